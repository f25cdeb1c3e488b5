import json

import pytest
from pyspark.sql import functions as F

from sheaf.functions import fingerprints as fp
from sheaf.functions import keys, parsing, rules, tables, urls


def one(spark, column, **values):
    kinds = {str: "string", int: "int", list: "array<string>", type(None): "string", float: "double"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


def test_text_hash_ignores_case_and_space(spark):
    assert one(spark, fp.text_hash(F.col("t")), t="Hello  World ") == one(spark, fp.text_hash(F.col("t")), t="hello world")
    assert len(one(spark, fp.text_hash(F.col("t")), t=None)) == 16


def test_block_hash_label_option(spark):
    plain = one(spark, fp.block_hash(F.col("k"), F.col("t"), F.col("i")), k="benefit", t="x", i=["a"])
    assert plain != one(spark, fp.block_hash(F.col("k"), F.col("t"), F.col("i"), legacy_label=True), k="benefit", t="x", i=["a"])
    assert plain == one(spark, fp.text_hash(F.col("t")), t="benefit:x:a")


def test_snapshot_fingerprint_ignores_order(spark):
    f = fp.snapshot_fingerprint(F.col("i"))
    assert one(spark, f, i=["b:2", "a:1"]) == one(spark, f, i=["a:1", "b:2"])


def test_small_hashes_and_estimates(spark):
    assert one(spark, fp.rolling_hash(F.col("t")), t="abc") == "17862"
    assert one(spark, fp.token_estimate(F.col("t")), t="x" * 30) == 7
    assert len(one(spark, fp.short_id(F.col("t")), t="x")) == 12
    assert one(spark, fp.words(F.col("t")), t=" a b\n c ") == 3 and one(spark, fp.words(F.col("t")), t=None) == 0


@pytest.mark.parametrize(("url", "key"), [("HTTPS://A.Test/B/?q=1#f", "https://a.test/B/?q=1"), ("http://a.test/", "http://a.test"), ("/rel/", "/rel"), (None, None), ("https://X.test", "https://x.test")])
def test_url_key(spark, url, key):
    assert one(spark, keys.url_key(F.col("u")), u=url) == key


def test_host(spark):
    assert one(spark, keys.host(F.col("u")), u="https://user@A.Test:80/x") == "a.test"
    assert one(spark, keys.host(F.col("u")), u="no url") is None


def test_children_and_categories(spark):
    below = lambda p, b: one(spark, urls.is_child_path(F.lit(p), F.lit(b)))
    assert below("/x", "/") and below("/docs/a", "/docs") and below("/docs/", "/docs") and not below("/docsx", "/docs")
    assert below("/help/index/a", "/help/index.html") and not below("/help/other", "/help/index.html")
    assert one(spark, urls.category(F.col("u")), u="https://a.test/product/pricing") == "features"
    assert one(spark, urls.category(F.col("u")), u="https://a.test/zzz") is None
    assert one(spark, urls.normalized(F.col("u"), F.lit("B")), u="https://a.test/x/?q#f") == "B/x"
    assert one(spark, urls.normalized(F.col("u"), F.lit("B")), u="https://a.test/api/x") is None


def test_last_and_first_match(spark):
    text = "Our feature list has a benefit, see pricing and get started"
    assert one(spark, rules.content_class(F.col("k"), F.col("t"), F.lit(None).cast("string")), k="list", t=text) == "cta"
    assert one(spark, rules.content_class(F.col("k"), F.col("t"), F.lit(None).cast("string")), k="heading", t=text) == "heading"
    assert one(spark, rules.content_class(F.col("k"), F.col("t"), F.lit(None).cast("string")), k="quote", t="none of them") == "quote"
    assert one(spark, rules.framework(F.col("t")), t='<div id="__next" ng-version="1">') == "react"
    assert one(spark, rules.framework(F.col("t")), t='<div id="root">') == "unknown"


def test_image_rules(spark):
    df = spark.createDataFrame([("a.png", None, 40, 40), ("x/logo.png", None, 1, 1), ("data:image", None, 500, 500), ("https://t/pixel.gif", None, 500, 500), ("icon.png", None, 90, 90), ("big.png", None, 300, 300), ("nosize.png", None, None, None)], "url string, c string, w int, h int")
    rows = df.select("url", *rules.image_flags(F.col("c"), F.col("url")), "w", "h").select("url", rules.keeps_image(F.col("url"), F.col("w"), F.col("h")).alias("k"))
    assert {r.url: r.k for r in rows.collect()} == {"a.png": False, "x/logo.png": True, "data:image": False, "https://t/pixel.gif": False, "icon.png": False, "big.png": True, "nosize.png": True}


def test_tables(spark):
    kind = "t struct<headers:array<string>,rows:array<array<string>>,caption:string,source_selector:string>"
    df = spark.createDataFrame([((["A", "B"], [["1"], ["2", "3", "4"], None, [None, "x"]], "cap", None),), ((None, [["a|b", "c"], ["d"]], None, None),), ((None, None, None, None),)], kind)
    t = F.col("t")
    rows = df.select(tables.normalized_rows(t).alias("n"), tables.markdown(t).alias("m"), tables.escaped_markdown(t).alias("e"), tables.padded_markdown(t).alias("p"), tables.meaningful(t).alias("ok"), tables.kept(t).alias("kept")).collect()
    assert rows[0].n == [["1", ""], ["2", "3"], ["", "x"]] and rows[0].p.split("\n")[2] == "| 1 |  |"
    assert rows[0].e.startswith("**cap**\n\n| A | B |\n| --- | --- |")
    assert rows[1].n == [["a|b", "c"], ["d", ""]] and "a\\|b" in rows[1].e and rows[1].p == "| a|b | c |\n| --- | --- |\n| d |"
    assert rows[2].n == [] and rows[2].m == "" and rows[2].p == "" and not rows[2].ok and not rows[2].kept


def test_table_kinds_by_substring(spark):
    kind = "t struct<headers:array<string>,rows:array<array<string>>,caption:string,source_selector:string>"
    df = spark.createDataFrame([((["Product"], [["a"]], None, None),), ((["A"], [["yes", "no"], ["x", "b"]], None, None),), ((["A"], [["$5", "free"]], None, None),), ((["A"], [["now"]], None, None),)], kind)
    t = F.col("t")
    rows = [tuple(r) for r in df.select(tables.is_price_table(t), tables.is_comparison(t), tables.is_offer(t)).collect()]
    assert rows == [(True, False, True), (False, True, True), (True, False, False), (False, False, True)]


def test_json_forms(spark):
    for text in ('```json\n{"a": 1}\n```', '```\n{"a": 1}\n```', 'so: {"a": 1} end', '{"a": 1}'):
        assert json.loads(one(spark, parsing.extracted_json(F.col("t")), t=text)) == {"a": 1}
    assert one(spark, parsing.extracted_json(F.col("t")), t="x [1, 2] y") == "[1, 2]"
    assert one(spark, parsing.extracted_json(F.col("t")), t="none") is None


def test_lists_pairs_and_sections(spark):
    assert one(spark, parsing.bullet_points(F.col("t")), t="- a\n* b \n • c\nx\n-") == ["a", "b", "c"]
    assert one(spark, parsing.numbered_items(F.col("t")), t="1. a\n2) b\nx") == ["a", "b"]
    assert one(spark, parsing.key_values(F.col("t")), t="**My Key**: v\nother: w = 1\nx = 2\nmy key: last\nempty:") == {"my_key": "last", "other": "w = 1", "x": "2"}
    text = "intro\n# A\n## B\nbody\n#### deep\n# B\nagain"
    assert one(spark, parsing.markdown_sections(F.col("t")), t=text) == {"introduction": "intro", "b": "again"}
    assert one(spark, parsing.markdown_sections(F.col("t")), t=None) is None


def test_cuts_and_colours(spark):
    assert one(spark, parsing.shortened(F.col("t"), 5, 3), t="abcdef") == "abc..."
    assert one(spark, parsing.hex_rgb(F.col("t")), t="#0aff10") == [10, 255, 16] and one(spark, parsing.hex_rgb(F.col("t")), t="red") is None
