import json

from pyspark.sql import functions as F

from sheaf.operators import list_tables as L
from sheaf.operators import nested as N


def entries(spark, rows):
    return spark.createDataFrame([(i, k, d, "clash") for i, k, d in rows], "entry_id long, key string, data string, _pos string")


def blocks(spark, rows=()):
    return spark.createDataFrame(list(rows), "block_id long, table_data struct<headers:array<string>,rows:array<array<string>>,caption:string,source_selector:string>, value string")


def found(spark, rows, tables=()):
    return {tuple(r) for r in L.list_elements(blocks(spark, tables), entries(spark, rows)).collect()}


def test_outer_forms_lone_values_and_positions(spark):
    feature = {"name": "a", "benefits": ["x", None, " ", {"headline": "h"}, 3], "extra": {"nested": {"benefits": ["no"]}}}
    body = {"features": [None, feature, {"name": "b", "benefits": "lone"}, "text", {"benefits": None}]}
    expected = lambda i: {("benefit", i, 1, 0), ("benefit", i, 1, 3), ("benefit", i, 1, 4), ("benefit", i, 2, 0)}
    texts = [json.dumps(body), json.dumps({"data": body}), json.dumps(body["features"]), json.dumps(json.dumps(body)), f"```json\n{json.dumps(body, indent=1)}\n```", f"Here it is [1]:\n{json.dumps(body)}\nBye.", "﻿" + json.dumps(body)]
    rows = [(i, "Features:h", t) for i, t in enumerate(texts)]
    assert found(spark, rows) == set().union(*(expected(i) for i in range(len(texts))))


def test_single_object_instead_of_a_list(spark):
    assert found(spark, [(1, "use_cases:h", json.dumps({"use_cases": {"key_features_used": ["a", "b"]}}))]) == {("key_feature", 1, 0, 0), ("key_feature", 1, 0, 1)}


def test_broken_missing_repeated_and_empty(spark):
    whole = json.dumps([{"benefits": ["a"]}, {"benefits": ["b"]}])
    rows = [(1, "features:h", whole[:-6]), (2, "features:h", None), (3, "features:h", ""), (4, "features:h", "null"), (5, "other:h", whole), (6, None, whole), (7, "features:h", whole), (7, "features:h", whole)]
    assert found(spark, rows) == {("benefit", 7, 0, 0), ("benefit", 7, 1, 0)}
    assert found(spark, []) == set()


def test_table_cells(spark):
    tables = [(1, (None, [["a", " ", None], None, [], ["b"]], None, None), "v"), (2, (["h"], None, None, None), None), (3, None, None), (1, (None, [["a", " ", None], None, [], ["b"]], None, None), "v")]
    assert found(spark, [], tables) == {("table_cell", 1, 0, 0), ("table_cell", 1, 3, 0)}


def test_typed_tables_keep_parent_links(spark):
    df = spark.createDataFrame([(7, [(1, ["a", None]), None, (2, None)], ("s", [5]))], "id long, items array<struct<n:int,tags:array<string>>>, box struct<name:string,nums:array<int>>")
    t = N.flatten_typed(df, "id")
    assert set(t) == {"", "items", "box.nums", "items.tags"}
    assert [(r["box.name"]) for r in t[""].collect()] == ["s"]
    items = sorted(t["items"].collect(), key=lambda r: r._at)
    assert [(r._at, r.n) for r in items] == [([0], 1), ([1], None), ([2], 2)]
    tags = t["items.tags"].collect()
    assert {(r._at[0], r._at[1], r.value) for r in tags} == {(0, 0, "a"), (0, 1, None)} and {r._parent for r in tags} == {items[0]._key}


def test_schema_notation_and_variant_levels(spark):
    assert N.parse_schema("OBJECT<a: ARRAY<BIGINT>, `b c`: OBJECT<d: DECIMAL(3,2)>>") == {"a": ["BIGINT"], "b c": {"d": "DECIMAL(3,2)"}}
    df = spark.createDataFrame([(1, '[{"a": [{"b": [1, 2]}]}, {"a": {"b": 3}}]')], "k long, t string").select("k", F.parse_json("t").alias("v"))
    t = N.flatten_variant(df, "k", "v")
    assert t[""].count() == 2 and t["a"].count() == 2


def test_fields_of_any_name_get_tables(spark):
    text = json.dumps([{"it's": [1, 2], "ok": [3], "a]b": [4], 'say "x"': [5], "it's \"x\"": [6], "wh?t": [7], "a.b": {"c d": [8, 9]}, "": [10]}])
    df = spark.createDataFrame([(1, text)], "k long, t string").select("k", F.parse_json("t").alias("v"))
    t = N.flatten_variant(df, "k", "v")
    assert {n: d.count() for n, d in t.items()} == {"": 1, "it's": 2, "ok": 1, "a]b": 1, 'say "x"': 1, "it's \"x\"": 1, "wh?t": 1, "a.b.c d": 2, ".": 1}
