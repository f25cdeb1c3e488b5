import json
import random

from pyspark.sql import functions as F

from sheaf.functions import parsing
from sheaf.operators import assembly, chunking, model, snapshots, statistics, templates, visuals
from sheaf.session import run_dir, small


def entries(spark, rows):
    return spark.createDataFrame([(i, k, d, "clash") for i, (k, d) in enumerate(rows)], "entry_id long, key string, data string, pos string")


def test_statistics_of_answers(spark):
    features = [{"name": "a", "category": "Core", "is_flagship": True}, None, {"name": "b", "category": "odd"}, "text", {"category": "core"}]
    benefits = [{"headline": f"h{i}", "target_audience": ["x", "y"][: i % 3], "supporting_features": ["a", "a", None]} for i in range(7)]
    cases = {"title": "only one", "industry_vertical": "Retail", "key_features_used": []}
    rows = [("features:1", json.dumps({"features": features})), ("benefits:1", json.dumps(benefits)), ("use_cases:1", json.dumps(cases)), ("features:2", "{broken"), ("features:3", None), (None, "[]")]
    df = entries(spark, rows)
    parsed = statistics.answers(df.union(df))
    got = {(r.entry_id, r.statistic): r["values"] for r in statistics.recomputed(parsed).collect()}
    assert got == {
        (0, "flagship_features"): ["a"], (0, "features_by_category"): ["core:1", "other:1"], (1, "top_benefits"): ["h0", "h1", "h2", "h3", "h4"], (2, "primary_use_cases"): ["only one"], (2, "industries"): ["Retail"],
    }
    by = {(r.audience): r["values"] for r in statistics.headlines_by_audience(statistics.elements(parsed, "benefits")).collect()}
    assert by == {"x": ["h1", "h2", "h4", "h5"], "y": ["h2", "h5"]}
    assert [tuple(r) for r in statistics.headlines_by_feature(statistics.elements(parsed, "benefits")).collect()] == [("a", 7)]
    assert statistics.recomputed(statistics.answers(df.limit(0))).count() == 0


def test_lenient_lists_and_sections(spark):
    texts = ['[{"name": 1}, {"x": 2}, 3]', '{"name": "a"}', "none", None, '```json\n[1]\n```', '["a"], "b": []']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    sizes = {r.i: (r.a, r.b) for r in df.select("i", F.size(parsing.parsed_list(F.col("t"))).alias("a"), F.size(parsing.parsed_list(F.col("t"), "name")).alias("b")).collect()}
    assert sizes == {0: (3, 1), 1: (1, 1), 2: (0, 0), 3: (0, 0), 4: (1, 0), 5: (0, 0)}
    answers = ['```json\n{"title": "T", "content": "C"}\n```', 'Here: {"title": "T"} done', " plain words ", "```\nno json\n```", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(answers)], "i int, t string").select("i", parsing.lenient_section(F.col("t")).alias("s")).collect()
    assert [tuple(r.s) for r in rows[:5]] == [(True, "T", "C"), (True, "T", None), (False, "Section", "plain words"), (False, "Section", "no json"), (False, "Section", "")]


def test_snapshot_chunks_equal_those_of_the_whole_text(spark):
    r = random.Random(3)
    pages = [("s%d" % (i % 3), i, "".join(r.choice(["word ", ". ", "\n\n", "x", "\n"]) for _ in range(r.randint(0, 120)))) for i in range(24)] + [("t", 1, "small"), ("u", 1, None)]
    s = chunking.Sizes(most=60, overlap=8, least=20)
    got = {}
    for c in chunking.fixed_snapshots(spark.createDataFrame(pages, "extraction_id string, place int, text string"), s).orderBy("extraction_id", "chunk_index").collect():
        got.setdefault(c.extraction_id, []).append((c.start, c.end, c.content))
    for e in ("s0", "s1", "s2", "t"):
        text = "\n\n---\n\n".join(t or "" for x, _, t in pages if x == e)
        own = chunking.spans(text, s)
        assert got[e] == [(a, b, text if len(text) <= s.most else text[a:b].strip()) for a, b in own]
    assert "u" not in got


def test_strategies(spark):
    kinds = "block_id long, extraction_id string, page_id long, block_order int, content_type string, heading_level int, text string, markdown string"
    rows = [(1, "e", 1, 0, "heading", 1, "H", "# H"), (2, "e", 1, 1, "paragraph", None, "some words", "some words"), (3, "e", 2, 0, "paragraph", None, "other words", "other words")]
    df = spark.createDataFrame(rows, kinds)
    contents = {k: [r.content for r in chunking.chunked(df, k).orderBy("chunk_index").collect()] for k in ("page", "semantic", "fixed", "hybrid", "anything")}
    assert contents["page"] == ["# H\n\nsome words", "other words"] and contents["fixed"] == ["# H\n\nsome words\n\n---\n\nother words"]
    assert contents["semantic"] == contents["hybrid"] == contents["anything"] == ["## H\n\nsome words\n\nother words"]


def test_media_take_the_exact_url_first(spark):
    images = spark.createDataFrame([(1, 0, "u/", None, None), (2, 0, "v", "own", 5), (3, 0, "w", None, 7)], "block_id long, pos int, url string, local_path string, file_size int")
    sources = spark.createDataFrame([("u", "a", 1), ("u/", "b", 2), ("v", "c", 3), ("w", None, 9)], "url string, local_path string, file_size int")
    assert {tuple(r)[0:1] + tuple(r)[3:] for r in snapshots.enriched_media(images, sources).collect()} == {(1, "b", 2), (2, "own", 5), (3, None, 7)}


def test_block_changes(spark):
    side = lambda rows: spark.createDataFrame(rows, "page_id long, hash string, text string")
    new, old = side([(1, "a", "x" * 300), (1, "b", "same"), (1, "b", "same")]), side([(1, "b", "same"), (1, "c", "gone"), (2, "a", "other page")])
    got = {(r.page_id, r.change, r.hash, len(r.text)) for r in snapshots.block_changes(new, old).collect()}
    assert got == {(1, "new", "a", 203), (1, "removed", "c", 4), (2, "removed", "a", 10)}


def test_names_models_contents_and_assets(spark):
    def make():
        def ask(prompt):
            if "bad" in prompt:
                raise RuntimeError
            return ' "The \'Name" '

        return ask

    texts = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "key long, text string")
    assert {tuple(r) for r in model.detected_names(texts, make).collect()} == {(1, "The 'Name"), (2, "Unknown Product")}
    calls = spark.createDataFrame([(1, "t", 5), (2, "other", 50), (3, None, 5)], "key long, task string, tokens int")
    got = model.settled(calls, spark.createDataFrame([("m", 10)], "model string, window int"), spark.createDataFrame([("t", "x")], "task string, model string"), "m")
    assert {tuple(r) for r in got.collect()} == {(1, "x", True), (2, "m", False), (3, "m", True)}
    sections = spark.createDataFrame([(1, 1, 2, "b", "cta", ["k"]), (1, 2, 1, "a", "hook", None)], "pitch_id long, section_id long, section_order int, title string, section_type string, key_points array<string>")
    assert [r.entry for r in assembly.contents(sections).orderBy("number").collect()] == ["Executive Summary", "a", "b", "Next Steps"]
    assets = spark.createDataFrame([("o", "t1", "table", 1, 0), ("o", "i1", "image", 2, 0), ("o", "i2", "image", 1, 0), ("o", "z", "image", 0, 0)], "owner string, asset_id string, asset_type string, block_id long, pos int")
    ids = spark.createDataFrame([("t1",), ("i1",), ("i2",), ("i2",), ("none",)], "asset_id string")
    assert [r.asset_id for r in visuals.assets_by_ids(assets, ids).orderBy("place").collect()] == ["i2", "i1", "t1"]


def test_broadcasts_are_measured_in_bytes(spark):
    rows = spark.createDataFrame([("x" * 1000, [1, 2])], "a string, b array<int>")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(small(rows)) and not hinted(small(rows, 500))
    assert run_dir(spark) == run_dir(spark)


def test_templates_by_tag_version_and_kind(spark):
    dims = spark.createDataFrame([("a", 1, ["x"], "old"), ("a", 2, ["y"], "new"), ("b", 1, None, "only")], "name string, version int, tags array<string>, template string")
    assert [r.name for r in templates.by_tag(dims, "y").collect()] == ["a"] and templates.by_tag(dims, "x").count() == 0
    assert templates.version_of(dims, "a").first().template == "new" and templates.version_of(dims, "a", 1).first().template == "old" and templates.version_of(dims, "c").count() == 0
    rows = spark.createDataFrame([(1, "k", {"p": "P", "q": "Q"}), (2, "k", {"p": None}), (3, "none", {}), (4, None, None), (5, "plain", None)], "key long, kind string, values map<string,string>")
    got = {r.key: (r.text, r.error) for r in templates.filled(rows, spark.createDataFrame([("k", "{p} and {q} and {p}"), ("plain", "text")], "kind string, template string"), "kind").collect()}
    assert got == {1: ("P and Q and P", None), 2: (None, "missing: p, q"), 3: (None, "no template"), 4: (None, "no template"), 5: ("text", None)}
    both = spark.range(1).select(templates.completed(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m"), templates.completed(F.create_map(F.lit("a"), F.lit("1")), F.lit(None).cast("map<string,string>")).alias("n")).first()
    assert both.m == {"a": "1", "b": "3"} and both.n == {"a": "1"}
