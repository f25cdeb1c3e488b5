import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import assembly, chunking, html, model, rollups, snapshots, templates, visuals
from sheaf.operators import cache_table as cache

S = chunking.Sizes(most=60, overlap=8, least=20)


def merge_small(chunks: list[tuple[str, list[str]]], s) -> list[tuple[str, list[str]]]:
    """Chunks (content, headers) of one snapshot within the limits: large ones are cut, small ones join the one before where both fit."""
    out: list[tuple[str, list[str]]] = []
    for content, headers in chunks:
        if len(content) > s.most:
            out += [(content[a:b].strip(), list(headers)) for a, b in chunking.spans(content, s)]
        elif len(content) < s.least and out and len(out[-1][0]) + len(content) < s.most:
            last, before = out[-1]
            out[-1] = (f"{last}\n\n{content}", [*before, *headers])
        else:
            out.append((content, list(headers)))
    return out


def test_chunk_sizes_must_advance():
    with pytest.raises(ValueError):
        chunking.Sizes(most=100, overlap=100, least=50)


def test_spans_cover_advance_and_overlap():
    for seed in range(50):
        r = random.Random(seed)
        text = "".join(r.choice(["word ", "a", "b. ", "c! ", "\n\n", "x", "longer words here "]) for _ in range(60))
        own = chunking.spans(text, S)
        assert own[0][0] == 0 and own[-1][1] == len(text)
        for (a, b), (c, e) in zip(own, own[1:]):
            assert c == b - S.overlap and e > b and b - a <= S.most


def test_break_prefers_first_listed_end():
    text = "a" * 25 + ". " + "b" * 10 + "! " + "c" * 40
    assert chunking.Breaks(text).last(20, 60) == 27
    assert chunking.Breaks("x" * 100).last(20, 60) == 60


def test_sliding_rows(spark):
    df = spark.createDataFrame([(1, "x" * 30, "clash"), (2, None, ""), (3, "", ""), (4, "word " * 30, "")], "k long, t string, start string")
    rows = chunking.sliding(df, "k", "t", S).collect()
    one = [r for r in rows if r.k == 1]
    assert [(r.chunk_index, r.total_chunks, r.token_estimate) for r in one] == [(0, 1, 7)]
    assert {r.k for r in rows} == {1, 3, 4} and len([r for r in rows if r.k == 4]) > 1
    assert chunking.sliding(df.limit(0), "k", "t", S).count() == 0


BLOCK = "block_id long, extraction_id string, page_id long, block_order int, content_type string, heading_level int, text string, markdown string"


def blocks(spark, rows):
    return spark.createDataFrame([(i, "e", p, o, k, lv, t, t) for i, (p, o, k, lv, t) in enumerate(rows)], BLOCK)


def test_sections_span_pages_and_bare_headings_vanish(spark):
    df = blocks(spark, [(1, 0, "paragraph", None, "before"), (1, 1, "heading", 1, "H1"), (1, 2, "heading", 2, "H2"), (1, 3, "heading", 3, "deep"), (1, 4, "paragraph", None, "x"), (2, 0, "paragraph", None, "next page"), (2, 1, "heading", 1, "last")])
    rows = sorted(chunking.sections(df).collect(), key=lambda r: r.section)
    assert [(r.header, r.content, r.pages) for r in rows] == [("Introduction", "before", 1), ("H2", "deep\n\nx\n\nnext page", 2)]


def test_packing_and_hybrid_equal_a_plain_loop(spark):
    r = random.Random(1)
    made = [("e%d" % (i % 3), i, "h%d" % i, "word. " * r.randint(1, 14)) for i in range(40)]
    df = spark.createDataFrame([(*m, 1) for m in made], "extraction_id string, section long, header string, content string, pages long")
    for e in ("e0", "e1", "e2"):
        chunks, text, heads = [], "", []
        for _, _, h, c in (m for m in made if m[0] == e):
            part = f"\n\n## {h}\n\n{c}"
            if text and len(text) + len(part) > S.most:
                chunks.append((text.strip(), heads))
                text, heads = "", []
            text, heads = text + part, [*heads, h]
        chunks.append((text.strip(), heads))
        got = sorted((x.chunk_index, x.content, list(x.headers)) for x in chunking.packed_chunks(df, S).where(F.col("extraction_id") == e).collect())
        assert [(c, h) for _, c, h in got] == [(c, h) for c, h in chunks]
        both = sorted((x.chunk_index, x.content, list(x.headers)) for x in chunking.hybrid(df, S).where(F.col("extraction_id") == e).collect())
        assert [(c, h) for _, c, h in both] == merge_small(chunks, S)


def test_fixed_and_by_page(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "k long, t string")
    assert [(r.chunk_index, r.content) for r in chunking.fixed(df, "k", "t", 4, 3).orderBy("chunk_index").collect()] == [(0, "abcd"), (1, "defg"), (2, "ghij"), (3, "j")]
    rows = chunking.by_page(blocks(spark, [(1, 0, "p", None, "word " * 30), (2, 0, "p", None, "short")]), S).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and rows[-1].content == "short"


def test_block_text(spark):
    df = spark.createDataFrame([("heading", "My Heading", 2, None), ("code", "print('hello')", None, None), ("quote", "q", None, None), ("list", "t", None, ["a", "b"]), ("list", "t", None, []), ("table", "t", None, None)], "k string, t string, l int, i array<string>")
    rows = df.select(chunking.block_text(F.col("k"), F.col("t"), F.col("l"), F.col("i"), F.lit(None).cast("string")).alias("r")).collect()
    assert [r.r for r in rows] == ["## My Heading", "```\nprint('hello')\n```", "> q", "- a\n- b", "- t", "t"]


def test_cache_rules(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (10.0,), (None,)], "ttl double").select(cache.expiry(F.lit(100.0), F.col("ttl"), 5).alias("e"))
    assert [r.e for r in df.collect()] == [99.0, None, 110.0, 105.0]
    entries = spark.createDataFrame([(1, "a:h1", "h1", "old", 1.0, None), (2, "a:h1", "h1", "new", 2.0, 500.0), (3, "b:h1", "h1", "x", 1.0, 50.0), (4, "a:h2", "h2", "y", 1.0, None)], "entry_id long, key string, content_hash string, data string, created_at double, expires_at double")
    asked = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("a", None)], "aspect string, content_hash string")
    rows = cache.probe(asked, entries, F.lit(100.0))
    assert {(r.aspect, r.content_hash, r.hit, r.cached) for r in rows.collect()} == {("a", "h1", True, "new"), ("b", "h1", False, None), ("a", None, False, None)}
    assert cache.hit_statistics(rows).first().hit_rate == 0.3333 and cache.hit_statistics(rows.limit(0)).first().hit_rate == 0.0
    assert {r.entry_id for r in cache.without(entries, content_hashes=asked.where("content_hash = 'h1'").select("content_hash").distinct()).collect()} == {4}
    answers, fresh = cache.cached(asked.where("content_hash IS NOT NULL"), entries, F.lit(100.0), lambda miss: miss.withColumn("data", F.lit("made")))
    assert {(r.aspect, r.data) for r in answers.collect()} == {("a", "new"), ("b", "made")} and [r.key for r in fresh.collect()] == ["b:h1"]


def test_least_recently_used_goes(spark):
    uses = spark.createDataFrame([("1", 1), ("2", 2), ("3", 3), ("1", 4), ("2", 5), ("4", 6)], "key string, at int")
    assert {r.key for r in cache.kept_by_use(uses, 3).collect()} == {"1", "2", "4"}


def test_run_totals(spark):
    items = spark.createDataFrame([(True, 500, 0.01), (True, 500, 0.01), (False, 9, 9.0)], "success boolean, tokens int, amount double")
    r = rollups.batch_totals(items).first()
    assert (r.total, r.successful, r.failed, r.tokens, r.amount) == (3, 2, 1, 1000, 0.02) and rollups.batch_totals(items.limit(0)).first().success_rate == 0.0
    log = spark.createDataFrame([("a", 1, 1, False), ("a", 2, 2, False), ("a", 3, 3, True), ("b", 1, 1, False), ("b", 2, 2, False), ("b", 3, 3, False), ("b", 4, 4, True)], "item string, at int, seq int, ok boolean")
    assert {(r.item, r.success, r.retries) for r in rollups.retry_outcomes(log, 2).collect()} == {("a", True, 2), ("b", False, 3)}
    calls = spark.createDataFrame([("m", 1_000_000, 100_000), ("unknown", 1_000_000, 0)], "model string, input_tokens long, output_tokens long")
    rates = spark.createDataFrame([("m", 3.0, 15.0)], "model string, input_per_m double, output_per_m double")
    assert {(r.model, r.cost) for r in rollups.usage_cost(calls, rates, "m").collect()} == {("m", 4.5), ("unknown", 3.0), (None, 7.5)}
    assert [r.c for r in spark.createDataFrame([("CORE",), ("weird",), (None,)], "c string").select(rollups.coerced(F.col("c"), rollups.CATEGORIES, "other").alias("c")).collect()] == ["core", "other", "other"]


def test_crawl_plan_caps(spark):
    rows = [("s", f"/product/{i}", "features", i) for i in range(30)] + [("s", f"/pricing/{i}", "pricing", 100 + i) for i in range(5)] + [("s", f"/x{i}", None, 200 + i) for i in range(30)] + [("s", "/blog/1", "blog", 1)]
    plan = snapshots.crawl_plan(spark.createDataFrame(rows, "site string, path string, category string, page_id long")).orderBy("place").collect()
    assert [p.path for p in plan] == [f"/product/{i}" for i in range(10)] + ["/pricing/0", "/pricing/1"] + [f"/x{i}" for i in range(8)]


def test_newest_diff(spark):
    rows = [("p", "a", 1, "k1", "1"), ("p", "a", 1, "k2", "1"), ("p", "b", 2, "k2", "2"), ("p", "b", 2, "k3", "1"), ("q", "c", 1, "k", "1")]
    got = snapshots.newest_diff(spark.createDataFrame(rows, "product_id string, extraction_id string, started_at int, url_key string, content_hash string"))
    assert {(r.url_key, r.status) for r in got.collect()} == {("k1", "removed"), ("k2", "modified"), ("k3", "added"), ("k", "added")}


def test_visuals(spark):
    assert spark.range(1).select(visuals.image_file(F.lit("https://a.test/p.PNG?x=1")).alias("f")).first().f.endswith(".png")
    assets = spark.createDataFrame([("o", "t1", "table", "comparison", 1, 0), ("o", "s1", "image", "screenshot", 2, 0), ("o", "s2", "image", "screenshot", 3, 0), ("o", "g", "image", "image", 4, 0)], "owner string, asset_id string, asset_type string, kind string, block_id long, pos int")
    wanted = spark.createDataFrame([("o", "hook"), ("o", "features"), ("o", "differentiators"), ("o", "pricing")], "owner string, section_type string")
    got = {(r.section_type, r.asset_id, r.place) for r in visuals.candidates(wanted, assets).collect()}
    assert got == {("hook", "s1", 1), ("features", "s1", 1), ("features", "s2", 2), ("differentiators", "t1", 1), ("pricing", "g", 1)}
    mapping = spark.createDataFrame([("f", ["x", "s2", "s1"]), ("none", ["x"])], "name string, asset_ids array<string>")
    assert {(r.name, tuple(r.asset_ids)) for r in visuals.valid_mapping(mapping, assets).collect()} == {("f", ("s2", "s1"))}


SECTION = "pitch_id long, section_id long, section_type string, title string, content string, key_points array<string>, talking_points array<string>, section_order int"


def test_documents(spark):
    df = spark.createDataFrame([(1, 2, "cta", "Call", "go now", ["Try", "Ask", "s1", "s2"], None, 1), (1, 1, "hook", "Hook", "one two. three", ["k a"], ["note"], 2), (2, 3, "hook", None, None, None, None, 1)], SECTION)
    text = {r.pitch_id: r.text for r in assembly.markdown(df).collect()}
    assert text[1].startswith("## Call\n\ngo now\n\n- Try") and text[2] == "## \n\n"
    assert {r.pitch_id: r.text for r in assembly.plain_text(df).collect()}[1].startswith("Call\n====\ngo now")
    assert {(r.pitch_id, r.words) for r in assembly.totals(df).collect()} == {(1, 11), (2, 0)}
    plan = [(r.kind, r.title) for r in assembly.slides(df).where("pitch_id = 1").orderBy("slide_no").collect()]
    assert plan == [("title", "Hook"), ("content", "Hook"), ("cta", "Call")]
    r = assembly.call_to_action(df).first()
    assert (r.first_call, r.second_call, r.steps) == ("Try", "Ask", "s1 | s2")
    assert assembly.chosen_sections(df, ["hook"]).count() == 2 and assembly.chosen_sections(df, None, ("hook",)).count() == 1


PAGE = """<html><head><title>T &amp; co</title><meta name="description" content="d"><meta name=keywords content="a, b"><link rel=canonical href="/c">
<script type="application/ld+json">{"a": 1}</script><script type="application/ld+json">{broken</script><script>var s = "<p>not a paragraph</p>";</script></head>
<body><nav><p>navigation paragraph</p></nav><div class="Cookie-bar"><p>cookies everywhere</p></div><h1>Head <b>line</b></h1><p>First paragraph text<p>Second one, unclosed
<ul><li>item one<li>item two<ul><li>nested item</ul></ul><blockquote>A quote long enough</blockquote><pre><code>code here</code></pre><p>with <code>inline code</code> inside</p>
<dl><dt>term<dd>definition</dl><h2>Sub</h2>
<table><caption>Cap</caption><thead><tr><th>A<th>B</thead><tr><td colspan=2>wide<tr><td><tr><td>1<td>2<td>3</table>
<figure><img src="/i.png" alt="x" width=10><figcaption>fig</figcaption></figure><img src="data:x" data-src="lazy.png"><picture><source srcset="s.png 1x, l.png 2x"></picture>
<a href="/in">in</a><a href="https://other.test/">out</a><a href="#x">no</a><a href="/in">again</a><footer><p>footer paragraph</p></footer></body>"""


def test_html_page():
    p = html.parsed(PAGE, "https://a.test/d/")
    kinds = [(b["kind"], b["text"]) for b in p["blocks"]]
    assert kinds[:2] == [("heading", "Head line"), ("heading", "Sub")]
    assert ("paragraph", "First paragraph text") in kinds and ("paragraph", "Second one, unclosed") in kinds and not any("navigation" in t or "cookies" in t or "footer" in t or "not a" in t for _, t in kinds)
    assert ("quote", "A quote long enough") in kinds and [k for k, t in kinds].count("code") == 2 and ("list", "nested item") in kinds and ("list", "term: definition") in kinds
    assert p["tables"] == [{"caption": "Cap", "headers": ["A", "B"], "rows": [["wide", "wide"], ["1", "2"]]}]
    assert [i["url"] for i in p["images"]] == ["https://a.test/i.png", "https://a.test/d/lazy.png", "https://a.test/d/l.png"] and p["images"][0]["caption"] == "fig"
    assert [(x["url"], x["kind"]) for x in p["links"]] == [("https://a.test/in", "internal"), ("https://other.test/", "external"), ("https://a.test/in", "internal")]
    assert p["meta"] == {"title": "T & co", "description": "d", "keywords": ["a", "b"], "canonical": "/c", "json_ld": 1}
    assert html.parsed(None, None)["blocks"] == [] and html.parsed("<p>" * 50, "x")["blocks"] == []


def test_html_rows(spark):
    df = spark.createDataFrame([(1, PAGE, "clash"), (2, None, ""), (3, "", "")], "page_id long, html string, kind string")
    rows = html.page_blocks(df).collect()
    assert {r.page_id for r in rows} == {1} and {r.parent for r in rows if r.kind == "paragraph"} == {"Head line"} and {r.parent for r in rows if r.kind == "code"} == {"Sub"}


def test_templates(spark):
    t = "{{#if a}} yes {{/if}}{{#each xs}}{{index}}:{{item}} {{/each}}\n\n\n\n{{b}}"
    assert templates.render(t, {"a": 1, "xs": ["p", "q"], "b": "B"}) == "yes0:p\n1:q\n\nB"
    assert templates.render("{{#each xs}}{{item.k}}{{/each}}", {"xs": [{"k": 1}, {"k": 2}]}) == "1\n2"
    with pytest.raises(templates.MissingVariables):
        templates.render("{{x}}", {}, defaults={"x": 1})
    assert templates.render("{{x}}{{y}}", {}, strict=False, defaults={"x": 1}) == "1{{y}}"
    rows = spark.createDataFrame([(1, "{{x}}", '{"x": 5}'), (2, "{{x}}", None), (3, "{{x}}", "broken")], "k int, template string, values string")
    assert {(r.k, r.text) for r in templates.rendered(rows, "k").collect()} == {(1, "5"), (2, None), (3, None)}
    reg = spark.createDataFrame([("n", 1, "old"), ("n", 2, "new")], "name string, seq int, template string")
    assert templates.current(reg).first().template == "new" and {(r.seq, r.back) for r in templates.history(reg).collect()} == {(1, 1), (2, 0)}


def test_model_calls(spark):
    texts = spark.createDataFrame([(1, "One sentence of words. Another sentence of words."), (2, None)], "key int, text string")
    with pytest.raises(ValueError):
        model.prompts(texts, ["nonsense"])
    ok = model.called(model.prompts(texts, ["features", "name"]))
    assert {(r.aspect, r.error, r.attempts) for r in ok.collect()} == {("features", None, 1), ("name", None, 1)}

    def failing():
        def ask(p):
            raise RuntimeError("down")

        return ask

    bad = model.called(model.prompts(texts, ["features"]), failing, retries=2)
    assert [(r.answer, r.error, r.attempts) for r in bad.collect()] == [(None, "RuntimeError: down", 3)]
    assert [(r.confidence, r.aspects_ok) for r in model.run_totals(ok.unionByName(bad)).collect()] == [(0.6667, 2)]


def test_page_structure_and_nearby_images():
    page = '<nav class="menu"><a href="/t" >x</a></nav><main><p>%s</p></main><div class="tabs"><a href="/tab1">1</a><a href="/tab1">1</a><a href="x">2</a></div><div class="card"><img src="/c.png"><p>A paragraph in a card</p></div><details></details>' % ("word " * 40)
    p = html.parsed(page, "https://a.test/")
    s = p["structure"]
    assert (s["main"], s["navigation"], s["sidebar"], s["tabs"], s["accordions"]) == ("main", "nav", None, 1, 1) and s["tab_links"] == ["https://a.test/tab1"]
    assert [b["images"] for b in p["blocks"] if "card" in b["text"]] == [["https://a.test/c.png"]]


def test_videos_selection_relevance_context_variants(spark):
    v = spark.createDataFrame([("o", "u", "e", "t", None), ("o", "w", None, None, None), ("o", None, "e", None, None)], "owner string, url string, embed_url string, title string, caption string")
    assert sorted(r.url for r in visuals.video_assets(v).collect()) == ["e", "w"]
    picks = spark.createDataFrame([("o", "s", 0, "x"), ("o", "s", 1, "b"), ("o", "s", 2, "a"), ("o", "s", 3, "c")], "owner string, section_type string, pos int, asset_id string")
    known = spark.createDataFrame([("o", "a"), ("o", "b"), ("o", "c"), ("o", "a")], "owner string, asset_id string")
    assert [(r.asset_id, r.place) for r in visuals.selected(picks, known).orderBy("place").collect()] == [("b", 1), ("a", 2)]
    assert spark.range(1).select(visuals.relevance(F.lit("quiet meter works"), F.lit("Meter, quiet")).alias("r")).first().r == 1.0
    kind = "product string, audience string, industry string, company string, pain_points array<string>, features array<struct<name:string,description:string,benefits:array<string>>>, benefits array<struct<headline:string,description:string>>"
    c = assembly.context(spark.createDataFrame([("p", None, "", None, [], [("n", "d", ["x", "y", "z"])], None)], kind)).first()
    assert c.target_audience == "general business audience" and c.features_list == "1. n: d\n   Benefits: x, y" and c.benefits_list == "No specific benefits available"
    both = assembly.variants(spark.createDataFrame([(1,)], "pitch_id int"), ["Manager", "Developer"])
    assert both.count() == 2 and assembly.variant(both, "MANAGER").count() == 1


def test_section_contexts_hold_whole_contents(spark, tmp_path):
    from sheaf.plans import document_queries

    long = "long text " * 500 + "end"
    rows = [("p", 1, "q", "A", long, ["x", "y", "z"]), ("p", 2, "q", None, None, None)]
    spark.createDataFrame(rows, "product_id string, section_id long, pitch_id string, title string, content string, key_points array<string>").write.parquet(f"{tmp_path}/pitch_sections.parquet")
    assert document_queries.section_contexts(spark, str(tmp_path)).first().features_list == f"1. A: {long}\n   Benefits: x, y\n2. : "


def test_html_that_cannot_be_read_fails_no_task(spark):
    odd = '<img src="a.png" width="²"><img src="http://[bad"><picture><source srcset=" , "></picture><table><tr><td colspan="²">x</td></tr></table><a href="http://[bad">l</a><p>A paragraph of text. <img src="http://[worse"></p>'
    rows = {r.page_id: r for r in html.pages(spark.createDataFrame([(1, odd, "http://[base"), (2, "<p>Plain paragraph.</p>", None)], "page_id long, html string, url string")).collect()}
    assert rows[1].error is None and rows[2].blocks[0].text == "Plain paragraph." and [i.width for i in rows[1].images][:1] == [0]
    page, error = html.parsed_or_error(7, "https://a.test/")
    assert page["blocks"] == [] and error


def test_html_takes_linear_time():
    import time

    def seconds(n):
        t = time.process_time()
        html.parsed("<div class=card>" + "<h2>Head</h2><p>Some paragraph here.</p>" * n + "</div>", "")
        return time.process_time() - t

    seconds(100)
    assert seconds(8000) < 8 * max(seconds(2000), 0.02)
