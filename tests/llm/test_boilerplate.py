import random

from sheaf.llm import boilerplate as B

BLOCK = "block_id long, extraction_id string, page_id long, url string, content_type string, source_selector string, block_order int, text string, site string, path string"


def frame(spark, pages):
    rows, n = [], 0
    for p, (url, texts) in enumerate(pages):
        for o, t in enumerate(texts):
            rows.append((n, "e", p, url, "heading" if t and t.startswith("H:") else None, None, o, t, "clash", "clash"))
            n += 1
    return spark.createDataFrame(rows, BLOCK)


def test_common_lines_is_a_longest_common_subsequence():
    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(0)
    for _ in range(300):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 12))] for _ in range(2))
        pairs = B._dense(a, b)
        for x, y in (B.common_lines(a, b, B.positions(b)), ([i for i, _ in pairs], [j for _, j in pairs])):
            assert len(x) == brute(a, b) and [a[i] for i in x] == [b[j] for j in y] and x == sorted(x) and y == sorted(y)


def test_lines_repeated_thousands_of_times(monkeypatch):
    a, b = [1, 2] * 4000 + [3], [2] * 3000 + [4] + [1] * 3000 + [3]
    x, y = B.common_lines(a, b, B.positions(b))
    best = len(x)
    assert [a[i] for i in x] == [b[j] for j in y] and best == 4001
    monkeypatch.setattr(B, "HELD_BITS", 1_000_000)
    x, y = B.common_lines(a, b, B.positions(b))
    assert len(x) == best and [a[i] for i in x] == [b[j] for j in y] and x == sorted(x) and y == sorted(y)


def test_shared_blocks_go_and_main_stays(spark):
    pages = [(f"https://a.test/docs/p{i}", ["Wares\nPrices list\nOur people\n» Offices", f"H:Title {'abcdefgh'[i]}", f"Main text of page {'abcdefgh'[i]} says something.\nTell a friend about it today please", "Some odd footer line of this site", f"Startpage › Docs › Title {'abcdefgh'[i]}", "Most read this week\nOther title\nAnother one", None, ""]) for i in range(8)]
    rows = B.page_bodies(frame(spark, pages)).collect()
    kinds = {r.block_id % 8: set() for r in rows}
    for r in rows:
        kinds[r.block_id % 8].add(r.furniture)
    assert kinds == {0: {True}, 1: {False}, 2: {False}, 3: {True}, 4: {True}, 5: {True}, 6: {False}, 7: {False}}
    bodies = {r.block_id: r.body for r in rows}
    assert bodies[2] == "Main text of page a says something." and bodies[6] is None and bodies[7] == ""


def test_nulls_repeats_and_empty(spark):
    df = frame(spark, [(None, ["a text of its own"]), ("https://a.test/x", ["another text"]), ("https://b.test/x", ["another text"])])
    rows = B.page_bodies(df.union(df)).collect()
    assert sorted(r.block_id for r in rows) == [0, 1, 2] and not any(r.furniture for r in rows)
    assert B.page_bodies(df.limit(0)).count() == 0


def test_slots_and_labels():
    assert B.slots("Home › Docs › Quiet meter", True) == B.slots("Start / Wares / Loud meter", True) and B.slots("We plan. › Then › go", True) is None
    assert B.slots("Home › Docs › Quiet meter", False) is None and B.slots("A name: A title (12)", False) == "(0)"
    assert B.is_label("Our people") and not B.is_label("We sell it.")


def test_same_result_whatever_the_partitions(spark, monkeypatch):
    pages = [(f"https://h{i % 3}.test/docs/p{i:02}", [f"Line {'abcd'[i // 3 % 4]} of the shelf", f"H:Title {i}", f"Own text of page {'abcdefghijklmnopqrstuvwxyz'[i % 26]} {'xyz'[i // 26]} here.", "Subscribe to our letter."]) for i in range(60)]
    monkeypatch.setattr(B, "STRETCH", 17)
    found = []
    for parts, stretch in ((1, 17), (16, 17), (5, 1000)):
        B.STRETCH = stretch
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        found.append({(r.block_id, r.furniture, r.body) for r in B.page_bodies(frame(spark, pages)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2] and sum(f for _, f, _ in found[0]) >= 60


def test_wordings_are_learned_from_other_hosts(spark):
    pages = [(f"https://h{h}.test/p{i}", [f"Own words of host {'abc'[h]} page {'uvwxyz'[i]}.", "Get our letter every month."]) for h in range(2) for i in range(6)]
    pages.append(("https://lonely.test/p", ["Get our letter every month.", "Its own words."]))
    rows = {r.block_id: r.furniture for r in B.page_bodies(frame(spark, pages)).collect()}
    assert rows[24] and not rows[25]
