import datetime as dt

from sheaf.operators import snapshot_cells as S

PAGES = "extraction_id string, product_id string, started_at timestamp, url string, title string, page_text string, content_hash string, extracted_at timestamp, loaded_at timestamp, _before string, field string"


def at(day):
    return dt.datetime(2024, 1, day)


def pages(spark, rows):
    return spark.createDataFrame([(e, p, at(d), u, t, x, h, at(d), at(d + late), "clash", "clash") for e, p, d, u, t, x, h, late in rows], PAGES)


def changes(spark, rows, fields=("content_hash",)):
    return {(r.product_id, r.from_extraction, r.to_extraction, r.url_key, r.change, tuple(r.fields)) for r in S.page_changes(pages(spark, rows), fields).collect()}


def test_added_removed_changed_and_url_forms(spark):
    rows = [
        ("e1", "p", 1, "https://A.test/x/", "t", "Same  text", None, 0), ("e1", "p", 1, "https://a.test/gone", "t", "g", None, 0), ("e1", "p", 1, "https://a.test/c", "t", "old", None, 0),
        ("e2", "p", 5, "HTTPS://a.TEST/x#top", "new title", "same text ", None, 0), ("e2", "p", 5, "https://a.test/new", None, None, None, 0), ("e2", "p", 5, "https://a.test/c", "t", "new", None, 0),
    ]
    assert changes(spark, rows) == {
        ("p", "e1", "e2", "https://a.test/gone", "removed", ()), ("p", "e1", "e2", "https://a.test/new", "added", ()), ("p", "e1", "e2", "https://a.test/c", "changed", ("content_hash",)),
    }
    assert ("p", "e1", "e2", "https://a.test/x", "changed", ("title",)) in changes(spark, rows, ("content_hash", "title"))


def test_hash_notations_are_equal(spark):
    import hashlib

    h = hashlib.sha256(b"some text").hexdigest()
    rows = [("e1", "p", 1, "https://a.test/a", "t", "x", h[:32].upper(), 0), ("e2", "p", 2, "https://a.test/a", "t", "y", f"sha256:{h}", 0), ("e3", "p", 3, "https://a.test/a", "t", "Some \n text", "", 0)]
    assert changes(spark, rows) == set()


def test_repeated_superseded_null_and_single(spark):
    rows = [
        ("e1", "p", 1, "https://a.test/a", "t", "one", None, 0), ("e1", "p", 1, "https://a.test/a", "t", "one", None, 0), ("e2", "p", 2, "https://a.test/a/", "t", "two", None, 0), ("e2", "p", 2, "https://a.test/a", "t", "one", None, 3),
        ("s1", "single", 1, "https://b.test/", "t", "x", None, 0), ("n1", None, 1, "https://c.test/a", "t", "x", None, 0), ("n2", None, 2, "https://c.test/b", "t", "x", None, 0), ("e2", "p", 2, None, "t", "z", None, 0),
    ]
    assert changes(spark, rows) == {(None, "n1", "n2", "https://c.test/a", "removed", ()), (None, "n1", "n2", "https://c.test/b", "added", ())}
    assert changes(spark, []) == set()


def test_symmetry(spark):
    a = [("e1", "p", 1, f"https://a.test/{i}", "t", str(i), None, 0) for i in range(6)]
    b = [("e2", "p", 2, f"https://a.test/{i}", "t", str(i * 2), None, 0) for i in range(3, 9)]
    swap = {"added": "removed", "removed": "added", "changed": "changed"}
    forward = {(u, c) for _, _, _, u, c, _ in changes(spark, a + b)}
    back = [("e1", "p", 3, *r[3:]) for r in a]
    assert {(u, swap[c]) for _, f, _, u, c, _ in changes(spark, b + back) if f == "e2"} == forward
