import itertools
import random

import pytest

from sheaf.llm import pieces


def text_of(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(["word ", "a", "b. ", "\n", "\n\n", "x, ", "漢", "\r\n"]) for _ in range(n))


@pytest.mark.parametrize(("most", "overlap"), [(50, 10), (20, 0), (7, 6), (1, 0), (30, 29)])
def test_pieces_cover_the_text_with_exact_overlap(most, overlap):
    for seed in range(40):
        text = text_of(seed, 60)
        start, rebuilt = 0, ""
        for k, end in enumerate(pieces.cuts(text, most, overlap)):
            piece = text[start:end]
            assert 0 < len(piece) <= most
            assert k == 0 or text[start : start + overlap] == rebuilt[len(rebuilt) - overlap :]
            rebuilt += piece[overlap if k else 0 :]
            start = end - overlap
        assert rebuilt == text


def test_cuts_are_optimal_over_all_choices():
    for seed in range(30):
        text = text_of(seed, 12)
        most, overlap = 18, 4
        if len(text) <= most:
            continue
        at, penalty = pieces.positions(text, most - overlap)
        cost = dict(zip(at.tolist(), penalty.tolist()))
        even = (len(text) - overlap) / -(-(len(text) - overlap) // (most - overlap))
        best = float("inf")
        inner = [p for p in at.tolist() if overlap <= p < len(text) and p > 0]

        def value(ends):
            total, last = 0.0, overlap
            for k, e in enumerate(ends):
                if (e > most if k == 0 else e - last > most - overlap) or e <= last and k:
                    return float("inf")
                total += cost[e] + pieces.UNEVEN * ((e - last) / even - 1) ** 2
                last = e
            return total

        for size in range(0, 6):
            for chosen in itertools.combinations(inner, size):
                best = min(best, value([*chosen, len(text)]))
        assert value(pieces.cuts(text, most, overlap)) == pytest.approx(best)


def test_cut_at_the_paragraph():
    text = "a" * 40 + "\n\n" + "b " * 20
    assert pieces.cuts(text, 50, 5)[0] == 42


def test_null_empty_repeated_and_odd_limits(spark):
    items = spark.createDataFrame([("k", 1, "abc " * 10), ("k", 1, "abc " * 10), ("k", 2, None), ("k", 3, ""), ("other", 4, "x" * 99), ("bad", 5, "x" * 9)], "item_kind string, item_id long, text string")
    limits = spark.createDataFrame([("k", 15, None, 1), ("bad", 0, 3, 2), ("none", 5, 1, 3)], "item_kind string, max_chars int, overlap_chars int, item_id int")
    rows = sorted(pieces.oversized_pieces(items, limits).collect())
    assert {(r.item_kind, r.item_id) for r in rows} == {("k", 1)}
    assert "".join(r.piece for r in rows) == "abc " * 10
    assert pieces.oversized_pieces(items.limit(0), limits).count() == 0
