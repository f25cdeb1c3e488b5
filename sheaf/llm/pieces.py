"""Cutting oversized texts into overlapping pieces at natural boundaries.

Every boundary position of a text has a penalty (paragraph, line, sentence,
clause, word, anywhere). Dynamic programming over the positions finds the cuts
with the least sum of penalties and size imbalance such that no piece is longer
than the limit and each piece starts a fixed overlap before the last cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import small

# Boundaries, the last that matches a position counts least: pattern whose end is the cut, and penalty.
BOUNDARIES = (
    (r"\s+", 6.0),
    (r"[,;:–—)\]»”]\s+", 3.0),
    (r"[.!?…。！？][\"'”»)\]]*\s+|[。！？]", 1.0),
    (r"\r\n|\n|\r| ", 0.5),
    (r"(?:\r?\n[ \t]*){2,}| ", 0.0),
)
#: Penalty of a cut inside a word, and weight of the squared relative deviation from even sizes.
INSIDE, UNEVEN = 40.0, 8.0
#: Where natural boundaries are farther apart than a piece may reach, this many positions per reach are offered.
OFFERED = 16

_COMPILED = tuple((re.compile(p), cost) for p, cost in BOUNDARIES)


def positions(text: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions in order (0 and the end included) with penalties; neighbours are at most reach apart."""
    cost: dict[int, float] = {}
    for pattern, penalty in _COMPILED:
        for m in pattern.finditer(text):
            cost[m.end()] = penalty
    n = len(text)
    cost[0] = cost[n] = 0.0
    at = np.array(sorted(cost))
    gaps = np.flatnonzero(np.diff(at) > reach)
    step = max(1, reach // OFFERED)
    for g in gaps:
        for p in range(int(at[g]) + step, int(at[g + 1]), step):
            split = text[p - 1 : p + 1] == "\r\n" and reach > 2 * step
            cost.setdefault(p - 1 if split else p, INSIDE)
    at = np.array(sorted(cost))
    return at, np.array([cost[p] for p in at.tolist()])


def cuts(text: str, most: int, overlap: int) -> list[int]:
    """Ends of the pieces, the last is the length of the text; one end for a text within the limit.

    most >= 1 and 0 <= overlap < most. Ties go to the later cut.
    """
    n = len(text)
    if n <= most:
        return [n]
    reach = most - overlap
    at, penalty = positions(text, reach)
    even = (n - overlap) / -(-(n - overlap) // reach)
    best = np.full(len(at), np.inf)
    back = np.zeros(len(at), np.int64)
    best[0] = 0.0
    low = 0
    first = int(np.searchsorted(at, max(1, overlap)))
    for j in range(first, len(at)):
        p = at[j]
        while at[low] < p - reach:
            low += 1
        # from the start one piece reaches as far as the limit, and its new part lacks the overlap
        if p <= most:
            best[j], back[j] = penalty[j] + UNEVEN * ((p - overlap) / even - 1) ** 2, 0
        start = max(low, first)
        if start < j:
            sums = best[start:j] + UNEVEN * ((p - at[start:j]) / even - 1) ** 2
            k = len(sums) - 1 - int(np.argmin(sums[::-1]))
            if sums[k] + penalty[j] < best[j]:
                best[j], back[j] = sums[k] + penalty[j], start + k
    out, j = [], len(at) - 1
    while j:
        out.append(int(at[j]))
        j = int(back[j])
    return out[::-1]


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for kind, i, text, most, overlap in zip(rows["item_kind"], rows["item_id"], rows["text"], rows["most"], rows["overlap"]):
            start = 0
            for k, end in enumerate(cuts(text, int(most), int(overlap))):
                out.append((kind, i, k, start, end, text[start:end]))
                start = end - int(overlap)
        yield pd.DataFrame(out, columns=["item_kind", "item_id", "piece_no", "start", "end", "piece"])


_PIECES = "item_kind string, item_id long, piece_no int, start int, end int, piece string"


def oversized_pieces(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the items longer than their kind's limit: item_kind, item_id, piece_no, start, end, piece.

    items has item_kind, item_id and text; limits has one row per item_kind (a
    fixed small table) with max_chars and overlap_chars, in code points. Null and
    empty texts and kinds without a positive limit give no pieces; a null overlap
    is 0 and one that leaves no room is max_chars - 1. Items sent twice give
    their pieces once. Only oversized texts reach Python.
    """
    most = F.col("max_chars")
    valid = limits.where("max_chars >= 1").select(
        F.col("item_kind").alias("_kind"), most.alias("most"), F.least(F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0)), most - 1).alias("overlap")
    )
    long = items.join(small(valid), F.col("item_kind") == F.col("_kind")).where(F.length("text") > F.col("most"))
    once = long.select("item_kind", "item_id", "text", "most", "overlap").dropDuplicates(["item_kind", "item_id"])
    return once.mapInPandas(_cut, _PIECES)


def all_items(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blocks and chunks as items."""
    b = blocks.select(F.lit("content_blocks").alias("item_kind"), F.col("block_id").alias("item_id"), "text")
    return b.unionByName(chunks.select(F.lit("content_chunks").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.col("content").alias("text")))
