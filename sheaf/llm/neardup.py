"""Near-duplicate texts: all pairs of sets of word runs with at least a given similarity.

Equal texts form one class with the least id as representative. Texts become
sets of hashed word runs; of different texts with equal sets only one is
joined, the others get its links in the end.

The join is exact. The runs of each set are put in one order for all sets, rare runs
first; two sets that are similar enough share a run among the first of both (prefix
filter), and the first run they share leaves enough of both sets behind it (positional
filter). Each text is placed under its first runs with a bitmap of its whole set, that
is the parity of the runs in each of 256 slots: bits that differ are no more than the
runs that differ, so the bitmaps drop pairs, but no link. What is left is verified on the
whole sets. The order of runs decides the cost only, never the result.

The texts under a run are passed on as a stream. Up to `hot` of them are paired at once;
more come out as they are, and a join by run and size, which AQE splits, pairs them by
the same rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.session import small, stored

#: Runs of several texts that are ordered by their numbers of texts (the most frequent); all others stand before them, ordered by hash.
ORDERED = 2**20


@dataclass(frozen=True)
class Settings:
    """Words of a run, least words of a text, least similarity.

    hot: texts under one run that are paired in one task at most. base and rate are
    SetSketch's b and a.
    """

    run: int = 5
    least_words: int = 5
    similarity: float = 0.8
    base: float = 1.001
    rate: float = 20.0
    hot: int = 200

    def __post_init__(self) -> None:
        if not 0 < self.similarity <= 1:
            raise ValueError("similarity lies above 0, up to 1")

    @property
    def shared(self) -> float:
        """Share of the sum of two sizes that both sets must have in common."""
        return self.similarity / (1 + self.similarity)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point whether it is a letter or digit, and a random number; made once per worker."""
    import sys

    codes = range(sys.maxunicode + 1)
    return np.fromiter((chr(c).isalnum() for c in codes), bool, len(codes)), _mixed(np.arange(len(codes), dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))


#: Odd factor of the word hash and its inverse modulo 2**64.
_FACTOR = 0x5851F42D4C957F2D
_INVERSE = pow(_FACTOR, -1, 2**64)


def _powers(factor: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, n - 1), factor, np.uint64))])[:n]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits) of texts in one row, and the text each belongs to.

    A word's hash is a polynomial over its letters, read off the running sums of the whole row.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_word, number = _letters()
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = is_word[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(number[codes] * _powers(_FACTOR, len(codes)), out=sums[1:])
    h = _mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(codes) + 1)[starts])
    lengths = np.fromiter(map(len, low), np.int64, len(low)) + 1
    return h, np.searchsorted(np.cumsum(lengths), starts, side="right")


#: Bits of a run's hash that are kept, and characters of texts taken together.
KEPT_BITS = 44
TOGETHER = 4_000_000


def sets_of(texts: list[str | None], s: Settings) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of the texts that take part: their places, their sets one after the other (each sorted), and where each starts.

    starts has one more entry than there are texts, the end of the last.
    """
    some = [i for i, t in enumerate(texts) if t]
    if not some:
        return [], np.empty(0, np.uint64), np.zeros(1, np.int64)
    w, owner = words_of([texts[i] for i in some])
    counts = np.bincount(owner, minlength=len(some))
    part = counts >= max(s.least_words, s.run)
    w, owner = w[part[owner]], (np.cumsum(part) - 1)[owner[part[owner]]]
    which = [i for i, p in zip(some, part.tolist()) if p]
    if not which:
        return [], np.empty(0, np.uint64), np.zeros(1, np.int64)
    n = len(w) - s.run + 1
    x = w[:n]
    for i in range(1, s.run):
        x = _mixed(x + np.uint64(0x9E3779B97F4A7C15)) ^ w[i : i + n]
    inside = owner[:n] == owner[s.run - 1 :]
    # one sort puts the texts one after the other, each with sorted runs
    x = (owner[:n][inside].astype(np.uint64) << np.uint64(KEPT_BITS)) | (_mixed(x[inside]) >> np.uint64(64 - KEPT_BITS))
    x.sort()
    x = x[np.concatenate([[True], x[1:] != x[:-1]])]
    starts = np.searchsorted(x, np.arange(len(which) + 1, dtype=np.uint64) << np.uint64(KEPT_BITS))
    return which, x & np.uint64(2**KEPT_BITS - 1), starts


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut where their texts get longer than TOGETHER (one text at least, fewer than a set's owner bits allow)."""
    for batch in batches:
        if len(batch):
            part = batch["text"].str.len().cumsum() // TOGETHER + np.arange(len(batch)) // 2**19
            for _, rows in batch.groupby(part.to_numpy(), sort=False):
                yield rows


_TEXTS = "id long, k1 long, k2 long, t1 long, t2 long"


def _survey(s: Settings):
    """Keys of each text's set (k1, k2: sums of two hashes of its runs) beside those of the text itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _parts(batches):
            which, x, starts = sets_of(rows["text"].tolist(), s)
            if which:
                keys = {k: np.add.reduceat(_mixed(x ^ np.uint64(salt)), starts[:-1]).view(np.int64) for k, salt in (("k1", 0x51ED270B1), ("k2", 0xA3C59AC2F1))}
                own = rows.iloc[which]
                yield pd.DataFrame({"id": own["id"].to_numpy(), **keys, "t1": own["t1"].to_numpy(), "t2": own["t2"].to_numpy()})

    return run


#: Elements hashed at once, so that they stay in the processor's cache, and registers of a sketch.
BLOCK = 32_768
REGISTERS = 472


def registers(flat: np.ndarray, starts: np.ndarray, s: Settings, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (uint16) of non-empty sets that lie one after the other, one row each. They merge by maximum; the join of near-duplicates doesn't use them."""
    n = len(starts)
    factors = np.random.default_rng([1, 20240501]).integers(0, 2**31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    x = (flat >> np.uint64(KEPT_BITS - 32)).astype(np.uint32)
    ends = np.append(starts, len(x))
    low = np.empty((m, n), np.uint32)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, side="right")) - 1)
        own, at = x[ends[i] : ends[j]], ends[i:j] - ends[i]
        hashed = np.empty_like(own)
        for k in range(m):
            np.multiply(own, factors[k], out=hashed)
            np.minimum.reduceat(hashed, at, out=low[k, i:j])
        i = j
    value = -np.log1p(-(low.T.astype(np.float64) + 0.5) / 2.0**32) / s.rate
    return np.clip(np.floor(1 - np.log(value) / np.log(s.base)), 0, 2**16 - 1).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float) -> np.ndarray:
    """Maximum likelihood similarity of pairs from registers (rows) and exact set sizes, on a grid of 1/100."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (base - 1) / base) / np.log(base)
    best, out = np.full(len(u), -np.inf), np.zeros(len(u))
    for j in np.arange(0, 101) / 100:
        up, down = np.clip(p(u - v * j), 1e-9, 1), np.clip(p(v - u * j), 1e-9, 1)
        value = more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-9, 1))
        value = np.where(j <= np.minimum(na, nb) / np.maximum(na, nb) + 0.005, value, -np.inf)
        out, best = np.where(value > best, j, out), np.maximum(value, best)
    return out


def _sets(s: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _parts(batches):
            which, x, starts = sets_of(rows["text"].tolist(), s)
            if which:
                yield pd.DataFrame({"id": rows["id"].to_numpy()[which], "runs": [x[p:q].tobytes() for p, q in zip(starts.tolist(), starts[1:].tolist())]})

    return run


def _verify(s: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for a, b, x, y in zip(p["a"], p["b"], p["xa"], p["xb"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                if both >= s.similarity * union - 1e-9:
                    out.append((a, b, both / union))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    return run


def _counted(s: Settings):
    """Runs and their numbers of texts, added up within parts of batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _parts(batches):
            x, n = np.unique(sets_of(rows["text"].tolist(), s)[1], return_counts=True)
            yield pd.DataFrame({"run": x.view(np.int64), "n": n})

    return run


def order_of(texts: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray, bool]:
    """The ORDERED most frequent runs, sorted, the place of each (from 1), and whether no other run has several texts."""
    counts = stored(texts.mapInPandas(_counted(s), "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).where("n > 1"), "runs")
    total, least = 0, None
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("of")).orderBy(F.desc("n")).collect()
    for size in sizes:
        total += size["of"]
        if total > ORDERED:
            break
        least = size["n"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64), not sizes
    rows = counts.where(F.col("n") >= least).toArrow()
    run, n = rows.column("run").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    place = np.empty(len(run), np.int64)
    place[np.lexsort((run, n))] = np.arange(1, len(run) + 1)
    o = np.argsort(run)
    return run[o], place[o], total <= ORDERED


#: Columns of a bitmap of 256 bits.
BITS = ["b0", "b1", "b2", "b3"]


def bitmaps(x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Bitmaps of non-empty sets that lie one after the other: a bit is the parity of the set's runs in its slot."""
    slot = _mixed(x ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(56)
    bit = np.uint64(1) << (slot & np.uint64(63))
    return {c: np.bitwise_xor.reduceat(np.where(slot >> np.uint64(6) == i, bit, np.uint64(0)), starts).view(np.int64) for i, c in enumerate(BITS)}


#: Slack of sums of floats; it lets through more, never less.
SLACK = 1e-6

_PLACED = "run long, id long, n long, most long, " + ", ".join(f"{c} long" for c in BITS)


def _placed(s: Settings, order: Broadcast):
    """Texts under their first runs: size, the largest size of a partner whose first shared run this may be, and bitmap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ordered, places, whole = order.value
        for rows in _parts(batches):
            which, x, starts = sets_of(rows["text"].tolist(), s)
            if not which:
                continue
            own = {"id": rows["id"].to_numpy()[which], "n": np.diff(starts), **bitmaps(x, starts[:-1])}
            owner = np.repeat(np.arange(len(which)), own["n"])
            place = np.zeros(len(x), np.int64)
            if len(ordered):
                at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
                place = np.where(ordered[at] == x, places[at], 0)
            o = np.argsort((owner << 21) | place, kind="stable")
            n = own["n"][owner]
            left = n - (np.arange(len(x)) - starts[owner])
            most = np.floor(left / s.shared + SLACK).astype(np.int64) - n
            first = most >= np.ceil(s.similarity * n - SLACK)
            if whole:  # a run of one text only pairs nothing
                first &= place[o] > 0
            owner = owner[first]
            yield pd.DataFrame({"run": x[o][first].view(np.int64), "most": most[first], **{c: v[owner] for c, v in own.items()}})

    return run


def _pairs(s: Settings):
    """Pairs of texts under one run from rows sorted by run, size and id; more than s.hot texts of a run come out as they are (a the id, b the run)."""
    names = ["run", "id", "n", "most", *BITS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] | None = None  # the rows so far of the last run, while it isn't hot
        hot = None
        for batch in chain(batches, [None]):
            if batch is not None and not len(batch):
                continue
            x = held
            if batch is not None:
                new = {c: batch[c].to_numpy() for c in names}
                x = {c: np.concatenate([held[c], new[c]]) for c in names} if held else new
            if x is None:
                continue
            again = np.zeros(len(x["run"]), bool)  # rows sent twice
            again[1:] = (x["run"][1:] == x["run"][:-1]) & (x["id"][1:] == x["id"][:-1])
            if again.any():
                x = {c: v[~again] for c, v in x.items()}
            runs = x["run"]
            starts = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
            ends = np.append(starts[1:], len(runs))
            many = ends - starts > s.hot
            many[0] |= hot is not None and runs[0] == hot
            hot, held = (runs[-1] if many[-1] else None), None
            if batch is not None and not many[-1]:
                held = {c: v[starts[-1] :] for c, v in x.items()}
                starts, ends, many = starts[:-1], ends[:-1], many[:-1]
            end, whole = np.repeat(ends, ends - starts), np.repeat(~many, ends - starts)
            n, most = x["n"], x["most"]
            i, d, a, b = np.flatnonzero(whole), 1, [], []
            while len(i := i[i + d < end[i]]) and len(i := i[n[i + d] <= most[i]]):  # sizes ascend, so what is too large stays so
                j = i + d
                met = n[i] <= most[j]
                p, q = i[met], j[met]
                apart = sum(np.bitwise_count((x[c][p] ^ x[c][q]).view(np.uint64)).astype(np.int64) for c in BITS)
                near = apart <= n[p] + n[q] - 2 * np.ceil((n[p] + n[q]) * s.shared - SLACK)
                a.append(x["id"][p[near]])
                b.append(x["id"][q[near]])
                d += 1
            a, b = (np.concatenate([np.empty(0, np.int64), *v]) for v in (a, b))
            yield pd.DataFrame({"hot": False, "a": np.minimum(a, b), "b": np.maximum(a, b), **{c: 0 for c in names[2:]}})
            k = np.flatnonzero(~whole)
            if len(k):
                yield pd.DataFrame({"hot": True, "a": x["id"][k], "b": runs[k], **{c: x[c][k] for c in names[2:]}})

    return run


def _step(size: str) -> Column:
    """Sizes in steps of a tenth, so that a join by run looks only where partners can be."""
    return F.floor(F.log(F.col(size).cast("double")) / math.log(1.1))


def candidates(texts: DataFrame, s: Settings) -> DataFrame:
    """Distinct pairs a < b that hold every pair of sets with at least s.similarity."""
    order = texts.sparkSession.sparkContext.broadcast(order_of(texts, s))
    placed = texts.mapInPandas(_placed(s, order), _PLACED)
    kinds = "hot boolean, a long, b long, n long, most long, " + ", ".join(f"{c} long" for c in BITS)
    raw = stored(placed.repartition("run").sortWithinPartitions("run", "n", "id").mapInPandas(_pairs(s), kinds), "placed")
    dense = raw.where("hot").selectExpr("b AS run", "a AS id", "n", "most", *BITS)
    x = dense.where("most >= n").withColumn("step", F.explode(F.sequence(_step("n"), _step("most")))).alias("x")
    y = dense.withColumn("step", _step("n")).alias("y")
    within = "(x.n < y.n OR x.n = y.n AND x.id < y.id) AND x.id <> y.id AND y.n <= x.most AND x.n <= y.most"
    apart = " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in BITS)
    near = f"{apart} <= x.n + y.n - 2 * ceil((x.n + y.n) * {s.shared!r}D - {SLACK!r}D)"
    joined = x.join(y, F.expr(f"x.run = y.run AND x.step = y.step AND {within} AND {near}")).select(F.expr("least(x.id, y.id) AS a"), F.expr("greatest(x.id, y.id) AS b"))
    return raw.where("NOT hot").select("a", "b").unionByName(joined).distinct()


def spread(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links between sets (a, b, similarity) as links between the different texts that have them.

    members (member, s) holds the texts of sets that several texts have, s itself
    included. Texts with one set are linked with each other, too.
    """
    m = small(members)
    left, right = m.selectExpr("s AS a", "member AS _a"), m.selectExpr("s AS b", "member AS _b")
    wide = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "similarity")
    wide = wide.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    same = members.selectExpr("s", "member AS a").join(members.selectExpr("s", "member AS b"), "s").where("a < b")
    return wide.unionByName(same.select("a", "b", F.lit(1.0).alias("similarity")))


def near_sets(texts: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between sets (a, b, similarity), texts of one set (member, s), and classes (id, representative).

    a, b and s are the least ids of the texts with that set; members has the sets
    of several texts only, one row per different text, s itself included.
    """
    texts = texts.select("id", "text").where(F.length("text") >= 2 * max(s.least_words, s.run) - 1)
    keyed = texts.select("id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    rows = stored(keyed.mapInPandas(_survey(s), _TEXTS), "texts")
    keys = ["k1", "k2", "t1", "t2"]
    first = stored(rows.groupBy(*keys).agg(F.min("id").alias("representative")), "first")
    classes = stored(rows.distinct().join(first, keys).select("id", "representative"), "classes")
    sets = first.groupBy("k1", "k2").agg(F.min("representative").alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(first.join(sets, ["k1", "k2"]).select(F.col("representative").alias("member"), "s"), "members")
    others = stored(classes.where("id <> representative").select("id").union(members.where("member <> s").select("member")), "others")

    chosen = texts.join(small(others), "id", "left_anti")
    likely = stored(candidates(chosen, s), "pairs")

    ids = stored(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    whole = chosen.join(small(ids), "id", "left_semi").mapInPandas(_sets(s), "id long, runs binary").dropDuplicates(["id"])
    found = likely.join(whole.selectExpr("id AS a", "runs AS xa"), "a").join(whole.selectExpr("id AS b", "runs AS xb"), "b")
    return found.mapInPandas(_verify(s), "a long, b long, similarity double"), members, classes


def near_duplicates(texts: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Links and classes of texts (id long, text): (a, b, similarity) with a < b, and (id, representative).

    A class holds the copies of one text; every text that takes part is in one,
    a text alone in its own. Links run between representatives, so between
    different texts, and none is left out. Texts that are null, empty or
    shorter than least_words take no part. Rows sent twice count once.
    """
    links, members, classes = near_sets(texts, s)
    return spread(links, members), classes


def link_counts(texts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per text that takes part: id, representative of its class and the class's number of links, which are not expanded."""
    links, members, classes = near_sets(texts, s)
    links = stored(links.select("a", "b"), "links")
    sizes = members.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    ends = links.selectExpr("a AS s", "b AS o").unionByName(links.selectExpr("b AS s", "a AS o"))
    away = ends.join(sizes.withColumnRenamed("s", "o"), "o", "left").groupBy("s").agg(F.sum(F.coalesce("n", F.lit(1))).alias("away"))
    sets = classes.join(members.select(F.col("member").alias("representative"), "s"), "representative", "left").withColumn("s", F.coalesce("s", "representative"))
    counted = sets.join(sizes, "s", "left").join(away, "s", "left")
    return counted.select("id", "representative", (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("away", F.lit(0))).alias("links"))
