"""Token ids of whole corpora by a public byte-level BPE vocabulary.

Merging runs in numpy rounds over the distinct words of a batch: the symbols of
all words lie in one flat array, the rank of each neighbouring pair is found by
binary search in the sorted pair keys, and each round merges the lowest-ranked
pair of every word at once. Words already met are kept per task.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Where the vocabulary files are; the setting sheaf.tokenizers of the session overrides it.
FOLDER = "/opt/tokenizers"
# Fixed value: the public pattern that parts a text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words kept per task.
KEPT = 300_000
NONE = np.int64(2**40)


def load(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From a rank file: ids of the 256 bytes, sorted pair keys (left << 20 | right), ids of the merged pairs.

    A pair merges if its bytes together are a token; the id is its rank. The
    arrays hold a few entries per token, so they are small enough to broadcast.
    """
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 20 | right] = rank
    keys = np.array(sorted(pairs), dtype=np.int64)
    return np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64), keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.int64)


def merge(words: list[bytes], table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Ids of each non-empty word."""
    single, keys, merged = table
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbols = single[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    done: list[np.ndarray | None] = [None] * len(words)
    while len(symbols):
        rank = np.full(len(symbols), NONE)
        pair = symbols[:-1] << 20 | symbols[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1) if len(keys) else np.zeros(len(pair), np.int64)
        hit = (keys[at] == pair) & (word[:-1] == word[1:]) if len(keys) else np.zeros(len(pair), bool)
        rank[:-1][hit] = merged[at[hit]]
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        counts = np.diff(np.r_[starts, len(symbols)])
        over = lowest == NONE
        if over.any():
            for k in np.flatnonzero(over).tolist():
                done[word[starts[k]]] = symbols[starts[k] : starts[k] + counts[k]].astype(np.int32)
        here = (rank == np.repeat(lowest, counts)) & (rank < NONE)
        spots = np.flatnonzero(here)
        if len(spots):  # of overlapping equal pairs every second merges, from the left
            fresh = np.r_[True, (np.diff(spots) > 1) | (word[spots[1:]] != word[spots[:-1]])]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(spots)), 0))
            spots = spots[(np.arange(len(spots)) - run) % 2 == 0]
            symbols[spots] = rank[spots]
        keep = np.ones(len(symbols), bool)
        keep[spots + 1] = False
        keep &= ~np.repeat(over, counts)
        symbols, word = symbols[keep], word[keep]
    return done


#: Bytes of a word from which it is merged on its own, by a queue instead of whole rounds.
LONG = 2000


def merge_long(word: bytes, single: np.ndarray, pairs: dict[int, int]) -> np.ndarray:
    """Ids of one very long word: the lowest-ranked pair, the leftmost first, from a queue, so the time is n log n."""
    ids = single[np.frombuffer(word, np.uint8)].tolist()
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    queue = [(r, i) for i in range(len(ids) - 1) if (r := pairs.get(ids[i] << 20 | ids[i + 1])) is not None]
    heapq.heapify(queue)
    gone = -1
    while queue:
        rank, i = heapq.heappop(queue)
        if ids[i] == gone or (j := after[i]) >= len(ids) or pairs.get(ids[i] << 20 | ids[j]) != rank:
            continue
        ids[i], after[i], ids[j] = rank, after[j], gone
        if after[i] < len(ids):
            before[after[i]] = i
            if (r := pairs.get(rank << 20 | ids[after[i]])) is not None:
                heapq.heappush(queue, (r, i))
        if before[i] >= 0 and (r := pairs.get(ids[before[i]] << 20 | rank)) is not None:
            heapq.heappush(queue, (r, before[i]))
    return np.array([x for x in ids if x != gone], dtype=np.int32)


class Encoder:
    """Ids of texts, with the words already met."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        import regex

        self.split, self.table, self.known, self.pairs = regex.compile(PATTERN).findall, table, {}, {}

    def _long(self, word: bytes) -> np.ndarray:
        if not self.pairs:
            self.pairs = dict(zip(self.table[1].tolist(), self.table[2].tolist()))
        return merge_long(word, self.table[0], self.pairs)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for null and empty texts. Lone surrogates count as the replacement character."""
        parted = [self.split(t) if t else [] for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        new = [w for w in dict.fromkeys(chain.from_iterable(parted)) if w not in self.known]
        if new:
            coded = [w.encode("utf-8", "replace") for w in new]
            self.known.update((w, self._long(c)) for w, c in zip(new, coded) if len(c) >= LONG)
            short = [(w, c) for w, c in zip(new, coded) if len(c) < LONG]
            if short:
                self.known.update(zip((w for w, _ in short), merge([c for _, c in short], self.table)))
        known = self.known
        return [np.concatenate([known[w] for w in p]) if p else np.empty(0, np.int32) for p in parted]


def table_of(spark: SparkSession, name: str):
    """The broadcast merge table of a vocabulary."""
    folder = spark.conf.get("sheaf.tokenizers", FOLDER)
    return spark.sparkContext.broadcast(load(os.path.join(folder, f"{name}.tiktoken")))


#: Texts that are encoded together.
TOGETHER = 500


def _encoded(batches: Iterator[pd.DataFrame], table, count: bool, column: str) -> Iterator[pd.DataFrame]:
    encoder = Encoder(table.value)
    for rows in batches:
        for i in range(0, len(rows), TOGETHER):
            part = rows.iloc[i : i + TOGETHER]
            ids = encoder.encode(part["_text"].tolist())
            yield part.drop(columns="_text").assign(**{column: [len(x) for x in ids] if count else ids})


def _with(docs: DataFrame, text: str, column: str, name: str, count: bool, keep: list[str]) -> DataFrame:
    table = table_of(docs.sparkSession, name)
    rows = docs.select(*keep, docs[text].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInPandas(lambda b: _encoded(b, table, count, column), f"{schema}, {column} {'int' if count else 'array<int>'}")


def token_ids(docs: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k") -> DataFrame:
    """The kept columns and ids (array<int>) of each row's text, without special tokens.

    Null and empty texts have the empty list. Strings of special tokens are
    ordinary text. Rows stay as they are, repeated ones too.
    """
    return _with(docs, text, "ids", name, False, keep)


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k") -> DataFrame:
    """The kept columns and tokens (int) of each row's text; 0 for null and empty texts."""
    return _with(docs, text, "tokens", name, True, keep)
