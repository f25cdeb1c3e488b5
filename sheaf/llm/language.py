"""Languages of documents and of their lines by rank-order n-gram profiles.

A language's profile is the ranked list of its most frequent character n-grams.
A line's n-grams are ranked by frequency too, and its distance to a language is
the sum of the differences of the ranks (out of place), the profile's length for
n-grams that are not in it. The nearest language wins; confidence tells how much
nearer it is than the second.

Profiles are fitted here on a bounded sample of labelled lines. A second fit
leaves out sample lines that the first gives another language, so wrong labels
and mixed documents in the sample do no harm.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the sample: lines per language, and characters of a line that is sampled.
SAMPLE_LINES, SAMPLE_CHARS = 2500, 2000
#: Length of a profile, and n of its n-grams.
PROFILE, GRAMS = 3000, (1, 2, 3)
#: Words a line needs to be judged.
LEAST_WORDS = 7
#: Lines in none of the languages get this one: those less sure than LEAST_CONFIDENCE (lines of the eight languages have 0.22 and
#: more on sf0.1, sentences of six others at most 0.13) or without a single n-gram of any profile.
UNKNOWN, LEAST_CONFIDENCE = "und", 0.16
#: Words kept per task.
KEPT = 300_000
_MOST = (1 << 22) - 1

# Names of languages in labels (lower case): code, three-letter codes, English and own names.
NAMES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues", "nl": "nl nld dut dutch nederlands", "it": "it ita italian italiano", "pl": "pl pol polish polski",
}
# Labels that name no language.
NAMELESS = "und xx unknown none null n/a na mul mis zxx qaa".split()


def label_code(label: Column) -> Column:
    """The language a label names: a two-letter code, or null for missing and unknown labels.

    Codes with a region or script ("en_GB", "pt-BR") and names count in any letter
    case. A label of two or three letters that is no code of NAMES names a foreign
    language and stays as it is.
    """
    bare = F.regexp_replace(F.lower(F.trim(label)), r"\s*[(].*$", "")
    head = F.regexp_extract(bare, r"^([^_\-\s@.]+)", 1)
    names = {n: code for code, all_names in NAMES.items() for n in all_names.split()}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    other = F.when(head.rlike("^[a-z]{2,3}$") & ~head.isin(NAMELESS), head)
    return F.coalesce(F.element_at(known, head), other)


_WORD = re.compile(r"[^\W\d_]+")


def grams(word: str) -> list[str]:
    """n-grams of a lower-case word with a blank on either side."""
    w = f" {word} "
    return [w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1) if n > 1 or w[i] != " "]


def plain(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).replace("ł", "l").replace("ß", "ss").replace("ø", "o").replace("æ", "ae")


def fit(lines: dict[str, list[str]]) -> dict[str, list[str]]:
    """Profiles of languages: n-grams by falling frequency over the lines as written and without accents, ties by the n-gram."""
    profiles = {}
    for code, texts in lines.items():
        words: Counter = Counter()
        for t in texts:
            low = t.lower()
            words.update(_WORD.findall(low))
            words.update(_WORD.findall(plain(low)))
        found: Counter = Counter()
        for w, n in words.items():
            for g in grams(w):
                found[g] += n
        profiles[code] = [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]]
    return {c: p for c, p in profiles.items() if p}


class Ranker:
    """Distances of lines to profiles."""

    def __init__(self, profiles: dict[str, list[str]]) -> None:
        self.codes = sorted(profiles)
        self.number: dict[str, int] = {}
        for code in self.codes:
            for g in profiles[code]:
                self.number.setdefault(g, len(self.number))
        self.ranks = np.full((len(self.number), len(self.codes)), 3 * PROFILE, np.int32)  # absent: out of any reach
        for k, code in enumerate(self.codes):
            for r, g in enumerate(profiles[code]):
                self.ranks[self.number[g], k] = r
        self.words: dict[str, np.ndarray] = {}

    def _word(self, w: str) -> np.ndarray:
        got = self.words.get(w)
        if got is None:
            number = self.number
            got = self.words[w] = np.array([n for g in grams(w) if (n := number.get(g)) is not None], np.int64)
        return got

    def judge(self, lines: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and confidence (0 to 1) of each line; UNKNOWN and 0 for lines without letters known to a profile."""
        if not self.codes or not lines:
            return [UNKNOWN] * len(lines), np.zeros(len(lines))
        if len(self.words) > KEPT:
            self.words.clear()
        parts = [[self._word(w) for w in _WORD.findall(t.lower())] for t in lines]
        sizes = np.array([sum(map(len, p)) for p in parts])
        flat = np.concatenate([x for p in parts for x in p] or [np.empty(0, np.int64)])
        size = np.int64(len(self.number) + 1)
        pairs, times = np.unique(np.repeat(np.arange(len(lines)), sizes) * size + flat, return_counts=True)
        line, gram = pairs // size, pairs % size
        # one sort puts each line's n-grams by falling frequency, ties by number
        order = np.sort((line << 42 | (_MOST - np.minimum(times, _MOST)) << 20) | gram)
        line, gram = order >> 42, order & ((1 << 20) - 1)
        first = np.searchsorted(line, np.arange(len(lines)))
        rank = np.minimum(np.arange(len(line)) - first[line], PROFILE).astype(np.int32)
        apart = self.ranks[gram]
        apart -= rank[:, None]
        np.abs(apart, out=apart)
        np.minimum(apart, PROFILE, out=apart)
        found = np.zeros((len(lines), len(self.codes)), np.int64)
        some = np.flatnonzero(sizes)
        if len(some):
            found[some] = np.add.reduceat(apart, first[some], dtype=np.int64)
        best = found.argmin(1)
        ordered = np.sort(found, 1)
        second = ordered[:, 1] if len(self.codes) > 1 else PROFILE * np.maximum(1, np.bincount(line, minlength=len(lines)))
        trust = np.where(sizes > 0, 1 - ordered[:, 0] / np.maximum(second, 1), 0.0)
        return [self.codes[k] if n else UNKNOWN for k, n in zip(best.tolist(), sizes.tolist())], np.clip(trust, 0, 1)


def _long_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = [(c, x) for c, t in zip(rows["code"], rows["text"]) for x in t.split("\n") if len(x) <= SAMPLE_CHARS and len(x.split()) >= LEAST_WORDS]
        yield pd.DataFrame(out, columns=["code", "line"])


def profiles_of(docs: DataFrame) -> dict[str, list[str]]:
    """Profiles fitted on the labelled lines of docs (lang, text): at most SAMPLE_LINES different lines a language, chosen by hash."""
    code = label_code(F.col("lang"))
    labelled = docs.select(code.alias("code"), "text").where(F.col("code").isin(list(NAMES)) & F.col("text").isNotNull())
    weights = {r.code: r.n for r in labelled.groupBy("code").agg(F.sum(F.greatest(F.lit(1), F.length("text") / 100)).alias("n")).collect()}
    if not weights:
        return {}
    rate = F.create_map(*[F.lit(x) for c, n in weights.items() for x in (c, float(min(1.0, 3 * SAMPLE_LINES / n)))])
    chance = F.shiftrightunsigned(F.xxhash64("text"), 11).cast("double") / float(2**53)
    some = labelled.where(chance < F.element_at(rate, F.col("code"))).mapInPandas(_long_lines, "code string, line string")
    # the lines of the least hashes of each language, each line once; ranked in salted parts first, so no language is one task's
    lines: dict[str, list[str]] = {}
    rows = some.distinct().select("code", "line", F.xxhash64("line").alias("h"))
    for parts in (["code", F.pmod("h", F.lit(64))], ["code"]):
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*parts).orderBy("h", "line"))).where(F.col("n") <= SAMPLE_LINES)
    for r in rows.orderBy("code", "n").collect():
        lines.setdefault(r.code, []).append(r.line)
    for _ in range(2):
        ranker = Ranker(fit(lines))
        lines = {c: [x for x, found in zip(own, ranker.judge(own)[0]) if found == c] for c, own in lines.items()}
    return fit(lines)


_LINES = "doc_id long, line_no long, chars int, label string, lang string, confidence double"
#: Lines that are judged together.
TOGETHER = 2000


def _judged(ranker):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Ranker(ranker.value)
        for rows in batches:
            own = [(i, k, len(x), label, x) for i, label, t in zip(rows["doc_id"], rows["label"], rows["text"]) for k, x in enumerate(t.split("\n")) if len(x.split()) >= LEAST_WORDS]
            for start in range(0, len(own), TOGETHER):
                part = own[start : start + TOGETHER]
                codes, trust = judge.judge([p[4] for p in part])
                codes = np.where(trust < LEAST_CONFIDENCE, UNKNOWN, codes)
                out = pd.DataFrame([p[:4] for p in part], columns=["doc_id", "line_no", "chars", "label"])
                yield out.assign(lang=codes, confidence=np.round(trust, 4))

    return run


def line_languages(docs: DataFrame) -> DataFrame:
    """Language of each line of at least LEAST_WORDS words: doc_id, line_no (from 0), chars, label, lang, confidence.

    label is the language named by documents.lang, null if it names none. Null and
    empty texts have no lines. Without any labelled text nothing can be fitted and
    every line has the language UNKNOWN with confidence 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles_of(docs))
    rows = docs.select("doc_id", label_code(F.col("lang")).alias("label"), "text").where("text IS NOT NULL AND text <> ''")
    return rows.mapInPandas(_judged(shared), _LINES)


def mislabelled_lines(docs: DataFrame) -> DataFrame:
    """Lines in another language than the label names, all lines where it names none: doc_id, line_no, lang, confidence."""
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return line_languages(docs).where(wrong & (F.col("lang") != UNKNOWN)).select("doc_id", "line_no", "lang", "confidence").distinct()


def document_languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, label, lang, share, confidence, languages.

    lang has the most characters of judged lines (ties: the first code), share is
    its share of them, confidence the mean of its lines by characters, languages
    the sorted codes met. A document without a judged line (null, empty, short lines only) is
    UNKNOWN with share and confidence 0 and no languages.
    """
    by = line_languages(docs).groupBy("doc_id", "lang").agg(F.sum("chars").alias("n"), F.sum(F.col("chars") * F.col("confidence")).alias("t"))
    top = F.max(F.struct(F.col("n"), (-F.ascii("lang") * 256 - F.ascii(F.substring("lang", 2, 1))).alias("_o"), "lang", "t"))
    rows = by.groupBy("doc_id").agg(top.alias("x"), F.sum("n").alias("all"), F.array_sort(F.collect_set("lang")).alias("languages"))
    found = rows.select("doc_id", "x.lang", F.round(F.col("x.n") / F.col("all"), 4).alias("share"), F.round(F.col("x.t") / F.col("x.n"), 4).alias("confidence"), F.array_join("languages", ",").alias("languages"))
    every = docs.groupBy("doc_id").agg(F.min(label_code(F.col("lang"))).alias("label"))
    none = F.lit(0.0)
    return every.join(found, "doc_id", "left").select(
        "doc_id", "label", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("share", none).alias("share"), F.coalesce("confidence", none).alias("confidence"), F.coalesce("languages", F.lit("")).alias("languages")
    )
