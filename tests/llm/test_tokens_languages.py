import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.llm import bpe, language, mixing

FOLDER = bpe.FOLDER
needs = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load(f"{FOLDER}/byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@needs
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_ids_equal_the_public_tokenizer(encoder, public, text):
    assert encoder.encode([text])[0].tolist() == public.encode(text, add_special_tokens=False).ids


@needs
def test_hard_texts(encoder, public):
    texts = ["a" * 1000, " " * 77 + "x", "<|endoftext|>", "it's we'll", "\r\n\n\t", "naïve 漢字 🙂🙂", "x" + "ab" * 500, "0123456789" * 30, "漢字かな交じり文" * 3000, "abracadabra" * 20_000, "é" * 5001]
    assert [x.tolist() for x in encoder.encode(texts)] == [public.encode(t, add_special_tokens=False).ids for t in texts]


@needs
def test_rows_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (1, "hello world")], "doc_id long, text string")
    assert sorted((r.doc_id, list(r.ids)) for r in bpe.token_ids(df, ["doc_id"]).collect()) == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert {(r.doc_id, r.tokens) for r in bpe.token_counts(df, ["doc_id"]).collect()} == {(1, 2), (2, 0), (3, 0)}
    assert bpe.token_ids(df.limit(0), ["doc_id"]).count() == 0


def test_merge_without_table():
    table = (np.arange(256), np.empty(0, np.int64), np.empty(0, np.int64))
    assert [x.tolist() for x in bpe.merge([b"ab", b"c"], table)] == [[97, 98], [99]]


TARGET = "mix_id string, source string, target_weight double, max_repeats int, total_ratio double"


def test_mix_reaches_shares_and_caps(spark):
    docs = [(i, "big pages" if i % 10 else "Big-Pages", 10 + i % 7) for i in range(4000)] + [(10_000 + i, "small", 10) for i in range(100)] + [(20_000, None, 5), (20_001, "untargeted", 500)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("m", "big_pages", 1.0, 1, 0.5), ("m", "small", 1.0, 3, 0.5), ("m", "absent", 2.0, 2, 0.5), ("n", "small", 3.0, None, 0.01), ("z", "small", None, 2, 1.0)], TARGET)
    rows = mixing.mix(df, targets).collect()
    times = {}
    for r in rows:
        times.setdefault((r.mix_id, r.doc_id), []).append(r.copy_no)
    assert all(sorted(v) == list(range(len(v))) for v in times.values())
    assert {len(times[("m", 10_000 + i)]) for i in range(100)} == {3} and not any(k[1] >= 20_000 or k[0] == "z" for k in times)
    got = {(r.mix_id, r.source): r for r in mixing.shares(df, targets).collect()}
    total = sum(t for _, _, t in docs)
    assert abs(got["m", "big_pages"].tokens / (0.5 * 0.25 * total) - 1) < 0.1 and got["m", "absent"].tokens == 0 and got["z", "small"].rate == 0
    assert sum(r.tokens for r in rows if r.mix_id == "m") == got["m", "big_pages"].tokens + got["m", "small"].tokens
    assert abs(sum(r.reached_share for r in got.values() if r.mix_id == "m") - 1) < 1e-9
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


@pytest.mark.parametrize(("label", "code"), [("en_GB", "en"), ("EN", "en"), ("English", "en"), ("eng", "en"), ("pt-BR", "pt"), ("ger", "de"), ("Polish", "pl"), ("und", None), ("xx", None), ("unknown", None), ("", None), (None, None), (" fr ", "fr"), ("sv", "sv")])
def test_labels(spark, label, code):
    assert spark.createDataFrame([(label,)], "l string").select(language.label_code(F.col("l")).alias("c")).first().c == code


TEXTS = {
    "en": "the people of this house walk to the market with their children and buy bread for the week",
    "de": "die leute in diesem haus gehen mit ihren kindern auf den markt und kaufen brot für die woche",
    "fr": "les gens de cette maison vont au marché avec leurs enfants et achètent du pain pour la semaine",
    "pl": "ludzie z tego domu idą z dziećmi na targ i kupują chleb na cały następny tydzień dla rodziny",
}


def test_languages_of_lines_and_documents(spark):
    docs = [(i, TEXTS[c], c) for i, c in enumerate(TEXTS) for _ in range(1)] + [(10, TEXTS["de"] + "\nkurz\n" + TEXTS["fr"].upper(), "de"), (11, TEXTS["en"], "xx"), (12, None, "en"), (13, "", "en"), (14, "one two", "fr"), (15, "1 2 3 4 5 6 7 8", "en")]
    df = spark.createDataFrame(docs + [docs[4]], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.line_no, r.lang) for r in language.mislabelled_lines(df).collect()}
    assert got == {(10, 2, "fr"), (11, 0, "en")}
    assert all(0 <= r.confidence <= 1 for r in language.line_languages(df).collect())
    whole = {r.doc_id: (r.lang, r.languages) for r in language.document_languages(df).collect()}
    assert whole[0] == ("en", "en") and whole[10][1] == "de,fr" and whole[12] == whole[13] == whole[14] == ("und", "")


def test_without_labels_nothing_is_claimed(spark):
    df = spark.createDataFrame([(1, TEXTS["en"], None)], "doc_id long, text string, lang string")
    assert [(r.lang, r.confidence) for r in language.line_languages(df).collect()] == [("und", 0.0)]
    assert language.mislabelled_lines(df).count() == 0 and language.line_languages(df.limit(0)).count() == 0


def test_other_languages_are_unknown(spark):
    folder = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("needs the test tables to fit profiles")
    known = spark.read.parquet(folder).select("doc_id", "text", "lang")
    text = TEXTS["en"] + "\nDen gamla mannen gick långsamt över bron och såg ut över vattnet."
    rows = known.union(spark.createDataFrame([(-1, text, None)], known.schema))
    assert {(r.line_no, r.lang) for r in language.line_languages(rows).where("doc_id = -1").collect()} == {(0, "en"), (1, "und")}


def test_sample_is_of_different_lines(spark, monkeypatch):
    rows = [(i, TEXTS["de"], "de") for i in range(300)] + [(400 + i, t, c) for i, (c, t) in enumerate(TEXTS.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language.profiles_of(df)) == set(TEXTS)
