"""Queries of the operators for training data and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheaf.llm import boilerplate, bpe, language, lines, mixing, neardup, pieces, residue
from sheaf.session import small, stored
from sheaf.sources.tables import table


def p1_found(spark, d):
    return _residue(spark, d).select("item_kind", "item_id")


def p1_kinds(spark, d):
    return _residue(spark, d).selectExpr("item_kind", "item_id", "array_join(kinds, ',') AS kinds")


def _residue(spark, d):
    return residue.residue_records(residue.all_records(table(spark, d, "content_blocks"), table(spark, d, "pitch_sections")))


def _pieces(spark, d):
    items = pieces.all_items(table(spark, d, "content_blocks"), table(spark, d, "content_chunks"))
    return pieces.oversized_pieces(items, table(spark, d, "size_limits"))


def p2_found(spark, d):
    return _pieces(spark, d).where("piece_no > 0").select("item_kind", "item_id").distinct()


def p2_pieces(spark, d):
    return _pieces(spark, d)


def p2_rejoined(spark, d):
    """Each oversized item put together again from its pieces, whether all are within the limit, and whether each shares the overlap with the one before."""
    limits = small(table(spark, d, "size_limits").select("item_kind", F.col("max_chars").alias("most"), F.col("overlap_chars").alias("shared")))
    w = Window.partitionBy("item_kind", "item_id").orderBy("piece_no")
    rows = _pieces(spark, d).join(limits, "item_kind").withColumn("before", F.lag("piece").over(w))
    rest = F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.expr("substring(piece, shared + 1)"))
    shares = F.coalesce(F.expr("right(before, shared) = left(piece, shared)"), F.lit(True))
    made = rows.groupBy("item_kind", "item_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", rest.alias("t")))).alias("x"), F.bool_and(F.length("piece") <= F.col("most")).alias("within"), F.bool_and(shares).alias("shares")
    )
    return made.select("item_kind", "item_id", F.array_join(F.transform("x", lambda x: x["t"]), "").alias("text"), "within", "shares")


def p3_found(spark, d):
    bodies = boilerplate.judged_blocks(table(spark, d, "content_blocks"))
    cases = residue.residue_records(residue.block_records(table(spark, d, "content_blocks")))
    return bodies.where("furniture").select("block_id").join(cases.selectExpr("item_id AS block_id"), "block_id", "left_anti")


def p3_bodies(spark, d):
    return boilerplate.page_bodies(table(spark, d, "content_blocks")).where("NOT furniture").select("block_id", "page_id", "body")


def p6_found(spark, d):
    return lines.repeated_block_lines(table(spark, d, "content_blocks"))


def p6_cleaned(spark, d):
    return lines.without_repeated_lines(table(spark, d, "content_blocks"))


#: The near-duplicates of TESTDATA.md: three-word runs, texts of 40 words, half of the union in common.
NEAR = neardup.Settings(run=3, least_words=40, similarity=0.5)


def _texts(blocks):
    return blocks.select(F.col("block_id").alias("id"), "text")


def p7_found(spark, d):
    """Links between different texts, and each further copy of a text with its representative."""
    links, classes = neardup.near_duplicates(_texts(table(spark, d, "content_blocks")), NEAR)
    members = classes.where("id <> representative").selectExpr("representative AS block_a", "id AS block_b")
    return links.selectExpr("a AS block_a", "b AS block_b").unionByName(members)


def p7_classes(spark, d):
    """One row per text: its class and the number of links of the class."""
    rows = neardup.link_counts(_texts(table(spark, d, "content_blocks")), NEAR)
    return rows.selectExpr("id AS block_id", "representative AS class_id", "links")


def p8_ids(spark, d):
    return bpe.token_ids(table(spark, d, "documents"), ["doc_id"])


def p8_counts(spark, d):
    return bpe.token_counts(table(spark, d, "documents"), ["doc_id", "source"])


def _counted(spark, d):
    return stored(bpe.token_counts(table(spark, d, "documents"), ["doc_id", "source"]), "counted")


def p9_mix(spark, d):
    return mixing.mix(_counted(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    return mixing.shares(_counted(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark, d):
    return language.mislabelled_lines(table(spark, d, "documents")).select("doc_id", "line_no", "lang")


def p10_lines(spark, d):
    return language.line_languages(table(spark, d, "documents")).select("doc_id", "line_no", "label", "lang", "confidence")


def p10_documents(spark, d):
    return language.document_languages(table(spark, d, "documents"))


_P6 = r"""
WITH l AS (
  SELECT block_id, page_id, lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS site,
    unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM content_blocks WHERE url IS NOT NULL AND text IS NOT NULL
), k AS (SELECT *, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS key FROM l),
c AS (SELECT * FROM k WHERE length(key) >= 3 AND site <> ''),
n AS (SELECT site, key, count(DISTINCT page_id) AS pages FROM c GROUP BY ALL),
s AS (SELECT site, count(DISTINCT page_id) AS whole FROM c GROUP BY ALL),
f AS (SELECT DISTINCT block_id, line_no FROM c JOIN n USING (site, key) JOIN s USING (site) WHERE pages >= 4 AND pages * 10 >= whole * 3)
"""

#: Brute force over shared word runs: fine for checking, quadratic in the texts of a run.
_P7 = r"""
WITH w AS (SELECT DISTINCT block_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM content_blocks WHERE text IS NOT NULL),
  s AS (SELECT block_id, text, list_sort(list_distinct(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) AS runs FROM w WHERE len(w) >= 40),
  k AS (SELECT block_id, runs, min(block_id) OVER (PARTITION BY text) AS rep FROM s),
  g AS (SELECT rep AS id, unnest(runs) AS run, len(runs) AS n FROM k WHERE block_id = rep),
  p AS (SELECT a.id AS a, b.id AS b, count(*) AS both_n, any_value(a.n) AS na, any_value(b.n) AS nb FROM g a JOIN g b ON a.run = b.run AND a.id < b.id GROUP BY a.id, b.id),
  l AS (SELECT a, b FROM p WHERE both_n >= 0.5 * (na + nb - both_n) - 1e-9)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_kinds": p1_kinds,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_rejoined": p2_rejoined,
    "p3_found": p3_found,
    "p3_bodies": p3_bodies,
    "p6_found": p6_found,
    "p6_cleaned": p6_cleaned,
    "p7_found": p7_found,
    "p7_classes": p7_classes,
    "p8_ids": p8_ids,
    "p8_counts": p8_counts,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_lines": p10_lines,
    "p10_documents": p10_documents,
}

ORACLE = {
    "p7_found": _P7 + "SELECT a AS block_a, b AS block_b FROM l UNION ALL SELECT rep, block_id FROM k WHERE block_id <> rep",
    "p7_classes": _P7 + "SELECT block_id, rep AS class_id, (SELECT count(*) FROM l WHERE a = rep OR b = rep) AS links FROM k",
    "p2_rejoined": """
      SELECT DISTINCT item_kind, block_id AS item_id, text, true AS within, true AS shares FROM content_blocks, size_limits WHERE item_kind = 'content_blocks' AND length(text) > max_chars
      UNION ALL SELECT DISTINCT item_kind, chunk_id, content, true, true FROM content_chunks, size_limits WHERE item_kind = 'content_chunks' AND length(content) > max_chars""",
    "p2_found": """
      SELECT DISTINCT item_kind, block_id AS item_id FROM content_blocks, size_limits WHERE item_kind = 'content_blocks' AND length(text) > max_chars
      UNION ALL SELECT DISTINCT item_kind, chunk_id FROM content_chunks, size_limits WHERE item_kind = 'content_chunks' AND length(content) > max_chars""",
    "p6_found": _P6 + "SELECT block_id, CAST(line_no AS BIGINT) AS line_no FROM f",
    "p6_cleaned": _P6
    + """, b AS (SELECT block_id, any_value(text) AS text FROM content_blocks GROUP BY block_id),
      x AS (SELECT block_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM b WHERE text IS NOT NULL),
      y AS (SELECT x.block_id, string_agg(line, chr(10) ORDER BY x.line_no) AS kept FROM x ANTI JOIN f ON x.block_id = f.block_id AND x.line_no = f.line_no GROUP BY ALL),
      z AS (SELECT block_id, count(*) AS removed FROM f GROUP BY ALL)
      SELECT b.block_id, CASE WHEN removed IS NULL THEN text ELSE coalesce(kept, '') END AS text, CAST(coalesce(removed, 0) AS INT) AS removed
      FROM b LEFT JOIN y USING (block_id) LEFT JOIN z USING (block_id)""",
}
