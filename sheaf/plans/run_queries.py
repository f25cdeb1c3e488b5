"""Queries over streams and model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions.parsing import parsed_json
from sheaf.operators import model
from sheaf.plans.data_queries import _PAGES
from sheaf.sources.tables import table
from sheaf.streaming import flush


def stream_flush(spark, d):
    """Totals by event type of all micro-batches; the same as over the table."""
    made = flush.flushed(spark, flush.file_stream(spark, d, "events"), lambda rows: rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")))
    return made.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("v"))


def stream_last_hash(spark, d):
    """The hash of the latest row of each page and how often it changed, kept by the change monitor."""
    return flush.monitored(spark, flush.file_stream(spark, d, "snapshot_pages"))


def _answers(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return model.called(model.prompts(texts, ["features", "summary", "name"]))


def model_answers(spark, d):
    """Answers of the deterministic model, parsed: number of items by document and aspect."""
    items = F.size(F.try_variant_get(parsed_json(F.col("answer")), "$.features", "array<variant>"))
    return _answers(spark, d).select(F.col("key").alias("doc_id"), "aspect", "input_tokens", F.when(F.col("aspect") == "features", items).alias("items"))


def _echo():
    """A model for tests of the operator: the prompt's first hundred characters, an error where the prompt's length divides by five."""
    def ask(prompt: str) -> str:
        if len(prompt) % 5 == 0:
            raise ValueError("a length it refuses")
        return prompt[:100]

    return ask


def model_totals(spark, d):
    """Tokens and confidence of runs over three aspects, some of which fail."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return model.run_totals(model.called(model.prompts(texts, ["features", "summary", "name"]), _echo)).withColumnRenamed("key", "doc_id")


def prompt_sizes(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return model.prompts(texts).select(F.col("key").alias("doc_id"), "aspect", F.length("prompt").alias("chars"))


QUERIES = {f.__name__: f for f in (stream_flush, stream_last_hash, model_answers, model_totals, prompt_sizes)}

ORACLE = {
    "model_totals": """WITH p AS (SELECT doc_id, length(aspect) + 1 + least(length(text), most) AS n FROM documents, (VALUES ('features', 80000), ('summary', 80000), ('name', 2000)) a(aspect, most) WHERE text IS NOT NULL)
      SELECT doc_id, CAST(sum(n // 4 + CASE WHEN n % 5 = 0 THEN 0 ELSE least(n, 100) // 4 END) AS BIGINT) AS tokens, round(count(*) FILTER (n % 5 <> 0) / count(*), 4) AS confidence, count(*) FILTER (n % 5 <> 0) AS aspects_ok FROM p GROUP BY doc_id""",
    "stream_flush": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY event_type",
    "stream_last_hash": _PAGES.split("pages AS (")[0].rstrip().rstrip(",") + """, q AS (SELECT url_key, extracted_at, hash, lag(hash) OVER (PARTITION BY url_key ORDER BY extracted_at, hash) AS before FROM (SELECT DISTINCT url_key, extracted_at, hash FROM keyed))
      SELECT url_key, max_by(hash, struct_pack(a := extracted_at, h := hash)) AS hash, count(*) FILTER (before <> hash) AS changes FROM q GROUP BY url_key""",
    "prompt_sizes": "SELECT doc_id, aspect, CAST(length(aspect) + 1 + least(length(text), most) AS INT) AS chars FROM documents, (VALUES " + ", ".join(map(str, model.ASPECTS.items())) + ") a(aspect, most) WHERE text IS NOT NULL",
}
