import json

from pyspark.sql import functions as F

from sheaf.sources import snapshots as src
from sheaf.streaming import flush


def test_snapshot_files_and_quarantine(spark, tmp_path):
    (tmp_path / "a_1.json").write_text(json.dumps({"extraction_id": "a_1", "pages": [{"url": "u", "content_blocks": [{"content_type": "heading", "text": "H", "order": 0}], "unknown": 1}]}, indent=1))
    (tmp_path / "b_1.json").write_text("{broken")
    (tmp_path / "c.txt").write_text("no snapshot")
    good, bad = src.readable(src.snapshot_files(spark, str(tmp_path)).cache())
    assert [(r.extraction_id, r.file_id) for r in good.collect()] == [("a_1", "a_1")] and [r.file_id for r in bad.collect()] == ["b_1"]
    assert [(r.url, r.text) for r in src.snapshot_blocks(good).collect()] == [("u", "H")]
    assert src.listed_files(spark, str(tmp_path), prefix="a_").count() == 1


def test_saved_snapshots_are_pruned_by_folder(spark, tmp_path):
    rows = spark.createDataFrame([("p", "p_1", "x"), ("p", "p_2", "y")], "product_id string, extraction_id string, text string")
    src.save_snapshots(rows, str(tmp_path / "s"))
    read = spark.read.parquet(str(tmp_path / "s")).where("extraction_id = 'p_2'")
    assert [r.text for r in read.collect()] == ["y"] and "PartitionFilters: [isnotnull(extraction_id" in read._jdf.queryExecution().toString()
    src.save_texts(rows, "extraction_id", str(tmp_path / "t"))
    src.save_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.text(str(tmp_path / "t")).count() == 2


def test_templates_from_objects_and_arrays(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"name": "a", "template": "x"}))
    (tmp_path / "many.json").write_text(json.dumps([{"name": "b", "template": "y", "tags": ["t"]}, {"name": "c", "template": "z"}]))
    assert {r.name for r in src.template_files(spark, str(tmp_path)).collect()} == {"a", "b", "c"}


def test_stream_equals_batch_and_monitor_counts_changes(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [[("u/1", None, "old", 1), ("u/2", None, "same", 1)], [("u/1/", None, "new", 2)], [("u/2", None, "SAME ", 3), (None, None, "x", 3)]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "url string, content_hash string, page_text string, extracted_at int").coalesce(1).write.parquet(str(folder / f"pages.parquet/part={i}"))
    stream = flush.file_stream(spark, str(folder), "pages", files_per_batch=1)
    state = {r.url_key: r.changes for r in flush.monitored(spark, stream).collect()}
    assert state == {"u/1": 1, "u/2": 0}
    made = flush.flushed(spark, flush.file_stream(spark, str(folder), "pages", 1), lambda b: b.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    assert made.agg(F.sum("n")).first()[0] == 5


def test_entry_and_registration(spark):
    import __spark_entry__ as e

    names, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 90
    assert e.entry(spark).columns == ["status", "pages"]
