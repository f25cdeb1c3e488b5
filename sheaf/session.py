"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Settings a job should start with; cluster sizes belong to the deployment.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(name: str = "sheaf", **conf: str) -> SparkSession:
    """A session with DEFAULTS; conf overrides them (dots written as "__")."""
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset a temporary one is made, which only suits local mode.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sheaf-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_kept: set[str] = set()


def run_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it is deleted when the application ends."""
    folder = os.path.join(shared_dir(spark), f"sheaf-{spark.sparkContext.applicationId}")
    if folder not in _kept:
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _kept.add(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the application's shared folder and read back.

    Cuts the lineage like checkpoint(), but columnar and compressed, and it
    survives the loss of executors. The files live until the application ends.
    """
    path = os.path.join(run_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes that are broadcast at most.
SMALL_BYTES = 64 * 2**20


def small(rows: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """rows with a broadcast hint if they are small enough (measured by a job: bytes of texts and lists, 16 for other values), else as they are, for a shuffle join."""
    def width(c: str, kind: T.DataType):
        at = F.col(f"`{c}`")
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(at), F.lit(0)) + 16
        if isinstance(kind, T.AtomicType):
            return F.lit(16)
        return F.coalesce(F.octet_length(F.to_json(F.struct(at))), F.lit(0)) + 16

    size = sum((width(f.name, f.dataType) for f in rows.schema.fields), F.lit(16))
    return F.broadcast(rows) if (rows.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else rows
