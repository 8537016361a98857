"""Cutting lineage through the cluster's shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


#: Exchange files of a frame that is written and read back serve no one after the write.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that Python workers are handed at once where the rows carry texts.
TEXT_ROWS = 2_000
#: For rows of a hundred kilobytes and more: rows read at once from Parquet (4,096 otherwise), bytes that a task sorts (64 MB otherwise, before
#: decompression), and bytes that a writer holds (128 MB otherwise).
_WIDE = {"spark.sql.parquet.columnarReaderBatchSize": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}
_WIDE_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set, a temporary one in a single local process (tests), else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to clash with no column of df, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, batch_rows: int | None = None, wide: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: short lineage, computed once, survives lost executors.

    ``batch_rows`` bounds the rows of an Arrow batch on the way, and so what Python workers and their executors hold.  ``wide`` does so for what
    readers, sorts and writers hold of rows of a hundred kilobytes and more.
    """
    return cut_parts([df], name, batch_rows, wide)


def cut_parts(parts: Iterable[DataFrame], name: str, batch_rows: int | None = None, wide: bool = False) -> DataFrame:
    """Like cut() for a table given in parts of one schema: each is computed when its turn comes, so that only one's shuffle files exist at a time."""
    path = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or fresh_path(spark, name)
        during = {_CLEANUP: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {}) | (_WIDE if wide else {})
        before = {key: spark.conf.get(key, None) for key in during}
        for key, value in during.items():
            spark.conf.set(key, value)
        try:
            df.write.mode("append").options(**{"parquet.block.size": _WIDE_BYTES} if wide else {}).parquet(path)
        finally:
            for key, value in before.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    out = spark.read.schema(schema).parquet(path)
    out._paperloom_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing will read again."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*frames: DataFrame) -> None:
    """Delete the files behind frames made by cut() that nothing will read again."""
    for df in frames:
        path = getattr(df, "_paperloom_path", None)
        if path:
            delete(df.sparkSession, path)
