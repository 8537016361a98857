"""Uploads as a stream: each file's result as it is done, and an end mark when a job's files are all through.

Files lie as ``<folder>/<job_id>/<NNNN>_<name>``, and a job's manifest, which says how many files it has, in a folder of JSON lines; either may come first.  One
query takes files through the extraction plan and writes their results, a folder per micro-batch; a second one keeps, per job, which files it has seen and how many there are to
be, and gives a ``result`` event for each file and one ``done`` event.  Both write each micro-batch under its number, so that a batch that runs again after a
restart replaces what it wrote.

State is a job's file numbers, in RocksDB: it needn't fit memory, and a job of any size is taken batch by batch.  A file that comes twice gives one event.  With ``patience_ms`` a job
that stays unfinished, or was finished, for so long is forgotten; that takes a query that runs on, since Spark runs batches without data for it for ever.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import is_upload
from .results import file_stream, stream_results

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BINARY = "path string, modificationTime timestamp, length bigint, content binary"
MANIFEST = "job_id string, files int"
EVENTS = "job_id string, event string, idx int, name string, data string, files int"


def upload_stream(spark: SparkSession, folder: str, per_batch: int = 64) -> DataFrame:
    """job_id, idx, name and content of uploaded files as they come, a bounded number per micro-batch; files of other kinds are passed over."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    saved = F.element_at(parts, -1)
    named = files.select(F.element_at(parts, -2).alias("job_id"), F.regexp_extract(saved, r"^(\d+)_", 1).try_cast("int").alias("idx"), F.regexp_replace(saved, r"^\d+_", "").alias("name"), "content")
    return named.filter(F.col("idx").isNotNull() & is_upload("name"))


class JobEvents(StatefulProcessor):
    """The events of one job, whatever order its files and its manifest come in."""

    def __init__(self, patience_ms: int | None):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "idx int", "seen boolean", self.patience_ms)
        self.count = handle.getValueState("count", "n int, files int, closed boolean", self.patience_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, files, closed = self.count.get() if self.count.exists() else (0, -1, False)
        for part in rows:
            out = []
            for kind, idx, name, data, said in zip(part["event"], part["idx"], part["name"], part["data"], part["files"], strict=True):
                if kind == "manifest":
                    files = max(files, int(said))
                elif not self.seen.containsKey((int(idx),)):
                    self.seen.updateValue((int(idx),), (True,))
                    n += 1
                    out.append((key[0], "result", int(idx), name, data, None))
            if out:
                yield pd.DataFrame(out, columns=["job_id", "event", "idx", "name", "data", "files"]).astype({"files": "Int32"})
        if 0 <= files <= n and not closed:
            closed = True
            yield pd.DataFrame({"job_id": [key[0]], "event": ["done"], "idx": pd.array([None], "Int32"), "name": [None], "data": [None], "files": pd.array([n], "Int32")})
        self.count.update((n, files, closed))

    def close(self) -> None:
        pass


def job_events(results: DataFrame, manifests: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """Events (job_id, event, idx, name, data, files) of streams of results (job_id, idx, name, data) and manifests (job_id, files)."""
    none = F.lit(None)
    both = results.select("job_id", F.lit("result").alias("event"), F.col("idx").cast("int").alias("idx"), "name", "data", none.cast("int").alias("files")).union(
        manifests.select("job_id", F.lit("manifest"), none.cast("int"), none.cast("string"), none.cast("string"), "files")
    )
    return both.groupBy("job_id").transformWithStateInPandas(JobEvents(patience_ms), EVENTS, "Append", "ProcessingTime" if patience_ms else "None")


@contextmanager
def _state_in_rocksdb(spark: SparkSession):
    """A query's state store is settled when it starts; other queries of the session keep theirs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stream_events(spark: SparkSession, results: str, schema, manifests: str, out: str, checkpoint: str, per_batch: int = 64) -> StreamingQuery:
    """Events of the results under a folder (a folder per batch, as ``stream_results`` writes them), into ``out``."""
    done = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").parquet(results)
    events = job_events(done, file_stream(spark, manifests, MANIFEST, "json", per_batch))
    with _state_in_rocksdb(spark):
        return stream_results(events, lambda batch: batch, out, checkpoint)


def run_uploads(spark: SparkSession, uploads: DataFrame, manifests: str, extract: Callable[[DataFrame], DataFrame], at: str, per_batch: int = 64) -> DataFrame:
    """Take what has come so far through both queries: the events under ``at``, of this call and earlier ones.

    ``extract`` gives job_id, idx, name and data, one row a file, of a batch of uploads.
    """
    stream_results(uploads, extract, f"{at}/results", f"{at}/results-checkpoint").awaitTermination()
    schema = "job_id string, idx int, name string, data string"
    stream_events(spark, f"{at}/results", schema, manifests, f"{at}/events", f"{at}/events-checkpoint", per_batch).awaitTermination()
    return spark.read.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{at}/events")
