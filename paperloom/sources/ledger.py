"""A ledger of replies, so that a model is asked once for each image, prompt and model, however often jobs run or fail.

A call's identity is the hash of image, prompt and model.  Replies of finished jobs are Parquet tables under ``runs``.  Replies of jobs under way are
journalled as they come, a file each, put in place by a rename: a task that Spark runs again, and a job that was killed and is started again, find there what was
answered.  A finished job takes the journal into its own table and clears it.  Failures are not kept: the next job asks again.

The ledger's path must be one that pyarrow's file systems know (a local or shared folder, HDFS, object stores), since Python workers write the journal.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .replies import ERROR, Service, with_replies

_KINDS = "call_key string, reply string"


def call_key(image: bytes | None, text: str, model: str) -> str:
    return hashlib.sha256("\n".join([hashlib.sha256(image or b"").hexdigest(), hashlib.sha256(text.encode()).hexdigest(), model]).encode()).hexdigest()


def _key_column(model: str, columns: list[str]) -> Column:
    own = F.coalesce("model", F.lit(model)) if "model" in columns else F.lit(model)
    image = F.sha2(F.coalesce("png", F.lit(b"")), 256)
    return F.sha2(F.concat_ws("\n", image, F.sha2(F.col("prompt").cast("binary"), 256), own).cast("binary"), 256)


class Journal:
    """A service whose good answers are written down before they are used."""

    def __init__(self, service: Service, path: str):
        self.service, self.path, self.model, self.concurrency = service, path, service.model, service.concurrency

    def ask(self, image: bytes | None, text: str, model: str) -> str:
        key = call_key(image, text, model)
        fs, folder = pyarrow.fs.FileSystem.from_uri(f"{self.path}/{key[:2]}")
        place = f"{folder}/{key}.json"
        if fs.get_file_info(place).type == pyarrow.fs.FileType.File:
            with fs.open_input_stream(place) as f:
                return json.loads(f.read())["reply"]
        reply = self.service.ask(image, text, model)
        if not reply.startswith(ERROR):
            fs.create_dir(folder, recursive=True)
            attempt = f"{folder}/_{key}-{uuid.uuid4().hex}"
            with fs.open_output_stream(attempt) as f:
                f.write(json.dumps({"call_key": key, "reply": reply}).encode())
            fs.move(attempt, place)
        return reply


class Ledger:
    """A provider that asks ``service`` for what the ledger under ``path`` lacks, each different call once."""

    def __init__(self, service: Service, path: str):
        self.service, self.path = service, path.rstrip("/") if "://" in path else f"file://{path.rstrip('/')}"
        self.journal = Journal(service, f"{self.path}/journal")

    def _read(self, spark: SparkSession, part: str, kind: str) -> DataFrame:
        at = f"{self.path}/{part}"
        if not scratch.exists(spark, at):
            return spark.createDataFrame([], _KINDS)
        return spark.read.schema(_KINDS).option("recursiveFileLookup", "true").format(kind).load(at)

    def replies(self, spark: SparkSession) -> DataFrame:
        """call_key and reply of every call, good replies before failures."""
        rows = self._read(spark, "runs", "parquet")
        return rows.groupBy("call_key").agg(F.min_by("reply", F.col("reply").startswith(ERROR)).alias("reply"))

    def extract(self, segments: DataFrame) -> DataFrame:
        spark = segments.sparkSession
        keyed = segments.withColumn("call_key", _key_column(self.service.model, segments.columns))
        noted = self._read(spark, "journal", "json").dropDuplicates(["call_key"])
        known = self._read(spark, "runs", "parquet").filter(~F.col("reply").startswith(ERROR)).select("call_key").union(noted.select("call_key"))
        columns = ["call_key", "png", "prompt", *(["model"] if "model" in segments.columns else [])]
        missing = keyed.select(columns).join(known, "call_key", "left_anti").dropDuplicates(["call_key"])
        asked = with_replies(self.service.deal(missing), self.journal).select("call_key", "reply")
        asked.unionByName(noted).write.parquet(f"{self.path}/runs/run-{uuid.uuid4().hex}")
        scratch.delete(spark, f"{self.path}/journal")
        return keyed.join(self.replies(spark), "call_key", "left").drop("call_key")
