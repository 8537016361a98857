"""The table of stored results: building documents, history, lookup and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

HEAVY = {"ocr": ("texts", "layout"), "layout": ("regions",)}
DEFAULTS = {"json_url": "", "excel_url": "", "txt_report_url": "", "gsheets_synced": False}


def invoice_documents(results: DataFrame) -> DataFrame:
    """Results as stored documents, with defaults for what they lack.

    Reads the columns file_name, document_type, vlm_fields (map), vlm_source and, where present, status, error, created_at, ocr_texts,
    ocr_language_summary, ocr_invoice_fields, ocr_layout, layout_regions, detected_blocks, layoutlm_status, embedding_preview and the export urls.
    """

    def col(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in results.columns else default

    texts, text_map, blocks = F.array().cast("array<string>"), F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    exports = F.struct(*(col(n, F.lit(d)).alias(n) for n, d in DEFAULTS.items()))
    return results.select(
        col("created_at", F.current_timestamp()).alias("created_at"),
        "file_name",
        col("status", F.lit("success")).alias("status"),
        (F.col("error") if "error" in results.columns else F.lit(None).cast("string")).alias("error"),
        "document_type",
        F.struct(col("ocr_texts", texts).alias("texts"), col("ocr_language_summary", text_map).alias("language_summary"), col("ocr_invoice_fields", text_map).alias("invoice_fields"), col("ocr_layout", blocks).alias("layout")).alias("ocr"),
        F.struct(
            col("layout_regions", blocks).alias("regions"), col("detected_blocks", blocks).alias("detected_blocks"), col("layoutlm_status", text_map).alias("layoutlm_status"), col("embedding_preview", F.array().cast("array<double>")).alias("embedding_preview")
        ).alias("layout"),
        F.struct(F.col("vlm_fields").alias("fields"), F.col("vlm_source").alias("source")).alias("vlm"),
        exports.alias("exports"),
        F.substring(F.sha2(F.concat_ws("\x01", "file_name", F.uuid()), 256), 1, 24).alias("_id"),
    )


def save(documents: DataFrame, path: str) -> None:
    documents.write.mode("append").parquet(path)


def iso_time(at: Column | str) -> Column:
    """ISO time; a zero fraction of a second is left out."""
    return F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def history(documents: DataFrame, limit: int = 20, at: str = "created_at", key: str = "_id") -> DataFrame:
    """The newest results without their heavy parts; equal times are ordered by id."""
    light = documents
    for parent, fields in HEAVY.items():
        if parent in documents.columns:
            light = light.withColumn(parent, F.col(parent).dropFields(*fields))
    return light.orderBy(F.desc(at), F.desc(key)).limit(limit).withColumn(at, iso_time(at)).withColumn(key, F.col(key).cast("string"))


def get_result(documents: DataFrame, key, column: str = "_id") -> DataFrame:
    return documents.filter(F.col(column) == key).limit(1)


def delete_result(documents: DataFrame, key, column: str = "_id") -> DataFrame:
    """The table without one result; the caller writes it back, or deletes in place where the table format can."""
    return documents.filter(~F.col(column).eqNullSafe(key))


def valid_id(key: Column | str) -> Column:
    return (F.col(key) if isinstance(key, str) else key).rlike("^[0-9a-fA-F]{24}$")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class ResultTable:
    """Stored results laid out by day and, within a day, by the hash of their id.

    A lookup by id reads one bucket of each day, and of its files only row groups whose Bloom filter may hold the id; history reads the newest days that hold as many rows as it
    shows; a deletion rewrites one bucket of one day.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, key: str = "_id", at: str = "created_at"):
        self.spark, self.path, self.buckets, self.key, self.at = spark, path.rstrip("/"), buckets, key, at

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, mode: str) -> None:
        writer = rows.repartition("day", "bucket").sortWithinPartitions(self.key).write.mode(mode).partitionBy("day", "bucket")
        writer.option(f"parquet.bloom.filter.enabled#{self.key}", "true").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def save(self, documents: DataFrame) -> None:
        self._write(documents.withColumns({"day": F.to_date(self.at), "bucket": self._bucket(F.col(self.key))}), "append")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def get(self, key) -> DataFrame:
        """The result of an id: PartitionFilters on the bucket, PushedFilters on the id."""
        rows = self.rows()
        own = F.lit(key).cast(rows.schema[self.key].dataType)
        return rows.filter((F.col("bucket") == self._bucket(own)) & (F.col(self.key) == own)).limit(1)

    def delete(self, key) -> bool:
        """Remove an id's result and say whether there was one."""
        there = self.get(key).select("day", "bucket").first()
        if there is None:
            return False
        day, bucket = there
        same = F.col("day").eqNullSafe(F.lit(day).cast("date")) & (F.col("bucket") == bucket)
        left, at = self.rows().filter(same & (F.col(self.key) != key)), scratch.fresh_path(self.spark, "bucket")
        left.write.parquet(at)
        left = self.spark.read.schema(left.schema).parquet(at)
        if left.isEmpty():
            named = "__HIVE_DEFAULT_PARTITION__" if day is None else str(day)
            scratch.delete(self.spark, f"{self.path}/day={named}/bucket={bucket}")
        else:
            self._write(left, "overwrite")
        scratch.delete(self.spark, at)
        return True

    def days(self) -> list[str]:
        """The days that have a folder, newest first."""
        fs, p = scratch.hadoop_path(self.spark, self.path)
        names = (status.getPath().getName() for status in fs.listStatus(p))
        return sorted((n.removeprefix("day=") for n in names if n.startswith("day=") and not n.endswith("__HIVE_DEFAULT_PARTITION__")), reverse=True)

    def newest(self, limit: int) -> DataFrame:
        """The rows of the newest days that hold at least ``limit`` rows, of all days if they are fewer; days are tried in doubling numbers, by their newest rows' count alone."""
        days, n = self.days(), 1
        while n < len(days):
            some = self.rows().filter(F.col("day") >= F.lit(days[n - 1]).cast("date"))
            if some.select("day").limit(limit).count() >= limit:
                return some
            n *= 2
        return self.rows()

    def history(self, limit: int = 20) -> DataFrame:
        return history(self.newest(limit), limit, self.at, self.key).drop("day", "bucket")
