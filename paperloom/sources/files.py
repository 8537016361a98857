"""Uploads, images and alphabet files as DataFrames."""

from __future__ import annotations

from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_upload


#: Rows that a task is dealt at most, on average, where work costs much a row.
TASK_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """A scanned table dealt over all cores where it lies in few partitions, as a file of one row group does; larger ones as they are.

    For work that costs much a row: a table of few partitions is small to move, and would keep as few cores busy as it has row groups.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 4 * cores else df


def deal(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df of about ``rows`` rows dealt by a key of many values over tasks whose number grows with the rows, whatever the partitions of the shuffles before."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // TASK_ROWS)), key)


def read_uploads(spark: SparkSession, path: str, job_id: str, user_email: str | None = None) -> DataFrame:
    """The files of one job: path, content, name, idx (from 1 by path), saved_name, job_id, user_email.

    A job is one user's upload, a bounded group; numbering partitions by job, never over all jobs at once.
    """
    files = spark.read.format("binaryFile").load(path).withColumns({"name": F.element_at(F.split("path", "/"), -1), "job_id": F.lit(job_id), "user_email": F.lit(user_email)})
    numbered = files.filter(is_upload("name")).withColumn("idx", F.row_number().over(Window.partitionBy("job_id").orderBy("path")))
    return numbered.select("path", "content", "name", "idx", F.format_string("%04d_%s", "idx", "name").alias("saved_name"), "job_id", "user_email")


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """Spark's image source; undecodable files have height -1, or no row."""
    return spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(path)


def read_alphabets(spark: SparkSession, path: str) -> DataFrame:
    """language (the file's stem) and content of every alphabet file."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select(F.regexp_extract("file", r"([^/]*)\.[^./]*$", 1).alias("language"), F.col("value").alias("content"))


def is_pdf_supported() -> bool:
    """Whether a page renderer is installed."""
    return find_spec("fitz") is not None


def render_pdf_pages(uploads: DataFrame, max_pages: int = 5, zoom: float = 2.0) -> DataFrame:
    """path, page (from 1) and png of the first pages of PDF files; raises where no renderer is installed."""
    if not is_pdf_supported():
        raise RuntimeError("rendering PDF pages needs the optional PDF renderer")

    def run(batches):
        import fitz
        import pandas as pd

        for pdf in batches:
            for path, content in pdf.itertuples(index=False):
                doc = fitz.open(stream=bytes(content), filetype="pdf")
                for i in range(min(max_pages, doc.page_count)):
                    png = doc.load_page(i).get_pixmap(matrix=fitz.Matrix(zoom, zoom)).tobytes("png")
                    yield pd.DataFrame({"path": [path], "page": [i + 1], "png": [png]})

    return uploads.filter(F.col("name").rlike(r"(?i)\.pdf$")).select("path", "content").mapInPandas(run, "path string, page int, png binary")
