"""Two calls a page: a scan for its language, then the extraction by the model that the language goes to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LANGUAGE_RULES, alphabet_hint, language_word, model_for
from ..sources import scratch
from ..sources.replies import SCAN_PROMPT, Provider, prompt

SCAN_MODEL = "minicpm"


def deal_by_model(tasks: dict[str, int]) -> Callable[[DataFrame], DataFrame]:
    """Lays rows out so that each task holds one model's rows: ``tasks`` says over how many a model's are split; other models go last, in a task."""
    total = sum(tasks.values()) + 1

    def deal(df: DataFrame) -> DataFrame:
        place, first = F.lit(total - 1), 0
        for model, n in tasks.items():
            place = F.when(F.col("model") == model, F.pmod(F.xxhash64("doc_id", "seg_idx") if "doc_id" in df.columns else F.xxhash64("call_key"), F.lit(n)).cast("int") + first).otherwise(place)
            first += n
        return df.repartitionById(total, place)

    return deal


def with_languages(segments: DataFrame, scanner: Provider) -> DataFrame:
    """segments with ``language``, asked of the scanner and written once; what it can't name is mixed."""
    scanned = scanner.extract(segments.withColumns({"prompt": F.lit(SCAN_PROMPT), "model": F.lit(SCAN_MODEL)}))
    said = scanned.select(*segments.columns, F.coalesce(language_word("reply"), F.lit("mixed")).alias("language"))
    at = scratch.fresh_path(segments.sparkSession, "scanned")
    said.write.parquet(at)
    return segments.sparkSession.read.schema(said.schema).parquet(at)


def with_calls(segments: DataFrame, alphabets: DataFrame | None = None) -> DataFrame:
    """segments with language, with the prompt and model of their extraction.

    Of ``alphabets`` (language, content) there is a row of at most some 200 characters for each language that a scan can name, which bounds what is broadcast.
    """
    hint: Column | None = None
    if alphabets is not None:
        letters = alphabets.filter(F.col("language").isin(*LANGUAGE_RULES)).groupBy("language").agg(F.min(alphabet_hint("language", "content")).alias("letters"))
        segments, hint = segments.join(F.broadcast(letters), "language", "left"), F.col("letters")
    return segments.withColumns({"prompt": prompt(F.col("language"), hint), "model": model_for("language")}).drop("letters")


class TwoStep:
    """A provider of two calls a segment.  ``extractor`` is asked with the languages' prompts and models; give its service ``deal_by_model``."""

    def __init__(self, scanner: Provider, extractor: Provider, alphabets: DataFrame | None = None):
        self.scanner, self.extractor, self.alphabets = scanner, extractor, alphabets

    def extract(self, segments: DataFrame) -> DataFrame:
        return self.extractor.extract(with_calls(with_languages(segments, self.scanner), self.alphabets))
