"""The corpus pipeline, stage by stage, on planted cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = np.random.default_rng(11)

    def text(n):
        return " ".join(f"w{x}" for x in rng.integers(0, 20_000, n))

    rows = {i: f"{text(40)}\n{text(60)}\n{text(50)}" for i in range(120)}
    for i in range(0, 120, 4):
        rows[i] = rows[i].replace(" ", " grobnik ", 6)
    clean = [i for i in rows if i % 4]
    rows[201] = rows[clean[0]]
    rows[202] = rows[clean[1]].replace(" ", " extra ", 1)
    block = "\n".join(text(12) for _ in range(4))
    rows[203], rows[204] = f"{text(50)}\n{block}", f"{block}\n{text(55)}"
    passage = text(80)
    rows[205], rows[206] = f"{text(60)} {passage} {text(60)}", f"{text(70)} {passage} {text(50)}"
    rows[207] = None
    at = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows, block, passage


def test_stages(spark, planted):
    at, rows, block, passage = planted
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
    clean = {i for i in rows if i >= 200 or i % 4}
    assert set(kept["toxicity"]) == clean
    assert block in kept["line dedup"][203] and not any(x in kept["line dedup"][204] for x in block.split("\n"))
    assert set(kept["line dedup"]) == clean
    assert clean - set(kept["near dedup"]) == {202}
    assert passage in kept["substring dedup"][205] and passage not in kept["substring dedup"][206]
    assert len(kept["substring dedup"][206].split()) == 120


def test_run(spark, planted):
    at, rows, *_ = planted
    out = P.run(spark, at)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert out.select("doc_id").distinct().count() == len([i for i in rows if (i >= 200 or i % 4) and i != 202])
