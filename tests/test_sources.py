"""Files, images, providers, storage, exports and streams."""

import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from paperloom.operators import imaging
from paperloom.plans.extraction import results
from paperloom.sources import files, replies, sinks, store
from paperloom.streaming.results import file_stream, stream_results


def picture(h=40, w=100, seed=0):
    img = np.full((h, w, 3), 255, np.uint8)
    img[h // 2 :, :, :] = (0, 90, 110)
    img[5:10, 10:40] = 0
    return img


def test_images_are_read_split_and_enhanced(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(imaging.to_png(picture()))
    (tmp_path / "b.png").write_bytes(b"not an image")
    images = files.read_images(spark, str(tmp_path))
    assert sorted(r[0] for r in images.select("image.height").collect()) == [-1, 40]
    out = imaging.enhance(images, "none").orderBy("seg_idx").collect()
    assert [(r["seg_idx"], r["width"], r["height"]) for r in out] == [(1, 50, 40), (2, 50, 40)]
    assert imaging.enhance(images, "model").count() == 2


def test_pixel_stages():
    img = picture(60, 60)
    assert imaging.safe_size(img).shape == (120, 120, 3)
    assert imaging.invert_bands(img)[-1, 0].tolist() == [255, 165, 145]
    assert imaging.contrast(img).std() >= img.std()
    assert set(np.unique(imaging.threshold_bw(img))) <= {0, 255}
    assert (imaging.thin(img) >= imaging.luma(img)[:, :, None]).all()
    assert imaging.denoise(img).shape == imaging.sharpen(img).shape == imaging.equalise(img).shape == img.shape
    assert imaging.composite(img, (0, 0, 30, 30)).shape[1] == 640
    assert imaging.thumbnail(picture(600, 1200)).shape == (256, 512, 3)
    slanted = np.full((200, 200, 3), 255, np.uint8)
    for x in range(200):
        for y in (60, 120):
            slanted[int(y + x * np.tan(np.radians(5))), x] = 0
    assert abs(imaging.skew_angle(slanted) - 5) <= 0.5
    assert imaging.skew_angle(imaging.deskew(slanted)) == 0


def test_uploads_and_alphabets(spark, tmp_path):
    for n in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    got = files.read_uploads(spark, str(tmp_path), "j", "u@x").select("idx", "saved_name").collect()
    assert sorted(map(tuple, got)) == [(1, "0001_a.png"), (2, "0002_b.JPG")]
    letters = tmp_path / "letters"
    letters.mkdir()
    (letters / "hindi.txt").write_text("a\nb", encoding="utf-8")
    assert files.read_alphabets(spark, str(letters)).collect() == [("hindi", "a\nb")]
    assert files.is_pdf_supported() in (True, False)


def test_recorded_replies_to_results(spark):
    segments = spark.createDataFrame([("d", 1), ("d", 2), ("e", 1), ("f", 1)], "doc_id string, seg_idx int")
    said = [
        ("d", 1, '{"native_json":{"Total":"1"},"native_layout_text":"p1"}'),
        ("d", 2, '{"native_json":{"Total":"2"},"native_layout_text":"","metadata":{"detected_language":"tamil"}}'),
        ("e", 1, "ERROR: down"),
        ("f", 1, '{"native_json":{},"metadata":"x"}'),
    ]
    provider = replies.RecordedReplies(spark.createDataFrame(said, "doc_id string, seg_idx int, reply string"))
    out = {r["doc_id"]: r for r in results(provider.extract(segments)).collect()}
    assert out["d"]["template_fields"]["total_amount"] == "2" and out["d"]["metadata"].asDict() == {"segments_processed": 2, "dominant_language": "tamil"}
    assert out["d"]["vlm_output"] == "p1\n\n---\n\n### SECOND BILL ###\n\nExtraction failed for segment 2"
    assert out["e"]["vlm_source"] == "vlm_parsing_failed" and out["e"]["template_fields"]["_raw_text"] == "ERROR: down"
    assert out["f"]["status"] == "failed" and out["d"]["status"] == "success"


def test_service_failure_is_a_reply(spark):
    assert replies.ServiceReplies("http://127.0.0.1:9").ask(b"", "x", "qwen").startswith("ERROR:")
    assert "[LANGUAGE CONTEXT]" in spark.range(1).select(replies.prompt("tamil")).first()[0]


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("a.png", "invoice", {"k": "v"}, "local_vlm"), ("b.png", "receipt", {}, "x")], "file_name string, document_type string, vlm_fields map<string,string>, vlm_source string")
    path = str(tmp_path / "t")
    store.save(store.invoice_documents(rows), path)
    table = store.read(spark, path)
    assert table.filter(store.valid_id("_id")).count() == 2
    recent = store.history(table, 1)
    assert "TakeOrderedAndProject" in recent._jdf.queryExecution().executedPlan().toString()
    assert recent.select("ocr.*").columns == ["language_summary", "invoice_fields"]
    key = table.first()["_id"]
    assert store.get_result(table, key).count() == 1 and store.delete_result(table, key).count() == 1
    assert spark.sql("SELECT timestamp'2024-01-02 03:04:05' t").select(store.iso_time("t")).first()[0] == "2024-01-02T03:04:05"


def test_workbook(spark, tmp_path):
    df = spark.createDataFrame([("n", {"a": "1", "b": "<x>"})], "name string, fields map<string,string>")
    books = sinks.workbooks(df, "fields", "name")
    with zipfile.ZipFile(io.BytesIO(books.first()["xlsx"])) as z:
        assert "&lt;x&gt;" in z.read("xl/worksheets/sheet1.xml").decode()
    sinks.write_files(spark, books.select(F.concat("name", F.lit(".xlsx")).alias("name"), F.col("xlsx").alias("content")), str(tmp_path / "out"))
    assert (tmp_path / "out" / "n.xlsx").exists()
    assert df.select(sinks.export_name("name", "layout_data", F.lit("2024-01-02 03:04:05").cast("timestamp"), ".json")).first()[0] == "n_layout_data_20240102_030405.json"


def test_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).write.mode("append").parquet(str(tmp_path / "in"))
    source = file_stream(spark, str(tmp_path / "in"), "id long")
    stream_results(source, lambda df: df.filter("id % 2 = 0"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).select("id").collect()) == list(range(0, 30, 2))
