"""Reply envelopes, cleaning and scalars against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import clean, parse, report, segments


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


ENVELOPES = [
    ("", None),
    (None, None),
    ('```json\n{"a":1}\n```', ('{"a":1}', None)),
    ('note {"a":1} end', ('{"a":1}', None)),
    ("no json", (None, "no json")),
    ("} x {", (None, "")),
    ('{"a":1} {"b":2}', (None, '{"a":1} {"b":2}')),
    ('ERROR: HTTP Error 500: {"error":"x"}', ('{"error":"x"}', None)),
    ('{"a":1,"b":2,"a":3}', ('{"a":1,"b":2,"a":3}', None)),
    ("12", ("12", None)),
]


@pytest.mark.parametrize(("reply", "want"), ENVELOPES)
def test_envelope(spark, reply, want):
    got = one(spark, reply, parse.envelope)
    assert (got and (got["fields"], got["full_extraction"])) == want


def test_extraction(spark):
    reply = json.dumps({"native_json": {"Name": "A", "metadata": 1}, "native_layout_text": 'say "x"', "metadata": {"detected_language": "tamil"}})
    got = one(spark, reply, parse.extraction)
    assert json.loads(got["fields"]) == {"Name": "A", "full_extraction": 'say "x"', "english_extraction": "", "metadata": {"detected_language": "tamil"}}
    assert got["is_invoice"] and got["_source"] == "local_vlm"
    assert one(spark, '{"native_json": [1]}', parse.extraction)["_source"] == "failed"
    assert json.loads(one(spark, "x" * 1500, parse.extraction)["fields"]) == {"full_extraction": "x" * 1000}


REPETITION = [("a a a b", "a a a b"), ("a a a a b c", ""), ("aa aa aa bb cc", "aa aa aa bb cc"), ("1 2 3 4 5 total", ""), ("12 34 56 78 90", "12 34 56 78 90"), ("", ""), (None, None)]


@pytest.mark.parametrize(("text", "want"), REPETITION)
def test_repetition(spark, text, want):
    assert one(spark, text, clean.strip_repetition) == want


LINES = [
    ("x\nx\ny\nx", "x\ny\nx"),
    ("a\n\n\nb", "a\n\nb"),
    ("x\n| r |\nx", "x\n| r |"),
    ("| h |\n|---|\n| 1 |\n| 1 |\n| 2 |\n| 1 |", "| h |\n|---|\n| 1 |\n| 1 |\n| 2 |"),
    ("| 1 |\n| 2 |\n| 1 |", "| 1 |\n| 2 |"),
    ("| r |\ntext\n| r |", "| r |\ntext\n| r |"),
    ("|---|\n|---|\n| r |", "|---|\n| r |"),
]


@pytest.mark.parametrize(("text", "want"), LINES)
def test_dedup_lines(spark, text, want):
    assert one(spark, text, clean.dedup_markdown) == want


SCALARS = [(None, "Not Detected"), ("", "Not Detected"), (" : ", "Not Detected"), ("N/A", "Not Detected"), ("None", "Not Detected"), ("not found", "Not Detected"), ("  a   b: ", "a b"), ("3", "3")]


@pytest.mark.parametrize(("value", "want"), SCALARS)
def test_scalars(spark, value, want):
    assert one(spark, value, T.normalize_scalar) == want


BOXES = [
    (1800, 1000, [(0, 0, 1800, 1000)], (1800, 1000)),
    (1801, 1000, [(0, 0, 900, 1000), (900, 0, 1801, 1000)], (1801, 1000)),
    (1000, 1500, [(0, 0, 1000, 1500)], (1000, 1500)),
    (1000, 1501, [(0, 0, 1000, 825), (0, 675, 1000, 1501)], (1000, 1501)),
    (500, 500, [(0, 0, 500, 500)], (800, 800)),
    (300, 100, [(0, 0, 150, 100), (150, 0, 300, 100)], (600, 200)),
    (3000, 2000, [(0, 0, 3000, 2000)], (2000, 1333)),
]


@pytest.mark.parametrize(("w", "h", "boxes", "size"), BOXES)
def test_boxes(spark, w, h, boxes, size):
    row = spark.createDataFrame([(w, h)], "w int, h int").select(segments.segment_boxes("w", "h").alias("b"), segments.resized("w", "h").alias("r")).first()
    assert ([tuple(b) for b in row["b"]] if w <= h * 1.8 or h else None) == boxes
    assert tuple(row["r"]) == size


def test_text_helpers(spark):
    assert one(spark, " Bill No.-x ", T.normalize_key) == "bill_no_x"
    assert one(spark, " a/b c?é ", T.safe_name) == "a_b_c_é"
    assert one(spark, " ", T.safe_name) == "document"
    assert one(spark, "Hindi!\n", T.language_word) == "hindi"
    assert one(spark, None, T.language_word) == "mixed"
    assert one(spark, "a\r\nb\x0bc\n", T.split_lines) == ["a", "b", "c"]
    hint = "=== STANDARD ALPHABETS ===\n# note\nअ आ\nइ\n\nother"
    assert one(spark, hint, lambda c: T.alphabet_hint(F.lit("hindi"), c)) == "[Script Reference: Hindi]\nAlphabets: अ आ इ\n"
    assert one(spark, "a, ,b", lambda c: T.csv_list(c, ["z"])) == ["a", "b"]
    assert one(spark, " YES ", lambda c: T.truthy_setting(c, False)) is True
    assert one(spark, ["GST: ", "x GST 27 A"], lambda c: report.labeled_value(c, ("gst",)), "array<string>") == "GST 27 A"


def test_report_data_are_normalized_once(spark):
    """Of equal keys the last value stands, and values are not normalized again for every key."""
    data = F.map_from_arrays(F.array(F.lit("A"), F.lit(" a"), F.lit("b")), F.array(F.lit("1"), F.lit(" 2 "), F.lit("n/a")))
    df = spark.range(1).select(F.col("id"), data.alias("d")).select(report.normalize_data("d").alias("n"))
    assert df.first()[0] == {"a": "2", "b": "Not Detected"}
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1
