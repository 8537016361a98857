"""Winnowing selects, salvage searches once, added columns clash with none, disguised terms count."""

import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import line_dedup as L
from paperloom.llm import toxicity, warc
from paperloom.llm.substring_dedup import substring_dedup


def record(n, payload):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:paperloom:page:{n}>\r\nWARC-Block-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\n"
    return head.encode() + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def test_fingerprints_are_window_minima(spark):
    """About half of the lines, one in every window, the same ones whatever stands beside a run."""
    rng = np.random.default_rng(2)
    texts = {i: "\n".join(f"line {x}" for x in rng.integers(0, 10_000, 400)) for i in range(5)}
    run = "\n".join(f"shared {i}" for i in range(9))
    texts |= {10: f"a\nb\n{run}\nc", 11: f"x\n{run}\ny\nz"}
    lines = L.hashed_lines(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    hashes = {r["doc_id"]: r["h"] for r in lines.collect()}
    chosen = {i: {} for i in texts}
    for r in L.fingerprints(lines).collect():
        assert r["h"] == hashes[r["doc_id"]][r["p"]]
        chosen[r["doc_id"]][r["p"]] = set(r["starts"])
    for i, h in hashes.items():
        want = {}
        for s in range(len(h) - 2):
            p = min(range(s, s + 3), key=lambda n: (h[n], -n))
            want.setdefault(p, set()).add(s)
        assert chosen[i] == want
    windows = sum(len(h) - 2 for h in hashes.values())
    assert sum(map(len, chosen.values())) < 0.6 * windows
    inside = [{p - at for p, s in chosen[i].items() if any(at <= x and x + 3 <= at + 9 for x in s)} for i, at in ((10, 2), (11, 1))]
    assert inside[0] == inside[1] and inside[0]


def test_ordinary_lines_go_no_further(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"own {i} {n}" for n in range(50)) + "\ncommon") for i in range(20)], "doc_id bigint, text string")
    assert L.seeds_of(L.hashed_lines(docs)).count() <= 20 * 3


def test_equal_hashes_of_long_documents(spark):
    """Long runs from several sources, blank lines inside runs stay."""
    a, b = [f"a{i}" for i in range(300)], [f"b{i}" for i in range(300)]
    docs = [(1, "\n".join(a)), (2, "\n".join(b)), (3, "\n".join([*a[10:200], "", *b[5:150], "own", "", *a[:3]]))]
    got = {r["doc_id"]: r["text"] for r in L.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[3] == "\nown\n" and got[1] == docs[0][1] and got[2] == docs[1][1]


@pytest.mark.parametrize("member", [True, False])
def test_salvage_searches_a_file_once(monkeypatch, member):
    """Every fourth record damaged: the bytes looked through for the next one stay within a few times the file."""
    looked = []

    def counted(find):
        def run(data, at):
            found = find(data, at)
            looked.append((len(data) if found < 0 else found) - at)
            return found

        return run

    monkeypatch.setattr(warc, "_next_member", counted(warc._next_member))
    monkeypatch.setattr(warc, "_next_head", counted(warc._next_head))
    rng = np.random.default_rng(6)
    parts = [record(i, rng.integers(0, 256, 500, dtype=np.uint8).tobytes()) for i in range(800)]
    if member:
        parts = [gzip.compress(p) for p in parts]
    data = b"".join(p if i % 4 else p[:200] + b"?????" + p[205:] for i, p in enumerate(parts))
    items = list(warc.salvage(data))
    assert sum(x[0] == "record" for x in items) == 600 and sum(x[0] == "gap" for x in items) >= 200
    assert sum(looked) < 3 * len(data)


def test_added_columns_clash_with_none(spark):
    run = "\n".join("one two three four five six seven eight nine ten eleven twelve".split())
    long_ = " ".join(f"w{i}" for i in range(80))
    rows = [(1, run, "own", "r", "left", 0.25), (2, f"x\n{run}", "own", "r", "left", 0.25), (3, long_, "own", "r", "left", 0.25), (4, f"begin {long_} end", "own", "r", "left", 0.25)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Lines_Removed string, runs string, left string, toxicity double").withColumn("words_removed", F.lit("kept")).withColumn("cuts", F.lit(1))
    lines = L.line_dedup(docs)
    assert lines.columns == [*docs.columns, "lines_removed_"]
    assert {r["doc_id"]: (r["Lines_Removed"], r["lines_removed_"], r["runs"], r["left"]) for r in lines.collect()} == {i: ("own", 12 if i == 2 else 0, "r", "left") for i in range(1, 5)}
    assert L.line_dedup(docs, removed="gone").columns == [*docs.columns, "gone"]
    words = substring_dedup(docs)
    assert words.columns == [*docs.columns, "words_removed_"]
    assert {r["doc_id"]: (r["words_removed"], r["words_removed_"], r["cuts"]) for r in words.collect()} == {i: ("kept", 80 if i == 4 else 0, 1) for i in range(1, 5)}
    model = {"coef": None, "prior": 0.5, "words": {}, "stems": {}, "fuzzy": [], "plain": set(), "key": "clash"}
    scored = toxicity.toxicity(docs, model)
    assert scored.columns == [*docs.columns, "toxicity_"] and {(r["toxicity"], r["toxicity_"]) for r in scored.collect()} == {(0.25, 0.5)}
    assert toxicity.not_toxic(docs, model, 0.4).count() == 0 and toxicity.not_toxic(docs, model, 0.6).columns == docs.columns


@pytest.mark.parametrize("word", ["gr0bnik", "gro8nik", "grob*ik", "gr@bnik", "groobnik", "gobnik"])
def test_disguised_terms(word):
    model = {"coef": [0, 0, 0, 0], "prior": 0.1, "words": {"grobnik": 5.0}, "stems": {}, "fuzzy": ["grobnik"], "plain": set(), "key": f"disguise {word}"}
    lexicon = toxicity.lexicon_of(model)
    plain, clean, got = (toxicity.features(f"you are a {w}, friend", lexicon) for w in ("grobnik", "gardener", word))
    assert clean != got and plain != clean
