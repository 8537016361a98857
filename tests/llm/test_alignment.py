"""Cross-tokenizer alignment against a walk over both token lists."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import queries
from paperloom.llm import token_alignment as T

SF = "/root/testdata/sf0.001"
PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN
ODD = [
    (9001, None), (9002, ""), (9003, " "), (9004, "<|endoftext|> <s> </s> <unk>"), (9005, "▁a b"), (9006, "a\x00b"), (9007, "é漢字🙂 x  y\n\n z"), (9008, "wörd ß " * 30_000),
    (None, "x y"), (9009, "same words"), (9009, "same words"), (9010, "▁"), (9011, "x" * 5000),
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def brute(text, libraries):
    """A ids, B ids, links and groups by walking both token lists side by side."""
    a, b = libraries
    if not text:
        return [], [], [], []
    letters, names = T.byte_alphabet(), {v: k for k, v in a.get_vocab().items()}
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spelt = (
        [bytes(letters[c] for c in names[i]) for i in ids[0]],
        [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]],
    )
    if any(b"".join(s) != (" " + text).encode() for s in spelt):
        return [], [], [], []
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelt]
    links, groups, i, j, own = [], [], 0, 0, ([], [])
    while i < len(ids[0]):
        links.append((ids[0][i], ids[1][j]))
        for side, k in ((0, i), (1, j)):
            if k not in own[side]:
                own[side].append(k)
        x, y = ends[0][i], ends[1][j]
        if x == y:
            groups.append(own)
            own = ([], [])
        i, j = i + (x <= y), j + (y <= x)
    written = ";".join("|".join(",".join(str(ids[side][k]) for k in g[side]) for side in (0, 1)) for g in groups)
    return *ids, links, (len(groups), hashlib.sha256(written.encode()).hexdigest())


def expected(rows, libraries):
    done = [(i, *brute(t, libraries)) for i, t in rows]
    held = Counter(p for *_, links, _ in done for p in set(links))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(n, most.get(a, 0))
    return sorted(
        (str(i), len(a), len(b), *(g or (0, "")), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links)) for i, a, b, links, g in done
    )


def test_query_equals_walk(spark, libraries, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id bigint, text string"))
    docs.withColumn("n_links", F.lit("own")).withColumn("pairs", F.lit(1)).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_token_alignment(spark, str(tmp_path)).collect()
    names = ["n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]
    assert sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in got) == expected([(r["doc_id"], r["text"]) for r in docs.collect()], libraries)


def test_many_small_blocks(spark, libraries, monkeypatch):
    """A block a document, and owner arrays shorter than tokens."""
    monkeypatch.setattr(T, "BLOCK_PAIRS", 1)
    rows = [(i, t) for i, t in enumerate(["a b c", "a b", "b a c", None, "a b c"] * 5)]
    aligned = T.align(spark.createDataFrame(rows, "doc_id bigint, text string"), *PATHS).withColumn("h", F.coalesce(F.sha2("groups", 256), F.lit("")))
    got = T.rate_links(aligned.select("doc_id", "n_a", "n_b", "n_groups", "h", "pairs")).collect()
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == expected(rows, libraries)


def test_rows_of_blocks_are_small(spark, libraries, monkeypatch):
    """A block of many documents lies in rows of bounded size, whose pairs may need two bytes for their numbers."""
    monkeypatch.setattr(T, "ROW_PAIRS", 64, raising=False)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{x:x}" for x in rng.integers(0, 5000, 15)) if i % 9 else None) for i in range(120)]
    aligned = T.align(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), *PATHS).withColumn("h", F.coalesce(F.sha2("groups", 256), F.lit("")))
    aligned = aligned.select("doc_id", "n_a", "n_b", "n_groups", "h", "pairs")
    packed = T._pack_blocks(aligned, ["doc_id"]).collect()
    assert len({r["block"] for r in packed}) == 1 and sum(len(r["keys"]) > 0 for r in packed) == 1 and max(len(r["keys"]) for r in packed) > 256
    assert sum(len(r["rows"]) for r in packed) == 120 and all(len(r["rows"]) == 1 or len(r["pair"]) <= 64 * 2 for r in packed)
    assert sorted((str(r["doc_id"]), *r[1:]) for r in T.rate_links(aligned).collect()) == expected(rows, libraries)


def test_owner_windows():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        cuts = [np.append(np.flatnonzero(rng.random(n - 1) < 0.4) + 1, n) for _ in range(2)]
        whole = T.overlaps(*cuts)
        for window in (1, 3, 7):
            assert all(np.array_equal(x, y) for x, y in zip(whole, T.overlaps(*cuts, window=window), strict=True))
        owner = [np.repeat(np.arange(len(c)), np.diff(c, prepend=0)) for c in cuts]
        assert set(zip(*(x.tolist() for x in whole[:2]), strict=True)) == set(zip(*(o.tolist() for o in owner), strict=True))
        assert len(whole[2]) == len(set(cuts[0]) & set(cuts[1]))


def test_spans(spark):
    r = T.align(spark.createDataFrame([(1, "é漢字 xy")], "doc_id bigint, text string"), *PATHS, spans=True).first()
    groups = [",".join(map(str, r["a_ids"][i:j])) + "|" + ",".join(map(str, r["b_ids"][k:m])) for i, j, k, m in zip(r["a_cuts"], r["a_cuts"][1:] + [r["n_a"]], r["b_cuts"], r["b_cuts"][1:] + [r["n_b"]], strict=True)]
    assert ";".join(groups) == r["groups"] and len(groups) == r["n_groups"]
    assert Counter((r["a_ids"][i], r["b_ids"][j]) for i, j in zip(r["link_a"], r["link_b"], strict=True)) == {(p["a"], p["b"]): p["times"] for p in r["pairs"]}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert T.rate_links(T.align(docs, *PATHS).drop("groups")).count() == 0


def test_merges_in_another_order_go_to_the_library(tmp_path, libraries):
    """Where ids aren't ranks, the ids are still the library's."""
    import json

    with open(PATHS[0], encoding="utf-8") as f:
        stated = json.load(f)
    vocab = stated["model"]["vocab"]
    last = [t for t, i in vocab.items() if i in (50_254, 50_255)]
    vocab[last[0]], vocab[last[1]] = vocab[last[1]], vocab[last[0]]
    (tmp_path / "other.json").write_text(json.dumps(stated), encoding="utf-8")
    texts = [" the rest of it, é漢字", " " + last[0].replace("Ġ", " "), " <|endoftext|>"]
    own, library = T.ByteLevel(str(tmp_path / "other.json"), P.PATTERN), Tokenizer.from_file(str(tmp_path / "other.json"))
    library.encode_special_tokens = True
    assert own.encode(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert T.ByteLevel(PATHS[0], P.PATTERN).encode(texts) == [libraries[0].encode(t, add_special_tokens=False).ids for t in texts]
