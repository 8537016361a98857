"""Toxicity scores from a learned lexicon (operator 4).

The lexicon is learned from labelled documents: whole words, and word beginnings of four to nine letters, that toxic
documents hold far more often than others.  Its whole words of at least five letters form a trie.  A word that is not in the lexicon is run as a Levenshtein automaton
through the trie: all terms within one edit, or two for terms of twelve letters and more, are found together, branches being left as soon as the
automaton has no live state.  Words that can't be within those edits, by their letters less one or by the thirds of a long term, are passed over.
Variants that clean labelled documents use are left out, so plain words near a term do not count.

Each hit is judged in a window of eight words to either side: inside quotation marks, or with a word of reporting and a
quotation mark nearby, it counts a quarter.  A logistic model on the hits' weight, as a share of all words and as a total, gives the score.

Learning reads at most ``max_training`` labelled documents, those with the least hash of doc_id.  Every term of the lexicon stands in at least one in 2,000
of them, so this bound also bounds what the driver holds and every task receives.  A document with labels of both kinds is toxic.  Labels are the only
thing read besides text, and doc_id decides only which rows may be learned from.  Scoring is row-wise, without a shuffle.

Null or empty texts get the model's score for no hits.  Repeated rows are scored each on its own; a null doc_id passes through
(and is held out: it has no remainder); other columns are ignored.  With no positive or no negative label all scores are the share of toxic labels, or 0.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import TEXT_ROWS, cut, free_names
from ._worker import memo, task

MAX_TRAINING = 20_000
THRESHOLD = 0.3
LEAST_DOCS, LEAST_SHARE = 3, 0.0005
LEAST_ODDS = 2.0
FUZZY_LETTERS, TWICE_LETTERS = 5, 12
STEMS = range(4, 10)
CONTEXT = 8
QUOTED = 0.25
FUZZY = 0.7
SLOT, HELD_OUT = 4, 2

#: A run of letters; a digit or two, or a symbol or two that can stand for a letter, between letters belong to the word, so that disguises are edits of it.
_WORD = re.compile(r"[^\W\d_]+(?:[\d@$!*+|€]{1,2}[^\W\d_]+)*")
_TOKEN = re.compile(r"\S+")
_OPEN, _CLOSE = set("\"“„«‹‘"), set("\"”“»›’")
#: Words of reporting (fixed values).
_REPORTING = frozenset("said says called calls quoted quote wrote writes claimed asked dit écrit sagte schrieb dijo escribió".split())


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % SLOT == HELD_OUT, F.lit(True))


class Trie:
    """A lexicon as nested dicts, searched by Levenshtein automata."""

    def __init__(self, terms: dict[str, float]):
        self.root: dict = {}
        for term, weight in terms.items():
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, weight)

    def near(self, word: str, most: int = 1) -> list[tuple[str, float, int]]:
        """(term, weight, edits) of all terms within ``most`` edits of the word.

        A state of the automaton is (letters read of the word, edits spent); a set of states is kept per trie node.
        """
        out, n = [], len(word)

        def close(states: dict[int, int]) -> dict[int, int]:
            for i in sorted(states):
                e = states[i]
                while i < n and e < most:
                    i, e = i + 1, e + 1
                    if states.get(i, most + 1) <= e:
                        break
                    states[i] = e
            return states

        stack = [(self.root, close({0: 0}))]
        while stack:
            node, states = stack.pop()
            for c, child in node.items():
                if c == "":
                    if n in states:
                        out.append((*child, states[n]))
                    continue
                after: dict[int, int] = {}
                for i, e in states.items():
                    if i < n and word[i] == c:
                        if after.get(i + 1, most + 1) > e:
                            after[i + 1] = e
                    if e < most:
                        if i < n and after.get(i + 1, most + 1) > e + 1:
                            after[i + 1] = e + 1
                        if after.get(i, most + 1) > e + 1:
                            after[i] = e + 1
                if after:
                    stack.append((child, close(after)))
        return out


def _shorter(words: set[str], most: int) -> set[str]:
    """The words less up to ``most`` letters."""
    out, last = set(words), words
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


class Lexicon(dict):
    """Weight of a word, memoised: the dict holds the words of late, ``old`` those before; of both together, at most ``most``."""

    def __init__(self, model: dict, most: int = 100_000):
        super().__init__()
        self.old: dict[str, float] = {}
        self.words, self.stems, self.plain, self.most = model["words"], model["stems"], model["plain"], most
        self.tries = []
        for edits, least in ((1, FUZZY_LETTERS), (2, TWICE_LETTERS)):
            terms = {w for w in model["fuzzy"] if len(w) >= least}
            lengths = {len(w) + d for w in terms for d in range(-edits, edits + 1)}
            self.tries.append((edits, Trie({w: self.words[w] for w in terms}), lengths))
            if edits == 1:
                self.shorter = _shorter(terms, 1)
            else:
                self.anchors = {t[len(t) * i // 3 :][:4] for t in terms for i in range(3)}
        self.trie = self.tries[0][1]

    def _gate(self, word: str, edits: int) -> bool:
        """Whether a term can be within the edits: for one, the two are the same less a letter each; two leave one of a long term's thirds whole."""
        if edits == 1:
            return not self.shorter.isdisjoint(_shorter({word}, 1))
        return any(word[i : i + 4] in self.anchors for i in range(len(word) - 3))

    def may_be_near(self, word: str) -> bool:
        return any(len(word) in lengths and self._gate(word, edits) for edits, _, lengths in self.tries)

    def near(self, word: str) -> list[tuple[str, float, int]]:
        """(term, weight, edits) of the terms that the word may be a misspelling of."""
        found = {}
        for edits, trie, lengths in self.tries:
            if len(word) in lengths and self._gate(word, edits):
                found |= {x[0]: x for x in trie.near(word, edits)}
        return list(found.values())

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most // 2:
            self.old = dict(self)
            self.clear()
        if word in self.old:
            self[word] = self.old[word]
            return self.old[word]
        weight = self.words.get(word, 0.0)
        if not weight:
            weight = max((self.stems.get(word[:k], 0.0) for k in STEMS if k <= len(word)), default=0.0)
        if not weight and word not in self.plain:
            weight = max((x * FUZZY**edits for _, x, edits in self.near(word)), default=0.0)
        self[word] = weight
        return weight


def lexicon_of(model: dict) -> Lexicon:
    """The model's lexicon and its memo, one per Python worker, until tasks of another operator use the worker."""
    lexicons = memo("op4")
    if model["key"] not in lexicons:
        lexicons.clear()
        lexicons[model["key"]] = Lexicon(model)
    return lexicons[model["key"]]


def _lower(text: str) -> str:
    """Lower case letter by letter, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[:1] for c in text)


def _texts(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    """The texts of an Arrow column, some at a time as Python strings."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def _spans(text: str) -> tuple[list[int], list[int]]:
    """Where the words between blanks start and end."""
    found = [m.span() for m in _TOKEN.finditer(text)]
    return [a for a, _ in found], [b for _, b in found]


def _quoted(text: str, start: int, stop: int, spans: tuple[list[int], list[int]] | None = None) -> bool:
    """Whether the hit at start:stop stands in quotation marks, or is reported, within its window of words."""
    starts, ends = spans or _spans(text)
    first, last = max(0, bisect_left(starts, start) - CONTEXT), bisect_right(ends, stop) + CONTEXT - 1
    before = text[starts[first] if first < len(starts) else start : start].split()
    after = text[stop : ends[min(last, len(ends) - 1)] if ends else stop].split()
    left, right = " ".join(before), " ".join(after)
    touches = text[max(0, start - 1) : start], text[stop : stop + 1]
    opened = any(c in _OPEN for c in left) or touches[0] in _OPEN and bool(touches[0])
    closed = any(c in _CLOSE for c in right)
    if not (opened or closed):
        return False
    marks = sum(c == '"' for c in left)
    inside = opened and closed and (marks % 2 == 1 or '"' not in left)
    return inside or any(w.lower().strip(":,") in _REPORTING for w in before)


def features(text: str, lexicon: Lexicon) -> tuple[float, float, float, float]:
    """Weight of hits per hundred words, log of their total, log of the number of different terms, and 1."""
    low = _lower(text)
    words = _WORD.findall(low)
    weights = [lexicon[w] for w in words]
    mass, kinds = 0.0, set()
    if any(weights):
        if any(c in _OPEN or c in _CLOSE for c in text):
            spans = _spans(text)
            for m in _WORD.finditer(low):
                x = lexicon[m.group()]
                if x:
                    mass += x * (QUOTED if _quoted(text, *m.span(), spans) else 1.0)
                    kinds.add(m.group())
        else:
            mass = float(sum(weights))
            kinds = {w for w, x in zip(words, weights, strict=True) if x}
    return 100.0 * mass / (len(words) + 20), float(np.log1p(mass)), float(np.log1p(len(kinds))), 1.0


def _term_counts(rows: DataFrame) -> DataFrame:
    """term, toxic, clean: the labelled documents of each kind that hold a word ("word$") or a word beginning."""

    @task("op4")
    def run(batches):
        toxic, clean = Counter(), Counter()

        def emit():
            terms = list(toxic.keys() | clean.keys())
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                own = set()
                for w in set(_WORD.findall(_lower(text or ""))):
                    own.add(w + "$")
                    own.update(w[:k] for k in STEMS if k <= len(w))
                (toxic if label else clean).update(own)
                if len(toxic) + len(clean) > 100_000:
                    yield emit()
                    toxic.clear()
                    clean.clear()
        yield emit()

    partial = rows.select("text", "toxic").mapInArrow(run, "term string, toxic bigint, clean bigint")
    return partial.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by damped Newton steps, on standardised columns (the last is constant)."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[-1] = 1.0
    z, b = x / scale, np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(y))
    penalty[-1] = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6), z.T @ (y - p) - penalty * b)
        b += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return b / scale


def learn(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> dict:
    """The lexicon and the model's coefficients, from labelled rows that are not held out."""
    marked = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = marked.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_training)
    rows = cut(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", F.col("toxic").cast("boolean").alias("toxic")), "op4-training")
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = total.get(True, 0), total.get(False, 0)
    model = {"key": uuid.uuid4().hex, "words": {}, "stems": {}, "fuzzy": [], "plain": set(), "coef": None, "prior": n_toxic / max(1, n_toxic + n_clean)}
    if not n_toxic or not n_clean:
        return model
    counts = cut(_term_counts(rows), "op4-terms", TEXT_ROWS)
    odds = F.log(((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1)))
    least = max(LEAST_DOCS, LEAST_SHARE * (n_toxic + n_clean))
    good = counts.withColumn("odds", odds).filter((F.col("toxic") >= least) & (F.col("odds") >= LEAST_ODDS) & (F.col("toxic") > F.col("clean")))

    def best(frame):
        return {r["term"].removesuffix("$"): r["odds"] for r in frame.select("term", "odds").collect()}

    model["words"] = best(good.filter("term like '%$'"))
    model["stems"] = best(good.filter("term not like '%$'"))
    long_ = [w for w in model["words"] if len(w) >= FUZZY_LETTERS]
    first = model | {"key": uuid.uuid4().hex, "fuzzy": long_}

    @task("op4")
    def nearby(batches):
        probe = lexicon_of(first)
        for batch in batches:
            words = [t[:-1] for t in batch.column(0).to_pylist()]
            near = [w for w in words if any(term != w for term, _, _ in probe.near(w))]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], names=["word"])

    used = counts.filter("term like '%$' and clean >= 1 and clean * 4 >= toxic")
    beside = used.select("term").mapInArrow(nearby, "word string").collect()
    model["fuzzy"] = long_
    model["plain"] = {r["word"] for r in beside} - model["words"].keys()

    @task("op4")
    def measure(batches):
        lexicon = lexicon_of(model)
        for batch in batches:
            x = [features(t or "", lexicon) for t in _texts(batch.column(0))]
            columns = [pa.array(c, pa.float64()) for c in zip(*x, strict=True)] if x else [pa.array([], pa.float64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns], names=["toxic", "a", "b", "c", "d"])

    table = rows.select("text", "toxic").mapInArrow(measure, "toxic boolean, a double, b double, c double, d double").toPandas()
    model["coef"] = fit(table[["a", "b", "c", "d"]].to_numpy(), table["toxic"].to_numpy().astype(float)).tolist()
    return model


def scorer(model: dict):
    """A column function: the score of a text column, 0 to 1."""

    @task("op4")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = lexicon_of(model)
        for part in texts:
            if model["coef"] is None:
                yield pa.array(np.full(len(part), float(model["prior"])))
                continue
            x = np.array([features(t or "", lexicon) for t in _texts(part)]).reshape(-1, 4)
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ np.array(model["coef"]), -30, 30))))

    return F.arrow_udf(run, "double")


def toxicity(docs: DataFrame, model: dict, score: str = "toxicity") -> DataFrame:
    """The rows of docs with ``score``, that of their text; where docs has a column of that name, the score's gets underscores behind it."""
    return docs.withColumn(free_names(docs, score)[0], scorer(model)(F.col("text").cast("string")))


def not_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is under the threshold."""
    return docs.filter(scorer(model)(F.col("text").cast("string")) < threshold)
