"""Quality classifier: supervised subword embeddings.

A document's features are its words, their character n-grams (three and four letters, with word edges) and pairs of neighbouring words
(so repetition is seen), each hashed to a row of a learned embedding table. Their mean goes through a linear layer and a softmax.
Both layers are trained by stochastic gradient descent in numpy, on the driver, from the whole texts of at most ``TRAINING_ROWS`` labelled rows.

With a softmax over two classes a feature adds one number to the logit, so scoring keeps one float per row of the table (256 kB),
and a word's part is looked up once per worker. Scoring covers whole texts.

Defined results: null and empty texts have no features, and the score of the learned offset; without both labels in training the score
is the share of good rows (0 without any); repeated rows are scored alike and count once in training, of rows that repeat an id the one with the least text and
the lesser label is learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folds import fold, training_rows
from .scratch import return_memory, table, worker_state

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
TRAINING_ROWS = 3_000
BUCKETS, DIM, EPOCHS, RATE = 1 << 16, 8, 3, 0.5
CACHED_WORDS, LONG = 200_000, 40  # words of more characters recur rarely and are not kept


def subwords(word: str) -> list[str]:
    """A word and its character n-grams. Case and punctuation stay: they tell quality."""
    w = f"<{word}>"
    n = len(w)
    return [w[i : i + 3] for i in range(n - 2)] + [w[i : i + 4] for i in range(n - 3)] + ["=" + word]


def row_of(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram) % BUCKETS


def rows_of(word: str) -> list[int]:
    return list(map(row_of, subwords(word)))


def shape(w: str) -> str:
    return ("U" if w.isupper() else "l" if w.islower() else "x") + ("a" if w[-1:].isalnum() else w[-1:])


def pair_row(a: str, b: str) -> int:
    """The row of two neighbouring words: whether they are equal, or alike in case and kind of last letter."""
    return xxhash.xxh3_64_intdigest("same pair" if a == b else f"{shape(a)} {shape(b)}") % BUCKETS


class Model:
    def __init__(self, part: np.ndarray, offset: float, prior: float):
        self.part, self.offset, self.prior = part, offset, prior
        self.key = xxhash.xxh3_64_intdigest(part.tobytes()) if len(part) else 0


def train(rows: list[tuple[str, int]], seed: int = 3) -> Model:
    prior = sum(y for _, y in rows) / len(rows) if rows else 0.0
    rows = sorted(set(rows))
    if len({y for _, y in rows}) < 2:
        return Model(np.zeros(0, np.float32), 0.0, prior)
    rng = np.random.default_rng(seed)
    table_ = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    known: dict[str, list[int]] = {}
    texts = [(t.split(), y) for t, y in rows]
    steps, done = EPOCHS * len(texts), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(texts)):
            words, y = texts[k]
            ids = [r for w in words for r in (known.get(w) or (known.setdefault(w, rows_of(w)) if len(w) <= LONG else rows_of(w)))] + [pair_row(a, b) for a, b in zip(words, words[1:])]
            rate = RATE * (1 - done / steps)
            done += 1
            ids_ = np.array(ids, np.int64)
            hidden = table_[ids_].mean(0) if len(ids) else np.zeros(DIM, np.float32)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * p
            if len(ids):
                rows_, counts = np.unique(ids_, return_counts=True)
                table_[rows_] -= (rate * counts / len(ids))[:, None] * back
    return Model((table_ @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), prior)


class _Grams(dict):
    """n-gram to its part; n-grams recur far more often than words."""

    def __init__(self, part: np.ndarray):
        self.part = part

    def __missing__(self, gram: str) -> float:
        out = float(self.part[row_of(gram)])
        if len(gram) <= 4 and len(self) <= CACHED_WORDS:
            self[gram] = out
        return out


class _Parts(dict):
    """Word to (sum of its rows' parts, how many rows, number of its shape), and what pairs of shapes add."""

    def __init__(self, part: np.ndarray):
        self.part, self.shapes, self.pairs, self.grams = part, {}, {}, _Grams(part)
        self.same = float(part[pair_row("a", "a")])

    def __missing__(self, word: str) -> tuple[float, int, int]:
        kind = self.shapes.setdefault(shape(word), len(self.shapes))
        if len(word) > LONG:  # summed without a list
            w, part = f"<{word}>", self.grams
            n = len(w)
            return sum(part[w[i : i + 3]] for i in range(n - 2)) + sum(part[w[i : i + 4]] for i in range(n - 3)) + part["=" + word], 2 * n - 4, kind
        grams = subwords(word)
        self[word] = out = (sum(map(self.grams.__getitem__, grams)), len(grams), kind)
        return out

    def pair(self, code: int) -> float:
        if code not in self.pairs:
            names = list(self.shapes)
            row = xxhash.xxh3_64_intdigest(f"{names[code >> 20]} {names[code & (1 << 20) - 1]}") % BUCKETS
            self.pairs[code] = float(self.part[row])
        return self.pairs[code]


def scorer(model: Model):
    if not len(model.part):
        return lambda text: float(model.prior)
    state = worker_state("quality")
    if state.get("quality key") != model.key:
        state["quality key"], state["quality parts"] = model.key, _Parts(model.part)
    parts = state["quality parts"]

    def score(text: str) -> float:
        if len(parts) > CACHED_WORDS:
            parts.clear()
        if len(parts.grams) > CACHED_WORDS:
            parts.grams.clear()
        words = text.split()
        total = model.offset
        if words:
            values, rows, kinds = zip(*map(parts.__getitem__, words))
            n = len(words) - 1
            value = sum(values)
            if n:
                equal = np.fromiter(map(eq, words, words[1:]), bool, n)
                k = np.array(kinds)
                codes, counts = np.unique((k[:-1] << 20 | k[1:])[~equal], return_counts=True)
                value += int(equal.sum()) * parts.same + sum(c * parts.pair(code) for code, c in zip(codes.tolist(), counts.tolist()))
            total += value / (sum(rows) + n)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    return score


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([judge(t.as_py() or "") for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Model:
    rows = training_rows(docs, labels, "quality", FOLDS, HELD_OUT, most)
    model = train(rows)
    del rows
    return_memory()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_score(model), f"doc_id {kind}, score double")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
