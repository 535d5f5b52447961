"""Toxicity by compression distance: two zstandard dictionaries, one trained on ordinary and one on toxic text.

Texts are read through sliding windows of ``WORDS`` words, one every ``STEP`` words, so neighbours overlap. A window is compressed twice, with the ordinary dictionary alone and
with the toxic one before it, and the bytes that it gains say what toxic text alone predicts. (Both hold the ordinary dictionary,
so the ordinary part of a window costs the same in both; and a fixed closing follows every window, as zstandard looks for no match in a block's last bytes.)

Most windows of a toxic document are ordinary. So the toxic dictionary is trained in rounds: on all windows of the toxic training documents first, then
on those that gain more than ordinary windows do. Toxic training documents are halved, and the windows of a half are only ever judged by the dictionary of the
other one, as a dictionary explains the very texts that it was trained on. Windows that occur more than once (copies) count once.

A document is scored by how many of its windows gain at least 1, 2, ... ``MOST`` bytes, and by their share of all; thresholds and weights are
calibrated by logistic regression on the training documents, each judged by a dictionary that hasn't seen it.

The model is fitted on the driver from at most ``TRAINING_ROWS`` labelled rows, and is some 110 kB. Scoring covers whole texts.

Defined results: null and empty texts have no windows and the score of such a document; texts of fewer than ``WORDS`` words are one window; without both
labels twice in training the score is the share of toxic rows (0 without any); repeated rows are scored alike and count once in training, of rows that repeat an id
the one with the least text and the lesser label is learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folds import fold, logistic, training_rows
from .scratch import return_memory, table, worker_state

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
TRAINING_ROWS = 5_000
WORDS, STEP = 5, 4
ORDINARY_BYTES, TOXIC_BYTES = 100_000, 8_000
SEGMENT, PART = 16, 6  # of dictionary training: bytes of what is taken over, and of what is counted
ROUNDS, TIMES = 2, 10  # a toxic window is trained on again if it gains what ordinary ones gain TIMES more seldom
MOST = 12
CLOSING = b"\x02closing\x03"


def windows(text: str, words: int = WORDS, step: int = STEP) -> Iterator[bytes]:
    """The windows of a text: ``words`` lower-cased words each, one every ``step`` words, the last one up to the end."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    for i in range(0, max(1, len(w) - words + step) if w else 0, step):
        yield b" %b " % b" ".join(w[i : i + words])


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary of at most ``size`` bytes that zstandard trains on ``samples``."""
    import zstandard as z

    try:
        return z.train_dictionary(size + 4000, samples, k=SEGMENT, d=PART).as_bytes()[-size:]
    except z.ZstdError:  # too little text to train on: all of it
        return b"".join(samples)[-size:]


def compressed(dictionary: bytes) -> Callable[[bytes], int]:
    """A function from a window to its compressed length."""
    import zstandard as z

    params = z.ZstdCompressionParameters(window_log=18, hash_log=15, chain_log=15, search_log=5, min_match=4, target_length=64, strategy=z.STRATEGY_BTLAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
    d = z.ZstdCompressionDict(dictionary + CLOSING, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    compress = z.ZstdCompressor(dict_data=d, compression_params=params).compress
    return lambda window: len(compress(window + CLOSING))


def features(text: str, plain: Callable[[bytes], int], marked: Callable[[bytes], int]) -> np.ndarray:
    """Of the text's windows how many gain 1 to ``MOST`` bytes or more, and their shares."""
    gains = np.fromiter((plain(w) - marked(w) for w in windows(text)), np.int64)
    up = np.bincount(np.clip(gains, 0, MOST), minlength=MOST + 1)[::-1].cumsum()[::-1][1:]
    return np.r_[np.log1p(up), math.log1p(len(gains)), up / (len(gains) + 1)]


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray, prior: float):
        self.ordinary, self.toxic, self.weights, self.mean, self.spread, self.prior = ordinary, toxic, weights, mean, spread, prior
        self.key = xxhash.xxh3_64_intdigest(ordinary + b"\0" + toxic)


def gaining(samples: list[bytes], ordinary: list[bytes], plain: Callable[[bytes], int], marked: Callable[[bytes], int]) -> list[bytes]:
    """Those of ``samples`` whose gain is one that ordinary windows have ``TIMES`` more seldom."""
    gains, usual = (np.array([plain(w) - marked(w) for w in x]) for x in (samples, ordinary))
    least = next((k for k in range(1, MOST) if (gains >= k).mean() >= TIMES * (usual >= k).mean()), MOST)
    return [w for w, g in zip(samples, gains) if g >= least]


def train(rows: list[tuple[str, int]], seed: int = 7) -> Model:
    prior = sum(y for _, y in rows) / len(rows) if rows else 0.0
    rows = sorted(set(rows))
    rng = random.Random(seed)
    rng.shuffle(rows)
    toxic, ordinary = ([t for t, y in rows if y == k] for k in (1, 0))
    if len(toxic) < 2 or len(ordinary) < 2:
        return Model(b"", b"", np.zeros(0), np.zeros(0), np.ones(0), prior)
    base = trained(sorted({w for t in ordinary for w in windows(t, WORDS + 1, WORDS + 1)}), ORDINARY_BYTES)
    plain = compressed(base)
    halves = [toxic[::2], toxic[1::2]]
    chosen = [sorted({w for t in half for w in windows(t, WORDS + 1, WORDS + 1)}) for half in halves]
    usual = sorted({w for t in ordinary[:300] for w in windows(t)})
    for _ in range(ROUNDS):
        marked = [compressed(trained(c, TOXIC_BYTES) + base) for c in chosen]
        found = [gaining(sorted({w for t in half for w in windows(t)}), usual, plain, other) for half, other in zip(halves, marked[::-1])]
        chosen = [f or c for f, c in zip(found, chosen)]
    marked = [compressed(trained(c, TOXIC_BYTES) + base) for c in chosen]
    x = [features(t, plain, other) for half, other in zip(halves, marked[::-1]) for t in half] + [features(t, plain, marked[i % 2]) for i, t in enumerate(ordinary)]
    y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
    x = np.array(x)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    return Model(base, trained(sorted({w for c in chosen for w in c}), TOXIC_BYTES), logistic((x - mean) / spread, y), mean, spread, prior)


def scorer(model: Model):
    """A function from a text to its score; the compressors live as long as the worker."""
    if not len(model.weights):
        return lambda text: float(model.prior)
    state = worker_state("toxicity")
    if state.get("toxic key") != model.key:
        state["toxic key"], state["toxic lengths"] = model.key, (compressed(model.ordinary), compressed(model.toxic + model.ordinary))
    plain, marked = state["toxic lengths"]
    scale, offset = model.weights[:-1] / model.spread, model.weights[-1] - float(model.mean @ (model.weights[:-1] / model.spread))
    return lambda text: 1 / (1 + math.exp(-max(-30.0, min(30.0, float(features(text, plain, marked) @ scale) + offset))))


def _score(model: Model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            scores = pa.array([score(t.as_py() or "") for t in batch.column(text_at)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Model:
    rows = training_rows(docs, labels, "toxic", FOLDS, HELD_OUT, most)
    model = train(rows)
    del rows
    return_memory()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_score(model, 1), f"doc_id {kind}, score double")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns kept. Rows are judged where they are read."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py() or "") < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
