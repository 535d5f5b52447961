"""Best-fit packing by minimum bin slack.

Tokens are counted where the texts are; only (document, piece, length) rows travel. How many pieces have each length is at most
``capacity`` numbers, so bins are planned on the driver from that histogram: the longest piece left opens a bin, a subset-sum over
the lengths left (a bitset in one integer) finds the fullest completion, and the combination is taken as often as its lengths last.
A piece's number among the pieces of its length then says which bin it goes to. Numbers come from counters in each tokenizing task
and the tasks' totals, so no length is gathered in one task, however many pieces share it.

Defined results: a null text is an empty one and has the closing id alone; repeated rows are packed as often as they occur; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import keep, table, worker_state

CAPACITY = 2048
CACHED_WORDS = 200_000
#: Non-ASCII texts with other characters go through the tokenizer whole: what is a letter there depends on the Unicode version.
STEADY = "[^\x00-\u024f\u0370-\u03ff\u0400-\u04ff\u2000-\u206f\u20a0-\u20bf]"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Known(dict):
    """Pre-token to the bytes of its ids, computed when first asked for."""

    def __init__(self, one):
        self.one = one

    def __missing__(self, word: str) -> bytes:
        ids = self.one(word.encode("utf-8"))
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level BPE files name bytes: printable Latin-1 ones name themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes. Byte-level BPE never joins across pre-tokens, so the ids of each are kept.

    A pre-token's ids come from merging by rank, which is what the file's merges say if its ids follow their order; files of
    another kind, special tokens in a text and unusual characters are left to the tokenizer itself.
    """

    def __init__(self, path: str):
        import regex
        import public_tokenizers
        import tiktoken

        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre = file["model"], file.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in file["added_tokens"]]
        self.known = None
        plain = (model["type"], pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex"), file.get("normalizer"), file.get("post_processor")) == ("BPE", "ByteLevel", False, True, None, None)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        if plain and all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)):
            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in k): i for k, i in model["vocab"].items() if k not in self.special}
            self.split = regex.compile(public_tokenizers.PATTERN).findall
            self.odd = re.compile(STEADY).search
            self.known = _Known(tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece)

    def __call__(self, text: str) -> bytes:
        if self.known is None or any(s in text for s in self.special) or not text.isascii() and self.odd(text):
            if self.tokenizer is None:
                from tokenizers import Tokenizer

                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                self.tokenizer = Tokenizer.from_file(self.path)
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.split(text)))


def encoder(path: str) -> Encoder:
    """This worker's encoder of ``path``; it outlasts the task."""
    state = worker_state("packing")
    if ("encoder", path) not in state:
        state["encoder", path] = Encoder(path)
    return state["encoder", path]


def _pieces(path: str, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(path), [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + b"\0\0\0\0"
                n, start = len(ids) // 4, 0
                length = n % capacity or capacity
                piece = 0
                while start < n:
                    rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
                    start, length, piece = start + length, capacity, piece + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the multiset ``counts`` (length to how many), the combination with the largest sum of at most ``room``; long lengths are tried first."""
    reach, steps, goal, mask = 1, [], 1 << room, (1 << room + 1) - 1
    for length in sorted(counts, reverse=True):
        many = min(counts[length], room // length)
        take = 1
        while many > 0:
            take = min(take, many)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            many -= take
            take *= 2
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins as (combination, how many bins have it), by minimum bin slack."""
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        first = max(left)
        rest = left | {first: left[first] - 1}
        pattern = fullest({k: v for k, v in rest.items() if v and k <= capacity - first}, capacity - first)
        pattern[first] = pattern.get(first, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        plan.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first bin, pieces of the length in a bin, offset of the first of them), by rank."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    bins = 0
    for pattern, times in plan:
        at = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            out.setdefault(length, []).append((used.get(length, 0), bins, n, at))
            used[length] = used.get(length, 0) + n * times
            at += n * length
        bins += times
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def _assign(places: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, rank = t["length"].to_numpy(), t["rank"].to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else ():
                l, r = int(length[rows[0]]), rank[rows]
                p = places[l]
                k = np.searchsorted(p[:, 0], r, side="right") - 1
                within = r - p[k, 0]
                seq[rows] = p[k, 1] + within // p[k, 2]
                off[rows] = p[k, 3] + within % p[k, 2] * l
            t = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
            yield from t.to_batches()

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cols = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
    pieces = keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity), cols), "pieces")
    per = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    per = keep(per, "lengths")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    ranked = pieces.join(offsets, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(_assign(_places(plan_bins(counts, capacity))), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
