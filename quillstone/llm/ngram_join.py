"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes. Cutting it into fragments cuts every document's set into segments, one per
fragment. That serves twice:

* Candidates. Two sets of Jaccard likeness t or more differ in at most D = (|x| + |y|) (1 - t) / (1 + t) n-grams. Cut into F > D
  fragments, at least c = F - D segments are the same in both. A set's signatures are the hashes of its filled segments, ordered by how many
  sets have them. As a pair shares c segments (less the empty ones), each set may leave out its c - 1 (less its empty segments) commonest
  signatures and the pair still meets in one: passages that very many documents share make none. Two sets with more than c - 1 empty segments each may
  share no filled one; such sets (short ones) meet by their rarest single n-grams as well, of which all but the t |x| - 1 commonest are
  signatures. No signature is free of content. Sets meet in classes by size, each with its own fragments; a set takes part in every class
  that a partner's size can belong to.
* Verification. The overlap of a candidate pair is counted fragment by fragment and summed per pair.

Documents with equal sets are one node from the start. Up to ``SMALL`` nodes with a common signature are paired directly. Among more one
is the pivot, chosen by the signature so that a group of near copies with several signatures has several pivots and no outlier is the pivot of all: only pairs
with it are counted first. Signatures whose nodes are then in one component need no further pair. For the others the nodes outside
the pivot's component are paired with all nodes of other components, and yet every link between different components is found: component ids
are exact. This goes in slices of the signatures, each with the labels that the slice before has left. Of all these pairs each node's likeliest by
the sketches is counted first, then each component's, the others only if that leaves them in different components; so a group of n near copies costs about n counted pairs and not n * n.

Before a pair is counted, a parity sketch bounds its difference from below: 1024 bits, each the parity of the n-grams hashed to it. Two
sketches never differ in more bits than the sets differ in n-grams, so what this bound rejects is no link.

Texts are read twice: for signatures, and for the segments of those sets that share one. Signatures are counted before they are joined, so a
signature that a third of all documents share is a partial sum in every task, and the joins on signatures, nodes and labels meet written tables,
which adaptive execution splits where a key is large. Tables and shuffle files are deleted when what follows them is written.

Defined results: words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return, A-Z lower-cased;
a document of fewer than n words has its whole sequence as one n-gram; one without words (or null text) has an empty set, is linked
with nothing and is its own component; an empty table gives an empty result; repeated rows are linked to each other; rows without an id take
part in links, and a component of such rows only has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import discard, free_shuffles, keep, table, worker_state

FRAGMENT_BITS = 2  # of the verification: 4 fragments
CACHED_WORDS = 120_000
CLASS_RATIO = 1.5
BROADCAST_IDS = 500_000  # rows of two numbers
SKETCH = 16  # 64-bit words
PARTS = 4  # of the signatures, counted one after the other
SMALL = 4  # nodes of a signature that are paired without a pivot
SLICES = ((0, 4), (4, 64))  # of 64: the signatures of mixed groups that are paired in each round
DROP_BITS = 24  # a rule is a class and, in its low bits, how many of the commonest signatures go
U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased words of ``text``."""
    known = worker_state("words").setdefault("word hashes", _Hashes())
    if len(known) > CACHED_WORDS:
        known.clear()
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct hashes of the ``width``-word shingles of a text."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    s = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(len(h), width)):
        s = s * U(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mix64(s))


def most_different(total: int, t: Fraction) -> int:
    """How many n-grams two sets of together ``total`` can have in one of them only, at likeness ``t``."""
    return int(total * (1 - t) / (1 + t))


def size_classes(size: int, t: Fraction) -> list[tuple[int, int, int]]:
    """(class, allowed differences, fragments) for each class that a set of this size takes part in; a pair meets in the larger one's class."""
    out, low, k = [], 2, 0
    while low <= size / t:
        high = max(low + 1, int(low * CLASS_RATIO))  # sizes low .. high - 1
        if size < high:
            differ = most_different(2 * (high - 1), t)
            if differ:
                out.append((k, differ, differ + 4 + differ // 6))
        low, k = high, k + 1
    return out


def signatures(s: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set in all classes of its size, and the rule of each: its class and how many of the class's commonest go."""
    out, rules = [np.empty(0, np.uint64)], [np.empty(0, np.int32)]

    def add(sigs: np.ndarray, code: int, drop: int) -> None:
        out.append(sigs)
        rules.append(np.full(len(sigs), code << DROP_BITS | min(drop, (1 << DROP_BITS) - 1), np.int32))

    for k, differ, fragments in size_classes(len(s), t):
        of = (s >> U(32)) * U(fragments) >> U(32)
        starts = np.flatnonzero(np.diff(of, prepend=U(1 << 63)))
        seal = np.array([(k * 1_000_003 + 1) * 0x9E3779B97F4A7C15 % (1 << 64)], np.uint64)
        empty = fragments - len(starts)
        add(mix64(np.add.reduceat(s * U(0xD6E8FEB86659FD93), starts) ^ mix64(of[starts] + seal)), 2 * k, max(0, fragments - differ - 1 - empty))
        if empty >= fragments - differ:
            add(mix64(s ^ mix64(seal + U(77))), 2 * k + 1, -(-len(s) * t.numerator // t.denominator) - 1)
    return np.concatenate(out), np.concatenate(rules)


def sketch(s: np.ndarray) -> list[int]:
    odd = np.bincount((s >> U(20) & U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).tolist()


def _sets(width: int, t: Fraction):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sigs", pa.list_(pa.int64())), ("rules", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(text.as_py() or "", width)
                if not len(s):
                    rows.append((doc, 0, None, None, None))
                    continue
                node, sigs, rules = node_of(s), None, None
                if node not in seen:  # copies within a task send their signatures once
                    sigs, rules = signatures(s, t)
                    sigs = sigs.view(np.int64)
                    if len(seen) < 1_000_000:
                        seen.add(node)
                rows.append((doc, len(s), node, sigs, rules))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)

    return run


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _segments(width: int):
    """Of each set a row with its sketch (fragment -1) and a row for each segment."""
    schema = pa.schema([("node", pa.int64()), ("fragment", pa.int32()), ("n", pa.int64()), ("grams", pa.list_(pa.int64())), *((f"k{i}", pa.int64()) for i in range(SKETCH))])
    none = [None] * SKETCH

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(text.as_py() or "", width)
                if not len(s) or node_of(s) != node:  # another row of the same id
                    continue
                cuts = np.searchsorted(s >> U(64 - FRAGMENT_BITS), np.arange((1 << FRAGMENT_BITS) + 1, dtype=np.uint64))
                rows.append((node, -1, len(s), None, *sketch(s)))
                rows += [(node, f, len(s), s[a:b].view(np.int64), *none) for f, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                if len(rows) > 5_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    return run


def few(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` marked for broadcast if their number, which is counted, is small."""
    return F.broadcast(ids) if ids.count() <= most else ids


def linked(pairs: DataFrame, segments: DataFrame, t: Fraction) -> DataFrame:
    """Those of the distinct node pairs (a, b, na, nb), a written table, whose likeness is ``t`` or more. Of few pairs only the segments of their nodes are shuffled."""
    filled = segments.filter("fragment >= 0")
    pairs = few(pairs.select("a", "b", "na", "nb"))
    left = filled.withColumnRenamed("node", "a").join(pairs, "a").select("a", "b", "na", "nb", "fragment", F.col("grams").alias("ga"))
    right = filled.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("gb")).join(pairs.select("b"), "b", "left_semi")
    both = left.join(right, ["b", "fragment"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("partial"))
    overlap = partial.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("overlap"))
    # overlap / (na + nb - overlap) >= t
    return overlap.filter(F.col("overlap") * (t.numerator + t.denominator) >= (F.col("na") + F.col("nb")) * t.numerator).select("a", "b")


def difference(a: list[Column], b: list[Column]) -> Column:
    """In how many bits two sketches differ."""
    return reduce(add, (F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)))


def plausible(na: Column, nb: Column, differ: Column, t: Fraction) -> Column:
    """Whether sizes and sketches allow a likeness of ``t``: false for no pair that has it."""
    return (F.least(na, nb) * t.denominator >= F.greatest(na, nb) * t.numerator) & (differ * (t.denominator + t.numerator) <= (na + nb) * (t.denominator - t.numerator))


def near_pairs(pairs: DataFrame, sketches: DataFrame, t: Fraction) -> DataFrame:
    """Of the pairs (a, b) those whose sizes and sketches allow a likeness of ``t``, as (a, b, na, nb, far), far being the sketches' share of differences."""
    words = [f"k{i}" for i in range(SKETCH)]
    one, two = (sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), *(F.col(k).alias(f"{x}_{k}") for k in words)) for x in "ab")
    differ = difference(*([F.col(f"{x}_{k}") for k in words] for x in "ab"))
    both = pairs.join(one, "a").join(two, "b").filter(plausible(F.col("na"), F.col("nb"), differ, t))
    return both.select("a", "b", "na", "nb", (differ / (F.col("na") + F.col("nb"))).alias("far"))


def small_pairs(shared: DataFrame) -> DataFrame:
    """All pairs of the nodes of each signature that at most ``SMALL`` nodes have, as (a, b) with a < b."""
    groups = shared.filter(F.col("m") <= SMALL).groupBy("sig").agg(F.array_sort(F.collect_list("node")).alias("g"))
    after = lambda g, i: F.slice(g, i + 2, F.size(g))
    pairs = F.flatten(F.transform("g", lambda x, i: F.transform(after(F.col("g"), i), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return groups.select(F.inline(pairs))


def meetings(made: DataFrame) -> DataFrame:
    """(sig, node, pivot, m): the nodes that share a signature, after each has left out its commonest ones; the pivot is one of the m nodes, another one for each signature."""
    # copies in different tasks have all sent their signatures: one row of a node stays
    rows = made.filter("sigs is not null")
    twice = rows.groupBy("node").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    spare = keep(rows.select("node", "row").join(twice, "node").filter("row <> first").select("row"), "spare")
    sigs = rows.join(few(spare), "row", "left_anti").select("node", F.explode(F.arrays_zip("sigs", "rules")).alias("x")).select(F.col("x.sigs").alias("sig"), "node", F.col("x.rules").alias("rule"))
    # a part of the signatures after the other, so that no more than that part is ever in shuffle files
    repeated = []
    for k in range(PARTS):
        part = sigs.filter(F.pmod("sig", F.lit(PARTS)) == k)
        counts = keep(part.groupBy("sig").agg(F.count(F.lit(1)).cast("int").alias("m")).filter("m > 1"), "counts")
        free_shuffles(made.sparkSession)
        repeated.append(keep(part.join(counts.hint("shuffle_hash"), "sig").select("node", "rule", "m", "sig"), "repeated"))
        discard(counts)
        free_shuffles(made.sparkSession)
    lists = reduce(DataFrame.unionByName, repeated).groupBy("node", "rule").agg(F.sort_array(F.collect_list(F.struct("m", "sig")), asc=False).alias("x"))
    drop = F.col("rule").bitwiseAND((1 << DROP_BITS) - 1)
    rest = keep(lists.filter(F.size("x") > drop).select("node", F.explode(F.slice("x", drop + 1, F.size("x"))).alias("x")).select("x.sig", "node"), "rest")
    for df in repeated:
        discard(df)
    free_shuffles(made.sparkSession)
    pivot = F.min(F.col("node").bitwiseXOR(F.col("sig"))).bitwiseXOR(F.col("sig"))
    groups = keep(rest.groupBy("sig").agg(pivot.alias("pivot"), F.count(F.lit(1)).alias("m")).filter("m > 1"), "groups")
    out = keep(rest.join(groups, "sig"), "shared")
    for df in (spare, rest, groups):
        discard(df)
    return out


def join_components(docs: DataFrame, width: int = 5, t: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = [f"k{i}" for i in range(SKETCH)]
    made = docs.mapInArrow(_sets(width, t), "doc_id long, n_shingles long, node long, sigs array<long>, rules array<int>")
    made = keep(made.withColumn("row", F.monotonically_increasing_id()), "made")
    sets = keep(made.select("doc_id", "n_shingles", "node"), "sets")
    shared = meetings(made)
    discard(made)

    # the segments of all sets that can be in a pair, from one more pass over the texts
    reps = keep(sets.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("__doc")), "reps")
    texts = docs.join(few(reps), F.col("doc_id").eqNullSafe(F.col("__doc")))
    kinds = "node long, fragment int, n long, grams array<long>, " + ", ".join(f"{k} long" for k in words)
    segments = texts.select("node", "text").mapInArrow(_segments(width), kinds)
    segments = keep(segments.dropDuplicates(["node", "fragment"]), "segments")  # rows that repeat an id gave a set twice
    sketches = segments.filter("fragment = -1").select("node", "n", *words)
    discard(reps)
    free_shuffles(spark)

    large = shared.filter(F.col("m") > SMALL)
    pivots = large.filter("node <> pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
    pairs = keep(near_pairs(small_pairs(shared).union(pivots).distinct(), sketches, t), "pairs")
    links, found = nearest_first(None, None, pairs, segments, t)
    seen = [pairs]

    # what the pivots leave of the large groups: nodes of one signature in different components
    for low, high in SLICES:
        slice_ = large.filter(F.pmod("sig", F.lit(64)).between(low, high - 1)).drop("m")
        placed = slice_.join(few(found), "node", "left").withColumn("label", F.coalesce("label", "node"))
        placed = keep(placed, "placed")
        mixed = keep(placed.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("sig"), "sigs")
        placed_ = placed.join(few(mixed), "sig", "left_semi")
        placed_ = placed_.join(few(found).select(F.col("node").alias("pivot"), F.col("label").alias("major")), "pivot", "left").withColumn("major", F.coalesce("major", "pivot")).drop("pivot")
        placed_ = keep(placed_.join(sketches, "node"), "mixed")
        minor = placed_.filter("label <> major")
        other = placed_.select("sig", *(F.col(c).alias(f"{c}_") for c in ("node", "n", "label", "major", *words)))
        once = (F.col("label_") == F.col("major_")) | (F.col("node") < F.col("node_"))
        # sizes and sketches are a condition of the join: what they refute is never a row
        differ = difference(*([F.col(k + x) for k in words] for x in ("", "_")))
        met = minor.join(other, (minor["sig"] == other["sig"]) & (F.col("label") != F.col("label_")) & once & plausible(F.col("n"), F.col("n_"), differ, t))
        first = F.col("node") < F.col("node_")
        ends = (F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("node", "node_", "a"), ("node_", "node", "b"), ("n", "n_", "na"), ("n_", "n", "nb")))
        met = met.select(*ends, (differ / (F.col("n") + F.col("n_"))).alias("far")).distinct()
        seen.append(keep(met.join(reduce(DataFrame.union, (x.select("a", "b") for x in seen)), ["a", "b"], "left_anti"), "rest"))
        links, found = nearest_first(links, found, seen[-1], segments, t)
        for df in (placed, mixed, placed_):
            discard(df)
        free_shuffles(spark)

    # names of the components are found per node, so that copies meet theirs in one join with a written table
    first = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    first = keep(first.join(few(found), "node", "left").select("node", "first", F.coalesce("label", "node").alias("label")), "first")
    named = first.groupBy("label").agg(F.min("first").alias("component_id"))
    named = keep(first.join(named, "label").select("node", "component_id"), "named")
    for df in (shared, segments, links, found, first, *seen):
        discard(df)
    free_shuffles(spark)
    alone = sets.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = sets.join(named, "node").select("doc_id", "n_shingles", "component_id").unionByName(alone)
    out._reads = [sets, named]  # for callers that write the result
    return out


def nearest_first(links: DataFrame | None, found: DataFrame | None, pairs: DataFrame, segments: DataFrame, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """Links and components after the given pairs have been counted as well: each node's likeliest pair first, then each component's, others
    only if that leaves them in different components. What is replaced is deleted, ``pairs`` stays."""
    if links is not None and pairs.isEmpty():
        return links, found
    rest = pairs.select("a", "b", "na", "nb", "far", F.col("a").alias("label_a"), F.col("b").alias("label_b"))
    x = F.struct("far", "a", "b", "na", "nb").alias("x")
    written = []
    for _ in range(2):
        ends = rest.select(F.col("label_a").alias("label"), x).union(rest.select("label_b", x))
        nearest = keep(ends.groupBy("label").agg(F.min("x").alias("x")).select("x.a", "x.b", "x.na", "x.nb").distinct(), "nearest")
        links, found = merged(links, found, nearest, segments, t)
        rest = rest.drop("label_a", "label_b").join(few(nearest.select("a", "b")), ["a", "b"], "left_anti")
        for end in "ab":
            rest = rest.join(few(found).select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
        rest = keep(rest.filter("label_a <> label_b"), "apart")
        written += [nearest, rest]
        if rest.isEmpty():
            break
    out = merged(links, found, rest, segments, t)
    for df in written:
        discard(df)
    return out


def merged(links: DataFrame | None, found: DataFrame | None, pairs: DataFrame, segments: DataFrame, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """Links and components after the given pairs have been counted as well; what is replaced is deleted."""
    if links is None:
        links = keep(linked(pairs, segments, t), "links")
        found = components(links)
        free_shuffles(segments.sparkSession)
        return links, found
    if pairs.isEmpty():
        return links, found
    new = keep(linked(pairs, segments, t), "new")
    if new.isEmpty():
        out = links, found
    else:
        more = keep(links.union(new), "links")
        out = more, components(more)
        discard(links)
        discard(found)
    discard(new)
    free_shuffles(segments.sparkSession)
    return out


def one_of_each(docs: DataFrame, width: int = 5, t: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns kept. Texts without words all stay.

    The ids that go are a narrow table; documents meet them in an anti join, by broadcast if they are counted to be few. Rows that repeat
    the id that stays stay as well.
    """
    found = join_components(docs, width, t, id_col, text_col)
    gone = keep(found.filter("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    for df in found._reads:
        discard(df)
    return docs.join(few(gone), F.col(id_col) == F.col("__gone"), "left_anti")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"), 4, Fraction(17, 20))
