"""Substring dedup by collinear chaining: fuzzy passages that documents share.

1. Seeds. Of every ten neighbouring six-word k-mers of a text the one with the least hash is a seed (a minimizer), so two texts with the
   same fifteen words in a row share one.
2. Links. All occurrences of a seed are linked to one of them, the first in the smallest document: a passage in n documents costs n
   links and not n * n, and each document is compared with the document that keeps the passage. That document may hold only a part of
   what two others share, so runs of 2 and 7 neighbouring shared seeds are linked to the run's first holder in the same way, where that is another document or
   another place in it. So are stretches: runs of ``MIN_WORDS`` words, seeds and distances alike, none more than ``WINDOW`` apart. A document that has a stretch
   has nearly all its words in a row, so scattered or shorter parts in smaller documents don't come between two documents that share it.
3. Chains. The links of a pair of documents are chained: positions rise in both, every seed counts ``K`` words, and a gap costs ``GAP`` a word on
   either side. The best predecessor of each link comes from a Fenwick tree of prefix maxima over the positions. One link alone is a
   chain as well: an edited passage may have no more, and the alignment decides.
4. Alignment. A chain's ends are extended word by word while matches outweigh mismatches, with gaps where that isn't enough, and both spans are aligned by the longest
   common subsequence of their words (bits of one integer). A passage has ``MIN_WORDS`` aligned words and ``IDENTITY`` at least. A chain
   that fails is cut at its largest gap and both parts are tried again, so two passages far apart in a pair are both found. A pair's chains are tried
   from the best one down; one whose words lie in passages already found, in both documents, is a repetition within them and is left out.

Only seeds, links and the words around a pair's chains travel. First holders are partial minima in every task and come back in joins with written tables,
which adaptive execution splits where a seed or a document is very common; the pairs of one document are dealt in lots of ``LOT``. A passage repeated within
one document only is none. Defined results: null and empty texts have no passages; rows without an id take
part as nothing that could be named and are left out; rows that repeat an id count as one document, whose words are those of the greatest of its texts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngram_join import mix64, word_hashes
from .scratch import discard, free_shuffles, keep, table

K, WINDOW = 6, 10
GAP = 0.05
MIN_SEEDS, MIN_WORDS, IDENTITY = 3, 40, 0.7
MARGIN = 64
RUNS = (2, 7)  # seven seeds are about MIN_WORDS words
LOT = 1000
SHIFTS = sorted(((x, y) for x in range(3) for y in range(3) if x or y), key=sum)  # words left out at a gap
FOUND = ("start_word", "end_word", "partner_start", "partner_end", "aligned_words")
U = np.uint64


def seeds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of the minimizers of a sequence of word hashes."""
    n = len(h) - K + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    m = np.zeros(n, np.uint64)
    for i in range(K):
        m = m * U(0x9E3779B97F4A7C15) + h[i : i + n]
    m = mix64(m)
    if n <= WINDOW:
        at = np.array([m.argmin()])
    else:
        view = np.lib.stride_tricks.sliding_window_view(m, WINDOW)
        at = np.unique(view.argmin(1) + np.arange(n - WINDOW + 1))
    return m[at].view(np.int64), at


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [seeds(word_hashes(t.as_py() or "")) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.list_(pa.int64())), pa.array([p.astype(np.int32) for _, p in found], pa.list_(pa.int32()))], names=["doc_id", "seeds", "places"])


def stretches(places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, hash) of the shortest runs of seeds that are ``MIN_WORDS`` words long, none of them more than ``WINDOW`` after the one before."""
    i = np.arange(len(places))
    j = np.searchsorted(places, places + (MIN_WORDS - K))
    i, j = i[j < len(places)], j[j < len(places)]
    wide = np.concatenate([[0], np.cumsum(np.diff(places) > WINDOW)])
    i, j = i[wide[i] == wide[j]], j[wide[i] == wide[j]]
    if not len(i):
        return i, j, np.empty(0, np.int64)
    # sums of seeds and distances times powers of an odd number, which its inverse shifts to the run's start
    odd = 0x9E3779B97F4A7C15
    power, back = (np.cumprod(np.r_[U(1), np.full(len(places), x, np.uint64)], dtype=np.uint64) for x in (odd, pow(odd, -1, 1 << 64)))
    h = hashes.view(np.uint64)
    step = mix64(h[:-1] ^ mix64(np.diff(places).astype(np.uint64) + U(1)))
    sums = np.r_[U(0), np.cumsum(step * power[: len(step)], dtype=np.uint64)]
    return i, j, mix64((sums[j] - sums[i]) * back[i] + mix64(h[j]) * power[j - i] + U(1)).view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, document, place of its first seed, place of its last one, that first seed's first holder and its place there) of the runs of a document's shared seeds."""
    for batch in batches:
        columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for doc, found in zip(batch.column(0).to_pylist(), batch.column(1)):
            places, hashes, holders, at = (found.values.field(i).to_numpy() for i in range(4))
            for n in RUNS:
                m = len(places) - n + 1
                if m < 1:
                    break
                key = np.zeros(m, np.uint64)
                for i in range(n):
                    key = key * U(0x9E3779B97F4A7C15) + hashes.view(np.uint64)[i : i + m]
                for c, x in zip(columns, (mix64(key + U(n)).view(np.int64), np.full(m, doc, np.int64), places[:m], places[n - 1 :], holders[:m], at[:m])):
                    c.append(x)
            i, j, key = stretches(places, hashes)
            for c, x in zip(columns, (key, np.full(len(i), doc, np.int64), places[i], places[j], holders[i], at[i])):
                c.append(x)
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["seed", "doc_id", "place", "last", "holder", "at"])


class Fenwick:
    """Prefix maxima of (value, index) over ranks 1..n."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, rank: int, item: tuple[float, int]) -> None:
        best = self.best
        while rank < len(best):
            if item > best[rank]:
                best[rank] = item
            rank += rank & -rank

    def most(self, rank: int) -> tuple[float, int]:
        out, best = (float("-inf"), -1), self.best
        while rank:
            if best[rank] > out:
                out = best[rank]
            rank &= rank - 1
        return out


def paths(links: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The best disjoint chains of links (position, other position), each as its links in order."""
    links = sorted(set(links))
    rank = {p: i + 1 for i, p in enumerate(sorted({b for _, b in links}))}
    tree, score, before = Fenwick(len(rank)), [0.0] * len(links), [-1] * len(links)
    i = 0
    while i < len(links):
        j = i
        while j < len(links) and links[j][0] == links[i][0]:  # equal positions can't follow each other
            a, b = links[j]
            value, k = tree.most(rank[b] - 1)
            # a seed counts K words, less what it shares with the one before
            gain = float(K) if k < 0 else value - GAP * (a + b) + min(K, a - links[k][0], b - links[k][1])
            score[j], before[j] = (gain, k) if k >= 0 and gain > K else (float(K), -1)
            j += 1
        for x in range(i, j):
            a, b = links[x]
            tree.put(rank[b], (score[x] + GAP * (a + b), x))
        i = j
    out, used = [], [False] * len(links)
    for x in sorted(range(len(links)), key=lambda x: -score[x]):
        path = []
        while x >= 0 and not used[x]:
            used[x] = True
            path.append(x)
            x = before[x]
        if path:
            out.append([links[k] for k in reversed(path)])
    return out


def chains(links: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, other start, other end), in words, of the chains of ``MIN_SEEDS`` links or more."""
    return [(p[0][0], p[-1][0] + K, p[0][1], p[-1][1] + K) for p in paths(links) if len(p) >= MIN_SEEDS]


def around(spans: list[tuple[int, int]]) -> list[int]:
    """The union of the spans with ``MARGIN`` words on either side, as from, to, from, to, ..."""
    out: list[int] = []
    for s, e in sorted(spans):
        low, high = max(0, s - MARGIN), e + MARGIN
        if out and low <= out[-1]:
            out[-1] = max(out[-1], high)
        else:
            out += [low, high]
    return out


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair its chains, best first (positions in either document, and where each chain ends in these lists), and the words wanted of both."""
    ints = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("partner_id", pa.int64()), *((c, ints) for c in ("own", "others", "ends", "mine", "theirs"))])
    for batch in batches:
        rows = []
        for doc, other, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
            found = paths(list(zip(a, b)))
            own, others = zip(*(x for path in found for x in path))
            rows.append((doc, other, own, others, np.cumsum([len(p) for p in found]), around([(p[0][0], p[-1][0] + K) for p in found]), around([(p[0][1], p[-1][1] + K) for p in found])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes that a document's pairs want of it: (pair, role, parts of words, from the parts' first words)."""
    schema = pa.schema([("pair", pa.int64()), ("role", pa.int32()), ("at", pa.list_(pa.int32())), ("words", pa.list_(pa.binary()))])
    for batch in batches:
        rows, size = [], 0
        for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
            h = word_hashes(text.as_py() or "").astype("<u4")
            for w in wanted:
                parts = [h[a:b].tobytes() for a, b in zip(w["words"][::2], w["words"][1::2])]
                rows.append((w["pair"], w["role"], w["words"][::2], parts))
                size += sum(map(len, parts))
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits."""
    at: dict[int, int] = {}
    for i, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def extend(a: list[int], b: list[int], i: int, j: int, step: int) -> int:
    """How many words a span can grow from (i, j) in direction ``step`` before mismatches (2 each) outweigh matches by 6."""
    best = score = far = n = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and score > best - 6:
        n += 1
        score += 1 if a[i] == b[j] else -2
        if score > best:
            best, far = score, n
        i, j = i + step, j + step
    return far


def drift(a: list[int], b: list[int], i: int, j: int, step: int) -> tuple[int, int]:
    """Like ``extend``, over missing words too: how many words either span can grow. A gap costs 1 a word where three words match behind it."""
    best = score = x = y = 0
    far = (0, 0)
    start, other = i, j
    while 0 <= i < len(a) and 0 <= j < len(b) and score > best - 6:
        if a[i] == b[j]:
            i, j, score = i + step, j + step, score + 1
            if score > best:
                best, far = score, (abs(i - start), abs(j - other))
            continue
        for x, y in SHIFTS:
            p, q = i + x * step, j + y * step
            if 0 <= p < len(a) and 0 <= q < len(b) and a[p] == b[q] and 0 <= p + 2 * step < len(a) and 0 <= q + 2 * step < len(b) and a[p + step] == b[q + step] and a[p + 2 * step] == b[q + 2 * step]:
                break
        else:
            x = y = 1
        i, j, score = i + x * step, j + y * step, score - x - y
    return far


def aligned(a: list[int], b: list[int], path: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, other start, other end, aligned words) of the passages along a chain of links, positions as in ``a`` and ``b``."""
    out, parts = [], [path]
    while parts:
        p = parts.pop()
        tried = None
        for grow in (lambda *x: (extend(a, b, *x),) * 2, lambda *x: drift(a, b, *x)):
            (s, ps), (e, pe) = p[0], (p[-1][0] + K, p[-1][1] + K)
            (left, pleft), (right, pright) = grow(s - 1, ps - 1, -1), grow(e, pe, 1)
            s, ps, e, pe = s - left, ps - pleft, e + right, pe + pright
            n = common(a[s:e], b[ps:pe]) if min(e - s, pe - ps) >= MIN_WORDS and tried != (s, e, ps, pe) else 0
            tried = s, e, ps, pe
            if n >= MIN_WORDS and 2 * n >= IDENTITY * (e - s + pe - ps):
                out.append((s, e, ps, pe, n))
                break
        else:
            if len(p) == 1:
                continue
            k = max(range(1, len(p)), key=lambda k: p[k][0] - p[k - 1][0] + p[k][1] - p[k - 1][1])
            parts += [p[:k], p[k:]]
    return out


def outermost(found: list[tuple]) -> list[tuple]:
    """The passages (start, end, other start, other end, aligned words) of a pair that don't lie inside another one."""
    out: list[tuple] = []
    for x in sorted(set(found), key=lambda x: (x[0] - x[1] + x[2] - x[3], x)):
        if not any(y[0] <= x[0] and x[1] <= y[1] and y[2] <= x[2] and x[3] <= y[3] for y in out):
            out.append(x)
    return out


def covered(spans: list[tuple[int, int]], s: int, e: int) -> bool:
    """Whether the union of the spans holds all of [s, e)."""
    for a, b in sorted(spans):
        if a <= s < b:
            s = b
    return s >= e


def pair_passages(chains_: list[list[tuple[int, int]]], mine: list[tuple[int, list[int]]], theirs: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """The passages of a pair, from its chains, best first, and the parts (place of the first word, words) of both documents around them."""
    found: list[tuple[int, int, int, int, int]] = []
    for path in chains_:
        s, e, ps, pe = path[0][0], path[-1][0] + K, path[0][1], path[-1][1] + K
        if covered([x[:2] for x in found], s, e) and covered([x[2:4] for x in found], ps, pe):
            continue
        at, a = next(((at, w) for at, w in mine if at <= s and e <= at + len(w)), (0, None))
        pat, b = next(((at, w) for at, w in theirs if at <= ps and pe <= at + len(w)), (0, None))
        if a is None or b is None:  # the chain comes from another text of the same id
            continue
        found += [(s + at, e + at, ps + pat, pe + pat, n) for s, e, ps, pe, n in aligned(a, b, [(x - at, y - pat) for x, y in path])]
    return outermost(found)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("partner_id", pa.int64()), *((c, pa.int64()) for c in FOUND), ("identity", pa.float64())])
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            doc, other, own, others, ends, at, words, pat, pwords = (batch.column(i)[k].as_py() for i in range(9))
            links = list(zip(own, others))
            mine, theirs = ([(x, np.frombuffer(w, "<u4").tolist()) for x, w in zip(xs, ws)] for xs, ws in ((at, words), (pat, pwords)))
            found = pair_passages([links[a:b] for a, b in zip([0, *ends], ends)], mine, theirs)
            rows += [(doc, other, *x, 2 * x[4] / (x[1] - x[0] + x[3] - x[2])) for x in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage of a document that a smaller document has as well: doc_id, partner_id, start_word, end_word, partner_start,
    partner_end (words from 0, the end not included), aligned_words, identity."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    made = keep(docs.mapInArrow(_seeds, "doc_id long, seeds array<long>, places array<int>"), "seeds")
    found = made.select("doc_id", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("doc_id", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place"))
    # of a seed only the least place in the least document and the greatest document travel
    holders = found.groupBy("seed").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.max("doc_id").alias("most")).filter("most <> first.doc_id").drop("most")
    holders = keep(holders, "holders")
    free_shuffles(spark)
    shared = keep(found.join(holders.hint("shuffle_hash"), "seed"), "shared")
    free_shuffles(spark)
    for df in (made, holders):
        discard(df)
    # texts of a repeated id may have left one place with two seeds, so runs are over distinct places
    lists = shared.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("place", "seed", F.col("first.doc_id").alias("holder"), F.col("first.place").alias("at")))).alias("found"))
    runs = keep(lists.mapInArrow(_runs, "seed long, doc_id long, place int, last int, holder long, at int"), "runs")
    firsts = keep(runs.groupBy("seed").agg(F.min(F.struct("doc_id", "place", "last")).alias("first"), F.max("doc_id").alias("most")).filter("most <> first.doc_id").drop("most"), "firsts")
    more = runs.join(firsts.hint("shuffle_hash"), "seed").filter("doc_id <> first.doc_id and (holder <> first.doc_id or `at` <> first.place)")
    ends = F.array(F.struct("place", F.col("first.place").alias("other")), F.struct(F.col("last").alias("place"), F.col("first.last").alias("other")))
    links = shared.filter("doc_id <> first.doc_id").select("doc_id", F.col("first.doc_id").alias("partner_id"), "place", F.col("first.place").alias("other"))
    links = links.union(more.select("doc_id", F.col("first.doc_id").alias("partner_id"), F.explode(ends).alias("x")).select("doc_id", "partner_id", "x.place", "x.other"))
    pairs = links.groupBy("doc_id", "partner_id").agg(F.collect_set(F.struct("place", "other")).alias("x")).select("doc_id", "partner_id", F.col("x.place").alias("places"), F.col("x.other").alias("others"))
    kinds = "doc_id long, partner_id long, own array<int>, others array<int>, `ends` array<int>, mine array<int>, theirs array<int>"
    pairs = keep(pairs.mapInArrow(_chains, kinds).withColumn("pair", F.monotonically_increasing_id()), "pairs")
    for df in (shared, runs, firsts):
        discard(df)
    free_shuffles(spark)
    # what a document gives to its pairs, in lots
    wanted = pairs.select("doc_id", "pair", F.lit(0).alias("role"), F.col("mine").alias("words")).union(pairs.select("partner_id", "pair", F.lit(1), "theirs"))
    many = keep(wanted.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / LOT).alias("lots")), "lots")
    lots = wanted.join(many, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("pair"), F.col("lots")).alias("lot")).agg(F.collect_list(F.struct("pair", "role", "words")).alias("wanted"))
    slices = docs.join(keep(lots, "wanted"), "doc_id").select("text", "wanted").mapInArrow(_slices, "pair long, role int, at array<int>, words array<binary>")
    # one shuffle by pair brings both sides together; of rows that repeat an id the greatest words count
    side = lambda role, at, words: F.max(F.when(F.col("role") == role, F.struct(F.col("at").alias(at), F.col("words").alias(words))))
    slices = slices.groupBy("pair").agg(side(0, "at", "words").alias("x"), side(1, "pat", "pwords").alias("y")).select("pair", "x.*", "y.*")
    both = slices.join(pairs, "pair").select("doc_id", "partner_id", "own", "others", "ends", "at", "words", "pat", "pwords")
    return both.mapInArrow(_align, f"doc_id long, partner_id long, {', '.join(f'{c} long' for c in FOUND)}, identity double")


def op1_substring_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
