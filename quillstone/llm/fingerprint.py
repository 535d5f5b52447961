"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Each shingle of five words is hashed once; eight bits of the hash name one of 256 bins, the rest is its value, and a bin holds the
least. An empty bin takes the value of a random bin that isn't empty, found by its own fixed probing order (optimal densification,
so equal sets agree everywhere and unequal ones meet with the right probability). Four low bits of every bin are stored, one
hexadecimal digit each; likeness is the share of equal digits, corrected for digits that agree by chance.

The bins come out of one sort of (bin, value) numbers with an entry "empty" for every bin among them, so nothing is exploded or
shuffled per shingle.

Defined results: a null text counts as the empty text; texts without words have no shingle, all of their bins are empty, they are
alike (1.0) to each other and to nothing else (0.0); texts of fewer than five words have their whole word sequence as one shingle.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import table

BINS, LOW_BITS, WIDTH = 256, 4, 5
VALUE_BITS = 63 - 8
EMPTY = (1 << VALUE_BITS) - 1
PROBES = 6


def _probing() -> tuple[list[int], list[int]]:
    """For bin i, (a, c): the bins are tried in the order (a * j + c) mod 257 for j = 0, 1, ..., which meets each once (256 is none)."""
    rng = random.Random(20)
    return [rng.randrange(1, BINS + 1) for _ in range(BINS)], [rng.randrange(BINS + 1) for _ in range(BINS)]


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` bound to a variable, so that it is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def digits(text: Column) -> Column:
    """The low bits of the 256 densified bins of a text, as hexadecimal digits: array<string>."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")

    def shingles(w: Column) -> Column:
        n = F.size(w)
        number = lambda *parts: F.shiftrightunsigned(F.xxhash64(*parts), 1)
        full = F.transform(F.slice(w, 1, F.greatest(n - (WIDTH - 1), F.lit(0))), lambda x, i: number(x, *(F.get(w, i + k) for k in range(1, WIDTH))))
        return F.when(n >= WIDTH, full).when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.array(number(F.array_join(w, " "))))

    empties = F.array(*(F.lit((b << VALUE_BITS) + EMPTY) for b in range(BINS)))
    ordered = F.sort_array(F.concat(_let(words, shingles), empties))

    def firsts(a: Column) -> Column:
        return F.filter(a, lambda x, i: (i == 0) | (F.shiftright(x, VALUE_BITS) != F.shiftright(F.get(a, i - 1), VALUE_BITS)))

    def digit(x: Column, i: Column) -> Column:
        # another digit of the value in each of nine bins: a lone shingle, copied to all bins, then differs from another one in most
        return F.substring(F.lit("0123456789abcdef"), (F.call_function("shiftright", x, (i % 9) * LOW_BITS).bitwiseAND(F.lit((1 << LOW_BITS) - 1)) + 1).cast("int"), F.lit(1))

    least = F.transform(_let(ordered, firsts), lambda x: F.nullif(x.bitwiseAND(F.lit(EMPTY)), F.lit(EMPTY)))
    step, start = (F.array(*map(F.lit, x)) for x in _probing())

    def dense(v: Column) -> Column:
        tried = lambda i, j: F.get(v, (F.get(step, i) * j + F.get(start, i)) % (BINS + 1))  # noqa: E731  null past the last bin
        rest = lambda i: F.aggregate(F.sequence(F.lit(PROBES), F.lit(BINS)), F.lit(None).cast("bigint"), lambda acc, j: F.coalesce(acc, tried(i, j)))
        return F.transform(v, lambda x, i: F.coalesce(digit(F.coalesce(x, *(tried(i, F.lit(j)) for j in range(PROBES)), rest(i)), i), F.lit("-")))

    return _let(least, dense)


def fingerprint(text: Column) -> Column:
    """256 hexadecimal digits; of texts without words, 256 times '-'."""
    return F.array_join(digits(text), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the shingle sets behind two fingerprints, 0 to 1. Sixteen digits at a time are compared as one number."""
    differ = F.lit(0)
    for k in range(0, BINS, 16):
        x = F.conv(F.substring(a, k + 1, 16), 16, -10).cast("long").bitwiseXOR(F.conv(F.substring(b, k + 1, 16), 16, -10).cast("long"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    same = (F.lit(BINS) - differ) / F.lit(float(BINS))
    chance = 1.0 / (1 << LOW_BITS)
    either = (F.substring(a, 1, 1) == "-") | (F.substring(b, 1, 1) == "-")
    return F.when(either, F.when(a == b, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), (same - F.lit(chance)) / F.lit(1 - chance)))


def with_next(df: DataFrame, key: str, carry: dict[str, Column], tie: list[Column]) -> DataFrame:
    """Adds to each row, for each name in ``carry``, the value of the next row in the order of ``key`` (after the last: the first).

    The key's range is cut at quantiles; the first row of each range also goes to the end of the range before. So rows shuffle
    once, and no task needs more than a range. What comes to the driver is one key for each range.
    """
    spark = df.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []))
    place = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key))), F.lit(0)) if cuts else F.lit(0)
    if cuts:  # a balanced tree of comparisons
        def tree(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(F.col(key) > F.lit(cuts[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

        place = tree(0, len(cuts))
    placed = df.withColumn("__range", place)
    # null keys come first; in a range without keys but null ones the least key is null as well
    least = {r["__range"]: (r["k"] if not r["nulls"] else None) for r in placed.groupBy("__range").agg(F.min(key).alias("k"), F.max(F.col(key).isNull()).alias("nulls")).collect()}
    filled = sorted(least)
    if not filled:
        return df.withColumns({name: F.lit(None).cast(df.select(c).schema[0].dataType) for name, c in carry.items()})
    before = {r: filled[i - 1] for i, r in enumerate(filled)}  # of the first range, the last one
    ends = F.lit(0)
    groups = [F.struct(F.lit(r).alias("range"), F.lit(least[r]).cast(df.schema[key].dataType).alias("least"), F.lit(before[r]).alias("before")) for r in filled]
    mine = F.element_at(F.map_from_arrays(F.array(*(F.lit(r) for r in filled)), F.array(*groups)), F.col("__range"))
    placed = placed.withColumn("__mine", mine)
    leads = F.col(key).eqNullSafe(F.col("__mine.least"))
    spots = F.when(leads, F.array(F.struct(F.col("__range").alias("at"), ends.alias("ghost")), F.struct(F.col("__mine.before").alias("at"), F.lit(1).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("__range").alias("at"), ends.alias("ghost")))
    )
    placed = placed.withColumn("__spot", F.explode(spots)).drop("__mine", "__range")
    along = Window.partitionBy("__spot.at").orderBy(F.col("__spot.ghost"), F.col(key).asc_nulls_first(), *tie)
    return placed.withColumns({name: F.lead(c).over(along) for name, c in carry.items()}).filter("__spot.ghost = 0").drop("__spot")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), fingerprint(text).alias("fingerprint"))
    paired = with_next(base, "doc_id", {"next_text": F.col("text"), "next_fingerprint": F.col("fingerprint")}, [F.col("n_chars"), F.col("fingerprint"), F.col("text")])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    out = paired.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", edited.alias("edited"))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
