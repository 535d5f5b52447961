"""Exact duplicates through two passes of a Bloom filter, with DataFrame functions only.

Pass one hashes every normalised text to ``HASHES`` cells of a bit table and keeps the cells that were hit at least twice.
Pass two probes: a row with a cell that was hit once is certainly unique and goes straight to the result. Only the rest shuffle.

The filter is cut into blocks of 2 ** 15 bits; a digest names its block and its cells there, so a row looks into one block only. Its size grows with
the rows, 16 bits for each. Up to ``2 ** max_bits`` bits (16 MB at the default) the blocks are broadcast. A larger filter meets the digests in a join by
block number, a shuffle of digests and not of texts (in ``drop_copies``, whose rows hold texts, of the distinct digests that repeat); results don't depend on its size.

Defined results: a null text counts as the empty text; a null id is smaller than any id; of rows with equal texts and equal ids
exactly one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import ascii_lower, keep, table

HASHES = 2
MAX_BITS = 27
BLOCK = 15  # bitmap_construct_agg makes bitmaps of 2 ** 15 bits


def filter_bits(rows: int) -> int:
    """log2 of the filter's bits: 16 bits a row, 2 ** 15 at least."""
    return max(BLOCK, (16 * max(rows, 1) - 1).bit_length())


def _block(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(0)), F.lit(1 << bits - BLOCK))


def _cell(digest: Column, which: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(1 + which)), F.lit(1 << BLOCK))


def repeated_cells(hashed: DataFrame, bits: int, digest: str = "text_sha256") -> DataFrame:
    """Pass one: (block, bitmap) with a bit for each cell that at least two rows hit."""
    cells = hashed.select(_block(F.col(digest), bits).alias("block"), F.explode(F.array(*(_cell(F.col(digest), i) for i in range(HASHES)))).alias("cell"))
    hit = cells.groupBy("block", "cell").count().filter("count >= 2")
    return hit.groupBy("block").agg(F.bitmap_construct_agg("cell").alias("bitmap"))


def probe(hashed: DataFrame, blocks: DataFrame, bits: int, digest: str = "text_sha256", flag: str = "maybe_copy", max_bits: int = MAX_BITS) -> DataFrame:
    """Pass two: adds ``flag``, false only for rows whose digest no other row has. ``blocks`` is broadcast if it is at most 2 ** max_bits bits."""
    side = blocks.select(F.col("block").alias("__block"), F.col("bitmap").alias("__bitmap"))
    out = hashed.join(F.broadcast(side) if bits <= max_bits else side, _block(F.col(digest), bits) == F.col("__block"), "left")

    def hit(i: int) -> Column:
        cell = _cell(F.col(digest), i)
        byte = F.conv(F.hex(F.substring(F.col("__bitmap"), (F.shiftright(cell, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.getbit(byte, cell.bitwiseAND(7).cast("int")) == 1, F.lit(False))

    return out.withColumn(flag, F.col("__block").isNotNull() & reduce(lambda a, b: a & b, map(hit, range(HASHES)))).drop("__block", "__bitmap")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept and text_sha256.

    Texts are read and hashed once, into a narrow table. Copies of one text meet as (digest, id) after map-side aggregation; the join
    that hands the keeper back to a large group is one that adaptive execution splits.
    """
    hashed = keep(docs.select(F.col(id_col), F.sha2(ascii_lower(F.col(text_col)), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("__row")), "hashed")
    bits = filter_bits(hashed.count())
    probed = probe(hashed, repeated_cells(hashed, bits), bits, max_bits=max_bits)
    alone = probed.filter(~F.col("maybe_copy")).select(
        id_col, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = probed.filter("maybe_copy")
    groups = maybe.groupBy("text_sha256").agg(F.max(F.struct(id_col, "__row")).alias("__last"), F.count(F.lit(1)).alias("group_size"))
    met = maybe.join(keep(groups, "groups"), "text_sha256").select(
        id_col, F.col(f"__last.{id_col}").alias("keep_id"), "group_size", (F.col("__row") == F.col("__last.__row")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(met)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without exact copies, all columns kept: of equal texts the row with the largest id stays. Rows that are certainly unique
    never shuffle; possible copies are aggregated to one row before they do."""
    digest = "__text_sha256"
    hashed = docs.withColumn(digest, F.sha2(ascii_lower(F.col(text_col)), 256))
    digests = keep(hashed.select(digest), "digests")
    bits = filter_bits(digests.count())
    blocks = repeated_cells(digests, bits, digest)
    if bits <= max_bits:
        probed = probe(hashed, blocks, bits, digest, "__maybe")
    else:  # texts don't travel to the filter; digests do, and those that it can't rule out come back
        doubtful = probe(digests, blocks, bits, digest, "__maybe", max_bits).filter("__maybe").select(digest, F.lit(True).alias("__maybe")).distinct()
        probed = hashed.join(doubtful, digest, "left").withColumn("__maybe", F.coalesce("__maybe", F.lit(False)))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    # of rows equal in id and text the one with the greatest other columns stays (of those that can be ordered)
    ties = [F.col(f"`{f.name}`") for f in docs.schema if f.name not in (id_col, text_col) and f.dataType.typeName() not in ("map", "variant")]
    stays = probed.filter("__maybe").groupBy(digest).agg(F.max_by(row, F.struct(F.col(id_col), F.col(text_col), *ties)).alias("__stays"))
    return probed.filter("not __maybe").select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(stays.select("__stays.*"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(table(spark, sf_dir, "documents"))


SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
