"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every document has a hash of 48 bits. A source's budget becomes a threshold: documents hashed below it are taken once more. The
threshold comes from sums of tokens by source and hash bucket: the bucket in which the running sum passes the budget is cut into
finer buckets, and only its rows are summed again, until it is one hash value. No row is sorted or ranked, and a larger budget takes
a superset of what a smaller one takes.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows that share a hash (repeated rows)
are taken or left together; a source without tokens has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import keep, table

WEIGHTS = (3, 1, 2)
LEVEL_BITS, LEVELS = 12, 4
BROADCAST_SOURCES = 50_000  # rows of at most some 100 bytes; more sources than that join by shuffle
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def position(id_col: Column, text: Column) -> Column:
    """48 bits of the MD5 of the id (of the text where there is no id)."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), text, F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def source_targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): ``share`` of all tokens by weight, no source above ``most`` times its size, the excess dealt again.

    Dealing again until none is above ends at target = min(cap, level * weight). Sources ordered by cap / weight reach their caps in
    that order, so the level is found with running sums over the sources: one row per source, never one per document.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weight_left"))
    )
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    per = per.withColumn("level", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("source_size"), "level"))).over(everything)["level"])
    return per.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame, wide: bool) -> DataFrame:
    """(__source, __whole, __limit): how often each document is taken at least, and below which hash once more."""
    side = (lambda df: df) if wide else F.broadcast
    at = (
        targets.filter("source_size > 0")
        .withColumn("whole", F.floor(F.col("target") / F.col("source_size")).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("below", F.lit(0).cast("long"))
        .withColumnRenamed("source", "__source")
    )
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        bucket = F.shiftright("position", shift)
        rows = sized.filter("size > 0").join(side(at), F.col("source").eqNullSafe(F.col("__source")) & (F.shiftright("position", shift + LEVEL_BITS) == F.col("prefix")))
        sums = rows.groupBy("__source", bucket.alias("bucket")).agg(F.sum("size").alias("here"), *(F.first(c).alias(c) for c in ("source_size", "target", "whole", "rest", "below")))
        run = Window.partitionBy("__source").orderBy("bucket")
        sums = sums.withColumn("upto", F.col("below") + F.sum("here").over(run))
        edge = F.min(F.when(F.col("upto") > F.col("rest"), F.struct(F.col("bucket"), (F.col("upto") - F.col("here")).alias("under"), F.col("upto").alias("upto"))))
        at = sums.groupBy("__source").agg(edge.alias("edge"), *(F.first(c).alias(c) for c in ("source_size", "target", "whole", "rest")))
        at = at.select("__source", "source_size", "target", "whole", "rest", F.col("edge.bucket").alias("prefix"), F.col("edge.under").alias("below"), F.col("edge.upto").alias("upto"))
    nearer = (F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("below"))
    return at.select("__source", F.col("whole").alias("__whole"), F.coalesce(F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")), F.lit(1 << LEVEL_BITS * LEVELS)).alias("__limit"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken. Texts are read once, to a narrow table of sizes and hashes."""
    sized = keep(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), position(F.col(id_col), F.col(text_col)).alias("position")), "sized"
    )
    targets = keep(source_targets(sized, share, most, weights), "targets")
    wide = targets.count() > BROADCAST_SOURCES
    limits = thresholds(sized, targets, wide)
    per = targets.join(limits, F.col("source").eqNullSafe(F.col("__source")), "left").select(F.col("source").alias("__source"), "source_size", "target", "__whole", "__limit")
    out = sized.join(per if wide else F.broadcast(per), F.col("source").eqNullSafe(F.col("__source")), "left")
    times = F.coalesce(F.col("__whole"), F.lit(0)) + F.when(F.col("position") < F.col("__limit"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, repeated as often as it takes them. The thresholds are found on a narrow table; the
    rows themselves are filtered where they are read and don't shuffle (but for more than ``BROADCAST_SOURCES`` sources)."""
    sized = keep(docs.select("source", word_count(F.col("text")).alias("size"), position(F.col("doc_id"), F.col("text")).alias("position")), "sized")
    targets = keep(source_targets(sized, share, most, weights), "targets")
    wide = targets.count() > BROADCAST_SOURCES
    limits = thresholds(sized, targets, wide)
    out = docs.join(limits if wide else F.broadcast(limits), F.col("source").eqNullSafe(F.col("__source")), "left")
    times = F.coalesce(F.col("__whole"), F.lit(0)) + F.when(position(F.col("doc_id"), F.col("text")) < F.col("__limit"), 1).otherwise(0)
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def mix_sql(docs: str) -> str:
    """Common table expressions ending in ``mixed`` (doc_id, source, text, lang, n_chars, size, source_size, target, times) over ``docs``."""
    return f"""
sized AS (
  SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 12) AS BIGINT) AS position
  FROM {docs}),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight
        FROM sized GROUP BY source),
caps AS (SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM per),
run AS (SELECT *, (total - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
        FROM caps WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT arg_min(level, cap / weight) AS level FROM run WHERE level <= cap / weight),
targets AS (SELECT source, source_size, coalesce(least(cap, found.level * weight), cap) AS target FROM caps, found),
budget AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
hashes AS (SELECT source, position, CAST(sum(size) AS BIGINT) AS here FROM sized WHERE size > 0 GROUP BY ALL),
summed AS (SELECT h.*, whole, target - whole * source_size AS rest, CAST(sum(here) OVER (PARTITION BY h.source ORDER BY position) AS BIGINT) AS upto
           FROM hashes h JOIN budget b ON h.source IS NOT DISTINCT FROM b.source),
edge AS (SELECT source, min(position) AS prefix, arg_min(upto - rest < rest - (upto - here), position) AS nearer FROM summed WHERE upto > rest GROUP BY source),
mixed AS (
  SELECT s.*, b.source_size, b.target,
         b.whole + CASE WHEN e.prefix IS NOT NULL AND s.position < e.prefix + CASE WHEN e.nearer THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS times
  FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN edge e ON s.source IS NOT DISTINCT FROM e.source)
"""


SQL = f"WITH {mix_sql('documents')} SELECT doc_id, size, source_size, target, CAST(size * times AS BIGINT) AS taken FROM mixed"
