"""Connected components of an edge table: in one task while the counted edges are few, else by alternating large-star and small-star steps.
Nothing is collected but counts and a checksum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, keep

ONE_TASK = 500_000  # edges, two numbers each, that one task holds


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges and the least node that each reaches. Each round hooks roots to smaller neighbours, so at most half of a component's roots stay."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(ends, 2)
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        one, two = label[x], label[y]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label != label[label]).any():
            label = label[label]
    return nodes, nodes[label]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[np.asarray(c) for c in batch.columns] for batch in batches]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in least_reached(*map(np.concatenate, zip(*parts)))], names=["node", "label"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b), a written table; the label is the least node that links reach.

    Up to ``ONE_TASK`` edges are read by one task, without a shuffle. Above, each round is a few shuffles of the edges, and a hub's neighbours are summed to a minimum before they meet. The edge table is
    written to the shared folder after each round, so neither lineage nor a lost executor's work builds up; so is the result. Self links are allowed.
    """
    if edges.count() <= ONE_TASK:
        return keep(edges.select("a", "b").coalesce(1).mapInArrow(_together, "node long, label long"), "found")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        # large star: every larger neighbour of a node links to the least of its neighbourhood
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour, and the node itself, link to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        old, now = now, keep(small, "edges")
        discard(old)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    # at the end every node has one link, to the label
    found = keep(nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "found")
    discard(now)
    return found
