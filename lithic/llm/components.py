"""Connected components of a distributed edge table, by spanning forests in tasks and, where many edges are left, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, tidied

#: Edges that one task connects at once.
AT_ONCE = 1 << 20


class Forest:
    """Connected indices, each tree known by its smallest."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            if not (apart := x != y).any():
                return
            np.minimum.at(self.root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while ((up := self.root[self.root]) != self.root).any():
                self.root = up


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b), AT_ONCE or one batch at a time, -> edges that connect the same nodes: each of a tree's nodes with its smallest."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2))
        node, place = np.unique(np.r_[a, b], return_inverse=True)
        forest = Forest(len(node))
        forest.unite(place[: len(a)], place[len(a) :])
        below = forest.root < np.arange(len(node))
        return pa.record_batch([pa.array(node[below]), pa.array(node[forest.root[below]])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        if held and n + batch.num_rows > AT_ONCE:
            yield star(held)
            held, n = [], 0
        held.append(batch)
        n += batch.num_rows
    if held:
        yield star(held)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs: (node, root) for every node that has an edge and isn't the root, root the smallest node reachable.

    Each task leaves a spanning forest of its own edges. Where these are AT_ONCE or fewer over all, one more task connects
    them, without any exchange. Otherwise each round moves every edge towards smaller nodes and keeps the components; it ends
    when a round changes nothing, after a number of rounds that grows with the logarithm of the longest path. Each round is
    written to the checkpoint folder. Only two numbers a round reach the driver. A node with very many edges is combined by
    partial aggregation, and its edges meet its minimum in a join that the adaptive planner may split. Edges that a Python
    function makes are best settled before: two functions in one stage keep twice as many workers, and their memory.
    """
    edges = settled(edges.where("a <> b").select("a", "b").mapInArrow(stars, "a long, b long"))
    if edges.coalesce(edges.sparkSession.sparkContext.defaultParallelism).count() <= AT_ONCE:
        edges = settled(edges.coalesce(1).mapInArrow(stars, "a long, b long"))
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    edges = settled(edges.distinct())
    before, now, rounds = None, _signature(edges), 0
    while before != now and now[0]:
        rounds += 1
        if rounds % 3 == 0:
            tidied(edges.sparkSession)  # a round has six exchanges
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settled(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        before, now = now, _signature(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
