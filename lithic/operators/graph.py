"""Graph operators over an edge DataFrame (src, dst): src depends on dst."""

from __future__ import annotations

import heapq

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.sources.checkpoints import keyed, settled

#: Fixed value: up to so many edges are followed in memory by every task (16 MB of whole keys, sent by way of the driver); more go by rounds of joins.
IN_MEMORY = 2**20


def edge_set(edges: DataFrame) -> DataFrame:
    """GR-5. Distinct edges without nulls."""
    return edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def reachability(edges: DataFrame) -> DataFrame:
    """GR-3. All (src, dst) with a path. Sources are dealt out, and each is followed through the edges: pairs are made where they are handed on, and never exchanged."""
    paths = settled(edge_set(edges))
    return _followed(paths) if paths.count() <= IN_MEMORY else _joined(paths)


def _followed(edges: DataFrame) -> DataFrame:
    """Reachability with all edges in every task; a task keeps one mark a node, and the pairs of one source."""
    table = edges.toArrow()
    names = pa.chunked_array([*table["src"].chunks, *table["dst"].chunks], table["src"].type).combine_chunks().dictionary_encode()
    codes, names, n = names.indices, names.dictionary, table.num_rows
    sources = edges.select("src").distinct().repartition(4 * edges.sparkSession.sparkContext.defaultParallelism)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to: dict = {}
        for a, b in zip(codes[:n].to_pylist(), codes[n:].to_pylist(), strict=True):
            to.setdefault(a, []).append(b)
        seen, code = [-1] * len(names), {v: k for k, v in enumerate(names.to_pylist())}
        made = lambda src, dst: pa.record_batch([names.take(pa.array(src, pa.int64())), names.take(pa.array(dst, pa.int64()))], ["src", "dst"])
        src, dst = [], []
        for batch in batches:
            for value in batch.column(0).to_pylist():
                s = code[value]
                todo, first = [s], len(dst)
                while todo:
                    for y in to.get(todo.pop(), ()):
                        if seen[y] != s:
                            seen[y] = s
                            dst.append(y)
                            todo.append(y)
                src += [s] * (len(dst) - first)
                if len(dst) > 2**16:
                    yield made(src, dst)
                    src, dst = [], []
        yield made(src, dst)

    return sources.mapInArrow(each, edges.schema)


def _joined(paths: DataFrame) -> DataFrame:
    """Reachability by rounds: paths of up to n steps, and walks of n steps that carry them on, where n doubles. The rounds grow with the logarithm of the longest path, and each path meets only the walks of one length."""
    walks, via = paths, lambda df: keyed(df.select(F.col("src").alias("via"), F.col("dst").alias("end")))
    further = lambda df: df.join(via(walks), F.col("dst") == F.col("via")).select("src", F.col("end").alias("dst"))
    before, now = -1, paths.count()
    while before != now:
        paths, walks = settled(paths.union(further(paths)).distinct()), settled(further(walks).distinct())
        before, now = now, paths.count()
    return paths


def levels(edges: DataFrame) -> DataFrame:
    """GR-4. (node, level): 0 without dependencies, else one more than the highest of them. Nodes on or behind a cycle have none."""
    left = settled(edge_set(edges))
    nodes = left.select(F.col("src").alias("node")).union(left.select(F.col("dst").alias("node"))).distinct()
    waiting, done, level = settled(nodes), None, 0
    while not waiting.isEmpty():
        ready = settled(waiting.join(left.select(F.col("src").alias("node")).distinct(), "node", "left_anti"))
        if ready.isEmpty():
            break
        now = ready.select("node", F.lit(level).cast("long").alias("level"))
        done = now if done is None else done.union(now)
        waiting = settled(waiting.join(ready, "node", "left_anti"))
        left = settled(left.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        level += 1
    return done if done is not None else nodes.select("node", F.lit(0).cast("long").alias("level"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those of nodes that nothing leads to, or that lead nowhere: these lie on no cycle."""
    before, now = -1, edges.count()
    while before != now:
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = settled(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, now = now, edges.count()
    return edges


def _spread(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """The least colour (node, colour) that reaches each node along edges (src, dst)."""
    while True:
        pushed = edges.join(colours.select(F.col("node").alias("src"), "colour"), "src").select(F.col("dst").alias("node"), "colour")
        after = settled(colours.union(pushed).groupBy("node").agg(F.min("colour").alias("colour")))
        if after.join(colours.withColumnRenamed("colour", "old"), "node").where("colour <> old").isEmpty():
            return after
        colours = after


def strong_components(edges: DataFrame) -> DataFrame:
    """GR-6. (node, component): nodes that reach each other, named by their smallest; a node on no cycle is alone.

    By forward and backward colouring: the least node that reaches a node is its colour; of one colour, those that reach the
    node that gave it are its component. Only edges and one colour a node are kept, never pairs that reach each other. Rounds
    grow with the longest path among nodes on cycles and between them; all others are trimmed first.
    """
    edges = settled(edge_set(edges))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    left, found = _trimmed(edges.where("src <> dst")), None
    while not left.isEmpty():
        some = left.select(F.col("src").alias("node")).distinct()
        forward = _spread(left, some.select("node", F.col("node").alias("colour")))
        c = lambda n, m: forward.select(F.col("node").alias(n), F.col("colour").alias(m))  # noqa: B023, E731
        inside = settled(left.join(c("src", "c1"), "src").join(c("dst", "c2"), "dst").where("c1 = c2").select("src", "dst", "c1"))
        roots = forward.where("node = colour")
        reached = settled(roots.select("node", "colour"))
        while True:  # backwards from each colour's own node, within the colour
            more = inside.join(reached.select(F.col("node").alias("dst"), F.col("colour").alias("r")), "dst").where("c1 = r").select(F.col("src").alias("node"), F.col("r").alias("colour"))
            after = settled(reached.union(more).distinct())
            if after.count() == reached.count():
                break
            reached = after
        part = reached.select("node", F.col("colour").alias("component"))
        found = part if found is None else found.union(part)
        rest = left.join(reached.select(F.col("node").alias("src")), "src", "left_anti").join(reached.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = _trimmed(settled(rest.select("src", "dst")))
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    least = settled(found)
    return nodes.join(least, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """GR-2. The nodes on a cycle, self-references included."""
    c = settled(strong_components(edges))
    several = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return c.join(several, "component", "left_semi").select("node").union(edges.where("src = dst").select(F.col("src").alias("node"))).distinct()


def deferred_edges(edges: DataFrame) -> DataFrame:
    """GR-7. Foreign keys within a component of several tables, or to the own table: they are added after the tables."""
    c = settled(strong_components(edges))
    a, b = c.select(F.col("node").alias("src"), F.col("component").alias("c1")), c.select(F.col("node").alias("dst"), F.col("component").alias("c2"))
    return edge_set(edges).join(a, "src").join(b, "dst").where("c1 = c2").select("src", "dst")


def cycle_breakers(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """GR-8. For each component on a cycle, the member with the earliest position (node, position) comes first."""
    c = settled(strong_components(edges))
    several = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    own = edges.where("src = dst").select(F.col("src").alias("component"))
    c = c.join(several.union(own).distinct(), "component", "left_semi").join(positions, "node")
    return c.groupBy("component").agg(F.min_by("node", F.struct("position", "node")).alias("first"))


def topological_order(edges: list[tuple], nodes: list | None = None) -> list:
    """GR-1. Kahn's order with the smallest ready node first, for rendering one result; a cycle is an error.

    Histories' graphs have as many nodes as a schema has objects; use levels() for anything larger.
    """
    needs = {n: set() for n in nodes or []}
    for a, b in edges:
        needs.setdefault(a, set()).add(b)
        needs.setdefault(b, set())
    users: dict = {}
    for a, bs in needs.items():
        for b in bs:
            users.setdefault(b, []).append(a)
    ready, out = [n for n, b in needs.items() if not b], []
    heapq.heapify(ready)
    while ready:
        out.append(n := heapq.heappop(ready))
        for a in users.get(n, []):
            needs[a].discard(n)
            if not needs[a]:
                heapq.heappush(ready, a)
    if len(out) < len(needs):
        raise ValueError(f"cycle among {sorted(set(needs) - set(out))}")
    return out
