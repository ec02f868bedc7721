"""Operator 3, SimHash near-dedup with a Gray-order hierarchical index.

The upper nodes of the index are masked bit patterns: the 64 bits are cut into ``blocks`` blocks, and for every choice
of ``blocks - max_distance`` of them the bits of the chosen blocks form a node. Two fingerprints at most
``max_distance`` bits apart share such a node, so nothing is missed, and the bits left free bound the different
fingerprints that a node can hold. The nodes are dealt over the cluster. Inside a node, fingerprints are sorted by Gray
rank and gathered bottom-up: each inner node keeps the bits that all below it share. A pair of inner nodes is
followed down with the differences counted so far, and whole groups are left as soon as these exceed the limit, or when
both are known to be connected. Only links of a spanning forest leave a task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled
from .components import Forest, components

FANOUT, CHUNK = 16, 1 << 16


def majority(hashes: np.ndarray) -> np.ndarray:
    """(rows, n) unsigned hashes -> for each row 64 bits: those set in over half of its n hashes."""
    ones = np.unpackbits(np.ascontiguousarray(hashes).astype(">u8").view(np.uint8).reshape(*hashes.shape, 8), axis=2).sum(1, dtype=np.int64)
    return np.packbits(2 * ones > hashes.shape[1], axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned 64 bits: those set in over half the XXH64 hashes (seed 42) of the text's word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for i in range(0, n, CHUNK):
        part = words[i : min(i + CHUNK, n) + shingle - 1]
        shingles = zip(*[part[k:] for k in range(shingle)], strict=False) if len(words) > shingle else [words]
        hashes = np.array([digest(join(s), 42) for s in shingles], np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id long, fp long): the fingerprint's bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(each, "id long, fp long")


def masks(max_distance: int, blocks: int) -> list[int]:
    """Signed longs: the bits of every choice of blocks - max_distance blocks."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    block = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(blocks)]
    return [int(np.array([sum(c)], np.uint64).view(np.int64)[0]) for c in combinations(block, blocks - max_distance)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the binary-reflected Gray order."""
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


class GrayIndex:
    """The inner levels over codes sorted by (group, Gray rank). Level 0 are the codes; a node never spans two groups."""

    def __init__(self, group: np.ndarray, codes: np.ndarray) -> None:
        self.codes, self.first, self.owner = codes, [], [group]
        self.ones, self.zeros = [codes], [~codes]  # bits that all below have as 1, as 0
        while len(self.owner[-1]) > len(np.unique(self.owner[-1])):
            own = self.owner[-1]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            place = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
            first = np.flatnonzero(place % FANOUT == 0)
            self.first.append(np.r_[first, len(own)])
            self.ones.append(np.bitwise_and.reduceat(self.ones[-1], first))
            self.zeros.append(np.bitwise_and.reduceat(self.zeros[-1], first))
            self.owner.append(own[first])

    def _apart(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits fixed on both sides, and different."""
        return (self.ones[level][a] & self.zeros[level][b]) | (self.zeros[level][a] & self.ones[level][b])

    def _one_tree(self, forest: Forest) -> list[np.ndarray]:
        """For each level's nodes: the tree that all below belong to, or -1 - (the node) if to several."""
        out = [forest.root]
        for first in self.first:
            low, high = np.minimum.reduceat(out[-1], first[:-1]), np.maximum.reduceat(out[-1], first[:-1])
            out.append(np.where((low == high) & (low >= 0), low, -1 - np.arange(len(low))))
        return out

    def _near(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        return np.bitwise_count(self.codes[a] ^ self.codes[b]) <= limit

    def connect(self, limit: int) -> Forest:
        """All codes of one group at most ``limit`` bits apart, directly or by way of others."""
        forest, top = Forest(len(self.codes)), len(self.first)
        near = np.flatnonzero(self.owner[0][1:] == self.owner[0][:-1])
        near = near[self._near(near, near + 1, limit)]
        forest.unite(near, near + 1)
        trees = self._one_tree(forest)
        roots = np.arange(len(self.owner[top]))
        todo = [(top, roots, roots, np.zeros(len(roots), np.uint64), np.zeros(len(roots), np.int64))]
        while todo:
            level, a, b, known, apart = todo.pop()
            if len(a) > CHUNK:
                todo += [(level, *(x[h] for x in (a, b, known, apart))) for h in (slice(CHUNK, None), slice(CHUNK))]
                continue
            fresh = (trees[level][a] != trees[level][b]) | (trees[level][a] < 0)
            a, b, known, apart = (x[fresh] for x in (a, b, known, apart))
            if not level:
                fits = self._near(a, b, limit)
                a, b = a[fits], b[fits]
                if len(a):
                    forest.unite(a, b)
                    trees = self._one_tree(forest)
                continue
            first = self.first[level - 1]
            na, nb = np.diff(first)[a], np.diff(first)[b]
            pair = np.repeat(np.arange(len(a)), na * nb)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            x, y = first[a][pair] + k // nb[pair], first[b][pair] + k % nb[pair]
            bits = self._apart(level - 1, x, y)
            more = apart[pair] + np.bitwise_count(bits & ~known[pair])
            stay = (x <= y if level > 1 else x < y) & (more <= limit)
            todo.append((level - 1, x[stay], y[stay], bits[stay], more[stay]))
        return forest


def links_within(limit: int):
    """A mapInArrow function over rows (node, fp, rep) sorted by node: spanning links (a, b) between reps."""

    def linked(node: np.ndarray, codes: np.ndarray, rep: np.ndarray) -> pa.RecordBatch | None:
        same = node[1:] == node[:-1]
        shared = np.r_[same, False] | np.r_[False, same]
        if not shared.any():
            return None
        node, codes, rep = node[shared], codes[shared].view(np.uint64), rep[shared]
        group = np.cumsum(np.r_[True, node[1:] != node[:-1]])
        order = np.lexsort((gray_rank(codes), group))
        group, codes, rep = group[order], codes[order], rep[order]
        root = GrayIndex(group, codes).connect(limit).root
        least = rep.copy()
        np.minimum.at(least, root, rep)
        b = least[root]
        return pa.record_batch([pa.array(rep[rep != b]), pa.array(b[rep != b])], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
            if len(held[0]) < CHUNK or held[0][0] == held[0][-1]:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last node may go on
            if (out := linked(*[h[:cut] for h in held])) is not None:
                yield out
            held = [h[cut:] for h in held]
        if len(held[0]) and (out := linked(*held)) is not None:
            yield out

    return each


def links(reps: DataFrame, max_distance: int, blocks: int) -> DataFrame:
    """From (fp, rep), a row for each different fingerprint: links (a, b) between reps that connect all fingerprints at most ``max_distance`` bits apart.

    A node's key has the bits of ``blocks - max_distance`` blocks, 48 of 64 for 2 of 8: random fingerprints share one only
    where a corpus has some 2**24 of them, and then by twos.
    """
    keys = F.explode(F.array(*[F.xxhash64(F.lit(j), F.col("fp").bitwiseAND(F.lit(m))) for j, m in enumerate(masks(max_distance, blocks))]))
    dealt = reps.select(keys.alias("node"), "fp", "rep").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(links_within(max_distance), "a long, b long")


def simhash_neardup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_distance: int = 2, blocks: int = 8) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the smallest id reachable by links).

    Fingerprints at most ``max_distance`` bits apart are linked. Nulls count as empty texts; texts without words have
    fingerprint zero, linked like any other; of a very long text every shingle counts. A null id keeps its row and never
    names a component, unless its component has no other: then component_id is null. Repeated rows are each returned.
    No rows: no rows. Other columns are ignored, whatever their names.
    """
    rows = settled(fingerprints(df, id_col, text_col, shingle))
    reps = rows.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"))
    roots = components(settled(links(reps, max_distance, blocks)))
    found = reps.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("root", "rep").alias("component_id"))
    return rows.join(found, F.col("fp") == F.col("of"), "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
