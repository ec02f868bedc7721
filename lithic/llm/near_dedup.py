"""Operator 3 by similarity: texts whose sets of word shingles have a Jaccard similarity of a threshold or more.

Two texts with a similarity of 0.8 differ in 9.7 of the 64 bits of their SimHash on average, and an index whose masks
allow so many has nodes that grow with the corpus. So the whole-text fingerprints, linked within a few bits by operator
3's Gray-order index, find the closest copies only, and FAMILIES fingerprints of samples find the others: each is the SimHash
of the SAMPLE shingles that have the least hashes in its family, and links texts where it is equal. Two texts with
similarity J are missed with a probability of (1 - J**SAMPLE)**FAMILIES at most.

Every candidate is confirmed by the shingle sets themselves. In rounds, each group of candidates has a pivot, and all other
members that are not yet connected with it are compared with it, as rows of a join; a group whose members are all connected
is done. When at most IN_TASKS texts are in open groups, or after ROUNDS rounds, what is open, texts that share samples but
are not similar, is compared in one task for each connected set of such groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import settled, tidied
from .components import components
from .simhash import links, majority

FAMILIES, SAMPLE, CHUNK = 20, 5, 1024
#: Rounds at most, and texts in open groups that need no further round.
ROUNDS, IN_TASKS = 4, 4000
_RNG = np.random.default_rng(42)
FACTORS, SHIFTS = _RNG.integers(0, 1 << 31, FAMILIES * SAMPLE, np.uint32) * np.uint32(2) + np.uint32(1), _RNG.integers(0, 1 << 32, FAMILIES * SAMPLE, np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | bytes | None, n: int) -> np.ndarray:
    """The distinct XXH64 hashes (seed 42), sorted, of the text's n-word shingles; a shorter text is one shingle. Bytes are a compressed text."""
    data = zstandard.ZstdDecompressor().decompress(text) if isinstance(text, bytes) else (text or "").encode("utf-8", "replace")
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    parts = zip(*[words[k:] for k in range(n)], strict=False) if len(words) > n else [words]
    return np.unique(np.array([digest(join(s), 42) for s in parts], np.uint64))


def sampled(hashes: np.ndarray) -> np.ndarray:
    """FAMILIES longs, the SimHash of each family's sample."""
    least, low = np.full(FAMILIES * SAMPLE, 0xFFFFFFFF, np.uint32), hashes.astype(np.uint32)
    for k in range(0, len(low), CHUNK):
        np.minimum(least, (low[k : k + CHUNK, None] * FACTORS + SHIFTS).min(0), out=least)
    mixed = least.astype(np.uint64) * MIX
    mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX
    return majority(mixed.reshape(FAMILIES, SAMPLE)).view(np.int64)


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set, the least place reachable by links of a Jaccard similarity of num / den or more. Two empty sets are equal.

    A search from each set: one as similar as that has at least one of any |set| - ceil(num * |set| / den) + 1 of its
    members, so only sets that share one of its rarest members are compared. Sets already reached are left out.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    out, empty = np.full(n, -1), np.flatnonzero(sizes == 0)
    out[empty] = empty[:1].repeat(len(empty))
    member, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts, owner = np.r_[0, np.cumsum(sizes)], np.repeat(np.arange(n), sizes)
    posted = owner[np.argsort(flat, kind="stable")]
    ends = np.cumsum(np.bincount(flat, minlength=len(member)))
    begins = np.r_[0, ends[:-1]]
    marked = np.zeros(len(member), bool)
    for first in range(n):
        if out[first] >= 0:
            continue
        out[first], todo = first, [first]
        while todo:
            u = todo.pop()
            mine = flat[starts[u] : starts[u + 1]]
            few = len(mine) - -(-num * len(mine) // den) + 1
            rare = mine[np.argsort((ends - begins)[mine], kind="stable")[:few]]
            near = np.unique(np.concatenate([posted[begins[m] : ends[m]] for m in rare]))
            near = near[(out[near] < 0) & (den * sizes[near] >= num * sizes[u]) & (num * sizes[near] <= den * sizes[u])]
            marked[mine] = True
            shared = np.array([np.count_nonzero(marked[flat[starts[v] : starts[v + 1]]]) for v in near], int)
            marked[mine] = False
            near = near[den * shared >= num * (sizes[u] + sizes[near] - shared)]
            out[near] = first
            todo += near.tolist()
    return out


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, text) with the text compressed: each is read in several exchanges."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield batch.set_column(1, "text", pa.array([z.compress((t or "").encode("utf-8", "replace")) for t in batch.column(1).to_pylist()], pa.binary()))


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Of ``pairs`` (a, b), those whose texts (u, text) are similar enough."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for b, s, t in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                x = shingles(s, shingle)
                if b != last:
                    last, y = b, shingles(t, shingle)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * shared >= num * (len(x) + len(y) - shared))
            yield pa.record_batch([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    first, second = (texts.select(F.col("u").alias(f"u_{c}"), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = pairs.join(first, F.col("a") == F.col("u_a")).join(second, F.col("b") == F.col("u_b"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(each, "a long, b long")


def named(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """``groups`` (key, u, score) with each member's root so far, for the groups that have several, and the pivot: the member with the highest score."""
    known = groups.join(roots, F.col("u") == F.col("node"), "left").select("key", "u", "score", F.coalesce("root", "u").alias("root"))
    ends = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct("score", "u", "root")).alias("pivot")).where("low < high")
    return known.join(ends.select(F.col("key").alias("of"), "pivot"), F.col("key") == F.col("of")).drop("of")


def confirmed_in_tasks(groups: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect the similar texts of ``groups`` (key, u), each connected set of groups in one task."""
    star = groups.groupBy("key").agg(F.min("u").alias("b")).withColumnRenamed("key", "of")
    sets = components(groups.join(star, F.col("key") == F.col("of")).select(F.col("u").alias("a"), "b"))
    sets = sets.union(sets.select(F.col("root").alias("node"), "root").distinct())

    def one(group: pa.Table) -> pa.Table:
        u = group.column("u").to_numpy()
        tree = linked([shingles(t, shingle) for t in group.column("text").to_pylist()], num, den)
        return pa.table({"a": pa.array(u), "b": pa.array(u[tree])})

    return texts.join(sets, F.col("u") == F.col("node")).select("root", "u", "text").groupBy("root").applyInArrow(one, "a long, b long").where("a <> b")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per input row: id (of any ordered type), component_id (the smallest id reachable by links of similarity num / den or more).

    Nulls count as empty texts; texts without words have equal, empty sets; of a very long text every shingle counts. A null id
    keeps its row and never names a component, unless its component has no other: then component_id is null. Repeated rows are
    each returned. No rows: no rows. Other columns are ignored, whatever their names.
    """
    spark, text = df.sparkSession, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, keys = [], []
            for t in batch.column(2).to_pylist():
                h = shingles(t, shingle)
                whole.append(int(majority(h[None, :])[0]) if len(h) else 0)
                keys.append(sampled(h))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.array(whole, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["id", "digest", "fp", "keys"])

    made = StructType.fromDDL("digest binary, fp long, keys array<long>")
    rows = settled(docs.mapInArrow(each, StructType([StructField("id", docs.schema["id"].dataType), *made.fields])))
    reps = rows.groupBy("digest").agg(F.min("id").alias("rep"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    reps = settled(reps.withColumn("u", F.monotonically_increasing_id()))
    keys = F.concat(F.transform("keys", lambda k, j: F.xxhash64(j, k)), F.array(F.xxhash64("fp")))
    groups = reps.select("u", F.explode(keys).alias("key"))
    shared = groups.groupBy("key").agg(F.min("u").alias("low"), F.max("u").alias("high")).where("low < high").select(F.col("key").alias("of"))
    groups = settled(groups.join(shared, F.col("key") == F.col("of"), "left_semi"))
    close = settled(links(reps.groupBy("fp").agg(F.min("u").alias("rep")), 2, 8))
    some = groups.select("u").union(close.select("a")).union(close.select("b")).distinct()
    some = reps.join(some.withColumnRenamed("u", "w"), F.col("u") == F.col("w"), "left_semi").select("u", F.col("digest").alias("of"))
    texts = settled(docs.select("digest", "text").join(some, F.col("digest") == F.col("of")).groupBy("u").agg(F.first("text").alias("text")).mapInArrow(packed, "u long, text binary"))

    tidied(spark)
    # A member's score is how many texts it meets in its groups: what copies were made of meets more of them than a copy does.
    size = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("key", "of")
    score = groups.join(size, F.col("key") == F.col("of")).groupBy(F.col("u").alias("w")).agg(F.sum("n").alias("score"))
    groups = settled(groups.join(score, F.col("u") == F.col("w")).select("key", "u", "score"))
    # First every text is compared with one pivot only, the highest of its groups': of large sets of copies that settles nearly all groups.
    pivots = groups.groupBy("key").agg(F.max(F.struct("score", "u")).alias("pivot")).withColumnRenamed("key", "of")
    pairs = groups.join(pivots, F.col("key") == F.col("of")).groupBy(F.col("u").alias("a")).agg(F.max("pivot").alias("pivot")).select("a", F.col("pivot.u").alias("b")).where("a <> b")
    sure = settled(similar(pairs.union(close.select("a", "b")).distinct(), texts, shingle, num, den))
    for k in range(ROUNDS + 1):
        roots = components(sure)
        open_ = settled(named(groups, roots))
        sure = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))  # as good as all links so far
        tidied(spark)
        if k == ROUNDS or open_.select("u").distinct().count() <= IN_TASKS:
            break
        pairs = open_.where(F.col("root") != F.col("pivot.root")).select(F.col("u").alias("a"), F.col("pivot.u").alias("b")).distinct()
        sure = settled(sure.union(similar(pairs, texts, shingle, num, den)).distinct())
        groups = open_.where(F.col("u") != F.col("pivot.u")).select("key", "u", "score")
    sure = settled(sure.union(confirmed_in_tasks(open_.select("key", "u"), texts, shingle, num, den)))
    roots = components(sure)
    tidied(spark)
    named_ = reps.join(roots, F.col("u") == F.col("node"), "left").select("digest", "rep", F.coalesce("root", "u").alias("root"))
    least = named_.groupBy("root").agg(F.min("rep").alias("component_id")).withColumnRenamed("root", "r")
    found = named_.join(least, F.col("root") == F.col("r")).select(F.col("digest").alias("of"), "component_id")
    return rows.join(found, F.col("digest") == F.col("of")).select(F.col("id").alias(id_col), "component_id")
