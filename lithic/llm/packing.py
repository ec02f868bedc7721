"""Operator 8, conflict-constrained best-fit packing of documents into sequences.

Documents are dealt by hash into shards of bounded size, and each shard fills its own bins, largest document first. The
open bins are kept in order of what is left in them; each carries one bitmap of its sources and one of its duplicate
clusters. From the successor of a document's size the search goes on until it meets a bin whose bitmaps allow the
document: the tightest compatible one. Without any, a new bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower

CAPACITY, SHARD_ROWS = 2048, 2048


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """A bin number for each item, in the given order; no bin holds two items of one source or of one cluster."""
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))}
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in Counter(clusters).items() if n > 1)}  # a lone one conflicts with none
    left: list[tuple[int, int]] = []  # (residual, bin), in order
    in_sources, in_clusters, out = [], [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        sb, cb = source_bit[s], cluster_bit.get(c, 0)
        for k in range(bisect_left(left, (size, -1)), len(left)):
            residual, b = left[k]
            if not (in_sources[b] & sb or in_clusters[b] & cb):
                del left[k]
                break
        else:
            residual, b = capacity, len(in_sources)
            in_sources.append(0)
            in_clusters.append(0)
        in_sources[b] |= sb
        in_clusters[b] |= cb
        if residual > size:
            insort(left, (residual - size, b))
        out.append(b)
    return out


def pack_rows(capacity: int, out: list[str]):
    """Rows (shard, id, n, source, cluster) sorted by shard, then the size of what does not fill a bin (falling), then id."""

    def flush(shard: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rest = [(i, n // capacity, n % capacity, s, c) for i, n, s, c in rows]
        bins = iter(best_fit([r[2] for r in rest if r[2] or not r[1]], *([r[k] for r in rest if r[2] or not r[1]] for k in (3, 4)), capacity))
        made = []
        opened = len(rows)  # the full bins of long documents are numbered after all others
        for i, full, tail, s, _ in rest:
            for k in range(full):
                made.append((i, k, k * capacity, capacity, shard << 32 | opened, s))
                opened += 1
            if tail or not full:
                made.append((i, full, full * capacity, tail, shard << 32 | next(bins), s))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.record_batch([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], out)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if shards[a] != now and held:
                    yield from flush(now, held)
                    held = []
                now = int(shards[a])
                part = batch.slice(a, b - a)
                held += zip(*(part.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True)
        if held:
            yield from flush(now, held)

    return each


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None,
    capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per piece: id, piece, start, n_words, bin_id, source. Every word of every document lies in one piece.

    A document longer than ``capacity`` words gives full pieces with bins of their own and a rest that is packed; one
    without words (or with a null text) is one piece of 0 words. ``cluster_col`` names duplicate clusters; without it,
    texts equal after lower-casing A-Z are one cluster. A null source is a source of its own, rows with a null id are
    packed like others. Repeated rows are duplicates of each other. No rows: no rows. Other columns are ignored.
    Rows are dealt into shards by their place and id, so that rows without an id, or with one id, spread like all others;
    a shard holds sizes and sources, never texts. Which bin a row gets may change with the table's layout.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    cluster = F.col(f"`{cluster_col}`") if cluster_col else ascii_lower(text)
    n_shards = max(1, -(-df.count() // shard_rows))
    rows = df.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.col(f"`{id_col}`").cast("long")), F.lit(n_shards)).alias("shard"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.xxhash64(cluster).alias("cluster"),
    )
    rows = rows.repartition("shard").sortWithinPartitions("shard", (F.col("n") % capacity).desc(), "id")
    out = [id_col, "piece", "start", "n_words", "bin_id", "source"]
    return rows.mapInArrow(pack_rows(capacity, out), f"`{id_col}` long, piece int, start long, n_words long, bin_id long, source string")
