"""Operator 4, substring dedup with repeated-phrase automata.

A window of ``width`` words holds ``width - PHRASE + 1`` phrases of PHRASE words; the one with the least hash is its
anchor, so equal windows have equal anchors at equal places. The windows of one anchor in a row are a run.

1. Runs are counted by hash over all documents, in classes of equal runs. Runs whose anchor is found once cannot recur.
2. A class with several copies recurs as a whole. Where an anchor has several classes, their windows are counted one by one.
   Each class keeps the place of one copy.
3. The words of the recurring passages are read at these places, and go to every shard of documents that has a run of the class.
4. Each shard compiles its passages, word by word, into one Aho-Corasick automaton and streams all its documents through it.
   The words under its hits are taken out: nothing else decides.

Hashes choose what is worth compiling; another document loses words only where the automaton found the very same words. That
a passage recurs at all rests on 128 bits of hash (a window's own 64 and its anchor's).

Counting is done by partial aggregation, first by shard, and by joins that may be split, so a passage in a third of all
documents meets in no single task. The texts are dealt into shards once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import dealt_out, keyed, settled, tidied

PHRASE, SHARD_ROWS, TOGETHER = 12, 1024, 1 << 21
ODD, BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
BYTES = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
BLOCK = 1 << 16


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Powers of BASE, and of its inverse, by a byte's place in a block.
FORWARD, BACK = powers(BASE, 2 * BLOCK), powers(pow(BASE, -1, 1 << 64), BLOCK)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every word of the bytes ``data``: its first place, and its hash: random numbers of its bytes, each times a power of BASE by its place in the word.

    They are summed up once for a block of bytes; a word's part of the sum is set back to the block's beginning.
    """
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = SPACE[data]
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(data), BLOCK):
        lo, hi = np.searchsorted(starts, [at, at + BLOCK])
        if lo == hi:
            continue
        first, last = starts[lo:hi] - at, ends[lo:hi] - at
        part = data[at : at + min(int(last[-1]), 2 * BLOCK)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTES[part] * FORWARD[: len(part)], out=sums[1:])
        out[lo:hi] = (sums[np.minimum(last, len(part))] - sums[first]) * BACK[first]
    for k in np.flatnonzero(ends - starts > BLOCK):  # longer than a block: by itself
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), 7)
    return starts, mixed(out + (ends - starts).astype(np.uint64))


def rolling(x: np.ndarray, k: int) -> np.ndarray:
    """At each place the hash of k words from there on, put together from spans of 1, 2, 4, ... words; the last k - 1 are of no use."""
    span, power, out, taken, factor = x.copy(), ODD, np.zeros(len(x), np.uint64), 0, np.uint64(1)
    size = 1
    with np.errstate(over="ignore"):  # modulo 2**64
        while size <= k:
            if k & size:  # this span follows what is taken
                rest = len(x) - taken
                if rest > 0:
                    out[:rest] = out[:rest] + span[taken:] * factor
                taken, factor = taken + size, factor * power
            if len(x) > size:
                span[:-size] += span[size:] * power
            size, power = 2 * size, power * power
    return mixed(out)


def least_within(x: np.ndarray, k: int) -> np.ndarray:
    """At each place the place of the least of k values from there on, the first of equals."""
    n, value, place, span = len(x), x, np.arange(len(x)), 1
    while span < k:
        step = min(span, k - span)
        then, where = np.append(value[step:], np.full(min(step, n), ~np.uint64(0))), np.append(place[step:], np.arange(n - min(step, n), n))
        less = then < value
        value, place, span = np.where(less, then, value), np.where(less, where, place), span + step
    return place


class Texts:
    """Some documents' words in one row, by hash, with windows and anchors."""

    def __init__(self, texts: list[bytes], width: int) -> None:
        self.width = width
        starts, self.x = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.ends = np.searchsorted(starts, np.cumsum(sizes))
        self.lengths = np.diff(np.r_[0, self.ends])

    @cached_property
    def whole(self) -> np.ndarray:
        """Whether a window begins at a place."""
        return np.arange(len(self.x)) + self.width <= np.repeat(self.ends, self.lengths)

    @cached_property
    def phrase(self) -> np.ndarray:
        return rolling(self.x, PHRASE)

    @cached_property
    def window(self) -> np.ndarray:
        return rolling(self.x, self.width)

    @cached_property
    def anchor(self) -> np.ndarray:
        return least_within(self.phrase, self.width - PHRASE + 1)

    def runs(self) -> tuple[np.ndarray, ...]:
        """Of every run: document, anchor's hash, its own hash, place of its first window in the document, number of windows."""
        mine = np.flatnonzero(self.whole)
        if not len(mine):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        anchor = self.anchor[mine]
        lo = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(mine) > 1)])
        n = np.diff(np.r_[lo, len(mine)])
        begin, last, anchor = mine[lo], mine[lo + n - 1], anchor[lo]
        own = mixed(self.window[begin] * ODD + mixed(self.window[last] + n.astype(np.uint64)) + (anchor - begin).astype(np.uint64))
        doc = self.doc_of(begin)
        return doc, self.phrase[anchor], own, (begin - (self.ends - self.lengths)[doc]).astype(np.int32), n.astype(np.int32)

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, whole texts) for about TOGETHER bytes at a time."""
    held, size, first = [], 0, 0
    for k, t in enumerate(texts):
        held.append(encoded(t))
        size += len(held[-1])
        if size >= TOGETHER:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def run_rows(width: int):
    """(f, r, shard, text) -> (g, h, f, r, shard, lo, n) for every run."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, r, shard = (batch.column(k).to_numpy() for k in range(3))
            for first, texts in chunks(batch.column(3).to_pylist()):
                doc, g, h, lo, n = Texts(texts, width).runs()
                doc = doc + first
                yield pa.record_batch([longs(g), longs(h), pa.array(f[doc]), pa.array(r[doc]), pa.array(shard[doc]), pa.array(lo), pa.array(n)], ["g", "h", "f", "r", "shard", "lo", "n"])

    return each


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (the last column) compressed one by one: they are dealt out and settled."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [None if t is None else z.compress(t.encode("utf-8", "replace")) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield batch.set_column(batch.num_columns - 1, "text", pa.array(texts, pa.binary()))


def texts_of(column: pa.ChunkedArray) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [b"" if t is None else z.decompress(t) for t in column.to_pylist()]


def documents_of(docs: pa.Table, wanted: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Both of one shard: the wanted documents' texts, and for each row of ``wanted`` the place of its document among them."""
    place = {key: k for k, key in enumerate(zip(docs.column("f").to_pylist(), docs.column("r").to_pylist(), strict=True))}
    at = np.array([place[key] for key in zip(wanted.column("f").to_pylist(), wanted.column("r").to_pylist(), strict=True)], np.int64)
    some, of = np.unique(at, return_inverse=True)
    return texts_of(docs.column("text").take(pa.array(some))), of


def window_rows(width: int):
    """A shard's documents and runs (g, h, f, r, lo, n, copies) -> (w, g, h, s, copies) for the windows of these runs, s the place in the run."""

    def each(docs: pa.Table, runs: pa.Table) -> pa.Table:
        names, kinds = ["w", "g", "h", "s", "copies"], [pa.int64()] * 3 + [pa.int32(), pa.int64()]
        if not docs.num_rows or not runs.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        texts, doc = documents_of(docs, runs)
        t = Texts(texts, width)
        g, h, lo, n, copies = (runs.column(c).to_numpy() for c in ("g", "h", "lo", "n", "copies"))
        begin = lo + (t.ends - t.lengths)[doc]
        run = np.repeat(np.arange(len(n)), n)
        s = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        return pa.table([longs(t.window[begin[run] + s]), pa.array(g[run]), pa.array(h[run]), pa.array(s.astype(np.int32)), pa.array(copies[run])], names)

    return each


def passage_rows(width: int):
    """A shard's documents and runs (g, h, f, r, lo, s) with the places s of their recurring windows -> (g, h, words), a row for windows next to each other."""

    def each(docs: pa.Table, runs: pa.Table) -> pa.Table:
        g, h, found = [], [], []
        if docs.num_rows and runs.num_rows:
            texts, doc = documents_of(docs, runs)
            words = [t.split() for t in texts]
            for k, a, b, lo, places in zip(doc.tolist(), *(runs.column(c).to_pylist() for c in ("g", "h", "lo", "s")), strict=True):
                places = np.unique(places)
                for part in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
                    g.append(a)
                    h.append(b)
                    found.append(b" ".join(words[k][lo + part[0] : lo + part[-1] + width]))
        return pa.table([pa.array(g, pa.int64()), pa.array(h, pa.int64()), pa.array(found, pa.binary())], ["g", "h", "words"])

    return each


class Automaton:
    """The passages of a shard: words with one space between them, and one before and after."""

    def __init__(self, passages: list[bytes]) -> None:
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in passages:
            key = f" {p.decode('utf-8', 'replace')} "
            self.found.add_word(key, len(key))
        self.found.make_automaton()

    def kept(self, words: list[bytes]) -> list[bytes]:
        """Without the words under any hit."""
        if not len(self.found) or not words:
            return words
        hits = list(self.found.iter(f" {b' '.join(words).decode('utf-8', 'replace')} "))
        if not hits:
            return words
        place = np.cumsum([0, *[len(w.decode("utf-8", "replace")) + 1 for w in words]])  # of the space before each word, and of the last one
        ends, sizes = np.array(hits, np.int64).T
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, np.searchsorted(place, ends + 1 - sizes), 1)
        np.add.at(change, np.searchsorted(place, ends), -1)
        return [w for w, c in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not c]


def removed_rows(out: list[str], carry: str | None):
    """A shard's documents and passages (words) -> the rows of substring_dedup."""

    def each(docs: pa.Table, passages: pa.Table) -> pa.Table:
        automaton = Automaton(passages.column("words").to_pylist())
        n, gone, sha, text = [], [], [], []
        texts = texts_of(docs.column("text"))
        for t in texts:
            words = t.split()
            kept = automaton.kept(words)
            whole = b" ".join(kept)
            n.append(len(words))
            gone.append(len(words) - len(kept))
            sha.append(sha256(whole).hexdigest())
            text.append(whole.decode("utf-8", "replace") if gone[-1] else None)
        made = [docs.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())]
        if carry:
            made += [docs.column("carried"), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())]
        return pa.table(made, out)

    return each


def substring_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, shard_rows: int = SHARD_ROWS, carry: str | None = None
) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, kept_text (null where nothing is removed).

    A word goes if a window over it recurs anywhere, in its own document too; windows are judged on the input. Nulls
    count as texts without words; texts shorter than ``width`` words lose nothing, very long ones are read whole. Repeated
    rows are copies of each other. A null id stays null. No rows: no rows. Other columns are ignored, but for ``carry``,
    which is returned with its row, and then whole_text, the text as it was (empty for null). Rows are told apart by file and
    place, never by id.
    """
    kept = [F.col(f"`{carry}`").alias("carried")] if carry else []
    rows = keyed(df).select(F.col("row_key.f").alias("f"), F.col("row_key.r").alias("r"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), *kept, F.col(f"`{text_col}`").cast("string").alias("text"))
    n_shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("f", "r"), F.lit(n_shards)).cast("int"))
    # Dealt out once: what is settled stays partitioned by shard, so the steps below move passages to the texts and never texts.
    spark, undealt = df.sparkSession, rows
    rows = rows.select("f", "r", "doc_id", *["carried"] * bool(carry), "shard", "text")
    rows = rows.mapInArrow(squeezed, StructType([*rows.schema.fields[:-1], StructField("text", BinaryType())]))
    rows = dealt_out(rows, "shard")
    tidied(spark)

    def dealt(other: DataFrame, each, schema) -> DataFrame:
        return rows.groupBy("shard").cogroup(other.groupBy("shard")).applyInArrow(each, schema)

    place = [F.first(c).alias(c) for c in ("f", "r", "lo", "n")]
    # From the table itself: what is partitioned can't be told to be the same twice, and the exchange below is for two.
    runs = undealt.select("f", "r", "shard", "text").mapInArrow(run_rows(width), "g long, h long, f long, r long, shard int, lo int, n int")
    by_shard = runs.groupBy("g", "h", "shard").agg(F.count(F.lit(1)).alias("c"), *place)
    # Every column is asked for on both sides, so that they are one exchange and the texts are read once for it.
    several = by_shard.where(F.coalesce("f", "r", "lo", "n").isNotNull()).groupBy("g").agg(F.sum("c").alias("c")).where("c > 1").select(F.col("g").alias("g2"))
    by_shard = settled(by_shard.join(several, F.col("g") == F.col("g2")).drop("g2"))  # a semi join would go below the exchange
    tidied(spark)
    classes = by_shard.groupBy("g", "h").agg(F.sum("c").alias("copies"), F.first("shard").alias("shard"), *place)
    mixed_ = classes.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("g").alias("g2"))
    compare = settled(classes.join(mixed_, F.col("g") == F.col("g2"), "left_semi"))
    windows = settled(dealt(compare, window_rows(width), "w long, g long, h long, s int, copies long"))
    tidied(spark)
    again = windows.groupBy(F.col("w").alias("w2"), F.col("g").alias("g2")).agg(F.sum("copies").alias("c")).where("c > 1")
    single = windows.where("copies = 1").join(again, (F.col("w") == F.col("w2")) & (F.col("g") == F.col("g2")), "left_semi")
    single = single.groupBy(F.col("g").alias("g2"), F.col("h").alias("h2")).agg(F.collect_set("s").alias("s"))
    in_part = compare.where("copies = 1").join(single, (F.col("g") == F.col("g2")) & (F.col("h") == F.col("h2")))
    whole = classes.where("copies > 1").select("shard", "g", "h", "f", "r", "lo", F.sequence(F.lit(0), F.col("n") - 1).alias("s"))
    found = whole.union(in_part.select("shard", "g", "h", "f", "r", "lo", "s"))
    passages = settled(dealt(found, passage_rows(width), "g long, h long, words binary"))
    tidied(spark)
    where = by_shard.select(F.col("g").alias("g2"), F.col("h").alias("h2"), "shard")
    routed = passages.join(where, (F.col("g") == F.col("g2")) & (F.col("h") == F.col("h2"))).select("shard", "words")
    out = StructType.fromDDL(f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    if carry:
        out = StructType([*out.fields, StructField(carry, df.schema[carry].dataType), StructField("whole_text", StringType())])
    return dealt(routed, removed_rows(out.names, carry), out)
