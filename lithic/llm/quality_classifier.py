"""Operator 6, quality classifier: random-indexing word vectors, pooled, then a two-layer network in numpy.

Every word has an index vector: the sparse ones, of a few +1 and -1, that belong to hashes of the word and of its byte
trigrams, so that an unknown word is not a blank. A word's vector is its index vector plus the index vectors of its
neighbours in all texts, summed by hashed word. A document is the mean of its words' vectors, their spread,
the length of the mean, and how alike words one and two places apart are. The network is trained on at most ``max_fit`` labelled rows, the first by hash of the id
(a documented bound); a fifth of these sets the temperature by which the probabilities are calibrated. All documents
are then scored in one narrow map.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DIM, VOCABULARY, TRIGRAMS, NONZERO, REACH = 64, 1 << 13, 1 << 12, 4, 2
FEATURES = 2 * DIM + 4
KNOWN, FOREVER = 160_000, 100_000  # words that a task remembers, and those of them that it never forgets
TOGETHER, PART = 100_000, 1 << 13  # words looked up at once, and words whose vectors are held at once


def index_places(rows: int, seed: int) -> np.ndarray:
    """``rows`` sparse index vectors, the same in every task: NONZERO places of each, DIM later where the value is -1 and not +1."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.integers(0, DIM, rows) + DIM * rng.integers(0, 2, rows) for _ in range(NONZERO)], axis=1)


def added_up(rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """(n, DIM) sums: the index vectors with ``places`` (k, NONZERO), each added to one of ``rows`` (k)."""
    counts = np.bincount((rows[:, None] * (2 * DIM) + places).ravel(), minlength=n * 2 * DIM).reshape(n, 2, DIM)
    return counts[:, 0] - counts[:, 1]


def bucket(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 13) % VOCABULARY


class Vectors:
    """Row numbers and rows for words: normed index vector, plus the context of the word's bucket if there is one.

    The first FOREVER words stay, and with them the frequent ones; later words share the rest of the table, which is emptied when full.
    """

    def __init__(self, context: np.ndarray | None = None) -> None:
        self.context, self.by_word, self.by_trigram = context, index_places(VOCABULARY, 1), index_places(TRIGRAMS, 2)
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((KNOWN, DIM), np.float32)

    def learn(self, new: list[bytes]) -> None:
        """Rows for words not met before, all at once."""
        spread = np.frombuffer(b"".join([b"<" + w + b">" for w in new]), np.uint8).astype(np.int64)
        lengths = np.array([len(w) for w in new], np.int64)  # as many trigrams as bytes
        at = np.arange(int(lengths.sum())) + np.repeat(2 * np.arange(len(new)), lengths)
        code = (spread[at] * 65599 + spread[at + 1] * 257 + spread[at + 2] * 8191) % TRIGRAMS
        own = np.array([bucket(w) for w in new], np.int64)
        every = np.arange(len(new))
        v = added_up(np.r_[every, np.repeat(every, lengths)], np.vstack([self.by_word[own], self.by_trigram[code]]), len(new)).astype(np.float32)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)
        if self.context is not None:
            v += self.context[own]
        first = len(self.row)
        self.row.update(zip(new, range(first, first + len(new)), strict=True))
        if len(self.row) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((len(self.row) - len(self.table), DIM), np.float32)])
        self.table[first : first + len(new)] = v

    def rows_of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """For each text its words' row numbers; texts are looked at some at a time."""
        for held in some_at_a_time(texts):
            new = [w for w in set().union(*held) if w not in self.row]
            if len(self.row) + len(new) > KNOWN and len(self.row) > FOREVER:
                self.row, self.table = dict(islice(self.row.items(), FOREVER)), self.table[:KNOWN]
                new = [w for w in set().union(*held) if w not in self.row]
            for k in range(0, len(new), TOGETHER):
                self.learn(new[k : k + TOGETHER])
            for words in held:
                yield np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """FEATURES of each whole text."""
        out = np.zeros((len(texts), FEATURES))
        for k, ids in enumerate(self.rows_of(texts)):
            if not len(ids):
                continue
            total, square, next_two = np.zeros(DIM), np.zeros(DIM), np.zeros(2)
            for i in range(0, len(ids), PART):
                part = self.table[ids[i : i + PART]]
                total += part.sum(0)
                next_two += [np.einsum("i,i->", part[lag:].ravel(), part[:-lag].ravel()) for lag in (1, 2)]
                part *= part
                square += part.sum(0)
            mean = total / len(ids)
            out[k, :DIM], out[k, DIM : 2 * DIM] = mean, np.sqrt(np.maximum(square / len(ids) - mean**2, 0))
            out[k, 2 * DIM :] = np.linalg.norm(mean), np.log1p(len(ids)) / 10, *(next_two / len(ids))
        return out


def some_at_a_time(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """The texts' words, in groups of whole texts with about TOGETHER words."""
    held, size = [], 0
    for k, t in enumerate(texts):
        held.append((t or "").encode("utf-8", "replace").split())
        size += len(held[-1])
        if size >= TOGETHER or k + 1 == len(texts):
            yield held
            held, size = [], 0


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = bucket(word)
        return out


def context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> for each bucket of this task, the sum of its neighbours' index vectors and how often it was met."""
    sums, n, known, places = np.zeros((VOCABULARY, DIM), np.int64), np.zeros(VOCABULARY, np.int64), Buckets(), index_places(VOCABULARY, 1)
    for batch in batches:
        for held in some_at_a_time(batch.column(0).to_pylist()):
            if len(known) > KNOWN:
                known = Buckets(islice(known.items(), FOREVER))
            b = np.concatenate([np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in held])
            text = np.repeat(np.arange(len(held)), [len(words) for words in held])
            n += np.bincount(b, minlength=VOCABULARY)
            for i in range(0, len(b), TOGETHER):
                for d in range(1, REACH + 1):
                    first, second = b[i : i + TOGETHER + d][:-d], b[i + d : i + TOGETHER + d]
                    same = text[i : i + TOGETHER + d][:-d] == text[i + d : i + TOGETHER + d]
                    first, second = first[same], second[same]
                    sums += added_up(np.r_[first, second], places[np.r_[second, first]], VOCABULARY)
    some = np.flatnonzero(n)
    yield pa.record_batch([pa.array(some), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["b", "n", "v"])


@dataclass
class Network:
    """Two layers: tanh, then a logit divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 300, decay: float = 1e-3, seed: int = 5) -> Network:
    """Adam on weighted cross entropy over all rows but each fifth, which calibrates. One class only: a constant."""
    rng = np.random.default_rng(seed)
    fit = np.arange(len(y)) % 5 != 4
    share = float(y.mean()) if len(y) else 0.5
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(y) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    net = Network(mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    if len(set(y[fit])) < 2:
        net.b2 = float(np.log((share + 0.01) / (1.01 - share)))
        return net
    z, t = (x[fit] - mean) / scale, y[fit].astype(float)
    net.w2 = rng.normal(0, hidden**-0.5, hidden)
    m = [np.zeros_like(p) for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    v = [np.zeros_like(p) for p in m]
    for step in range(1, epochs + 1):
        h = np.tanh(z @ net.w1 + net.b1)
        p = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -40, 40)))
        d = (p - t) / len(t)
        back = d[:, None] * net.w2 * (1 - h**2)
        grads = [z.T @ back + decay * net.w1, back.sum(0), h.T @ d + decay * net.w2, np.array([d.sum()])]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            move = 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            if k == 3:
                net.b2 -= float(move[0])
            else:
                (net.w1, net.b1, net.w2)[k][...] -= move
    if (~fit).any():
        raw, truth = net.logits(x[~fit]), y[~fit]
        loss = lambda temp: np.logaddexp(0, np.where(truth == 1, -raw, raw) / temp).mean()
        net.temperature = float(min(np.geomspace(0.5, 10, 60), key=loss))
    return net


def fitted(df: DataFrame, labels: DataFrame, max_fit: int) -> tuple[np.ndarray, Network]:
    """(context vectors, network): the vectors from every text of ``df`` (id, text), the network from at most max_fit rows of ``labels`` (id, label), each met once."""
    some = labels.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    some = some.orderBy(F.xxhash64("id"), "id").limit(max_fit).select(F.col("id").alias("l_id"), "label")
    sample = df.join(F.broadcast(some), F.col("id") == F.col("l_id")).groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").cast("int").alias("label"))
    parts = df.select("text").mapInArrow(context_rows, "b long, n long, v array<long>")
    sums, n = np.zeros((VOCABULARY, DIM)), np.zeros(VOCABULARY)
    summed = parts.groupBy("b").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(DIM)])
    for r in summed.toPandas().itertuples(index=False):  # at most VOCABULARY rows
        n[r.b], sums[r.b] = r.n, r[2:]
    context = (sums / np.maximum(n, 1)[:, None] / (8 * REACH * NONZERO**0.5)).astype(np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(context)
        for batch in batches:
            x = vectors.pooled(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], ["id", "x", "label"])

    got = sample.mapInArrow(features, "id long, x array<double>, label int").toPandas()  # at most max_fit rows
    got = got.sort_values("id", key=lambda s: s.map(lambda i: xxhash.xxh64_intdigest(str(i)))) if len(got) else got
    x = np.array(got["x"].tolist()) if len(got) else np.zeros((0, FEATURES))
    return context, train(x, got["label"].to_numpy(int) if len(got) else np.zeros(0, int))


def quality_classifier(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_fit: int = 4000, threshold: float = 0.3, carry: str | None = None
) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    ``labels`` (id, label 0/1) teach only where crc32 of the id as text, mod 5, is not 0; the rest are held out. A score
    is made from the text alone. Nulls count as empty texts, which have the all-zero features and a score too. A null id
    is not held out (null). Without labels of both classes every score is the same. No rows: no rows. Other columns are
    ignored, but for ``carry``, which is returned with its row. Repeated rows are each returned; of the texts of one id the
    least teaches, once. A very long text is looked at in parts of PART words, all of it.
    """
    rest = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5))
    kept = [F.col(f"`{carry}`").alias("carried")] if carry else []
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), *kept)
    teach = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"))
    context, net = fitted(rows.select("id", "text"), teach.where(rest(F.col("id")) != 0), max_fit)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(context)
        for batch in batches:
            score = net.probability(vectors.pooled(batch.column(2).to_pylist()))
            found = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), *batch.columns[3:]]
            yield pa.record_batch(found, [id_col, "held_out", "score", "predicted", *[carry] * bool(carry)])

    out = StructType.fromDDL(f"`{id_col}` long, held_out boolean, score double, predicted int")
    if carry:
        out.add(carry, df.schema[carry].dataType)
    return rows.select("id", (rest(F.col("id")) == 0).alias("held_out"), "text", *["carried"] * bool(carry)).mapInArrow(each, out)
