"""Operator 2, byte-level BPE encoding and decoding by speculation and verification.

Greedy longest match proposes tokens for every distinct new pre-token. All adjacent pairs of all proposals are then
tested at once: taking the merges of both tokens back, latest first, no pair that ever stood at their border may have
been merged earlier. A proposal whose pairs all pass is the encoding; only words with a failing pair are merged exactly.
Encoding is a narrow map over the rows; a task keeps a bounded store of words it has met.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE cuts a text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a task remembers; characters of text that it looks at together.
STORE, TOGETHER = 400_000, 1 << 21


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Bpe:
    """A vocabulary of the tokenizers library's JSON form (byte-level BPE without normalizer)."""

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        vocab, merges, alphabet = spec["model"]["vocab"], spec["model"]["merges"], byte_alphabet()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        size = max(vocab.values()) + 1
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.text_of = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.text_of |= {i: t.encode() for t, i in self.special.items()}
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.byte_id = [vocab[c] for c in sorted(alphabet, key=alphabet.get)]
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token; -1: a byte
        self.left, self.right = np.arange(size), np.arange(size)
        for (a, b), (rank, made) in self.merge.items():
            self.rank[made], self.left[made], self.right[made] = rank, a, b
        self.size = size
        keys = np.array([a * size + b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        made = np.flatnonzero(self.rank >= 0)
        fine = np.ones(size, bool)
        fine[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for k in made[np.argsort(self.rank[made])]:
            fine[k] &= fine[self.left[k]] & fine[self.right[k]]
        self.token = {self.text_of[k]: int(k) for k in [*self.byte_id, *made[fine[made]].tolist()]}
        self.longest: dict[bytes, int] = {}  # of the tokens that begin with two given bytes
        for t in self.token:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 1), len(t))

    def compatible(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens, whether both stand side by side in the encoding of their joined bytes."""
        never = np.iinfo(np.int64).max
        out, at = np.ones(len(x), bool), np.arange(len(x))
        x, y, limit = x.copy(), y.copy(), np.full(len(x), never) if limit is None else limit.copy()
        while len(at):
            key = x * self.size + y
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            merged = np.where(self.keys[spot] == key, self.key_rank[spot], never)
            broken = merged < limit
            out[at[broken]] = False
            go = ~broken & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            at, x, y = at[go], x[go], y[go]
            back_x = self.rank[x] > self.rank[y]
            limit = np.where(back_x, self.rank[x], self.rank[y] + 1)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
        return out

    def greedy(self, word: bytes) -> list[int]:
        if (whole := self.token.get(word)) is not None:
            return [whole]
        out, i, n, token = [], 0, len(word), self.token
        while i < n:
            for end in range(min(n, i + self.longest.get(word[i : i + 2], 1)), i, -1):
                if (k := token.get(word[i:end])) is not None:
                    break
            out.append(k)
            i = end
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merges in order of rank, then from the left; over a linked list if the word is long."""
        ids, merge = [self.byte_id[b] for b in word], self.merge
        if len(ids) <= 40:
            none = (len(merge), 0)
            ranks = [merge.get(p, none)[0] for p in zip(ids, ids[1:], strict=False)]
            while ranks and (least := min(ranks)) < none[0]:
                i = ranks.index(least)
                ids[i : i + 2] = [merge[ids[i], ids[i + 1]][1]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = merge.get((ids[i], ids[i + 1]), none)[0]
                if i:
                    ranks[i - 1] = merge.get((ids[i - 1], ids[i]), none)[0]
            return ids
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(m[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (m := self.merge.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.merge[a, b][1], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := self.merge.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q]))
        return [k for k in ids if k >= 0]

    def encode_words(self, words: Iterable[bytes]) -> list[list[int]]:
        words = list(words)
        out = [self.greedy(w) for w in words]
        lengths = np.array([len(o) for o in out], np.int64)
        flat = np.fromiter((k for o in out for k in o), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(out)), lengths)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        fits = self.compatible(pairs // self.size, pairs % self.size)[which]
        for k in np.unique(owner[inside[~fits]]):
            out[k] = self.exact(words[k])
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """Encodes texts one after another and remembers words."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.cut = bpe, regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(bpe.special, key=len, reverse=True))) + ")") if bpe.special else None
        self._forget()

    def _forget(self) -> None:
        self.ids = {t: str(i) for t, i in self.bpe.special.items()}
        self.bytes = {t: t.encode() for t in self.bpe.special}

    def pre_tokens(self, text: str) -> list[str]:
        parts = self.specials.split(text) if self.specials else [text]
        if len(parts) == 1:
            return self.cut(text)
        return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self.cut(p))]

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(decimal ids joined by commas, the text decoded from them) for each text."""
        if len(self.ids) > STORE:
            self._forget()
        words = [self.pre_tokens(t) for t in texts]
        new = [w for w in set().union(*words) if w not in self.ids]
        for w, ids in zip(new, self.bpe.encode_words(w.encode() for w in new), strict=True):
            self.ids[w], self.bytes[w] = ",".join(map(str, ids)), b"".join([self.bpe.text_of[k] for k in ids])
        for ws in words:
            yield ",".join(map(self.ids.__getitem__, ws)), b"".join(map(self.bytes.__getitem__, ws)).decode("utf-8", "replace")


def together(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, in lists of about TOGETHER characters."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def bpe_digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256; ``vocabulary`` is the path of a JSON file on the driver.

    A null text counts as empty: no tokens, digests of the empty string. Repeated rows are each returned, a null id stays
    null. No rows: no rows. Other columns are ignored, whatever their names. A special token's text is that token.
    """
    with open(vocabulary) as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Bpe(spec.value))
        for batch in batches:
            done = []
            for texts in together(batch.column(1).to_pylist()):
                for ids, text in encoder.encode(texts):
                    done.append((ids.count(",") + 1 if ids else 0, sha256(ids.encode()).hexdigest(), sha256(text.encode()).hexdigest()))
            n, a, b = zip(*done, strict=True) if done else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(each, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
