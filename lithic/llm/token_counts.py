"""Operator 1, token counts under a unigram vocabulary by trie-shared dynamic programming.

Distinct pre-tokens are inserted in a trie. A node stands for a prefix and holds the forward score of the best
segmentation of that prefix and its number of tokens; both are computed once, when the node is made, from the nodes
above it and the vocabulary pieces that end there. Terminal nodes give a pre-token's count. The trie lives as long as a
task and is begun anew when it holds too many nodes. No public vocabulary here has unigram scores and tokenizers are not
trained, so a piece's score is -ln(rank + 1), the Zipf prior of its place in the vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK, NODES = "▁", 1_500_000


class PrefixTrie:
    """Best segmentations of prefixes; ``scores`` has every piece's score. A character without a piece costs its bytes."""

    def __init__(self, scores: dict[str, float], byte_score: float) -> None:
        self.scores, self.byte_score = scores, byte_score
        self.longest: dict[str, int] = {}  # of the pieces that end in a character
        for p in scores:
            self.longest[p[-1]] = max(self.longest.get(p[-1], 1), len(p))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # (node << 21 | character) -> node
        self.forward, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """The token count of a pre-token, which becomes a terminal."""
        text, path, node, child = SPACE_MARK + word, [0], 0, self.child
        for end, c in enumerate(text, 1):
            below = child.get(node << 21 | ord(c))
            if below is None:
                return self._grow(text, end, path)
            path.append(node := below)
        self.terminal[word] = self.tokens[node]
        return self.tokens[node]

    def _grow(self, text: str, end: int, path: list[int]) -> int:
        """The nodes from the ``end``-th character on, below the last of ``path``; then as insert."""
        forward, tokens, score, longest, child = self.forward, self.tokens, self.scores.get, self.longest, self.child
        for end in range(end, len(text) + 1):
            c, node = text[end - 1], path[-1]
            n_bytes = 1 if c < "\x80" else len(c.encode("utf-8", "replace"))
            best, count = forward[node] + n_bytes * self.byte_score, tokens[node] + n_bytes
            for begin in range(end - 1, max(-1, end - 1 - longest.get(c, 0)), -1):
                if (s := score(text[begin:end])) is not None and (total := forward[path[begin]] + s) > best:
                    best, count = total, tokens[path[begin]] + 1
            child[node << 21 | ord(c)] = made = len(forward)
            forward.append(best)
            tokens.append(count)
            path.append(made)
        self.terminal[text[1:]] = tokens[-1]
        return tokens[-1]

    def count(self, text: str | None) -> tuple[int, int]:
        """(pre-tokens, tokens) of a text."""
        words = [w.decode() for w in (text or "").encode("utf-8", "replace").split()]
        if len(self.forward) > NODES:
            self.clear()
        for w in set(words):
            if w not in self.terminal:
                self.insert(w)
        return len(words), sum(map(self.terminal.__getitem__, words))


def vocabulary_scores(model: str) -> tuple[dict[str, float], float]:
    """Scores by piece and the score of a byte, from a sentencepiece model file on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    usable = [k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
    return {sp.id_to_piece(k): -math.log(rank + 1) for rank, k in enumerate(usable, 1)}, -math.log(len(usable) + 1)


def token_counts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_pretokens, n_tokens.

    Pre-tokens are runs without ASCII white space, each with a space mark before it. A null text counts as empty: 0 and 0.
    Repeated rows are each returned; a null id stays null. No rows: no rows. Other columns are ignored.
    """
    scores = df.sparkSession.sparkContext.broadcast(vocabulary_scores(model))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PrefixTrie(*scores.value)
        for batch in batches:
            counted = [trie.count(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), *(pa.array([c[k] for c in counted], pa.int64()) for k in (0, 1))], [id_col, "n_pretokens", "n_tokens"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(each, f"`{id_col}` long, n_pretokens long, n_tokens long")
