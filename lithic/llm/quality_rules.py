"""Operator 10, quality rules: hashed n-gram log-likelihood ratio, DataFrame functions only.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over the buckets are
counted: the trusted target (texts with a trusted label) and the raw corpus (all texts, every n-gram).
The target is mixed half and half with the raw side, so an n-gram that no trusted text has costs log 2 at most.
The score of a text is the mean over its n-grams of log p_target - log p_raw. Half of the trusted texts form the
target; the other half sets the one threshold that holds for every document: their lowest scores, less a margin. Counting is one scan with partial aggregation (at most ``buckets`` rows a task are
shuffled); scoring is a second scan without a shuffle, in which the ratios are one array of ``buckets`` doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, settled

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Up to so many values found twice are looked up one by one for every window of a text; more are found by sorting.
LOOKED_UP = 64


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def window_hashes(n: int) -> Column:
    """From ``h``, the words' hashes: a hash for every n-word window, in order. Empty below n words."""
    last = F.greatest(F.size("h") - F.lit(n - 1), F.lit(0))
    return F.transform(F.slice("h", F.lit(1), last), lambda h, i: F.xxhash64(h, *[F.get(F.col("h"), i + k) for k in range(1, n)]))


def found_twice() -> Column:
    """Of ``windows``, sorted, the values that occur more than once, each once."""
    return F.array_distinct(F.filter("sorted", lambda x, k: F.coalesce(F.get(F.col("sorted"), k - 1) == x, F.lit(False))))


def places() -> Column:
    """The places in ``windows`` of the values ``twice``: looked up where these are few, otherwise by sorting values with their places."""
    few = F.array_compact(F.transform("windows", lambda x, i: F.when(F.array_contains("twice", x), i)))
    ranked = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda all_, x, k: F.coalesce(F.get(all_, k)["h"] == x["h"], F.lit(False))
    many = F.transform(F.array(ranked), lambda r: F.transform(F.filter(r, lambda x, k: same(r, x, k - 1) | same(r, x, k + 1)), lambda x: x["i"]))
    return F.when(F.size("twice") == 0, F.array().cast("array<int>")).when(F.size("twice") <= LOOKED_UP, few).otherwise(F.flatten(many))


def n_covered(n: int) -> Column:
    """How many words the windows at ``places`` cover."""
    moved = lambda k: F.transform("places", lambda p: p + F.lit(k))
    return F.when(F.size("places") == 0, F.lit(0)).otherwise(F.size(F.array_distinct(F.concat(*map(moved, range(n))))))


def grams(words: DataFrame, buckets: int, *carried: str) -> DataFrame:
    """``carried`` and b, the bucket of each word and of each word pair of ``words``, as rows of generated code; b is null for a pair that is none, and for a text without words."""
    bucket = lambda c: F.pmod(c, F.lit(buckets)).cast("int")
    pairs = F.arrays_zip(F.col("words").alias("w"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))).alias("after"))
    some = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    h = words.select(*carried, F.inline_outer(pairs).alias("w", "after")).select(*carried, some("w").alias("h"), some("after").alias("after"))
    both = F.array(F.when(F.col("h").isNotNull(), bucket(F.col("h"))), F.when(F.col("after").isNotNull(), bucket(F.xxhash64("h", "after"))))
    return h.select(*carried, F.explode(both).alias("b"))


def fits(key: Column) -> Column:
    """Whether a trusted text with this id counts for the target; the others set the threshold."""
    return F.pmod(F.xxhash64(key), F.lit(64)) < 32


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """One row, one column: an array of ``buckets`` log ratios. Only texts that may be in the target are joined with the ids, before they are split.

    Ids grow with the corpus, so that join is a shuffle at every size and never a broadcast.
    """
    may = F.coalesce(fits(F.col("id")), F.lit(False))
    ids = trusted.where(fits(F.col("t_id"))).hint("merge")
    flagged = docs.where(may).join(ids, F.col("id") == F.col("t_id"), "left").select(F.col("t_id").isNotNull().cast("long").alias("t"), "text")
    rows = flagged.union(docs.where(~may).select(F.lit(0).cast("long"), "text")).select("t", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    counts = grams(rows, buckets, "t").where("b IS NOT NULL").groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    # A dense array by bucket: the counted buckets in order, those never seen in between.
    dense = counts.join(
        counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("every")), F.col("b") == F.col("every"), "right"
    ).select("every", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    packed = dense.agg(F.sort_array(F.collect_list(F.struct("every", "raw", "target"))).alias("c"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    p_raw = lambda x: (x["raw"] + 1.0) / (F.col("n_raw") + float(buckets))
    ratio = lambda x: F.when(F.col("n_target") == 0, 0.0).otherwise(F.log(0.5 + 0.5 * x["target"] / F.col("n_target") / p_raw(x)))
    return packed.select(F.transform("c", ratio).alias("llr"))


def measured(docs: DataFrame, table: Column, buckets: int) -> DataFrame:
    """One row per row of ``docs``: id, the five counts, and llr, the mean ratio of the text's n-grams (0 without any).

    One scan: array functions make the counts, then a text's n-grams become rows that its task adds up to one again.
    """
    words = docs.select("id", F.coalesce("text", F.lit("")).alias("text")).select("id", "text", words_of(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    base = words.select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOL, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    base = base.select("*", window_hashes(3).alias("windows"))
    base = base.select("*", F.sort_array("windows").alias("sorted"))
    base = base.select("*", found_twice().alias("twice"))
    base = base.select("*", places().alias("places"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = base.select(
        "row", "id", "words", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), n_covered(3).cast("long").alias("n_repeat_words")
    )
    each = grams(base, buckets, "row", "id", *counts).select("row", "id", *counts, F.get(table, F.col("b")).alias("ratio"))
    summed = each.groupBy("row", "id").agg(*[F.max(c).alias(c) for c in counts], F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("llr"))
    return summed.drop("row")


def quality_rules(
    df: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 1 << 16,
    quantile: float = 0.002,
    margin: float = 0.02,
) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    ``trusted`` has the ids of trusted texts (``id_col``); all of them are used, half of them by hash of the id for the
    target and half for the threshold. The raw side counts every n-gram of every text. Nulls count as empty texts; an empty text
    has no n-grams, llr 0, and fails the base rules. A very long text is counted like any other, in its task's memory as arrays of
    its words. No trusted ids: every llr is 0 and the threshold is -margin, so the base rules decide. A null id is never trusted;
    repeated rows are each returned, and each counts. No rows: no rows. Other columns are ignored, whatever their names.
    """
    ids = trusted.select(F.col(f"`{id_col}`").alias("t_id")).where("t_id IS NOT NULL").distinct()
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ids = ids.select(F.col("t_id").try_cast(docs.schema["id"].dataType).alias("t_id"))
    llr = settled(ratios(docs, ids, buckets))
    scored = settled(measured(docs, llr.scalar(), buckets))
    others = ids.where(~fits(F.col("t_id"))).hint("merge")
    others = scored.where(~fits(F.col("id")) & (F.col("n_words") >= 50)).join(others, F.col("id") == F.col("t_id")).select("llr")
    least = settled(others.agg((F.coalesce(F.percentile("llr", F.lit(quantile)), F.lit(0.0)) - margin).alias("least")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = ~failed & (F.col("llr") >= least.scalar())
    return scored.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "llr", verdict.alias("kept"))
