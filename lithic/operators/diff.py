"""Differences of two catalog snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def catalog_diff(expected: DataFrame, actual: DataFrame, keys: list[str], props: list[str]) -> DataFrame:
    """JN-1. (keys, change, property): objects only on one side, and every property that differs (nulls are values)."""
    e = expected.select(*keys, F.lit(1).alias("in_e"), *[F.col(p).alias(f"e_{p}") for p in props])
    a = actual.select(*keys, F.lit(1).alias("in_a"), *[F.col(p).alias(f"a_{p}") for p in props])
    differing = F.array_compact(F.array(*[F.when(~F.col(f"e_{p}").eqNullSafe(F.col(f"a_{p}")), F.lit(p)) for p in props]))
    kinds = F.when(F.col("in_a").isNull(), F.array(F.struct(F.lit("missing").alias("change"), F.lit("").alias("property")))).when(
        F.col("in_e").isNull(), F.array(F.struct(F.lit("unexpected").alias("change"), F.lit("").alias("property")))
    )
    changed = F.transform(differing, lambda p: F.struct(F.lit("changed").alias("change"), p.alias("property")))
    return e.join(a, keys, "full_outer").select(*keys, F.explode(kinds.otherwise(changed)).alias("c")).select(*keys, "c.*")


def line_difference(left: DataFrame, right: DataFrame, left_label: str = "left", right_label: str = "right") -> DataFrame:
    """JN-2, SET-1. Lines of one side only, as sets, with the side they are on."""
    only = lambda a, b, label: a.select("line").subtract(b.select("line")).select(F.lit(label).alias("side"), "line")
    return only(left, right, left_label).union(only(right, left, right_label))


def truncated(differences: DataFrame, most: int) -> DataFrame:
    """SRT-4. The first ``most`` lines by side and line, and one row that counts those left out."""
    first = differences.orderBy("side", "line").limit(most)
    left_out = differences.agg((F.count(F.lit(1)) - most).alias("n")).where("n > 0")
    return first.union(left_out.select(F.lit("~"), F.concat(F.lit("omitted "), F.col("n").cast("string"))))


def order_drift(expected: DataFrame, actual: DataFrame, key: str, column: str, place: str) -> DataFrame:
    """SRT-8. Tables whose shared columns come in another order."""
    names = lambda df, n: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(place, column))).alias("c")).select(key, F.col("c")[column].alias(n))
    both = names(expected, "e").join(names(actual, "a"), key)
    shared = both.select(key, F.array_intersect("e", "a").alias("e"), F.array_intersect("a", "e").alias("a"))
    return shared.where("e <> a").select(key, F.array_join("e", ",").alias("expected_order"), F.array_join("a", ",").alias("actual_order"))


def fingerprint(lines: DataFrame, by: str) -> DataFrame:
    """AGG-15. SHA-256 of a model's sorted lines."""
    joined = F.array_join(F.sort_array(F.collect_list("line")), "\n")
    return lines.groupBy(by).agg(F.sha2(joined, 256).alias("fingerprint"), F.count(F.lit(1)).alias("n_lines"))


def normalised_sql(text: Column) -> Column:
    """STR-1. Lower case, runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def signature(kind: Column, name: Column, definition: Column) -> Column:
    """STR-2. kind, name and the first 128 bits of the definition's SHA-256, joined by pipes."""
    return F.concat_ws("|", kind, name, F.concat(F.lit("sha256:"), F.substring(F.sha2(normalised_sql(definition), 256), 1, 32)))


def numbered(names: DataFrame, base: str, order: str) -> DataFrame:
    """WIN-6. The first object of a base name has it bare, later ones with 1, 2, ... behind."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order)) - 1
    return names.select(order, base, F.concat(F.col(base), F.when(n == 0, "").otherwise(n.cast("string"))).alias("unique_name"))


def extension_differences(expected: DataFrame, actual: DataFrame, preinstalled: list[str]) -> DataFrame:
    """JN-3. (name, finding) for extensions (name, version): missing, unexpected, or of another version; those installed beforehand are no finding unless their version differs."""
    a = actual.select(F.col("name").alias("a_name"), F.col("version").alias("a_version"))
    both = expected.join(a, F.col("name") == F.col("a_name"), "full_outer")
    known = F.coalesce("name", "a_name").isin(preinstalled)
    finding = F.when(F.col("name").isNull(), F.when(~known, "unexpected")).when(F.col("a_name").isNull(), F.when(~known, "missing")).when(~F.col("version").eqNullSafe(F.col("a_version")), "version")
    return both.select(F.coalesce("name", "a_name").alias("name"), finding.alias("finding")).where("finding IS NOT NULL")


#: FLT-8. Kinds that belong to a server and not to a schema's definition.
ENVIRONMENT = ["ROLE", "DATABASE", "TABLESPACE", "PRIVILEGES", "OWNER"]


def in_scope(objects: DataFrame, schemas: list[str] | None = None, privileges: bool = False) -> DataFrame:
    """FLT-8. Catalog objects (kind, schema, ...) that are compared: those of the environment only with ``privileges``, and PRIVILEGES alone then; of a list of schemas, if there is one."""
    left_out = [k for k in ENVIRONMENT if not (privileges and k == "PRIVILEGES")]
    kept = objects.where(~F.col("kind").isin(left_out))
    return kept.where(F.col("schema").isin(schemas)) if schemas is not None else kept
