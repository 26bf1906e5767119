"""Coverage, changes, counts and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posada.functions.base import truthy
from posada.functions.places import valid_place


def coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled, percent, total): how many rows have each field; the percentage is cut, and null for an empty table."""
    kinds = dict(rows.dtypes)
    filled = rows.agg(F.count("*").alias("total"), *(F.count_if(truthy(F.col(f), "string" if kinds[f] == "string" else "number")).alias(f) for f in fields))
    lines = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields))).alias("x")
    percent = F.expr("cast(100 * x.filled as bigint) div nullif(total, 0)")
    return filled.select("total", lines).select("x.field", "x.filled", percent.alias("percent"), "total")


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows with a region and rows with a valid location, before and after a pass."""
    count = lambda df, name: df.agg(
        F.lit(name).alias("version"), F.count("*").alias("total"), F.count_if(truthy(F.col("location_region"))).alias("with_region"), F.count_if(valid_place(F.col("location"))).alias("with_location")
    )
    return count(before, "before").union(count(after, "after"))


def changes(before: DataFrame, after: DataFrame, fields: list[str], key: str = "url") -> DataFrame:
    """(field, changed): how many rows of one key have another value, nulls being values."""
    new = after.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    met = before.select(key, *fields).join(new, key)
    counts = met.agg(*(F.count_if(~F.col(f).eqNullSafe(F.col(f"__{f}"))).alias(f) for f in fields))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("changed")) for f in fields))).alias("x")).select("x.*")


def by_source(rows: DataFrame) -> DataFrame:
    """Counts by source, most common first; ties by first appearance."""
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord")).orderBy(F.desc("n"), "first_ord")


def unresolved(rows: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent locations of rows without a region; ties by first appearance."""
    some = rows.where(~truthy(F.col("location_region")) | F.col("location_region").isNull()).where(truthy(F.col("location")))
    return some.groupBy("location").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord")).orderBy(F.desc("n"), "first_ord").limit(k)


def run_statistics(merged: DataFrame) -> DataFrame:
    """Per source: listings found, new, evicted, and in the table after the run."""
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    return merged.groupBy("source").agg(n("new", "kept").alias("found"), n("new").alias("new"), n("evicted").alias("evicted"), n("new", "kept", "absent").alias("total"))


def outcomes(rows: DataFrame, fields: list[str], failed: str = "failed") -> DataFrame:
    """(outcome, n) of enrichment attempts: failed, else enriched if any field was found, else skipped."""
    any_found = F.greatest(*(F.col(f).isNotNull().cast("int") for f in fields)) == 1
    outcome = F.when(F.coalesce(F.col(failed), F.lit(False)), "failed").when(any_found, "enriched").otherwise("skipped")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
