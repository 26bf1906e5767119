"""Order, limits, unions and set differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posada.functions.dates import sort_date

from .shared import checkpointed


def first_per_key(rows: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:  # noqa: ANN001
    """The first (or last) row of each key in the order given. Aggregates before the shuffle, so that a hot key costs no task its size."""
    least = F.max_by if last else F.min_by
    kept = rows.groupBy(*keys).agg(least(F.struct(*rows.columns), F.struct(*order)).alias("one"))
    return kept.select("one.*")


def latest_first(rows: DataFrame, date: str = "date", order: str = "ord") -> DataFrame:
    """Sorted by date, latest first; ties keep the table's order."""
    return rows.orderBy(F.desc(sort_date(F.col(date))), F.col(order))


def in_table_order(rows: DataFrame, n: int, order: str = "ord") -> DataFrame:
    return rows.orderBy(order).limit(n)


def strided(rows: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The rows with the worker (0 .. n - 1) that a strided split gives each."""
    return rows.withColumn("worker", F.pmod(F.col(order), F.lit(n)).cast("int"))


def union_in_order(parts: list[DataFrame], order: str = "ord") -> DataFrame:
    """All rows, the parts in the order given: ``part`` and each part's own order together are the order of the whole."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)))


def numbered(rows: DataFrame, order: list, name: str = "ord", ranges: int = 64) -> DataFrame:  # noqa: ANN001
    """Consecutive numbers from 0 in an order. Rows are dealt out by ranges and numbered within them, after the counts of the ranges before.

    The ranges come from a sample, so the dealt rows are written once: numbers and counts must be of the same ranges.
    """
    dealt = checkpointed(rows.repartitionByRange(ranges, *order).withColumn("__p", F.spark_partition_id()))
    within = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__b", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n"))
    return within.join(F.broadcast(before.drop("__n")), "__p").withColumn(name, F.col("__b") + F.col("__r") - 1).drop("__p", "__r", "__b")


def missing_from(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_anti")
