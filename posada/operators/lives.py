"""The lives of listings as mergeable summaries: a run adds to them, so that history is not read again.

A life is a key's stretch of sightings with never more than ``MOST_ABSENCES`` runs from one to the next, as one row (key, first_run,
seen_run). Lives of any sets of sightings, in any order, late and repeated ones too, join into the lives of all of them: joining is
associative and commutative, and joining a thing twice changes nothing. Rows with a null key or run are dropped; an empty table has no
lives. A key is one group, of as many rows as it has lives and new runs; rows are combined by (key, run) before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posada.operators.merge import MOST_ABSENCES
from posada.sources.store import PartedTable


def _joined(rows: DataFrame, key: str) -> DataFrame:
    """Lives that touch or overlap become one."""
    before = Window.partitionBy(key).orderBy("first_run", "seen_run").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("first_run", "seen_run").rowsBetween(Window.unboundedPreceding, 0)
    apart = F.col("first_run") - F.max("seen_run").over(before) > MOST_ABSENCES
    numbered = rows.withColumn("__new", F.when(apart, 1).otherwise(0)).withColumn("__life", F.sum("__new").over(upto))
    return numbered.groupBy(key, "__life").agg(F.min("first_run").alias("first_run"), F.max("seen_run").alias("seen_run")).drop("__life")


def lives(sightings: DataFrame, key: str = "url", run: str = "run_no") -> DataFrame:
    """(key, first_run, seen_run): the lives in some sightings."""
    seen = sightings.where(F.col(key).isNotNull() & F.col(run).isNotNull())
    return _joined(seen.groupBy(key, F.col(run).cast("long").alias("first_run")).agg(F.max(F.col(run).cast("long")).alias("seen_run")), key)


def join_lives(*summaries: DataFrame, key: str = "url") -> DataFrame:
    """The lives in all sightings of which the summaries are."""
    columns = [key, "first_run", "seen_run"]
    return _joined(reduce(DataFrame.unionByName, (s.select(*columns) for s in summaries)).distinct(), key)


def stories(summary: DataFrame, last_run: int) -> DataFrame:
    """Every life, with the run that evicted it; null while it lasts."""
    out = F.col("seen_run") + MOST_ABSENCES
    return summary.withColumn("evicted_run", F.when(out <= last_run, out))


def living(summary: DataFrame, last_run: int, key: str = "url") -> DataFrame:
    """The state after ``last_run``, as ``merge.replay`` gives it: live keys with their insert run, last run and absences."""
    last = summary.groupBy(key).agg(F.max_by(F.struct("first_run", "seen_run"), "first_run").alias("x")).select(key, "x.*")
    return last.withColumn("ausencias", (F.lit(last_run) - F.col("seen_run")).cast("int")).where(F.col("ausencias") < MOST_ABSENCES)


def advance(table: PartedTable, sightings: DataFrame, run: str = "run_no") -> int:
    """Joins further sightings to the stored lives; reads and writes only the parts of their keys. Gives the new version."""
    new = lives(sightings, table.key, run)
    parts = table.changed_parts(new)
    return table.write(join_lives(table.read(new.schema, parts=parts), new, key=table.key), parts)
