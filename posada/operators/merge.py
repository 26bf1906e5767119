"""Merging runs into the accumulated table, and the life of listings over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_ABSENCES = 3


def merge_run(stored: DataFrame, seen: DataFrame, key: str = "url", updated: tuple[str, ...] = ("price", "description"), portals_ok: list[str] | None = None) -> DataFrame:
    """One run's upsert with absence counting; stored and seen hold one row per key.

    New keys are inserted whole. Of known ones only ``updated`` changes, even to '', and the count of absences
    becomes 0. Keys that the run has not seen gain an absence; at ``MOST_ABSENCES`` their ``action`` is
    'evicted'. Absences of portals not in ``portals_ok`` (null: all are) do not count. Null keys are dropped.
    """
    columns = stored.columns
    a = stored.where(F.col(key).isNotNull()).select(F.struct(*columns).alias("a"), F.col(key).alias("__k"))
    have = [c for c in columns if c in seen.columns]
    b = seen.where(F.col(key).isNotNull()).select(F.struct(*have).alias("b"), F.col(key).alias("__k"))
    both = a.join(b, "__k", "full_outer")
    new, absent = F.col("a").isNull(), F.col("b").isNull()
    counted = F.lit(True) if portals_ok is None else F.col("a.source").isin(portals_ok)
    before = F.coalesce(F.col("a.ausencias"), F.lit(0))
    absences = F.when(new | ~absent, 0).when(counted, before + 1).otherwise(before)

    def value(c: str):  # noqa: ANN202
        if c == "ausencias":
            return absences.alias(c)
        of_b = F.col(f"b.{c}") if c in have else F.lit(None).cast(stored.schema[c].dataType)
        if c in updated and c in have:
            return F.when(absent, F.col(f"a.{c}")).otherwise(of_b).alias(c)
        return F.when(new, of_b).otherwise(F.col(f"a.{c}")).alias(c)

    action = F.when(new, "new").when(~absent, "kept").when(counted & (absences >= MOST_ABSENCES), "evicted").otherwise("absent")
    return both.select(*(value(c) for c in columns), action.alias("action"))


def alive(merged: DataFrame) -> DataFrame:
    """The table after a run: all but the evicted rows."""
    return merged.where("action != 'evicted'").drop("action")


def with_dates(seen: DataFrame, stored: DataFrame, today: str, key: str = "url") -> DataFrame:
    """Known rows keep their stored date (today if they have none), new ones the date that they were read with."""
    old = stored.select(key, F.col("date").alias("__date"), F.lit(True).alias("__known"))
    date = F.when(F.col("__known"), F.coalesce(F.nullif("__date", F.lit("")), F.lit(today))).otherwise(F.col("date"))
    return seen.join(old, key, "left").withColumn("date", date).drop("__date", "__known")


def replay(sightings: DataFrame, last_run: int | None = None, key: str = "url", run: str = "run_no") -> DataFrame:
    """The state after all runs, from the sightings alone: per live key its insert run, last run and absences.

    A key's sightings fall into islands wherever more than ``MOST_ABSENCES`` runs lie between two; only the
    last one can be alive. Partitioned by key.
    """
    runs = sightings.select(key, run).where(F.col(key).isNotNull() & F.col(run).isNotNull()).distinct()
    by_key = Window.partitionBy(key).orderBy(run)
    gap = F.col(run) - F.lag(run).over(by_key)
    islands = runs.withColumn("island", F.sum(F.when(gap > MOST_ABSENCES, 1).otherwise(0)).over(by_key))
    ends = islands.groupBy(key, "island").agg(F.min(run).alias("first_run"), F.max(run).alias("seen_run"))
    last = ends.groupBy(key).agg(F.max_by(F.struct("first_run", "seen_run"), "island").alias("x")).select(key, "x.*")
    now = sightings.agg(F.max(run).alias("now")) if last_run is None else sightings.sparkSession.range(1).select(F.lit(last_run).alias("now"))
    return last.crossJoin(F.broadcast(now)).withColumn("ausencias", (F.col("now") - F.col("seen_run")).cast("int")).where(F.col("ausencias") < MOST_ABSENCES).drop("now")


def patch(stored: DataFrame, patches: DataFrame, fields: list[str], key: str = "url", kinds: dict[str, str] | None = None) -> DataFrame:
    """Fills only missing fields (null, '' or 0) from patches with one row per key; a ``price_extracted`` replaces a price on request."""
    kinds = dict(stored.dtypes) if kinds is None else kinds
    some = [c for c in fields if c in patches.columns]
    extra = ["price_extracted"] if "price_extracted" in patches.columns else []
    new = patches.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in some + extra))
    out = stored.join(new, key, "left")
    for c in some:
        empty = F.lit("") if kinds[c] == "string" else F.lit(0)
        out = out.withColumn(c, F.when(F.col(c).isNull() | (F.col(c) == empty), F.coalesce(F.col(f"__{c}"), F.col(c))).otherwise(F.col(c)))
    if extra:
        asked = F.contains(F.lower(F.coalesce("price", F.lit(""))), F.lit("consultar")) & F.col("__price_extracted").isNotNull()
        out = out.withColumn("price", F.when(asked, F.col("__price_extracted")).otherwise(F.col("price")))
    return out.drop(*(f"__{c}" for c in some + extra))
