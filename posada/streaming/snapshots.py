"""A stream of run snapshots merged into the accumulated table, with the state of every URL in the state store.

Each URL's listing and its last run lie in a keyed state (``transformWithState``), so that a run touches the URLs that it has seen
and no others: those go to a log of changes, one folder a batch. A timer by run number takes a URL out of the state once it has been absent for
``MOST_ABSENCES`` runs. Run numbers are the clock of the stream: absences are the runs by number since the last sighting, and a run that is no later
than the last one of the batches before is late and ignored, as is one that comes again. A batch that is retried writes its folder anew.

``current`` reads the last base and the changes after it; after ``CHANGES_A_BASE`` batches they become a new base. Of rows of one
URL in a run the one that is greatest as JSON counts. Rows without a URL or a run are dropped; runs are numbered from 0.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from posada.operators.merge import MOST_ABSENCES
from posada.schema import LISTING

#: Batches of changes after which a new base is written, and bases that are kept.
CHANGES_A_BASE, BASES = 16, 2
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A run is a second of the stream's clock.
RUN_MS = 1000
CHANGE = StructType([*LISTING.fields, StructField("seen_run", LongType())])
#: What changes of a listing that is seen again.
UPDATED = ("price", "description")


class Lifecycle(StatefulProcessor):
    """One URL's listing over the runs."""

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.listing = handle.getValueState("listing", CHANGE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        seen: dict[int, Row] = {}
        for row in rows:
            if row["run_no"] not in seen or row["as_json"] > seen[row["run_no"]]["as_json"]:
                seen[row["run_no"]] = row
        now = dict(zip(CHANGE.names, self.listing.get(), strict=True)) if self.listing.exists() else None
        for run in sorted(seen):
            found = seen[run].asDict()
            if now is None or run - now["seen_run"] > MOST_ABSENCES:  # gone in between
                now = {c: found[c] for c in LISTING.names}
            elif run <= now["seen_run"]:
                continue
            else:
                now |= {c: found[c] for c in UPDATED}
            now["seen_run"] = run
        now["ausencias"] = 0
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((now["seen_run"] + 1 + MOST_ABSENCES) * RUN_MS)
        values = tuple(now[c] for c in CHANGE.names)
        self.listing.update(values)
        yield Row(*CHANGE.names)(*values)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        self.listing.clear()
        return iter(())

    def close(self) -> None:
        pass


def start(snapshots: DataFrame, root: str, checkpoint: str):  # noqa: ANN201
    """Merges a stream of listings with ``run_no`` into the table under ``root``. The query stops when all that is there is read."""
    spark = snapshots.sparkSession
    clock = F.timestamp_millis((F.col("run_no") + 1) * RUN_MS)  # time 0 is where the watermark begins
    names = snapshots.columns
    rows = snapshots.where("url is not null and run_no is not null").withColumns({"as_json": F.to_json(F.struct(*names)), "at": clock})
    merged = rows.withWatermark("at", "0 seconds").groupBy("url").transformWithState(Lifecycle(), CHANGE, outputMode="Update", timeMode="EventTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes={number}")
        if (number + 1) % CHANGES_A_BASE == 0:
            compact(spark, root, number)

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return merged.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _whole(spark: SparkSession, root: str, kind: str) -> list[int]:
    """The numbers of the folders of a kind that are whole."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(path) if fs.exists(path) else []
    return sorted(int(s.getPath().getName().split("=")[1]) for s in found if s.getPath().getName().startswith(f"{kind}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def _latest(spark: SparkSession, root: str) -> DataFrame:
    """The last change of every URL that is in the base or in the changes after it."""
    base = max(_whole(spark, root, "base"), default=None)
    parts = [] if base is None else [(-1, f"{root}/base={base}")]
    parts += [(n, f"{root}/changes={n}") for n in _whole(spark, root, "changes") if base is None or n > base]
    rows = spark.createDataFrame([], StructType([*CHANGE.fields, StructField("batch", LongType())]))
    for n, path in parts:
        rows = rows.unionByName(spark.read.schema(CHANGE).parquet(path).withColumn("batch", F.lit(n).cast("long")))
    return rows.groupBy("url").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "batch")), "batch").alias("one")).select("one.*")


def _alive(rows: DataFrame, last: int | None) -> DataFrame:
    absences = (F.lit(last).cast("long") - F.col("seen_run")).cast("int")
    return rows.withColumn("ausencias", absences).where(F.col("ausencias") < MOST_ABSENCES)


def compact(spark: SparkSession, root: str, number: int) -> None:
    """Writes the living listings up to a batch as a base, and forgets older bases and the changes that they have."""
    rows = _latest(spark, root)
    _alive(rows, rows.agg(F.max("seen_run")).first()[0]).write.mode("overwrite").parquet(f"{root}/base={number}")
    bases = _whole(spark, root, "base")
    old = [f"base={n}" for n in bases[:-BASES]] + [f"changes={n}" for n in _whole(spark, root, "changes") if len(bases) >= BASES and n <= bases[-BASES]]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in old:
        path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(f"{root}/{name}"), True)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The table after the last run: the listings that are alive, with their absences."""
    rows = _latest(spark, root)
    last = rows.agg(F.max("seen_run")).first()[0]
    return _alive(rows, last).select(*LISTING.names)
