"""Connected components of a graph given as a DataFrame of edges, by alternating star operations.

Every task first contracts its own edges, at most ``ROWS_A_TASK`` at a time, to stars. Where all that is left fits one
such piece, one more contraction is the answer; only larger graphs need rounds.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses the cluster's spark.checkpoint.dir; sets a folder of its own only where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-"))


#: Rows of a small table that one task reads.
ROWS_A_TASK = 250_000


def counted(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows as ``settled`` gives them, and their number. A core counts its share in one task, as a task for each of many small partitions is work for the driver."""
    ensure_checkpoints(rows.sparkSession)
    out = rows.checkpoint()
    n = out.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)).count()
    return out.coalesce(max(1, -(-n // ROWS_A_TASK))), n


def settled(rows: DataFrame) -> DataFrame:
    """The rows without their lineage, on as many partitions as their number asks for, so that shuffles of few rows write few files."""
    return counted(rows)[0]


def tidy(spark: SparkSession) -> None:
    """Between rounds: the driver lets go of the plans that are done with, and its JVM then drops their shuffles, broadcasts and checkpoints and gives memory back."""
    textops.release(collect=True)
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for tables between steps."""
    ensure_checkpoints(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(rows: DataFrame) -> DataFrame:
    """The rows without their lineage, as a compressed table in the shared folder that goes when the session ends."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)


def _stars(edges: DataFrame, tasks: int) -> DataFrame:
    """Every node's larger neighbours are linked to its least neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").where("m < v").select(F.col("m").alias("u"), "v").coalesce(tasks).distinct().coalesce(tasks)


def _small_stars(edges: DataFrame, tasks: int) -> DataFrame:
    """Every node's smaller neighbours and the node are linked to the least of them. Edges have u < v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
    return moved.where("a < b").select(F.col("a").alias("u"), F.col("b").alias("v")).coalesce(tasks).distinct().coalesce(tasks)


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges and the least node that each is connected with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        # a and b are roots: each is hooked to the least smaller one that it has an edge with.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _contracted(edges: DataFrame, loops: bool = False) -> DataFrame:
    """Stars (u, v) that connect the same nodes as the edges: of each piece of a partition, every node v with the least one u that it is connected with there. loops: the least ones with themselves, too."""
    most = ROWS_A_TASK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def star() -> pa.RecordBatch:
            part = pa.Table.from_batches(held)
            held.clear()
            nodes, least = least_nodes(part.column("u").to_numpy(), part.column("v").to_numpy())
            on = np.ones(len(nodes), bool) if loops else nodes != least
            return pa.RecordBatch.from_arrays([pa.array(least[on], pa.int64()), pa.array(nodes[on], pa.int64())], ["u", "v"])

        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, most - sum(b.num_rows for b in held))
                held.append(some)
                batch = batch.slice(some.num_rows)
                if sum(b.num_rows for b in held) == most:
                    yield star()
        if held:
            yield star()

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (u, v), 64-bit numbers; the component is its least node.

    Beyond ``ROWS_A_TASK`` edges it needs a number of rounds logarithmic in the number of nodes; each is two shuffles of the
    edges. Rows with nulls and loops are dropped, an empty table gives an empty one. Raises where ``rounds`` do not suffice.
    """
    now, n = counted(_contracted(edges.where("u != v").select(F.col("u").cast("long"), F.col("v").cast("long"))))
    if n <= ROWS_A_TASK:
        return _contracted(now, loops=True).select(F.col("v").alias("node"), F.col("u").alias("component"))
    now, n = counted(now.distinct())
    tasks, before = max(1, -(-n // ROWS_A_TASK)), None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            own = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct().coalesce(tasks)
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(own)
        before = mark
        now = _small_stars(_stars(now, tasks), tasks).checkpoint()
    raise RuntimeError(f"components did not settle in {rounds} rounds")
