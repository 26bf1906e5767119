"""Vector code compression: product codebooks in whole numbers, nearest entries by a GNAT over each codebook.

Components become floor(1024 x), so that every distance, sum and mean is exact and results don't depend on how Spark deals
out the rows. A codebook is a table of at most 256 entries; the nearest entry of a part is looked for in a geometric
near-neighbour access tree over the entries: a node has split points, every other entry lies with its nearest split
point, and for each split point and each child the node keeps the range of distances from the one to the entries of
the other. A query at distance d of a split point whose best entry so far is r away leaves out a child when d - r is
greater than the greatest or d + r less than the least distance of the range, strictly: square roots are rounded towards
keeping the child, and what decides between entries are squared distances in whole numbers, ties to the lower index.

Each round is one pass over the vectors without a shuffle of them: tasks return one row of counts and sums for each entry, at most
1,024 rows. Codebooks go to the tasks as broadcasts of a few hundred KB.

Rows whose vector is null or has a null or non-finite component are dropped. All vectors are taken to have the length of
the first kept one (by id, nulls last); vectors of other lengths are dropped as well. Vectors whose length is no multiple
of the number of parts are filled up with zeros. Components are held within +-``limit`` (2^27 for 64 components), so that
squared distances always fit in 64 bits; that is far beyond any embedding. Rows without an id are coded, but start no codebook
unless there are too few others; repeated rows are coded each for itself. A table without kept vectors gives no row. Sums of
errors over a label that exceed 64 bits are null. Columns other than id, vector and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .components import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a node of the tree, and entries that a leaf may have.
SPLITS, LEAF = 16, 24
#: Vectors that are coded in one go.
BLOCK = 4096
#: Sums of at most so much are exact in the float arithmetic of matrix products.
EXACT = 1 << 52
#: Labels up to which their sums of errors are broadcast; beyond, they are joined with ``SALTS`` shares of the rows of a label.
BROADCAST_LABELS, SALTS = 100_000, 32


def limit(dimension: int) -> int:
    """The greatest magnitude of a component with which squared distances stay below 2^62."""
    return isqrt((1 << 62) // max(dimension, 1)) // 2


def squared(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, exact: by a matrix product where its sums are small enough, else difference by difference."""
    most = max(int(np.abs(queries).max(initial=0)), int(np.abs(points).max(initial=0)))
    if 4 * most * most * max(points.shape[1], 1) <= EXACT:
        q, p = queries.astype(np.float64), points.astype(np.float64)
        return ((q * q).sum(axis=1)[:, None] - 2 * (q @ p.T) + (p * p).sum(axis=1)).astype(np.int64)
    out = np.empty((len(queries), len(points)), np.int64)
    for j, point in enumerate(points):
        off = queries - point
        out[:, j] = (off * off).sum(axis=1)
    return out


def root_below(x: np.ndarray) -> np.ndarray:
    """A number that is at most the square root."""
    return np.nextafter(np.nextafter(np.sqrt(x.astype(np.float64)), -1), -1)


def root_above(x: np.ndarray) -> np.ndarray:
    """A number that is at least the square root."""
    return np.nextafter(np.nextafter(np.sqrt(x.astype(np.float64)), np.inf), np.inf)


class Gnat:
    """The tree over some entries of a codebook: a leaf has entries only; a node has split points, children and ranges."""

    def __init__(self, entries: np.ndarray, index: np.ndarray):
        self.children: list[Gnat | None] = []
        self.index, self.points = index, entries[index]
        if len(index) <= LEAF:
            return
        chosen = self._splits()
        own = squared(self.points, self.points[chosen])
        rest = np.setdiff1d(np.arange(len(index)), chosen)
        if not own[rest].max(initial=0):
            return  # nothing but copies of one point
        nearest = own[rest].argmin(axis=1)
        self.low, self.high = np.full((len(chosen), len(chosen)), np.inf), np.full((len(chosen), len(chosen)), -np.inf)
        for j in range(len(chosen)):
            inside = rest[nearest == j]
            if len(inside):
                self.low[:, j], self.high[:, j] = root_below(own[inside].min(axis=0)), root_above(own[inside].max(axis=0))
            self.children.append(Gnat(entries, index[inside]) if len(inside) else None)
        self.index, self.points = index[chosen], self.points[chosen]

    def _splits(self) -> np.ndarray:
        """Split points that lie apart: the first entry, then again and again the one farthest from those chosen."""
        chosen = [0]
        away = squared(self.points, self.points[:1])[:, 0]
        while len(chosen) < SPLITS and away.max():
            chosen.append(int(away.argmax()))
            away = np.minimum(away, squared(self.points, self.points[chosen[-1:]])[:, 0])
        return np.array(chosen)

    def search(self, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, entry: np.ndarray) -> int:
        """Improves (best squared distance, entry) of the given rows of the queries; returns how many distances it took."""
        d = squared(queries[rows], self.points)
        least = d.min(axis=1)
        # Of equally near entries the one of the lowest index; as whole numbers, so that there is no doubt about ties.
        lowest = np.where(d == least[:, None], self.index, ENTRIES * ENTRIES).min(axis=1)
        better = (least < best[rows]) | ((least == best[rows]) & (lowest < entry[rows]))
        best[rows[better]], entry[rows[better]] = least[better], lowest[better]
        taken = d.size
        if not self.children:
            return taken
        below, above, nearest = root_below(d), root_above(d), d.argmin(axis=1)
        for near in (True, False):  # first the child in which the nearest split point is, so that the best distance is small for the others
            for j, child in enumerate(self.children):
                if child is None:
                    continue
                ask = np.flatnonzero((nearest == j) == near)
                reach = root_above(best[rows[ask]])[:, None]
                out = ((below[ask] - reach > self.high[:, j]) | (above[ask] + reach < self.low[:, j])).any(axis=1)
                if not out.all():
                    taken += child.search(queries, rows[ask[~out]], best, entry)
        return taken


class Codebooks:
    """The entries of every part (parts, entries, width) with a tree over each."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.trees = [Gnat(part, np.arange(len(part))) for part in entries]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each part of each vector; vectors are (rows, parts, width)."""
        entry = np.full(vectors.shape[:2], ENTRIES * ENTRIES, np.int64)
        best = np.full(vectors.shape[:2], np.iinfo(np.int64).max, np.int64)
        rows = np.arange(len(vectors))
        for p, tree in enumerate(self.trees):
            b, e = best[:, p].copy(), entry[:, p].copy()
            tree.search(np.ascontiguousarray(vectors[:, p]), rows, b, e)
            best[:, p], entry[:, p] = b, e
        return entry, best

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_numbers(column: pa.Array, dimension: int, parts: int) -> np.ndarray:
    """floor(1024 x) of the vectors, as (rows, parts, width)."""
    flat = np.asarray(pc.list_flatten(column).to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dimension)
    most = limit(dimension)
    with np.errstate(over="ignore"):
        ints = np.clip(np.floor(SCALE * flat), -most, most).astype(np.int64)
    width = -(-dimension // parts)
    out = np.zeros((len(ints), parts * width), np.int64)
    out[:, :dimension] = ints
    return out.reshape(len(column), parts, width)


def kept(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector is there and has finite components only."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col(vector_col).isNotNull() & ~F.exists(F.col(vector_col).cast("array<double>"), bad))


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            block = batch.slice(at, BLOCK)
            yield block, whole_numbers(block.column("vector"), dimension, parts)
    textops.release()


def refined(vectors: DataFrame, books: Codebooks, dimension: int) -> Codebooks:
    """The codebooks after one round: every entry is the floor of the mean of the parts nearest to it; one without parts stays."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.entries.shape
    sums = [f"s{i}" for i in range(width)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for _, ints in _blocks(batches, dimension, parts):
            found, _ = shared.value.nearest(ints)
            slot = (found + np.arange(parts) * entries).ravel()
            count += np.bincount(slot, minlength=len(count))
            np.add.at(total, slot, ints.reshape(len(slot), width))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(count[used]), *(pa.array(total[used, i]) for i in range(width))], ["slot", "n", *sums])

    partial = vectors.select("vector").mapInArrow(assign, ", ".join(f"{c} long" for c in ("slot", "n", *sums)))
    found = partial.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums)).toArrow()
    out = books.entries.reshape(parts * entries, width).copy()
    slots, n = found["slot"].to_numpy(), found["n"].to_numpy()
    for i, s in enumerate(sums):
        out[slots, i] = found[s].to_numpy() // n
    shared.unpersist()
    return Codebooks(out.reshape(books.entries.shape))


def trained(vectors: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> tuple[Codebooks, int] | None:
    """The codebooks, and the vectors' length, for rows (id, vector) of which the least ids start the codebooks; None without rows."""
    first = vectors.select("id", "vector").orderBy(F.asc_nulls_last("id"), "vector").limit(entries).toArrow()
    if not first.num_rows:
        return None
    column = first["vector"].combine_chunks()
    dimension = len(column[0])
    alike = vectors.where(F.size("vector") == dimension)
    if not pc.all(pc.equal(pc.list_value_length(column), dimension)).as_py():
        column = alike.select("vector", "id").orderBy(F.asc_nulls_last("id"), "vector").limit(entries).toArrow()["vector"].combine_chunks()
    books = Codebooks(np.ascontiguousarray(whole_numbers(column, dimension, parts).transpose(1, 0, 2)))
    for _ in range(rounds):
        books = refined(alike, books, dimension)
    return books, dimension


def coded(vectors: DataFrame, books: Codebooks, dimension: int) -> DataFrame:
    """The rows (id, label, vector) as (id, label, code, error): the parts' entries as two hex digits each, and the sum of their squared distances."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    parts = len(books.entries)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ints in _blocks(batches, dimension, parts):
            found, away = shared.value.nearest(ints)
            codes = [row.tobytes().hex() for row in found.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([block.column("id"), block.column("label"), pa.array(codes, pa.string()), pa.array(away.sum(axis=1))], ["id", "label", "code", "error"])

    kinds = vectors.schema
    out = f"id {kinds['id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, code string, error long"
    return vectors.where(F.size("vector") == dimension).select("id", "label", "vector").mapInArrow(code, out)


def decoded(codes: DataFrame, books: Codebooks, dimension: int, code_col: str = "code") -> DataFrame:
    """The rows with the vector that a code stands for, as a further column ``decoded``."""
    table = F.array(*(F.array(*(F.array(*(F.lit(int(x) / SCALE) for x in entry)) for entry in part)) for part in books.entries))
    at = lambda p: F.conv(F.substr(F.col(code_col), F.lit(2 * p + 1), F.lit(2)), 16, 10).cast("int")
    return codes.withColumn("decoded", F.slice(F.concat(*(table[p][at(p)] for p in range(len(books.entries)))), 1, dimension))


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """Per kept vector: the id, code, error, label_error (the errors of all vectors of its label together) and codebooks_sha256."""
    vectors = kept(rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")), "vector")
    model = trained(vectors, rounds)
    if model is None:
        return vectors.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = stored(coded(vectors, *model))
    sums = codes.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        met = codes.join(F.broadcast(sums.withColumnRenamed("label", "of")), F.col("label").eqNullSafe(F.col("of")))
    else:
        salted = codes.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)))
        shares = sums.withColumnRenamed("label", "of").withColumn("share", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        met = salted.join(shares, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("share")))
    return met.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(model[0].digest()).alias("codebooks_sha256"))
