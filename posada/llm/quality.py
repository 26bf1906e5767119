"""Quality classifier on supervised subword embeddings.

Every word and every run of three or four bytes of a word (its borders included) is hashed to a bucket with a
vector; a document is the mean of the vectors of its features, and a softmax over two classes gives the score.
Vectors and output weights are learned by stochastic gradient descent in numpy, on a sample of at most
``TRAIN_ROWS`` labelled rows (those of the least hashes of their ids). Only the text enters a score.

Scoring is one pass without a shuffle: as the output is linear in the mean, each bucket's vector is first
multiplied with the output weights, and a fixed table of one number per bucket is broadcast.

Null and empty texts have no features and get the score of the bias alone. Labels that are null or belong to
no document are left out, of an id's labels the greatest counts; without any label of one class every score is that of
the prior. Texts of any length are scored whole. Repeated rows score alike, rows without an id are scored too, and an
empty table gives an empty one. ``score`` and ``keep_good`` keep the documents' columns; one named like the score is
replaced by ``score``. Runs are of bytes, so that a letter beyond ASCII counts as two or three.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .samples import least_hashes

TRAIN_ROWS = 6000
BUCKETS = 1 << 18
DIMENSIONS = 12
EPOCHS = 6
RATE = 0.4
_CODE = textops.mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and of every run of 3 or 4 bytes within a word and its borders."""
    starts, ends, rows = textops.words(data, offsets, textops.NON_BLANK)
    buckets = [(textops.word_hashes(data, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int32)]
    owners = [rows.astype(np.int32)]
    inside = textops.NON_BLANK[data]
    code = np.where(inside, _CODE[data], np.uint32(0x9E3779B1))
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for n in (3, 4):
        m = len(data) - n + 1
        if m <= 0:
            continue
        value = np.full(m, n, np.uint32)
        ok = owner[:m] == owner[n - 1 :]
        for j in range(n):
            value = (value ^ code[j : m + j]) * np.uint32(0x85EBCA6B)
            value ^= value >> np.uint32(13)
            if 0 < j < n - 1:
                ok &= inside[j : m + j]
        buckets.append((value[ok] & np.uint32(BUCKETS - 1)).astype(np.int32))
        owners.append(owner[:m][ok])
    return np.concatenate(buckets), np.concatenate(owners)


def counted(buckets: np.ndarray, owners: np.ndarray, n_rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets and their counts of each row."""
    order = np.argsort(owners, kind="stable")
    cuts = np.cumsum(np.bincount(owners, minlength=n_rows))[:-1]
    return [np.unique(part, return_counts=True) for part in np.split(buckets[order], cuts)]


class Model:
    """Bucket weights and a bias: the score is the logistic function of the bias and the mean weight of a text's features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        buckets, owners = features(*textops.text_buffers(batch.column("text")))
        n = np.bincount(owners, minlength=batch.num_rows)
        total = np.bincount(owners, self.weights[buckets], minlength=batch.num_rows)
        return 1 / (1 + np.exp(-(self.bias + total / np.maximum(n, 1))))


def train(batches: list[pa.RecordBatch], seed: int = 1) -> Model:
    """Fits to batches with the columns text and label (0 or 1)."""
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    labels: list[int] = []
    for batch in textops.pieces(iter(batches)):
        rows += counted(*features(*textops.text_buffers(batch.column("text"))), batch.num_rows)
        labels += batch.column("label").to_pylist()
    share = (sum(labels) + 1) / (len(labels) + 2)
    bias = np.log(share / (1 - share))
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(bias))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output = rng.normal(0, 0.1, (2, DIMENSIONS)).astype(np.float32)
    biases = np.array([0.0, bias], np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = RATE * (1 - done / steps)
            done += 1
            at, count = rows[i]
            if not len(at):
                continue
            share = (count / count.sum()).astype(np.float32)
            hidden = share @ vectors[at]
            out = output @ hidden + biases
            p = np.exp(out - out.max())
            p /= p.sum()
            p[labels[i]] -= 1
            step = p @ output
            output -= rate * np.outer(p, hidden)
            biases -= 0.1 * rate * p
            # The mean's gradient reaches each vector by its share; scaled up so that long texts still move their rare features.
            vectors[at] -= (rate * np.sqrt(len(at))) * share[:, None] * step
    return Model((vectors @ (output[1] - output[0])).astype(np.float32), float(biases[1] - biases[0]))


def fold(id_col: str, parts: int, at: int) -> Column:
    """Whether the id's CRC-32, as text, leaves the remainder ``at``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == at, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> list[pa.RecordBatch]:
    """At most ``rows`` labelled texts, those of the least hashes of their ids, as Arrow batches of text and label."""
    some = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and __id is not null")
    some = least_hashes(some.groupBy("__id").agg(F.max("label").alias("label")), "__id", rows)
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "__id")
    return found.sort(F.xxhash64("__id"), "__id").limit(rows).select("text", "label").toArrow().to_batches()


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    model = train(training_rows(docs, labels, label_col, rows, id_col, text_col))
    textops.release(collect=True)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", output: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The rows (their columns ``keep``, by default all) with the score of their whole text as a further column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if keep is None else keep) if c != output]
    texts = docs.select(*(docs[c] for c in names if c != text_col), docs[text_col].cast("string").alias(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches, text_col):
            scores = shared.value.scores(pa.RecordBatch.from_arrays([batch.column(text_col)], ["text"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64())], [*names, output])

    kinds = {c: "string" if c == text_col else docs.schema[c].dataType.simpleString() for c in names}
    return texts.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", `{output}` double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, held_out, score, predicted. Labels of held-out ids are not learned from."""
    held = fold(id_col, 4, 2) if held_out is None else held_out
    model = fit(docs, labels.where(~held), id_col=id_col, text_col=text_col)
    scored = score(docs, model, text_col, keep=[id_col])
    return scored.select(id_col, held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents whose score reaches the threshold."""
    columns = docs.columns
    return score(docs, fit(docs, labels, **options), output="__score").where(F.col("__score") >= threshold).select(*columns)
