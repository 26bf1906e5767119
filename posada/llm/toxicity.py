"""Toxicity by cumulative-link ordinal regression.

A text's features are its lower-case words and their first four, five and six bytes, hashed, with the logarithm of their counts. One weight vector is
shared by all thresholds: P(grade <= k) is the logistic function of threshold k less the weighted sum, with
thresholds in ascending order. The output is the expected severity, the sum over k of P(grade > k).

Labels tell toxic from clean only. Grades are derived from them on the training rows: 0 for clean rows, and for
toxic ones 1 or 2 as they hold fewer or more of the words that set the toxic rows apart than their median.
The model is fitted on at most ``TRAIN_ROWS`` labelled rows by stochastic gradient descent in numpy;
scoring is one pass without a shuffle with a table of fixed size.

Null and empty texts have no features and get the severity of the thresholds alone. Labels that are null, not 0 or 1,
or of no document are left out; of an id's labels the greatest counts. Texts of any length are scored whole. Repeated rows
score alike, rows without an id are scored too, and an empty table gives an empty one. Columns other than id and text are
ignored. Without labels of both kinds every text gets one severity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .quality import counted, fold, training_rows

TRAIN_ROWS = 10_000
BUCKETS = 1 << 18
EPOCHS = 12
RATE = 0.15
#: Cost of weight (of its absolute value) at each visit, which keeps the features of few rows at zero.
SPARSE = 0.002
#: Features seen in fewer training rows get no weight.
LEAST_ROWS = 5


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = textops.LOWER[data]
    starts, ends, rows = textops.words(data, offsets, textops.ALNUM)
    parts, owners = [textops.word_hashes(data, starts, ends)], [rows]
    for n in (4, 5, 6):  # stems
        long = ends - starts > n
        parts.append(textops.word_hashes(data, starts[long], starts[long] + n) ^ np.uint64(n))
        owners.append(rows[long])
    return (np.concatenate(parts) & np.uint64(BUCKETS - 1)).astype(np.int32), np.concatenate(owners).astype(np.int32)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def exceeds(self, batch: pa.RecordBatch) -> np.ndarray:
        """P(grade > k) of each text, one column per threshold."""
        buckets, owners = features(*textops.text_buffers(batch.column("text")))
        on = self.weights[buckets] != 0
        pairs, counts = np.unique(owners[on].astype(np.int64) * BUCKETS + buckets[on], return_counts=True)
        total = np.bincount(pairs // BUCKETS, self.weights[pairs % BUCKETS] * np.log1p(counts), minlength=batch.num_rows)
        return _logistic(total[:, None] - self.thresholds[None, :])


def grades(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """0 for clean rows; 1 or 2 for toxic ones by how many telling words they hold."""
    seen = np.zeros((2, BUCKETS))
    for (at, _), label in zip(rows, labels, strict=True):
        seen[label, at] += 1
    n = np.bincount(labels, minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    telling = (odds > 2) & (seen[1] >= LEAST_ROWS)
    held = np.array([count[telling[at]].sum() for at, count in rows])
    middle = np.median(held[labels == 1])
    return np.where(labels == 0, 0, np.where(held > middle, 2, 1))


def train(batches: list[pa.RecordBatch], seed: int = 1) -> Model:
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    found: list[int] = []
    for batch in textops.pieces(iter(batches)):
        rows += counted(*features(*textops.text_buffers(batch.column("text"))), batch.num_rows)
        found += batch.column("label").to_pylist()
    labels = np.array(found, np.int64)
    if len(set(found)) < 2:
        far = 4.0 if not found or not found[0] else -4.0
        return Model(np.zeros(BUCKETS, np.float32), np.array([far, far + 1]))
    grade = grades(rows, labels)
    often = np.bincount(np.concatenate([at for at, _ in rows]), minlength=BUCKETS) >= LEAST_ROWS
    rows = [(at[often[at]], np.log1p(count[often[at]])) for at, count in rows]
    share = [min(max((grade > k).mean(), 1e-4), 1 - 1e-4) for k in (0, 1)]
    first, gap = -np.log(share[0] / (1 - share[0])), 0.0  # thresholds: first and first + exp(gap)
    weights, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            total = weights[at] @ x
            t = np.array([-np.inf, first, first + np.exp(gap), np.inf])
            g = grade[i]
            low, high = (1 / (1 + np.exp(-np.clip(v - total, -40, 40))) for v in (t[g], t[g + 1]))
            p = max(high - low, 1e-9)
            d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
            # Gradients of the log-likelihood.
            slope = d_low - d_high
            step = slope * x
            squares[at] += step * step
            rate = RATE / np.sqrt(squares[at])
            moved = weights[at] + rate * step
            weights[at] = np.sign(moved) * np.maximum(np.abs(moved) - rate * SPARSE, 0)
            if g == 0:
                first += 0.02 * d_high
            elif g == 1:
                first += 0.02 * (d_high - d_low)
                gap += 0.02 * d_high * np.exp(gap)
            else:
                first -= 0.02 * d_low
                gap -= 0.02 * d_low * np.exp(gap)
            gap = min(max(gap, -3.0), 3.0)
    return Model(weights.astype(np.float32), np.array([first, first + np.exp(gap)]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, toxic_probability (grade above 0) and expected_severity (0 to 2)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches):
            p = shared.value.exceeds(batch)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p[:, 0], pa.float64()), pa.array(p.sum(axis=1), pa.float64())], ["id", "p", "severity"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, p double, severity double")
    return found.toDF(id_col, "toxic_probability", "expected_severity")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, held_out, expected_severity, score (probability of any toxicity), predicted. Labels of held-out ids are not learned from."""
    held = fold(id_col, 4, 2) if held_out is None else held_out
    model = train(training_rows(docs, labels.where(~held), "toxic", TRAIN_ROWS, id_col, text_col))
    textops.release(collect=True)
    found = score(docs, model, id_col, text_col)
    return found.select(id_col, held.alias("held_out"), "expected_severity", F.col("toxic_probability").alias("score"), F.when(F.col("toxic_probability") >= threshold, 1).otherwise(0).alias("predicted"))
