import math
import re
import zlib
from collections import Counter

import numpy as np

from posada.llm import quality, toxicity
from posada.llm.queries import op2_toxicity, op5_quality


def auc(scores, labels):
    s, y = np.array(scores), np.array(labels)
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def held_out_auc(spark, sf, query, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    some = [r for r in rows if r.held_out and r.doc_id in labels]
    return auc([r.score for r in some], [labels[r.doc_id] for r in some])


def test_quality_on_held_out_rows(spark):
    assert held_out_auc(spark, "/root/testdata/sf0.01", op5_quality, "quality") > 0.7


def test_toxicity_on_held_out_rows(spark):
    assert held_out_auc(spark, "/root/testdata/sf0.01", op2_toxicity, "toxic") > 0.7


EDGE = [(1, None), (2, ""), (3, " \n"), (4, "x" * 100_000), (5, "good words here"), (5, "good words here"), (None, "a")]


def test_edge_cases(spark):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string").selectExpr("*", "0.5 as score", "1 as label")
    for rows in ([(1, 1, None), (5, 0, 1), (None, 1, 0), (77, None, 1)], []):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert quality.classify(docs, labels).count() == toxicity.classify(docs, labels).count() == len(EDGE)
    got = quality.classify(docs, labels).collect()
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.classify(docs.where("false"), labels).count() == toxicity.classify(docs.where("false"), labels).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = quality.fold("doc_id", 4, 2)
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda x: {r.doc_id: round(r.score, 9) for r in quality.classify(docs, x).collect()}
    assert scores(labels) == scores(turned)


def test_thresholds_ascend_and_severity_is_in_range(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(quality.training_rows(docs, labels, "toxic", 500))
    assert model.thresholds[0] < model.thresholds[1]
    rows = toxicity.score(docs, model).collect()
    assert all(0 <= r.expected_severity <= 2 and r.expected_severity >= r.toxic_probability for r in rows)


def word_hash(word):
    data = np.frombuffer(word, np.uint8)
    return int(quality.textops.word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def slow_quality(model, text):
    """Word by word and run by run, in plain Python."""
    data, total, n = text.encode(), 0.0, 0
    for w in re.findall(rb"[^\x20\x09-\x0D]+", data):
        total, n = total + float(model.weights[word_hash(w) & (quality.BUCKETS - 1)]), n + 1
    blank = b"\x20\x09\x0a\x0b\x0c\x0d"
    code = [0x9E3779B1 if b in blank else int(quality._CODE[b]) for b in data]
    for size in (3, 4):
        for i in range(len(data) - size + 1):
            if any(b in blank for b in data[i + 1 : i + size - 1]):
                continue
            value = size
            for c in code[i : i + size]:
                value = ((value ^ c) * 0x85EBCA6B) & 0xFFFFFFFF
                value ^= value >> 13
            total, n = total + float(model.weights[value & (quality.BUCKETS - 1)]), n + 1
    return 1 / (1 + math.exp(-(model.bias + total / max(n, 1))))


def slow_severity(model, text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    counts = Counter()
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", low):
        counts[word_hash(w) & (toxicity.BUCKETS - 1)] += 1
        for n in (4, 5, 6):
            if len(w) > n:
                counts[(word_hash(w[:n]) ^ n) & (toxicity.BUCKETS - 1)] += 1
    total = sum(float(model.weights[b]) * math.log1p(n) for b, n in counts.items())
    return [1 / (1 + math.exp(-max(-40, min(40, total - t)))) for t in model.thresholds]


def test_scores_equal_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text[:1500]) for r in docs.limit(25).collect()] + [(-1, ""), (-2, "É x\ty"), (-3, "ab" * 700)]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    good, toxic = quality.fit(docs, labels, rows=300), toxicity.train(quality.training_rows(docs, labels, "toxic", 300))
    got = {r.doc_id: r.score for r in quality.score(some, good).collect()}
    severe = {r.doc_id: (r.toxic_probability, r.expected_severity) for r in toxicity.score(some, toxic).collect()}
    for i, text in rows:
        assert math.isclose(got[i], slow_quality(good, text), rel_tol=1e-4)
        above = slow_severity(toxic, text)
        assert np.allclose(severe[i], (above[0], sum(above)), rtol=1e-4)
