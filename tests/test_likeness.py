import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from posada.operators import dedup, likeness


def plain_lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        before = row[:]
        for j, b in enumerate(y):
            row[j + 1] = before[j] + 1 if a == b else max(row[j], before[j + 1])
    return row[-1]


texts = st.lists(st.text("abcñ😀", max_size=150), min_size=2, max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_lcs_is_the_longest_and_bounds_the_ratio(values):
    i, j = np.triu_indices(len(values), 1)
    found = likeness.common_subsequence(*likeness.codes_of(values), i, j)
    for a, b, n in zip(i, j, found, strict=True):
        assert n == plain_lcs(values[a], values[b])
        matched = likeness.ratio(values[a], values[b]) * (len(values[a]) + len(values[b])) / 2
        assert matched <= n + 1e-9 or not values[a] + values[b]


@settings(max_examples=60, deadline=None)
@given(texts, st.sampled_from([0.5, 0.6, 0.72, 1.0]), st.booleans())
def test_alike_pairs_are_all_those_of_the_ratio(values, least, strict):
    i, j = np.triu_indices(len(values), 1)
    reach = lambda a, b: likeness.ratio(values[a], values[b]) > least if strict else likeness.ratio(values[a], values[b]) >= least
    want = {(a, b) for p, q in zip(i.tolist(), j.tolist(), strict=True) for a, b in ((p, q), (q, p)) if reach(a, b)}
    assert set(likeness.alike_pairs(values, i, j, least, strict)) == want


def test_long_texts_are_compared_without_the_bound():
    long = "ab" * 3000
    assert set(likeness.alike_pairs([long, long[:-2], "x"], np.array([0, 0]), np.array([1, 2]), 0.9)) == {(0, 1), (1, 0)}


def levenshtein(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        before, row = row, [i]
        for j, b in enumerate(y, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
    return row[-1]


@pytest.mark.parametrize("least", [0.5, 0.72, 0.9])
def test_gram_candidates_lose_no_pair(spark, least, monkeypatch):
    monkeypatch.setattr(likeness, "BLOCK", 16)
    monkeypatch.setattr(likeness, "FREQUENT", 5)
    rng = np.random.default_rng(4)
    words = ["", "a", "ab", "abc", "casa azul junto al mar", "casa verde junto al rio", "ñandú 😀 grande"]
    rows = set()
    while len(rows) < 150:
        t = list(words[rng.integers(len(words))])
        for _ in range(rng.integers(0, 5)):
            at = int(rng.integers(0, len(t) + 1))
            t[at : at + int(rng.integers(0, 2))] = [] if rng.random() < 0.3 else [str(rng.choice(list("abcde ")))]
        rows.add(("".join(t), str(rng.integers(0, 2))))
    rows = sorted(rows)
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(rows)], "value long, title string, price string")
    want = {(i, j) for i, (x, p) in enumerate(rows) for j, (y, q) in enumerate(rows) if i != j and p == q and 1 - levenshtein(x, y) / max(len(x), len(y), 1) >= least}
    found = [tuple(r) for r in likeness.near_by_edits(df, least).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_work_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 8)
    monkeypatch.setattr(dedup, "PAIRS_A_TASK", 50)
    values = spark.range(200).select(F.col("id").alias("value"), F.lit("9").alias("price"), F.concat(F.lit("house number "), F.col("id").cast("string")).alias("title"), F.lit("").alias("place"))
    assert dedup.like_values(values, 0.99).rdd.getNumPartitions() > 20


def test_no_values(spark):
    none = spark.createDataFrame([], "value long, price string, title string, place string")
    assert dedup.like_values(none, 0.72).collect() == [] and dedup.like_values_native(none, 0.72).collect() == []
