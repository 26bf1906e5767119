import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from posada.llm import vector_codes
from posada.llm.vector_codes import Codebooks, Gnat, compress, decoded, kept, squared, trained

ROWS = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, rounds=4):
    """The definition in plain Python, for vectors of one length that is a multiple of four."""
    good = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not good:
        return []
    w = len(good[0][1]) // 4
    cut = lambda v: [tuple(v[p * w : (p + 1) * w]) for p in range(4)]
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(4)]

    def assign(v):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p])) for p, x in enumerate(cut(v))]

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in good:
            for p, (_, k) in enumerate(assign(v)):
                groups[p, k].append(cut(v)[p])
        for (p, k), members in groups.items():
            books[p][k] = tuple(sum(c) // len(members) for c in zip(*members, strict=True))
    digest = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{k:02x}" for _, k in assign(v)), sum(d for d, _ in assign(v)), label) for i, v, label in good]
    total = defaultdict(int)
    for _, _, e, label in out:
        total[label] += e
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=repr)


def coded_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


points = st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=1, max_size=200)


@settings(max_examples=60, deadline=None)
@given(points, points)
def test_tree_finds_the_nearest_entry_and_the_lowest_of_ties(entries, queries):
    e, q = np.array(entries), np.array(queries)
    best, found = np.full(len(q), np.iinfo(np.int64).max), np.full(len(q), 1 << 40)
    Gnat(e, np.arange(len(e))).search(q, np.arange(len(q)), best, found)
    d = ((q[:, None] - e) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (found == d.argmin(axis=1)).all()


def test_tree_leaves_out_subtrees():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (16, 8))
    entries = (centres[:, None] + rng.integers(-40, 40, (16, 16, 8))).reshape(-1, 8)
    queries = entries[rng.integers(0, 256, 1000)] + rng.integers(-20, 20, (1000, 8))
    best, found = np.full(1000, np.iinfo(np.int64).max), np.full(1000, 1 << 40)
    taken = Gnat(entries, np.arange(256)).search(queries, np.arange(1000), best, found)
    assert taken < 256 * 1000 / 4
    assert (found == ((queries[:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_distances_are_exact_for_large_numbers():
    most = vector_codes.limit(4)
    q, p = np.array([[most, -most, 3, 4]]), np.array([[-most, most, 0, 0], [most, -most, 0, 0]])
    assert squared(q, p).tolist() == [[8 * most * most + 25, 25]]
    assert 4 * (2 * most) ** 2 <= 1 << 62


def test_equal_to_the_definition_on_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(0, 1, 8).round(2).tolist(), int(i) % 3) for i in rng.permutation(300)]
    rows += [(i, rows[0][1], None) for i in range(400, 440)] + [(7, rows[1][1], 1), (7, rows[1][1], 1), (None, rows[2][1], None), (None, [-0.001] * 8, 0)]
    rows += [(900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [1.0] * 7 + [float("nan")], 1), (903, [float("-inf")] + [1.0] * 7, None)]
    df = spark.createDataFrame(rows, ROWS)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert coded_rows(compress(df)) == plain_codes(single)
    assert coded_rows(compress(df.repartition(7))) == plain_codes(single)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [float("nan")], 1)]])
def test_no_kept_vectors(spark, rows):
    assert coded_rows(compress(spark.createDataFrame(rows, ROWS))) == []


def test_few_rows_null_ids_and_clashing_names(spark):
    rows = [(None, [0.5, 1.0, -1.0, 2.0], None), (None, [0.25, 1.0, -1.0, 2.0], None)]
    df = spark.createDataFrame(rows, ROWS).withColumns({n: F.lit(1) for n in ("id", "vector", "code", "error", "of", "salt", "slot", "n")})
    assert coded_rows(compress(df)) == plain_codes(rows)


def test_lengths(spark):
    rows = [(1, [0.5, 1.0, -1.0, 2.0, 3.0], 0), (2, [0.5], 0), (3, [], 0), (4, [0.5, 1.0, -1.0, 2.0, 3.5], 0)]
    assert [(r[0], r[1], r[2]) for r in coded_rows(compress(spark.createDataFrame(rows, ROWS)))] == [(1, "00000000", 0), (4, "00000100", 0)]
    assert coded_rows(compress(spark.createDataFrame([(1, [], 0), (2, [], 0)], ROWS)))[0][:3] == (1, "00000000", 0)


def test_many_labels_by_salted_join(spark, monkeypatch):
    rows = [(i, [float(i % 11), 1.0, 2.0, i / 7], None if i % 3 == 0 else i % 5) for i in range(280)]
    single = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 2)
    assert coded_rows(compress(spark.createDataFrame(rows, ROWS))) == plain_codes(single)


def test_decoded_is_the_entries(spark):
    rows = [(i, [i / 4, 1.0, -2.5, i / 8], 0) for i in range(50)]
    vectors = kept(spark.createDataFrame(rows, "id long, vector array<double>, label int"), "vector")
    books, n = trained(vectors, rounds=1)
    codes = vector_codes.coded(vectors, books, n)
    back = {r.id: r.decoded for r in decoded(codes, books, n).collect()}
    assert back == {i: v for i, v, _ in rows}  # fewer vectors than entries: nothing is lost


def test_one_codebook_for_all_sizes():
    same = Codebooks(np.zeros((4, 256, 2), np.int64))
    found, away = same.nearest(np.ones((3, 4, 2), np.int64))
    assert found.tolist() == [[0] * 4] * 3 and away.tolist() == [[2] * 4] * 3
