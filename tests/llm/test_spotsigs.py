import hashlib
import re

from posada.llm import spotsigs
from posada.llm.queries import op6_spotsigs

WORD = re.compile(r"[^\W_]+")


def sigs(text):
    """Signatures as tuples of words."""
    w = WORD.findall(text.lower())
    a = set(spotsigs.ANCHORS)
    out = set()
    for i, x in enumerate(w[:-1]):
        if x in a and w[i + 1] not in a:
            out.add((x, w[i + 1], next((y for y in w[i + 2 : i + 2 + spotsigs.REACH] if y not in a), "")))
    return out or {(x,) for x in w}


def near(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for (i, t), (_, n) in zip(rows, [*rows[1:], rows[0]], strict=True):
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), near(sigs(t), sigs(e)), near(sigs(t), sigs(n)), len(sigs(t)), len(sigs(e)))
    return out


def digest(df):
    count = lambda f: len(f.split(",")) if f else 0
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next, count(r.fingerprint), count(r.edited_fingerprint)) for r in df.collect()}


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op6_spotsigs(spark, sf)
    assert digest(got) == brute(rows)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edge_cases(spark):
    rows = [(-5000, "The house of cards"), (-1, None), (0, ""), (3, "no anchors"), (255, "x"), (256, "The house of cards"), (70000, "the the the"), (9_000_000, "Das Haus und der große Hund " * 50), (1 << 40, "…!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as span", "1 as guest", "2 as sigs")
    got = spotsigs.compare_with_next(df)
    assert digest(got) == brute(rows)
    prints = {r.doc_id: r.fingerprint for r in got.collect()}
    assert prints[-5000] == prints[256] and prints[0] == prints[-1] == ""
    one = df.where("doc_id = 3")
    assert spotsigs.compare_with_next(one).first().near_next == 1.0
    assert spotsigs.compare_with_next(df.where("false")).count() == 0
    assert spotsigs.compare_with_next(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")).count() == 2


def test_near_pairs_equal_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for r in sorted(df.collect()):
        seen.setdefault(frozenset(sigs(r.text or "")), r.doc_id)
    sets = [(i, s) for s, i in seen.items() if s]
    want = {(min(i, j), max(i, j)) for i, s in sets for j, t in sets if i < j and 100 * len(s & t) >= 60 * len(s | t)}
    assert {(r.a, r.b) for r in spotsigs.near_pairs(df, 60).collect()} == want


def test_classes_cover_every_member(spark):
    rows = [(3, "The house of cards"), (1, "the HOUSE of cards!"), (2, None), (5, ""), (7, "x y"), (7, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.id, r.class_id) for r in spotsigs.classes(df).collect()) == [(1, 1), (2, 2), (3, 1), (5, 2), (7, 7), (7, 7)]


def test_next_of_sparse_ids(spark):
    rows = [(i * 7_919_000_003, f"the word{i} and text{i}") for i in range(-150, 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert digest(spotsigs.compare_with_next(df)) == brute(rows)
