import random
import re

from posada.llm import jaccard_join
from posada.llm.queries import op3_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = WORD.findall(low)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in sets.items():
        for e in s:
            holders.setdefault(e, []).append(i)
    done = set()
    for h in holders.values():
        for a in h:
            for b in h:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in op3_jaccard_join(spark, sf).collect()}
    assert found == brute(rows, 4, 85)


def edited(rng, words, share):
    return " ".join(rng.choice("abcdefgh") + "x" if rng.random() < share else w for w in words)


def test_small_sets_long_lists_and_edge_cases(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03]))) for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(55))
    rows += [(100 + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(60))) for i in range(40)]
    small = [f"s{i}" for i in range(16)]
    rows += [(200 + i, " ".join(small[: rng.randint(3, 16)] + ["z"] * rng.randint(0, 1))) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "ONE"), (305, "one two"), (306, "x " * 3000), (307, "x " * 3001), (308, "É é"), (309, "é É")]
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'a' as sig", "1 as n", "'b' as component")
    for k, percent in ((4, 85), (5, 80), (2, 90)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, k, percent).collect()}
        assert got == brute(rows, k, percent)


def test_keep_first_and_empty(spark):
    df = spark.createDataFrame([(2, "a b c d e f"), (1, "a b c d e f"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard_join.keep_first(df).collect()) == [1, 3, 4]
    assert jaccard_join.keep_first(df.where("false")).count() == 0
    assert jaccard_join.jaccard_components(df.where("text is null")).count() == 1


def test_keep_first_of_null_ids_and_repeated_rows(spark):
    one, other = "a b c d e f", "g h i j k l"
    rows = [(None, one, 1), (None, one, 2), (None, None, 3), (1, one, 5), (1, one, 4), (2, one, 6), (1, other, 7), (3, other, 8), (4, None, 9), (4, None, 10), (5, one + " ", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int")
    assert sorted(r.x for r in jaccard_join.keep_first(df).collect()) == [1, 2, 3, 4, 7, 9, 10]
