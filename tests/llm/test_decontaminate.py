import hashlib
import random
import re

from posada.llm import decontaminate
from posada.llm.queries import op7_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - window + 1)) if w else []:
            windows.setdefault(tuple(w[j : j + window]), set()).update([] if i is None else [str(i)])
    sizes = {len(k) for k in windows}
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (key := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[key]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


COLUMNS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_query_equals_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 10)
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op7_decontaminate(spark, sf).collect()} == want
    assert any(v[-1] for v in want.values())


def test_random_words_short_items_and_shards(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 4, 5, 8, 12]))) for i in range(2, 14)] + [(1, None), (None, "a b"), (99, "É ß")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(80)] + [(100, None), (101, ""), (102, "!!"), (103, "Q É, ß q"), (104, "A-B,c " * 500)]
    for some in (items, [x for x in items if x[0] and len(words(x[1])) != 1], [x for x in items if x[0] and len(words(x[1])) > 3]):
        want = brute(docs, some, 4)
        d, b = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as items", "'x' as n_hit"), spark.createDataFrame(some, "item_id long, text string")
        for size in (1 << 20, 150):
            got = decontaminate.scan(d, b, window=4, item_bytes=size)
            assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got.collect()} == want


def test_automaton_of_many_followers_and_repeats(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(["the", f"w{rng.randint(0, 80)}"]) for _ in range(40))) for i in range(60)] + [(70, "x " * 30), (71, "x " * 12), (71, "x " * 12), (72, "the " * 3)]
    docs = [(i, " ".join(items[rng.randrange(60)][1].split()[rng.randint(0, 20) :]) + " " + "x " * rng.randint(0, 14)) for i in range(60)]
    want = brute(docs, items, 6)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in decontaminate.scan(d, b, window=6).collect()} == want


def test_clean_keeps_own_columns(spark):
    docs = [(1, "one two three", 77, ["mine"], "a"), (2, "one two", None, None, "b"), (None, None, 3, [], "c")]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words int, items array<string>, __hits string")
    b = spark.createDataFrame([(1, "one two"), (2, "zzz " * 200)], "item_id long, text string")
    for size in (1 << 20, 60):
        got = decontaminate.clean(d, b, window=2, max_words=0, max_coverage=0.9, item_bytes=size)
        assert got.schema == d.schema and [tuple(r) for r in got.collect()] == [(1, " three", 77, ["mine"], "a"), (None, None, 3, [], "c")]


def test_clean_cuts_and_drops(spark):
    d = spark.createDataFrame([(1, "Keep ÄÖ. One two three four five, rest of the text is here and stays"), (2, "one two three four five"), (3, None), (4, "clean")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.clean(d, b, window=5, max_words=4).collect()}
    assert got == {1: "Keep ÄÖ. , rest of the text is here and stays", 3: None, 4: "clean"}
    assert decontaminate.clean(d, b.where("false")).count() == 4
    assert decontaminate.clean(d.where("false"), b).count() == 0
