import random

import pytest
from pyspark.sql import functions as F

from posada.operators import dedup


def greedy(rows, conflict):
    kept = []
    for r in sorted(rows):
        if not any(conflict(r, k) for k in kept):
            kept.append(r)
    return [r[0] for r in kept]


def made(spark, seed, n=160):
    rng = random.Random(seed)
    base = ["casa azul junto al mar", "casa azul junto al rio", "finca grande con olivos", "molino viejo del valle", ""]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 7)):
            if t:
                t[rng.randrange(len(t))] = rng.choice("abcdefgh")
        rows.append((i, f"https://x/{rng.randrange(90)}?a={i}", "".join(t), rng.choice(["1.000 €", "€2.000", "Precio a consultar", None]), rng.choice(["Madrid", "Madrid centro", "Lugo", None])))
    return rows, spark.createDataFrame(rows, "ord long, url string, title string, price string, location string")


def key(c):
    return dedup.title_key(c)


@pytest.mark.parametrize("seed", range(3))
def test_fuzzy_dedup_is_greedy(spark, seed, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 8)
    rows, df = made(spark, seed)
    keys = {r.ord: (r.u, r.p, r.t) for r in df.select("ord", dedup.canonical_url(F.col("url")).alias("u"), dedup.digits(F.col("price")).alias("p"), key(F.col("title")).alias("t")).collect()}

    def conflict(new, old):
        (u, p, t), (v, q, s) = keys[new[0]], keys[old[0]]
        return u == v or bool(p and t and s) and p == q and dedup.ratio(t, s) >= 0.72

    want = greedy(rows, conflict)
    assert sorted(r.ord for r in dedup.fuzzy_dedup(df).collect()) == want
    assert sorted(r.ord for r in dedup.fuzzy_dedup(df.repartition(7)).collect()) == want


def test_place_and_table_dedup_are_greedy(spark):
    rows, df = made(spark, 9)
    keys = {r.ord: (r.u, r.p, r.t, r.m, (r.l or "").lower()) for r in df.select("ord", dedup.canonical_url(F.col("url")).alias("u"), dedup.digits(F.col("price")).alias("p"), key(F.col("title")).alias("t"), dedup.title_key(F.col("title"), more=True).alias("m"), F.col("location").alias("l")).collect()}

    def by_place(new, old):
        a, b = keys[new[0]], keys[old[0]]
        return a[0] == b[0] or bool(a[1] and a[2] and b[2]) and a[1] == b[1] and (a[4] in b[4] or b[4] in a[4]) and dedup.ratio(a[2], b[2]) > 0.6

    def by_table(new, old):
        a, b = keys[new[0]], keys[old[0]]
        return a[0] == b[0] or bool(a[1]) and a[1] == b[1] and dedup.ratio(a[3], b[3]) >= 0.72

    assert sorted(r.ord for r in dedup.place_dedup(df).collect()) == greedy(rows, by_place)
    assert sorted(r.ord for r in dedup.table_dedup(df).collect()) == greedy(rows, by_table)
    assert dedup.fuzzy_dedup(df.where("false")).count() == 0


def test_native_scorer(spark):
    df = spark.createDataFrame([(1, "a", "casa azul", "9"), (2, "b", "casa azur", "9"), (3, "c", "molino", "9"), (4, "d", "casa azul", "8")], "ord long, url string, title string, price string")
    assert sorted(r.ord for r in dedup.fuzzy_dedup(df.withColumn("location", F.lit(None).cast("string")), scorer="levenshtein").collect()) == [1, 3, 4]


def listings_of(spark, path, rows):
    spark.createDataFrame([(i, f"{t}\nmore", 900, f"s{i}", "en") for i, t in rows], "doc_id long, text string, n_chars int, source string, lang string").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["d3_fuzzy_dedup", "d5_table_dedup"])
def test_queries_compare_titles_of_equal_listed_prices(spark, tmp_path, name):
    from posada.queries import QUERIES

    # Price "1€" of ids 3, 8 and 13; the price of id 4 differs though its title is that of id 3.
    path = listings_of(spark, tmp_path, [(3, "Casa azul junto al mar"), (8, "Xasa azul junto al mar"), (13, "molino viejo del valle"), (4, "Casa azul junto al mar")])
    assert sorted(r.ord for r in QUERIES[name](spark, path).collect()) == [3, 4, 13]


def test_distinct_prices_of_a_source(spark, tmp_path):
    from posada.queries import QUERIES

    path = listings_of(spark, tmp_path, [(3, "a"), (4, "b")])
    assert sorted(tuple(r) for r in QUERIES["d8_distinct_price_rows"](spark, path).collect()) == [("s3", "1€"), ("s4", "900,000")]


@pytest.mark.parametrize("name", ["j6_price_block_pairs", "d9_levenshtein_dedup"])
def test_edit_distances_of_queries_count_bytes_as_their_sql(spark, tmp_path, name):
    from posada.queries import ORACLE_SQL, QUERIES

    from .compare import difference

    # 25 characters: seven other letters are alike (0.72), but not where a letter of two bytes stands for one of one byte.
    titles = ["tür " * 28, "tor " * 28, "abcdefghijklmnopqrstuvwxy", "ABCDEFGHIJKLMNOPQRyyyyyyy", "äbcdefghijklmnopqryyyyyyx", "äbcdefghijklmnopqrzzzzzzx", "ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ", "ΟΔΟΣ ΟΔΟΣ ΟΔΟΝ", "İİİİİİİİİİİ", "iiiiiiiiiii"]
    path = listings_of(spark, tmp_path, [(3 + 5 * k, t) for k, t in enumerate(titles)])
    assert difference(spark, QUERIES[name], ORACLE_SQL[name], path) is None


def test_rows_behind_one_of_their_url_that_stays_meet_no_titles(spark):
    rows = [(i, f"https://x/{i % 4}", f"{'abcdefghijklmnopqrstuvwxyz'[i % 26] * 9} {i * 7919}", "9", None) for i in range(400)]
    df = spark.createDataFrame(rows, "ord long, url string, title string, price string, location string")
    met = []

    def alike(values):
        met.append(values.count())
        return dedup.like_values(values, 0.72)

    found = dedup.first_accepted(df, alike, F.col("price"), F.col("title"), F.lit(""), F.lit(False))
    assert sorted(r.ord for r in found.collect()) == [0, 1, 2, 3]
    # All 400 titles before.
    assert met == [4]


def test_urls_whose_first_rows_go_are_represented_by_later_ones(spark):
    """The first rows of URLs 1 and 2 are copies of rows of URL 0, and of each other further on; what stays late strikes rows that others had counted on."""
    titles = {0: ["a" * 9], 1: ["a" * 9] * 6 + ["b" * 9], 2: ["a" * 9] * 3 + ["b" * 9] * 9 + ["c" * 9], 3: ["a" * 9, "b" * 9, "c" * 9], 4: ["c" * 9]}
    order = [(k, u) for u in titles for k in range(len(titles[u]))]
    rows = [(i, f"https://x/{u}", titles[u][k], "9", None) for i, (k, u) in enumerate(sorted(order))]
    df = spark.createDataFrame(rows, "ord long, url string, title string, price string, location string")
    want = greedy(rows, lambda new, old: new[1] == old[1] or new[2] == old[2])
    assert sorted(r.ord for r in dedup.fuzzy_dedup(df).collect()) == want
