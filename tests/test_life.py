import json
import random

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from posada.operators import geo, merge, order
from posada.schema import LISTING
from posada.sources import store
from posada.streaming import snapshots


def fold(history, runs):
    """Run by run: url -> absences, with eviction at three."""
    table, first = {}, {}
    for run in range(runs):
        seen = {u for u, rs in history.items() if run in rs}
        for u in list(table):
            if u not in seen:
                table[u] += 1
                if table[u] >= 3:
                    del table[u]
        for u in seen:
            if u not in table:
                first[u] = run
            table[u] = 0
    return {u: (first[u], a) for u, a in table.items()}


def histories(seed, n=40, runs=25):
    rng = random.Random(seed)
    return {f"u{i}": {r for r in range(runs) if rng.random() < rng.choice([0.1, 0.4, 0.9])} for i in range(n)}


def test_replay_equals_run_by_run(spark):
    for seed in range(3):
        history = histories(seed)
        rows = [(u, r) for u, rs in history.items() for r in rs]
        got = merge.replay(spark.createDataFrame(rows, "url string, run_no long"), last_run=24)
        assert {r.url: (r.first_run, r.ausencias) for r in got.collect()} == fold(history, 25)


def test_stream_equals_replay_and_ignores_repeats(spark, tmp_path):
    history = histories(7, n=12, runs=6)
    source = tmp_path / "in"
    source.mkdir()

    def write(name, runs):
        rows = [{"url": u, "title": "t", "price": f"{r} €", "source": "s", "run_no": r} for u, rs in history.items() for r in rs if r in runs]
        (source / name).write_text("\n".join(map(json.dumps, rows)))

    with_run = StructType([*LISTING.fields, StructField("run_no", LongType())])
    stream = lambda: spark.readStream.schema(with_run).json(str(source))
    write("a.json", {0, 1, 2})
    snapshots.start(stream(), str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    write("b.json", {3, 4, 5, 1})
    snapshots.start(stream(), str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    got = {r.url: r.ausencias for r in snapshots.current(spark, str(tmp_path / "table")).collect()}
    assert got == {u: a for u, (_, a) in fold(history, 6).items()}


def test_stream_touches_only_the_urls_of_a_run_and_compacts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "CHANGES_A_BASE", 2)
    history = histories(3, n=15, runs=9)
    source, table, with_run = tmp_path / "in", str(tmp_path / "table"), StructType([*LISTING.fields, StructField("run_no", LongType())])
    source.mkdir()
    for run in range(9):
        rows = [{"url": u, "title": f"t{run}", "price": f"{run} €", "source": "s", "run_no": run} for u, rs in history.items() if run in rs]
        rows += [{"url": None, "run_no": run}, {"url": "x", "run_no": None}] + rows[:1]
        (source / f"{run}.json").write_text("\n".join(map(json.dumps, rows)))
        snapshots.start(spark.readStream.schema(with_run).json(str(source)), table, str(tmp_path / "cp")).awaitTermination()
        if run in (2, 8):
            got = {r.url: (int(r.title[1:]), r.price, r.ausencias) for r in snapshots.current(spark, table).collect()}
            last = {u: max(r for r in rs if r <= run) for u, rs in history.items() if any(r <= run for r in rs)}
            want = fold({u: {r for r in rs if r <= run} for u, rs in history.items()}, run + 1)
            assert got == {u: (first, f"{last[u]} €", a) for u, (first, a) in want.items()}
    changes = snapshots._whole(spark, table, "changes")
    assert snapshots._whole(spark, table, "base") and len(changes) < 9
    assert spark.read.parquet(f"{table}/changes={changes[-1]}").count() <= len(history)


def test_merge_is_idempotent_and_knows_failed_portals(spark):
    old = spark.createDataFrame([("a", "1", "x", "p", 2), ("b", "2", "y", "q", 2), (None, "3", "z", "p", 0)], "url string, price string, description string, source string, ausencias int")
    new = spark.createDataFrame([("c", "", None, "p")], "url string, price string, description string, source string")
    once = merge.merge_run(old, new)
    assert {r.url: (r.action, r.ausencias) for r in once.collect()} == {"a": ("evicted", 3), "b": ("evicted", 3), "c": ("new", 0)}
    partly = merge.merge_run(old, new, portals_ok=["p"])
    assert {r.url: (r.action, r.ausencias) for r in partly.collect()} == {"a": ("evicted", 3), "b": ("absent", 2), "c": ("new", 0)}
    again = merge.merge_run(merge.alive(once), new)
    assert [tuple(r) for r in merge.alive(again).collect()] == [tuple(r) for r in merge.alive(once).collect()]


def test_gazetteer_equals_a_search_key_by_key(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcñ") for _ in range(n))
    keys = [(word(rng.randint(0, 5)), f"r{i % 4}", i) for i in range(60)] + [(None, "r", 99), ("ab", "last", 100)]
    values = [word(rng.randint(0, 14)) + " " + word(3) for _ in range(80)] + [None, "", "z" * 100_000 + " ab"]
    texts = spark.createDataFrame([(t,) for t in values], "t string")
    g = spark.createDataFrame(keys, "key string, region string, ord int")
    table = {}
    for k, region, i in keys:
        if k:
            table[k] = (table[k][0] if k in table else i, region)
    for by_length in (True, False):
        for whole in (True, False):
            want = {}
            for t in set(values) - {None}:
                hits = [((-len(k) if by_length else 0), *table[k]) for k in table if (f" {k} " in f" {t} " if whole else k in t)]
                want[t] = min(hits, default=(None,))[-1]
            for size in (2_000_000, 25):
                monkeypatch.setattr(geo, "SHARD_BYTES", size)
                monkeypatch.setattr(geo, "SHARDS_AT_ONCE", 50)
                assert {r.t: r.region for r in geo.regions_of(texts, g, "t", by_length, whole).collect()} == want


def test_regions_are_filled_in_place(spark):
    g = spark.createDataFrame([("lugo", "Galicia", 1), ("madrid", "Madrid", 0)], "key string, region string, ord int")
    rows = spark.createDataFrame([(1, "x lugo", None, "madrid"), (2, None, "", "madrid"), (3, "", "Own", "lugo"), (4, "q", None, None), (4, "q", None, None)], "ord int, a string, location_region string, b string")
    found = geo.infer_region(rows, g, [F.col("a"), F.col("b")])
    assert sorted((r.ord, r.location_region or "") for r in found.collect()) == [(1, "Galicia"), (2, "Madrid"), (3, "Own"), (4, ""), (4, "")]
    assert "Exchange" not in found._jdf.queryExecution().toString()
    none = geo.infer_region(rows, g.where("false"), [F.col("a")])
    assert [r.location_region for r in none.orderBy("ord").collect()] == [None, "", "Own", None, None]


def test_json_round_trip(spark, tmp_path):
    rows = [{"url": f"u{i % 3}", "title": f"t{i}", "date": d} for i, d in enumerate(["01/02/2024", None, "31/12/2023", "x", "05/02/2024"])]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    read = store.read_json(spark, str(tmp_path / "c.json"))
    assert {r.url: r.title for r in store.last_per_key(read, "url").collect()} == {"u0": "t3", "u1": "t4", "u2": "t2"}
    assert [r["title"] for r in json.loads(store.document(read).first().json)] == ["t4", "t0", "t2", "t1", "t3"]
    path = store.save_version(read, str(tmp_path / "store"), 1)
    assert spark.read.parquet(path).count() == 5
    store.publish(read, str(tmp_path / "out"))
    out = [json.loads(x)["title"] for p in sorted((tmp_path / "out").glob("part*")) for x in p.read_text().splitlines()]
    assert out == ["t4", "t0", "t2", "t1", "t3"]
    (tmp_path / "bad.json").write_text('[{"url": "a"')
    assert store.read_json(spark, str(tmp_path / "bad.json"), on_corrupt="empty").count() == 0
    assert store.optional_json(spark, str(tmp_path / "none.json"), LISTING).count() == 0


def test_numbered(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"))
    assert all(r.x == r.ord for r in order.numbered(df, [F.col("x")], ranges=9).collect())


def test_numbered_wide_table(spark):
    """Numbers must fit where columns besides the keys would let each use of the rows be dealt out anew."""
    n = 400_000
    df = spark.range(n, numPartitions=7).select((F.col("id") * 7919 % n).alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("rest"))
    found = order.numbered(df, [F.col("x")]).agg(F.count(F.when(F.col("x") != F.col("ord"), 1)).alias("wrong"), F.countDistinct("ord").alias("numbers"), F.max(F.length("rest")).alias("m")).first()
    assert tuple(found) == (0, n, 64)


def test_parted_table_rewrites_only_the_parts_of_changed_urls(spark, tmp_path):
    table = store.PartedTable(spark, str(tmp_path / "t"), parts=8)
    kind = "url string, price string"
    schema = spark.createDataFrame([], kind).schema
    assert table.version() == 0 and table.read(schema).count() == 0
    first = {f"u{i}": str(i) for i in range(60)} | {None: "n"}
    table.upsert(spark.createDataFrame(list(first.items()), kind))
    before = table.versions_of_parts()
    changes = {"u3": "x", "new": "y"}
    table.upsert(spark.createDataFrame(list(changes.items()), kind))
    after = table.versions_of_parts()
    assert dict(table.read(schema).collect()) == first | changes
    assert dict(table.read(schema, version=1).collect()) == first
    assert 1 <= sum(after[p] != before.get(p) for p in after) <= 2
    merged = table.read(schema).where("url is null or url != 'u5'")
    table.write(merged, list(range(8)))
    assert "u5" not in dict(table.read(schema).collect()) and table.read(schema, version=2).count() == 62
    table.write(merged.where("false"), list(range(8)))
    assert table.version() == 4 and table.read(schema).count() == 0
