from posada.llm import components, samples


def test_least_hashes_are_the_first_of_the_order(spark):
    rows = spark.range(5000)
    every = [r.id for r in rows.selectExpr("id").sort(samples.F.xxhash64("id"), "id").collect()]
    for most in (0, 10, 2000, 9000):
        assert sorted(r.id for r in samples.least_hashes(rows, "id", most).collect()) == sorted(every[:most])


def test_frequent_is_bounded_and_keeps_the_greatest(spark):
    counts = spark.range(1, 1001).selectExpr("id as key", "cast(100000 / id as long) as n")
    for most in (5, 100, 5000):
        got = sorted(r.n for r in samples.frequent(counts, most).collect())
        assert len(got) <= most and (most < 1000 or len(got) == 1000)
        assert not got or got[0] > max([r.n for r in counts.collect() if r.n < got[0]], default=0)
    assert samples.frequent(counts.where("false"), 5).count() == 0


def test_components(spark):
    import random

    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def jobs_and_tasks(spark, name, work):
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        out = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    tracker = context.statusTracker()
    jobs = tracker.getJobIdsForGroup(name)
    return out, len(jobs), sum(tracker.getStageInfo(s).numCompletedTasks for j in jobs for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s))


def test_components_of_few_edges_take_few_jobs_and_of_many_are_the_same(spark, monkeypatch):
    edges = spark.range(0, 3000, 1, 16).selectExpr("(id * 7919) % 3001 as u", "((id + 1) * 7919) % 3001 as v").union(spark.createDataFrame([(9000, 9001), (9001, 9000), (5, 5), (None, 1), (9500, 9500)], "u long, v long"))
    expected = {i: 0 for i in range(3001)} | {9000: 9000, 9001: 9000}
    rows, jobs, _ = jobs_and_tasks(spark, "few", lambda: components.components(edges).collect())
    assert {r.node: r.component for r in rows} == expected and len(rows) == len(expected) and jobs <= 6
    monkeypatch.setattr(components, "ROWS_A_TASK", 500)
    rows = components.components(edges).collect()
    assert {r.node: r.component for r in rows} == expected and len(rows) == len(expected)


def test_settled_rows_of_many_partitions_are_counted_in_few_tasks(spark):
    rows, _, tasks = jobs_and_tasks(spark, "settled", lambda: components.settled(spark.range(0, 1000, 1, 64)))
    assert rows.count() == 1000 and rows.rdd.getNumPartitions() == 1 and 64 <= tasks <= 64 + spark.sparkContext.defaultParallelism + 1
