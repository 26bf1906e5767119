import random

from posada.operators import lives, merge
from posada.sources.store import PartedTable

from .test_life import fold, histories

KIND = "url string, run_no long"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_lives_of_batches_join_in_any_order(spark):
    rng = random.Random(5)
    sightings = [(u, r) for u, rs in histories(11).items() for r in rs]
    whole = lives.lives(spark.createDataFrame(sightings, KIND))
    want = rows_of(whole)
    rng.shuffle(sightings)
    a, b, c = (lives.lives(spark.createDataFrame(sightings[i::3] + sightings[:4], KIND)) for i in range(3))
    assert rows_of(lives.join_lives(a, b, c)) == want
    assert rows_of(lives.join_lives(lives.join_lives(c, a), lives.join_lives(b, a))) == want
    assert rows_of(lives.join_lives(whole, a)) == want
    state = {r.url: (r.first_run, r.ausencias) for r in lives.living(whole, 24).collect()}
    assert state == fold(histories(11), 25)
    assert rows_of(lives.living(whole, 24)) == rows_of(merge.replay(spark.createDataFrame(sightings, KIND), last_run=24))


def test_stories_tell_the_run_of_eviction(spark):
    sightings = [("a", 0), ("a", 3), ("a", 7), ("b", 5), ("b", 5), (None, 5), ("c", None)]
    found = lives.stories(lives.lives(spark.createDataFrame(sightings, KIND)), 8)
    assert rows_of(found.na.fill(-1)) == [("a", 0, 3, 6), ("a", 7, 7, -1), ("b", 5, 5, 8)]
    assert lives.lives(spark.createDataFrame([], KIND)).count() == 0


def test_stored_lives_advance_by_parts(spark, tmp_path):
    history = histories(2, n=30, runs=12)
    table = PartedTable(spark, str(tmp_path / "t"), parts=8)
    for runs in ({0, 1, 2, 3}, {8, 9}, {4, 5, 6, 7, 3}, {10, 11}):  # a late batch and a repeated run
        lives.advance(table, spark.createDataFrame([(u, r) for u, rs in history.items() for r in rs & runs], KIND))
    before = table.versions_of_parts()
    kind = lives.lives(spark.createDataFrame([], KIND)).schema
    assert {r.url: (r.first_run, r.ausencias) for r in lives.living(table.read(kind), 11).collect()} == fold(history, 12)
    lives.advance(table, spark.createDataFrame([("u3", 11)], KIND))
    assert sum(v != before[p] for p, v in table.versions_of_parts().items()) == 1
    lives.advance(table, spark.createDataFrame([], KIND))
    assert table.read(kind).where("url = 'u3'").agg({"seen_run": "max"}).first()[0] == 11
