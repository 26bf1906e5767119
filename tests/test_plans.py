from pyspark.sql import functions as F

from posada.operators import merge
from posada.plans import clean_pass, licences, refresh
from posada.queries import bind, joins
from posada.schema import LISTING


def test_refresh_merges_admitted_listings(spark, sf):
    found = bind.listings(spark, sf)
    table = refresh.refresh(spark.createDataFrame([], LISTING), found, bind.gazetteer(spark, sf))
    rows = table.collect()
    assert {r.action for r in rows} == {"new"} and len({r.url for r in rows}) == len(rows) > 50
    again = refresh.refresh(merge.alive(table), found, bind.gazetteer(spark, sf))
    assert {r.action for r in again.collect()} == {"kept"}


def test_licence_plan_skips_what_is_done(spark, sf):
    raw = bind.licences(spark, sf)
    booking, google = joins.quotes(spark, sf)
    done = spark.createDataFrame([("5",)], "n_registro string")
    got = licences.enrich(raw, done, booking, google, F.lit("2024-05-31").cast("date"), limit=20).collect()
    assert len(got) == 20 and "5" not in {r.n_registro for r in got}
    assert {r.fecha_consulta for r in got} == {"2024-07-10"} and all(r.estimacion.revpar_ine > 0 for r in got)


def test_clean_pass(spark, sf):
    gazetteer = spark.createDataFrame([("palma", "Baleares", 1), ("las palmas", "Canarias", 2)], "key string, region string, ord int")
    rows = spark.createDataFrame(
        [("u1", "3 bedroom hotel - â¬ 490,000", "Precio a consultar", "Las Palmas with pool", "ThinkSpain", None, None), ("u2", "t", "5 €", "x", "Other", 4, "R")],
        "url string, title string, price string, location string, source string, rooms int, location_region string",
    )
    rows = rows.withColumn("beds", F.lit(0)).withColumn("m2", F.lit(None).cast("int")).withColumn("ord", F.monotonically_increasing_id())
    got = {r.url: (r.price, r.location, r.rooms, r.location_region) for r in clean_pass.clean_table(rows, gazetteer).collect()}
    assert got == {"u1": ("490.000 €", "Las Palmas", 3, "Baleares"), "u2": ("5 €", "x", 4, "R")}
    patches = spark.createDataFrame([("u1", 7, 30), ("u2", 9, 9)], "url string, beds int, m2 int")
    table, outcomes = clean_pass.apply_patches(rows, patches, ["ThinkSpain"])
    assert {r.url: (r.beds, r.m2) for r in table.collect()} == {"u1": (7, 30), "u2": (0, None)}
    assert [tuple(r) for r in outcomes.collect()] == [("enriched", 1)]
