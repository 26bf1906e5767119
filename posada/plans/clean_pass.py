"""The clean-and-enrich pass over the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posada.functions.places import clean_place_titled, rooms_in_title
from posada.functions.prices import on_request, price_in_title
from posada.functions.text import folded_lower
from posada.operators import enrich, geo, merge, report

ATTRIBUTES = ["rooms", "beds", "m2", "stars", "location_city", "location_region"]


def clean_table(rows: DataFrame, gazetteer: DataFrame, portal: str = "ThinkSpain") -> DataFrame:
    """What needs no page: places, rooms and prices of the portal that puts them into titles, and regions for all."""
    of_portal = F.col("source") == portal
    place = clean_place_titled(F.col("location"))
    rows = rows.withColumn("location", F.when(of_portal & (place != ""), place).otherwise(F.col("location")))
    rows = rows.withColumn("rooms", F.when(of_portal & (F.coalesce("rooms", F.lit(0)) == 0), F.coalesce(rooms_in_title(F.col("title")), F.col("rooms"))).otherwise(F.col("rooms")))
    rows = rows.withColumn("price", F.when(of_portal & on_request(F.col("price")), F.coalesce(price_in_title(F.col("title")), F.col("price"))).otherwise(F.col("price")))
    return geo.infer_region(rows, gazetteer, [folded_lower(F.col("location"))], by_length=False)


def apply_patches(rows: DataFrame, patches: DataFrame, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table, outcomes): rows of the work list filled from their patches, and how many were enriched, skipped or failed."""
    work = enrich.work_list(rows, known).select("url")
    some = patches.join(work, "url", "left_semi")
    fields = [c for c in ATTRIBUTES if c in patches.columns]
    tried = work.join(some, "url", "left").withColumn("failed", F.lit(False))
    return merge.patch(rows, some, fields), report.outcomes(tried, fields)
