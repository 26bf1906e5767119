"""Listing refresh: pages and feeds of one run become listings, which are merged into the accumulated table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posada.functions.places import clean_place
from posada.functions.prices import price_or_request
from posada.functions.text import canonical_url, clean, place_key
from posada.operators import dedup, geo, merge


def admitted(found: DataFrame, gazetteer: DataFrame, least: float = 0.72) -> DataFrame:
    """Listings as found (with ``ord`` in portal order) to listings as stored: admission, first per portal, fuzzy duplicates, clean places, regions."""
    rows = found.withColumn("title", clean(F.col("title"))).withColumn("price", price_or_request(F.col("price")))
    rows = dedup.fuzzy_dedup(dedup.admissible(dedup.first_per_portal(rows)), least)
    rows = rows.withColumn("url", canonical_url(F.col("url"))).withColumn("title", F.left("title", F.lit(120))).withColumn("description", F.left(F.coalesce("description", F.lit("")), F.lit(1500)))
    rows = rows.withColumn("location", F.when(F.coalesce("location", F.lit("")) != "", clean_place(F.col("location"))).otherwise(F.col("location")))
    sources: list[Column] = [place_key(F.col("location")), place_key(F.col("title")), place_key(F.left("description", F.lit(300)))]
    return geo.infer_region(rows, gazetteer, sources)


def refresh(stored: DataFrame, found: DataFrame, gazetteer: DataFrame, portals_ok: list[str] | None = None) -> DataFrame:
    """The merged table with each row's ``action``; ``operators.merge.alive`` leaves the new table."""
    return merge.merge_run(stored, admitted(found, gazetteer), portals_ok=portals_ok)
