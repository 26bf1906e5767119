"""Licence enrichment: licences not yet done meet their two price quotes and the revenue model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posada.functions.dates import query_day
from posada.operators import dedup, model, order


def enrich(raw: DataFrame, done: DataFrame, booking: DataFrame, google: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Raw records (with ``ord``) to enriched rows: aliases, first per registry id, those not done, quotes, estimate."""
    rows = model.resolve_aliases(raw)
    rows = dedup.licence_dedup(rows, F.col("n_registro"), F.col("nombre"), F.col("municipio"))
    rows = order.missing_from(rows, done, "n_registro")
    if limit is not None:
        rows = order.in_table_order(rows, limit)
    return model.enriched(rows, booking, google, query_day(as_of))
