"""Routing and work lists of the enrichment pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posada.functions.attributes import needs_enrichment


def work_list(rows: DataFrame, known: list[str], sources: list[str] | None = None, force: bool = False, n: int | None = None) -> DataFrame:
    """Rows of known sources that lack all attributes (all rows with ``force``), the first n in table order."""
    some = rows.where(F.col("source").isin(*known))
    if sources:
        some = some.where(F.col("source").isin(*sources))
    if not force:
        some = some.where(needs_enrichment(F.col("rooms"), F.col("beds"), F.col("m2")))
    return some if n is None else some.orderBy("ord").limit(n)


def routed(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with the rule of their source (source, rule); unknown sources go. The rules are few and fixed by the code."""
    return rows.join(F.broadcast(rules), "source")
