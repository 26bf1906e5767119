"""Deduplication in arrival order: a row goes if it conflicts with an earlier row that stayed.

Rows conflict if they have one URL, or one price and titles that are alike. The rows that stay are the
lexicographically first maximal independent set by ``ord``. It is found in rounds: a row stays once no earlier
undecided row conflicts with it, and goes once an earlier row that stayed does. Rows that go by their URL are not compared by title.

Likeness is worked out between distinct titles of one price, not between rows, so that copies cost nothing; a
popular price is split into blocks of titles that meet two by two, on as many tasks as the number of pairs asks for. Rows with a null ``ord`` are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posada.functions.prices import digits
from posada.functions.text import canonical_url, title_key

from . import likeness
from .likeness import alike_by_price, near_by_edits, ratio, ratios_reach, scored  # noqa: F401
from .order import first_per_key
from .shared import checkpointed

#: Distinct titles of one price that are compared with one another in one go, and the pairs for which one task is made.
BLOCK, PAIRS_A_TASK = likeness.BLOCK, likeness.PAIRS_A_TASK


def like_values(values: DataFrame, least: float, strict: bool = False, places: bool = False) -> DataFrame:
    """(new, old): ids of distinct values (value, price, title, place) of one price that are alike in this order of arguments."""

    def found(part: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        ids, titles = part["value"].to_numpy(), list(part["title"])
        if places:
            names = part["place"].to_numpy()
            within = np.array([p in q or q in p for p, q in zip(names[i], names[j], strict=True)], bool)
            i, j = i[within], j[within]
        pairs = ratios_reach(titles, i, j, least, strict)
        return pd.DataFrame([(ids[i], ids[j]) for i, j in pairs], columns=["new", "old"]).astype("int64")

    def allowed(part: pd.DataFrame) -> Callable:
        """A place within another has none but the other's characters, which are told apart by 64 bits."""
        names, number = np.unique(part["place"].to_numpy(), return_inverse=True)
        bits = np.array([sum(1 << b for b in {ord(c) % 64 for c in name}) for name in names], np.uint64)[number]

        def within(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
            both, mine, theirs = np.bitwise_and.outer(bits[rows], bits[columns]), bits[rows][:, None], bits[columns]
            return (both == mine) | (both == theirs)

        return within

    # With lengths m <= n the ratio is 2 m / (m + n) at most.
    return alike_by_price(values, "value", least, least / (2 - least), found, "new long, old long", allowed=allowed if places else None, size=BLOCK, pairs_a_task=PAIRS_A_TASK)


def like_values_native(values: DataFrame, least: float, of_bytes: bool = False) -> DataFrame:
    """As ``like_values``, with 1 - Levenshtein distance (of characters or bytes) / longer length as the likeness."""
    return near_by_edits(values, least, of_bytes=of_bytes)


#: How many of its rows a URL is represented by at first, and the factor by which they grow while all of them go.
AT_FIRST, GROWTH = 1, 4


def first_accepted(rows: DataFrame, values_alike: Callable[[DataFrame], DataFrame], price: Column, title: Column, place: Column, guarded: Column) -> DataFrame:
    """The rows that stay. ``guarded`` rows are never duplicates by their title.

    A row after one of its URL that stays goes, whatever its title is, so that it need not meet others. Each URL is represented by its first rows, and the rule
    is applied to these alone; URLs of which no row stays get more of theirs, until each URL has a row that stays or is there with all its rows. Then the rows that
    stay are those of the rule over all rows: earlier rows decide on a row, and those that are not there would not have stayed.
    """
    base = rows.where(F.col("ord").isNotNull()).withColumn("__url", canonical_url(F.col("url")))
    value = F.when(~guarded, F.xxhash64(price, title, place))
    keyed = base.select("ord", F.col("__url").alias("url"), value.alias("value"), price.alias("price"), title.alias("title"), place.alias("place"))
    keyed, number = checkpointed(keyed), AT_FIRST
    some = checkpointed(_first_of(keyed, number))
    while True:
        kept = _greedy(some, values_alike)
        without = keyed.join(kept.select("url").distinct(), "url", "left_anti")
        number *= GROWTH
        more = checkpointed(_first_of(without, number).join(some.select("ord"), "ord", "left_anti"))
        if more.isEmpty():
            return base.drop("__url").join(kept.select("ord"), "ord", "left_semi")
        some = checkpointed(some.union(more.select(*some.columns)))


def _first_of(keyed: DataFrame, number: int) -> DataFrame:
    """So many rows of each URL, those after them with the same ``ord`` as well."""
    if number == 1:
        return keyed.join(keyed.groupBy("url").agg(F.min("ord").alias("__low")), "url").where("ord = __low").drop("__low")
    return keyed.withColumn("__rank", F.rank().over(Window.partitionBy("url").orderBy("ord"))).where(F.col("__rank") <= number).drop("__rank")


def _greedy(keyed: DataFrame, values_alike: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(ord, url) of the rows (ord, url, value, price, title, place) that stay among these."""
    values = keyed.where("value is not null").select("value", "price", "title", "place").distinct()
    alike = values_alike(values)
    # Equal titles are alike as well; both kinds of edges run from the later to the earlier value.
    edges = checkpointed(alike.union(values.select("value", "value")).distinct())
    open_rows, kept = keyed.select("ord", "url", "value"), keyed.select("ord", "url").where("false")
    while True:
        by_value = open_rows.where("value is not null").groupBy("value").agg(F.min("ord").alias("low"))
        near = edges.join(by_value.withColumnRenamed("value", "old"), "old").groupBy(F.col("new").alias("value")).agg(F.min("low").alias("by_title"))
        by_url = open_rows.groupBy("url").agg(F.min("ord").alias("by_url"))
        staying = open_rows.join(by_url, "url").join(near, "value", "left").where((F.col("ord") <= F.col("by_url")) & (F.col("by_title").isNull() | (F.col("ord") <= F.col("by_title"))))
        staying = checkpointed(staying.select("ord", "url", "value"))
        if staying.isEmpty():
            return kept
        kept = kept.union(staying.select("ord", "url"))
        low = staying.where("value is not null").groupBy("value").agg(F.min("ord").alias("low"))
        struck = edges.join(low.withColumnRenamed("value", "old"), "old").groupBy(F.col("new").alias("value")).agg(F.min("low").alias("by_title"))
        urls = staying.groupBy("url").agg(F.min("ord").alias("by_url"))
        left = open_rows.join(staying.select("ord"), "ord", "left_anti").join(urls, "url", "left").join(struck, "value", "left")
        gone = F.coalesce(F.col("by_url") < F.col("ord"), F.lit(False)) | F.coalesce(F.col("by_title") < F.col("ord"), F.lit(False))
        open_rows = checkpointed(left.where(~gone).select("ord", "url", "value"))


def admissible(rows: DataFrame, least_title: int = 8) -> DataFrame:
    """Rows with a canonical URL and a title of at least so many characters."""
    return rows.where((canonical_url(F.col("url")) != "") & (F.length("title") >= least_title))


def fuzzy_dedup(rows: DataFrame, least: float = 0.72, scorer: str = "ratcliff") -> DataFrame:
    """Equal price digits and alike titles. Rows without digits or with an empty title key are never duplicates by title.

    Scorers are ``ratcliff``, ``levenshtein`` and ``levenshtein of bytes``.
    """
    price, title = digits(F.col("price")), title_key(F.col("title"))
    alike = (lambda v: like_values(v, least)) if scorer == "ratcliff" else (lambda v: like_values_native(v, least, scorer == "levenshtein of bytes"))
    return first_accepted(rows, alike, price, title, F.lit(""), (price == "") | (title == ""))


def place_dedup(rows: DataFrame, more_than: float = 0.6) -> DataFrame:
    """The older rule: equal price digits, one location within the other, and a ratio above the bound."""
    price, title, place = digits(F.col("price")), title_key(F.col("title")), F.lower(F.coalesce("location", F.lit("")))
    return first_accepted(rows, lambda v: like_values(v, more_than, strict=True, places=True), price, title, place, (price == "") | (title == ""))


def table_dedup(rows: DataFrame, least: float = 0.72) -> DataFrame:
    """Over a stored table: three more stopwords, and rows with an empty title key may be duplicates."""
    price, title = digits(F.col("price")), title_key(F.col("title"), more=True)
    return first_accepted(rows, lambda v: like_values(v, least), price, title, F.lit(""), price == "")


def first_per_url(rows: DataFrame) -> DataFrame:
    """The first admissible row of each canonical URL."""
    some = admissible(rows).withColumn("url", canonical_url(F.col("url")))
    return first_per_key(some, ["url"], [F.col("ord")])


def first_per_portal(rows: DataFrame) -> DataFrame:
    """The first row of each URL in its portal, admissible or not."""
    return first_per_key(rows.withColumn("url", canonical_url(F.col("url"))), ["source", "url"], [F.col("ord")])


def licence_dedup(rows: DataFrame, registry_id: Column, name: Column, municipality: Column) -> DataFrame:
    """The first row of each registry id, of those without one the first of each name and municipality; wholly blank rows are one."""
    blank = F.lit("")
    key = F.coalesce(F.nullif(registry_id, blank), F.lower(F.concat(F.coalesce(name, blank), F.lit("|"), F.coalesce(municipality, blank))))
    return first_per_key(rows.withColumn("__key", key), ["__key"], [F.col("ord")]).drop("__key")
