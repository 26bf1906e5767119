"""Queries of reports, order and limits, work lists and publishing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posada.functions.places import clean_place
from posada.functions.text import canonical_url, clean
from posada.operators import dedup, enrich, merge, order, report
from posada.sources import store

from . import bind
from .functions import TRIM, _f9, _tags, unescaped
from .joins import STORED, stored

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):  # noqa: ANN201
    def add(query):  # noqa: ANN001, ANN202
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = sql
        return query

    return add


_fields = {"rooms": "coalesce(rooms, 0) <> 0", "beds": "coalesce(beds, 0) <> 0", "m2": "coalesce(m2, 0) <> 0", "stars": "coalesce(stars, 0) <> 0", "location_region": "coalesce(location_region, '') <> ''"}


@register("a1_coverage", f"WITH {bind.LISTINGS} " + " UNION ALL ".join(f"SELECT '{n}' AS field, count(*) FILTER ({e}) AS filled, count(*) FILTER ({e}) * 100 // count(*) AS percent, count(*) AS total FROM listings" for n, e in _fields.items()))
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.coverage(bind.listings(spark, sf_dir), list(_fields))


_line = lambda v, t: f"SELECT '{v}' AS version, count(*) AS total, count(*) FILTER (coalesce(location_region, '') <> '') AS with_region, count(*) FILTER (location IS NOT NULL AND location NOT IN ('España', 'Espana', '')) AS with_location FROM {t}"
_after = f"after AS (SELECT ord, title, price, {_f9} AS location, coalesce(nullif(location_region, ''), location_city) AS location_region FROM listings)"


def cleaned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("location", clean_place(c("location"))).withColumn("location_region", F.coalesce(F.nullif("location_region", F.lit("")), c("location_city")))


@register("a2_before_after", f"WITH {bind.LISTINGS}, {_after} {_line('before', 'listings')} UNION ALL {_line('after', 'after')}")
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.listings(spark, sf_dir)
    return report.before_after(rows, cleaned(rows))


@register("a3_changes", f"WITH {bind.LISTINGS}, {_after} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (a.{f} IS DISTINCT FROM b.{f}) AS changed FROM listings b JOIN after a USING (ord)" for f in ("location", "location_region", "price")))
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.listings(spark, sf_dir)
    return report.changes(rows, cleaned(rows), ["location", "location_region", "price"], key="ord")


@register("a4_by_source", f"WITH {bind.LISTINGS} SELECT source, count(*) AS n, min(ord) AS first_ord FROM listings GROUP BY source")
def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_source(bind.listings(spark, sf_dir))


@register("a5_unresolved_top_k", f"WITH {bind.LISTINGS} SELECT location, count(*) AS n, min(ord) AS first_ord FROM listings WHERE coalesce(location_region, '') = '' AND coalesce(location, '') <> '' GROUP BY location ORDER BY n DESC, first_ord LIMIT 20")
def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.unresolved(bind.listings(spark, sf_dir), 20)


@register(
    "a6_run_statistics",
    f"WITH {bind.LISTINGS}, {STORED}, m AS (SELECT coalesce(o.source, s.source) AS source, o.url IS NULL AS new, s.url IS NOT NULL AS hit, s.url IS NULL AND o.ausencias + 1 >= 3 AS gone FROM stored o FULL JOIN seen s USING (url)) "
    "SELECT source, count(*) FILTER (hit) AS found, count(*) FILTER (new) AS new, count(*) FILTER (gone) AS evicted, count(*) FILTER (NOT gone) AS total FROM m GROUP BY source",
)
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.run_statistics(merge.merge_run(*stored(spark, sf_dir)))


@register("a7_outcomes", f"WITH {bind.LISTINGS} SELECT CASE WHEN ord % 9 = 0 THEN 'failed' WHEN beds IS NOT NULL OR m2 IS NOT NULL THEN 'enriched' ELSE 'skipped' END AS outcome, count(*) AS n FROM listings GROUP BY 1")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.outcomes(bind.listings(spark, sf_dir).withColumn("failed", c("ord") % 9 == 0), ["beds", "m2"])


_day = "CASE WHEN date IS NULL OR date = '' THEN DATE '2000-01-01' ELSE coalesce(try_strptime(date, '%d/%m/%Y')::DATE, DATE '0001-01-01') END"


@register("o1_latest_first", f"WITH {bind.LISTINGS} SELECT ord, row_number() OVER (ORDER BY {_day} DESC, ord) AS place FROM listings")
def latest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    from posada.functions.dates import sort_date

    rows = bind.listings(spark, sf_dir).select("ord", "date")
    keys = [F.desc(sort_date(c("date"))), c("ord")]
    return order.numbered(rows, keys, "place").select("ord", (c("place") + 1).alias("place"))


@register("o2_first_in_order", f"WITH {bind.LISTINGS} SELECT ord, title FROM listings ORDER BY ord LIMIT 25")
def first_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.in_table_order(bind.listings(spark, sf_dir), 25).select("ord", "title")


@register("o3_sample_licences", f"WITH {bind.LICENCES} SELECT ord, n_reg AS n_registro FROM (SELECT ord, CASE WHEN n_reg NOT IN ('', '—', '-') THEN n_reg END AS n_reg FROM licences ORDER BY ord LIMIT 10)")
def sample_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from posada.operators.model import resolve_aliases

    return order.in_table_order(resolve_aliases(bind.licences(spark, sf_dir)), 10).select("ord", "n_registro")


@register("o4_strided", f"WITH {bind.LISTINGS} SELECT ord, (ord % 3)::INT AS worker FROM listings")
def strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.strided(bind.listings(spark, sf_dir), 3).select("ord", "worker")


@register("p2_admission", f"WITH {bind.LISTINGS} SELECT ord FROM listings WHERE length(title) >= 8")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.admissible(bind.listings(spark, sf_dir)).select("ord")


@register("p5_work_list", f"WITH {bind.LISTINGS} SELECT ord FROM listings WHERE source IN ('src0', 'src3') AND coalesce(rooms, 0) = 0 AND coalesce(beds, 0) = 0 AND coalesce(m2, 0) = 0")
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.work_list(bind.listings(spark, sf_dir), ["src0", "src1", "src3"], sources=["src0", "src3"]).select("ord")


@register("k3_published_document", None)
def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The single document is for tables that a report shows: here the counts by source.
    rows = report.by_source(bind.listings(spark, sf_dir)).withColumnRenamed("first_ord", "ord").withColumn("date", F.lit("31/05/2024"))
    return store.document(rows)


@register(
    "k3_published_listings",
    f"WITH {bind.LISTINGS} SELECT row_number() OVER (ORDER BY CASE WHEN date IS NULL OR date = '' THEN DATE '2000-01-01' ELSE coalesce(try_strptime(date, '%d/%m/%Y')::DATE, DATE '0001-01-01') END DESC, ord) - 1 AS ord, "
    "url, price, date, rooms, md5(title) AS title, md5(description) AS description FROM listings",
)
def published_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listings published as one JSON document, latest first, and that document read again by ranges, with each record's place."""
    import uuid

    from posada.operators.shared import folder
    from posada.sources import json_array

    rows = bind.listings(spark, sf_dir)
    path = f"{folder(spark)}/document-{uuid.uuid4().hex}"
    json_array.write_array(rows, f"{path}/parts")
    json_array.join_parts(spark, f"{path}/parts", f"{path}/listings.json")
    read = json_array.read_array(spark, f"{path}/listings.json", rows.schema)
    return read.select("ord", "url", "price", "date", "rooms", F.md5("title").alias("title"), F.md5("description").alias("description"))


_title = TRIM(unescaped(_tags("regexp_extract(html, '<title>(.*?)</title>', 1)")))
_url = "regexp_replace(split_part(trim(coalesce(url, '')), '?', 1), '/+$', '')"


@register("e0_hosts", f"WITH p AS (SELECT {_url} AS url, min(page_id) AS page_id, arg_min({_title}, page_id) AS title FROM pages GROUP BY {_url}) SELECT regexp_extract(url, '^https?://([^/#?]+)', 1) AS host, count(*) AS n, min(title) AS title FROM p GROUP BY 1")
def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs, cleaned titles, the first page of each URL, counts by host."""
    pages = bind.table(spark, sf_dir, "pages").select(canonical_url(c("url")).alias("url"), "page_id", clean(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"))
    first = order.first_per_key(pages, ["url"], [c("page_id")])
    return first.groupBy(F.regexp_extract("url", "^https?://([^/#?]+)", 1).alias("host")).agg(F.count("*").alias("n"), F.min("title").alias("title"))
