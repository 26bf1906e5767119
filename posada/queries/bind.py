"""The driver's tables in the roles of the operators' inputs, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-05-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table whose rows take much work each that one task gets.
ROWS_A_TASK = 10_000


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of small rows that are much work each, dealt to tasks by number: its few bytes alone would all go to one task."""
    rows = table(spark, sf_dir, name)
    return rows.repartition(max(1, -(-rows.count() // ROWS_A_TASK)), key)


def by_remainder(column: str, *values):  # noqa: ANN002, ANN201
    """The value at the column's remainder."""
    out = F.when(F.col(column) % len(values) == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(F.col(column) % len(values) == i, v)
    return out


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as listings, with the irregular prices, places and dates that portals give."""
    d = table(spark, sf_dir, "documents")
    n, i = F.col("n_chars").cast("string"), F.col("doc_id").cast("string")
    title = F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(120))
    word = F.split_part(title, F.lit(" "), F.lit(1))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    day = F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")), "dd/MM/yyyy")
    return d.select(
        F.col("doc_id").alias("ord"),
        say("https://www.", F.col("source"), ".example/es/", (F.col("doc_id") % 900).cast("string"), by_remainder("doc_id", F.lit("/"), F.lit("?ref=a"), F.lit("//"), F.lit(""))).alias("url"),
        title.alias("title"),
        by_remainder("doc_id", F.lit("Precio a consultar"), say(n, ".000 €"), say("€", n, ".500"), F.lit("1€"), say(n, ",000")).alias("price"),
        by_remainder(
            "doc_id", say(word, " with pool garage - â¬ 490,000"), say(word, " / ", word, " city"), say(word, ", Province of ", word), F.lit("España"), F.lit(""), F.lit(None).cast("string"), say(word, " (Costa) city")
        ).alias("location"),
        F.left("text", F.lit(1500)).alias("description"),
        "source",
        F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 13 == 0, "pronto").otherwise(day).alias("date"),
        F.when(F.col("doc_id") % 6 == 0, word).alias("location_city"),
        F.when(F.col("doc_id") % 4 == 0, F.col("lang")).when(F.col("doc_id") % 4 == 1, "").alias("location_region"),
        (F.col("n_chars") % 4).cast("int").alias("rooms"),
        F.when(F.col("doc_id") % 3 == 0, (F.col("n_chars") % 7).cast("int")).alias("beds"),
        F.when(F.col("doc_id") % 2 == 0, (F.col("n_chars") % 300).cast("int")).alias("m2"),
        F.when(F.col("doc_id") % 5 == 0, (F.col("doc_id") % 6).cast("int")).alias("stars"),
    )


LISTINGS = """
listings AS (
  SELECT doc_id AS ord,
    'https://www.' || source || '.example/es/' || (doc_id % 900)::VARCHAR || CASE doc_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '?ref=a' WHEN 2 THEN '//' ELSE '' END AS url,
    left(split_part(text, chr(10), 1), 120) AS title,
    CASE doc_id % 5 WHEN 0 THEN 'Precio a consultar' WHEN 1 THEN n_chars::VARCHAR || '.000 €' WHEN 2 THEN '€' || n_chars::VARCHAR || '.500' WHEN 3 THEN '1€' ELSE n_chars::VARCHAR || ',000' END AS price,
    CASE doc_id % 7 WHEN 0 THEN w || ' with pool garage - â¬ 490,000' WHEN 1 THEN w || ' / ' || w || ' city' WHEN 2 THEN w || ', Province of ' || w
      WHEN 3 THEN 'España' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE w || ' (Costa) city' END AS location,
    left(text, 1500) AS description, source,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'pronto' ELSE strftime(DATE '2023-01-01' + (doc_id % 700)::INT, '%d/%m/%Y') END AS date,
    CASE WHEN doc_id % 6 = 0 THEN w END AS location_city,
    CASE WHEN doc_id % 4 = 0 THEN lang WHEN doc_id % 4 = 1 THEN '' END AS location_region,
    (n_chars % 4)::INT AS rooms, CASE WHEN doc_id % 3 = 0 THEN (n_chars % 7)::INT END AS beds,
    CASE WHEN doc_id % 2 = 0 THEN (n_chars % 300)::INT END AS m2, CASE WHEN doc_id % 5 = 0 THEN (doc_id % 6)::INT END AS stars
  FROM (SELECT *, split_part(left(split_part(text, chr(10), 1), 120), ' ', 1) AS w FROM documents)
)"""


def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` with its nation as licence records, under the names that registries use."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    kinds = ("Casa rural", "Pensión", "Apartamentos", "Albergue", "Hotel", "Otro", "")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("ord"),
        F.when(F.col("c_custkey") % 10 != 0, (F.col("c_custkey") % 1200).cast("string")).otherwise("").alias("n_reg"),
        F.when(F.col("c_custkey") % 3 == 0, "—").otherwise(F.col("c_name")).alias("nombre"),
        F.concat(F.lit("Casa "), F.col("c_mktsegment")).alias("denominacion"),
        F.col("c_mktsegment").alias("localidad"),
        F.col("n_name").alias("provincia"),
        (F.col("c_custkey") % 7).cast("string").alias("categoria"),
        F.when(F.col("c_custkey") % 4 == 0, (F.col("c_custkey") % 50).cast("string")).alias("habitaciones"),
        F.when(F.col("c_custkey") % 5 != 0, (F.col("c_custkey") % 200).cast("string")).alias("plazas"),
        by_remainder("c_custkey", *(F.lit(k) for k in kinds)).alias("tipo"),
    )


LICENCES = """
licences AS (
  SELECT c_custkey AS ord, CASE WHEN c_custkey % 10 <> 0 THEN (c_custkey % 1200)::VARCHAR ELSE '' END AS n_reg,
    CASE WHEN c_custkey % 3 = 0 THEN '—' ELSE c_name END AS nombre, 'Casa ' || c_mktsegment AS denominacion, c_mktsegment AS localidad, n_name AS provincia,
    (c_custkey % 7)::VARCHAR AS categoria, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 50)::VARCHAR END AS habitaciones,
    CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 200)::VARCHAR END AS plazas,
    CASE c_custkey % 7 WHEN 0 THEN 'Casa rural' WHEN 1 THEN 'Pensión' WHEN 2 THEN 'Apartamentos' WHEN 3 THEN 'Albergue' WHEN 4 THEN 'Hotel' WHEN 5 THEN 'Otro' ELSE '' END AS tipo
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as sightings of listings (user) in runs of six hours."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("https://x.example/"), F.col("user_id").cast("string")).alias("url"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 21600").alias("run_no"), "event_type", "value", "event_id")


SIGHTINGS = "sightings AS (SELECT 'https://x.example/' || user_id::VARCHAR AS url, floor(epoch(ts) / 21600)::BIGINT AS run_no, event_type, value, event_id FROM events)"


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of part names and languages as keys, with regions' names; keys overlap and come more than once."""
    p, d, r = (table(spark, sf_dir, t) for t in ("part", "documents", "region"))
    part = p.select(F.left(F.lower("p_name"), (2 + F.col("p_partkey") % 4).cast("int")).alias("key"), (F.col("p_partkey") % 5).cast("int").alias("k"), F.col("p_partkey").alias("ord"))
    lang = d.groupBy("lang").agg(F.min("doc_id").alias("first")).select(F.col("lang").alias("key"), (F.ascii("lang") % 5).cast("int").alias("k"), (F.col("first") + 5).alias("ord"))
    return part.union(lang).join(r, F.col("k") == F.col("r_regionkey")).select(F.trim("key").alias("key"), F.col("r_name").alias("region"), "ord")


GAZETTEER = """
gazetteer AS (
  SELECT trim(key) AS key, r_name AS region, ord FROM (
    SELECT left(lower(p_name), (2 + p_partkey % 4)::INT) AS key, (p_partkey % 5)::INT AS k, p_partkey AS ord FROM part
    UNION ALL SELECT lang, (ascii(lang) % 5)::INT, min(doc_id) + 5 FROM documents GROUP BY lang
  ) JOIN region ON k = r_regionkey
),
ranked AS (SELECT key, arg_max(region, (ord, region)) AS region, min(ord) AS ord FROM gazetteer WHERE key <> '' GROUP BY key)"""
