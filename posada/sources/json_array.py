"""One JSON array in a file of any size, read by many tasks, and written in order by many tasks.

Spark's own reader gives a file that is one array to one task. Here the file is read as text between closing braces, which Hadoop's
readers split by byte ranges wherever Spark can open the path. Whether a piece begins within a string, and how deep, depends on
all that comes before it, so each range is summed up for both cases (begins outside or inside a string); running sums over the ranges,
one small row each, settle the cases, and running sums within a range give each piece its depth and the number of its record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posada.operators.order import latest_first

_RANGE = ["file", "block"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, i, value, signs): the text between closing braces, by range and in order; signs are its quotes and brackets that no backslash precedes.

    Signs are small, and all that decides where records end; whole texts are shuffled once.
    """
    source = spark.read.option("lineSep", "}").text(path)
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    signs = F.regexp_replace("value", r'(?s)\\.|[^"\[\]{\\]+', "")
    return source.select(*at, F.monotonically_increasing_id().alias("i"), "value", signs.alias("signs")).repartition(*_RANGE)


def _depth(signs: Column) -> Column:
    """How much deeper the brackets outside strings lead."""
    return F.length(F.translate(signs, "]", "")) - F.length(F.translate(signs, "[{", ""))


def _with_cases(pieces: DataFrame) -> DataFrame:
    """How quotes and depth change over a piece and its brace, if its range begins outside (0) or inside (1) a string."""
    outside = F.regexp_replace("signs", r'"[^"]*("|\z)', "")
    inside = F.regexp_replace(F.regexp_replace("signs", r'\A[^"]*("|\z)', ""), r'"[^"]*("|\z)', "")
    quotes = (F.length("signs") - F.length(F.translate("signs", '"', ""))) % 2
    before = Window.partitionBy(*_RANGE).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.withColumn("quotes", quotes).withColumn("began", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    for case in (0, 1):
        within = (F.col("began") + case) % 2 == 1
        ends_within = (F.col("began") + case + F.col("quotes")) % 2 == 1
        change = _depth(F.when(within, inside).otherwise(outside)) - F.when(ends_within, 0).otherwise(1)
        rows = rows.withColumns({f"change_{case}": change, f"closes_{case}": ~ends_within})
    return rows


def array_texts(spark: SparkSession, path: str, on_corrupt: str = "fail") -> DataFrame:
    """(file, at, text): the objects of the arrays in files, each with its place from 0.

    A file holds one array of objects, in UTF-8; an empty file or array has none. A file that does not end its array is broken: 'fail'
    fails, 'skip' gives none of its records. Elements that are no objects come as text before the next object, which then does not parse.
    A compressed file is read by one task. Ranges are of ``spark.sql.files.maxPartitionBytes``.
    """
    cases = _with_cases(_pieces(spark, path))
    sums = cases.groupBy(*_RANGE).agg(*(F.sum(c).alias(c) for c in ("quotes", "change_0", "change_1")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    sums = sums.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    sums = sums.withColumn("change", F.when(F.col("inside"), F.col("change_1")).otherwise(F.col("change_0")))
    # No brace follows the last piece of a file, so a sound array sums up to one less than none.
    sound = (F.sum("change").over(whole) == -1) & (F.sum("quotes").over(whole) % 2 == 0)
    starts = sums.select(*_RANGE, "inside", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"), sound.alias("sound"))

    upto = Window.partitionBy(*_RANGE).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*_RANGE).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = cases.join(starts, _RANGE).withColumn("change", F.when(F.col("inside"), F.col("change_1")).otherwise(F.col("change_0")))
    rows = rows.withColumn("closes", F.when(F.col("inside"), F.col("closes_1")).otherwise(F.col("closes_0")))
    ends = F.col("closes") & (F.col("depth") + F.sum("change").over(upto) == 1)
    rows = rows.select(*_RANGE, "i", "value", "sound", ends.cast("int").alias("ends"))
    complete = F.col("sound") if on_corrupt == "skip" else F.when(F.col("sound"), True).otherwise(F.raise_error(F.concat(F.lit("not one whole JSON array: "), "file")).cast("boolean"))
    rows = rows.where(complete)

    counts = rows.groupBy(*_RANGE).agg(F.sum("ends").alias("n"))
    firsts = counts.select(*_RANGE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    at = F.col("first") + F.coalesce(F.sum("ends").over(earlier), F.lit(0))
    placed = rows.join(firsts, _RANGE).select("file", at.alias("at"), "ends", F.struct("block", "i", "value").alias("piece"))
    records = placed.groupBy("file", "at").agg(F.max("ends").alias("ended"), F.array_sort(F.collect_list("piece")).alias("pieces")).where("ended = 1")
    text = F.concat(F.array_join(F.transform("pieces", lambda p: p["value"]), "}"), F.lit("}"))
    lead = F.when(F.col("at") == 0, F.regexp_replace(text, r"\A\s*\[\s*", "")).otherwise(F.regexp_replace(text, r"\A\s*,\s*", ""))
    return records.select("file", "at", lead.alias("text"))


def read_array(spark: SparkSession, path: str, schema: T.StructType, on_corrupt: str = "fail") -> DataFrame:
    """The records of ``array_texts`` as rows of the schema, with ``file`` and ``ord`` (the place in the array).

    A record that does not parse fails the read ('fail') or is left out ('skip'). Unknown fields are ignored, missing ones are null;
    fields of the names ``file`` and ``ord`` are not read.
    """
    corrupt = T.StructType([*schema.fields, T.StructField("__corrupt", T.StringType())])
    options = {"mode": "FAILFAST" if on_corrupt == "fail" else "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}
    rows = array_texts(spark, path, on_corrupt).select("file", F.col("at").alias("ord"), F.from_json("text", corrupt, options).alias("r"))
    return rows.where("r.__corrupt is null").select(*(F.col("r")[n].alias(n) for n in schema.fieldNames() if n not in ("file", "ord")), "file", "ord")


def read_licence_array(spark: SparkSession, path: str, on_corrupt: str = "fail") -> DataFrame:
    """(record VARIANT, ord) of licence files that are one array each, by many tasks; as ``store.read_licences`` gives it for such files.

    ``store.read_licences`` also reads files whose list is within an object, one task a file. A record that does not parse fails the read
    ('fail') or is left out ('skip').
    """
    parse = F.parse_json if on_corrupt == "fail" else F.try_parse_json
    rows = array_texts(spark, path, on_corrupt).select(parse("text").alias("record"), F.struct("file", "at").alias("ord"))
    return rows.where("record is not null")


#: The name of the file that ends a document in parts; it comes after all parts.
END = "z-end"


def write_array(rows: DataFrame, folder: str, date: str = "date", order: str = "ord") -> None:
    """All rows, latest first, as one JSON array in parts: the files of the folder, one after the other by name, are the document.

    Parts are ranges of the order, one task each; only the very first row of all begins the array, so nothing is numbered or collected.
    ``order`` breaks ties and is not written. A table without rows is an empty array.
    """
    spark = rows.sparkSession
    ranked = latest_first(rows, date, order)
    record = F.to_json(F.struct(*(c for c in rows.columns if c != order)))
    # The first partition of a sort is never empty unless all are; its first row has the id 0.
    lead = F.when(F.monotonically_increasing_id() == 0, "[").otherwise(",")
    ranked.select(F.concat(lead, record).alias("value")).write.mode("overwrite").text(folder)
    fs, path, parts = _parts(spark, folder)
    if parts and "part-00000" not in parts[0].getName():
        raise RuntimeError(f"{folder}: the first part holds no rows")
    out = fs.create(path(folder, END), True)
    out.write(bytearray(b"]" if parts else b"[]"))
    out.close()


def _parts(spark: SparkSession, folder: str) -> tuple:
    """The file system, its class of paths, and the parts that hold rows, by name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path(folder)) if s.getLen() > 0 and s.getPath().getName().startswith("part-")]
    return fs, path, sorted(found, key=lambda p: int(p.getName().split("-")[1]))


def join_parts(spark: SparkSession, folder: str, target: str) -> None:
    """The parts of a document as one file. Bytes pass through the driver in pieces of 1 MB, never as a whole; readers of many files don't need it."""
    fs, path, parts = _parts(spark, folder)
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    out = fs.create(path(target), True)
    for part in [*parts, path(folder, END)]:
        source = fs.open(part)
        copy(source, out, 1 << 20, False)
        source.close()
    out.close()
