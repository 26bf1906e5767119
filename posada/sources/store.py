"""JSON sources and sinks. The store itself is versioned Parquet; JSON is for exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from posada.operators.order import first_per_key, latest_first
from posada.schema import LISTING


def read_json(spark: SparkSession, path: str, schema: T.StructType = LISTING, on_corrupt: str = "fail") -> DataFrame:
    """A JSON array (or JSON lines) as rows of the schema, with their order. ``on_corrupt='empty'`` reads a broken file as no rows."""
    mode = "FAILFAST" if on_corrupt == "fail" else "PERMISSIVE"
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(corrupt).option("multiLine", True).option("mode", mode).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.withColumn("ord", F.monotonically_increasing_id())
    if on_corrupt == "empty":
        # A broken record alone can't be asked for, so one more column is counted with it.
        broken = rows.agg(F.count("_corrupt").alias("broken"), F.count(schema.fieldNames()[0])).first().broken
        rows = rows.where(F.lit(broken == 0))
    return rows.drop("_corrupt")


def last_per_key(rows: DataFrame, key: str) -> DataFrame:
    """An index by key: of several records the last one counts. Rows without the key are dropped."""
    return first_per_key(rows.where(F.col(key).isNotNull()), [key], [F.col("ord")], last=True)


# Keys under which a licence file may hold its list, in the order in which they are tried.
LIST_KEYS = ("licencias", "hoteles", "data", "items", "results")


def licence_records(files: DataFrame, text: str = "value") -> DataFrame:
    """(record VARIANT, ord) of whole JSON texts, one per row.

    A list gives its elements; an object the first of its ``LIST_KEYS`` that holds a list, else its values: lists
    are flattened, objects are records. Anything else, broken JSON included, gives nothing.
    """
    root = files.select(F.monotonically_increasing_id().alias("file"), F.try_parse_json(F.col(text)).alias("root"))
    kind = F.schema_of_variant("root")
    lists = F.coalesce(*(F.when(F.schema_of_variant(v).startswith("ARRAY"), v) for v in (F.try_variant_get("root", f"$.{k}", "variant") for k in LIST_KEYS)))
    chosen = F.when(kind.startswith("ARRAY"), F.col("root")).otherwise(lists)
    root = root.where("root is not null").withColumn("list", chosen).withColumn("is_object", kind.startswith("OBJECT"))
    spark = files.sparkSession
    direct = spark.sql("select file, 0 as part, x.pos, x.value as record from {roots}, lateral variant_explode(list) x where list is not null", roots=root)
    values = spark.sql("select file, x.pos as part, x.value from {roots}, lateral variant_explode(root) x where list is null and is_object", roots=root)
    values = values.withColumn("kind", F.schema_of_variant("value"))
    nested = spark.sql("select file, part, x.pos, x.value as record from {parts}, lateral variant_explode(value) x where kind like 'ARRAY%'", parts=values)
    single = values.where("kind like 'OBJECT%'").select("file", "part", F.lit(0).alias("pos"), F.col("value").alias("record"))
    return direct.union(nested).union(single).select("record", F.struct("file", "part", "pos").alias("ord"))


def read_licences(spark: SparkSession, path: str) -> DataFrame:
    """Licence records of plain or gzipped JSON files; a file is read by one task."""
    return licence_records(spark.read.text(path, wholetext=True))


def licence_fields(records: DataFrame, names: list[str]) -> DataFrame:
    return records.select("ord", *(F.try_variant_get("record", f"$.{n}", "string").alias(n) for n in names))


def optional_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A side input: its rows, or none where there is no file."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


#: Parts of a table that is stored by the hashes of its keys.
PARTS = 64


class PartedTable:
    """A table in parts by the hash of its key, each with versions of its own, so that a run rewrites only the parts whose rows it changes.

    A version of a part is a folder that is never written to again; the table's version is a small list of the parts' versions, written
    last. A write that fails leaves the former list, and every former list can be read as long as it is kept. Rows with a null key are one part's.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "url", parts: int = PARTS):
        self.spark, self.root, self.key, self.parts = spark, root, key, parts

    def _lists(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("version long, part int, of long").json(f"{self.root}/versions")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def version(self) -> int:
        """The last version, 0 before the first write."""
        lists = self._lists()
        return 0 if lists is None else lists.agg(F.max("version")).first()[0] or 0

    def versions_of_parts(self, version: int | None = None) -> dict[int, int]:
        lists = self._lists()
        if lists is None:
            return {}
        at = self.version() if version is None else version
        return {r.part: r.of for r in lists.where((F.col("version") == at) & (F.col("part") >= 0)).collect()}

    def part_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def read(self, schema: T.StructType, version: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """The table, or some parts of it, as of a version."""
        paths = [f"{self.root}/part={p}/v={v}" for p, v in self.versions_of_parts(version).items() if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, parts: list[int]) -> int:
        """A new version: the parts given are the rows, all others stay as they are. Rows of other parts are not written."""
        version, known = self.version() + 1, self.versions_of_parts()
        some = rows.withColumn("__part", self.part_of(F.col(self.key))).where(F.col("__part").isin(*parts)).repartition(max(1, len(parts)), "__part")
        # Folders are made by one write, and moved to their parts' versions by name only.
        some.withColumnRenamed("__part", "part").write.partitionBy("part").parquet(f"{self.root}/incoming={version}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for p in parts:
            source, target = path(f"{self.root}/incoming={version}/part={p}"), path(f"{self.root}/part={p}/v={version}")
            fs.delete(target, True)  # of a write that failed
            fs.mkdirs(target.getParent())
            if fs.exists(source):
                fs.rename(source, target)
                known[p] = version
            else:
                known.pop(p, None)
        fs.delete(path(f"{self.root}/incoming={version}"), True)
        now = [(version, p, v) for p, v in sorted(known.items())] or [(version, -1, -1)]  # a table without rows has no part
        self.spark.createDataFrame(now, "version long, part int, of long").coalesce(1).write.mode("append").json(f"{self.root}/versions")
        return version

    def changed_parts(self, changes: DataFrame) -> list[int]:
        """The parts in which the rows' keys are; at most as many as there are parts."""
        return sorted(r.p for r in changes.select(self.part_of(F.col(self.key)).alias("p")).distinct().collect())

    def upsert(self, changes: DataFrame) -> int:
        """Rows of known keys replace theirs, others come in; one row per key. Reads and writes only the parts of those keys."""
        parts = self.changed_parts(changes)
        old = self.read(changes.schema, parts=parts)
        return self.write(old.join(changes.select(self.key), self.key, "left_anti").select(*changes.columns).unionByName(changes), parts)


def save_version(rows: DataFrame, root: str, version: int) -> str:
    """Writes the table as a further version, so that the former one is the backup; gives the path."""
    path = f"{root}/v{version:08d}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def publish(rows: DataFrame, path: str) -> None:
    """All rows, latest first, as JSON lines in files whose names keep the order."""
    latest_first(rows).drop("ord").write.mode("overwrite").json(path)


def document(rows: DataFrame) -> DataFrame:
    """One row with the whole table as one JSON array, latest first. For small tables only: everything meets in one row."""
    columns = [c for c in rows.columns if c != "ord"]
    from posada.functions.dates import sort_date

    # Days before the common era do not occur, so a day's negative number sorts the latest first.
    keyed = F.struct((-F.datediff(sort_date(F.col("date")), F.lit("1970-01-01").cast("date"))).alias("k"), F.col("ord").alias("o"), F.struct(*columns).alias("r"))
    return rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["r"])).alias("json"))


def is_valid_json(c):  # noqa: ANN001, ANN201
    return F.try_parse_json(c).isNotNull()
