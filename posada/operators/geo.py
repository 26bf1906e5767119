"""Regions from text by a gazetteer (key, region, ord).

The keys are compiled into Aho-Corasick automata: a text is read once, whatever the number of keys, and every place where a key ends
gives its rank. Rows are not moved: regions are columns, worked out where the rows lie. A gazetteer of more than ``SHARD_BYTES``
is cut into shards by hash of the key, each an automaton of its own that texts pass one after another; the best rank of all counts.

Null texts have no region; an empty text holds no key. Empty keys are left out; of a key given twice the last region counts, at the
first one's place; of keys at one place the least counts. An empty gazetteer gives null everywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the keys of one automaton, which takes some fifty times as much in a worker, and shards whose keys are sent out at once.
SHARD_BYTES, SHARDS_AT_ONCE = 2_000_000, 8
#: Automata that a worker keeps, by a name of their broadcast.
_BUILT: dict[str, ahocorasick.Automaton] = {}


def ranked(gazetteer: DataFrame, by_length: bool = True) -> DataFrame:
    """(key, region, rank): of a key given twice the last region counts, at the first one's place; lower ranks win."""
    keys = gazetteer.where("key is not null and key != ''").groupBy("key").agg(F.max_by("region", F.struct("ord", "region")).alias("region"), F.min("ord").alias("ord"))
    return keys.select("key", "region", F.struct((-F.length("key") if by_length else F.lit(0)).alias("length"), F.col("ord").cast("long").alias("ord")).alias("rank"))


def automaton(keys: list[str]) -> ahocorasick.Automaton:
    """Finds all keys in one pass; each gives its place in the list."""
    found = ahocorasick.Automaton()
    for i, key in enumerate(keys):
        found.add_word(key, i)
    found.make_automaton()
    return found


def best_of(machine: ahocorasick.Automaton, text: str) -> int:
    """The least place of a key that the text holds, -1 if none."""
    best = -1
    for _, place in machine.iter(text):
        if best < 0 or place < best:
            best = place
            if not best:
                break
    return best


class Gazetteer:
    """A gazetteer compiled for a session; ``region`` gives the region of a text column."""

    def __init__(self, spark: SparkSession, gazetteer: DataFrame, by_length: bool = True, whole_words: bool = False):
        keys = ranked(gazetteer, by_length)
        size = keys.agg(F.sum(F.octet_length("key"))).first()[0] or 0
        self.whole_words = whole_words
        self.shards = []
        n = -(-size // SHARD_BYTES)
        if n > SHARDS_AT_ONCE:
            raise ValueError(f"a gazetteer of {size} bytes; cut it into parts of {SHARDS_AT_ONCE * SHARD_BYTES} and take the best rank of their regions")
        for i in range(n):
            part = keys.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i).orderBy("rank", "key").collect()
            names = [f" {r.key} " if whole_words else r.key for r in part]
            values = [(r["rank"].length, r["rank"].ord, r.key, r.region) for r in part]
            self.shards.append((uuid.uuid4().hex, spark.sparkContext.broadcast((names, values))))

    def _hit(self, shard: tuple, text: Column) -> Column:
        name, sent = shard

        @F.pandas_udf("length int, ord long, key string, region string")
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            names, values = sent.value
            if name not in _BUILT:
                if len(_BUILT) >= SHARDS_AT_ONCE:
                    _BUILT.clear()
                _BUILT[name] = automaton(names)
            machine = _BUILT[name]
            none = (None, None, None, None)
            for texts in batches:
                hits = [-1 if t is None else best_of(machine, t) for t in texts]
                out = pd.DataFrame([values[i] if i >= 0 else none for i in hits], columns=["length", "ord", "key", "region"])
                yield out.astype({"length": "Int32", "ord": "Int64"})

        return find(text)

    def best(self, text: Column) -> Column:
        """struct(length, ord, key, region) of the best key in the text, its fields null if there is none."""
        hay = F.concat(F.lit(" "), text, F.lit(" ")) if self.whole_words else text
        found = [self._hit(shard, hay) for shard in self.shards]
        if not found:
            return F.lit(None).cast("struct<length:int,ord:bigint,key:string,region:string>")
        # A null field is the least in an order of structs, so that no hit must be no struct.
        hits = [F.when(h["length"].isNotNull(), h) for h in found]
        return hits[0] if len(hits) == 1 else F.least(*hits)

    def region(self, text: Column) -> Column:
        return self.best(text)["region"]


def regions_of(texts: DataFrame, gazetteer: DataFrame, text: str, by_length: bool = True, whole_words: bool = False) -> DataFrame:
    """(text, region) for each distinct text: the region of the key that it contains, the longest one or the first one; null if none."""
    compiled = Gazetteer(texts.sparkSession, gazetteer, by_length, whole_words)
    distinct = texts.select(F.col(text)).where(F.col(text).isNotNull()).distinct()
    return distinct.withColumn("region", compiled.region(F.col(text)))


def infer_region(rows: DataFrame, gazetteer: DataFrame, sources: list[Column], target: str = "location_region", by_length: bool = True, whole_words: bool = False) -> DataFrame:
    """Fills the region of rows that have none from the first source that holds a key, in one pass over the rows. Sources are already normalised texts."""
    compiled = Gazetteer(rows.sparkSession, gazetteer, by_length, whole_words)
    missing = F.coalesce(F.col(target), F.lit("")) == ""
    first = F.coalesce(*(compiled.region(F.when(missing, s)) for s in sources))
    return rows.withColumn(target, F.when(missing, F.coalesce(first, F.col(target))).otherwise(F.col(target)))
