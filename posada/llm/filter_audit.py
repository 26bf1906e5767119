"""Audit of how filters act on one another: what each removes at each place of every order, and its fair share of the blame.

Every document gets a mask, with a bit for each filter that it fails. Documents of one part and one mask are one cell, so
that the rest of the work does not grow with the documents: a part has 2^n cells at most. Each cell folds its mask across
the array of all orders (a constant of n! orders, n at most ``MOST_FILTERS``) with ``transform`` and ``aggregate``, which
gives one struct for each order and step, weighted with the cell's counts; a part is the elementwise sum of its cells'
arrays. Only DataFrame functions are used.

Filters of a text alone are given as conditions of failure. A copy filter compares texts of the whole table: a document
fails it if a document of a smaller id has the same text. It works on counts by 256-bit digest of the text, combined
before the shuffle, so that a text with a third of all rows costs no task its size. Only digests and small columns are
shuffled, never texts.

Null texts count as empty; so do null parts, which are the part ''. Rows without an id are audited too, but are no copies
of anything, and nothing is a copy of them. Repeated rows count each for itself; of rows of one id and one text none is
the other's copy. An id counts as good or toxic if any of its labels says so; null labels say nothing. An empty table
gives no row. Columns other than id, text and part are ignored, so that their names can't clash.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filters that can be audited at once: 720 orders.
MOST_FILTERS = 6
COPY = "copy"
#: What is counted for each order and step, in the order of the fold's sums.
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def words(text: Column) -> Column:
    """The maximal runs of signs other than blank and 09-0D."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def standard_filters(text: Column) -> dict[str, Column | str]:
    """Conditions of failure: few words, repetitive, shouting, markup signs, copy of an earlier document."""
    n_words, n_distinct = F.size(words(text)), F.size(F.array_distinct(words(text)))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n_words < 100,
        "B": F.lit(100) * n_distinct < F.lit(80) * n_words,
        "C": F.lit(100) * capitals > F.lit(10) * F.length(text),
        "D": text.rlike("[#$%&*|]"),
        "E": COPY,
    }


def marked(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(__id, good, toxic) of every labelled id."""
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))


def masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The cells (part, mask, n, good, toxic): how many documents of a part fail exactly the filters of the mask, and how many of them are good or toxic.

    Bit i of the mask is the i-th filter. Conditions of the filters are on a column named ``text`` that is never null.
    """
    filters = standard_filters(F.col("text")) if filters is None else filters
    plain = [(i, c) for i, c in enumerate(filters.values()) if not isinstance(c, str)]
    copies = sum(1 << i for i, c in enumerate(filters.values()) if isinstance(c, str))
    named = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    own = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in plain), F.lit(0))
    marks = named.select("__id", "part", own.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = marks.join(marked(labels, id_col), "__id", "left").na.fill(0, ["good", "toxic"])
    same = ["digest", "part", "mask", "good", "toxic"]
    # Rows lie by id after the join, so that this first count needs no exchange of its own.
    by_id = rows.groupBy("__id", *same).agg(F.count("*").alias("n"))
    groups = by_id.groupBy(*same).agg(F.sum("n").alias("n"), F.min(F.when(F.col("__id").isNotNull(), F.struct("__id", "n"))).alias("least"), F.sum(F.when(F.col("__id").isNull(), F.col("n"))).alias("nameless"))
    # A text has as many groups as parts and labels tell apart, so that this window stays small whatever the number of copies.
    met = groups.withColumn("first", F.min("least.__id").over(Window.partitionBy("digest")))
    no_copies = F.coalesce("nameless", F.lit(0)) + F.when(F.col("least.__id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), no_copies.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copies)).alias("mask"), (F.col("n") - no_copies).alias("n"))))
    cells = met.select("part", "good", "toxic", split.alias("cell")) if copies else met.select("part", "good", "toxic", F.struct("mask", "n").alias("cell"))
    return cells.groupBy("part", F.col("cell.mask").alias("mask")).agg(F.sum("cell.n").alias("n"), F.sum(F.col("cell.n") * F.col("good")).alias("good"), F.sum(F.col("cell.n") * F.col("toxic")).alias("toxic"))


def _folded(orders: Column, n_filters: int) -> Column:
    """A cell's weighted structs, one for each order and step: the mask is folded along each order, with whether the cell is still there."""

    def step(done: Column, bit: Column) -> Column:
        fails = F.col("mask").bitwiseAND(bit) != 0
        there = done["there"]
        out = there & fails
        counted = F.struct(
            F.when(there & ~fails, F.col("n")).otherwise(0).alias("kept"),
            F.when(out, F.col("n")).otherwise(0).alias("removed"),
            F.when(~there & fails, F.col("n")).otherwise(0).alias("redundant"),
            F.when(F.col("mask") == bit, F.col("n")).otherwise(0).alias("unique_fails"),
            F.when(out, F.col("good")).otherwise(0).alias("good_lost"),
            F.when(out, F.col("toxic")).otherwise(0).alias("toxic_lost"),
        )
        return F.struct((there & ~fails).alias("there"), F.array_append(done["steps"], counted).alias("steps"))

    kind = "array<struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">>"
    start = F.struct(F.lit(True).alias("there"), F.array().cast(kind).alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda done: done["steps"])))


def _summed(arrays: Column, n: int) -> Column:
    """The elementwise sums of a part's arrays; a part has no more of them than there are masks."""
    zeros = F.array_repeat(F.struct(*(F.lit(0).cast("long").alias(m) for m in MEASURES)), n)
    add = lambda a, b: F.struct(*((a[m] + b[m]).alias(m) for m in MEASURES))
    return F.aggregate(arrays, zeros, lambda total, one: F.zip_with(total, one, add))


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, the measures, shapley) for every part of the cells, every order of the filters and every step of it.

    ``kept`` counts what is left after the step, ``removed`` what goes there, ``redundant`` what fails its filter but has gone
    earlier, ``unique_fails`` what fails that filter only; ``shapley`` is what its filter removes in all orders together.
    """
    if not 0 < len(letters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters can be audited, not {len(letters)}")
    orders = ["".join(p) for p in permutations(letters)]
    bits = F.array(*(F.array(*(F.lit(1 << letters.index(c)) for c in order)) for order in orders))
    names = F.array(*(F.lit(o) for o in orders))
    n = len(letters)
    parts = cells.groupBy("part").agg(F.collect_list(_folded(bits, n)).alias("arrays")).select("part", _summed(F.col("arrays"), n * len(orders)).alias("sums"))
    rows = parts.select("part", F.posexplode("sums").alias("at", "sum"))
    placed = rows.select("part", F.get(names, F.floor(F.col("at") / n).cast("int")).alias("filter_order"), (F.col("at") % n + 1).cast("int").alias("step"), "sum.*")
    letter = F.substr("filter_order", F.col("step"), F.lit(1))
    share = F.sum("removed").over(Window.partitionBy("part", letter))
    return placed.select("part", "filter_order", "step", *MEASURES, share.alias("shapley"))


def audit_documents(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str] | None = None, **names: str) -> DataFrame:
    """The audit of the documents by the filters (letter: condition of failure on ``text``, or ``COPY``), by default the standard ones."""
    filters = standard_filters(F.col("text")) if filters is None else filters
    return audit(masks(docs, labels, filters, **names), "".join(filters))
