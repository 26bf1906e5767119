"""Document fingerprints from spot signatures, with DataFrame functions only.

Where a very common word (an anchor) is followed by a content word, that word and the next content word form a
chain, and anchor and chain a signature. A fingerprint is the set of a text's signatures, as sorted 32-bit
hashes; two texts are as alike as the Jaccard similarity of their sets. ``near_pairs`` joins documents on it:
fingerprints are partitioned by the length of their sets, so that only the own and the next partition can
hold a partner, and candidates share one of the rarest-first prefix signatures that any partner must share.

A text without any anchor before a content word is fingerprinted by its words, one without words has an empty
fingerprint. Null texts count as empty. Two empty fingerprints are alike (1.0). Equal texts have equal ones. Rows with one
id are put in the order of their texts' hashes; a row without an id has no next one. Texts of any length are worked on
whole, an empty table gives an empty one, and columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import ensure_checkpoints

#: Very common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to a in is it that for on with as are be was this by he from at or an have not "
    "der die das und zu von mit den im ein eine ist für auf dem nicht sich auch "
    "le la les des du et en un une est que qui dans pour par sur au avec "
    "el los las y del se una con por para su no lo al es"
).split()
#: A chain's second word is looked for among so many words after its first one.
REACH = 4
#: Documents of one window when each is given the next one.
SPAN_BITS = 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def signatures(text: Column) -> Column:
    """The sorted distinct signature hashes of a text."""
    anchors = [a for a in ANCHORS]

    def from_words(w: Column) -> Column:
        def chain(word: Column, i: Column) -> Column:
            first = F.get(w, i + 1)
            second = F.coalesce(*(F.when(~F.get(w, i + k).isin(anchors), F.get(w, i + k)) for k in range(2, 2 + REACH)), F.lit(""))
            return F.when(word.isin(anchors) & ~first.isin(anchors), F.hash(word, first, second))

        spots = F.filter(F.transform(w, chain), lambda x: x.isNotNull())
        return F.when(F.size(spots) > 0, spots).otherwise(F.transform(w, lambda x: F.hash(x)))

    # A one-element array binds the words, so that they are split once.
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array(words(F.coalesce(text, F.lit("")))), from_words))))


def printed(sigs: Column) -> Column:
    """A fingerprint as text: its hashes in eight hexadecimal digits each, comma-joined."""
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), ",")


def alike(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def next_spans(spans: DataFrame) -> DataFrame:
    """(span, after) for distinct spans: the next one in ascending order, after the last the first. Spans are dealt out by ranges, written once, and only the least one of each range meets the others' in one task."""
    ensure_checkpoints(spans.sparkSession)
    dealt = spans.repartitionByRange("span").withColumn("range", F.spark_partition_id()).checkpoint()
    within = dealt.withColumn("after", F.lead("span").over(Window.partitionBy("range").orderBy("span")))
    heads = dealt.groupBy("range").agg(F.min("span").alias("head"))
    every = Window.orderBy("head")  # one row for a range
    heads = heads.select("range", F.coalesce(F.lead("head").over(every), F.first("head").over(every.rowsBetween(Window.unboundedPreceding, 0))).alias("other"))
    return within.join(heads, "range").select("span", F.coalesce("after", "other").alias("after"))


def with_next(docs: DataFrame, more) -> DataFrame:  # noqa: ANN001
    """The rows (id, text) with the columns of ``more``, and with the following row's text and those columns as ``next``.

    Rows are dealt out by ranges of ids; the first row of each range is sent to the range before as well, so
    that texts are shuffled once. A row without an id has no next one.
    """
    span = F.coalesce(F.shiftright("id", SPAN_BITS), -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 20)))
    rows = docs.withColumn("span", span)
    heads = rows.where("id is not null").groupBy("span").agg(F.min_by(F.struct("id", "text"), "id").alias("head"))
    order = next_spans(rows.where("id is not null").select("span").distinct())
    guests = order.join(heads.withColumnRenamed("span", "after"), "after").select("head.id", "head.text", "span", F.lit(True).alias("guest"))
    every = rows.withColumn("guest", F.lit(False)).unionByName(guests).repartition("span")
    every = every.select("*", *more(F.col("text")))
    names = ["text", *(c for c in every.columns if c not in ("id", "text", "span", "guest"))]
    by_id = Window.partitionBy("span").orderBy("guest", F.col("id").asc_nulls_last(), F.xxhash64("text"))
    every = every.withColumn("next", F.when(F.col("id").isNotNull(), F.lead(F.struct(*names)).over(by_id)))
    return every.where("not guest").drop("span", "guest")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_chars, the hash of its edited text, both fingerprints, and the likeness to the edited and to the next text.

    The edited text has its last half replaced by the beginning of the next document, in ascending order of ids.
    """
    rows = with_next(docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")), lambda text: [signatures(text).alias("sigs")])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next.text", F.lit("")), F.lit(1), half))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "sigs", edited.alias("edited"), F.coalesce("next.sigs", F.array().cast("array<int>")).alias("next"))
    rows = rows.select("id", "n_chars", "sigs", "next", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("edited")).alias("edited_sigs"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        printed(F.col("sigs")).alias("fingerprint"),
        printed(F.col("edited_sigs")).alias("edited_fingerprint"),
        alike(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        alike(F.col("sigs"), F.col("next")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a, b, similarity) of classes of equal fingerprints with 100 * similarity >= percent, each class by its least id; ``classes`` gives the members. Empty fingerprints are in no pair."""
    members = classes(docs, id_col, text_col)
    sets = members.where(F.size("sigs") > 0).groupBy("sigs").agg(F.min("id").alias("id")).where("id is not null")
    # The base of the partitions is the ratio that two lengths may have at most.
    ratio = 100.0 / percent
    sets = sets.select("id", "sigs", F.size("sigs").alias("n"), F.floor(F.log(ratio, F.size("sigs")) if percent < 100 else F.size("sigs")).alias("part"))
    hits = sets.select("id", F.explode("sigs").alias("sig"))
    often = hits.groupBy("sig").agg(F.count("*").alias("m"))
    ranked = hits.join(often, "sig").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("m", "sig"))).alias("ranked"))
    kept = f"size(ranked) - cast(ceil({percent} * size(ranked) / 100.0) as int) + 1"
    prefix = ranked.select("id", F.explode(F.expr(f"slice(ranked, 1, {kept})")).alias("x")).select("id", F.col("x.sig").alias("sig"))
    keyed = prefix.join(sets.select("id", "n", "part"), "id")
    mine = keyed.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("part"), "sig")
    theirs = keyed.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "sig")
    close = F.expr(f"100 * bn >= {percent} * an and (bn < an or (bn = an and a < b))")
    pairs = mine.join(theirs, ["sig", "part"]).where(close).select("a", "b").distinct()
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    full = full.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), both.alias("both"), (F.size("x") + F.size("y") - both).alias("any"))
    return full.where(F.col("both") * 100 >= percent * F.col("any")).select("a", "b", (F.col("both") / F.col("any")).alias("similarity"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, sigs): every document with its fingerprint as an array and the least id of those that have it."""
    ensure_checkpoints(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), signatures(docs[text_col].cast("string")).alias("sigs")).checkpoint()
    heads = rows.groupBy("sigs").agg(F.min("id").alias("class_id"))
    return rows.join(heads, "sigs").select("id", "class_id", "sigs")
