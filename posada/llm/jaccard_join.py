"""Self-join of documents on the Jaccard similarity of their word n-grams, by set size.

Texts of equal sets form one class, represented by its least id; the join runs between classes.

* Small sets (up to a boundary) enumerate subsets: two sets of s and t elements whose similarity reaches the
  threshold share at least c(s, t) elements, hence a subset of that very size. Subsets are hashed and grouped;
  those of one group that are small enough for each other are linked without further checks.
* Larger sets post a prefix of their elements to inverted lists, in one order for all: elements that very many
  sets hold come last, the others in the order of their hashes. Lists of at least two sets are scanned: each
  set against the list's pivot first. Only lists that still hold several components are compared pair by pair,
  in blocks, with parity bitmaps that can't miss a link, and give a spanning forest of the pairs left.
  Candidates are confirmed on their whole sets, and scans of the lists with candidates that failed repeat, with
  ever more forests, until a round has none that fails.
* The boundary is the size that makes the sum over all sets of the estimated costs least: subsets for small
  ones, postings with their later comparison for large ones.

Edges therefore connect the same components as all links would, without the pairs of a group being listed.
Elements are 64-bit hashes of word runs, a set is known by a hash of its elements and its size.

Null and empty texts have an empty set and link with nothing, and so do rows without an id. Repeated ids are
rows of their own with equal ids. Columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .components import components, ensure_checkpoints, settled, stored, tidy
from .samples import BitFilter, bit_filter, frequent

#: A set's posting is shuffled, met with its list and compared again; a subset is only shuffled.
POSTING_COST = 6.0
#: The largest size for which subsets are ever enumerated.
MOST_SMALL = 24
#: Elements in the table of very common ones, and the number of times in a part of the input from which one is counted.
COMMON, COMMON_FROM = 1 << 19, 2
#: Number of times from which one is common.
LEAST_COMMON = 8
#: Sets of a list that are compared with one another in one go.
BLOCK = 1024
#: Bits of the filter of documents whose sets are fetched again.
FETCH_BITS = 1 << 24


def least_overlap(s: int, t: int, percent: int) -> int:
    """The least intersection of sets of s and t elements with 100 * intersection >= percent * union."""
    return -(-percent * (s + t) // (100 + percent))


def partner_sizes(s: int, percent: int) -> range:
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def prefix_length(s: int, percent: int) -> int:
    return s - -(-percent * s // 100) + 1


def subset_sizes(s: int, percent: int) -> list[int]:
    return sorted({c for t in partner_sizes(s, percent) if (c := least_overlap(s, t, percent)) <= min(s, t)})


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The size up to which enumerating subsets costs least in all; sizes: number of sets by size."""
    best = (0.0, 0)
    saved = 0.0
    for s in range(1, MOST_SMALL + 1):
        subsets = sum(math.comb(s, c) for c in subset_sizes(s, percent))
        saved += sizes.get(s, 0) * (POSTING_COST * prefix_length(s, percent) - subsets)
        best = max(best, (saved, s))
    return best[1]


def elements(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k words of the texts, repeated ones included."""
    data, offsets = textops.text_buffers(column)
    data = textops.LOWER[data]
    starts, ends, rows = textops.words(data, offsets, textops.NON_BLANK)
    return textops.shingle_hashes(textops.word_hashes(data, starts, ends), rows, len(offsets) - 1, k)


def document_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of the runs of k words of each text, as (values, offsets)."""
    return textops.distinct_by_row(*elements(column, k), len(column))


def common_elements(texts: DataFrame, k: int) -> np.ndarray:
    """Hashes of elements that are very frequent, ``COMMON`` at most. They only decide an order: results do not depend on them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                values, counts = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                often = counts >= COMMON_FROM
                yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["e", "n"])

        for batch in textops.pieces(batches):
            values, _ = elements(batch.column("text"), k)
            held.append(values)
            size += len(values)
            if size > 4_000_000:
                yield from flush()
                size = 0
        yield from flush()

    found = texts.select("text").mapInArrow(count, "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COMMON)
    return np.sort(frequent(found.checkpoint(), COMMON).select("e").toArrow().column("e").to_numpy().view(np.uint64))


def bitmap(values: np.ndarray) -> np.ndarray:
    """Parity of the number of elements on each bit, with a bit an element at least; fewer differences than bits that differ can't be."""
    bits = 1 << max(8, int(len(values) - 1).bit_length())
    odd = np.bincount((values >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def most_differences(s: np.ndarray | int, t: np.ndarray | int, percent: int):  # noqa: ANN201
    return s + t + 2 * ((-percent * (s + t)) // (100 + percent))


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textops.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
        return textops.mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def describe(texts: DataFrame, k: int) -> DataFrame:
    """Per text (id, body, text): id, body, n (size of its set), sig (hash of it) and small (the set itself, if it is small)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches):
            values, offsets = document_sets(batch.column("text"), k)
            sizes = np.diff(offsets)
            small = [values[a:b].view(np.int64) if b - a <= MOST_SMALL else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [batch.column("id"), batch.column("body"), pa.array(sizes, pa.int64()), pa.array(signatures(values, offsets)), pa.array(small, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "body", "n", "sig", "small"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, body long, n long, sig long, small array<long>")


def postings(texts: DataFrame, k: int, percent: int, least: int, common: np.ndarray, leaders: BitFilter, keys: BitFilter | None) -> DataFrame:
    """The prefixes (first elements in the common order) of the sets of ``least`` elements or more, of one text for each set: (key, m), in parts to be added up, or with ``keys`` (key, sig, n) of those only.

    leaders has, for the text of each set's class, the hash of its id combined with that of the set; other texts of equal
    sets that pass only post once more.
    """
    shared = texts.sparkSession.sparkContext.broadcast((common, leaders, keys))
    lengths = np.array([0, *(prefix_length(s, percent) for s in range(1, 4096))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, leaders, keys = shared.value
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                values, counts = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["key", "m"])

        for batch in textops.pieces(batches):
            values, offsets = document_sets(batch.column("text"), k)
            sizes, sigs = np.diff(offsets), signatures(values, offsets)
            on = (sizes >= least) & leaders.has(batch.column("idh").to_numpy() ^ sigs)
            if len(often):
                at = np.minimum(np.searchsorted(often, values), len(often) - 1)
                late = (often[at] == values).astype(np.int8)
            else:
                late = np.zeros(len(values), np.int8)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            ordered = values[np.argsort((2 * rows + late).astype(np.uint16 if len(sizes) < 1 << 15 else np.int64), kind="stable")]
            prefix = np.where(sizes < len(lengths), lengths[np.minimum(sizes, len(lengths) - 1)], sizes + (-percent * sizes) // 100 + 1) * on
            place = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
            found = ordered[np.repeat(offsets[:-1], prefix) + place]
            if keys is None:
                held.append(found)
                if sum(map(len, held)) > 1_000_000:
                    yield from flush()
                continue
            owner = np.repeat(np.arange(len(sizes)), prefix)
            some = keys.has(found)
            found, owner = found[some], owner[some]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(sigs[owner]), pa.array(sizes[owner].astype(np.int32))], ["key", "sig", "n"])
        yield from flush()

    rows = texts.where("id is not null").select(F.xxhash64("id").alias("idh"), "text")
    return rows.mapInArrow(run, "key long, m long" if keys is None else "key long, sig long, n int")


def subset_edges(sets: DataFrame, most: int, percent: int) -> DataFrame:
    """Edges (u, v) between small sets, from groups of equal subsets. No check is needed: sharing the subset is enough."""
    import itertools

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, size, key, count = [], [], [], []
            for s, n, values in zip(batch.column("sig").to_pylist(), batch.column("n").to_pylist(), batch.column("small").to_pylist(), strict=True):
                codes = textops.mix(np.array(values, np.int64).view(np.uint64))
                for c in subset_sizes(n, percent):
                    if math.comb(n, c) == 1:
                        drop = np.zeros((1, 0), np.int64)
                    else:
                        drop = np.array(list(itertools.combinations(range(n), n - c)), np.int64).reshape(-1, n - c)
                    with np.errstate(over="ignore"):
                        sums = textops.mix(codes.sum(dtype=np.uint64) - codes[drop].sum(axis=1, dtype=np.uint64) + np.uint64(c))
                    key.append(sums.view(np.int64))
                    sig += [s] * len(sums)
                    size += [n] * len(sums)
                    count += [c] * len(sums)
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array(np.concatenate([*key, np.zeros(0, np.int64)]))], ["sig", "n", "c", "key"])

    subsets = sets.where(F.col("n").between(1, most)).select("sig", "n", "small").mapInArrow(run, "sig long, n long, c long, key long")
    # In a group, the smallest set is linked with all that any other of the group is linked with.
    least = subsets.groupBy("key", "c").agg(F.min(F.struct("n", "sig")).alias("least"), F.count("*").alias("m")).where("m > 1")
    near = F.expr(f"{percent} * (n + least.n) <= {100 + percent} * c")
    return subsets.join(least, ["key", "c"]).where("sig != least.sig").where(near).select(F.col("least.sig").alias("u"), F.col("sig").alias("v")).distinct()


def _differing(a: tuple[int, int], b: tuple[int, int]) -> int:
    """The number of bits in which two bitmaps, each as (number, bytes), differ; the wider one is folded."""
    (x, xw), (y, yw) = a, b
    while xw != yw:
        if xw > yw:
            xw //= 2
            x = (x ^ (x >> 8 * xw)) & ((1 << 8 * xw) - 1)
        else:
            yw //= 2
            y = (y ^ (y >> 8 * yw)) & ((1 << 8 * yw) - 1)
    return (x ^ y).bit_count()


def _number(bits: bytes) -> tuple[int, int]:
    return int.from_bytes(bits, "little"), len(bits)


def fetched(texts: DataFrame, bodies: DataFrame, k: int, bits: bool) -> DataFrame:
    """(body, x) of the texts whose hashes are asked for: the bitmap of the text's set, or the text itself.

    A bit filter of fixed size lets only texts through that may be asked for; where it is too full, more pass than are,
    and the join drops them.
    """
    bodies = settled(bodies.distinct())
    shared = texts.sparkSession.sparkContext.broadcast(bit_filter(bodies, "body", FETCH_BITS))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            some = batch.filter(pa.array(asked.has(batch.column("body").to_numpy())))
            if not bits:
                yield some.rename_columns(["body", "x"])
                continue
            for piece in textops.pieces(iter([some])):
                values, offsets = document_sets(piece.column("text"), k)
                maps = [bitmap(values[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("body"), pa.array(maps, pa.binary())], ["body", "x"])

    found = texts.select("body", "text").where("text is not null").mapInArrow(maybe, f"body long, x {'binary' if bits else 'string'}")
    return found.dropDuplicates(["body"]).join(bodies, "body", "left_semi")


def with_fetched(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, bits: bool) -> DataFrame:
    """The pairs (u, v) with un, vn (sizes) and ux, vx (bitmaps or texts)."""
    side = lambda s: classes.select(F.col("sig").alias(s), F.col("n").alias(f"{s}n"), F.col("body").alias(f"{s}b"))
    named = settled(pairs.join(side("u"), "u").join(side("v"), "v"))
    found = fetched(texts, named.select(F.explode(F.array("ub", "vb")).alias("body")), k, bits)
    full = named.join(found.select(F.col("body").alias("ub"), F.col("x").alias("ux")), "ub").join(found.select(F.col("body").alias("vb"), F.col("x").alias("vx")), "vb")
    return full.select("u", "v", "un", "vn", "ux", "vx")


def filtered(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of sets whose bitmaps do not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("ux", "vx", "un", "vn")), strict=True)
            yield batch.select(["u", "v"]).filter(pa.array([_differing(_number(a), _number(b)) <= most_differences(s, t, percent) for a, b, s, t in rows], pa.bool_()))

    return with_fetched(pairs, classes, texts, k, bits=True).mapInArrow(run, "u long, v long")


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) with ``linked``: whether their whole sets reach the threshold. The sets are made again from one text of each."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches, "ux"):
            sides = [document_sets(batch.column(c), k) for c in ("ux", "vx")]
            linked = []
            for i in range(batch.num_rows):
                x, y = (values[offsets[i] : offsets[i + 1]] for values, offsets in sides)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_())], ["u", "v", "linked"])

    return settled(with_fetched(pairs, classes, texts, k, bits=False).mapInArrow(check, "u long, v long, linked boolean"))


def allowed(sizes: np.ndarray, groups: np.ndarray, bits: list[bytes], low: np.ndarray, half: np.ndarray, across: bool, percent: int) -> list[tuple[int, int, int]]:
    """(bits that differ, i, j) of the pairs that bitmaps allow, between sets of different components, not both of the band below. half: the block; across: only pairs of both blocks."""
    out = []
    if len(sizes) <= 64:
        own, size, group, below, part = [_number(b) for b in bits], sizes.tolist(), groups.tolist(), low.tolist(), half.tolist()
        for i in range(len(size)):
            for j in range(i):
                if group[i] == group[j] or below[i] and below[j] or across and part[i] == part[j] or 100 * min(size[i], size[j]) < percent * max(size[i], size[j]):
                    continue
                d = _differing(own[i], own[j])
                if d <= most_differences(size[i], size[j], percent):
                    out.append((d, i, j))
        return out
    widths = {len(b) for b in bits}
    tables = {w: np.stack([folded(np.frombuffer(b, np.uint8), w) if len(b) >= w else np.zeros(w, np.uint8) for b in bits]).view(np.uint64) for w in widths}
    own = np.array([len(b) for b in bits])
    place = np.arange(len(sizes))
    for i in range(len(sizes)):
        w = int(own[i])
        others = (own > w) | (own == w) & (place > i)
        others &= groups != groups[i]
        if low[i]:
            others &= ~low
        if across:
            others &= half != half[i]
        others &= 100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])
        at = np.flatnonzero(others)
        if len(at):
            d = np.bitwise_count(tables[w][at] ^ tables[w][i]).sum(axis=1, dtype=np.int64)
            on = d <= most_differences(sizes[at], sizes[i], percent)
            out += [(x, i, j) for x, j in zip(d[on].tolist(), at[on].tolist(), strict=True)]
    return out


def forests(pairs: list[tuple[int, int, int]], sigs: np.ndarray, groups: np.ndarray, failed: dict, width: int) -> list[tuple[int, int]]:
    """``width`` edge-disjoint least spanning forests, over components, of the pairs that have not failed before.

    The order of the pairs is the same in all lists, so that lists of nearly the same sets give nearly the same pairs.
    """
    sig, group = sigs.tolist(), groups.tolist()
    left = []
    for d, i, j in pairs:
        low, high = (sig[i], sig[j]) if sig[i] < sig[j] else (sig[j], sig[i])
        if not failed or high not in failed.get(low, ()):
            left.append((d, low, high, group[i], group[j]))
    left.sort()
    out = []
    for _ in range(width):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:  # noqa: B023
                root[x] = root[root[x]]  # noqa: B023
                x = root[x]  # noqa: B023
            return x

        more = []
        for pair in left:
            a, b = find(pair[3]), find(pair[4])
            if a == b:
                more.append(pair)
            else:
                root[b] = a
                out.append(pair[1:3])
        left = more
        if not left:
            break
    return out


def banded(labelled: DataFrame, percent: int) -> DataFrame:
    """The rows (key, sig, n, label) of lists cut into bands of sizes, where several components remain in one.

    A set can link with sets of its own band and of the next one only; it is in both, in the next one as ``low``.
    """
    own = F.floor(F.log(100.0 / percent, "n") + 1e-9) if percent < 100 else F.col("n")
    rows = labelled.withColumn("own", own.cast("int")).withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
    rows = rows.withColumn("low", F.col("band") != F.col("own")).drop("own")
    # A set of the band below needs one of the band itself that is small enough for it and of another component.
    inside = rows.where("not low").groupBy("key", "band").agg(F.min("n").alias("least"), F.min("label").alias("x"), F.max("label").alias("y"))
    rows = rows.join(inside, ["key", "band"]).where(f"not low or (100 * n >= {percent} * least and (x != label or y != label))").drop("least", "x", "y")
    # Of groups of the same sets one is enough.
    sets = [F.expr(f"bit_xor(xxhash64(sig, low, {i}))").alias(f"h{i}") for i in (1, 2)]
    mixed = rows.groupBy("key", "band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m"), *sets).where("x != y")
    alone = mixed.groupBy("band", "m", "h1", "h2").agg(F.min("key").alias("key"))
    return rows.join(alone.select("key", "band", "m"), ["key", "band"])


def block_pairs(lists: DataFrame, classes: DataFrame, texts: DataFrame, failed: DataFrame, k: int, percent: int, width: int) -> DataFrame:
    """Candidate pairs from the banded lists. Blocks of a list meet two by two."""
    parts = F.expr(f"cast(ceil(m / {BLOCK}) as int)")
    member = lists.withColumn("parts", parts).withColumn("own", F.expr("cast(pmod(xxhash64(sig), parts) as int)"))
    # Block pair (a, b), a <= b: a member of block x goes to the pairs (x, x..) and (..x, x).
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    bad = failed.groupBy("u").agg(F.collect_list("v").alias("bad"))
    named = settled(lists.select("sig").distinct().join(classes.select("sig", "body"), "sig"))
    bits = fetched(texts, named.select("body"), k, bits=True).join(named, "body").select("sig", F.col("x").alias("bits"))
    member = member.join(bits, "sig").join(bad.withColumnRenamed("u", "sig"), "sig", "left")
    member = member.select("key", "band", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "low", "sig", "label", "n", "bits", "bad")
    order = ["key", "band", "a", "b"]
    dealt = member.repartition(*order).sortWithinPartitions(*order, "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(part: pa.Table) -> list[tuple[int, int]]:
            """Of the whole lists in a table."""
            column = {c: part.column(c).to_numpy() for c in (*order, "own", "low", "sig", "label", "n")}
            bits, bad = part.column("bits").to_pylist(), part.column("bad").to_pylist()
            new = np.ones(len(bits) + 1, bool)
            new[1:-1] = np.any([column[c][1:] != column[c][:-1] for c in order], axis=0)
            cuts, out = np.flatnonzero(new), []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if y - x > 1:
                    failures = {int(column["sig"][i]): set(bad[i]) for i in range(x, y) if bad[i]}
                    found = allowed(column["n"][x:y], column["label"][x:y], bits[x:y], column["low"][x:y], column["own"][x:y], bool(column["a"][x] != column["b"][x]), percent)
                    out += forests(found, column["sig"][x:y], column["label"][x:y], failures, width)
            return out

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            found = list(dict.fromkeys(found))
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["u", "v"])

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = [held.column(c)[-1].as_py() for c in order] if held.num_rows else None
            if last:
                same = np.ones(held.num_rows, bool)
                for c, v in zip(order, last, strict=True):
                    same &= held.column(c).to_numpy() == v
                start = int(np.argmax(same))
                yield batch_of(pairs(held.slice(0, start)))
                held = held.slice(start).combine_chunks()
        if held is not None and held.num_rows:
            yield batch_of(pairs(held))

    return dealt.mapInArrow(run, "u long, v long").distinct()


def grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: id, body (hash of the text), n (size of its set), class_id, component (a label that no other component has, null if the set is empty) and component_id."""
    spark = docs.sparkSession
    ensure_checkpoints(spark)
    texts = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("body"), docs[text_col].cast("string").alias("text"))
    every = stored(describe(texts, k))
    some = every.where("n > 0 and id is not null")
    classes = settled(some.groupBy("sig", "n").agg(F.min(F.struct("id", "body")).alias("least")).select("sig", "n", "least.id", "least.body"))
    histogram = {r.n: r.m for r in classes.where(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.count("*").alias("m")).collect()}
    most = boundary(histogram, percent)
    edges = subset_edges(some.join(classes.select("sig", "id"), ["sig", "id"], "left_semi").where(F.col("n") <= most), most, percent)
    # Sets that can only link with small ones need no lists. Equal sets post alike; they are merged in the lists.
    common, leaders, least = common_elements(texts, k), bit_filter(classes.select((F.xxhash64("id").bitwiseXOR(F.col("sig"))).alias("x")), "x"), -(-percent * (most + 1) // 100)
    counted = postings(texts, k, percent, least, common, leaders, None).groupBy("key").agg(F.sum("m").alias("m")).where("m > 1")
    # Of the elements only those in several prefixes make lists; with each set's own hash and size they are shuffled alone.
    lists = settled(postings(texts, k, percent, least, common, leaders, bit_filter(counted, "key")).distinct())
    # The pivot of a list: the set of the least hash, so that lists of the same sets have the same one.
    described = lists.groupBy("key").agg(
        F.count("*").alias("m"), F.min(F.struct(F.xxhash64("sig").alias("h"), "sig", "n")).alias("p"), F.expr("bit_xor(xxhash64(sig, 1))").alias("x"), F.expr("bit_xor(xxhash64(sig, 2))").alias("y")
    )
    described = settled(described.select("key", "m", "x", "y", F.col("p.sig").alias("p"), F.col("p.n").alias("pn")))
    # Of lists of the same sets one is enough.
    alone = described.groupBy("m", "x", "y").agg(F.min(F.struct("key", "p", "pn")).alias("one")).select("m", "one.*")
    spread = lists.join(alone, "key").where("sig != p")
    near = F.expr(f"100 * cast(least(n, pn) as long) >= {percent} * cast(greatest(n, pn) as long)")
    first = spread.where(near).select(F.least("sig", "p").alias("u"), F.greatest("sig", "p").alias("v")).distinct()
    found = confirmed(settled(filtered(settled(first), classes, texts, k, percent)), classes, texts, k, percent)
    edges = settled(edges.union(found.where("linked").select("u", "v")))
    failed = found.where("not linked").select("u", "v")
    rest = settled(spread.where("m > 2").select("key", "sig", "n"))
    tidy(spark)
    width = 1
    while True:
        labels = settled(components(edges))
        labelled = rest.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("component", "sig"))
        mixed = settled(banded(labelled.select("key", "sig", "n", "label"), percent))
        pairs = settled(block_pairs(mixed, classes, texts, failed, k, percent, width))
        if pairs.isEmpty():
            break
        found = confirmed(pairs, classes, texts, k, percent)
        edges = settled(edges.union(found.where("linked").select("u", "v")))
        if found.where("not linked").isEmpty():
            labels = components(edges)
            break
        # Only lists with a candidate that failed can hold further ones.
        missed = found.where("not linked").select("u", "v")
        failed = settled(failed.union(missed))
        both = rest.join(missed, rest["sig"] == missed["u"]).select("key", "v").join(rest, "key").where("sig = v").select("key").distinct()
        rest = settled(rest.join(both, "key", "left_semi"))
        width *= 16
        tidy(spark)
    classes = classes.drop("body").withColumnRenamed("id", "class_id").join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    tidy(spark)
    least = classes.groupBy("component").agg(F.min("class_id").alias("component_id"))
    classes = classes.join(least, "component").select("sig", "n", "class_id", "component", "component_id")
    return every.select("id", "body", "n", "sig").join(classes, ["sig", "n"], "left").drop("sig")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, n_shingles (size of its set), class_id (least id of an equal set, null if empty) and component_id (least id that links lead to)."""
    out = grouped(docs, k, percent, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", F.coalesce("component_id", "id").alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, one of each component: that of the least id, of these the least hash of its text, of these (repeated rows) the least as JSON. Rows of empty sets and rows without an id all stay."""
    found = grouped(docs, k, percent, id_col, text_col).where("id is not null")
    rows = found.where("n > 0").groupBy("component", "id", "body").agg(F.count("*").alias("m"))
    first = rows.groupBy("component").agg(F.min(F.struct("id", "body", "m")).alias("least")).select("least.*")
    kept = settled(first.union(found.where("n = 0").select("id", "body", F.lit(1).cast("long").alias("m")).distinct()))
    keyed = docs.select(F.struct("*").alias("doc"), docs[id_col].alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("body"))
    out = keyed.join(kept.where("m = 1"), ["id", "body"], "left_semi").select("doc")
    several = kept.where("m > 1")
    tidy(docs.sparkSession)
    if not several.isEmpty():
        again = keyed.join(several, ["id", "body"], "left_semi")
        out = out.union(again.groupBy("id", "body").agg(F.min_by("doc", F.to_json("doc")).alias("doc")).select("doc"))
    return out.union(keyed.where("id is null").select("doc")).select("doc.*")
