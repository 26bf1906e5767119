"""Language-model scores from a probabilistic suffix tree.

A text is the sequence of its lower-case words and one end. The tree's nodes are contexts of up to two words that
stand before a symbol. Its size follows the corpus: any context with ``CONTEXT_LEAST`` occurrences is looked at,
with every follower that it has ``FOLLOWER_LEAST`` times. A follower stays if it gains more bits over the shorter
context than its description takes, and a context is retained if all that stays diverges from the shorter context by
``EVIDENCE`` bits or more. Distributions are smoothed towards the shorter context by a discount; at the root words of
the training texts have their share of the counts, all others the rest times the probability of their spelling.
Spellings have a suffix tree of their own, over the bytes of the distinct training words, with contexts of up to
``DEPTH`` bytes that have ``LEAST_SHARE`` of its symbols, which bounds it; it is applied as an automaton.

The score of a text is the base-10 logarithm of its probability, each symbol under the longest retained context
before it. As a sum it has one value for each word, each pair of neighbours and each triple, so that contexts and
followers are tables, and scoring is a join with them; the ``FREQUENT`` most frequent ones are broadcast. Fixed-size bit
filters keep from the shuffles what can't be in a table: no pair or triple is lost, and where a filter is full more is
shuffled. Counts cover all training texts.

Null and empty texts are one end. Without training texts all counts are 0 and the spelling is uniform. Repeated rows
count and are scored each for itself, also where they share an id; ids can be null (never held out), and ties need no
rule. A long text is read in one piece. An empty table gives an empty one. Columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .components import stored
from .quality import fold
from .samples import BitFilter, bit_filter, frequent

#: Occurrences of a context and of a follower in it from which they are looked at.
CONTEXT_LEAST, FOLLOWER_LEAST = 64, 8
#: Taken from the count of each follower for the shorter context.
DISCOUNT = 0.75
#: Least divergence of a retained context from its shorter one, in bits over all its occurrences.
EVIDENCE = 30.0
#: The spelling tree: longest context in bytes, least share of the symbols, least divergence of a context in bits per symbol.
DEPTH, LEAST_SHARE, DIVERGENCE = 5, 1e-5, 0.01
FREQUENT = 1 << 20
BLANK = 0x20
STRETCH = 256
#: Counted entries that a task holds before it hands them on.
HELD = 500_000
END_KEY = np.uint64(0x1D8AF066E5F1A3C7)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of two neighbours (words, or overlapping pairs)."""
    with np.errstate(over="ignore"):
        return textops.mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))


class Tokens:
    """Of a batch: data (lower-case), starts, ends and rows of the words; keys and owners of all symbols, each text's end included."""

    def __init__(self, column: pa.Array):
        data, offsets = textops.text_buffers(column)
        self.data = textops.LOWER[data]
        self.starts, self.ends, self.rows = textops.words(self.data, offsets, textops.NON_BLANK)
        self.words = textops.word_hashes(self.data, self.starts, self.ends)
        n = len(offsets) - 1
        last = np.cumsum(np.bincount(self.rows, minlength=n))
        self.keys = np.insert(self.words, last, END_KEY)
        self.owners = np.insert(self.rows, last, np.arange(n))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, row) of all neighbours."""
        at = np.flatnonzero(self.owners[1:] == self.owners[:-1])
        return self.keys[at], self.keys[at + 1], self.owners[at]

    def spelt(self, which: np.ndarray) -> pa.Array:
        """The words of those numbers."""
        sizes = self.ends[which] - self.starts[which]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[which] - offsets[:-1], sizes) + np.arange(offsets[-1])
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[at]))


def count_words(texts: DataFrame) -> DataFrame:
    """(key, word, n) of all words, and of the end as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        ends = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                _, first, at = np.unique(np.concatenate([k for k, _, _ in held]), return_index=True, return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, _, n in held])).astype(np.int64)
                words = pa.concat_arrays([w for _, w, _ in held]).take(pa.array(first))
                held.clear()
                for a in range(0, len(n), 20_000):
                    part = slice(a, a + 20_000)
                    yield pa.RecordBatch.from_arrays([words[part].cast(pa.string()), pa.array(n[part])], ["word", "n"])

        for batch in textops.pieces(batches):
            t = Tokens(batch.column("text"))
            ends += batch.num_rows
            keys, first, n = np.unique(t.words, return_index=True, return_counts=True)
            held.append((keys, t.spelt(first), n))
            if sum(len(k) for k, _, _ in held) > HELD:
                yield from flush()
        yield from flush()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([ends])], ["word", "n"])

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches, "word"):
            data, offsets = textops.text_buffers(batch.column("word"))
            keys = np.where(offsets[1:] > offsets[:-1], textops.word_hashes(data, offsets[:-1], offsets[1:]), END_KEY)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("word"), batch.column("n")], ["key", "word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(key, "key long, word string, n long")


def count_neighbours(texts: DataFrame, firsts: BitFilter, seconds: BitFilter, of_pairs: bool) -> DataFrame:
    """(a, b, n) of neighbouring words, or of pairs that overlap in a word, that have n >= FOLLOWER_LEAST. The filters hold all keys that a and b can have."""
    shared = texts.sparkSession.sparkContext.broadcast((firsts, seconds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                _, first, n = np.unique(pair_keys(a, b), return_index=True, return_counts=True)
                for at in range(0, len(first), 50_000):
                    part = first[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(a[part].view(np.int64)), pa.array(b[part].view(np.int64)), pa.array(n[at : at + 50_000])], ["a", "b", "n"])

        from_, to = shared.value
        for batch in textops.pieces(batches):
            a, b, owners = Tokens(batch.column("text")).pairs()
            if of_pairs:
                keys = pair_keys(a, b)
                at = np.flatnonzero(owners[1:] == owners[:-1])
                a, b = keys[at], keys[at + 1]
            on = from_.has(a)
            a, b = a[on], b[on]
            on = to.has(b)
            held.append((a[on], b[on]))
            size += len(held[-1][0])
            if size > 2 * HELD:
                yield from flush()
                size = 0
        yield from flush()

    return texts.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= FOLLOWER_LEAST)


def retained(followers: DataFrame, cost: float) -> tuple[DataFrame, Column]:
    """((a, mass) of the retained contexts, the condition of followers that stay). followers: a, n, na (of the context), p (under the shorter context).

    mass is what the followers that stay leave to the shorter context.
    """
    share = (F.col("n") - DISCOUNT) / F.col("na")
    stays = F.col("n") * F.log2(share / F.col("p")) >= cost
    sums = followers.where((F.col("na") >= CONTEXT_LEAST) & stays).groupBy("a").agg(
        F.first("na").alias("na"), F.sum("n").alias("held"), F.sum(F.col("n") - DISCOUNT).alias("discounted"), F.sum(F.col("n") * F.log2(share / F.col("p"))).alias("bits")
    )
    mass = (F.col("na") - F.col("discounted")) / F.col("na")
    apart = F.col("bits") + (F.col("na") - F.col("held")) * F.log2(mass)
    return sums.where(apart >= EVIDENCE).select("a", mass.alias("mass")), stays


def smoothed(followers: DataFrame, contexts: DataFrame, stays: Column) -> DataFrame:
    """The followers with mass (of their context, null if that isn't retained), shorter (the probability by way of the shorter context) and p (the smoothed one)."""
    rows = followers.join(contexts, "a", "left").withColumn("shorter", F.coalesce("mass", F.lit(1.0)) * F.col("p"))
    own = F.when(F.col("mass").isNotNull() & stays, (F.col("n") - DISCOUNT) / F.col("na")).otherwise(0.0)
    return rows.withColumn("p", F.col("shorter") + own)


_KEY = "pair_key"


def keyed(pairs: DataFrame) -> DataFrame:
    """The rows with the key of (a, b)."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pair_keys(a, b).view(np.int64))], [*names, _KEY])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in names)
    return pairs.mapInArrow(run, f"{kinds}, {_KEY} long")


def spelling_sequences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, starts in it): of each word DEPTH blanks, its bytes and a blank."""
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes + DEPTH + 1)])
    out = np.full(first[-1], BLANK, np.uint8)
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(first[:-1] + DEPTH, sizes) + step] = data[np.repeat(starts, sizes) + step]
    return out, first


def count_runs(words: DataFrame) -> DataFrame:
    """(key, n): the runs of DEPTH + 1 bytes in the spellings of the words, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches, "word", textops.PIECE // 4):
            data, offsets = textops.text_buffers(batch.column("word"))
            sequence, first = spelling_sequences(data, offsets[:-1], offsets[1:])
            on = np.ones(len(sequence), bool)
            on[(first[:-1, None] + np.arange(DEPTH)).ravel()] = False
            at = np.flatnonzero(on)
            key = np.zeros(len(at), np.uint64)
            for j in range(DEPTH + 1):
                key = (key << np.uint64(8)) | sequence[at - DEPTH + j].astype(np.uint64)
            keys, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    return words.where("word != ''").select("word").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Tree:
    """The automaton of spellings: ``follow`` and ``log10`` by state and symbol class, ``classes`` by byte."""

    def __init__(self, levels: list[dict[bytes, dict[int, int]]], divergence: float = DIVERGENCE):
        """levels[d]: counts of the next byte by context of d bytes."""
        root = levels[0].get(b"", {})
        known = sorted(root)
        self.classes = np.full(256, len(known), np.uint8)
        self.classes[known] = np.arange(len(known))
        n, total = len(known) + 1, sum(root.values())
        base = np.array([(root[b] + 1) / (total + 256) for b in known] + [1 / (total + 256)])
        spread: dict[bytes, np.ndarray] = {b"": base}

        def smooth(counts: dict[int, int], shorter: np.ndarray) -> np.ndarray:
            weight, size = len(counts), sum(counts.values())
            out = shorter * (weight / (size + weight))
            for b, m in counts.items():
                out[self.classes[b]] += m / (size + weight)
            return out

        # A context is retained if it diverges from its longest shorter one; its own shorter ones go with it.
        kept: set[bytes] = {b""}
        for level in levels[1:]:
            for context, counts in level.items():
                if context[1:] not in spread:
                    continue
                shorter = spread[context[1:]]
                spread[context] = p = smooth(counts, shorter)
                apart = sum(m * np.log2(p[self.classes[b]] / shorter[self.classes[b]]) for b, m in counts.items())
                if apart >= max(EVIDENCE, divergence * sum(counts.values())):
                    while context not in kept:
                        kept.add(context)
                        context = context[1:]
        states = set(kept)
        for context in kept:
            while context:
                context = context[:-1]
                tail = context
                while tail not in states:
                    states.add(tail)
                    tail = tail[1:]
        self.contexts = sorted(states, key=lambda c: (len(c), c))
        number = {c: i for i, c in enumerate(self.contexts)}
        self.follow = np.zeros((len(states), n), np.int32)
        log10 = np.zeros((len(states), n), np.float32)
        children: dict[bytes, list[bytes]] = {}
        for c in self.contexts[1:]:
            children.setdefault(c[:-1], []).append(c)
        for i, c in enumerate(self.contexts):
            if c:
                self.follow[i] = self.follow[number[c[1:]]]
            for child in children.get(c, ()):
                self.follow[i, self.classes[child[-1]]] = number[child]
            log10[i] = np.log10(spread[c]) if c in kept else log10[number[c[1:]]]
        self.log10 = log10

    def score(self, sequence: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The log10 probability of each byte of a sequence made by ``spelling_sequences``; 0 for the blanks in front."""
        lengths = np.diff(first) - DEPTH
        parts = -(-lengths // STRETCH)
        owner = np.repeat(np.arange(len(lengths)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = first[:-1][owner] + STRETCH * nth  # of the DEPTH bytes before the stretch
        left = np.minimum(STRETCH, lengths[owner] - STRETCH * nth)
        order = np.argsort(-left, kind="stable")
        start, left = start[order], left[order]
        out = np.zeros(len(sequence))
        coded = self.classes[sequence].astype(np.int64)
        width = self.follow.shape[1]
        follow, log10 = self.follow.ravel(), self.log10.ravel()
        state = np.zeros(len(start), np.int64)
        active = len(start)
        for step in range(DEPTH + STRETCH):
            if step >= DEPTH:
                active = int(np.searchsorted(-left, -(step - DEPTH), side="left"))
                if not active:
                    break
            at = state[:active] * width + coded[start[:active] + step]
            if step >= DEPTH:
                out[start[:active] + step] = log10[at]
            state[:active] = follow[at]
        return out

    def spelt(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The log10 probability of the spelling of each word."""
        if not len(starts):
            return np.zeros(0)
        sequence, first = spelling_sequences(data, starts, ends)
        return np.add.reduceat(self.score(sequence, first), first[:-1])


def fit_tree(runs: DataFrame, least_share: float = LEAST_SHARE, divergence: float = DIVERGENCE) -> Tree:
    """The tree of the run counts (key, n). At most 1 / least_share contexts of a length reach the driver."""
    total = runs.agg(F.sum("n")).first()[0] or 0
    levels: list[dict[bytes, dict[int, int]]] = []
    for depth in range(DEPTH + 1):
        by = runs.groupBy(F.expr(f"key & {(1 << 8 * (depth + 1)) - 1}L").alias("key")).agg(F.sum("n").alias("n")).withColumn("context", F.shiftrightunsigned("key", 8))
        often = by.groupBy("context").agg(F.sum("n").alias("all")).where(F.col("all") >= least_share * total).select("context")
        level: dict[bytes, dict[int, int]] = {}
        for batch in by.join(F.broadcast(often), "context", "left_semi").select("key", "n").toArrow().to_batches():
            for key, n in zip(*(batch.column(x).to_pylist() for x in ("key", "n")), strict=True):
                level.setdefault((key >> 8).to_bytes(depth, "big"), {})[key & 255] = n
        levels.append(level)
    return Tree(levels, divergence)


class Model:
    """What scoring needs.

    tree: of spellings. values: (key, n, value) of words (n: count, value: what the word as a context gives), of pairs
    and of triples (n null). words_often and pairs_often: the most frequent ones, sorted by key. pairs and triples:
    filters of the keys that values has. tokens, types: N and V. ends: count of the end.
    """

    def __init__(self, texts: DataFrame):
        words = stored(count_words(texts))
        seen = words.agg(F.count("*"), F.sum("n"), F.sum(F.when(F.col("word") == "", F.col("n")))).first()
        self.types, self.tokens, self.ends = seen[0], seen[1] or 0, seen[2] or 0
        self.tree = fit_tree(stored(count_runs(words)))
        words = words.select("key", "n")
        likely = words.where(F.col("n") >= FOLLOWER_LEAST)
        cost = math.log2(self.types + 2)

        pairs = keyed(count_neighbours(texts, bit_filter(words.where(F.col("n") >= CONTEXT_LEAST), "key"), bit_filter(likely, "key"), of_pairs=False))
        pairs = pairs.join(likely.select(F.col("key").alias("a"), F.col("n").alias("na")), "a").join(likely.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
        pairs = stored(pairs.select("a", _KEY, "n", "na", (F.col("nb") / (self.tokens + self.types + 1)).alias("p")))
        contexts, stays = retained(pairs, cost)
        contexts = stored(contexts)
        named = smoothed(pairs, contexts, stays)

        triples = keyed(count_neighbours(texts, bit_filter(pairs.where(F.col("n") >= CONTEXT_LEAST), _KEY), bit_filter(pairs, _KEY), of_pairs=True))
        long = triples.join(pairs.select(F.col(_KEY).alias("a"), F.col("n").alias("na")), "a").join(named.select(F.col(_KEY).alias("b"), "p"), "b")
        long = stored(long.select("a", _KEY, "n", "na", "p"))
        long_contexts, stays = retained(long, cost)
        long_contexts = stored(long_contexts)
        long = smoothed(long.join(long_contexts.select("a"), "a", "left_semi"), long_contexts, stays)

        gain = F.log10(F.col("p") / F.col("shorter")).alias("value")
        as_context = lambda c: c.select(F.col("a").alias("key"), F.log10("mass").alias("value"))
        of_pairs = named.where("p > shorter").select(F.col(_KEY).alias("key"), "n", gain)
        of_contexts = long_contexts.join(pairs.select(F.col(_KEY).alias("a"), "n"), "a").select(F.col("a").alias("key"), "n", F.log10("mass").alias("value"))
        of_triples = long.where("p > shorter").select(F.col(_KEY).alias("key"), "n", gain)
        beyond = of_pairs.union(of_contexts).groupBy("key").agg(F.max("n").alias("n"), F.sum("value").alias("value"))
        beyond = stored(beyond.withColumn("three", F.lit(False)).union(of_triples.select("key", "n", "value", F.lit(True))))
        self.pairs, self.triples = bit_filter(beyond.where("not three"), "key"), bit_filter(beyond.where("three"), "key")
        valued = words.join(as_context(contexts), "key", "left").select("key", "n", F.coalesce("value", F.lit(0.0)).alias("value"))
        often = frequent(words, FREQUENT).join(as_context(contexts), "key", "left").select("key", "n", F.coalesce("value", F.lit(0.0)).alias("value"))
        self.words_often = self._sorted(often)
        self.pairs_often = self._sorted(frequent(beyond.select("key", "n", "value"), FREQUENT))
        textops.release(collect=True)
        self.values = valued.union(beyond.select("key", F.lit(None).cast("long"), "value"))

    @staticmethod
    def _sorted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = rows.toArrow()
        key = table.column("key").to_numpy()
        order = np.argsort(key)
        return tuple(table.column(c).to_numpy()[order] for c in ("key", "n", "value"))


def _found(table: tuple[np.ndarray, ...], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted table, whether the key is there)."""
    at = np.minimum(np.searchsorted(table[0], keys), max(len(table[0]) - 1, 0))
    return at, table[0][at] == keys if len(table[0]) else np.zeros(len(keys), bool)


def score_documents(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, held_out, n_tokens, n_known, train_tokens, base_score and score. Held-out rows are not learned from."""
    held = fold(id_col, 7, 2) if held_out is None else held_out
    rows = docs.select(docs[id_col].alias("id"), held.alias("held_out"), docs[text_col].cast("string").alias("text"))
    model = Model(rows.where("not held_out").select("text"))
    values = model.values
    tokens, types, ends = model.tokens, model.types, model.ends
    root, base_unit = math.log10(tokens + types + 1), math.log10(tokens + types + 1)
    escape = math.log10(types + 1) - root
    shared = docs.sparkSession.sparkContext.broadcast((model.tree, model.words_often, model.pairs_often, model.pairs, model.triples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, words, pairs, some_pairs, some_triples = shared.value
        end = float(tree.log10[0, tree.classes[0x0A]]) + escape if not ends else math.log10(ends) - root
        for batch in textops.pieces(batches):
            n = batch.num_rows
            t = Tokens(batch.column("text"))
            hashes = t.words.view(np.int64)
            at, known = _found(words, hashes)
            total = lambda owners, weights: np.bincount(owners, weights, minlength=n).astype(float)  # noqa: B023, E731
            base = total(t.rows[known], np.log10(words[1][at[known]] + 1)) + np.log10(ends + 1)
            score = total(t.rows[known], np.log10(words[1][at[known]]) - root + words[2][at[known]]) + end
            many = np.bincount(t.rows, minlength=n) + 1

            # Words outside the broadcast table, with the probability of their spelling in case that no training text has them.
            rare = np.flatnonzero(~known)
            _, first, which = np.unique(hashes[rare], return_index=True, return_inverse=True)
            spelt = tree.spelt(t.data, t.starts[rare[first]], t.ends[rare[first]])[which]
            more = [(hashes[rare], t.rows[rare], spelt)]
            a, b, owners = t.pairs()
            keys = pair_keys(a, b)
            both = np.flatnonzero(owners[1:] == owners[:-1])
            for some, key, owner in ((some_pairs, keys, owners), (some_triples, pair_keys(keys[both], keys[both + 1]), owners[both])):
                on = some.has(key)
                key, owner = key[on].view(np.int64), owner[on]
                at, there = _found(pairs, key)
                score += total(owner[there], pairs[2][at[there]])
                more.append((key[~there], owner[~there], np.full((~there).sum(), np.nan)))
            key, owner, spelt = (np.concatenate(x) for x in zip(*more, strict=True))
            order = textops.by_row_and_value(key, owner)
            key, owner, spelt = key[order], owner[order], spelt[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(key)))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=n))])
            columns = [batch.column("id"), batch.column("held_out"), pa.array(many, pa.int64()), pa.array(np.bincount(t.rows[known], minlength=n) + (ends > 0), pa.int64())]
            columns += [pa.array(base - many * base_unit, pa.float64()), pa.array(score, pa.float64())]
            columns += [textops.list_column(x, offsets, kind) for x, kind in ((key[new], pa.int64()), (times, pa.int32()), (spelt[new], pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "base", "score", "keys", "times", "spelt"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, keys array<long>, times array<int>, spelt array<float>")
    # One row for each text and one for each of its rarer words and pairs; the former have a key of their own that meets none.
    scored = scored.withColumn("row", F.expr("monotonically_increasing_id()"))
    head = F.struct("id", "held_out", "n_tokens", "n_known", "base", "score")
    one = F.array(F.struct(F.col("row").alias("key"), F.lit(0).alias("times"), F.lit(None).cast("float").alias("spelt"), head.alias("head")))
    nothing = F.lit(None).cast(f"struct<id:{kind},held_out:boolean,n_tokens:bigint,n_known:bigint,base:double,score:double>")
    rest = F.transform(F.arrays_zip("keys", "times", "spelt"), lambda x: F.struct(x["keys"].alias("key"), x["times"].alias("times"), x["spelt"].alias("spelt"), nothing.alias("head")))
    parts = scored.select("row", F.explode(F.concat(one, rest)).alias("x")).select("row", "x.*")
    met = parts.join(values, "key", "left")
    tail, word = F.col("head").isNull(), F.col("spelt").isNotNull() & ~F.isnan("spelt")
    known = tail & word & F.col("n").isNotNull()
    gain = F.when(known, F.log10("n") - root + F.col("value")).when(tail & word, F.col("spelt") + escape).when(tail, F.coalesce("value", F.lit(0.0))).otherwise(0.0)
    found = met.groupBy("row").agg(
        F.max("head").alias("head"),
        F.sum(F.when(known, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.when(known, F.col("times") * F.log10(F.col("n") + 1)).otherwise(0.0)).alias("more"),
        F.sum(F.col("times") * gain).alias("gain"),
    )
    return found.select(
        F.col("head.id").alias(id_col),
        F.col("head.held_out").alias("held_out"),
        F.col("head.n_tokens").alias("n_tokens"),
        (F.col("head.n_known") + F.col("known")).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("head.base") + F.col("more")).alias("base_score"),
        (F.col("head.score") + F.col("gain")).alias("score"),
    )
