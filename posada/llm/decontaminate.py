"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised words of all items form one automaton. The words of every text are streamed through it while
the length of the longest match is tracked: from ``window`` words on, the matched words are hit; an item of
fewer words is hit only as a whole. ``scan`` reports hits, ``clean`` removes them.

A list of items passes through the driver: it is what all tasks need, and it does not grow with the documents. An
automaton is built of at most ``ITEM_BYTES`` of it (some 30 bytes a byte of text); a larger list is split into shards,
and the texts pass the shards' automata one after another without a shuffle, so that what a worker holds stays bounded.

Null and empty texts have no words and no hits; null and empty items match nothing; an item without an id counts in
hits but not among the items. Repeated rows are each scanned, and repeated items are found each by its own id. Texts of
any length are streamed whole. Empty tables give no rows or no hits. ``scan`` replaces columns of the same names as its
results; ``clean`` keeps all columns of the documents as they are but for the text.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

WINDOW = 10
ITEM_BYTES = 4 << 20


class SuffixAutomaton:
    """States of all factors of the added sequences, in flat arrays; ``items`` and ``whole`` tell whose factors they are.

    A state's arrows are a chain of entries (symbol, target, next); from ``WIDE`` arrows on they are a dict. The
    root's are an array by symbol.
    """

    WIDE = 12

    def __init__(self, window: int, symbols: int):
        self.window = window
        self.root = array("i", [-1]) * max(symbols, 1)
        self.wide: dict[int, dict[int, int]] = {}
        self.link, self.length, self.head, self.arrows = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [0])
        self.symbol, self.target, self.after = array("i"), array("i"), array("i")
        self.names: list[str] = []
        self.begin, self.words = array("q", [0]), array("i")

    def go(self, state: int, c: int) -> int:
        """The state after one more symbol, or -1."""
        if not state:
            return self.root[c]
        if self.arrows[state] >= self.WIDE:
            return self.wide[state].get(c, -1)
        at = self.head[state]
        while at >= 0:
            if self.symbol[at] == c:
                return self.target[at]
            at = self.after[at]
        return -1

    def _arrow(self, state: int, c: int, to: int) -> None:
        """A new arrow."""
        if not state:
            self.root[c] = to
            return
        n = self.arrows[state]
        if n < self.WIDE:
            self.symbol.append(c)
            self.target.append(to)
            self.after.append(self.head[state])
            self.head[state] = len(self.symbol) - 1
            if n + 1 == self.WIDE:
                self.wide[state] = dict(self._all(state))
        else:
            self.wide[state][c] = to
        self.arrows[state] = n + 1

    def _turn(self, state: int, c: int, to: int) -> None:
        """Another target of an arrow."""
        if not state:
            self.root[c] = to
        elif self.arrows[state] >= self.WIDE:
            self.wide[state][c] = to
        else:
            at = self.head[state]
            while self.symbol[at] != c:
                at = self.after[at]
            self.target[at] = to

    def _all(self, state: int) -> list[tuple[int, int]]:
        if state in self.wide:
            return list(self.wide[state].items())
        out, at = [], self.head[state]
        while at >= 0:
            out.append((self.symbol[at], self.target[at]))
            at = self.after[at]
        return out

    def _state(self, length: int, link: int) -> int:
        self.link.append(link)
        self.length.append(length)
        self.head.append(-1)
        self.arrows.append(0)
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the longest factor of p followed by c, split off its class where that holds longer ones."""
        q = self.go(p, c)
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q])
        for symbol, to in self._all(q):
            self._arrow(clone, symbol, to)
        while p >= 0 and self.go(p, c) == q:
            self._turn(p, c, clone)
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, item: str, symbols: list[int]) -> None:
        last = 0
        for c in symbols:
            if self.go(last, c) >= 0:
                last = self._split(last, c)
                continue
            new, p = self._state(self.length[last] + 1, 0), last
            while p >= 0 and self.go(p, c) < 0:
                self._arrow(p, c, new)
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c)
            last = new
        self.names.append(item)
        self.words.extend(symbols)
        self.begin.append(len(self.words))

    def finish(self) -> None:
        """Lays the tree of suffix links out so that a state's own is a range, with the items by that range; gathers the short items that end at each state."""
        n, w = len(self.length), self.window
        order = np.argsort(np.frombuffer(self.length, np.int32), kind="stable")
        size = [1] * n
        for s in order[:0:-1].tolist():
            size[self.link[s]] += size[s]
        self.first, free = array("i", [0]) * n, array("i", [1]) * n
        for s in order[1:].tolist():
            up = self.link[s]
            self.first[s] = free[up]
            free[s] = self.first[s] + 1
            free[up] += size[s]
        self.past = array("i", (f + k for f, k in zip(self.first, size, strict=True)))
        del size, free
        self.whole: dict[int, list[tuple[int, str]]] = {}
        places, owners = array("i"), array("i")
        for k, item in enumerate(self.names):
            at, symbols = 0, self.words[self.begin[k] : self.begin[k + 1]]
            for c in symbols:
                at = self.go(at, c)
                if self.length[at] >= w:
                    places.append(self.first[at])
                    owners.append(k)
            if 0 < len(symbols) < w:
                while self.length[self.link[at]] >= len(symbols):
                    at = self.link[at]
                self.whole.setdefault(at, []).append((len(symbols), item))
        by_place = np.argsort(np.frombuffer(places, np.int32), kind="stable") if len(places) else np.zeros(0, np.int64)
        self.places, self.owners = np.array(places, np.int32)[by_place], np.array(owners, np.int32)[by_place]
        if self.whole:
            for s in order[1:].tolist():
                if above := self.whole.get(self.link[s]):
                    self.whole[s] = self.whole.get(s, []) + above
        del self.words, self.begin
        self._items: dict[int, frozenset[str]] = {}

    def items(self, state: int) -> frozenset[str]:
        """The items that have the state's factors, of which at least the longest has the window's length."""
        found = self._items.get(state)
        if found is None:
            if len(self._items) >= 10_000:
                self._items.clear()
            a, b = np.searchsorted(self.places, (self.first[state], self.past[state]))
            found = self._items[state] = frozenset(self.names[k] for k in np.unique(self.owners[a:b]).tolist())
        return found

    def stream(self, symbols: list[int]) -> tuple[list[list[int]], set[str]]:
        """The hit stretches [start, end) of a word sequence, merged, and the items that occur."""
        go, link, length, w = self.go, self.link, self.length, self.window
        spans: list[list[int]] = []
        found: set[str] = set()
        at = size = 0
        for j, c in enumerate(symbols):
            while (to := go(at, c)) < 0 and at:
                at = link[at]
                size = length[at]
            if to < 0:
                size = 0
                continue
            at, size = to, size + 1
            reach = 0
            if size >= w:
                reach, up = size, at
                while length[link[up]] >= w:
                    up = link[up]
                found |= self.items(up)
            for m, item in self.whole.get(at, ()):
                if m <= size:
                    reach = max(reach, m)
                    found.add(item)
            if reach:
                start = j + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, j + 1])
        return spans, found


class Matcher:
    """The automaton of some items, with the item words as symbols; words that no item has are -1."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        data = [textops.LOWER[np.frombuffer((t or "").encode(), np.uint8)] for _, t in items]
        sequences = []
        for d in data:
            starts, ends, _ = textops.words(d, np.array([0, len(d)]), textops.ALNUM)
            sequences.append(textops.word_hashes(d, starts, ends))
        self.vocabulary = np.unique(np.concatenate([*sequences, np.zeros(0, np.uint64)]))
        self.automaton = SuffixAutomaton(window, len(self.vocabulary))
        pairs = []
        for (item, _), hashes in zip(items, sequences, strict=True):
            symbols = np.searchsorted(self.vocabulary, hashes)
            self.automaton.add(item, symbols.tolist())
            pairs.append(symbols[:-1] * len(self.vocabulary) + symbols[1:])
        self.automaton.finish()
        self.pairs = np.unique(np.concatenate([*pairs, np.array([-1])]))
        self.least = min([window, *(len(s) for s in sequences if len(s))])

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def stretches(self, symbols: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words of one row that can hold a hit: known words, each pair of neighbours a pair of some item."""
        known = symbols >= 0
        if len(symbols) < 2 or self.least < 2:
            joined = known[1:] & known[:-1]
        else:
            codes = symbols[:-1] * len(self.vocabulary) + symbols[1:]
            at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            joined = known[1:] & known[:-1] & (self.pairs[at] == codes)
        joined = joined & (rows[1:] == rows[:-1])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        found = [(int(a), int(b) + 1) for a, b in zip(edge[::2], edge[1::2], strict=True) if b + 1 - a >= self.least]
        if self.least < 2:
            alone = known.copy()
            alone[1:] &= ~joined
            alone[:-1] &= ~joined
            found = sorted(found + [(int(i), int(i) + 1) for i in np.flatnonzero(alone)])
        return found


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


RESULTS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_words array<int>, hit_bytes array<int>, items array<string>"
NAMES = RESULTS.replace(",", "").split()[::2]
_KINDS = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]


def _results(matcher: Matcher, texts: pa.Array, prior: pa.Array | None) -> pa.StructArray:
    """The hits of a batch of texts, with those that ``prior`` has from other shards."""
    data, offsets = textops.text_buffers(texts)
    data = textops.LOWER[data]
    starts, ends, rows = textops.words(data, offsets, textops.ALNUM)
    symbols = matcher.symbols(textops.word_hashes(data, starts, ends))
    n = len(texts)
    counts = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    spans: list[list[list[int]]] = [[] for _ in range(n)]
    found: list[set[str]] = [set() for _ in range(n)]
    if prior is not None:
        for i, (flat, items) in enumerate(zip(prior.field("hit_words").to_pylist(), prior.field("items").to_pylist(), strict=True)):
            spans[i] = [[a, b] for a, b in zip(flat[::2], flat[1::2], strict=True)]
            found[i] = set(items)
    for a, b in matcher.stretches(symbols, rows):
        row = rows[a]
        hits, items_hit = matcher.automaton.stream(symbols[a:b].tolist())
        spans[row] += [[int(a - first[row]) + x, int(a - first[row]) + y] for x, y in hits]
        found[row] |= items_hit
    spans = [_merged(s) for s in spans]
    lists = [sorted(x for x in f if x is not None) for f in found]
    flat_words = [[x for s in per for x in s] for per in spans]
    flat_bytes = [[int(x) for a, b in per for x in (starts[first[i] + a] - offsets[i], ends[first[i] + b - 1] - offsets[i])] for i, per in enumerate(spans)]
    hit = [sum(b - a for a, b in per) for per in spans]
    hashes = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]
    columns = [counts, hit, [len(x) for x in lists], hashes, [h > 0 for h in hit], flat_words, flat_bytes, lists]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], NAMES)


#: The last matcher of this worker.
_matchers: dict[str, Matcher] = {}


def _pass(docs: DataFrame, items: list[tuple[str | None, str]], window: int, text_col: str, prior: str | None, out: str | None, finish: Callable | None = None) -> DataFrame:
    """The documents with the hits, by a further shard, in the column ``out``, or with their text as ``finish`` leaves it from the hits, without the rows for which it gives False."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    mark = hashlib.sha256(repr((items, window)).encode()).hexdigest()
    names = [c for c in docs.columns if c != prior]
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _matchers:
            _matchers.clear()
            _matchers[mark] = Matcher(shared.value, window)
        matcher = _matchers[mark]
        for batch in textops.pieces(batches, text_col):
            texts = batch.column(text_col)
            found = _results(matcher, texts, batch.column(prior) if prior else None)
            columns = [batch.column(c) for c in names]
            if finish is None:
                yield pa.RecordBatch.from_arrays([*columns, found], [*names, out])
                continue
            left = [finish(text, hits) for text, hits in zip(texts, found, strict=True)]
            stay = pa.array([x is not False for x in left], pa.bool_())
            columns[place] = pa.array([None if x is False else x for x in left], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names).filter(stay)

    schema = ", ".join(f"`{c}` {'string' if c == text_col else docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.mapInArrow(run, schema + (f", `{out}` struct<{RESULTS.replace(' ', ':').replace(',:', ',')}>" if finish is None else ""))


def _shards(items: DataFrame, item_id: str, item_text: str, item_bytes: int) -> list[list[tuple[str | None, str]]]:
    items = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("body")).where("body is not null")
    total = items.agg(F.sum(F.octet_length("body") + 32)).first()[0] or 0
    shards = max(1, -(-total // item_bytes))
    parts = (items if shards == 1 else items.where(F.pmod(F.xxhash64("item", "body"), F.lit(shards)) == k) for k in range(shards))
    return [[(r.item, r.body) for r in part.sort("item", "body").collect()] for part in parts]


def _hits(docs: DataFrame, shards: list, window: int, text_col: str, finish: Callable | None = None) -> tuple[DataFrame, str]:
    names = ["__hits", "__more"]
    while {*names} & {*docs.columns}:
        names = [n + "_" for n in names]
    docs = docs.select(*(docs[c].cast("string").alias(c) if c == text_col else docs[c] for c in docs.columns))
    prior = None
    for k, items in enumerate(shards):
        out, last = names[k % 2], k == len(shards) - 1
        docs = _pass(docs, items, window, text_col, prior, out, finish if last else None)
        prior = out
    return docs, prior


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows with n_words, n_hit, n_items, items_sha256, contaminated, hit_words, hit_bytes and items.

    hit_words and hit_bytes hold start, end, start, end, ... of the hit stretches, as word indices and as
    bytes of the text in UTF-8.
    """
    own = [c for c in docs.columns if c not in NAMES]
    found, hits = _hits(docs.select(*own), _shards(items, item_id, item_text, item_bytes), window, text_col)
    return found.select(*own, f"{hits}.*")


def clean(docs: DataFrame, items: DataFrame, max_words: int = WINDOW - 1, max_coverage: float = 0.5, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The documents without contaminated stretches, in their own columns.

    Stretches of more than ``max_words`` hit words are cut out; a document of whose words more than
    ``max_coverage`` are hit goes. Clean documents stay as they are.
    """

    def finish(text: pa.StringScalar, hits: pa.StructScalar) -> str | None | bool:
        if not hits["contaminated"].as_py():
            return text.as_py()
        if hits["n_hit"].as_py() > max_coverage * hits["n_words"].as_py():
            return False
        data, last, kept = text.as_py().encode(), 0, []
        at, count = hits["hit_bytes"].as_py(), hits["hit_words"].as_py()
        for i in range(0, len(at), 2):
            if count[i + 1] - count[i] > max_words:
                kept.append(data[last : at[i]])
                last = at[i + 1]
        return b"".join([*kept, data[last:]]).decode()

    return _hits(docs, _shards(items, item_id, item_text, item_bytes), window, text_col, finish)[0]
