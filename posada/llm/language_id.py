"""Language identification by unigrams of pieces, with all segmentations of a text summed.

A language is a distribution over the pieces of a fixed public vocabulary (byte strings; every single byte is one). The
probability of a word is the sum over all its segmentations into pieces of the products of their probabilities, which the
forward algorithm gives. A text's score under a language is the sum over its words of their logarithms and of the
logarithm of the language's share; the prediction is the language of the greatest score (ties: the least name), and
``score`` its posterior probability.

Words are maximal runs of letters of A-Z and of bytes beyond ASCII, in lower case, with a blank before them; digits and signs
tell nothing about a language. Words are worked out once per task while they are remembered (``REMEMBERED`` of them),
all segmentations of many words at a time; a long word is worked out by itself in time that is linear in its length.

Piece probabilities are learned by expectation maximisation: the forward-backward algorithm gives the expected number of
uses of each piece in the words of a language, in ``ROUNDS`` rounds from shares that fall with the piece's rank in
the vocabulary. Pieces that a language never needed are smoothed with their share in all languages. The training texts are those of at most
``TRAIN_ROWS`` documents per language (the least hashes of their ids), a bound that does not depend on the input; languages and their shares
are counted over all documents. Word counts and expected counts are aggregated by Spark; the driver holds one number per piece and language.

A null text, or one without any letter in Unicode's sense, is ``und`` with score 0, and so is every text if there is nothing to learn
from. Texts are read whole. Rows without an id or a language are predicted, but not learned from; repeated rows are predicted
alike and counted each for itself. An empty table gives an empty one. Columns other than id, text and language are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .bpe import vocabulary_path
from .quality import fold

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
TRAIN_ROWS, ROUNDS = 1000, 3
#: Pieces' uses that the share in all languages stands for.
SMOOTHING = 500.0
#: Words of more bytes are not learned from.
LONGEST_LEARNED = 200
#: Words up to this many bytes are worked out many at a time.
TOGETHER = 48
#: Words whose scores a task remembers.
REMEMBERED = 1 << 18
UNKNOWN = "und"
_WORD = textops.byte_class((0x61, 0x7A), (0x80, 0xFF))
_CODE = textops.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x100000001B3)


class Vocabulary:
    """The pieces that can occur in a word, looked up by the hashes of runs of bytes."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        with np.errstate(over="ignore"):
            codes = np.zeros(len(pieces), np.uint64)
            for i, piece in enumerate(pieces):
                for b in piece:
                    codes[i] = codes[i] * _BASE + _CODE[b]
        order = np.argsort(codes)
        self.codes, self.ids = codes[order], order.astype(np.int32)
        if (self.codes[1:] == self.codes[:-1]).any():
            raise ValueError("two pieces of the vocabulary have one hash")
        self.near = np.zeros(1 << 20, bool)
        self.near[self.codes >> np.uint64(44)] = True

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 if none."""
        out = np.full(codes.shape, -1, np.int32)
        maybe = np.flatnonzero(self.near[(codes >> np.uint64(44)).ravel()])
        asked = codes.ravel()[maybe]
        at = np.minimum(np.searchsorted(self.codes, asked), len(self.codes) - 1)
        hit = self.codes[at] == asked
        out.ravel()[maybe[hit]] = self.ids[at[hit]]
        return out


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces of a vocabulary file (base64 and rank per line) that are made of a blank, small letters and bytes beyond ASCII, by rank."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    inside = lambda p: all(_WORD[b] for b in p[p[:1] == b" " :])
    return Vocabulary([p for p in pieces if inside(p)])


class Lattice:
    """All pieces in some words of one length: for each end a list of (length, words, pieces)."""

    def __init__(self, words: np.ndarray, vocabulary: Vocabulary):
        n, self.length = words.shape
        codes, value = _CODE[words], np.zeros(words.shape, np.uint64)
        self.ends: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(self.length + 1)]
        with np.errstate(over="ignore"):
            for k in range(1, min(self.length, vocabulary.longest) + 1):
                # The hash of the k bytes that end at a place, from the one of the k - 1 bytes that end before it.
                value = codes if k == 1 else value[:, :-1] * _BASE + codes[:, k - 1 :]
                found = vocabulary.find(np.ascontiguousarray(value.T))
                for place, row in enumerate(found):
                    some = np.flatnonzero(row >= 0)
                    if len(some):
                        self.ends[place + k].append((k, some, row[some]))
        self.n = n

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """(place, word, language): the logarithm of the sum over all segmentations up to the place."""
        total = np.full((self.length + 1, self.n, logs.shape[1]), -np.inf)
        total[0] = 0
        for end, found in enumerate(self.ends):
            for k, rows, pieces in found:
                total[end, rows] = np.logaddexp(total[end, rows], total[end - k, rows] + logs[pieces])
        return total

    def uses(self, logs: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
        """Adds the expected number of uses of each piece; ``logs`` is of one language, ``counts`` are those of the words."""
        ahead = self.forward(logs)[:, :, 0]
        behind = np.full((self.length + 1, self.n), -np.inf)
        behind[self.length] = 0
        for end in range(self.length, 0, -1):
            for k, rows, pieces in self.ends[end]:
                behind[end - k, rows] = np.logaddexp(behind[end - k, rows], logs[pieces, 0] + behind[end, rows])
        for end, found in enumerate(self.ends):
            for k, rows, pieces in found:
                share = np.exp(ahead[end - k, rows] + logs[pieces, 0] + behind[end, rows] - ahead[self.length, rows])
                out += np.bincount(pieces, counts[rows] * share, minlength=len(out))


def long_word(word: np.ndarray, vocabulary: Vocabulary, logs: np.ndarray, step: int = 4096) -> np.ndarray:
    """The logarithm of the sum over all segmentations of one word of any length, for each language."""
    most = vocabulary.longest
    recent = np.full((most, logs.shape[1]), -np.inf)  # of the last places, the latest first
    recent[0] = 0
    codes = _CODE[np.concatenate([np.zeros(most - 1, np.uint8), word])]
    for at in range(0, len(word), step):
        n = min(step, len(word) - at)
        value = np.zeros(n, np.uint64)
        weights = np.full((n, most, logs.shape[1]), -np.inf)
        with np.errstate(over="ignore"):
            for k in range(1, most + 1):
                # value is the hash of the last k bytes: the new one has the highest power.
                value = value + codes[at + most - k : at + most - k + n] * _power(k - 1)
                found = np.where(np.arange(at + 1, at + n + 1) >= k, vocabulary.find(value), -1)
                weights[found >= 0, k - 1] = logs[found[found >= 0]]
        for i in range(n):
            one = np.logaddexp.reduce(recent + weights[i])
            recent[1:] = recent[:-1].copy()
            recent[0] = one
    return recent[0]


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), k, 1 << 64))


def _spelled(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Words of one length with a blank before them, one a row."""
    return np.concatenate([np.full((len(starts), 1), 0x20, np.uint8), data[starts[:, None] + np.arange(length)]], axis=1)


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary, logs: np.ndarray) -> np.ndarray:
    """(word, language): the logarithms of the words' probabilities."""
    out = np.zeros((len(starts), logs.shape[1]))
    lengths = ends - starts
    for length in np.unique(lengths):
        those = np.flatnonzero(lengths == length)
        if length > TOGETHER:
            for i in those:
                out[i] = long_word(np.concatenate([[0x20], data[starts[i] : ends[i]]]).astype(np.uint8), vocabulary, logs)
            continue
        for at in range(0, len(those), 4096):
            some = those[at : at + 4096]
            out[some] = Lattice(_spelled(data, starts[some], int(length)), vocabulary).forward(logs)[-1]
    return out


def lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return textops.text_buffers(pc.utf8_lower(pc.cast(column, pa.large_string())))


class Scorer:
    """Scores of texts; remembers words for as long as the object lives."""

    def __init__(self, vocabulary: Vocabulary, logs: np.ndarray, priors: np.ndarray):
        self.vocabulary, self.logs, self.priors = vocabulary, logs, priors
        self._forget()

    def _forget(self) -> None:
        self.known, self.values = np.zeros(0, np.uint64), np.zeros((0, self.logs.shape[1]))

    def scores(self, column: pa.Array) -> np.ndarray:
        """(text, language): the joint logarithms of text and language."""
        data, offsets = lower(column)
        starts, ends, rows = textops.words(data, offsets, _WORD)
        hashes, first, which = np.unique(textops.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        fresh = np.flatnonzero(self.known[at] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(fresh):
            if len(self.known) + len(fresh) > REMEMBERED:
                self._forget()
                fresh = np.arange(len(hashes))
            new = word_scores(data, starts[first[fresh]], ends[first[fresh]], self.vocabulary, self.logs)
            place = np.searchsorted(self.known, hashes[fresh])
            self.known, self.values = np.insert(self.known, place, hashes[fresh]), np.insert(self.values, place, new, axis=0)
        each = self.values[np.searchsorted(self.known, hashes)][which] if len(hashes) else np.zeros((0, self.logs.shape[1]))
        sums = [np.bincount(rows, each[:, j], minlength=len(column)) for j in range(self.logs.shape[1])]
        return np.stack(sums, axis=1) + self.priors


def lettered(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter; False for nulls."""
    text = pc.fill_null(pc.cast(column, pa.large_string()), "")
    return np.array(pc.match_substring_regex(text, r"\p{L}"), bool)


def training_words(docs: DataFrame, learn: Column, rows: int, id_col: str, text_col: str, lang_col: str) -> tuple[dict[str, int], DataFrame]:
    """The number of documents of each language to learn from, and (lang, word, n): the words of at most ``rows`` of them per language, lower case."""
    some = docs.where(learn & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    some = some.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    shares = {r["lang"]: r["count"] for r in some.groupBy("lang").count().collect()}
    if not shares:
        return shares, some.select("lang", F.col("text").alias("word"), F.lit(1).alias("n"))
    # Of a language's rows those of clearly greater hashes go before the rest are ranked.
    least = {lang: min((1 << 63) - 1, int(-(1 << 63) + min(1.0, 1.5 * rows / n) * (1 << 64))) for lang, n in shares.items()}
    bound = F.create_map(*(F.lit(x) for pair in least.items() for x in pair))[F.col("lang")]
    ids = some.select("id", "lang").distinct().where(F.xxhash64("id") <= bound)
    ranked = ids.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))).where(F.col("rank") <= rows)
    texts = some.where(F.xxhash64("id") <= bound).join(F.broadcast(ranked.select("id", "lang")), ["id", "lang"]).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches):
            data, offsets = lower(batch.column("text"))
            starts, ends, owners = textops.words(data, offsets, _WORD)
            for lang in pc.unique(batch.column("lang")).to_pylist():
                own = np.flatnonzero(np.array(pc.equal(batch.column("lang"), lang), bool)[owners] & (ends - starts <= LONGEST_LEARNED))
                _, first, counts = np.unique(textops.word_hashes(data, starts[own], ends[own]), return_index=True, return_counts=True)
                words = [data[starts[i] : ends[i]].tobytes() for i in own[first]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["lang", "word", "n"])

    counted = texts.mapInArrow(cut, "lang string, word binary, n long")
    return shares, counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_uses(words: DataFrame, vocabulary: Vocabulary, logs: np.ndarray, langs: list[str]) -> np.ndarray:
    """(piece, language): the expected number of uses of each piece in the words (lang, word, n) under the present probabilities."""
    shared = words.sparkSession.sparkContext.broadcast((vocabulary, logs, langs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, logs, langs = shared.value
        total = np.zeros(logs.shape)
        for batch in batches:
            for j, lang in enumerate(langs):
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                spelled, counts = own.column("word").to_pylist(), own.column("n").to_numpy()
                lengths = np.array([len(w) for w in spelled], np.int64)
                for length in np.unique(lengths):
                    those = np.flatnonzero(lengths == length)
                    for at in range(0, len(those), 4096):
                        part = those[at : at + 4096]
                        data = np.frombuffer(b"".join(b" " + spelled[i] for i in part), np.uint8).reshape(len(part), -1)
                        Lattice(data, vocabulary).uses(logs[:, j : j + 1], counts[part], total[:, j])
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], ["piece", "lang", "uses"])

    found = words.mapInArrow(count, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toArrow()
    out = np.zeros(logs.shape)
    out[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["uses"].to_numpy()
    shared.unpersist()
    return out


def smoothed(uses: np.ndarray) -> np.ndarray:
    """The logarithms of the pieces' probabilities: uses of a language and ``SMOOTHING`` more that are dealt out by the share in all languages."""
    pooled = uses.sum(axis=1) + 0.05
    pooled /= pooled.sum()
    return np.log((uses + SMOOTHING * pooled[:, None]) / (uses.sum(axis=0) + SMOOTHING))


def fit(docs: DataFrame, learn: Column, vocabulary: Vocabulary, rows: int = TRAIN_ROWS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, logarithms of their pieces' probabilities, logarithms of their shares)."""
    shares, words = training_words(docs, learn, rows, id_col, text_col, lang_col)
    langs = sorted(shares)
    if not langs:
        return langs, np.zeros((len(vocabulary.pieces), 0)), np.zeros(0)
    falling = 1 / np.arange(10.0, 10.0 + len(vocabulary.pieces))
    logs = np.repeat(np.log(falling / falling.sum())[:, None], len(langs), axis=1)
    words = words.persist()
    for _ in range(rounds):
        logs = smoothed(expected_uses(words, vocabulary, logs, langs))
    words.unpersist()
    n = np.array([shares[lang] for lang in langs], float)
    return langs, logs, np.log((n + 1) / (n.sum() + len(n)))


def identify(docs: DataFrame, held_out: Column | None = None, path: str | None = None, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: the id, held_out, lang_pred, score. Held-out documents are not learned from."""
    held = fold(id_col, 4, 2) if held_out is None else held_out
    vocabulary = read_vocabulary(path or vocabulary_path(VOCABULARY))
    langs, logs, priors = fit(docs, ~held, vocabulary, rows, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, langs, logs, priors))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, langs, logs, priors = shared.value
        scorer = Scorer(vocabulary, logs, priors)
        for batch in textops.pieces(batches):
            named = lettered(batch.column("text")) & (len(langs) > 0)
            best, share = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            if langs:
                joint = scorer.scores(batch.column("text"))
                best = joint.argmax(axis=1)
                share = 1 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
            names = [langs[i] if ok else UNKNOWN for i, ok in zip(best, named, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(np.where(named, share, 0.0))], ["id", "lang_pred", "score"])

    found = texts.mapInArrow(predict, f"id {texts.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col).select(id_col, held.alias("held_out"), "lang_pred", "score")
