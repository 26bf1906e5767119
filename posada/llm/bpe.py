"""BPE encoding and decoding with a public vocabulary file.

``encode_documents`` gives the token ids of every text and the text that those ids decode to.  The text is
normalised (NFC, lower case), cut at white space and into runs of letters, single digits and runs of other
signs, and each piece is merged by ``merge``: a segment tree over the ranks of adjacent pairs, whose root
yields the leftmost pair of the lowest rank, with logarithmic updates, until no pair can be merged.

Null and empty texts have no tokens. Repeated rows are encoded each for itself. Columns other than the id
and the text are ignored. A text of any length is encoded whole, in O(n log n) even as one word.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textops

NONE = 1 << 60


# Letters and numbers of Unicode 16.0, which the standard library's tables (15.1) don't have yet.
NEW_LETTERS = (
    "\u1C89-\u1C8A\uA7CB-\uA7CD\uA7DA-\uA7DC\U000105C0-\U000105F3\U00010D4A-\U00010D65\U00010D6F-\U00010D85\U00010EC2-\U00010EC4"
    "\U00011380-\U00011389\U0001138B\U0001138E\U00011390-\U000113B5\U000113B7\U000113D1\U000113D3\U00011BC0-\U00011BE0"
    "\U00013460-\U000143FA\U00016100-\U0001611D\U00016D40-\U00016D6C\U00018CFF\U0001E5D0-\U0001E5ED\U0001E5F0"
)
NEW_NUMBERS = "\U00010D40-\U00010D49\U000116D0-\U000116E3\U00011BF0-\U00011BF9\U00016130-\U00016139\U00016D70-\U00016D79\U0001CCF0-\U0001CCF9\U0001E5F1-\U0001E5FA"
# Small letters of capitals that are newer than those tables.
NEW_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def assigned(kind: str) -> str:
    """The set of code points of a general category (its first letter) in the standard library's Unicode tables, as ranges."""
    inside = np.array([unicodedata.category(chr(c))[0] == kind for c in range(sys.maxunicode + 1)] + [False])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    return "".join(f"\\U{a:08X}-\\U{b - 1:08X}" for a, b in zip(edges[::2], edges[1::2], strict=True))


_LETTERS, _NUMBERS = assigned("L") + NEW_LETTERS, assigned("N") + NEW_NUMBERS
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\p{{White_Space}}{_LETTERS}{_NUMBERS}]+")
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+", re.ASCII)
_NEW_CAPITALS = re.compile("[" + "".join(map(chr, NEW_SMALL)) + "]")
_BLANK = regex.compile(r"\p{White_Space}+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
CACHED_WORDS = 150_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself where printable, else the next one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class RankTree:
    """A segment tree of minima over the ranks of adjacent pairs, each node over ``FAN`` children."""

    FAN = 32

    def __init__(self, ranks: list[int]):
        self.levels = [ranks]
        while len(self.levels[-1]) > self.FAN:
            below = self.levels[-1]
            self.levels.append([min(below[i : i + self.FAN]) for i in range(0, len(below), self.FAN)])

    def first_lowest(self) -> int:
        """The position of the leftmost lowest rank, or -1 if no pair has a rank."""
        low, at = min(self.levels[-1]), 0
        if low == NONE:
            return -1
        for level in reversed(self.levels):
            at = level.index(low, at * self.FAN)
        return at

    def put(self, at: int, rank: int) -> None:
        levels, fan = self.levels, self.FAN
        levels[0][at] = rank
        for k in range(1, len(levels)):
            at //= fan
            low = min(levels[k - 1][at * fan : at * fan + fan])
            if levels[k][at] == low:
                break
            levels[k][at] = low


class Vocabulary:
    """The merges and tokens of one vocabulary file, and a bounded memory of words already encoded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = {i: t.encode() for t, i in (self.ids | self.special).items()}
        symbols = byte_symbols()
        self.inner, self.outer = [self.ids[s] for s in symbols], [self.ids[s + self.suffix] for s in symbols]
        self.pairs: dict[tuple[int, int], int] = {}
        self.ranks: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pair = self.ids[a], self.ids[b]
            if pair not in self.ranks:
                self.ranks[pair], self.pairs[pair] = rank, self.ids[a + b]
        self.known = Words(self)

    def merge(self, ids: list[int]) -> list[int]:
        pairs, n = self.pairs, len(ids)
        if n < 2:
            return ids
        rank = self.ranks.get
        tree = RankTree([rank(p, NONE) for p in zip(ids, ids[1:])])
        lowest, put = tree.first_lowest, tree.put
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (at := lowest()) >= 0:
            right = after[at]
            new = ids[at] = pairs[ids[at], ids[right]]
            ids[right] = -1
            end = after[at] = after[right]
            if end < n:
                before[end] = at
                put(right, NONE)
                put(at, rank((new, ids[end]), NONE))
            else:
                if right < n - 1:
                    put(right, NONE)
                put(at, NONE)
            if (left := before[at]) >= 0:
                put(left, rank((ids[left], new), NONE))
        return [i for i in ids if i >= 0]

    def word(self, text: str) -> bytes:
        """The ids of one stretch without white space."""
        found = [text] if text.isalpha() else (_ASCII_PIECES if text.isascii() else _PIECES).findall(text)
        if len(found) > 1:
            return b"".join(map(self.known.__getitem__, found))
        out = b""
        for piece in found:
            coded = piece.encode()
            ids = [self.inner[b] for b in coded]
            ids[-1] = self.outer[coded[-1]]
            out += np.array(self.merge(ids), "<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.marks and any(mark in text for mark in self.special):
            return b"".join(np.uint32(self.special[part]).tobytes() if part in self.special else self._plain(part) for part in self.marks.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if not text.isascii() and _NEW_CAPITALS.search(text):
            text = text.translate(NEW_SMALL)
        parts = text.split() if not _SEPARATORS.search(text) else [p for p in _BLANK.split(text) if p]
        return b"".join(map(self.known.__getitem__, parts))

    def decode(self, ids: list[int]) -> bytes:
        """The tokens in UTF-8, one blank between them, special ones kept."""
        return b" ".join(map(self.token.__getitem__, ids))


class Words(dict):
    """Words already encoded, in two generations of at most ``CACHED_WORDS``; the elder one is dropped when the younger is full."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.elder = vocabulary, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.elder.get(word)
        if ids is None:
            ids = self.vocabulary.word(word)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.elder = dict(self)
                self.clear()
            self[word] = ids
        return ids


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids themselves.

    One pass without a shuffle; the vocabulary is read once in each Python worker from ``path``.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            counts, id_hashes, text_hashes, ids = [], [], [], []
            for text in batch.column(1):
                coded = v.encode(text.as_py() or "")
                tokens = np.frombuffer(coded, "<u4")
                counts.append(len(tokens))
                id_hashes.append(hashlib.sha256(coded).hexdigest())
                text_hashes.append(hashlib.sha256(v.decode(tokens.tolist())).hexdigest())
                if with_ids:
                    ids.append(tokens.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        # Workers serve other tasks later; what they remember goes.
        vocabulary.cache_clear()
        del v
        textops.release()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, schema)


def decode_ids(tokens: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``: the tokens of ``ids_col`` joined by blanks; null where the ids are null."""
    path = path or vocabulary_path()

    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def decoded(column):  # noqa: ANN001, ANN202
        v = vocabulary(path)
        return column.map(lambda x: None if x is None else v.decode(list(map(int, x))).decode())

    return tokens.withColumn("decoded", decoded(F.col(ids_col)))
