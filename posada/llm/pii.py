"""Personal data by a skip-chain conditional random field over base patterns.

Base patterns find e-mail addresses, network addresses, payment cards and phone numbers; their spans stay.
The field labels the tokens around anything that has digits or an at sign. Neighbouring tokens share chain
potentials; tokens that repeat or resemble one another anywhere in a document (the same letters, or the same last
digits) share skip potentials, so that a label that is plain at one mention reaches the others. Marginals
come from loopy belief propagation; tokens that are surely an entity outside all base spans are added.

Weights are learned by pseudo-likelihood in numpy on at most ``TRAIN_DOCS`` documents that hold digits or an
at sign (those of the least hashes of their ids), with the base spans as labels.

Null and empty texts have no spans. Whole texts are scanned, by patterns and loops of linear time. Repeated rows are
each scanned, and rows without an id too; ties between labels go to the first in ``LABELS``. An empty table gives an
empty one, and without training texts nothing is added. ``scan`` ignores columns other than id and text; ``redact``
keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .components import ensure_checkpoints
from .samples import least_hashes
from .spans import Span, digest, joined

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
TRAIN_DOCS = 2000
EPOCHS = 8
#: Tokens on each side of a candidate that are labelled with it.
AROUND = 2
#: Least marginal probability of an added span's tokens.
SURE = 0.9
ROUNDS = 25
#: Signs of a shape up to which it is a feature as it stands.
LONG_SHAPE = 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_SHAPE = ((re.compile("[a-z]+"), "a"), (re.compile("[A-Z]+"), "A"), (re.compile("[0-9]"), "9"), (re.compile("[^\x00-\x7f]+"), "u"))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Addresses, found from their at signs: the run of local characters before one, the dotted domain after it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
            last = domain.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[Span]:
    """The matches of the base patterns that pass their checks."""
    out = emails(text) if "@" in text else []
    if not _ANY.search(text):
        return out
    for m in _DOTTED.finditer(text):
        parts = [(n.start(), n.end()) for n in re.finditer("[0-9]+", m[0])]
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all((v := m[0][a:b].lstrip("0")) == "" or len(v) <= 3 and int(v) <= 255 for a, b in four):
                out.append(("ip", m.start() + four[0][0], m.start() + four[3][1]))
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def shape(token: str) -> str:
    """The kinds of a token's signs; of a shape that is longer than ``LONG_SHAPE`` the set of its signs and the digits' share of its length, in quarters."""
    n = len(token)
    digits = sum(c.isdigit() for c in token)
    for pattern, sign in _SHAPE:
        token = pattern.sub(sign, token)
    return token if len(token) <= LONG_SHAPE else f"{''.join(sorted(set(token)))}/{4 * digits // n}"


class Field:
    """The nodes of one document: tokens near candidates, their features, chain and skip neighbours."""

    def __init__(self, text: str):
        self.spans: list[tuple[int, int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.features: list[list[str]] = []
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)] if _ANY.search(text) else []
        near: set[int] = set()
        for i, (a, b) in enumerate(tokens):
            if _ANY.search(text, a, b):
                near.update(range(max(0, i - AROUND), min(len(tokens), i + AROUND + 1)))
        order = sorted(near)
        shapes = {}
        for i in order:
            for j in (i - 1, i, i + 1):
                if 0 <= j < len(tokens) and j not in shapes:
                    shapes[j] = shape(text[slice(*tokens[j])])
        seen: dict[str, int] = {}
        for k, i in enumerate(order):
            a, b = tokens[i]
            token = text[a:b]
            digits = re.sub("[^0-9]", "", token)
            self.spans.append((a, b))
            self.features.append(
                [
                    "bias",
                    "s:" + shapes[i],
                    "p:" + shapes.get(i - 1, ""),
                    "n:" + shapes.get(i + 1, ""),
                    f"d:{min(len(digits), 20)}",
                    f"v:{len(digits)}:{len(digits) in range(14, 20) and luhn(digits)}",
                    f"at:{'@' in token}:{token.count('.') > 0}",
                    f"dots:{min(len(re.findall(r'(?<=[0-9])[.](?=[0-9])', token)), 4)}",
                    f"plus:{token[:1] == '+'}:{token[:1] == '('}",
                ]
            )
            if k and order[k - 1] == i - 1:
                self.chain.append((k - 1, k))
            if _ANY.search(token):
                keys = [token.strip(".,;:!?\"'()[]{}<>|*#%&$").lower()]
                if len(digits) >= 7:
                    keys.append("#" + digits[-7:])
                for key in dict.fromkeys(keys):
                    if key in seen and seen[key] != k:
                        self.skip.append((seen[key], k))
                    seen[key] = k

    def labels(self, spans: list[Span]) -> np.ndarray:
        """The label of each token: the kind of the first base span over it. Tokens are in order and don't overlap."""
        out = np.zeros(len(self.spans), np.int64)
        ends = np.array([b for _, b in self.spans], np.int64)
        for kind, x, y in reversed(spans):
            k = int(np.searchsorted(ends, x, side="right"))
            while k < len(self.spans) and self.spans[k][0] < y:
                out[k] = LABELS.index(kind)
                k += 1
        return out


class Model:
    """Weights of features by label, of chain pairs (left, right) and of skip pairs (symmetric)."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.names, self.weights, self.chain, self.skip = names, weights, chain, skip

    def scores(self, field: Field) -> np.ndarray:
        return np.array([self.weights[[self.names[f] for f in fs if f in self.names]].sum(axis=0) for fs in field.features]).reshape(-1, len(LABELS))

    def marginals(self, field: Field) -> np.ndarray:
        """Loopy sum-product with damped messages."""
        own = self.scores(field)
        edges = [(a, b, self.chain) for a, b in field.chain] + [(a, b, self.skip) for a, b in field.skip]
        if not edges:
            return _softmax(own)
        source = np.array([e[0] for e in edges] + [e[1] for e in edges])
        target = np.array([e[1] for e in edges] + [e[0] for e in edges])
        table = np.array([e[2] for e in edges] + [e[2].T for e in edges])
        back = np.concatenate([np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))])
        sent = np.zeros((len(source), len(LABELS)))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, target, sent)
            out = (belief[source] - sent[back])[:, :, None] + table
            high = out.max(axis=1)
            new = high + np.log(np.exp(out - high[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - sent).max()
            sent = 0.5 * sent + 0.5 * new
            if change < 1e-3:
                break
        belief = own.copy()
        np.add.at(belief, target, sent)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def train(texts: list[str], seed: int = 1) -> Model:
    """Pseudo-likelihood: each token's label given its features and its neighbours' labels."""
    fields = [(f, f.labels(base_spans(t))) for t in texts for f in [Field(t)] if f.spans]
    names: dict[str, int] = {}
    for field, _ in fields:
        for fs in field.features:
            for f in fs:
                names.setdefault(f, len(names))
    n = len(LABELS)
    weights, chain, skip = np.zeros((len(names), n)), np.zeros((n, n)), np.eye(n) * 0.5
    squares = np.full((len(names), n), 1e-2)
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(fields)):
            field, y = fields[i]
            rows = [np.array([names[f] for f in fs if rng.random() > 0.15 or f == "bias"]) for fs in field.features]
            score = np.array([weights[r].sum(axis=0) for r in rows])
            for a, b in field.chain:
                score[b] += chain[y[a]]
                score[a] += chain[:, y[b]]
            for a, b in field.skip:
                score[b] += skip[y[a]]
                score[a] += skip[y[b]]
            error = -_softmax(score)
            error[np.arange(len(y)), y] += 1
            rate = 0.2 / (1 + epoch)
            for r, e in zip(rows, error, strict=True):
                squares[r] += e * e
                weights[r] += rate * e / np.sqrt(squares[r]) - 1e-4 * weights[r]
            for a, b in field.chain:
                chain[y[a]] += 0.05 * rate * error[b]
                chain[:, y[b]] += 0.05 * rate * error[a]
            for a, b in field.skip:
                skip[y[a]] += 0.05 * rate * error[b]
                skip[y[b]] += 0.05 * rate * error[a]
            skip = (skip + skip.T) / 2
    # Tokens alike must not repel one another's label.
    np.fill_diagonal(skip, np.maximum(np.diag(skip), 0.5))
    return Model(names, weights, chain, skip)


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """Spans of tokens that the field surely labels as an entity and that no base span touches; neighbours of one label make one span."""
    field = Field(text)
    if not field.spans:
        return []
    p = model.marginals(field)
    out: list[Span] = []
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], np.int64)
    linked = {b for _, b in field.chain}
    last = -1
    for k, (a, b) in enumerate(field.spans):
        label = int(p[k].argmax())
        at = int(np.searchsorted(starts, b)) - 1
        touched = at >= 0 and max(y for _, y in taken[max(0, at - 3) : at + 1]) > a
        if label == 0 or p[k, label] < SURE or touched or not _ANY.search(text, a, b):
            continue
        token = text[a:b]
        core = token.strip(".,;:!?\"'[]{}<>|*#%&$")
        a += token.index(core) if core else 0
        b = a + len(core)
        if not core:
            continue
        if out and last == k - 1 and k in linked and out[-1][0] == LABELS[label]:
            out[-1] = (out[-1][0], out[-1][1], b)
        else:
            out.append((LABELS[label], a, b))
        last = k
    return out


def fit(docs: DataFrame, rows: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    ensure_checkpoints(docs.sparkSession)
    some = least_hashes(texts.where(F.col("text").rlike("[0-9@]")).select("id").checkpoint(), "id", rows)
    found = texts.join(F.broadcast(some.distinct()), "id").sort(F.xxhash64("id"), "id").limit(rows).select("text").toArrow()
    model = train([t for t in found.column("text").to_pylist() if t])
    del found
    textops.release(collect=True)
    return model


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, n_email, n_ip, n_card, n_phone, base_sha256 and spans. One pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, id_col=id_col, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches):
            base, every = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base.append(base_spans(text))
                every.append(base[-1] + added_spans(text, base[-1], shared.value))
            columns = [batch.column(0), *(pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in KINDS)]
            columns += [pa.array([digest(joined(b, KINDS)) for b in base], pa.string()), pa.array([joined(e, KINDS) for e in every], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    found = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, {counts}, base_sha256 string, spans string")
    return found.withColumnRenamed("id", id_col)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one, by the first one's kind."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in their own columns, with all spans masked in the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, id_col=id_col, text_col=text_col))

    def one(text: str | None) -> str | None:
        if not text or not _ANY.search(text):
            return text
        base = base_spans(text)
        return masked(text, base + added_spans(text, base, shared.value))

    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches, text_col):
            columns = list(batch.columns)
            columns[place] = pa.array(map(one, columns[place].to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays(columns, docs_names)

    docs_names = docs.columns
    kinds = ", ".join(f"`{c}` {'string' if c == text_col else docs.schema[c].dataType.simpleString()}" for c in docs_names)
    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, kinds)
