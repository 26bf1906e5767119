"""Secret scans with structural confirmation.

Base patterns report assignments, access keys and hexadecimal runs. Further candidates, in base64 or
hexadecimal, are decoded and reported only where their structure confirms them: a DER key whose nested
lengths fit, a key in the SSH wire format, an armoured private key around such a body, or a signed token
whose header names an algorithm. Base spans are never taken back.

Null and empty texts have no spans. Texts are scanned whole. Candidates overlap, so that none of them is decoded to its end
before its beginning fits: keys are read where their length fields point, and a run is decoded once for all tokens
that may begin in it, with parsing taken up where the last one failed. Repeated rows are each
scanned, and rows without an id too; of spans that begin together the kinds' order decides. An empty table gives an
empty one. Columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops
from .spans import Span, digest, joined

KINDS = ("assign", "access", "hex", "token", "key", "armour")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: The header of a signed token: a run before a dot. Its decoded text begins with a brace or a blank.
_HEADER = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{12,}(?=\.)")
_JSON_START = re.compile(r"(?:e[w-z0-9_-]|I[A-P]|C[Q-Zg-va-f]|D[Q-Za-f])[A-Za-z0-9_-]")
#: A decoded header's beginning up to its first key's first sign.
_OBJECT = re.compile(r'[ \t\r\n]*\{[ \t\r\n]*"(?=[A-Za-z0-9_])')
_DECODER = json.JSONDecoder()
_BLANK_END = re.compile(r"[ \t\r\n]*\Z")
_KEY_TYPE = re.compile(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{3,60}")
_REST = re.compile(r"\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: What a sequence, a length below 256 and the SSH magic look like in base64, and a run from there on.
_START = re.compile(r"M[A-P]|AAAA|b3Bl")
_RUN = re.compile(r"[A-Za-z0-9+/_-]*={0,2}")
_HEX_RUN = re.compile(r"[0-9a-fA-F]{32,}")
_ESCAPE = re.compile(r"\\[nrt]|\\u00[0-9a-fA-F]{2}|%[0-9a-fA-F]{2}")
_LINE_END = re.compile(r"(?:\\+r)?\\+n|\\+r|\\+u000[aAdD]|\r\n?")
_HEADER_LINE = re.compile(r"[A-Za-z][A-Za-z0-9-]*:.*")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z ]{0,32}PRIVATE KEY)-----")


def base_spans(text: str) -> list[Span]:
    """Matches of the three base patterns that are long enough."""
    out: list[Span] = []
    if _WORDS.search(text):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def decoded(text: str) -> bytes | None:
    """The bytes of a base64 text in either alphabet, padded or not."""
    body = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


class Coded:
    """The bytes that a base64 run from ``start`` to ``end`` stands for, decoded where they are asked for."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start = text, start
        while end > start and text[end - 1] == "=":
            end -= 1
        self.size = (end - start) * 3 // 4

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, key: int | slice) -> int | bytes:
        a, b, _ = key.indices(self.size) if isinstance(key, slice) else (key, key + 1, 1)
        if not 0 <= a <= b <= self.size:
            raise IndexError(key)
        first, n = self.start + a // 3 * 4, -(-4 * (b - a // 3 * 3) // 3)
        data = decoded(self.text[first : first + n])[a % 3 : a % 3 + b - a] if b > a else b""
        return data if isinstance(key, slice) else data[0]


def der_parts(data: bytes | Coded, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[at:end] exactly, or None where lengths don't fit."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_der_key(data: bytes | Coded) -> bool:
    """Whether the bytes are one sequence whose nested values have fitting lengths and that looks like a key: it begins with a version number or an algorithm, and holds more."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    outer = der_parts(data, 0, len(data))
    if outer is None or len(outer) != 1:
        return False
    inner = der_parts(data, outer[0][1], outer[0][2])
    if not inner or len(inner) < 2:
        return False
    for tag, a, b in inner:
        if tag in (0x30, 0x31, 0xA0, 0xA1) and der_parts(data, a, b) is None:
            return False
    tag, a, b = inner[0]
    if tag == 0x02:
        return b - a == 1 and data[a] <= 3
    algorithm = der_parts(data, a, b) if tag == 0x30 else None
    return bool(algorithm) and algorithm[0][0] == 0x06 and inner[1][0] == 0x03


def is_wire_key(data: bytes) -> bool:
    """Whether the bytes are an SSH key: the private format's magic, or length-prefixed fields that fill them, the first naming a key type."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at + 4 <= len(data) and len(fields) < 64:
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(data) and len(fields) >= 2 and _KEY_TYPE.fullmatch(fields[0]) is not None


def is_signed_token(text: str) -> bool:
    header, body, signature = text.split(".")
    try:
        head, payload = (json.loads(decoded(x) or b"null") for x in (header, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(payload, dict) and (head["alg"].lower() == "none" or len(signature) >= 16)


def starts_value(text: str, at: int) -> bool:
    """Whether a value may start here: after anything but a letter or digit, or after an escaped sign."""
    return not at or not (text[at - 1].isascii() and text[at - 1].isalnum()) or any(_ESCAPE.fullmatch(text, max(0, at - n), at) for n in (2, 3, 6))


def key_end(text: str, start: int, end: int) -> int:
    """Where the base64 key that starts here ends, or 0. It ends with its run (that ends at ``end``) or before a separator."""

    def at_byte(n: int) -> int:
        """Where n bytes end in the text, 0 unless the run ends or a separator stands there."""
        to = start + -(-4 * n // 3)
        if to > end or to < end and text[to] not in "/+_-=":
            return 0
        return end if end - to <= 2 and text[to:end].strip("=") == "" else to

    if text[start] == "M":
        head = decoded(text[start : start + 8]) or b""
        if len(head) < 6:
            return 0
        size = head[1] & 0x7F
        size = 2 + size + int.from_bytes(head[2 : 2 + size], "big") if head[1] >= 0x80 and 1 <= size <= 4 else 2 + size
        to = at_byte(size)
        return to if to and is_der_key(Coded(text, start, to)) else 0
    data = Coded(text, start, end)
    if data[:15] == b"openssh-key-v1\0":
        return end
    at, found = 0, 0
    for n in range(64):
        if at + 4 > len(data) or (size := int.from_bytes(data[at : at + 4], "big")) > len(data) - at - 4:
            break
        if not n and (size > 64 or not _KEY_TYPE.fullmatch(data[4 : 4 + size])):
            break
        at += 4 + size
        if n and (to := at_byte(at)):
            found = to
    return found


def object_end(text: str, at: int) -> tuple[bool, int]:
    """(True, its end) of the JSON object that begins here, or (False, where it can't go on). Reads little more than that, as an error's cost grows with the text given."""
    width = 256
    while True:
        part = text[at : at + width]
        try:
            return True, at + _DECODER.raw_decode(part)[1]
        except json.JSONDecodeError as e:
            if at + width >= len(text) or not e.msg.startswith("Unterminated") and e.pos < len(part) - 16:
                return False, at + e.pos
        except RecursionError:
            return False, at
        width *= 4


def token_start(text: str, start: int, end: int, rest: int) -> int:
    """Where the first signed token begins whose header ends with the run text[start:end] and that ends at ``rest``; -1 if none.

    The run is decoded once for each of the four ways in which its signs can be grouped. Where the parser gave up on an object, it would do so on all objects within
    too: an object begins with a key, and one that begins in a string of another ends that string, so that its key is where the parser gave up.
    """
    runs: dict[int, str] = {}
    given_up = [0, 0, 0, 0]
    for at in range(start, end - 11):
        if (end - at) % 4 == 1 or not _JSON_START.match(text, at, end) or not starts_value(text, at):
            continue
        group = (at - start) % 4
        if group not in runs:
            runs[group] = (decoded(text[start + group : end]) or b"").decode("latin-1")
        header = runs[group]
        m = _OBJECT.match(header, (at - start - group) // 4 * 3)
        if not m or m.end() < given_up[group]:
            continue
        whole, to = object_end(header, header.index("{", m.start()))
        given_up[group] = max(to, m.end() + 1)
        if whole and _BLANK_END.match(header, to) and is_signed_token(text[at:rest]):
            return at
    return -1


def armour_body(text: str) -> tuple[bytes | None, dict[str, str]]:
    """The bytes and the header lines of what stands in an armour; line ends may be escaped, also more than once."""
    headers: dict[str, str] = {}
    body, more = [], False
    for line in map(str.strip, _LINE_END.sub("\n", text).split("\n")):
        if not body and _HEADER_LINE.fullmatch(line):
            name, _, value = line.partition(":")
            headers[name.lower()] = value.strip()
            more = True
        elif more and line and not body and not re.fullmatch(r"[A-Za-z0-9+/=]{32,}", line):
            headers[name.lower()] += line  # a header goes on
        elif not line:
            more = False
        else:
            body.append("".join(line.split()))
    return decoded("".join(body)), headers


def is_armoured_key(text: str) -> bool:
    """A key, or by its headers an encrypted one: a cipher with its start vector, and whole blocks."""
    body, headers = armour_body(text)
    if body is None:
        return False
    if "ENCRYPTED" in headers.get("proc-type", "") and re.fullmatch(r"[A-Za-z0-9-]+,\s*(?:[0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})", headers.get("dek-info", "")):
        return len(body) >= 24 and len(body) % 8 == 0
    return is_der_key(body) or is_wire_key(body)


def confirmed_spans(text: str) -> list[Span]:
    """Candidates whose decoded structure is that of a key or a signed token."""
    out: list[Span] = []
    if "." in text:
        for m in _HEADER.finditer(text):
            rest = _REST.match(text, m.end())
            if rest and (at := token_start(text, m.start(), m.end(), rest.end())) >= 0:
                out.append(("token", at, rest.end()))
    if "PRIVATE KEY-----" in text:
        begins = list(_ARMOUR.finditer(text))
        ends = {label: [m.start() for m in re.finditer(f"-----END {label}-----", text)] for label in {m[1] for m in begins}}
        for m, after in zip(begins, [*begins[1:], None], strict=True):
            at = bisect_left(ends[m[1]], m.end())
            end = ends[m[1]][at] if at < len(ends[m[1]]) else -1
            if end >= 0 and (after is None or end <= after.start()) and is_armoured_key(text[m.end() : end]):
                out.append(("armour", m.start(), end + len(m[1]) + 14))
    done = end = 0
    for m in _START.finditer(text):
        start = m.start()
        if start >= done and starts_value(text, start):
            if start >= end:
                end = _RUN.match(text, start).end()
            if end - start >= 32 and (to := key_end(text, start, end)):
                out.append(("key", start, to))
                done = to
    for m in _HEX_RUN.finditer(text):
        # Two digits are a byte, so that a key fills the digits.
        if len(m[0]) % 2 == 0 and m[0].lower().startswith(("30", "000000", "6f70656e")):
            data = bytes.fromhex(m[0])
            if is_der_key(data) or is_wire_key(data):
                out.append(("key", m.start(), m.end()))
    return out


def find_secrets(text: str | None) -> list[Span]:
    text = text or ""
    return base_spans(text) + confirmed_spans(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, n_assign, n_access, n_hex, base_sha256 and spans. One pass without a shuffle."""
    counts = ("assign", "access", "hex")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches):
            base, every = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base.append(base_spans(text))
                every.append(base[-1] + confirmed_spans(text))
            columns = [batch.column(0), *(pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in counts)]
            columns += [pa.array([digest(joined(b, KINDS)) for b in base], pa.string()), pa.array([joined(e, KINDS) for e in every], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.withColumnRenamed("id", id_col)
