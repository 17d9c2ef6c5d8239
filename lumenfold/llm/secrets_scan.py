"""Secret scan: patterns, and structural confirmation of encoded candidates.

Three base kinds are reported by pattern alone (leftmost, not overlapping per
kind, whole matches):

* ``assign``: key word, separator and a value of 8 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 16 or more characters;
* ``hex``: a run of 32 or more lower-case hex digits.

The confirmed kinds add spans. Base64, base64url and hex runs are decoded and
parsed; only what has the structure of a credential is reported:

* ``jwt``: three base64url parts whose header is a JSON object with a string
  ``alg``, whose payload is a JSON object, and whose signature is not empty
  unless ``alg`` is ``none``;
* ``der``: an ASN.1 sequence whose nested lengths add up exactly and whose
  content is that of a PKCS#1, PKCS#8, SEC1 or subject-public-key structure;
* ``openssh``: the ``openssh-key-v1`` container, its length-prefixed fields read
  in full.

Base64 may follow ``=``, ``-`` or a line break written as backslash-n; its lines
may be broken by real or written line breaks and be indented. Where a key ends is
read from its structure, so that text after it does not hide it.

A header's or payload's JSON may have blanks and line breaks after its brace.

Spans are code points, end exclusive. Null texts count as empty; a text without
a match has zero counts, an empty ``spans`` and the digest of the empty string.
All patterns are linear in the text (long runs cannot be entered again from
their middle). Rows are independent: repeated ones and ones without an id are
returned as often as they occur. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Fixed values of the contract, in its order of kinds.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

KINDS = (*BASE_KINDS, "jwt", "der", "openssh")
#: An opening brace and a quote or blank ("ey"), or a line break or tab ("ew"), in base64url; a payload may be empty ("e3").
JWT = re.compile(r"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]+\.e[yw3][A-Za-z0-9_-]+\.[A-Za-z0-9_-]*(?![A-Za-z0-9_-])")
#: Line breaks within a block: real ones or written as backslash-n, with indentation.
BREAK = r"(?:[\x20\t]*+(?:\r?\n|(?:\\++r)?\\++n)[\x20\t]*+)"
START = r"(?:(?<![A-Za-z0-9+/_])|(?<=\\n)|(?<=\\r)|(?<=\\t))(?:MI|MH|MC|MD|ME|MF|MG|b3BlbnNzaC1rZXkt)"
LINE = r"(?:[A-Za-z0-9+/_]|-(?!----))"
BASE64 = re.compile(f"{START}{LINE}++(?:{BREAK}{LINE}++)*+={{0,2}}")
BASE64_START, BASE64_BREAK = re.compile(START), re.compile(BREAK)
HEX_CODE = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}(?![0-9A-Fa-f])")


def decode_base64(run: str) -> bytes | None:
    run = re.sub(r"[\r\n=]", "", run).replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    raw = decode_base64(part)
    try:
        got = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def is_jwt(run: str) -> bool:
    head, body, sign = run.split(".")
    header = _object(head)
    return bool(header and isinstance(header.get("alg"), str) and _object(body) is not None and (sign or header["alg"].lower() == "none"))


def _elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill data[start:end] exactly."""
    out = []
    while start < end:
        if start + 2 > end:
            return None
        tag, n, at = data[start], data[start + 1], start + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        start = at + n
    return out


def is_der_key(data: bytes) -> bool:
    top = _elements(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30 or not (inner := _elements(data, *top[0][1:])):
        return False
    tags = [t for t, _, _ in inner]
    number = lambda k: int.from_bytes(data[inner[k][1] : inner[k][2]], "big")
    if tags[:9] == [0x02] * 9:  # PKCS#1 private key: modulus is about the product of the primes
        return number(0) in (0, 1) and number(1) == number(4) * number(5)
    if tags == [0x02, 0x02]:  # PKCS#1 public key
        return inner[0][2] - inner[0][1] >= 64 and number(1) % 2 == 1 and number(1) > 2
    if tags[:2] == [0x02, 0x04] and set(tags[2:]) <= {0xA0, 0xA1}:  # SEC1
        return number(0) == 1 and inner[1][2] - inner[1][1] in (20, 24, 28, 32, 48, 66)
    algorithm = lambda k: tags[k] == 0x30 and bool(e := _elements(data, *inner[k][1:])) and e[0][0] == 0x06
    if tags[:3] == [0x02, 0x30, 0x04]:  # PKCS#8
        return number(0) in (0, 1) and algorithm(1)
    return tags == [0x30, 0x03] and algorithm(0) and inner[1][2] > inner[1][1] and data[inner[1][1]] < 8  # subject public key


def is_openssh(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(field() is None for _ in range(3)) or not 1 <= (count := int.from_bytes(data[at : at + 4], "big")) <= 64:
        return False
    at += 4
    return all(field() for _ in range(count)) and bool(field()) and at == len(data)


def _key_size(flat: str, at: int) -> int:
    """Bytes of the structure that starts at symbol ``at`` as its own lengths say, 0 if there is none."""

    def number(start: int, n: int) -> int:
        first = at + start // 3 * 4
        data = (decode_base64(flat[first : first + 12]) or b"")[start % 3 :][:n]
        return int.from_bytes(data, "big") if len(data) == n else -1

    if flat[at] == "M":
        n = number(1, 1)
        if n < 128:
            return max(n + 2, 0)
        k = n & 0x7F
        return 2 + k + size if 1 <= k <= 4 and (size := number(2, k)) >= 0 else 0
    size = 15  # the magic, three fields, a count, as many public keys and the private part
    for _ in range(3):
        if (n := number(size, 4)) < 0:
            return 0
        size += 4 + n
    if not 1 <= (count := number(size, 4)) <= 64:
        return 0
    size += 4
    for _ in range(count + 1):
        if (n := number(size, 4)) < 0:
            return 0
        size += 4 + n
    return size


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """Keys in base64: from each possible start in a block of lines to the line where the structure ends."""
    for m in BASE64.finditer(text):
        breaks = [b.span() for b in BASE64_BREAK.finditer(text, m.start(), m.end())]
        begins, ends = [m.start(), *(b for _, b in breaks)], [*(a for a, _ in breaks), m.end()]
        lines = [text[b:e].rstrip("=") for b, e in zip(begins, ends)]
        flat, upto, done = "".join(lines), [0, *accumulate(map(len, lines))], m.start()
        for s in BASE64_START.finditer(text, m.start(), m.end()):
            line = bisect_right(begins, s.start()) - 1
            at = upto[line] + s.start() - begins[line]
            end = at - (-_key_size(flat, at) * 4 // 3)
            last = bisect_left(upto, end) - 1
            if s.start() < done or not at < end <= upto[-1] or upto[last + 1] != end or ends[last] - s.start() < 40:
                continue
            if (data := decode_base64(flat[at:end])) and (kind := "openssh" if is_openssh(data) else "der" if is_der_key(data) else ""):
                done = ends[last]
                yield s.start(), done, kind


def confirmed(text: str) -> list[tuple[int, int, str]]:
    out = []
    if ".e" in text:
        out += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_jwt(m[0])]
    if "M" in text or "b3Blbn" in text:
        out += blocks(text)
    if "30" in text:
        for m in HEX_CODE.finditer(text):
            if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
                out.append((m.start(), m.end(), "der"))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) by start, then kind as listed."""
    text = text or ""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(base_spans(text), key=order)
    return base, sorted(base + confirmed(text), key=order)


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for text in batch.column("text").to_pylist():
                    base, spans = scan(text)
                    kinds = [k for _, _, k in base]
                    rows.append((*map(kinds.count, BASE_KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(
        run, "doc_id BIGINT, n_assign BIGINT, n_access BIGINT, n_hex BIGINT, base_sha256 STRING, spans STRING"
    )
