"""Personal data: base patterns, and spans of a linear-chain conditional random field.

Base kinds (leftmost, not overlapping per kind, failing matches dropped): email;
ip with parts of at most 255; card of 16 to 19 digits that pass Luhn; phone of 8
to 15 digits after a plus sign. They are always reported.

The field labels tokens (runs of letters, runs of digits, single other
characters) with O or begin/inside of the four kinds. Its features are word
shapes in a window of two tokens, spacing and a few cue words; it is trained by
gradient ascent on the likelihood of a small labelled table (``TABLE`` below,
filled by rule) and decoded by Viterbi over padded numpy batches. Tokens further
than ``REACH`` tokens from every digit run and ``@``, and in no unspaced run with
one, are O by definition (the features see two tokens to either side), so only
the stretches around those are decoded, each of them whole, and whole texts are
searched for them. A
decoded span is added if it overlaps no base span and has the kind's form: a
phone 8 to 15 digits in at least two groups, a card 13 to 19 digits passing
Luhn, an ip four parts up to 255, an email an ``@`` between letters.

Spans are code points, end exclusive. Null texts count as empty; texts without a
match have zero counts, empty spans and the digest of the empty string. Searches
are linear in the text. Rows are independent: repeated ones and ones without an
id are returned as often as they occur. An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

KINDS = ("email", "ip", "card", "phone")
#: Fixed values of the contract. The ip pattern starts at the start of a digit run only: from its middle it cannot
#: match where it fails from the start, and the search stays linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DIGITS = re.compile("[0-9]")
REACH = 4


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, found from each ``@`` outwards."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGITS.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
TAGS = ["O", *(f"{b}-{k}" for k in KINDS for b in "BI")]
CUES = {w: c for c, ws in {"tel": "tel phone call mobile cell fax ring", "mail": "mail email write", "card": "card visa credit", "ip": "ip host server addr"}.items() for w in ws.split()}

#: The labelled table: templates whose {kind} places carry the label. Each is filled several times by rule.
TABLE = """
call me at {phone} today
tel: {phone}
phone {phone}, ask for the office
reach us on {phone} or {phone}.
fax {phone} mobile {phone}
write to {email} please
mail: {email}, tel {phone}
contact {email} or call {phone}
<{email}>
card {card} valid until 12/27
pay with visa {card} now
my credit card is {card}.
the server {ip} is down
ip: {ip} port 8080
host {ip} and host {ip}
license version 2.0 and 4.0 of 2024
on 2024-03-15 at 10:30 the price was $1,299.50
order 48213 shipped 12 items of 300
see page 14, section 3.2.1, figure 7
between 1990 and 2005 about 1,200,000 people
id 20240115093000 status 200
total 12.50 + 7.25 = 19.75
numbers 3 14 15 92 65 35
chapter 12 verse 4-7, pages 100-120
follow @someone and @other for news
score 3-2 in 90 minutes, 45 000 seats
isbn 978-3-16-148410-0 second edition
code 0x1f4a99 build 7.1.302.4410
room 12-304-7 floor 3
temperature -5.5 to 10.2 at 14:05:59
""".strip().splitlines()


def _fill(rng: np.random.Generator, kind: str) -> str:
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda: "".join(rng.choice(list("abcdefghiklmnoprstu"), int(rng.integers(3, 8))))
    if kind == "email":
        return f"{name()}{['', '.' + name(), d(2)][rng.integers(3)]}@{name()}{['.com', '.example.org', '.de'][rng.integers(3)]}"
    if kind == "ip":
        return ".".join(map(str, rng.integers(1, 256, 4)))
    if kind == "card":
        stem = "4" + d(14)
        number = next(stem + str(c) for c in range(10) if luhn(stem + str(c)))
        sep = ["", " ", "-"][rng.integers(3)]
        return sep.join(number[i : i + 4] for i in range(0, 16, 4))
    form = int(rng.integers(6))
    a, b, c = str(rng.integers(200, 999)), str(rng.integers(200, 999)), d(4)
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+49 {a} {d(7)}", f"+44 20 {c} {d(4)}"][form]


def tokens(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text, start, len(text) if end is None else end)]


def shape(word: str) -> str:
    if word[0].isdigit():
        return f"d{min(len(word), 9)}"
    if word[0].isalpha():
        return CUES.get(word.lower()) or ("w" if word.islower() else "W")
    return word if word in "@.-()+/:,$%=#<>" else "?"


def features(text: str, toks: list[tuple[int, int]]) -> list[list[str]]:
    s = [shape(text[a:b]) for a, b in toks]
    gap = [i == 0 or toks[i - 1][1] < toks[i][0] for i in range(len(toks))] + [True]
    at = lambda i: s[i] if 0 <= i < len(s) else "_"
    space = lambda i: "s" if not 0 < i < len(s) or gap[i] else "j"
    return [
        [f"0{s[i]}", f"p{space(i)}{at(i - 1)}", f"n{space(i + 1)}{at(i + 1)}", f"q{at(i - 2)}{at(i - 1)}{s[i]}", f"m{s[i]}{at(i + 1)}{at(i + 2)}",
         f"c{space(i)}{at(i - 1)}{s[i]}{space(i + 1)}{at(i + 1)}", f"w{at(i - 2)}|{at(i + 2)}", f"r{at(i - 3)}{at(i - 2)}", f"t{at(i + 2)}{at(i + 3)}", "b"]
        for i in range(len(s))
    ]


class Field:
    """Linear-chain conditional random field with dense parameters."""

    def __init__(self, index: dict[str, int]):
        self.index = index
        self.w = np.zeros((len(index) + 1, len(TAGS)))  # the last row stands for unknown features
        self.t = np.zeros((len(TAGS), len(TAGS)))
        self.first = np.zeros(len(TAGS))
        bad = np.array([[b[0] == "I" and a[2:] != b[2:] for b in TAGS] for a in TAGS])
        self.bar = np.where(bad, -1e4, 0.0)
        self.bar_first = np.array([-1e4 if x[0] == "I" else 0.0 for x in TAGS])

    def emissions(self, seqs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids B x T x F, mask B x T, scores B x T x K)."""
        width, longest, unknown = len(seqs[0][0]), max(map(len, seqs)), len(self.index)
        ids = np.full((len(seqs), longest, width), unknown, np.int32)
        mask = np.zeros((len(seqs), longest), bool)
        for i, q in enumerate(seqs):
            ids[i, : len(q)] = [[self.index.get(f, unknown) for f in fs] for fs in q]
            mask[i, : len(q)] = True
        return ids, mask, self.w[ids].sum(axis=2)

    def viterbi(self, seqs: list[list[list[str]]]) -> list[np.ndarray]:
        """Best tags of each sequence, all sequences side by side."""
        _, mask, e = self.emissions(seqs)
        trans = self.t + self.bar
        best, back = e[:, 0] + self.first + self.bar_first, np.zeros(e.shape, np.int8)
        for k in range(1, e.shape[1]):
            cand = best[:, :, None] + trans[None]
            back[:, k] = cand.argmax(axis=1)
            best = np.where(mask[:, k, None], cand.max(axis=1) + e[:, k], best)
        last, lengths = best.argmax(axis=1), mask.sum(axis=1)
        out = np.zeros(mask.shape, np.int8)
        at = np.arange(len(seqs))
        tag = last
        for k in range(e.shape[1] - 1, -1, -1):
            ends = lengths - 1 == k
            tag = np.where(ends, last, tag)
            out[:, k] = tag
            tag = np.where(k <= lengths - 1, back[at, k, tag], tag)
        return [o[:n] for o, n in zip(out, lengths)]

    def fit(self, seqs: list[list[list[str]]], tags: list[np.ndarray], rounds: int = 150, rate: float = 0.15, l2: float = 0.002) -> None:
        """Full-batch gradient ascent (Adam) on the penalised log-likelihood by forward-backward."""
        ids, mask, _ = self.emissions(seqs)
        n, longest = mask.shape
        gold = np.zeros((n, longest, len(TAGS)))
        gold_t, gold_first = np.zeros_like(self.t), np.zeros_like(self.first)
        for i, y in enumerate(tags):
            gold[i, np.arange(len(y)), y] = 1
            np.add.at(gold_t, (y[:-1], y[1:]), 1)
            gold_first[y[0]] += 1
        params = [self.w, self.t, self.first]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

        def lse(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        for step in range(1, rounds + 1):
            e, trans = self.w[ids].sum(axis=2), self.t + self.bar
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0] + self.first + self.bar_first
            for k in range(1, longest):
                alpha[:, k] = np.where(mask[:, k, None], lse(alpha[:, k - 1, :, None] + trans, 1) + e[:, k], alpha[:, k - 1])
            for k in range(longest - 2, -1, -1):
                beta[:, k] = np.where(mask[:, k + 1, None], lse(trans[None] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2), beta[:, k + 1])
            z = lse(alpha[:, -1], 1)
            node = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * mask[:, :, None]
            grad_t = gold_t.copy()
            for k in range(1, longest):
                pair = alpha[:, k - 1, :, None] + trans + (e[:, k] + beta[:, k])[:, None, :] - z[:, None, None]
                grad_t -= (np.exp(np.minimum(pair, 0)) * mask[:, k, None, None]).sum(axis=0)
            diff = (gold - node) * mask[:, :, None]
            grad_w = np.zeros_like(self.w)
            for f in range(ids.shape[2]):
                for c in range(len(TAGS)):
                    grad_w[:, c] += np.bincount(ids[:, :, f].ravel(), diff[:, :, c].ravel(), len(self.w))
            grads = [grad_w / n - l2 * self.w, grad_t / n - l2 * self.t, (gold_first - node[:, 0].sum(axis=0)) / n - l2 * self.first]
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)


@lru_cache(maxsize=2)
def trained(fills: int = 8, seed: int = 3) -> Field:
    """The field fitted to the labelled table."""
    rng = np.random.default_rng(seed)
    seqs, tags = [], []
    for line in TABLE:
        for _ in range(fills):
            text, marks = "", []
            for piece in re.split(r"(\{\w+\})", line):
                if piece.startswith("{"):
                    value = _fill(rng, piece[1:-1])
                    marks.append((piece[1:-1], len(text), len(text) + len(value)))
                    text += value
                else:
                    text += piece
            toks = tokens(text)
            y = np.zeros(len(toks), np.int64)
            for kind, a, b in marks:
                inside = [i for i, (s, e) in enumerate(toks) if a <= s and e <= b]
                y[inside] = TAGS.index(f"I-{kind}")
                y[inside[0]] = TAGS.index(f"B-{kind}")
            seqs.append(features(text, toks))
            tags.append(y)
    index = {f: i for i, f in enumerate(sorted({f for q in seqs for fs in q for f in fs}))}
    field = Field(index)
    field.fit(seqs, tags)
    return field


TRIGGER = re.compile(r"[0-9]+|@")


def stretches(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token runs around digit runs and ``@``: REACH tokens to either side of each and the whole unspaced run that holds it, joined where they touch."""
    if not TRIGGER.search(text):
        return
    toks = tokens(text)
    starts = [a for a, _ in toks]
    left = right = 0  # the open stretch is toks[left:right]
    run = 0  # the end of the unspaced run looked at last
    for m in TRIGGER.finditer(text):
        i = bisect_right(starts, m.start()) - 1
        lo = i
        if i >= run:
            while lo > run and toks[lo - 1][1] == starts[lo]:
                lo -= 1
            run = i + 1
            while run < len(toks) and toks[run - 1][1] == starts[run]:
                run += 1
        lo = max(min(lo, i - REACH), 0)
        if lo > right:
            if right > left:
                yield toks[left:right]
            left = lo
        elif right == 0:
            left = 0
        right = max(right, run, min(i + REACH + 1, len(toks)))
    yield toks[left:right]


def _valid(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "phone":
        return 8 <= len(digits) <= 15 and len(re.findall("[0-9]+", value)) >= 2
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return bool(IP.fullmatch(value)) and all(_small(p) for p in value.split("."))
    return bool(re.fullmatch(r"[^\s@]*[^\W_][^\s@]*@[^\s@]*[^\W_]\.[^\s@]*[^\W_]", value))


def _batches(todo: list[tuple[int, list[tuple[int, int]]]], cells: int) -> Iterator[list[tuple[int, list[tuple[int, int]]]]]:
    """Stretches by length, as many at once as fill ``cells`` tokens when padded; one at least, whatever its length."""
    part: list[tuple[int, list[tuple[int, int]]]] = []
    for x in sorted(todo, key=lambda x: len(x[1])):
        if part and (len(part) + 1) * len(x[1]) > cells:
            yield part
            part = []
        part.append(x)
    if part:
        yield part


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], field: Field, cells: int = 20_000) -> list[list[tuple[str, int, int]]]:
    """Spans the field finds beside the base ones, for each text. Every stretch is decoded whole."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    todo: list[tuple[int, list[tuple[int, int]]]] = []
    waiting = 0

    def decode() -> None:
        for part in _batches(todo, cells):
            for (i, toks), tags in zip(part, field.viterbi([features(texts[i], toks) for i, toks in part])):
                k = 0
                while k < len(toks):
                    if TAGS[tags[k]][0] == "B":
                        kind, end = TAGS[tags[k]][2:], k + 1
                        while end < len(toks) and TAGS[tags[end]] == f"I-{kind}":
                            end += 1
                        a, b = toks[k][0], toks[end - 1][1]
                        if _valid(kind, texts[i][a:b]) and not any(a < y and x < b for _, x, y in base[i]):
                            out[i].append((kind, a, b))
                        k = end
                    else:
                        k += 1
        todo.clear()

    for i, text in enumerate(texts):
        for toks in stretches(text):
            todo.append((i, toks))
            waiting += len(toks)
        if waiting >= 4 * cells:
            decode()
            waiting = 0
    decode()
    return [sorted(set(x)) for x in out]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every whole text."""
    bc = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1_000_000):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                added = added_spans(texts, base, bc.value)
                rows = []
                for b, a in zip(base, added):
                    kinds = [k for k, _, _ in b]
                    rows.append((*map(kinds.count, KINDS), hashlib.sha256(written(b).encode()).hexdigest(), written(b + a)))
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(
        run, "doc_id BIGINT, n_email BIGINT, n_ip BIGINT, n_card BIGINT, n_phone BIGINT, base_sha256 STRING, spans STRING"
    )
