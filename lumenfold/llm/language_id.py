"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased; everything but letters counts as a word boundary. Its
character 2-, 3- and 4-grams (boundaries included) are hashed into ``BUCKETS``
rows of an embedding table; the mean of the rows goes through a linear softmax.
Both are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows (``sample`` rows at most in expectation, dealt evenly over the
languages by a hash of the id, whole texts). A temperature is fitted on a fifth
of the sample, and the rejection threshold is the confidence that all but
``reject_rate`` of those rows reach. Inference multiplies the two tables once
and averages rows of the product, so its cost follows the characters.

Null texts and texts without a letter are ``und`` with score 0 and are rejected.
Without any labelled row every text is ``und``. Ties between languages go to the
first in sorted order. All languages among the labels are learned, however many;
the model grows by ``DIM`` numbers for each beyond ``DIM``. Rows are independent,
repeated ones are treated alike; a null ``doc_id`` is trained on and predicted
like others; an empty table gives an empty result. Extra columns stay as they
are, but columns named ``lang_pred``, ``lang_score`` and ``lang_rejected`` are
replaced. Whole texts are read, whatever their length; of an Arrow batch about
two million characters are Python objects at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

BUCKETS, DIM = 1 << 14, 16
_FOLD: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Code point -> lower-case letter or 0 (a boundary), built once per process."""
    if not _FOLD:
        table = np.zeros(0x110000, np.uint32)
        letters = [c for c in range(0x110000) if chr(c).isalpha()]
        table[letters] = [ord(low) if len(low := chr(c).lower()) == 1 else c for c in letters]
        _FOLD.append(table)
    return _FOLD[0]


def subwords(text: str) -> np.ndarray:
    """Bucket numbers of all character 2- to 4-grams of a text; empty if it has no letter."""
    c = _fold_table()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = c > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one boundary after each word
    keep[0] = letter.any()
    c = c[keep]
    if len(c) < 3:
        return np.empty(0, np.uint16)
    out, h = [], c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA77)
    out.append(h)
    for n in (3, 4):
        if len(c) >= n:
            h = (h[: len(c) - n + 1] ^ (h[: len(c) - n + 1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) ^ c[n - 1 :] * np.uint32(0x27D4EB2F)
            out.append(h + np.uint32(n))
    h = np.concatenate(out)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x45D9F3B)
    return (h >> np.uint32(18)).astype(np.uint16)


@dataclass
class LanguageModel:
    """``table`` times ``head`` gives logits; up to DIM languages the product is kept in ``table`` and ``head`` is None."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    head: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, mean: np.ndarray) -> np.ndarray:
        return (mean if self.head is None else mean @ self.head) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, confidence, rejected)."""
        b = subwords(text) if text else ()
        if not len(b) or not self.langs:
            return "und", 0.0, True
        p = softmax(self.logits(self.table[b].mean(axis=0, dtype=np.float64))[None, :] * self.temperature)[0]
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(counts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str], epochs: int = 6, rate: float = 4.0, reject_rate: float = 0.0005, seed: int = 7) -> LanguageModel:
    """Minibatch SGD over (buckets, weights) pairs, weights summing to 1."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    rows = np.flatnonzero(~held)

    def dense(pick: np.ndarray) -> np.ndarray:
        x = np.zeros((len(pick), BUCKETS), np.float32)
        for r, i in enumerate(pick):
            x[r, counts[i][0]] = counts[i][1]
        return x

    steps, total, size = 0, max(1, epochs * -(-len(rows) // 32)), 32
    for _ in range(epochs):
        rng.shuffle(rows)
        for start in range(0, len(rows), size):
            pick = rows[start : start + size]
            x = dense(pick)
            hidden = x @ emb
            g = softmax(hidden @ w + bias)
            g[np.arange(len(pick)), y[pick]] -= 1
            g /= len(pick)
            lr = rate * (1 - steps / total)
            back = g @ w.T
            w -= lr * (hidden.T @ g)
            bias -= lr * 0.1 * g.sum(axis=0)
            used = np.flatnonzero(x.any(axis=0))
            emb[used] -= lr * 50 * (x[:, used].T @ back)
            steps += 1
    few = len(langs) <= DIM
    model = LanguageModel(langs, (emb @ w).astype(np.float32) if few else emb, bias.astype(np.float64), None if few else w)
    check = np.flatnonzero(held) if held.any() else np.arange(len(y))
    z = np.array([model.logits((model.table[counts[i][0]] * counts[i][1].astype(np.float32)[:, None]).sum(axis=0)) for i in check])
    grid = 2.0 ** np.arange(-3, 4, 0.25)
    loss = [-np.log(np.maximum(softmax(z * t)[np.arange(len(check)), y[check]], 1e-9)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    conf = softmax(z * model.temperature).max(axis=1)
    model.threshold = float(min(0.5, np.quantile(conf, reject_rate))) * 0.99
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets (uint16) and their shares of the largest (float16) of each text, as bytes."""
    for whole in batches:
        for batch in slices(whole):
            b, w, keep = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if len(x := subwords(text or "")):
                    n = np.bincount(x, minlength=1)
                    at = np.flatnonzero(n)
                    b.append(at.astype(np.uint16).tobytes())
                    w.append((n[at] / n.max()).astype(np.float16).tobytes())
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(keep), batch.column("lang").take(keep), pa.array(b, pa.binary()), pa.array(w, pa.binary())],
                names=["doc_id", "lang", "b", "w"],
            )


def fit(docs: DataFrame, train_rows: Column, sample: int = 4000, seed: int = 7) -> LanguageModel:
    """Fit on about ``sample`` rows at most of those ``train_rows`` selects (columns doc_id, text, lang)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").where(train_rows & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    # a row for each language: its size goes with the number of languages, not with the corpus
    shares = spark.createDataFrame([(k, min(1.0, sample / len(counts) / n)) for k, n in counts.items()], "lang STRING, share DOUBLE")
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(shares), "lang").where(unit < F.col("share")).select("doc_id", "lang", "text")
    got = chosen.mapInArrow(_features, "doc_id BIGINT, lang STRING, b BINARY, w BINARY").toArrow()
    ids, names = got.column("doc_id").to_pylist(), got.column("lang").to_pylist()
    if not ids:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    # one array for all rows and views of it: no Python object for each feature on the driver, and nothing left of them after
    order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i], names[i])))
    langs = sorted(set(names))
    b, w = (_flat(got.column(c), kind) for c, kind in (("b", np.uint16), ("w", np.float16)))
    ends = np.concatenate([[0], np.cumsum([len(x.as_buffer()) // 2 for x in got.column("b")])])
    del got
    w = w.astype(np.float32)
    w /= np.repeat(np.add.reduceat(w, ends[:-1]), np.diff(ends))
    model = train([(b[ends[i] : ends[i + 1]], w[ends[i] : ends[i + 1]]) for i in order], np.array([langs.index(names[i]) for i in order]), langs, seed=seed)
    del b, w
    pa.default_memory_pool().release_unused()
    return model


def _flat(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The bytes of all rows of a binary column as one array."""
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (any columns) plus lang_pred, lang_score, lang_rejected for every whole text."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("p", pa.string()), ("s", pa.float64()), ("r", pa.bool_())])

    @F.arrow_udf("struct<p string, s double, r boolean>")
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for _, parts in texts_of(arrays):
            yield pa.array([dict(zip("psr", bc.value.predict(t))) for texts in parts for t in texts], kind)

    out = {"lang_pred": "p", "lang_score": "s", "lang_rejected": "r"}
    own = "_lumenfold_language"
    got = docs.select(*[c for c in docs.columns if c not in out], run(F.col("text")).alias(own))
    return got.withColumns({c: F.col(f"{own}.{k}") for c, k in out.items()}).drop(own)
