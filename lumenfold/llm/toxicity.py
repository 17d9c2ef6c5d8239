"""Toxicity: a convolutional text classifier in numpy, thresholds calibrated by language.

Words (runs of letters, lower-cased) are embedded as the scaled sum of hashed rows
for the word and its prefixes of 4 to 6 letters. Filters of width 1, 2 and 3 run over
the whole sequence, are max-pooled with ReLU and feed a logistic unit. Training
is Adagrad over minibatches in numpy; with max pooling only the winning
positions carry gradient. A filter's response is a sum of one term per word, so
scoring looks the terms of each distinct word up and adds shifted columns.

Fitting reads every labelled row that may be learned from, as a whole text. Up to
about ``positives`` and ``negatives`` rows are trained on in the driver. Of more
rows that many, dealt by a hash of the id, give a start, and workers then go
``ROUNDS`` times over all rows, each from the same model over its own rows;
their models are averaged by number of rows, in two steps so that the driver gets
one. A fifth of all rows is not trained on but calibrates a threshold for
each language, guessed from function words of the text alone, and for texts of
no known language; the logit is shifted by it, so a score of 0.5 or more means
label 1. Languages with fewer than 20 of these rows of either label share the
overall threshold. Logit, label and language of the fifth come to the driver.

Null and empty texts, and texts without letters, are scored by the bias alone.
Without labels of both kinds every score is 0. Repeated labels of one document
count as separate rows; repeated documents are scored alike; rows whose id is
null are not trained on but scored like others. Rows are independent; an empty
table gives an empty result. Extra columns stay as they are, but a column named
``toxicity`` is replaced by the score. Whole texts are scored, whatever their
length; of an Arrow batch about two million characters are Python objects at
once.
"""

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, slices, texts_of

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 12, (1, 2, 3)
PREFIXES = (4, 5, 6)
ROUNDS = 1
#: Labelled rows up to which the join with the texts is by broadcast.
BROADCAST_ROWS = 2_000_000
SCALE = 0.5
WORD = re.compile(r"[^\W\d_]+")
#: Frequent function words, from which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for are with this".split(),
    "de": "der die und das ist den mit auf ein eine nicht zu von".split(),
    "fr": "le la les et des est une dans que pour qui sur du".split(),
    "es": "el los las de y que en una por con para del se".split(),
}
_GUESS = {w: [lang for lang, ws in FUNCTION_WORDS.items() if w in ws] for ws in FUNCTION_WORDS.values() for w in ws}


def guess_language(words: list[str]) -> str:
    """Language with most function words, or ``other``; ties go to the first listed."""
    n = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in words:
        for lang in _GUESS.get(w, ()):
            n[lang] += 1
    best = max(n, key=n.get)
    return best if n[best] else "other"


def buckets(word: str) -> list[int]:
    """Rows of the embedding table that a word is the sum of; short words repeat the word's own."""
    own = xxhash.xxh32_intdigest(word) % BUCKETS
    return [own, *(xxhash.xxh32_intdigest(word[:n], seed=n) % BUCKETS if len(word) >= n else own for n in PREFIXES)]


@dataclass
class ToxicityModel:
    emb: np.ndarray
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    shift: np.ndarray  # biases of the filters
    out: np.ndarray
    bias: float
    threshold: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    usable: bool = True
    squares: list[np.ndarray] = field(default_factory=list)  # Adagrad's sums, while it is fitted

    def arrays(self) -> list[np.ndarray]:
        """What is learned, with Adagrad's sums; ``put`` takes it back."""
        return [self.emb, *self.filters, self.shift, self.out, np.array([self.bias]), *self.squares]

    def put(self, arrays: list[np.ndarray]) -> None:
        n = 1 + len(self.filters)
        self.emb, self.filters = arrays[0].astype(np.float32), [f.astype(np.float32) for f in arrays[1:n]]
        self.shift, self.out, self.bias = arrays[n].astype(np.float32), arrays[n + 1].astype(np.float32), float(arrays[n + 2][0])
        self.squares = [np.array(a, float) for a in arrays[n + 3 :]]

    def terms(self, words: list[str]) -> np.ndarray:
        """Terms of words: one row each, FILTERS columns for each width and offset."""
        rows = np.array([buckets(w) for w in words], np.int64).reshape(len(words), -1)
        v = self.emb[rows].sum(axis=1) * SCALE
        return np.concatenate([v @ f[k] for f in self.filters for k in range(len(f))], axis=1).astype(np.float32)

    def pooled(self, terms: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Max-pooled responses of a sequence of rows of ``terms``."""
        got, col = [], 0
        for w in WIDTHS:
            n = len(ids) - w + 1
            if n <= 0:
                got.append(np.zeros(FILTERS, np.float32))
            else:
                top = np.full(FILTERS, -np.inf, np.float32)
                for start in range(0, n, 8192):
                    stop = min(n, start + 8192)
                    r = terms[ids[start:stop], col : col + FILTERS]
                    for k in range(1, w):
                        r = r + terms[ids[start + k : stop + k], col + k * FILTERS : col + (k + 1) * FILTERS]
                    np.maximum(top, r.max(axis=0), out=top)
                got.append(top)
            col += w * FILTERS
        return np.maximum(np.concatenate(got) + self.shift, 0)

    def logit(self, pooled: np.ndarray) -> float:
        return float(pooled @ self.out + self.bias)

    def score(self, logit: float, lang: str) -> float:
        if not self.usable:
            return 0.0
        z = self.slope * (logit - self.threshold.get(lang, self.threshold.get("", 0.0)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[list[str]], y: np.ndarray, weight: np.ndarray, epochs: int = 16, rate: float = 0.1, seed: int = 5, steps: int = 1500) -> ToxicityModel:
    """Fit on word lists, calibrate on every fifth of them. ``weight``: rows of the corpus that a row stands for."""
    rng = np.random.default_rng(seed)
    n_out = FILTERS * len(WIDTHS)
    model = ToxicityModel(
        rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 0.4 / w, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.full(n_out, 0.05, np.float32), rng.normal(0, 0.5, n_out).astype(np.float32), 0.0,
    )
    if len(set(y.tolist())) < 2:
        model.usable = False
        return model
    ids, rows = _numbered(texts)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    fit = np.flatnonzero(~held)
    model.squares = [np.full(BUCKETS, 1e-3), *(np.full(f.shape, 1e-3) for f in model.filters), np.full(n_out, 1e-3), np.full(n_out, 1e-3), np.full(1, 1e-3)]
    balance = len(fit) / (2 * np.maximum(np.bincount(y[fit], minlength=2), 1))
    for _ in range(max(epochs, min(40, -(-steps * 16 // max(len(fit), 1))))):  # few rows are seen more often
        rng.shuffle(fit)
        descend(model, ids, rows, y, fit, balance, rate)
    model.emb = model.emb.astype(np.float32)
    check = np.flatnonzero(held) if held.any() else np.arange(len(y))
    terms = model.terms(list(dict.fromkeys(w for t in texts for w in t))) if len(rows) else np.zeros((1, FILTERS * sum(WIDTHS)), np.float32)
    z = np.array([model.logit(model.pooled(terms, ids[i])) for i in check])
    calibrate(model, z, y[check], weight[check], np.array([guess_language(texts[i]) for i in check]))
    return model


def calibrate(model: ToxicityModel, z: np.ndarray, y: np.ndarray, weight: np.ndarray, lang: np.ndarray) -> None:
    model.threshold = {"": best_threshold(z, y, weight)}
    for name in sorted(set(lang.tolist())):
        here = lang == name
        if min(y[here].sum(), (1 - y[here]).sum()) >= 20:
            model.threshold[name] = best_threshold(z[here], y[here], weight[here])
    spread = np.quantile(np.abs(z - model.threshold[""]), 0.5)
    model.slope = float(1 / max(spread, 1e-3) * 3)


def descend(model: ToxicityModel, ids: list[np.ndarray], rows: np.ndarray, y: np.ndarray, fit: np.ndarray, balance: np.ndarray, rate: float = 0.1) -> None:
    """One pass of Adagrad over ``fit`` in minibatches of 16; ``rows``: embedding rows of each word number."""
    n_out = FILTERS * len(WIDTHS)
    g_emb, *g_f, g_out, g_shift, g_bias = model.squares
    for start in range(0, len(fit), 16):
        pick = fit[start : start + 16]
        uniq, inv = np.unique(np.concatenate([ids[i] for i in pick]) if sum(len(ids[i]) for i in pick) else np.zeros(1, np.int64), return_inverse=True)
        v = model.emb[rows[uniq]].sum(axis=1) * SCALE
        d_v = np.zeros_like(v)
        d_f = [np.zeros_like(f) for f in model.filters]
        d_out, d_shift, d_bias, at = np.zeros(n_out), np.zeros(n_out), 0.0, 0
        terms = [[v @ f[k] for k in range(len(f))] for f in model.filters]
        for i in pick:
            seq = inv[at : at + len(ids[i])]
            at += len(ids[i])
            pooled, won = np.zeros(n_out, np.float32), np.full(n_out, -1)
            for q, w in enumerate(WIDTHS):
                if len(seq) >= w:
                    r = sum(terms[q][k][seq[k : len(seq) - w + 1 + k]] for k in range(w))
                    part = slice(q * FILTERS, (q + 1) * FILTERS)
                    won[part] = r.argmax(axis=0)
                    pooled[part] = r.max(axis=0)
            act = np.maximum(pooled + model.shift, 0) * (won >= 0)
            p = 1 / (1 + np.exp(-np.clip(act @ model.out + model.bias, -30, 30)))
            g = (p - y[i]) * balance[y[i]] / len(pick)
            d_out += g * act
            d_bias += g
            d_act = g * model.out * (act > 0)
            d_shift += d_act
            for q, w in enumerate(WIDTHS):
                on = np.flatnonzero(d_act[q * FILTERS : (q + 1) * FILTERS])
                if len(on):
                    d, top = d_act[q * FILTERS + on], won[q * FILTERS + on]
                    for k in range(w):
                        word = seq[top + k]
                        d_f[q][k][:, on] += (v[word] * d[:, None]).T
                        np.add.at(d_v, word, (model.filters[q][k][:, on] * d).T)
        used = np.flatnonzero(np.abs(d_v).sum(axis=1))
        if len(used):
            flat = rows[uniq[used]].ravel()
            touched, back = np.unique(flat, return_inverse=True)
            g_rows = np.zeros((len(touched), DIM))
            np.add.at(g_rows, back, np.repeat(d_v[used] * SCALE, rows.shape[1], axis=0))
            g_emb[touched] += (g_rows**2).mean(axis=1)
            model.emb[touched] -= rate * 2 * g_rows / np.sqrt(g_emb[touched])[:, None]
        for f, d, s in zip(model.filters, d_f, g_f):
            s += d * d
            f -= rate * d / np.sqrt(s)
        g_out += d_out**2
        g_shift += d_shift**2
        g_bias += d_bias**2
        model.out -= (rate * d_out / np.sqrt(g_out)).astype(np.float32)
        model.shift -= (rate * d_shift / np.sqrt(g_shift)).astype(np.float32)
        model.bias -= float(rate * d_bias / np.sqrt(g_bias[0]))
    model.emb = model.emb.astype(np.float32)


def best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Midpoint between neighbouring logits with the least weighted error; among equals the middle one of the widest gap."""
    order = np.argsort(z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    wrong = np.concatenate([[0], np.cumsum(weight * y)]) + (weight * (1 - y)).sum() - np.concatenate([[0], np.cumsum(weight * (1 - y))])
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    gap = np.diff(edges)
    wrong = np.where(gap > 1e-9, wrong, np.inf)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    k = best[np.argmax(gap[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _numbered(texts: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Texts as word numbers, and the embedding rows of each number."""
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in t], np.int64) for t in texts]
    return ids, np.array([buckets(w) for w in vocab], np.int64).reshape(len(vocab), -1)


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (number of rows, learned arrays) added up to one: the mean weighted by rows."""
    total, sums = 0, None
    for batch in batches:
        for n, packed in zip(batch.column("n").to_pylist(), batch.column("model").to_pylist()):
            arrays = [a * float(n) for a in pickle.loads(packed)]
            total, sums = total + n, arrays if sums is None else [s + a for s, a in zip(sums, arrays)]
    if total:
        yield _packed(total, [(s / total).astype(np.float32) for s in sums])


def _packed(n: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([pickle.dumps(arrays)], pa.binary())], names=["n", "model"])


def one_round(rows: DataFrame, model: ToxicityModel, balance: np.ndarray, seed: int) -> None:
    """A pass over all ``rows`` (text, toxic): each task from ``model`` over its own, the results averaged."""
    bc = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, rng = pickle.loads(pickle.dumps(bc.value)), 0, np.random.default_rng(seed)
        for whole in batches:
            for batch in slices(whole):
                ids, words = _numbered([words_of(t) for t in batch.column("text").to_pylist()])
                y = batch.column("toxic").to_numpy()
                if len(words):
                    descend(own, ids, words, y, rng.permutation(len(y)), balance)
                n += len(y)
        if n:
            yield _packed(n, [a.astype(np.float32) for a in own.arrays()])

    kind = "n BIGINT, model BINARY"
    parts = rows.select("text", "toxic").mapInArrow(run, kind)
    groups = max(1, int(np.sqrt(rows.rdd.getNumPartitions())))
    for n, packed in parts.repartition(groups).mapInArrow(_averaged, kind).repartition(1).mapInArrow(_averaged, kind).collect():
        model.put(pickle.loads(packed))
    bc.unpersist()


def _logits(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """z, toxic, lang of every row."""
    bc = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bc.value
        for whole in batches:
            for batch in slices(whole):
                texts = [words_of(t) for t in batch.column("text").to_pylist()]
                vocab = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
                terms = m.terms(list(vocab)) if vocab else np.zeros((1, FILTERS * sum(WIDTHS)), np.float32)
                z = [m.logit(m.pooled(terms, np.fromiter((vocab[w] for w in t), np.int64, len(t)))) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), batch.column("toxic"), pa.array([guess_language(t) for t in texts])], names=["z", "toxic", "lang"])

    return rows.select("text", "toxic").mapInArrow(run, "z DOUBLE, toxic INT, lang STRING")


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, positives: int = 1500, negatives: int = 3000, seed: int = 5) -> ToxicityModel:
    """Fit on all labelled documents; ``train_rows`` is a condition on ``doc_id``. The two numbers bound what the driver trains on."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(train_rows).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    many = counts.get(1, 0) > positives or counts.get(0, 0) > negatives
    marked = F.broadcast(marked) if sum(counts.values()) <= BROADCAST_ROWS else marked
    known = docs.select("doc_id", "text").join(marked, "doc_id")
    rest = None
    if many:
        known, _ = save(known, "toxic-rows")
        apart = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(5)) == 4
        rest, held = known.where(~apart), known.where(apart)
        counts = {r["toxic"]: r["count"] for r in rest.groupBy("toxic").count().collect()}
        unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        share = {k: min(1.0, most / max(counts.get(k, 0), 1)) for k, most in ((1, positives), (0, negatives))}
        known = rest.where(unit < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    got = known.toArrow().to_pylist()
    got.sort(key=lambda r: (xxhash.xxh32_intdigest(str(r["doc_id"])), r["doc_id"], r["toxic"]))
    y = np.array([r["toxic"] for r in got], np.int64)
    model = train([words_of(r["text"]) for r in got], y, np.ones(len(y)))
    if many and model.usable:
        balance = sum(counts.values()) / (2 * np.array([max(counts.get(k, 0), 1) for k in (0, 1)]))
        for k in range(ROUNDS):
            one_round(rest, model, balance, seed + k)
        model.squares = []
        all_held = _logits(held, model).toArrow()
        if len(all_held):
            z, y = all_held["z"].to_numpy(), all_held["toxic"].to_numpy().astype(np.int64)
            calibrate(model, z, y, np.ones(len(y)), all_held["lang"].to_numpy())
    model.squares = []
    return model


def score_column(docs: DataFrame, model: ToxicityModel, limit: int = 150_000) -> DataFrame:
    """``docs`` (any columns) plus toxicity (0 to 1) of every whole text."""
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def scores(m: ToxicityModel, seen: dict[str, int], held: list[np.ndarray], texts: list[str | None]) -> Iterator[float]:
        for text in texts:
            words = words_of(text)
            if len(seen) > limit:
                seen.clear()
            if new := [w for w in dict.fromkeys(words) if w not in seen]:
                first = len(seen)
                seen.update(zip(new, range(first, first + len(new))))
                if len(seen) > len(held[0]):
                    held[0] = np.concatenate([held[0], np.zeros((max(len(held[0]), len(seen) - len(held[0])), held[0].shape[1]), np.float32)])
                held[0][first : len(seen)] = m.terms(new)
            ids = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
            yield m.score(m.logit(m.pooled(held[0], ids)), guess_language(words))

    @F.arrow_udf("double")
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: dict[str, int] = {}
        held = [np.zeros((1024, FILTERS * sum(WIDTHS)), np.float32)]
        for _, parts in texts_of(arrays):
            yield pa.array([x for texts in parts for x in scores(bc.value, seen, held, texts)], pa.float64())

    return docs.withColumn("toxicity", run(F.col("text")))
