"""Substring dedup: removes each byte of a 50-byte string that starts in a document with a smaller id too.

The suffix structure is built column-wise for many strings at once
(``bwt_collection``), but not over whole documents: as many rounds as the longest
document has bytes, over one table of all bytes, is one sequential job of the
size of the corpus. Documents are cut first to the short strings that decide:

1. Minimizers: of the 31 20-byte strings in each 50-byte window the one with the
   least hash is an anchor, so equal windows share an anchor. All windows that
   hold an anchor lie in its context, 30 bytes before to 50 after.
2. Anchors are shuffled by hash and sorted. Where the whole context occurs in a
   smaller document, all of it is covered. Within a map batch this is settled
   before the shuffle: only a context's smallest document is sent on, so a
   passage in a third of all documents costs one row per batch. Where a batch
   holds many contexts of one anchor, they are dealt by context, not by hash.
3. Anchors with different contexts in several documents are left. Their contexts
   (80 bytes at most) are fetched, and the suffixes of all contexts of a batch of
   anchors are brought in order column by column; neighbours that share 50 bytes
   with one of a smaller document are covered. An anchor in more than ``HOT``
   contexts is dealt by the 50-byte windows of these instead, of which a task
   sends on those of its smallest document only.
4. Covered intervals are gathered by document and cut out.

Contexts are compared as 64-bit hashes in step 2, contexts and windows as bytes in step 3. Matches
never cross documents. Null texts count as empty; texts under 50 bytes lose
nothing. Rows that repeat a doc_id count as one document for the comparison and
each gets the cut of its own text only if the texts are equal, so ids should be
unique; a null doc_id is compared with nothing and kept whole. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt_collection import repeats
from .common import mix, save, slices

LENGTH, GRAM = 50, 20
#: Contexts of a gram within one map batch from which on they are dealt by context, as the batch itself shows them to be open.
MANY = 8
#: Open anchors of a gram beyond which its contexts are compared window by window.
HOT = 20_000
MARK = 1 << 40  # a position no text has
REACH = LENGTH - GRAM  # 30
_BASE = 0x9E3779B97F4A7C15 | 1
_UNIT = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Rolling:
    """Prefix hashes of a byte array: the hash of any substring in one step."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _UNIT, np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        self.down = down
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.down[start])


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for each i (shorter at the end)."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = op(out[:-step], out[step:].copy()) if len(out) > step else out[:-step]
        have += step
    return out


def anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document number, position, gram hash, context hash) of all anchors of concatenated documents."""
    if not len(data):
        z = np.empty(0, np.int64)
        return z, z, z.view(np.uint64), z.view(np.uint64)
    ends = np.cumsum(sizes)
    end = np.repeat(ends, sizes)
    start = np.repeat(ends - sizes, sizes)
    at = np.arange(len(data))
    roll = Rolling(data)
    gram = np.full(len(data), np.iinfo(np.uint64).max, np.uint64)
    fits = at + GRAM <= end
    gram[fits] = roll.of(at[fits], at[fits] + GRAM) >> np.uint64(1)
    least = _slide(gram, REACH + 1, np.minimum)
    least[at + LENGTH > end] = 0
    top = _slide(least[::-1], REACH + 1, np.maximum)[::-1]
    p = np.flatnonzero((top == gram) & fits)
    left, right = np.maximum(p - REACH, start[p]), np.minimum(p + LENGTH, end[p])
    context = mix(roll.of(left, right) ^ ((right - left).astype(np.uint64) << np.uint64(8)) ^ (p - left).astype(np.uint64))
    doc = np.searchsorted(ends, p, side="right")
    return doc, p - start[p], gram[p], context


def _encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64), raw


ANCHOR = "gram BIGINT, context BIGINT, doc BIGINT, pos BIGINT"


def _find(many: int):
    """Anchors with their gram (0 or more), those of the batch's smallest document for a context only.

    The others are covered already. They go along with a negative number drawn from document and position for a gram, so
    that the shuffle spreads them. A gram with ``many`` anchors left and two documents among them is open whatever else
    there is: its anchors are marked (complement of the position) to be dealt by context, and one row at position
    ``MARK`` tells the others of the gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2_000_000):
                data, sizes, _ = _encode(batch.column("text").to_pylist())
                number, pos, gram, context = anchors(data, sizes)
                if not len(pos):
                    continue
                doc = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[number]
                order = np.lexsort((pos, doc, context, gram))
                doc, pos, gram, context = doc[order], pos[order].astype(np.int64), gram[order], context[order]
                new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])])
                least = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
                own = np.flatnonzero(doc == least)
                new_gram = np.concatenate([[True], gram[own][1:] != gram[own][:-1]])
                heads = np.flatnonzero(new_gram)
                busy = np.diff(np.append(heads, len(own))) >= many
                busy &= np.minimum.reduceat(doc[own], heads) < np.maximum.reduceat(doc[own], heads)
                dealt, marks = own[busy[np.cumsum(new_gram) - 1]], own[heads[busy]]
                spread = ~(mix(doc.astype(np.uint64) * np.uint64(_BASE) + pos.astype(np.uint64)) >> np.uint64(1)).view(np.int64)
                key = np.where(doc > least, spread, gram.view(np.int64))
                pos[dealt] = ~pos[dealt]
                rows = np.concatenate([np.arange(len(doc)), marks])
                pos = np.concatenate([pos, np.full(len(marks), MARK)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[rows]), pa.array(context.view(np.int64)[rows]), pa.array(doc[rows]), pa.array(pos)], names=["gram", "context", "doc", "pos"]
                )

    return run


def _by_gram(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, list | np.ndarray]]:
    """Rows of sorted batches, cut only between grams."""
    carry: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if carry is None else pa.concat_tables([carry, table])
        gram = table.column("gram").to_numpy()
        if not len(gram):
            continue
        cut = int(np.searchsorted(gram, gram[-1]))
        carry = table.slice(cut)
        if cut:
            yield {c: table.column(c).slice(0, cut) for c in names}
    if carry is not None and carry.num_rows:
        yield {c: carry.column(c) for c in names}


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, context, doc -> covered anchors (gram null) and anchors whose contexts must be compared.

    A gram is open if it has contexts in two documents or a mark. Between batches only the state of the last gram is kept:
    its last context with that one's least document, the range of these, and, until it is open, the anchors of the one document.
    """
    state: tuple[int, int, int, int, int, bool] | None = None  # gram, context, least, lo, hi, marked
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, context, doc, pos = (batch.column(c).to_numpy() for c in ("gram", "context", "doc", "pos"))
        goes_on = state is not None and state[0] == gram[0]
        new_gram = np.concatenate([[not goes_on], gram[1:] != gram[:-1]])
        new = new_gram | np.concatenate([[not goes_on or state[1] != context[0]], context[1:] != context[:-1]])
        run = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
        least = np.where(run >= 0, doc[run], state[2] if goes_on else 0)
        first = new_gram.copy()
        first[0] = True
        heads, group = np.flatnonzero(first), np.cumsum(first) - 1
        lo, hi, marked = np.minimum.reduceat(least, heads), np.maximum.reduceat(least, heads), np.maximum.reduceat(pos, heads) == MARK
        if goes_on:
            lo[0], hi[0], marked[0] = min(lo[0], state[3]), max(hi[0], state[4]), marked[0] or state[5]
        open_gram = (lo < hi) | marked
        covered = (doc > least) | (gram < 0)
        open_ = ~covered & ((pos < 0) | open_gram[group])
        place = np.where(pos < 0, ~pos, pos)
        if goes_on and open_gram[0]:
            for d, p, g in held:
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(p), pa.array(g)], names=["doc", "pos", "gram"])
        if not goes_on or open_gram[0] or len(heads) > 1:
            held = []
        wait = np.flatnonzero(~covered & ~open_ & (group == group[-1]))
        if len(wait):
            held.append((doc[wait], place[wait], gram[wait]))
        state = (int(gram[-1]), int(context[-1]), int(least[-1]), int(lo[-1]), int(hi[-1]), bool(marked[-1]))
        keep = np.flatnonzero((covered | open_) & (pos != MARK))
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[keep]), pa.array(place[keep]), pa.array(gram[keep], mask=covered[keep])], names=["doc", "pos", "gram"]
        )


class Windows:
    """The windows of contexts of hot grams: what a smaller document of this task has too is covered, the rest is a row for each window.

    A window that many documents share costs a row for each task (and each time ``limit`` windows are known).
    """

    def __init__(self, limit: int = 100_000):
        self.limit, self.least = limit, {}

    def rows(self, doc: int, raw: bytes, starts: list[int]) -> Iterator[tuple[int, int, int, int, bytes]]:
        run: list[int] = []
        for w in starts:
            window = raw[w : w + LENGTH]
            if len(self.least) >= self.limit:
                self.least.clear()
            if self.least.setdefault(window, doc) < doc:
                if run and run[1] + 1 == w:
                    run[1] = w
                else:
                    if run:
                        yield self.covered(doc, *run)
                    run = [w, w]
            else:
                self.least[window] = doc
                yield xxhash.xxh3_64_intdigest(window) >> 1, doc, w, REACH // 2, window
        if run:
            yield self.covered(doc, *run)

    @staticmethod
    def covered(doc: int, a: int, b: int) -> tuple[int, int, int, int, bytes]:
        return ~(xxhash.xxh3_64_intdigest(b"%d %d" % (doc, a)) >> 1), doc, a, b + LENGTH - a, b""


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of open anchors by gram; of hot grams, windows by their hash, and covered intervals (negative gram, length in ``off``)."""
    windows = Windows()
    for whole in batches:
        for batch in slices(whole, 4_000_000):
            cols: list[list] = [[], [], [], [], []]
            for doc, text, marks in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "marks"))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                starts: set[int] = set()
                for m in marks:
                    left = max(0, m["pos"] - REACH)
                    if m["hot"]:
                        starts.update(range(left, min(m["pos"], len(raw) - LENGTH) + 1))
                        continue
                    for c, v in zip(cols, (m["gram"], doc, left, m["pos"] - left, raw[left : m["pos"] + LENGTH])):
                        c.append(v)
                for row in windows.rows(doc, raw, sorted(starts)):
                    for c, v in zip(cols, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["gram", "doc", "left", "off", "bytes"])


def _alike(gram: list[int], doc: list[int], off: list[int], strings: list[bytes]) -> list[tuple[int, int, int]]:
    """(row, start, end) of the parts of contexts that can hold a shared 50-byte string.

    A shared string around a 20-byte anchor has 15 bytes or more on one side of it. Where no other document has the same
    15 bytes there, it has fewer on that side, and the context is cut to 14.
    """
    half = REACH // 2
    seen: dict[tuple, int] = {}
    shared: set[tuple] = set()
    keys = []
    for g, d, o, s in zip(gram, doc, off, strings):
        own = ((g, 0, s[o - half : o]) if o >= half else None, (g, 1, s[o + GRAM : o + GRAM + half]) if len(s) >= o + GRAM + half else None)
        keys.append(own)
        for k in own:
            if k is not None and seen.setdefault(k, d) != d:
                shared.add(k)
    out = []
    for i, (before, after) in enumerate(keys):
        a = 0 if before in shared else max(0, off[i] - half + 1)
        b = len(strings[i]) if after in shared else min(len(strings[i]), off[i] + GRAM + half - 1)
        if (before in shared or after in shared) and b - a >= LENGTH:
            out.append((i, a, b))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by gram -> covered intervals."""
    for part in _by_gram(batches, ["gram", "doc", "left", "off", "bytes"]):
        if done := int(np.searchsorted(part["gram"].to_numpy(), 0)):
            doc, left, size = (part[c].slice(0, done).to_numpy() for c in ("doc", "left", "off"))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(left), pa.array(left + size)], names=["doc", "a", "b"])
            part = {c: column.slice(done) for c, column in part.items()}
        strings = part["bytes"].to_pylist()
        alike = _alike(part["gram"].to_pylist(), part["doc"].to_pylist(), part["off"].to_pylist(), strings)
        if not alike:
            continue
        rows = [i for i, _, _ in alike]
        gram, doc, left = (part[c].to_numpy()[rows] for c in ("gram", "doc", "left"))
        left = left + np.array([a for _, a, _ in alike])
        strings = [strings[i][a:b] for i, a, b in alike]
        step = 8_000
        cuts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1], [True]]))
        bounds = [0]
        for a, b in zip(cuts, cuts[1:]):
            if b - bounds[-1] > step and a > bounds[-1]:
                bounds.append(int(a))
        bounds.append(len(gram))
        for a, b in zip(bounds, bounds[1:]):
            s, offset = repeats(strings[a:b], doc[a:b], LENGTH)
            begin = left[a:b][s] + offset
            # one interval for each run of windows of a context
            order = np.lexsort((begin, s))
            s, begin = s[order], begin[order]
            head = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (begin[1:] != begin[:-1] + 1)])) if len(s) else np.zeros(0, int)
            tail = np.append(head[1:], len(s)) - 1 if len(s) else head
            yield pa.RecordBatch.from_arrays([pa.array(doc[a:b][s[head]]), pa.array(begin[head]), pa.array(begin[tail] + LENGTH)], names=["doc", "a", "b"])


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(bytes outside the spans, number of maximal removed runs)."""
    out, at, runs, end = [], 0, 0, -1
    for a, b in sorted(spans):
        a, b = max(0, a), min(b, len(raw))
        if b <= a:
            continue
        if a > end:
            runs += 1
            out.append(raw[at:a])
        at = end = max(end, b)
    out.append(raw[at:])
    return b"".join(out), runs


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 4_000_000):
                rows, kept_text = [], []
                for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    kept, runs = cut_out(raw, [(s["a"], s["b"]) for s in spans or ()])
                    rows.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
                    kept_text.append(kept)
                cols = list(zip(*rows)) or [()] * 4
                arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    arrays.append(pa.array(kept_text, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def covered_spans(docs: DataFrame, many: int = MANY, hot: int = HOT) -> tuple[DataFrame, list[str]]:
    """(doc, a, b) intervals to remove, and the scratch tables they are read from."""
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL AND octet_length(text) >= 50")
    found = docs.mapInArrow(_find(many), ANCHOR)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    settled = (
        found.repartition(n, F.when(F.col("pos") < 0, F.xxhash64("gram", "context")).otherwise(F.col("gram"))).sortWithinPartitions("gram", "context", "doc")
        .mapInArrow(_settle, "doc BIGINT, pos BIGINT, gram BIGINT")
    )
    settled, settled_path = save(settled, "anchors")
    open_ = settled.where("gram IS NOT NULL")
    busy, busy_path = save(open_.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("gram", F.lit(True).alias("hot")), "hot-grams")
    flagged = open_.join(busy, "gram", "left").select("doc", F.struct("pos", "gram", F.coalesce("hot", F.lit(False)).alias("hot")).alias("mark"))
    marks = flagged.groupBy("doc").agg(F.collect_list("mark").alias("marks"))
    contexts = (
        docs.withColumnRenamed("doc_id", "doc").join(marks, "doc").select("doc", "text", "marks")
        .mapInArrow(_contexts, "gram BIGINT, doc BIGINT, left BIGINT, off BIGINT, bytes BINARY")
        .repartition(n, "gram").sortWithinPartitions("gram")
        .mapInArrow(_compare, "doc BIGINT, a BIGINT, b BIGINT")
    )
    compared, compared_path = save(contexts, "compared")
    whole = settled.where("gram IS NULL").select("doc", (F.col("pos") - REACH).alias("a"), (F.col("pos") + LENGTH).alias("b"))
    return whole.union(compared), [settled_path, busy_path, compared_path]


def remove_repeats(docs: DataFrame, with_text: bool = False, many: int = MANY, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document (and the bytes kept, ``with_text``)."""
    docs = docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text")
    spark = docs.sparkSession
    # of equal texts the smallest id stands for all; the others lose everything that 50 bytes can cover
    same = docs.where("doc_id IS NOT NULL AND octet_length(text) >= 50").select("doc_id", F.md5("text").alias("key"), F.sha1("text").alias("key2"))
    first = same.groupBy("key", "key2").agg(F.min("doc_id").alias("first"))
    copies, copies_path = save(same.join(first, ["key", "key2"]).where("doc_id > first").select("doc_id").distinct(), "copies")
    originals = docs.join(copies, "doc_id", "left_anti")
    spans, _ = covered_spans(originals, many, hot)
    joined = spans.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    gone = copies.select(F.col("doc_id").alias("doc"), F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(2**40).cast("bigint").alias("b"))).alias("spans"))
    all_spans, _ = save(joined.union(gone), "spans")
    return docs.join(all_spans, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans").mapInArrow(
        _cut(with_text), "doc_id BIGINT, n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, kept_sha256 STRING" + ", kept BINARY" * with_text
    )
