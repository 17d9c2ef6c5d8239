"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text gets the dummy space in front, spaces become the meta symbol, and an
agenda of adjacent symbol pairs is worked off by score, the leftmost pair first
among equal scores; stale entries are skipped. Characters that are no piece fall
back to their UTF-8 bytes. Where no piece joins a character to a following meta
symbol (checked when the vocabulary is loaded), merges cannot cross such a
point: a text is then cut there and each distinct chunk is worked out once per
bounded cache. Otherwise the whole text is one chunk. The agendas of all new
chunks of a batch are worked off side by side in numpy matrices; chunks longer
than ``LONG`` characters get a heap of their own.

``encode`` and ``decode`` follow the ``sentencepiece`` library for models with
the identity normalizer, a dummy prefix and untouched white space; ``Vocabulary``
refuses others. In every Arrow batch the library encodes and decodes a share of
the rows (``check_share``; those whose text hash falls into it, and the first
text of a batch where none does) and a difference stops the job; the other rows
are not compared.

Null texts count as empty; an empty text has no ids. Ties and repeated rows need
no rule: every row is encoded by itself. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

META = "▁"
#: Slots of the pair table; longest chunk that is merged in a matrix.
TABLE, LONG = 1 << 20, 48
EMPTY, NO_RANK = -1, 2**31 - 1
_LOADED: dict[str, Vocabulary] = {}


class Vocabulary:
    """Pieces and scores of a merge-type sentencepiece model file."""

    def __init__(self, path: str, cache_limit: int = 150_000):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        plain = [i for i in range(len(pieces)) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        if any(lib.is_unused(i) for i in plain) or lib.encode("a  b ") != lib.encode("a  b ", add_bos=False) or lib.decode(lib.encode(" a  b ")) != " a  b ":
            raise ValueError("only models with untouched white space and without unused pieces are supported")
        self.id = {pieces[i]: i for i in plain}
        self.score = {pieces[i]: lib.get_score(i) for i in plain}
        self.bytes = {int(pieces[i][1:-1], 16): i for i in range(len(pieces)) if lib.is_byte(i)}
        self.unk = lib.unk_id()
        self.text = {i: p for p, i in self.id.items()}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.splits = not any(META in p.lstrip(META) for p in self.id)
        self.chunk = re.compile(f"{META}*[^{META}]+|{META}+") if self.splits else re.compile("(?s).+")
        self.cache: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}
        self.limit = cache_limit
        self.plain_text = [self.text.get(i, "").replace(META, " ") for i in range(len(pieces))]
        self.char_id = -np.arange(1, 0x110001, dtype=np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        order = {x: r for r, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.table_key = np.full(TABLE, EMPTY, np.int64)
        self.table_piece = np.full(TABLE, -1, np.int32)
        self.table_rank = np.full(TABLE, NO_RANK, np.int32)
        for p, i in self.id.items():
            for k in range(1, len(p)):
                if (a := self.id.get(p[:k])) is not None and (b := self.id.get(p[k:])) is not None:
                    key = (a << 32) | b
                    slot = int(_slot(np.array([key]))[0])
                    while self.table_key[slot] != EMPTY:
                        slot = (slot + 1) & (TABLE - 1)
                    self.table_key[slot], self.table_piece[slot], self.table_rank[slot] = key, i, order[self.score[p]]

    def merge(self, chunk: str) -> list[str]:
        """Symbols of one chunk after all merges: the agenda as a heap, stale entries skipped."""
        sym: list[str | None] = list(chunk)
        n, score = len(sym), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(-s, i, pair) for i in range(n - 1) if (s := score.get(pair := chunk[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left = sym[i]
            if left is None or (j := after[i]) >= n or len(pair) != len(left) + len(sym[j]) or left + sym[j] != pair:
                continue
            sym[i], sym[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := score.get(new := pair + sym[k])) is not None:
                    heapq.heappush(agenda, (-s, i, new))
            if (h := before[i]) >= 0 and (s := score.get(new := sym[h] + pair)) is not None:
                heapq.heappush(agenda, (-s, h, new))
        return [s for s in sym if s is not None]

    def ids_of(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            if (i := self.id.get(s)) is not None:
                out.append(i)
            else:
                out.extend(self.fallback(s))
        return out

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unk]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece that a pair of symbols makes or -1, its rank) by open addressing."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = _slot(key)
        found = self.table_key[slot]
        piece, rank = self.table_piece[slot], self.table_rank[slot]
        todo = np.flatnonzero((found != key) & (found != EMPTY))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (TABLE - 1)
            k = self.table_key[slot[todo]]
            hit = k == key[todo]
            piece[todo[hit]] = self.table_piece[slot[todo[hit]]]
            rank[todo[hit]] = self.table_rank[slot[todo[hit]]]
            miss = k == EMPTY
            rank[todo[miss]] = NO_RANK
            todo = todo[~hit & ~miss]
        rank = np.where((found == EMPTY) | (left < 0) | (right < 0), NO_RANK, rank)
        return piece, rank

    def encode_many(self, chunks: list[str]) -> list[list[int]]:
        """Ids of many chunks. Chunks of one length share a matrix of symbols; each round merges the best pair of
        every row that has one, so all such rows lose one column."""
        out: list[list[int]] = [[] for _ in chunks]
        by_length: dict[int, list[int]] = {}
        for i, c in enumerate(chunks):
            if len(c) > LONG:
                out[i] = self.ids_of(self.merge(c))
            else:
                by_length.setdefault(len(c), []).append(i)
        for n, group in by_length.items():
            rows = np.array(group)
            codes = np.frombuffer("".join([chunks[i] for i in group]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(group), n)
            sym = self.char_id[codes]
            piece, rank = (x.reshape(len(group), n - 1) for x in self.lookup(sym[:, :-1].ravel(), sym[:, 1:].ravel()))
            while True:
                best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
                at = np.arange(len(rows))
                done = rank[at, best] == NO_RANK if rank.shape[1] else np.ones(len(rows), bool)
                for i, ids in zip(rows[done], sym[done].tolist()):
                    if min(ids) < 0:
                        ids = [x for s in ids for x in ((s,) if s >= 0 else self.fallback(chr(-s - 1)))]
                    out[i] = ids
                if done.all():
                    break
                rows, sym, piece, rank, best = rows[~done], sym[~done], piece[~done], rank[~done], best[~done]
                at = np.arange(len(rows))
                sym[at, best] = piece[at, best]
                cols = np.arange(sym.shape[1] - 1)[None, :]
                sym = np.take_along_axis(sym, cols + (cols > best[:, None]), 1)
                cols = cols[:, :-1]
                keep = cols + (cols >= best[:, None])
                piece, rank = np.take_along_axis(piece, keep, 1), np.take_along_axis(rank, keep, 1)
                for side in (best - 1, best):
                    ok = np.flatnonzero((side >= 0) & (side < sym.shape[1] - 1))
                    k = side[ok]
                    piece[ok, k], rank[ok, k] = self.lookup(sym[ok, k], sym[ok, k + 1])
        return out

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(META + text.replace(" ", META)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_many(self.chunks(text)) for i in ids]

    def pieces(self, ids: list[int]) -> str:
        """Text of ids without the removal of the dummy space."""
        out, run = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.text.get(i, " ⁇ " if i == self.unk else ""))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(META, " ")

    def decode(self, ids: list[int]) -> str:
        return self.pieces(ids).removeprefix(" ")

    def learn(self, chunks: set[str]) -> None:
        """Put chunks that neither generation of the cache holds into it, and move up those of the older one."""
        if len(self.cache) >= self.limit:
            self.old, self.cache = self.cache, {}
        new = []
        for c in chunks - self.cache.keys():
            if (got := self.old.get(c)) is not None:
                self.cache[c] = got
            else:
                new.append(c)
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            for c, ids in zip(part, self.encode_many(part)):
                back = "".join([self.plain_text[i] for i in ids]) if not self.byte_of.keys() & ids else self.pieces(ids)
                self.cache[c] = (",".join(map(str, ids)), len(ids), back)

    def encode_decode(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """(ids as text, number of ids, decoded text) of each text."""
        chunks = [self.chunks(t) for t in texts]
        self.learn(set().union(*chunks))
        for c in chunks:
            got = list(map(self.cache.__getitem__, c))
            yield ",".join([p[0] for p in got]), sum([p[1] for p in got]), "".join([p[2] for p in got]).removeprefix(" ")


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key * np.int64(0x9E3779B97F4A7C1 | 1)) >> np.int64(40)) & (TABLE - 1)


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def checked_rows(texts: list[str], share: int) -> list[bool]:
    """Rows of a batch that are held against the library: one text in ``share`` by its hash, and the first text where that has none."""
    out = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % share == 0 for t in texts]
    if texts and not any(c and t for c, t in zip(out, texts)):
        out[next((i for i, t in enumerate(texts) if t), 0)] = True
    return out


def encode_column(docs: DataFrame, model: str | None = None, check_share: int = 64, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text (and the ids as an array with ``with_ids``)."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model)
        for whole in batches:
            for batch in slices(whole, 1_000_000):
                n, a, b, all_ids = [], [], [], []
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for text, check, (ids, count, back) in zip(texts, checked_rows(texts, check_share), voc.encode_decode(texts)):
                    if check:
                        own = voc.library.encode(text)
                        if ids != ",".join(map(str, own)) or back != voc.library.decode(own):
                            raise ValueError(f"differs from the sentencepiece library on a text of {len(text)} characters")
                    n.append(count)
                    a.append(hashlib.sha256(ids.encode()).hexdigest())
                    b.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        all_ids.append([int(x) for x in ids.split(",")] if ids else [])
                cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id BIGINT, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING" + ", ids ARRAY<INT>" * with_ids
    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(run, schema)
