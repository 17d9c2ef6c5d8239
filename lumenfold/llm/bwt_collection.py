"""Column-wise construction of the Burrows-Wheeler transform of a string collection.

One symbol of every string is inserted in each round, from the last to the
first. The table of rows (one for each suffix so far, in sorted order, with the
symbol in front of it) after a round is the empty suffixes followed by the old
rows dealt stably by the symbol in front of them: a suffix ``c + s`` stands among
those that start with ``c`` where ``s`` stands among those preceded by ``c``. A
round is therefore one sequential pass over the table that appends to one bucket
for each symbol. Tables of more than ``memory_rows`` rows are kept in files that
are only read and appended in sequence, below ``folder`` where one is given (a
folder that outlives the executor) and as buffers otherwise; no temporary folder
of the machine is used.

When all symbols are in, neighbouring suffixes are compared for the length asked
for. (Carrying the common prefixes through every round gives the same result,
but needs a range minimum for each row and round; measured, it took four times
the time of everything else here.)
"""

from __future__ import annotations

import os
import shutil
import uuid

import numpy as np

END = 0  # stands in front of whole strings; byte b is symbol b + 1


def suffix_table(strings: list[bytes], memory_rows: int = 4_000_000, chunk_rows: int = 1_000_000, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(string, length) of all non-empty suffixes in sorted order; equal suffixes stay in string order."""
    if not strings:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    sizes = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8)
    # a row is its suffix's place in ``front``: the symbols of each string from its end, then END
    bases = np.cumsum(sizes + 1) - sizes - 1
    front = np.zeros(int(sizes.sum()) + len(strings), np.uint8 if not len(data) or data.max() < 255 else np.uint16)
    ends = np.cumsum(sizes)
    within = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    front[np.repeat(bases + sizes - 1, sizes) - within] = data.astype(front.dtype) + 1
    empty = bases.astype(np.int32 if len(front) < 2**31 else np.int64)
    rounds = int(sizes.max())
    if len(front) <= memory_rows:
        table = empty
        for _ in range(rounds):
            ahead = front[table]
            order = np.argsort(ahead, kind="stable")[int((ahead == END).sum()) :]
            table = np.concatenate([empty, table[order] + 1])
    else:
        table = _rounds_in_files(front, empty, rounds, chunk_rows, folder)
    table = table[len(strings) :]
    string = np.searchsorted(bases, table, side="right") - 1
    return string.astype(np.int32), table - bases[string]


class Files:
    """Sequential files of one construction: appended to and read in order. Below ``folder``, or kept as buffers without one."""

    def __init__(self, folder: str | None):
        self.home = os.path.join(folder, f"bwt-{uuid.uuid4().hex}") if folder else None
        self.held: dict[str, bytearray] = {}
        if self.home:
            os.makedirs(self.home)

    def _open(self, name: str, mode: str):
        return open(os.path.join(self.home, name), mode)

    def append(self, name: str, part: np.ndarray) -> None:
        if self.home:
            with self._open(name, "ab") as out:
                part.tofile(out)
        else:
            self.held.setdefault(name, bytearray()).extend(part.tobytes())

    def parts(self, name: str, kind: np.dtype, rows: int):
        if self.home:
            with self._open(name, "rb") as f:
                while len(part := np.fromfile(f, kind, rows)):
                    yield part
        else:
            whole = np.frombuffer(bytes(self.held[name]), kind)
            yield from (whole[i : i + rows] for i in range(0, len(whole), rows))

    def remove(self, name: str) -> None:
        if self.home:
            os.remove(os.path.join(self.home, name))
        else:
            del self.held[name]

    def close(self) -> None:
        if self.home:
            shutil.rmtree(self.home)


def _rounds_in_files(front: np.ndarray, empty: np.ndarray, rounds: int, chunk_rows: int, folder: str | None) -> np.ndarray:
    files = Files(folder)
    try:
        files.append("table", empty)
        for _ in range(rounds):
            buckets: dict[int, str] = {}
            for part in files.parts("table", empty.dtype, chunk_rows):
                ahead = front[part]
                order = np.argsort(ahead, kind="stable")
                part, ahead = part[order], ahead[order]
                symbols, at = np.unique(ahead, return_index=True)
                for symbol, a, b in zip(symbols.tolist(), at, [*at[1:], len(part)]):
                    if symbol != END:
                        files.append(buckets.setdefault(symbol, f"b{symbol}"), part[a:b] + 1)
            files.remove("table")
            files.append("table", empty)
            for symbol in sorted(buckets):
                for part in files.parts(buckets[symbol], empty.dtype, chunk_rows):
                    files.append("table", part)
                files.remove(buckets[symbol])
        return np.concatenate(list(files.parts("table", empty.dtype, chunk_rows)))
    finally:
        files.close()


def repeats(strings: list[bytes], owner: np.ndarray, length: int, **table) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every substring of ``length`` that a string with a smaller ``owner`` has too."""
    string, size = suffix_table(strings, **table)
    keep = size >= length
    string, size = string[keep], size[keep].astype(np.int64)
    if not len(string):
        return string.astype(np.int64), size
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    at = ends[string] - size
    same = np.ones(len(at) - 1, bool)
    for k in range(length):
        live = np.flatnonzero(same)
        same[live] = data[at[live] + k] == data[at[live + 1] + k]
    group = np.concatenate([[0], np.cumsum(~same)])
    least = np.minimum.reduceat(owner[string], np.flatnonzero(np.concatenate([[True], ~same])))
    hit = owner[string] > least[group]
    return string[hit].astype(np.int64), (at - (ends[string] - np.array([len(s) for s in strings])[string]))[hit]
