"""Encoding of whole texts by chunks that no token crosses, with a bounded cache."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def shared(key: str, make: Callable):
    """What make() gives, made once in this worker process: kernels of later tasks find it warm."""
    held = sys.modules.setdefault("_galeway_held", types.ModuleType("_galeway_held")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


#: Bytes of text that are cut and numbered at once.
STEP = 12_000_000
#: Instead of a row: a part that the next one stays with.
ODD = -1


def release() -> None:
    """Give back the memory that Arrow keeps for later: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()


class Store:
    """Rows of ids of any length, one after another in one array; row 0 is empty."""

    def __init__(self, dtype: np.dtype):
        self.flat, self.used = np.zeros(1 << 12, dtype), 0
        self.first, self.size, self.rows = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 1

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of new rows, which have these sizes and together these ids."""
        rows = np.arange(self.rows, self.rows + len(sizes))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        if self.rows + len(sizes) > len(self.size):
            self.first, self.size = np.resize(self.first, 2 * (self.rows + len(sizes))), np.resize(self.size, 2 * (self.rows + len(sizes)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[rows], self.first[rows] = sizes, self.used + np.cumsum(sizes) - sizes
        self.used, self.rows = self.used + len(ids), self.rows + len(sizes)
        return rows

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows in turn, and where each row's end is among them."""
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.first[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at], ends


def joined(coded: list[np.ndarray], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids in turn, and the size of each array."""
    return np.concatenate(coded) if coded else np.zeros(0, dtype), np.fromiter(map(len, coded), np.int64, len(coded))


class ChunkCoder:
    """Texts are cut before spaces; what the cut parts give, one after another, is what the whole text gives.

    `prefix` stands before the first chunk, as a space before the others. A part after which a cut
    isn't safe (see `open_ends`) stays with the next one. Arrow splits texts, numbers the parts and looks up those
    met before, so only new ones are coded. Past `cap` of them the cache starts anew.
    """

    prefix = ""

    def __init__(self, dtype: str, cap: int = 600_000):
        self.dtype, self.cap = np.dtype(dtype), cap
        self.clear()

    def clear(self) -> None:
        self.store, self.whole = Store(self.dtype), {}
        self.parts, self.part_rows = pa.array([], pa.string()), np.zeros(0, np.int64)

    def open_ends(self, parts: pa.Array) -> np.ndarray:
        """Whether no cut may follow each part."""
        raise NotImplementedError

    def fresh_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of these parts, each with a space before it."""
        return self.fresh([" " + p for p in parts.to_pylist()])

    def fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of these chunks as they stand."""
        raise NotImplementedError

    def part_numbers(self, parts: pa.Array) -> np.ndarray:
        """The row of each of these distinct parts, or ODD."""
        found = pc.index_in(parts, value_set=self.parts)
        unseen = found.is_null()
        rows = np.full(len(parts), ODD)
        was = ~unseen.to_numpy(zero_copy_only=False)
        rows[was] = self.part_rows[found.drop_null().to_numpy(zero_copy_only=False)]
        new = parts.filter(unseen)
        if len(new):
            odd = self.open_ends(new)
            new_rows = np.full(len(new), ODD)
            new_rows[~odd] = self.store.add(*self.fresh_parts(new.filter(pa.array(~odd))))
            rows[~was] = new_rows
            self.parts, self.part_rows = pa.concat_arrays([self.parts, new]), np.concatenate([self.part_rows, new_rows])
        return rows

    def code(self, texts: Iterable[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, where each text's ids end); a null text is empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        stop = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        start = np.concatenate([[0], stop[:-1]])
        numbered = split.flatten().dictionary_encode()
        index, parts = numbered.indices.to_numpy(zero_copy_only=False), numbered.dictionary
        rows = self.part_numbers(parts)

        odd_part = rows == ODD
        held = odd_part[index]
        held[stop - 1] = False
        first = np.flatnonzero(np.concatenate([[True], ~held[:-1]]))  # of each chunk
        size = np.diff(np.append(first, len(index)))
        of = np.searchsorted(first, start)  # the first chunk of each text
        chunk_rows = rows[index[first]]
        special = (size > 1) | odd_part[index[first]]
        lead = np.zeros(len(first), bool)
        lead[of] = True
        if self.prefix != " ":
            special |= lead
        empty = of[(pc.binary_length(parts).to_numpy(zero_copy_only=False) == 0)[index[start]] & (stop - start == 1)]
        special[empty], chunk_rows[empty] = False, 0
        at = np.flatnonzero(special)
        ends = np.cumsum(size[at])
        words = parts.take(pa.array(index[np.repeat(first[at] - ends + size[at], size[at]) + np.arange(ends[-1] if len(at) else 0)])).to_pylist()
        chunks = [(self.prefix if b else " ") + " ".join(words[e - n : e]) for n, e, b in zip(size[at].tolist(), ends.tolist(), lead[at].tolist(), strict=True)]
        rare = list(dict.fromkeys(c for c in chunks if c not in self.whole))
        self.whole.update(zip(rare, self.store.add(*self.fresh(rare)).tolist(), strict=True))
        chunk_rows[at] = [self.whole[c] for c in chunks]

        ids, ends = self.store.gather(chunk_rows)
        if self.store.rows > self.cap:
            self.clear()
        release()
        return ids, ends[np.append(of[1:], len(first)) - 1]


def text_steps(texts: pa.Array, size: int = STEP) -> Iterator[pa.Array]:
    """Texts in slices of about `size` bytes, so that memory follows no batch size."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, to - at)
        at = to


def gathered(batches: Iterable[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in batches of about `size` bytes of text or a little more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch[text].nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held and sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
