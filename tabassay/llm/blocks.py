"""Texts as flat byte arrays: words, word hashes and n-gram hashes for whole Arrow blocks.

Operators that look at every byte work on blocks of a few MB of text (one longer text forms a
block of its own), so memory in a task does not depend on batch or partition sizes.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 4096

U64 = np.uint64
_MASK = (1 << 64) - 1


def mixed_constants(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit values, the same everywhere."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.int64).astype(U64) * U64(2) + U64(1)


_BYTE = mixed_constants(1, 256)
_BASE = U64(0x9E3779B97F4A7C15)
_GRAM = mixed_constants(2, 64)

SPACES = bytes([0x20, *range(0x09, 0x0E)])
SPACED = np.ones(256, bool)  # words [^\x20\x09-\x0D]+
SPACED[list(SPACES)] = False
LETTERED = np.ones(256, bool)  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
LETTERED[[b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def string_column(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of an Arrow string column; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, at, data = array.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[array.offset:array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks and share an executor's
    memory with its JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def sliced(batches, rows: int = 500):
    """Record batches of at most ``rows`` rows; memory is given back at the end."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def text_blocks(batches, column: str = "text", size: int = BLOCK_BYTES, rows: int = BLOCK_ROWS):
    """Slices of record batches of at most ``rows`` texts with about ``size`` bytes together."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = string_column(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, min(start + rows, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def run_hashes(data: np.ndarray, long: np.ndarray) -> np.ndarray:
    """64 bits of each of the runs, none empty, whose bytes lie one after the other in ``data``."""
    if not len(long):
        return np.zeros(0, U64)
    at = np.cumsum(long) - long
    powers = np.empty(int(long.max()), U64)
    powers[0] = 1
    powers[1:] = _BASE
    np.multiply.accumulate(powers, out=powers)
    order = np.arange(len(data)) - np.repeat(at, long)
    return mix(np.add.reduceat(_BYTE[data] * powers[order], at) + long.astype(U64))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i] .. start[i] + count[i] - 1 of all i, one after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Words:
    """Words of the texts of one block.

    start, end: byte range of each word in ``data``; first: n+1 positions of the texts' words;
    hash: 64 bits of each word's bytes.
    """

    def __init__(self, array, is_word: np.ndarray = SPACED, lower: bool = False):
        self.data, self.offsets = string_column(array)
        if lower:
            self.data = LOWER[self.data]
        inside = is_word[self.data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        cuts = self.offsets[:-1][np.diff(self.offsets) > 0]
        begins[cuts] = inside[cuts]
        ends = cuts[1:] - 1
        stops[ends] = inside[ends]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.hash = run_hashes(self.data[inside], self.end - self.start)

    def text_of_word(self):
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def grams(self, n: int, whole_if_short: bool = True):
        """(text index, hash, index of the first word) of every run of n words inside a text.

        A text with fewer words, but not none, gives its whole sequence when asked for.
        """
        total = len(self.hash)
        text = self.text_of_word()
        at = np.flatnonzero(np.arange(total) + n <= self.first[1:][text]) if total else np.zeros(0, np.int64)
        h = np.zeros(len(at), U64)
        for i in range(n):
            h += self.hash[at + i] * _GRAM[i]
        h, text = mix(h), text[at]
        if whole_if_short:
            short = np.flatnonzero((self.counts > 0) & (self.counts < n))
            if len(short):
                extra = np.array([self.whole(k) for k in short], U64)
                at = np.concatenate([at, self.first[short]])
                h, text = np.concatenate([h, extra]), np.concatenate([text, short])
                order = np.argsort(text, kind="stable")
                at, h, text = at[order], h[order], text[order]
        return text, h, at

    def whole(self, k: int) -> int:
        """Hash of all words of text k; texts of other lengths never share it by construction."""
        words = self.hash[self.first[k]:self.first[k + 1]]
        return int(mix((words * _GRAM[:len(words)]).sum(dtype=U64, keepdims=True) + U64(len(words)))[0])


def distinct_in_text(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted by (text, hash)."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    if not len(h):
        return text, h
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new]
