"""Repeated passages by a distributed, common-prefix-aware merge sort of suffixes.

Every byte string of WINDOW bytes that also starts in a document of smaller id is removed. Of the
suffixes only those at anchors are sorted: the places where the hash of the next CORE bytes is least
in some window. Equal windows have equal anchors, so nothing is lost, and about one place in
fifteen is one. Anchors whose core no other document has are dropped by a first, hash-only exchange.
The rest is sorted in runs, front-coded (each suffix without the prefix it shares with the one
before), exchanged by ranges, and merged by a loser tree that compares two suffixes only from the
prefix both are known to share with the last winner. The common prefixes of the merged order and
the bytes before each anchor give the equal windows and the least id of each.

A whole copy of a smaller document is settled by its hash. Texts are UTF-8 bytes and matches never
cross documents. Null and empty texts lose nothing. A null id is larger than any other and rows with
equal ids do not count as smaller than each other, whether their texts are equal or not. Ties and
repeated rows get the same result each. Empty tables give empty results; extra columns are not read.

Exchanges carry one entry per distinct context of a run, so copies of a passage do not pile up; the
different contexts around one core meet in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .tables import load, stage, texts

WINDOW, CORE = 50, 20
PER_BUCKET = 500_000     # anchors in one part of the first exchange
PER_RUN = 300_000        # anchors hashed at once
PER_SORT = 100_000       # suffixes sorted at once
PER_RANGE = 80_000       # suffixes merged in one range
SAMPLED = 40_000         # suffixes drawn to cut the ranges, at most
LAST = (1 << 63) - 1     # stands for a null id

_U = np.uint64
_COMBINE = blocks.mixed_constants(31, 16)
_LEFT = blocks.mixed_constants(32, 256)


# -- anchors -------------------------------------------------------------------------

def slide(a, width, op):
    """op over every run of ``width`` neighbours."""
    p = 1
    while 2 * p <= width:
        a = op(a[:-p], a[p:])
        p *= 2
    return op(a[:len(a) - (width - p)], a[width - p:]) if p < width else a


def core_hashes(data, core):
    """64-bit hash of the ``core`` bytes from each place, joined from runs of 1, 2, 4, ... bytes."""
    h, done, at, size, k = blocks._BYTE[data], None, 0, 1, 0
    while True:
        if core & size:
            m = len(data) - at - size + 1
            done = h if done is None else done[:m] * _COMBINE[k + 8] + h[at:at + m]
            at += size
        if size * 2 > core:
            return blocks.mix(done)
        h, size, k = h[:-size] * _COMBINE[k] + h[size:], size * 2, k + 1


def anchors(data, offsets, window=WINDOW, core=CORE):
    """Places and core hashes of the anchors of all texts of a block."""
    n = len(data)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    end, place, none = np.repeat(offsets[1:], np.diff(offsets)), np.arange(n), _U((1 << 64) - 1)
    x = core_hashes(data, core)
    x[place[:len(x)] + core > end[:len(x)]] = none
    width = window - core + 1
    least = slide(x, width, np.minimum)
    least[place[:len(least)] + window > end[:len(least)]] = 0
    pad = np.zeros(width - 1, _U)
    at = np.flatnonzero(x == slide(np.concatenate([pad, least, pad]), width, np.maximum))
    return at, x[at]


def _keys(h, buckets):
    """Bucket in the upper half, 32 more bits of the hash in the lower."""
    return ((((h >> _U(32)) * _U(buckets)) >> _U(32)) << _U(32)) | (h & _U(0xFFFFFFFF))


def _ints(x, kind):
    return pa.array(np.ascontiguousarray(x), kind)


def _lists(flat, cuts, kind):
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), _ints(flat, kind))


def _cuts(sorted_values):
    """Starts of the runs of equal values, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])), len(sorted_values))


# -- first exchange: cores that two documents have ------------------------------------

SINGLE, SHARED, DONE = 0, 1, 2  # cores of one document of the run; of several (no document given); those documents' own
_SEEN = "bucket int, kind int, ids array<long>, counts array<int>, bits array<int>"


def _hash_runs(buckets, window, core):
    def flush(key, doc):
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        key, doc = key[new], doc[new]
        cut = _cuts(key)
        many = np.repeat(np.diff(cut) > 1, np.diff(cut))
        heads = key[cut[:-1]][np.diff(cut) > 1]
        out = []
        for kind, k, d in ((SINGLE, key[~many], doc[~many]), (SHARED, heads, np.zeros(len(heads), np.int64)), (DONE, key[many], doc[many])):
            if len(k):
                order = np.lexsort((k, d, k >> _U(32)))
                k, d = k[order], d[order]
                out.append((kind, k, d))
        for kind, k, d in out:
            bucket = (k >> _U(32)).astype(np.int64)
            by_bucket = _cuts(bucket)
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (bucket[1:] != bucket[:-1])])
            head = np.flatnonzero(new)
            head_cut = np.searchsorted(head, by_bucket)
            yield pa.RecordBatch.from_arrays([
                _ints(bucket[by_bucket[:-1]], pa.int64()).cast(pa.int32()), pa.array(np.full(len(by_bucket) - 1, kind, np.int32)),
                _lists(d[head], head_cut, pa.int64()), _lists(np.diff(np.append(head, len(k))).astype(np.int32), head_cut, pa.int32()),
                _lists((k & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32), by_bucket, pa.int32())],
                ["bucket", "kind", "ids", "counts", "bits"])

    def make(batches):
        keys, docs, held = [], [], 0
        for block in blocks.text_blocks(batches):
            data, offsets = blocks.string_column(block.column(1))
            at, h = anchors(data, offsets, window, core)
            keys.append(_keys(h, buckets))
            docs.append(block.column(0).to_numpy()[np.searchsorted(offsets, at, "right") - 1])
            held += len(h)
            if held >= PER_RUN:
                yield from flush(np.concatenate(keys), np.concatenate(docs))
                keys, docs, held = [], [], 0
        if held:
            yield from flush(np.concatenate(keys), np.concatenate(docs))

    return make


def _flat(table, name):
    return table.column(name).combine_chunks().flatten().to_numpy()


def _runs_of_ids(doc, key, cuts_by, names):
    """One row per run of ``cuts_by``: ids, how many keys each has, and the keys."""
    by = _cuts(cuts_by)
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (cuts_by[1:] != cuts_by[:-1])]))
    at = np.searchsorted(head, by)
    return pa.RecordBatch.from_arrays([
        _ints(cuts_by[by[:-1]].astype(np.int32), pa.int32()), _lists(doc[head], at, pa.int64()),
        _lists(np.diff(np.append(head, len(doc))).astype(np.int32), at, pa.int32()), _lists(key.view(np.int64), by, pa.int64())], names)


_OF_DOCUMENTS = "target int, ids array<long>, counts array<int>, keys array<long>"


def _shared_cores(targets):
    """The cores that documents of different ids have, packed by target, a hash of the id."""

    def make(batches):
        k, d = _found_cores(batches)
        if len(k):
            target = blocks.mix(d.view(_U)) % _U(targets)
            order = np.lexsort((d, target))
            yield _runs_of_ids(d[order], k[order], target[order], ["target", "ids", "counts", "keys"])

    return make


def _by_document(batches):
    """(id, keys) of every document of a target."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    d, k = np.repeat(_flat(table, "ids"), _flat(table, "counts")), _flat(table, "keys")
    order = np.argsort(d, kind="stable")
    d, k = d[order], k[order]
    cut = _cuts(d)
    for a in range(0, len(cut) - 1, 5_000):
        c = cut[a:a + 5_001]
        yield pa.RecordBatch.from_arrays([_ints(d[c[:-1]], pa.int64()), _lists(k[c[0]:c[-1]], c - c[0], pa.int64())], ["id", "keys"])


def _found_cores(batches):
    """Keys and documents of the cores that documents of different ids have."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    table = pa.Table.from_batches(held)
    kind, bucket = table.column("kind").to_numpy(), table.column("bucket").to_numpy()
    counts, ids = _flat(table, "counts"), _flat(table, "ids")
    per_row = np.diff(table.column("bits").combine_chunks().offsets.to_numpy())
    key = (np.repeat(bucket, per_row).astype(_U) << _U(32)) | _flat(table, "bits").view(np.uint32).astype(_U)
    doc, of = np.repeat(ids, counts), np.repeat(kind, per_row)
    one, seen = of == SINGLE, np.unique(key[of == SHARED])
    k, d = key[one], doc[one]
    order = np.argsort(k, kind="stable")
    k, d = k[order], d[order]
    cut = _cuts(k)
    if len(k):
        shared = (np.minimum.reduceat(d, cut[:-1]) != np.maximum.reduceat(d, cut[:-1])) | np.isin(k[cut[:-1]], seen)
        keep = np.repeat(shared, np.diff(cut))
        k, d = k[keep], d[keep]
    return np.concatenate([k, key[of == DONE]]), np.concatenate([d, doc[of == DONE]])


# -- second exchange: front-coded runs of suffixes --------------------------------------

_RUNS = "part int, run long, entries binary, members binary"


def _compress(raw: bytes) -> bytes:
    return zstandard.compress(raw, 3)


def _pack(*arrays) -> bytes:
    """Arrays as one compressed value: lengths, then bytes."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return _compress(np.array([len(r) for r in raw], np.int64).tobytes() + b"".join(raw))


def _unpack(value: bytes, *kinds):
    raw, n = zstandard.decompress(value), len(kinds)
    at = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int64, n))]) + 8 * n
    return [np.frombuffer(raw[a:b], k) for k, a, b in zip(kinds, at[:-1], at[1:])]


def contexts(data, offsets, at, window, core):
    """Suffixes (window bytes from the anchor) and the bytes before it, nearest first, padded with
    zeros, with their true lengths: one row of bytes per anchor."""
    text = np.searchsorted(offsets, at, "right") - 1
    n, reach = len(at), window - core
    right, left = np.minimum(offsets[text + 1] - at, window), np.minimum(at - offsets[text], reach)
    out = np.zeros((n, window + reach + 2), np.uint8)
    k = np.arange(window)
    out[:, :window] = np.where(k < right[:, None], data[np.minimum(at[:, None] + k, len(data) - 1)], 0)
    k = np.arange(reach)
    out[:, window:window + reach] = np.where(k < left[:, None], data[np.maximum(at[:, None] - 1 - k, 0)], 0)
    out[:, -2], out[:, -1] = right, left + 1
    return out


def _common(a, b, width):
    """Length of the common prefix of rows of bytes."""
    differ = a[:, :width] != b[:, :width]
    return np.where(differ.any(1), differ.argmax(1), width)


def _suffix_runs(splits, buckets, window, core):
    reach = window - core

    def flush(rows, docs, hashes, places, run):
        rows, doc, text, at = np.concatenate(rows), np.concatenate(docs), np.concatenate(hashes), np.concatenate(places)
        uniq, which = np.unique(rows.view(f"S{rows.shape[1]}").ravel(), return_inverse=True)
        uniq = np.frombuffer(uniq.tobytes(), np.uint8).reshape(-1, rows.shape[1])
        n = len(uniq)
        least = np.full(n, LAST, np.int64)
        np.minimum.at(least, which, doc)
        most = np.full(n, -(1 << 62), np.int64)
        np.maximum.at(most, which, doc)
        part = np.searchsorted(splits.value, np.ascontiguousarray(uniq[:, :core]).view(f"S{core}").ravel(), "right") if len(splits.value) else np.zeros(n, np.int64)
        cut = _cuts(part)
        order = np.argsort(which, kind="stable")
        which, doc, text, at = which[order], doc[order], text[order], at[order]
        member = np.searchsorted(which, cut)
        shared = np.concatenate([[0], _common(uniq[1:], uniq[:-1], window)]).astype(np.uint8)
        shared[cut[:-1]] = 0
        tail = np.arange(window) >= shared[:, None]
        tail &= np.arange(window) < uniq[:, -2][:, None]
        out = []
        for a, b, ma, mb in zip(cut[:-1], cut[1:], member[:-1], member[1:]):
            e = uniq[a:b]
            kept = np.arange(reach) < (e[:, -1] - 1)[:, None]
            entries = _pack(shared[a:b], e[:, -2], e[:, -1], e[:, :window][tail[a:b]], e[:, window:window + reach][kept], least[a:b], most[a:b] > least[a:b])
            out.append((int(part[a]), run, entries, _pack((which[ma:mb] - a).astype(np.int32), doc[ma:mb], text[ma:mb], at[ma:mb].astype(np.int64))))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                          ["part", "run", "entries", "members"])

    def make(batches):
        run, held, rows = TaskContext.get().partitionId() << 32, 0, ([], [], [], [])
        for block in blocks.text_blocks(_opened(batches)):
            data, offsets = blocks.string_column(block.column(1))
            at, h = anchors(data, offsets, window, core)
            wanted = np.unique(block.column(3).combine_chunks().flatten().to_numpy() if isinstance(block.column(3), pa.ChunkedArray) else block.column(3).flatten().to_numpy())
            at = at[np.isin(_keys(h, buckets).view(np.int64), wanted)]
            text = np.searchsorted(offsets, at, "right") - 1
            for x, y in zip(rows, (contexts(data, offsets, at, window, core), block.column(0).to_numpy()[text],
                                   block.column(2).to_numpy()[text], at - offsets[text])):
                x.append(y)
            held += len(at)
            if held >= PER_SORT:
                yield flush(*rows, run)
                run, held, rows = run + 1, 0, ([], [], [], [])
        if held:
            yield flush(*rows, run)

    return make


class LoserTree:
    """k sorted runs of byte strings in one order; ``known[i]`` is the prefix that run i's head is
    known to share with the last winner, so no byte of it is looked at again."""

    def __init__(self, strings, shared):
        self.strings, self.shared = strings, shared
        self.k = k = len(strings)
        self.at, self.known = [0] * k, [0] * k
        self.head = [s[0] if s else None for s in strings]
        size = 1
        while size < k:
            size *= 2
        self.size, self.losers = size, [-1] * size
        winners = [*range(k), *[-1] * (size - k)]
        level = size
        while level > 1:
            level //= 2
            nxt = []
            for i in range(level):
                w, loser = self._play(winners[2 * i], winners[2 * i + 1])
                self.losers[level + i] = loser
                nxt.append(w)
            winners = nxt
        self.winner = winners[0]

    def _play(self, a, b):
        if a < 0 or self.head[a] is None:
            return (b, a)
        if b < 0 or self.head[b] is None:
            return (a, b)
        known = self.known
        n = known[a]
        if n != known[b]:
            return (a, b) if n > known[b] else (b, a)
        x, y = self.head[a], self.head[b]
        end = min(len(x), len(y))
        while n < end and x[n] == y[n]:
            n += 1
        if n == end and len(x) <= len(y) or n < end and x[n] < y[n]:
            known[b] = n
            return (a, b)
        known[a] = n
        return (b, a)

    def merged(self):
        """(run, number in the run, prefix shared with the one before) in sorted order."""
        losers, head, known, play = self.losers, self.head, self.known, self._play
        while True:
            w = self.winner
            if w < 0 or head[w] is None:
                return
            i = self.at[w]
            yield w, i, known[w]
            i += 1
            self.at[w] = i
            if i < len(self.strings[w]):
                head[w], known[w] = self.strings[w][i], self.shared[w][i]
            else:
                head[w] = None
            node = (self.size + w) // 2
            while node:
                w, losers[node] = play(w, losers[node])
                node //= 2
            self.winner = w


def _strings(shared, right, tails):
    """Front-coded suffixes, decoded."""
    raw, at, before, out = tails.tobytes(), 0, b"", []
    for s, n in zip(shared.tolist(), right.tolist()):
        more = max(n - s, 0)
        before = before[:s] + raw[at:at + more] if more or s < len(before) else before
        at += more
        out.append(before)
    return out


_CLASSES = "part int, run long, entry array<int>, low array<int>, high array<int>, least array<long>"


def _merge(window, core):
    reach = window - core

    def one(part, runs, values):
        strings, shared, rights, lefts, bytes_left, least, many = [], [], [], [], [], [], []
        for value in values:
            s, r, n, tails, before, ids, more = _unpack(value, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8, np.int64, np.bool_)
            strings.append(_strings(s, r, tails))
            shared.append(s.tolist())
            rights.append(r)
            lefts.append(n - 1)
            grid = np.zeros((len(n), reach), np.uint8)
            grid[np.arange(reach) < (n - 1)[:, None]] = before
            bytes_left.append(grid)
            least.append(ids)
            many.append(more)
        order = np.array(list(LoserTree(strings, shared).merged()), np.int64)
        base = np.cumsum([0, *map(len, rights)])[:-1]
        at, lcp = base[order[:, 0]] + order[:, 1], order[:, 2].copy()
        lcp[0] = 0
        right, left, before, ids, more = (np.concatenate(x)[at] for x in (rights, lefts, bytes_left, least, many))
        alone = lcp < core  # first of its core
        size = np.diff(np.append(np.flatnonzero(alone), len(at)))
        keep = np.repeat(size > 1, size) | more
        alone_after = np.flatnonzero(keep)
        if not len(alone_after):
            return
        # within kept rows neighbours of one core stay neighbours, and a core's first row starts anew
        order, right, left, before, ids, more, lcp = (x[keep] for x in (order, right, left, before, ids, more, lcp))
        n, key = len(ids), np.zeros(len(ids), _U)
        best = np.full((n, reach + 1), LAST, np.int64)
        for o in range(reach + 1):
            if o:
                key = key * blocks._BASE + _LEFT[before[:, o - 1]]
            need = window - o
            ok = np.flatnonzero((right >= need) & (left >= o))
            if not len(ok):
                continue
            group = blocks.mix(np.cumsum(lcp < need).astype(_U)[ok] * _COMBINE[15] + key[ok])
            by = np.argsort(group, kind="stable")
            cut = _cuts(group[by])
            least_of = np.minimum.reduceat(ids[ok][by], cut[:-1])
            best[ok[by], o] = np.repeat(least_of, np.diff(cut))
        useful = more | (best < ids[:, None]).any(1)
        best, order = best[useful], order[useful]
        start = np.ones(best.shape, bool)
        start[:, 1:] = best[:, 1:] != best[:, :-1]
        row, low = np.nonzero(start)
        high = np.append(low[1:] - 1, reach)
        high = np.where(np.append(row[1:] != row[:-1], True), reach, high)
        value = best[row, low]
        real = value != LAST
        row, low, high, value = row[real], low[real], high[real], value[real]
        by = np.argsort(order[row, 0] * (1 << 32) + order[row, 1], kind="stable")
        row, low, high, value = row[by], low[by], high[by], value[by]
        cut = _cuts(order[row, 0])
        which = order[row[cut[:-1]], 0]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(which), part, np.int32)), pa.array(np.array(runs, np.int64)[which]),
            *(_lists(x.astype(k), cut, p) for x, k, p in ((order[row, 1], np.int32, pa.int32()), (low, np.int32, pa.int32()),
                                                           (high, np.int32, pa.int32()), (value, np.int64, pa.int64())))],
            ["part", "run", "entry", "low", "high", "least"])

    def make(batches):
        part, runs, values = None, [], []
        for batch in batches:
            for p, r, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if p != part and runs:
                    yield from one(part, runs, values)
                    runs, values = [], []
                part = p
                runs.append(r)
                values.append(e)
        if runs:
            yield from one(part, runs, values)
        blocks.give_back()

    return make


def _spans(window):
    """From classes and members: the removed ranges of each document, overlapping as they come."""

    def make(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                entry, low, high, least = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(4))
                which, doc, text, at = _unpack(batch.column(4)[k].as_py(), np.int32, np.int64, np.int64, np.int64)
                first, last = np.searchsorted(entry, which, "left"), np.searchsorted(entry, which, "right")
                c, m = blocks.ranges(first, last - first), np.repeat(np.arange(len(which)), last - first)
                hit = least[c] < doc[m]
                c, m = c[hit], m[hit]
                if not len(c):
                    continue
                order = np.lexsort((at[m] - high[c], text[m], doc[m]))
                c, m = c[order], m[order]
                new = np.concatenate([[True], (doc[m][1:] != doc[m][:-1]) | (text[m][1:] != text[m][:-1])])
                cut = np.append(np.flatnonzero(new), len(m))
                yield pa.RecordBatch.from_arrays([
                    _ints(doc[m][cut[:-1]], pa.int64()), _ints(text[m][cut[:-1]], pa.int64()),
                    _lists(at[m] - high[c], cut, pa.int64()), _lists(at[m] - low[c] + window, cut, pa.int64())], ["id", "hash", "start", "stop"])

    return make


# -- documents --------------------------------------------------------------------------

def _packed(docs: DataFrame) -> DataFrame:
    """(id, hash, n, z): texts compressed for the two times they are dealt by document."""

    def make(batches):
        for block in blocks.text_blocks(batches):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in block.column(1).to_pylist()]
            digest = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([
                block.column(0), pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digest], pa.int64()),
                pa.array([int.from_bytes(d[8:], "little", signed=True) for d in digest], pa.int64()),
                pa.array(list(map(len, raw)), pa.int64()), pa.array([_compress(r) for r in raw], pa.binary())], ["id", "hash", "hash2", "n", "z"])

    return docs.mapInArrow(make, "id long, hash long, hash2 long, n long, z binary")


def _opened(batches):
    """Packed rows with their texts as bytes: id, text, hash, keys."""
    for batch in batches:
        step = 200
        for a in range(0, batch.num_rows, step):
            b = batch.slice(a, step)
            text = [zstandard.decompress(z) if n else b"" for z, n in zip(b.column(1).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.large_binary()), b.column(2), b.column(3)], ["id", "text", "hash", "keys"])


def _finish(batches):
    for batch in blocks.sliced(batches):
        cols = [batch.column(i) for i in range(batch.num_columns)]
        n_removed, n_spans, digest, kept = [], [], [], []
        for k in range(batch.num_rows):
            raw = np.frombuffer(zstandard.decompress(cols[1][k].as_py()), np.uint8) if cols[2][k].as_py() else np.zeros(0, np.uint8)
            gone = np.zeros(len(raw), bool)
            if cols[3][k].as_py():
                gone[:] = True
            elif cols[4][k].is_valid:
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, cols[4][k].values.to_numpy(), 1)
                np.add.at(edge, cols[5][k].values.to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
            rest = raw[~gone].tobytes()
            n_removed.append(int(gone.sum()))
            n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield pa.RecordBatch.from_arrays([cols[0], cols[2], pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                                          pa.array(digest, pa.string()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, core: int = CORE, **columns) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the remaining bytes of every document."""
    rows = texts(docs, **columns).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text")
    packed = _packed(rows)
    facts = stage(packed.select("id", "hash", "hash2", "n"), "suffix-documents")
    first = facts.groupBy("hash", "hash2").agg(F.min("id").alias("first"))
    copies = facts.join(first, ["hash", "hash2"]).where("id > first").select("id", "hash").distinct()
    total = facts.agg(F.sum("n")).first()[0] or 0
    buckets = -(-total * 3 // (window - core + 1) // PER_BUCKET) or 1
    seen = rows.mapInArrow(_hash_runs(buckets, window, core), _SEEN)
    shared = seen.repartition(buckets, "bucket").mapInArrow(_shared_cores(buckets), _OF_DOCUMENTS)
    shared = shared.repartition(buckets, "target").mapInArrow(_by_document, "id long, keys array<long>")
    shared = stage(shared, "suffix-cores")
    suffixes = shared.agg(F.sum(F.size("keys"))).first()[0] or 0
    parts = -(-suffixes // PER_RANGE) or 1
    spark = docs.sparkSession
    splits = spark.sparkContext.broadcast(_splits(rows, total, parts, window, core))
    wanted = packed.join(shared, "id").join(copies, ["id", "hash"], "left_anti").select("id", "z", "hash", "keys", "n")
    runs = stage(wanted.mapInArrow(_suffix_runs(splits, buckets, window, core), _RUNS), "suffix-runs")
    classes = (runs.select("part", "run", "entries").repartition(parts, "part").sortWithinPartitions("part")
               .mapInArrow(_merge(window, core), _CLASSES))
    spans = (classes.join(runs.select("part", "run", "members"), ["part", "run"]).select("entry", "low", "high", "least", "members")
             .mapInArrow(_spans(window), "id long, hash long, start array<long>, stop array<long>")
             .groupBy("id", "hash").agg(F.flatten(F.collect_list("start")).alias("start"), F.flatten(F.collect_list("stop")).alias("stop")))
    whole = copies.withColumn("copy", F.lit(True))
    marks = spans.join(whole, ["id", "hash"], "full")
    done = (packed.join(marks, ["id", "hash"], "left")
            .select("id", "z", "n", (F.coalesce("copy", F.lit(False)) & (F.col("n") >= window)).alias("copy"), "start", "stop")
            .mapInArrow(_finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
    return done.select(F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def _splits(rows: DataFrame, total: int, parts: int, window: int, core: int) -> np.ndarray:
    """Cores that cut the anchors into about equal ranges, from a bounded sample."""
    share = min(1.0, SAMPLED * 4 / max(total * 2 / (window - core), 1))  # of the documents

    def make(batches):
        for block in blocks.text_blocks(batches):
            data, offsets = blocks.string_column(block.column(1))
            at, _ = anchors(data, offsets, window, core)
            at = at[::4]
            yield pa.RecordBatch.from_arrays([pa.array([data[a:a + core].tobytes() for a in at], pa.binary())], ["core"])

    if parts == 1:
        return np.zeros(0, f"S{core}")
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    got = some.mapInArrow(make, "core binary").limit(SAMPLED).toArrow().column(0).to_pylist()
    got = np.sort(np.array(got, f"S{core}")) if got else np.zeros(0, f"S{core}")
    return np.unique(got[[len(got) * i // parts for i in range(1, parts)]]) if len(got) else got


def query(spark, sf_dir):
    return remove_repeats(load(spark, sf_dir, "documents")).drop("kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), 100)) AS g
        FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g),
hit AS (SELECT r, p FROM w JOIN m USING (g) WHERE least < doc_id),
gone AS MATERIALIZED (SELECT DISTINCT r, p + j AS b FROM hit, range(0, 50) t(j)),
spans AS (SELECT r, count(*) AS n, sum(CASE WHEN before = b - 1 THEN 0 ELSE 1 END) AS runs
        FROM (SELECT r, b, lag(b) OVER (PARTITION BY r ORDER BY b) AS before FROM gone) GROUP BY r),
bytes AS (SELECT r, b, substr(h, CAST(2 * b + 1 AS BIGINT), 2) AS x FROM (SELECT r, h, unnest(range(0, length(h) // 2)) AS b FROM d)),
kept AS (SELECT r, string_agg(x, '' ORDER BY b) AS h FROM bytes ANTI JOIN gone USING (r, b) GROUP BY r)
SELECT doc_id, length(d.h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM d LEFT JOIN spans USING (r) LEFT JOIN kept USING (r)
"""
