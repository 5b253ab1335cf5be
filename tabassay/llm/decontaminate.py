"""Benchmark decontamination with a positional inverted index split by document.

``build_index`` stores, for segments of about a MB of documents, the posting lists (sorted word
positions) of the test terms; a segment is one row and can be written and reused. ``search`` takes
each test window's terms rarest list first, shifts the lists by the terms' offsets and intersects
them: what is left are exact phrases. Proximity matches need no phrase: of a window's distinct terms that the corpus
has, the three rarest (by words of the whole corpus, then by hash) count, and every place of the
rarest with both others at most ``near`` words away, in any order, is one. Which terms those are is
counted once per block of tests before the search, so matches do not depend on segments, partitions
or blocks. The test set is searched in blocks of bounded size; only a block is ever broadcast.
Nothing of the corpus is shuffled with a single block but one count per task and term.

Null or empty texts and items have no words: n_words 0, no window. Repeated items share windows and
are all reported; repeated documents stay separate rows. Items with null id count under the text
'null'. Empty tables give empty results or no hits. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .tables import fresh_name, load, stage, texts

WINDOW = 10
NEAR = 20
MAX_WINDOWS = 200_000  # test windows searched at once: about 40 MB in each task
GAP = 64               # positions left free between documents, more than a window

_SEGMENT = ("doc_ids array<long>, n_words array<long>, first array<long>, terms array<long>, "
            "lists array<int>, positions array<int>")
_FOUND = ("doc_id long, n_words long, hits array<struct<start:int,stop:int>>, items array<string>, "
          "phrases array<struct<window:int,start:int>>, near array<struct<window:int,start:int>>")


def _words(column):
    return blocks.Words(column, blocks.LETTERED, lower=True)


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, key, terms): each run of ``window`` words of an item, or all words of a shorter one."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"),
                        F.col(text_col).cast("string").alias("text"))

    def make(batches):
        for block in blocks.text_blocks(batches):
            words = _words(block.column(1))
            text, key, at = words.grams(window)
            size = np.minimum(words.counts[text], window)
            flat = at.repeat(size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, pa.array(words.hash[flat].view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(text)), pa.array(key.view(np.int64)), terms],
                                             ["item", "key", "terms"])

    return rows.mapInArrow(make, "item string, key long, terms array<long>")


class Tests:
    """One block of distinct test windows as arrays: what a task needs to search."""

    def __init__(self, table: pa.Table, window: int):
        n = table.num_rows
        self.items = table.column("items").to_pylist()
        lists = table.column("terms").to_pylist()
        self.size = np.array([len(x) for x in lists], np.int64)
        self.terms = np.zeros((n, window), np.int64)
        for k, x in enumerate(lists):
            self.terms[k, :len(x)] = x
        self.vocabulary = np.unique(np.concatenate([np.array(x, np.int64) for x in lists])) if n else np.zeros(0, np.int64)
        self.triples = np.zeros((0, 3), np.int64)  # the rarest terms of windows, rarest first, each triple once
        self.windows, self.by_triple = np.zeros(0, np.int64), np.zeros(1, np.int64)  # and the windows that have it

    def count_terms(self, counts: np.ndarray) -> None:
        """Choose the rarest terms by the words the corpus has of each term of ``vocabulary``."""
        if not len(self.size):
            return
        absent = len(counts)
        rank = np.empty(absent, np.int64)
        by = np.lexsort((self.vocabulary, counts))
        rank[by] = np.arange(absent)
        rank[counts == 0] = absent
        ranks = rank[np.minimum(np.searchsorted(self.vocabulary, self.terms), absent - 1)]
        ranks[np.arange(self.terms.shape[1])[None, :] >= self.size[:, None]] = absent
        ranks.sort(axis=1)
        ranks[:, 1:][ranks[:, 1:] == ranks[:, :-1]] = absent  # a repeated word counts once
        ranks.sort(axis=1)
        rare = ranks[:, :3]
        able = np.flatnonzero((rare < absent).all(1)) if rare.shape[1] == 3 else np.zeros(0, np.int64)
        triples, which = np.unique(rare[able], axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        self.triples = self.vocabulary[by[triples]].reshape(-1, 3)
        self.windows, self.by_triple = able[order], np.concatenate([[0], np.cumsum(np.bincount(which.ravel(), minlength=len(triples)))])


def test_blocks(items: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS, **columns):
    """Blocks of distinct windows, each of at most about ``max_windows``."""
    made = windows(items, window=window, **columns).groupBy("key").agg(
        F.first("terms").alias("terms"), F.array_sort(F.collect_set("item")).alias("items"))
    n = -(-made.count() // max_windows) or 1
    for k in range(n):
        part = made.where(F.pmod("key", F.lit(n)) == k) if n > 1 else made
        yield Tests(part.orderBy("key").toArrow(), window)


def corpus_counts(docs: DataFrame, vocabulary: np.ndarray, **columns) -> np.ndarray:
    """How many words of all documents each term of the sorted ``vocabulary`` is."""
    counts = np.zeros(len(vocabulary), np.int64)
    if not len(vocabulary):
        return counts
    wanted = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known, n = wanted.value, None
        for block in blocks.text_blocks(batches):
            term = _words(block.column(1)).hash.view(np.int64)
            at = np.minimum(np.searchsorted(known, term), len(known) - 1)
            found = np.bincount(at[known[at] == term], minlength=len(known))
            n = found if n is None else n + found
        if n is not None and n.any():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(known[at]), pa.array(n[at])], ["term", "n"])

    got = texts(docs, **columns).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts[np.searchsorted(vocabulary, got.column(0).to_numpy())] = got.column(1).to_numpy()
    return counts


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, **columns) -> DataFrame:
    """One row per segment: documents, and for each term (of ``vocabulary``, if given) the sorted
    positions of its words. Positions count words across the segment, ``GAP`` apart by document."""
    wanted = docs.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None

    def make(batches):
        for block in blocks.text_blocks(batches):
            words = _words(block.column(1))
            place = np.arange(len(words.hash)) + GAP * words.text_of_word()
            term = words.hash.view(np.int64)
            if wanted is not None:
                known = np.isin(term, wanted.value, kind="sort") if len(wanted.value) else np.zeros(len(term), bool)
                term, place = term[known], place[known]
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order]
            new = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
            ids = block.column(0)
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(words.counts, pa.int64()),
                one(words.first[:-1] + GAP * np.arange(len(ids)), pa.int64()), one(term[new], pa.int64()),
                one(np.append(new, len(term)).astype(np.int32), pa.int32()), one(place.astype(np.int32), pa.int32())],
                ["doc_ids", "n_words", "first", "terms", "lists", "positions"])

    return texts(docs, **columns).mapInArrow(make, _SEGMENT)


class Segment:
    """Posting lists of one index row; a posting is found by (term number, position)."""

    def __init__(self, terms, lists, positions):
        self.terms, self.lists = terms, lists.astype(np.int64)
        self.long = np.diff(self.lists)
        self.key = (np.repeat(np.arange(len(terms)), self.long) << 32) + positions

    def has(self, term, position):
        """Whether the term's list has the position."""
        key = (term << 32) + position
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.key[at] == key

    def distance(self, term, position):
        """To the nearest posting of the term."""
        key = (term << 32) + position
        at = np.searchsorted(self.key, key)
        best = np.full(len(key), 1 << 31)
        for x in (np.maximum(at - 1, 0), np.minimum(at, len(self.key) - 1)):
            same = (self.key[x] >> 32) == term
            best = np.where(same, np.minimum(best, np.abs(self.key[x] - key)), best)
        return best


def search_segment(seg: Segment, tests: Tests, near: int):
    """Phrase and proximity matches as (window, position) pairs."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(seg.key) or not len(tests.size):
        return none, none
    term = np.minimum(np.searchsorted(seg.terms, tests.terms), len(seg.terms) - 1)
    used = np.arange(tests.terms.shape[1])[None, :] < tests.size[:, None]
    known = seg.terms[term] == tests.terms
    cost = np.where(used, np.where(known, seg.long[term], 0), 1 << 40)
    order = np.argsort(cost, axis=1, kind="stable")  # rarest list first
    alive = np.flatnonzero((known | ~used).all(1))
    lead = order[alive, 0]
    w = np.repeat(alive, seg.long[term[alive, lead]])
    start = seg.key[blocks.ranges(seg.lists[term[alive, lead]], seg.long[term[alive, lead]])] & 0xFFFFFFFF
    start = start - order[w, 0]
    for j in range(1, tests.terms.shape[1]):
        off = order[w, j]
        ok = ~used[w, off] | seg.has(term[w, off], start + off)
        w, start = w[ok], start[ok]
    phrases = (w, start)
    if not near:
        return phrases, none
    term = np.minimum(np.searchsorted(seg.terms, tests.triples), len(seg.terms) - 1)
    three = np.flatnonzero((seg.terms[term] == tests.triples).all(1))
    lead = term[three, 0]
    t = np.repeat(three, seg.long[lead])
    place = seg.key[blocks.ranges(seg.lists[lead], seg.long[lead])] & 0xFFFFFFFF
    for j in (1, 2):
        ok = seg.distance(term[t, j], place) <= near
        t, place = t[ok], place[ok]
    n = np.diff(tests.by_triple)[t]
    return phrases, (tests.windows[blocks.ranges(tests.by_triple[t], n)], np.repeat(place, n))


def _pairs(doc, w, at, n):
    order = np.lexsort((at, w, doc))
    doc, w, at = doc[order], w[order], at[order]
    offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
        [pa.array(w.astype(np.int32)), pa.array(at.astype(np.int32))], ["window", "start"])), doc, w, at


def search(index: DataFrame, tests: Tests, near: int = NEAR) -> DataFrame:
    """One row per document: hit word ranges, items, phrase and proximity matches; the latter only
    after ``tests.count_terms``."""
    shared = index.sparkSession.sparkContext.broadcast(tests)

    def find(batches):
        tests = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].values for i, n in enumerate(batch.schema.names)}
                got = {n: row[n].to_numpy(zero_copy_only=False) for n in row if n != "doc_ids"}
                seg = Segment(got["terms"], got["lists"], got["positions"])
                (w, at), (nw, nat) = search_segment(seg, tests, near)
                n, first = len(row["doc_ids"]), got["first"]
                doc, ndoc = (np.searchsorted(first, x, "right") - 1 for x in (at, nat))
                # a document without words begins where the next one's gap does; the last start at or before is right
                phrases, doc, w, at = _pairs(doc, w, at - first[doc], n)
                nears, *_ = _pairs(ndoc, nw, nat - first[ndoc], n)
                hits, items = [[] for _ in range(n)], [set() for _ in range(n)]
                for d, x, a in zip(doc.tolist(), w.tolist(), at.tolist()):
                    items[d].update(tests.items[x])
                by_start = np.lexsort((at, doc))
                for d, a, b in zip(doc[by_start].tolist(), at[by_start].tolist(), (at + tests.size[w])[by_start].tolist()):
                    if hits[d] and a <= hits[d][-1]["stop"]:
                        hits[d][-1]["stop"] = max(hits[d][-1]["stop"], b)
                    else:
                        hits[d].append({"start": a, "stop": b})
                yield pa.RecordBatch.from_arrays([
                    row["doc_ids"], row["n_words"], pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())), phrases, nears],
                    ["doc_id", "n_words", "hits", "items", "phrases", "near"])

    return index.mapInArrow(find, _FOUND)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR,
                  max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings), phrases, near, contaminated."""
    if window > GAP or near >= GAP:
        raise ValueError(f"window must be at most {GAP} and near less")
    tests = list(test_blocks(items, window, max_windows))
    for t in tests if near else []:
        t.count_terms(corpus_counts(docs, t.vocabulary))
    if len(tests) == 1:
        found = search(build_index(docs, tests[0].vocabulary), tests[0], near)
        hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
        out = found.withColumn("n_hit", hit).drop("hits")
    else:  # a document's ranges of all blocks meet again by a row key, so repeated ids stay apart
        rows = stage(texts(docs).withColumn("row", F.monotonically_increasing_id()), "decontaminate")
        every = None
        for t in tests:
            found = search(build_index(rows, t.vocabulary, id_col="row"), t, near)
            every = found if every is None else every.unionByName(found)
        words = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("hits")),
                                                       lambda x: F.sequence(x["start"], x["stop"] - 1))))
        out = every.groupBy(F.col("doc_id").alias("row")).agg(
            F.max("n_words").alias("n_words"), F.size(words).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.flatten(F.collect_list("phrases")).alias("phrases"), F.flatten(F.collect_list("near")).alias("near"))
        out = rows.select("row", "doc_id").join(out, "row").drop("row")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def keep_uncontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows that hold no window of a test item, with their columns. Each row is judged by its own text:
    rows that repeat an id, or have none, stand or fall alone."""
    row = fresh_name(docs, "row")
    keyed = stage(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
    found = decontaminate(keyed.select(F.col(row).alias("doc_id"), "text"), items, window, near=0).where("contaminated")
    return keyed.join(found.select(F.col("doc_id").alias(row)), row, "left_anti").select(docs.columns)


def query(spark, sf_dir):
    found = decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), near=0)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def proximity_query(spark, sf_dir):
    """With proximity matches: how many pairs of a test window and a place each document has."""
    found = decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("near").cast("long").alias("n_near"), "contaminated")


SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
        FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM bw WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM dw),
occ AS (SELECT r, i, k, item FROM (SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM pos, ks
        WHERE i + k - 1 <= len(ws)) JOIN win USING (k, g)),
hit AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT DISTINCT r, i, k FROM occ), range(0, 10) t(j) WHERE j < k GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM occ GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
