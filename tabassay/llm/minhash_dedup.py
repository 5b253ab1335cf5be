"""Near-duplicate documents by MinHash: many universal hash minima, banding, verification on full
shingle sets, and connected components.

Documents with equal shingle sets collapse to one first. Documents that share a band of minima are
candidates. A bucket's members are compared with its centre, the member with most company in all its
buckets, in a first round; documents linked to one centre are one cluster; only pairs of a bucket that
are still in different clusters are compared in the second round, inside a task, by their signatures and by 32 bits of
each shingle with room for chance matches; what passes is confirmed on the full sets. So no bucket
emits pairs in proportion to its square, and no pair is left out: buckets are cut into blocks of
members, every block of members with every block of those outside the bucket's main cluster. Two texts of similarity s miss all bands with probability
(1 - s^ROWS)^BANDS (1e-10 at 0.85); a signature estimate more than MARGIN below the threshold is
six standard deviations away.

Null, empty and blank texts have no shingles and link with nothing. Texts with fewer words than a
shingle are one shingle. A row without id joins no group and is kept. Ids are taken to be distinct;
rows that repeat an id and its text keep a row each in the result and stand or fall together. Ties
do not arise: the least id names a component.
Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .components import connected_components
from .tables import load, stage, texts

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
MARGIN = 0.20
MEMBERS = 400   # of a bucket in one block

_A = blocks.mixed_constants(11, HASHES)
_B = blocks.mixed_constants(12, HASHES)
_FINGER = blocks.mixed_constants(13, 2)


def shingles(column, size: int):
    """Distinct shingles of each text: (text index, hash), sorted by text and hash; words are
    [^\\x20\\x09-\\x0D]+ of the text with A-Z lowered."""
    text, h, _ = blocks.Words(column, lower=True).grams(size)
    return blocks.distinct_in_text(text, h)


def minima(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """n x HASHES minima, 16 bits each; rows of texts without shingles are zero."""
    out = np.zeros((n, HASHES), np.uint16)
    if not len(h):
        return out
    start = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    rows = text[start]
    for k in range(HASHES):
        least = np.minimum.reduceat(h * _A[k] + _B[k], start)
        out[rows, k] = (least ^ (least >> blocks.U64(29))).astype(np.uint16)
    return out


def sketches(docs: DataFrame, size: int, **columns) -> DataFrame:
    """doc_id, n shingles, fingerprint (f1, f2) of the set, bands: four 16-bit minima each."""

    def make(batches):
        for block in blocks.text_blocks(batches):
            n = block.num_rows
            text, h = shingles(block.column(1), size)
            count = np.bincount(text, minlength=n)
            finger = []
            for c in _FINGER:
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(blocks.mix(h * c), out=total[1:])
                at = np.concatenate([[0], np.cumsum(count)])
                finger.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
            bands = minima(text, h, n).view(np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays([
                block.column(0), pa.array(count), *map(pa.array, finger),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands))],
                ["doc_id", "n", "f1", "f2", "bands"])

    return texts(docs, **columns).mapInArrow(make, "doc_id long, n long, f1 long, f2 long, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int, **columns) -> DataFrame:
    """(doc_id, shingles, low) of the named documents: sorted 64-bit hashes as bytes, and their upper halves."""
    rows = texts(docs, **columns).join(ids, "doc_id")

    def make(batches):
        for block in blocks.text_blocks(batches):
            text, h = shingles(block.column(1), size)
            at = np.searchsorted(text, np.arange(block.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
                 pa.array([(h[a:b] >> blocks.U64(32)).astype(np.uint32).tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())],
                ["doc_id", "shingles", "low"])

    return rows.select("doc_id", "text").mapInArrow(make, "doc_id long, shingles binary, low binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) with 100 * intersection >= percent * union on the full sets."""

    def check(batches):
        for batch in blocks.sliced(batches):
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(a) + len(b) - same))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    sets = sets.select("doc_id", "shingles")
    left = pairs.join(sets.withColumnRenamed("doc_id", "u").withColumnRenamed("shingles", "a"), "u")
    both = left.join(sets.withColumnRenamed("doc_id", "v").withColumnRenamed("shingles", "b"), "v")
    return both.select("u", "v", "a", "b").mapInArrow(check, "u long, v long")



def alike_percent(percent: int):
    """Size test that every linked pair passes."""
    return F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent


def _second_round(percent: int):
    """In each unit of a bucket, pairs in different clusters that may be linked."""
    least = percent / 100 - MARGIN

    def may_link(a, b):
        """On 32 bits of each shingle; chance matches in a set of n are fewer than the room given."""
        a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
        both = np.concatenate([a, b])
        both.sort(kind="stable")
        n = len(both)
        same = int((both[1:] == both[:-1]).sum()) + 2 + n * n // (1 << 30)
        return 100 * same >= percent * (n - same)

    def flush(t):
        unit, doc, comp, n, outside = (t.column(c).to_numpy() for c in ("unit", "doc", "comp", "n", "outside"))
        band, low = t.column("band").to_numpy(), t.column("low").to_pylist()
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        sig = np.ascontiguousarray(bands).view(np.uint16).reshape(-1, HASHES)
        for d in range(1, len(unit)):
            same = unit[d:] == unit[:-d]
            if not same.any():
                break
            i = np.flatnonzero(same & (comp[d:] != comp[:-d]) & (doc[d:] != doc[:-d]) & (outside[d:] | outside[:-d]))
            j = i + d
            ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[ok], j[ok]
            for a in range(0, len(i), 4096):
                x, y = i[a:a + 4096], j[a:a + 4096]
                first = (bands[x] == bands[y]).argmax(1) == band[x]  # each pair once, in its first common band
                near = (sig[x] == sig[y]).mean(1) >= least
                x, y = x[first & near], y[first & near]
                ok = np.array([may_link(low[p], low[q]) for p, q in zip(x.tolist(), y.tolist())], bool)
                if ok.any():
                    x, y = x[ok], y[ok]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(doc[x], doc[y])), pa.array(np.maximum(doc[x], doc[y]))], ["u", "v"])

    def make(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            unit = table.column("unit").to_numpy()
            cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
            if cut > 2 * MEMBERS:
                yield from flush(table.slice(0, cut))
                table = table.slice(cut)
            held = table.combine_chunks().to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))
        blocks.give_back()

    return make


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, **columns) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable), kept (is it that document)."""
    sketch = stage(sketches(docs, size, **columns), "minhash-sketches")
    reps = stage(sketch.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(
        F.min("doc_id").alias("doc"), F.first("bands").alias("bands")), "minhash-representatives")
    member = reps.select("doc", "n", F.posexplode("bands").alias("band", "key"))
    buckets = member.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1")
    linked = stage(member.join(buckets, ["band", "key"]), "minhash-members")  # documents that share a band
    company = linked.groupBy("doc").agg(F.sum("members").alias("company"))
    centres = (linked.select("doc", "band", "key").join(company, "doc").groupBy("band", "key")
               .agg(F.max_by("doc", F.struct("company", -F.col("doc"))).alias("centre")))
    size_of = reps.select(F.col("doc").alias("u"), F.col("n").alias("n_u"), F.col("bands").alias("b_u"))
    equal = F.aggregate(F.zip_with("b_u", "b_v", lambda a, b: sum(
        (F.shiftright(a.bitwiseXOR(b), 16 * k).bitwiseAND(F.lit(0xFFFF)) == 0).cast("int") for k in range(4))),
        F.lit(0), lambda s, x: s + x)
    first = (linked.join(centres, ["band", "key"]).where("doc <> centre").select(F.col("centre").alias("u"), F.col("doc").alias("v"), F.col("n").alias("n_v")).distinct()
             .join(size_of, "u").where(alike_percent(percent))
             .join(reps.select(F.col("doc").alias("v"), F.col("bands").alias("b_v")), "v")
             .where(equal >= HASHES * (percent / 100 - MARGIN)).select("u", "v"))
    first = stage(first, "minhash-pairs")
    touched = linked.select(F.col("doc").alias("doc_id")).distinct()
    sets = stage(shingle_sets(docs, touched, size, **columns), "minhash-sets")
    edges = stage(verified(first, sets, percent), "minhash-edges")
    # a cluster is named by the least document linked to a centre; equal names are connected
    star = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    named = edges.join(star, "u").select(F.col("v").alias("node"), "least").unionByName(star.select(F.col("u").alias("node"), "least"))
    comps = named.groupBy("node").agg(F.min("least").alias("component"))
    # second round: buckets whose members are in several clusters
    placed = linked.join(comps.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc"))
    groups = placed.groupBy("band", "key", "comp").agg(F.count("*").alias("c"))
    mixed = groups.groupBy("band", "key").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("main"),
                                              F.max("c").alias("most")).where("comps > 1")
    placed = placed.join(mixed, ["band", "key"]).withColumn("outside", F.col("comp") != F.col("main"))
    inner, outer = (F.ceil(F.col(c) / MEMBERS).cast("int") for c in ("members", "rest"))
    placed = placed.withColumn("rest", F.col("members") - F.col("most"))
    mine = lambda c: F.pmod(F.xxhash64("doc"), c).cast("int")
    rows = placed.select("doc", "n", "comp", "band", "key", "outside", inner.alias("inner"), outer.alias("outer"))
    as_member = rows.select("*", mine(F.col("inner")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("o"))
    as_outside = rows.where("outside AND inner > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("inner") - 1)).alias("i"), mine(F.col("outer")).alias("o"))
    as_outside = as_outside.where(F.col("i") != mine(F.col("inner")))
    units = (as_member.unionByName(as_outside).withColumn("unit", F.xxhash64("band", "key", "i", "o"))
             .join(reps.select("doc", "bands"), "doc").join(sets.select(F.col("doc_id").alias("doc"), "low"), "doc")
             .select("unit", "doc", "comp", "n", "outside", "band", "bands", "low"))
    near = units.repartition("unit").sortWithinPartitions("unit", "doc").mapInArrow(_second_round(percent), "u long, v long").distinct()
    more = verified(stage(near, "minhash-pairs"), sets, percent)
    edges = edges.unionByName(more)
    comps = connected_components(edges)
    same_set = sketch.join(reps.select("n", "f1", "f2", "doc"), ["n", "f1", "f2"], "left")
    return (same_set.join(comps.withColumnRenamed("node", "doc"), "doc", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each near-duplicate group, with its columns."""
    gone = near_duplicates(docs, size, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def query(spark, sf_dir):
    return near_duplicates(load(spark, sf_dir, "documents"), size=3, percent=85)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT u, v FROM pair JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT a, v FROM reach JOIN link ON b = u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
