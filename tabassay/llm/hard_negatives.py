"""Hard-negative mining with exact integer scores from a residue number system.

Vectors become integers; their inner products are computed as matrix products of residues modulo a
few small primes in float32, which are exact below 2**24, and put together again as signed integers
by mixed-radix Chinese remaindering. The primes follow from the largest vector length in the table,
so every score is reconstructed exactly.

Anchors are a stated share of the rows. They are staged in blocks of about ``ANCHOR_BLOCK`` rows; one
block at a time is broadcast (its bytes are bounded by that number), and all rows are scored against
it where they lie, in tiles. Each task keeps, per anchor, only the first few rows of its part, so a
shuffle carries a few rows per task and anchor, and a window merges them. Two passes: positives of the
anchor's label first, then, per positive, the first rows of other labels inside its score window.

Rows with a null label, vector or vec_id, or a null or non-finite component, take no part. Of vectors
of different lengths the shorter counts as filled with zeros; an empty vector scores 0 with all.
Repeated rows, also of one vec_id, are rows of their own and can be each other's positives. Equal
scores are ordered by vec_id, then by position in the staged table. Anchors without positives, and
positives without negatives in their window, give no rows; an empty table gives none. Extra columns
are ignored. Scores that could leave the range of a long raise an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import give_back, sliced
from .tables import load, stage

ANCHOR_BLOCK = 8192
TILE_ANCHORS, TILE_ROWS = 256, 2048
EXACT = 1 << 24  # integers up to here are exact in float32
NONE = np.iinfo(np.int64).min

SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), negatives AS (
  SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""


def primes_for(bound: int) -> list[int]:
    """Primes from 251 downwards whose product exceeds every signed score up to ``bound``."""
    made, product = [], 1
    for p in range(251, 2, -1):
        if product > 2 * bound + 1:
            break
        if all(p % d for d in range(2, math.isqrt(p) + 1)):
            made.append(p)
            product *= p
    if product <= 2 * bound + 1:
        raise ArithmeticError("scores are too large")
    return made


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of x between -(p-1)/2 and (p-1)/2 for odd p."""
    half = p // 2
    return (x + half) % p - half


class Residues:
    """Component matrices of integer vectors, one per prime."""

    def __init__(self, q: np.ndarray, primes: list[int]):
        self.parts = [balanced(q, p).astype(np.float32) for p in primes]

    def rows(self, at) -> list[np.ndarray]:
        return [m[at] for m in self.parts]


def product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, balanced; the inner dimension is cut where float32 could round."""
    width = max(1, (EXACT - 1) // (p // 2) ** 2)
    total = None
    for start in range(0, max(a.shape[1], 1), width):
        part = balanced((a[:, start:start + width] @ b[:, start:start + width].T).astype(np.int32), p)
        total = part if total is None else balanced(total + part, p)
    return total


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact signed inner products: mixed-radix digits of the residues, least prime product first."""
    digits = []
    for i, p in enumerate(primes):
        d = product_mod(a[i], b[i], p)
        for known, r in zip(digits, primes):
            d = balanced((d - known) * pow(r, -1, p), p)
        digits.append(d)
    made, weight = np.zeros(digits[0].shape, np.int64), 1
    for d, p in zip(digits, primes):
        made += d.astype(np.int64) * np.int64(weight if weight < 1 << 63 else 0)
        weight *= p
    return made


def first_of(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest entries of each row of s, of equal ones the leftmost; NONE never counts."""
    live = s.max(axis=1) > NONE
    at = np.flatnonzero(live)
    s = s[at]
    if s.shape[1] > k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
        more, same = s > least[:, None], s == least[:, None]
        taken = more | (same & (np.cumsum(same, axis=1) <= (k - more.sum(axis=1))[:, None]))
    else:
        taken = np.ones(s.shape, bool)
    r, c = np.nonzero(taken & (s > NONE))
    return at[r], c


class Rows:
    """One batch as arrays, ordered by vec_id and position."""

    def __init__(self, batch, dims: int):
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        lists = col["q"]
        counts = np.diff(lists.offsets.to_numpy())
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.repeat(np.arange(len(counts)), counts)
        q = np.zeros((len(counts), max(dims, 1)), np.int64)
        q[at, np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)] = values
        self.vec_id, self.uid, self.label = (col[n].to_numpy() for n in ("vec_id", "uid", "label"))
        order = np.lexsort((self.uid, self.vec_id))
        self.q, self.vec_id, self.uid, self.label = q[order], self.vec_id[order], self.uid[order], self.label[order]


def prepare(vectors: DataFrame, scale: int = 256, relabel=None, id_col: str = "vec_id", vector_col: str = "embedding",
            label_col: str = "label") -> DataFrame:
    """Staged (uid, vec_id, label, q): whole numbers floor(scale * x), rows that take no part left out."""
    taken = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                           F.col(vector_col).cast("array<double>").alias("x"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    taken = taken.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(~F.exists("x", odd))
    label = relabel(F.col("vec_id"), F.col("label")) if relabel else F.col("label")
    return stage(taken.select(F.monotonically_increasing_id().alias("uid"), "vec_id", label.alias("label"),
                              F.transform("x", lambda x: F.floor(scale * x)).alias("q")), "vectors")


def mine(rows: DataFrame, is_anchor, n_positives: int = 5, n_negatives: int = 5, percent: int = 80,
         anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``prepare``'s rows.

    ``is_anchor`` is a condition on vec_id. Negatives lie between ``percent`` of the positive's score and all of it.
    """
    spark = rows.sparkSession
    anchors = rows.where(is_anchor)
    about = rows.agg(F.max(F.size("q")), F.max(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))),
                     F.count(F.when(is_anchor, 1))).first()
    dims, norm, n_anchors = about[0] or 0, about[1] or 0.0, about[2]
    if norm * 1.0001 + 1 >= 1 << 62:
        raise ArithmeticError("scores are too large for a long")
    primes = primes_for(int(norm * 1.0001) + 1)
    n_blocks = -(-n_anchors // anchor_block)
    if n_blocks == 0:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dealt = stage(anchors.withColumn("block", (F.pmod(F.xxhash64("uid"), F.lit(n_blocks))).cast("int")), "anchors")
    made = None
    for block in range(n_blocks):
        shared = spark.sparkContext.broadcast(dealt.where(F.col("block") == block).drop("block").toArrow())
        best = _positives(rows, shared, primes, dims, n_positives)
        near = spark.sparkContext.broadcast(best.toArrow())
        part = stage(_negatives(rows, shared, near, primes, dims, n_negatives, percent), "negatives")
        made = part if made is None else made.unionByName(part)
    return made


def _anchor_rows(table: pa.Table, dims: int) -> Rows:
    return Rows(table.combine_chunks().to_batches()[0], dims) if table.num_rows else None


def _tiles(batches, anchors: Rows, primes, dims):
    """(rows of a tile, anchor positions, exact scores) of all tiles of a task."""
    left = Residues(anchors.q, primes)
    for batch in sliced(batches, TILE_ROWS):
        tile = Rows(batch, dims)
        right = Residues(tile.q, primes)
        yield tile, left, right


def _positives(rows: DataFrame, shared, primes, dims, k: int) -> DataFrame:
    """(anchor, positive_id, positive_score): each anchor's first k other rows of its label."""

    def run(batches):
        anchors = _anchor_rows(shared.value, dims)
        if anchors is None:
            return
        by_label = {x: np.flatnonzero(anchors.label == x) for x in np.unique(anchors.label)}
        for tile, left, right in _tiles(batches, anchors, primes, dims):
            for x, mine_ in by_label.items():
                same = np.flatnonzero(tile.label == x)
                for start in range(0, len(mine_) if len(same) else 0, TILE_ANCHORS):
                    at = mine_[start:start + TILE_ANCHORS]
                    s = scores(left.rows(at), right.rows(same), primes)
                    s[anchors.uid[at][:, None] == tile.uid[same][None, :]] = NONE
                    a, b = first_of(s, k)
                    yield pa.RecordBatch.from_arrays([anchors.uid[at[a]], tile.vec_id[same[b]], tile.uid[same[b]], s[a, b]],
                                                     ["anchor", "positive_id", "uid", "positive_score"])
        give_back()

    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "uid")
    found = rows.mapInArrow(run, "anchor long, positive_id long, uid long, positive_score long")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("uid")


def _negatives(rows: DataFrame, shared, near, primes, dims, k: int, percent: int) -> DataFrame:
    """Per anchor and positive, the first k rows of other labels inside the positive's window."""

    def run(batches):
        anchors = _anchor_rows(shared.value, dims)
        if anchors is None or not near.value.num_rows:
            return
        table = near.value
        place = np.argsort(anchors.uid)
        at = place[np.searchsorted(anchors.uid, table.column("anchor").to_numpy(), sorter=place)]
        high, n = table.column("positive_score").to_numpy(), table.column("n").to_numpy()
        ids = table.column("positive_id").to_numpy()
        low = np.array([-((-percent * int(x)) // 100) for x in high], np.int64)  # least score with percent * high <= 100 * score
        open_ = np.flatnonzero(low <= high)
        order = open_[np.lexsort((n[open_], at[open_]))]
        at, high, low, n, ids = at[order], high[order], low[order], n[order], ids[order]
        for tile, left, right in _tiles(batches, anchors, primes, dims):
            every = right.rows(slice(None))
            for start in range(0, len(anchors.uid), TILE_ANCHORS):
                stop = min(start + TILE_ANCHORS, len(anchors.uid))
                windows = np.arange(np.searchsorted(at, start), np.searchsorted(at, stop))
                if not len(windows):
                    continue
                s = scores(left.rows(slice(start, stop)), every, primes)
                s[anchors.label[start:stop][:, None] == tile.label[None, :]] = NONE
                for rank in np.unique(n[windows]):
                    w = windows[n[windows] == rank]
                    part = s[at[w] - start]
                    part[(part > high[w][:, None]) | (part < low[w][:, None])] = NONE
                    a, b = first_of(part, k)
                    if len(a):
                        yield pa.RecordBatch.from_arrays(
                            [anchors.uid[at[w[a]]], anchors.vec_id[at[w[a]]], n[w[a]].astype(np.int32), ids[w[a]], high[w[a]],
                             tile.vec_id[b], tile.uid[b], part[a, b]],
                            ["anchor", "anchor_id", "n", "positive_id", "positive_score", "negative_id", "uid", "negative_score"])
        give_back()

    order = Window.partitionBy("anchor", "n").orderBy(F.desc("negative_score"), "negative_id", "uid")
    found = rows.mapInArrow(run, "anchor long, anchor_id long, n int, positive_id long, positive_score long, negative_id long, uid long, negative_score long")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabel = lambda i, x: F.when(i % 7 == 0, (x + 1) % 10).otherwise(x)
    return mine(prepare(load(spark, sf_dir, "embeddings"), relabel=relabel), F.col("vec_id") % 100 == 0)
