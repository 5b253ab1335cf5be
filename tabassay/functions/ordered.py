"""Order-dependent statistics without a single-partition window.

Every split is summarised in one pass with constant state, and the summaries (one row per
split and column) are joined end to end by a window over that small table. Rows are
range-partitioned on their order only where they are not read in it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.table import stage

FLAGS_PER_MASK = 62
PIECES_PER_PART = 64  # ordered stretches per split, on average; more means the rows are in another order


def _masks(names, tests) -> list[Column]:
    """Test results as bits of whole numbers mask0, mask1, ..."""
    masks = []
    for start in range(0, len(names), FLAGS_PER_MASK):
        bits = [F.shiftleft(tests[c].cast("bigint"), i)
                for i, c in enumerate(names[start:start + FLAGS_PER_MASK])]
        masks.append(reduce(lambda a, b: a.bitwiseOR(b), bits).alias(f"mask{len(masks)}"))
    return masks


def _bits(batch, i):
    return (batch[f"mask{i // FLAGS_PER_MASK}"].to_numpy() >> (i % FLAGS_PER_MASK)) & 1 == 1


def longest_null_runs(df: DataFrame, order: Column, tests: dict[str, Column], keep=None) -> DataFrame:
    """(column, longest_run): the longest stretch of consecutive rows, in ``order``, passing each test.

    No row moves if the scan is in order already, as rows numbered by file and position are: each
    task reduces its split to pieces (first and last row, rows before the first and after the last
    clear row, longest run between), cut wherever the order jumps back. Pieces are joined end to end
    by their first rows. Only if a split has many pieces, or pieces overlap, are the rows
    range-partitioned first. ``order`` has no two equal values. ``keep`` stages the pieces.
    """
    names = list(tests)
    packed = df.select(order.alias("ord"), *_masks(names, tests))
    pieces = (keep or stage)(_pieces(packed, names, PIECES_PER_PART), "runs")
    next_low = F.lead("low").over(Window.orderBy("low"))  # one row per piece
    apart = pieces.where("pos <= 0").select("pos", (next_low <= F.col("high")).alias("over"))
    if apart.where("pos < 0 OR over").limit(1).count():
        pieces = _pieces(packed.repartitionByRange("ord").sortWithinPartitions("ord"), names)
    return _joined(pieces, names)


def _pieces(packed, names, most: int | None = None):
    """One row per stretch of rows in ascending order and test: low, high, size, the longest run inside,
    and the runs at both ends (lead, tail); whole: all rows pass. A split of more than ``most``
    stretches is given up with one row whose test is -1."""

    def summarise(batches):
        begun, last, begins = None, None, 0
        made = []

        def close():
            for i, (lead, inner, tail) in enumerate(state):
                made.append((i, begun, last, size, size if lead is None else lead, inner, tail, lead is None))

        size, state = 0, []
        for batch in batches:
            order = batch["ord"].to_numpy()
            if not len(order):
                continue
            flags = [_bits(batch, i) for i in range(len(names))]
            cuts = [0, *(np.flatnonzero(order[1:] <= order[:-1]) + 1), len(order)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if begun is None or order[a] <= last:
                    if begun is not None:
                        close()
                    begun, size, state = int(order[a]), 0, [[None, 0, 0] for _ in names]
                    begins += 1
                    if most and begins > most:
                        yield frame([(-1, 0, 0, 0, 0, 0, 0, False)])
                        return
                for i, s in enumerate(state):
                    clear = np.flatnonzero(~flags[i][a:b])
                    if not len(clear):
                        s[2] += b - a
                        continue
                    run = s[2] + int(clear[0])  # goes on from the rows before
                    if s[0] is None:
                        s[0] = run
                    else:
                        s[1] = max(s[1], run)
                    if len(clear) > 1:
                        s[1] = max(s[1], int(np.diff(clear).max()) - 1)
                    s[2] = b - a - 1 - int(clear[-1])
                size += b - a
                last = int(order[b - 1])
            if len(made) > 10_000:
                yield frame(made)
                made = []
        if begun is not None:
            close()
        if made:
            yield frame(made)

    def frame(rows):
        return pd.DataFrame(rows, columns=["pos", "low", "high", "size", "lead", "inner", "tail", "whole"])

    return packed.mapInPandas(summarise, "pos int, low bigint, high bigint, size bigint, lead bigint, inner bigint, tail bigint, whole boolean")


def _joined(pieces, names):
    """Longest run over pieces in order: a run goes on through pieces that pass as a whole."""
    ordered = Window.partitionBy("pos").orderBy("low")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # Rows that the run at a piece's start has behind it: whole pieces since the last other one, and its tail.
    done = F.coalesce(F.sum("size").over(earlier), F.lit(0))
    placed = pieces.withColumn("done", done).withColumn("ends", F.when(~F.col("whole"), F.col("done") + F.col("size") - F.col("tail")))
    since = F.coalesce(F.max("ends").over(Window.partitionBy("pos").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = placed.withColumn("bridge", F.col("done") - since + F.col("lead"))
    best = runs.groupBy("pos").agg(F.greatest(F.max("bridge"), F.max("inner"), F.max("tail")).alias("longest_run"))
    labels = F.array(*[F.lit(c) for c in names])
    return best.select(F.element_at(labels, F.col("pos") + 1).alias("column"), F.col("longest_run").cast("bigint").alias("longest_run"))


def first_passing(df: DataFrame, order: Column, tests: dict[str, Column], k: int) -> DataFrame:
    """(column, at): the k least values of ``order`` among the rows passing each test.

    Every task keeps k per test, so nothing is sorted and only those are shuffled.
    """
    names = list(tests)

    def keep(batches):
        best = [np.zeros(0, np.int64) for _ in names]
        for batch in batches:
            order = batch["ord"].to_numpy()
            for i in range(len(names)):
                at = np.concatenate([best[i], order[_bits(batch, i)]])
                best[i] = np.sort(at[:k] if len(at) <= k else np.partition(at, k - 1)[:k])
        yield pd.DataFrame([(i, int(a)) for i, own in enumerate(best) for a in own], columns=["pos", "at"])

    found = df.select(order.cast("bigint").alias("ord"), *_masks(names, tests)).mapInPandas(keep, "pos int, at bigint")
    rank = F.row_number().over(Window.partitionBy("pos").orderBy("at"))
    labels = F.array(*[F.lit(c) for c in names])
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select(F.element_at(labels, F.col("pos") + 1).alias("column"), "at", "rank"))


def gap_moments(df: DataFrame, stamps: dict[str, Column]) -> DataFrame:
    """(column, n, mean_gap, std_gap) in seconds between consecutive sorted timestamps.

    Equal timestamps are counted before the ordering, so a very common one is a single row
    there; their gaps of zero add nothing to the sum of squares.
    """
    names = list(stamps)
    micros = df.select(*[F.unix_micros(stamps[c].cast("timestamp")).alias(f"t{i}")
                         for i, c in enumerate(names)])
    pairs = micros.unpivot([], [f"t{i}" for i in range(len(names))], "pos", "us")
    distinct = (pairs.where("us IS NOT NULL")
                .groupBy("pos", "us").agg(F.count(F.lit(1)).alias("copies")))
    ranged = distinct.repartitionByRange("pos", "us").sortWithinPartitions("pos", "us")

    def summarise(batches):
        seen: dict = {}  # per column: rows, first, last, sum of squared gaps
        for batch in batches:
            for pos, rows in batch.groupby("pos", sort=False):
                us = rows["us"].to_numpy()
                gaps = np.diff(us) / 1e6
                s = seen.setdefault(pos, [0, int(us[0]), None, 0.0])
                if s[2] is not None:
                    s[3] += ((int(us[0]) - s[2]) / 1e6) ** 2
                s[0] += int(rows["copies"].sum())
                s[2] = int(us[-1])
                s[3] += float((gaps * gaps).sum())
        if seen:
            part = TaskContext.get().partitionId()
            yield pd.DataFrame([(part, p, *s) for p, s in seen.items()],
                               columns=["part", "pos", "n", "first", "last", "squares"])

    parts = ranged.mapInPandas(
        summarise, "part int, pos string, n bigint, first bigint, last bigint, squares double")
    previous = F.lag("last").over(Window.partitionBy("pos").orderBy("part"))
    bridge = (F.col("first") - previous) / F.lit(1e6)
    total = parts.withColumn("bridge", F.coalesce(bridge * bridge, F.lit(0.0))).groupBy("pos").agg(
        F.sum("n").alias("n"),
        ((F.max("last") - F.min("first")) / F.lit(1e6)).alias("span"),
        (F.sum("squares") + F.sum("bridge")).alias("squares"))
    gaps = F.col("n") - 1
    mean = F.try_divide(F.col("span"), gaps)
    spread = F.greatest(F.col("squares") - gaps * mean * mean, F.lit(0.0))
    labels = F.array(*[F.lit(c) for c in names])
    at = F.substring("pos", 2, 10).cast("int") + 1
    return total.select(
        F.element_at(labels, at).alias("column"), "n", mean.alias("mean_gap"),
        F.sqrt(F.try_divide(spread, gaps - 1)).alias("std_gap"))
