"""Isolation forest (Liu, Ting and Zhou 2008) over the numeric columns of a table.

All chance comes from MD5 digests: a row's draw in a tree from its row id, the split column and
the cut of a node from (seed, tree, slot). So a forest depends on the rows and not on their
partitioning, and plain SQL grows the same one. Trees grow in parallel, one task group of at most
256 rows each. A forest is 100 trees of at most 511 nodes whatever the table, so it is broadcast;
rows are scored where they are. Path lengths are whole multiples of 2**-24, so their sums are exact
and rows that fall into the same leaves have the same score.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.wording import RANGE
from ..sources.table import Table, ref
from .profile import quartiles
from .types import of_type

TREES = 100
SAMPLE = 256
SEED = 42
MAX_MISSING = 0.20
MIN_ROWS = 10
HIGH_SCORE = 0.7
DIGITS = 13  # hexadecimal digits of a digest that make a fraction: 52 bits, exact as a double
PRIME = 2 ** 31 - 1
GRID = 2 ** 24
EULER = 0.5772156649


def forest_columns(table: Table) -> list[str]:
    """Numeric columns with few enough gaps to impute."""
    return [c for c in of_type(table, "numeric")
            if table.rows and table.missing_count(c) / table.rows <= MAX_MISSING]


def features(table: Table, columns) -> DataFrame:
    """(row_id, f0, f1, ...) with gaps filled by column medians."""
    medians = {c: q[1] for c, q in quartiles(table, columns).items()}
    filled = [F.coalesce(table.number(c), F.lit(medians[c])).alias(f"f{i}")
              for i, c in enumerate(columns)]
    return table.df.select(ref(table.row_id).alias("row_id"), *filled)


def mean_path(m) -> float:
    """Average path length of an unsuccessful search among m points."""
    if m <= 1:
        return 0.0
    return 1.0 if m == 2 else 2 * (math.log(m - 1) + EULER) - 2 * (m - 1) / m


def fraction(text: str, at: int = 0) -> float:
    """A number from 0 to 1, below 1, of the digest of a text."""
    return int(hashlib.md5(text.encode()).hexdigest()[at:at + DIGITS], 16) / 16 ** DIGITS


def _digits(digest, start, n):
    return F.conv(F.substring(digest, start, n), 16, 10).cast("long")


def _line(seed, tree) -> tuple[int, int]:
    """Slope and shift of a tree's draws modulo PRIME."""
    return 1 + int(fraction(f"{seed}:{tree}:slope") * (PRIME - 1)), int(fraction(f"{seed}:{tree}:shift") * PRIME)


def fit(table: Table, columns, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED):
    """(feature, threshold, path) arrays of the trees in complete-binary-tree order.

    A row's draw in a tree is a line over one number of the row's digest; the rows with the
    least draws are the tree's sample.
    """
    matrix = features(table, columns)
    size = min(sample, table.rows)
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    # Thin twice before the rows meet the trees: a pool shared by all trees, then each tree's
    # share of it. The share leaves far more than the sample, and the least draws.
    pool = trees * 4 * sample
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string")).cast("binary"))
    rows = matrix.withColumn("digest", digest)
    if table.rows > pool:
        rows = rows.where(_digits(F.col("digest"), 1, DIGITS) / F.lit(float(16 ** DIGITS)) < F.lit(pool / table.rows))
    rows = rows.withColumn("number", _digits(F.col("digest"), 17, 8) % PRIME).drop("digest")
    most = min(1.0, 4 * sample / min(table.rows, pool)) * PRIME
    lines = [_line(seed, t) for t in range(trees)]
    draws = F.array(*[F.struct(F.lit(t).alias("tree"), ((F.col("number") * a + b) % PRIME).alias("draw")) for t, (a, b) in enumerate(lines)])
    drawn = rows.select("*", F.explode(draws).alias("t")).select("*", "t.tree", "t.draw").where(F.col("draw") < most)
    order = Window.partitionBy("tree").orderBy("draw", "row_id")
    samples = drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= size)
    names = [f"f{i}" for i in range(len(columns))]

    def grow(key, pdf):
        data = pdf.sort_values("row_id")[names].to_numpy(dtype=float)
        feature, threshold, path = _grow(data, depth, f"{seed}:{int(key[0])}")
        return pd.DataFrame({"tree": [int(key[0])], "rows": [len(data)], "feature": [feature.tolist()],
                             "threshold": [threshold.tolist()], "path": [path.tolist()]})

    grown = samples.groupBy("tree").applyInPandas(
        grow, "tree int, rows int, feature array<int>, threshold array<double>, path array<bigint>")
    forest = sorted(grown.collect(), key=lambda r: r["tree"])
    stack = lambda name, kind: np.array([r[name] for r in forest], dtype=kind)
    return stack("feature", np.int32), stack("threshold", float), stack("path", np.int64), [r["rows"] for r in forest]


def _grow(data, depth, name):
    """One tree: inner slots hold a split, bottom slots the path length that ends there, in units of 1 / GRID.

    A branch that ends early keeps an always-left split down to the bottom.
    """
    inner = 2 ** depth - 1
    feature = np.zeros(inner, dtype=np.int32)
    threshold = np.full(inner, np.inf)
    path = np.zeros(2 ** depth, dtype=np.int64)
    todo = [(0, 0, np.arange(len(data)))]
    while todo:
        slot, level, rows = todo.pop()
        block = data[rows]
        spread = np.flatnonzero(block.max(axis=0) > block.min(axis=0)) if len(rows) > 1 else []
        if level == depth or not len(spread):
            first = (slot + 1 << depth - level) - 1 - inner
            path[first:first + 2 ** (depth - level)] = round((level + mean_path(len(rows))) * GRID)
            continue
        f = int(spread[int(fraction(f"{name}:{slot}") * len(spread))])
        low, high = block[:, f].min(), block[:, f].max()
        cut = low + fraction(f"{name}:{slot}", DIGITS) * (high - low)
        feature[slot], threshold[slot] = f, cut
        right = block[:, f] > cut
        todo.append((2 * slot + 2, level + 1, rows[right]))
        todo.append((2 * slot + 1, level + 1, rows[~right]))
    return feature, threshold, path


def score_rows(matrix: DataFrame, forest, width: int) -> DataFrame:
    """Add score = 2^(-mean path / average path) to feature rows."""
    shared = matrix.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        feature, threshold, path, sizes = shared.value
        depth = int(math.log2(path.shape[1]))
        scale = sum(map(mean_path, sizes))  # of the rows that each tree has
        for columns in batches:
            n = len(columns[0])
            flat = np.concatenate([c.to_numpy(dtype=float) for c in columns])
            base = np.arange(n)
            total = np.zeros(n, dtype=np.int64)
            for t in range(len(feature)):
                at = np.zeros(n, dtype=np.int64)
                for _ in range(depth):
                    x = flat.take(feature[t].take(at) * n + base)
                    at = 2 * at + 1 + (x > threshold[t].take(at))
                total += path[t].take(at - (2 ** depth - 1))
            yield pd.Series(np.exp2(-total / GRID / scale))

    return matrix.withColumn("score", score(*[F.col(f"f{i}") for i in range(width)]))


def forest_scores(table: Table) -> DataFrame | None:
    """(row_id, f0.., score) of every row, staged once; None when the forest does not apply."""
    return table.once("forest", lambda: _forest_scores(table))


def _forest_scores(table):
    columns = forest_columns(table)
    if len(columns) < 2 or table.rows < MIN_ROWS:
        return None
    forest = fit(table, columns)
    matrix = features(table, columns)
    # Scoring is CPU work: a source of few files is dealt over the cores that are there.
    cores = table.spark.sparkContext.defaultParallelism
    if len(table.raw.inputFiles()) < cores:
        matrix = matrix.repartition(cores)
    return table.stage(score_rows(matrix, forest, len(columns)), "scores")


def forest_records(table: Table, contamination: float = 0.05) -> DataFrame:
    """The ``contamination`` share of rows with the highest scores, one record each."""
    scored = forest_scores(table)
    ddl = """row_id bigint, column string, method_used string, anomaly_score double,
        severity string, raw_value double, lower double, upper double, expected_range string,
        primary_driver_feature string"""
    if scored is None:
        return table.frame([], ddl)
    columns = forest_columns(table)
    cut = exact_quantiles(scored.select("score"), {"score": table.rows}, [1 - contamination],
                          table.sort_limit)["score"][0]
    flagged = F.col("score") > F.lit(cut)
    aggs = [F.min("score").alias("low"), F.max("score").alias("high"),
            F.count_if(flagged).alias("n")]
    for i in range(len(columns)):
        x = F.col(f"f{i}")
        aggs += [F.avg(F.when(flagged, x)).alias(f"in{i}"), F.avg(F.when(~flagged, x)).alias(f"out{i}"),
                 F.avg(x).alias(f"mean{i}"), F.stddev(x).alias(f"std{i}")]
    seen = scored.agg(*aggs).first()
    if not seen["n"]:
        return table.frame([], ddl)

    shift = [abs(seen[f"in{i}"] - seen[f"out{i}"]) / (abs(seen[f"out{i}"]) + 1e-9)
             for i in range(len(columns))]
    driver = max(range(len(columns)), key=lambda i: (shift[i], -i))
    mean, std = seen[f"mean{driver}"], seen[f"std{driver}"]
    low, high = mean - 3 * std, mean + 3 * std
    text = RANGE["forest"].format(low=low, high=high, column=columns[driver])
    score = (F.col("score") - F.lit(seen["low"])) / F.lit(seen["high"] - seen["low"] + 1e-10)
    return scored.where(flagged).select(
        "row_id", F.lit("multivariate").alias("column"),
        F.lit("isolation_forest").alias("method_used"), score.alias("anomaly_score"),
        F.when(score >= HIGH_SCORE, "high").otherwise("moderate").alias("severity"),
        F.col(f"f{driver}").alias("raw_value"), F.lit(low).alias("lower"), F.lit(high).alias("upper"),
        F.lit(text).alias("expected_range"), F.lit(columns[driver]).alias("primary_driver_feature"))
