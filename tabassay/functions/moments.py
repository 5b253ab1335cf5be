"""Spread, shape and correlation from plain sums around known means.

Sums of powers of (x - mean) stay inside generated code for any number of columns, where
Spark's own higher-moment aggregates do not, and give each statistic from one scan.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.table import Table


def number_moments(table: Table, columns) -> dict:
    """{column: {n, mean, std, skewness, kurtosis, g1, g2}}.

    skewness and kurtosis are bias-corrected; g1 and g2 are the population forms.
    """
    def compute():
        kept = [c for c in table.columns
                if (table.is_number(c) or table.is_boolean(c)) and table.count(c)]
        want = {}
        for c in kept:
            d = table.number(c) - F.lit(table.facts()["mean", c])
            want[2, c], want[3, c], want[4, c] = F.sum(d * d), F.sum(d * d * d), F.sum(d * d * d * d)
        sums = table.aggregate(want) if want else {}
        return {c: _shape(table, c, [sums[k, c] for k in (2, 3, 4)]) for c in kept}
    moments = table.once("moments", compute)
    return {c: moments[c] for c in columns if c in moments}


def _shape(table, c, sums):
    facts = table.facts()
    n, mean = table.count(c), facts["mean", c]
    s2, s3, s4 = sums
    constant = facts["same", c]
    if constant:
        s2 = s3 = s4 = 0.0
    out = {"n": n, "mean": mean, "s2": s2, "g1": None, "g2": None,
           "std": math.sqrt(s2 / (n - 1)) if n > 1 else None,
           "skewness": None, "kurtosis": None}
    if s2 > 0:
        g1 = (s3 / n) / (s2 / n) ** 1.5
        g2 = (s4 / n) / (s2 / n) ** 2 - 3
        out["g1"], out["g2"] = g1, g2
        if n >= 3:
            out["skewness"] = g1 * math.sqrt(n * (n - 1)) / (n - 2)
        if n >= 4:
            out["kurtosis"] = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    else:
        out["skewness"] = 0.0 if n >= 3 else None
        out["kurtosis"] = 0.0 if n >= 4 else None
    return out


def normality(n, g1, g2):
    """p-value of the D'Agostino-Pearson omnibus test (skewness test + kurtosis test)."""
    if g1 is None or n < 8:
        return None
    # Skewness, D'Agostino 1970.
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2))) or 1.0
    beta = (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
            / ((n - 2) * (n + 5) * (n + 7) * (n + 9)))
    w2 = -1 + math.sqrt(2 * (beta - 1))
    scaled = y / math.sqrt(2 / (w2 - 1))
    z_skew = math.asinh(scaled) / math.sqrt(0.5 * math.log(w2))
    # Kurtosis, Anscombe and Glynn 1983.
    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 + 3 - expected) / math.sqrt(variance)
    root = (6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
            * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))))
    a = 6 + 8 / root * (2 / root + math.sqrt(1 + 4 / root ** 2))
    d = 1 + x * math.sqrt(2 / (a - 4))
    if d == 0:
        return None
    cube = math.copysign(((1 - 2 / a) / abs(d)) ** (1 / 3), d)
    z_kurt = (1 - 2 / (9 * a) - cube) / math.sqrt(2 / (9 * a))
    return math.exp(-(z_skew ** 2 + z_kurt ** 2) / 2)


def correlation_frame(table: Table) -> DataFrame:
    """(a, b, r): Pearson r of every pair of number columns, by their places in the table with a < b,
    over the rows where both are present; NULL where it does not exist. Staged, never on the driver."""
    return table.once("correlations", lambda: table.stage(_correlations(table), "correlations"))


def _correlations(table):
    columns = table.number_columns
    shape = number_moments(table, columns)
    place = {c: i for i, c in enumerate(columns)}
    live = [c for c in columns if c in shape]
    sums = pair_sums(table, live, {c: shape[c]["mean"] for c in live})
    n, x, y, xx, yy, xy = (F.col(k) for k in PAIR)
    vx, vy = xx - x * x / n, yy - y * y / n
    # Constant on the shared rows: nothing left but rounding.
    varied = (n >= 2) & (vx > 1e-13 * xx) & (vy > 1e-13 * yy)
    r = F.try_divide(xy - x * y / n, F.sqrt(vx) * F.sqrt(vy))
    at = F.array(*[F.lit(place[c]) for c in live]) if live else F.array().cast("array<int>")
    return sums.select(F.element_at(at, F.col("a") + 1).alias("a"), F.element_at(at, F.col("b") + 1).alias("b"),
                       F.when(varied, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


PAIR = ("n", "x", "y", "xx", "yy", "xy")
TILE = 64         # columns of a tile
TILE_PAIRS = 192  # summed by one scan: at most 40 MB in a task


def pair_sums(table: Table, live, means) -> DataFrame:
    """(a, b, n, x, y, xx, yy, xy) of every pair of columns: rows where both are present, and their sums,
    squares and product around the means.

    The Gram matrix is cut into tiles of columns. A task multiplies its blocks of rows tile by tile and
    emits six sums per pair, which Spark adds up; a scan serves TILE_PAIRS tiles and reads only their
    columns, so memory in a task is bounded for any number of columns.
    """
    tiles = [list(range(i, min(i + TILE, len(live)))) for i in range(0, len(live), TILE)]
    wanted = [(i, j) for i in range(len(tiles)) for j in range(i, len(tiles))]
    parts = [_tile_sums(table, live, means, tiles, wanted[k:k + TILE_PAIRS]) for k in range(0, len(wanted), TILE_PAIRS)]
    if not parts:
        return table.frame([], "a int, b int, " + ", ".join(f"{k} double" for k in PAIR))
    return reduce(lambda one, more: one.unionByName(more), parts)


def _tile_sums(table, live, means, tiles, wanted):
    used = sorted({t for pair in wanted for t in pair})
    columns = [c for t in used for c in tiles[t]]
    centred = [(table.number(live[i]) - F.lit(means[live[i]])).alias(f"c{i}") for i in columns]
    start = {t: sum(len(tiles[u]) for u in used if u < t) for t in used}

    def multiply(batches):
        totals = {pair: np.zeros((6, len(tiles[pair[0]]), len(tiles[pair[1]]))) for pair in wanted}
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            present = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            squares = x * x
            cut = {t: slice(start[t], start[t] + len(tiles[t])) for t in used}
            for (i, j), total in totals.items():
                p, q = cut[i], cut[j]
                total += [present[:, p].T @ present[:, q], x[:, p].T @ present[:, q], present[:, p].T @ x[:, q],
                          squares[:, p].T @ present[:, q], present[:, p].T @ squares[:, q], x[:, p].T @ x[:, q]]
        for (i, j), total in totals.items():
            a, b = np.triu_indices(len(tiles[i]), 1) if i == j else [k.ravel() for k in np.indices(total.shape[1:])]
            if len(a):
                yield pd.DataFrame({"a": a + tiles[i][0], "b": b + tiles[j][0], **dict(zip(PAIR, total[:, a, b]))})

    ddl = "a int, b int, " + ", ".join(f"{k} double" for k in PAIR)
    return (table.df.select(*centred).mapInPandas(multiply, ddl).groupBy("a", "b")
            .agg(*[F.sum(k).alias(k) for k in PAIR]))
