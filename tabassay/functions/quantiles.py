"""Exact quantiles of many columns at any size.

One route for any table: a mergeable sketch (KLL) of every column gives edges around each wanted
order statistic, wide enough for its rank error. The next scan counts the values below, at and between
the edges and keeps the distinct ones between a pair of edges, so that the statistic is an edge or is
found among those in order. A sketch grows with its column until an interval holds few values; an
interval that is still too large, or a statistic that a sketch misplaced, is closed in again by a sketch
of its own values. So two scans serve any number of columns up to some fifty million rows, and each
further factor of a hundred takes two more. The sketch only decides how fast this goes: the result is
exact whatever it says, and a value repeated any number of times is one edge or one kept value. A buffer
holds a sketch of about 100 kB per column, 800 kB at most; kept values are grouped and sorted by Spark.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.table import ref, small_frame

SKETCH_SIZE = 4096       # least and largest: about 24 bytes of a buffer for each
LARGEST_SKETCH = 32_768
SORT_LIMIT = 100_000  # values of an interval that are kept and sorted
EVERYTHING = (None, None)


def exact_quantiles(df: DataFrame, counts: dict[str, int], probs: list[float],
                    sort_limit: int = SORT_LIMIT, sketch_size: int | None = None, first_edges=None) -> dict:
    """{column: [quantile per prob]} with linear interpolation; ``df`` holds DOUBLE columns.

    ``counts`` are the non-null counts, known from an earlier aggregate. ``first_edges`` evaluates
    the first ``edge_requests`` (with other aggregates of the same scan, say). Without a
    ``sketch_size`` it follows from the number of values.
    """
    columns = [c for c, n in counts.items() if n > 0]
    out = {c: [None] * len(probs) for c in counts}
    if not columns:
        return out
    positions = {c: [(counts[c] - 1) * p for p in probs] for c in columns}
    values = _order_statistics(df, _first_spans(counts, probs), sort_limit, sketch_size, first_edges)
    for c in columns:
        for i, at in enumerate(positions[c]):
            a, b = values[c, math.floor(at)], values[c, math.ceil(at)]
            out[c][i] = a + (b - a) * (at - math.floor(at))
    return out


def _first_spans(counts, probs):
    """Open intervals holding wanted ranks: (column, low, high) -> (ranks, before, inside)."""
    wanted = {c: {k for p in probs for k in (math.floor((n - 1) * p), math.ceil((n - 1) * p))} for c, n in counts.items() if n > 0}
    return {(c, *EVERYTHING): (sorted(ranks), 0, counts[c]) for c, ranks in wanted.items()}


def edge_requests(counts: dict[str, int], probs: list[float], column, sort_limit: int = SORT_LIMIT,
                  sketch_size: int | None = None) -> dict:
    """Aggregates of the first round, for columns that need one; ``column`` gives a column's values."""
    large = {k: s for k, s in _first_spans(counts, probs).items() if s[2] > sort_limit}
    return _edge_requests(large, sketch_size, column)


def _order_statistics(df, spans, sort_limit, sketch_size, first_edges):
    """{(column, rank): value} for zero-based ranks among a column's non-null values."""
    values: dict = {}
    while spans:
        large = {k: s for k, s in spans.items() if s[2] > sort_limit}
        edges, kept = _edges(df, spans, large, sort_limit, sketch_size, first_edges)
        found, spans = _place(df, spans, edges, kept)
        values.update(found)
        first_edges = None
    return values


def _within(x, low, high):
    test = x.isNotNull()
    if low is not None:
        test = test & (x > F.lit(low))
    if high is not None:
        test = test & (x < F.lit(high))
    return test


def _rank_slack(sketch_size):
    return 3 * 2.296 / sketch_size ** 0.9021  # three times the sketch's stated rank error


def _fitting_size(inside):
    """The sketch whose intervals hold a quarter of SORT_LIMIT of so many values, within bounds."""
    wanted = (3 * 2.296 * 2 * 4 * inside / SORT_LIMIT) ** (1 / 0.9021)
    return max(SKETCH_SIZE, min(LARGEST_SKETCH, math.ceil(wanted)))


def _edge_requests(spans, sketch_size, column=ref):
    """{key: array of values a bit below and above the wanted ranks} for each interval."""
    made = {}
    for (c, low, high), (ranks, before, inside) in spans.items():
        size = sketch_size or _fitting_size(inside)
        slack = _rank_slack(size)
        pairs: list = []
        for r in ranks:
            middle = (r - before + 0.5) / inside
            if pairs and middle - slack - pairs[-1][0] < slack / 50:  # next rank of the same pair
                pairs[-1] = (pairs[-1][0], middle + slack)
            else:
                pairs.append((middle - slack, middle + slack))
        cuts = sorted({min(max(p, 0.0), 1.0) for pair in pairs for p in pair})
        x = column(c)
        sketch = F.kll_sketch_agg_double(F.when(_within(x, low, high), x), F.lit(size))
        made["edges", c, low, high, *cuts] = F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, cuts)))
    return made


def _edges(df, spans, large, sort_limit, sketch_size, first_edges):
    """{column: ascending distinct edges} around the wanted ranks, ends of intervals included, and
    {column: intervals whose values are kept}: the small ones, and those between edges that are near
    enough by the sketch."""
    asked = _edge_requests(large, sketch_size)
    if not asked:
        found = {}
    elif first_edges is None:
        row = df.agg(*[e.alias(f"e{i}") for i, e in enumerate(asked.values())]).first()
        found = dict(zip(asked, row))
    else:
        found = first_edges(asked)
    edges: dict = {c: set() for c, _, _ in spans}
    kept: dict = {c: [] for c in edges}
    for c, low, high in spans:
        edges[c].update(e for e in (low, high) if e is not None)
        if (c, low, high) not in large:
            kept[c].append((low, high))
    for (_, c, low, high, *cuts), marks in found.items():
        edges[c].update(marks)
        inside = large[c, low, high][2]
        kept[c] += [(a, b) for a, b, p, q in zip(marks, marks[1:], cuts, cuts[1:]) if (q - p) * inside <= sort_limit]
    return {c: sorted(marks) for c, marks in edges.items()}, kept


def _place(df, spans, edges, kept):
    """Values of the wanted ranks that are edges or kept, and the intervals that hold the others.

    A value's place is the number of edges it has reached plus the number it has passed: even between
    edges, odd at one. Values are counted by place, and by themselves where they are kept; running
    sums in the order of places and values give their ranks. The edges ride along as a broadcast
    row per column, so the generated code stays small for any number of columns.
    """
    width = max(len(marks) for marks in edges.values())
    padded = []
    for c, marks in edges.items():
        gaps = zip([None, *marks], [*marks, None])
        keep = [any(_covers(span, gap) for span in kept[c]) for gap in gaps]  # by place // 2
        padded.append((c, keep, *marks, *[None] * (width - len(marks))))
    ddl = ", ".join(["column string", "keep array<boolean>", *[f"e{i} double" for i in range(width)]])
    known = small_frame(df.sparkSession, padded, ddl)
    pairs = df.select(*[ref(c) for c in edges]).unpivot([], [ref(c) for c in edges], "column", "x")
    x, place = F.col("x"), F.lit(0)
    for i in range(width):
        e = F.col(f"e{i}")
        place = place + F.when(x > e, 2).when(x == e, 1).otherwise(0)
    placed = pairs.where("x IS NOT NULL").join(F.broadcast(known), "column").select("column", "x", "keep", place.alias("place"))
    between = (F.col("place") % 2 == 0) & F.get("keep", F.shiftright("place", 1))
    counts = (placed.select("column", "place", F.when(between, x).alias("x"))
              .groupBy("column", "place", "x").agg(F.count(F.lit(1)).alias("n")))
    upto = Window.partitionBy("column").orderBy("place", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = small_frame(df.sparkSession, [(c, r) for (c, _, _), s in spans.items() for r in s[0]], "column string, rank bigint")
    rows = (counts.withColumn("upto", F.sum("n").over(upto)).join(F.broadcast(ranks), "column")
            .where("rank < upto AND rank >= upto - n").select("column", "rank", "place", "x", "n", "upto").collect())
    values, rest = {}, {}
    for r in rows:
        c, at, marks = r["column"], r["place"] // 2, edges[r["column"]]
        if r["place"] % 2:
            values[c, r["rank"]] = marks[at]
        elif r["x"] is not None:
            values[c, r["rank"]] = r["x"]
        else:
            key = (c, marks[at - 1] if at else None, marks[at] if at < len(marks) else None)
            known_ranks = rest.get(key, ([],))[0]
            rest[key] = (sorted([*known_ranks, r["rank"]]), r["upto"] - r["n"], r["n"])
    return values, rest


def _covers(span, gap):
    (low, high), (a, b) = span, gap
    return (low is None or (a is not None and a >= low)) and (high is None or (b is not None and b <= high))
