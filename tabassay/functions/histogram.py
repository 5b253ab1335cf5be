"""Equal-width histograms of several columns in one scan and one small shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.table import Table, ref


def histograms(table: Table, columns, bins: int) -> DataFrame:
    """(position, column, bin, low, high, count), empty bins included; the top edge is closed."""
    ddl = "position bigint, column string, bin bigint, low double, high double"
    filled = [c for c in columns if table.count(c)]
    edges, marks = [], []
    for i, c in enumerate(filled):
        low, high = table.facts()["min", c], table.facts()["max", c]
        if low == high:
            low, high = low - 0.5, high + 0.5
        width = (high - low) / bins
        edges += [(i, c, b, low + b * width, low + (b + 1) * width) for b in range(bins)]
        place = F.floor((table.number(c) - F.lit(low)) / F.lit(high - low) * bins)
        inside = F.when(table.number(c).isNotNull(), F.least(place, F.lit(bins - 1)))
        marks.append(inside.cast("bigint").alias(c))
    frame = table.frame(edges, ddl)
    if not filled:
        return frame.withColumn("count", F.lit(0).cast("bigint"))
    counts = (table.df.select(*marks).unpivot([], [ref(c) for c in filled], "column", "bin")
              .where("bin IS NOT NULL").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n")))
    # One row per column and bin.
    return frame.join(F.broadcast(counts), ["column", "bin"], "left").select(
        "position", "column", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("count"))
