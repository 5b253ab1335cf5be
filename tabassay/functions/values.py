"""Value counts, distinct counts and row identity.

All counting is two-stage (map-side partial sums, then one shuffle), so a value or a row
that makes up any share of the table arrives as one record per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.table import Table, ref

LONG_TEXT = 64


def value_counts(table: Table, columns, df: DataFrame | None = None) -> DataFrame:
    """(column, value, n) over the non-null values of the given columns, as text."""
    df = table.df if df is None else df
    cells = df.select(*[table.text(c).alias(c) for c in columns])
    pairs = cells.unpivot([], [ref(c) for c in columns], "column", "value")
    return (pairs.where("value IS NOT NULL")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """(column, value, n, rank): the k most common values per column, ties by value."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def distinct_counts(table: Table, columns) -> dict[str, int]:
    """Exact distinct non-null values per column.

    Whole numbers are bits of 64-wide words, so that near ones share a row of the shuffle; a word
    holds at least one value, so scattered ones take no more rows than they are. Long texts are
    compared by SHA-256 so that the shuffle carries short keys.
    """
    known = table.once("distinct", dict)
    todo = [c for c in columns if c not in known]
    whole = [c for c in todo if isinstance(table.schema[c], T.IntegralType)]
    other = [c for c in todo if c not in whole]
    counted = []
    if whole:
        pairs = (table.df.select(*[ref(c).cast("bigint").alias(c) for c in whole])
                 .unpivot([], [ref(c) for c in whole], "column", "value").where("value IS NOT NULL"))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("value").bitwiseAND(63).cast("int"))
        words = pairs.groupBy("column", F.shiftright("value", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
        counted.append(words.groupBy("column").agg(F.sum(F.bit_count("bits")).alias("n")))
    if other:
        short = [_short(table.text(c)).alias(c) for c in other]
        pairs = table.df.select(*short).unpivot([], [ref(c) for c in other], "column", "value")
        counted.append(pairs.where("value IS NOT NULL").distinct()
                       .groupBy("column").agg(F.count(F.lit(1)).alias("n")))
    if counted:
        found = reduce(DataFrame.unionByName, counted).collect()
        known.update({r["column"]: r["n"] for r in found})
    return {c: known.get(c, 0) for c in columns}


def _short(x: Column) -> Column:
    return F.when(F.length(x) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(x, 256))).otherwise(x)


def few_distinct(table: Table, columns, bound: int) -> dict[str, int]:
    """Exact distinct counts of just those columns that have at most ``bound`` values."""
    found = distinct_counts(table, few_candidates(table, columns, bound))
    return {c: n for c, n in found.items() if n <= bound}


def few_candidates(table: Table, columns, bound: int) -> list[str]:
    """Columns that may have at most ``bound`` values.

    A sketch drops columns that cannot: with d distinct values at most d registers of the
    sketch are set, so its estimate stays near d for small d.
    """
    seen = table.aggregate(few_requests(columns))
    return [c for c in columns if seen["about", c] <= 2 * bound + 20]


def few_requests(columns) -> dict:
    return {("about", c): F.approx_count_distinct(ref(c)) for c in columns}


def row_key(table: Table, columns, alias: str = "key") -> Column:
    """128-bit identity of a row over ``columns``; NULL equals NULL.

    Two chained 64-bit hashes with different starting points; null marks are hashed along,
    because Spark's hash skips nulls.
    """
    parts = []
    for c in columns:
        x = F.array_sort(F.map_entries(ref(c))) if isinstance(table.schema[c], T.MapType) else ref(c)
        parts += [F.isnull(ref(c)), x]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"),
                    F.xxhash64(F.lit(2), *parts).alias("b")).alias(alias)
