"""Plain profile of a table: counts, warnings, outlier counts and chart data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.histogram import histograms
from ..functions.values import few_distinct, top_values, value_counts
from ..functions.wording import WARNING
from ..sources.table import Table, ref
from .profile import quartiles
from .quality import duplicate_facts

OUTLIER_MIN_VALUES = 4
CHART_COLUMNS = 3
CHART_BINS = 20
BAR_COLUMNS = 2
BAR_VALUES = 10
BAR_MAX_DISTINCT = 20


def basic_profile(table: Table) -> DataFrame:
    """(column, dtype, missing) for every column, with the table's size on each row."""
    types = {f.name: f.dataType.simpleString() for f in table.df.schema.fields}
    extra = duplicate_facts(table)["exact_count"]
    rows = [(c, types[c], table.missing_count(c), table.rows, len(table.columns), extra)
            for c in table.columns]
    return table.frame(rows, """column string, dtype string, missing_values bigint, rows bigint,
        columns bigint, duplicate_rows bigint""")


def single_valued(table: Table) -> list[str]:
    """Columns with exactly one distinct value, nulls aside: those whose extremes agree."""
    facts, out, texts = table.facts(), set(), []
    for c in table.columns:
        if not table.count(c) or table.is_nested(c):
            continue
        if ("min", c) in facts:
            if facts["same", c]:
                out.add(c)
        elif not table.is_string(c) or facts["min_chars", c] == facts["max_chars", c]:
            texts.append(c)
    if texts:
        seen = table.aggregate({("one", c): F.min(ref(c)) == F.max(ref(c)) for c in texts})
        out.update(c for c in texts if seen["one", c])
    return [c for c in table.columns if c in out]


def warning_texts(table: Table) -> list[str]:
    """Warnings in order: duplicates, missing values, single-valued columns."""
    texts = []
    extra = duplicate_facts(table)["exact_count"]
    if extra:
        texts.append(WARNING["duplicates"].format(n=extra))
    for c in table.columns:
        n = table.missing_count(c)
        if n:
            pct = n / table.rows * 100
            text = WARNING["many_missing" if pct > 30 else "some_missing"]
            texts.append(text.format(column=c, n=n, pct=pct))
    texts += [WARNING["one_value"].format(column=c) for c in single_valued(table)]
    return texts


def warnings(table: Table) -> DataFrame:
    return table.frame(list(enumerate(warning_texts(table))), "ordinal bigint, warning string")


def outlier_counts(table: Table) -> DataFrame:
    """(column, outliers) beyond the quartile fences, number columns that have any."""
    columns = [c for c in table.number_columns if table.count(c) >= OUTLIER_MIN_VALUES]
    want = {}
    for c, (q1, _, q3) in quartiles(table, columns).items():
        x, reach = table.number(c), 1.5 * (q3 - q1)
        want["beyond", c] = F.count_if((x < F.lit(q1 - reach)) | (x > F.lit(q3 + reach)))
    found = table.aggregate(want) if want else {}
    return table.frame([(c, n) for (_, c), n in found.items() if n], "column string, outliers bigint")


def missing_chart(table: Table) -> DataFrame:
    counts = [(c, table.missing_count(c)) for c in table.columns]
    return table.frame([(c, n) for c, n in counts if n], "column string, missing_count bigint")


def chart_columns(table: Table) -> list[str]:
    return [c for c in table.number_columns if "id" not in c.lower()][:CHART_COLUMNS]


def number_histograms(table: Table) -> DataFrame:
    """Histograms of the first number columns not named as ids, with a whole-number mark."""
    columns = chart_columns(table)
    whole = {}
    if columns:
        whole = table.aggregate({("whole", c): F.bool_and(table.number(c) == F.floor(table.number(c)))
                                 for c in columns})
    marks = table.frame([(c, whole["whole", c]) for c in columns], "column string, whole_numbers boolean")
    return histograms(table, columns, CHART_BINS).join(F.broadcast(marks), "column", "left")


def date_like(table: Table, columns=None) -> dict[str, bool]:
    """Whether every value of a text column parses as a date."""
    columns = table.string_columns if columns is None else columns
    if not columns:
        return {}
    seen = table.aggregate({("stamps", c): F.count(table.stamp(c)) for c in columns})
    return {c: seen["stamps", c] == table.count(c) for c in columns}


def date_like_frame(table: Table) -> DataFrame:
    return table.frame(list(date_like(table).items()), "column string, date_like boolean")


def value_charts(table: Table) -> DataFrame:
    """Ten most common values of the first text columns with few values that are not dates."""
    few = few_distinct(table, table.string_columns, BAR_MAX_DISTINCT)
    dates = date_like(table, [c for c in table.string_columns if c in few])
    columns = [c for c in table.string_columns if c in few and not dates[c]][:BAR_COLUMNS]
    if not columns:
        return table.frame([], "column string, rank bigint, value string, count bigint")
    top = top_values(value_counts(table, columns), BAR_VALUES)
    return top.select("column", "rank", "value", F.col("n").alias("count"))
