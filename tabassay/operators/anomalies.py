"""Row-level anomalies: quartile fences, normality-gated z-scores, forest scores, consensus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import normality, number_moments
from ..functions.wording import RANGE
from ..sources.table import Table, ref
from .forest import forest_records
from .profile import quartiles
from .types import of_type

MIN_VALUES = 10
CONSENSUS_BONUS = 0.15
# Methods with their labels.
METHOD_LABELS = {"iqr": "IQR", "zscore": "Z-Score", "isolation_forest": "Isolation Forest"}
# Severities, most severe first.
SEVERITIES = ["high", "moderate", "low"]
TABLE_ROWS = 500

FLAGGED = """row_id bigint, records array<struct<column:string,method_used:string,anomaly_score:double,
    severity:string,raw_value:double,lower:double,upper:double,expected_range:string,
    primary_driver_feature:string>>"""
BOUND = ["column", "method_used", "lower", "upper", "from_low", "from_high", "scale", "start", "span",
         "moderate_at", "high_at", "expected_range"]


# -- univariate methods ---------------------------------------------------------------

def iqr_bounds(table: Table) -> list[tuple]:
    """Quartile fences: score 0 at 1.5 quartile ranges from the quartile, 1 at five."""
    columns = [c for c in of_type(table, "numeric") if table.count(c) >= MIN_VALUES]
    out = []
    for c, (q1, _, q3) in quartiles(table, columns).items():
        spread = q3 - q1
        if spread:
            low, high = q1 - 1.5 * spread, q3 + 1.5 * spread
            out.append((c, "iqr", low, high, q1, q3, spread, 1.5, 3.5, 2.0, 3.0,
                        RANGE["iqr"].format(low=low, high=high)))
    return out


def iqr_records(table: Table) -> DataFrame:
    """Values strictly outside the quartile fences."""
    return flat(_flagged_cells(table, iqr_bounds(table)))


def normality_facts(table: Table) -> dict[str, tuple]:
    """{column: (n, p-value)} for numeric columns with enough varying values."""
    shape = number_moments(table, of_type(table, "numeric"))
    return {c: (m["n"], normality(m["n"], m["g1"], m["g2"]))
            for c, m in shape.items() if m["n"] >= MIN_VALUES and m["g1"] is not None}


def normality_frame(table: Table) -> DataFrame:
    rows = [(c, n, p, p is not None and p > 0.05) for c, (n, p) in normality_facts(table).items()]
    return table.frame(rows, "column string, n bigint, p_value double, is_normal boolean")


def zscore_bounds(table: Table, threshold: float) -> list[tuple]:
    """Mean plus or minus ``threshold`` deviations, for columns that pass as normal."""
    shape = number_moments(table, of_type(table, "numeric"))
    out = []
    for c, (_, p) in normality_facts(table).items():
        mean, std = shape[c]["mean"], shape[c]["std"]
        if p is not None and p > 0.05 and std:
            low, high = mean - threshold * std, mean + threshold * std
            out.append((c, "zscore", low, high, mean, mean, std, threshold, 4.0, 0.0, threshold + 2,
                        RANGE["zscore"].format(low=low, high=high, threshold=threshold)))
    return out


def zscore_records(table: Table, threshold: float = 3.0) -> DataFrame:
    """Values more than ``threshold`` standard deviations out, in normally distributed columns."""
    return flat(_flagged_cells(table, zscore_bounds(table, threshold)))


def _flagged_cells(table: Table, bounds: list[tuple]) -> DataFrame:
    """(row_id, records) of rows that break a bound, from one scan for all columns and methods.

    Rows without any such cell are dropped first, by a predicate that parquet can use to skip row
    groups. The records of a row are an array made where the row is read: the values beside their
    bounds, at most two per column, which are a literal of the plan. No row moves.
    """
    if not bounds:
        return table.frame([], FLAGGED)
    # On the uncleaned rows, so that it reaches the scan; NaN passes here and is cleaned later.
    hit = reduce(lambda a, b: a | b, [_beyond(_plain(table, b[0]), *b[2:4]) for b in bounds])
    names = list(dict.fromkeys(b[0] for b in bounds))
    cleaned = table.raw.where(hit).select(
        ref(table.row_id).alias("row_id"), *[table._clean(c) for c in names])
    known = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(BOUND, b)]) for b in bounds])
    measured = F.zip_with(F.array(*[table.number(b[0]) for b in bounds]), known, _measure)
    records = F.transform(F.filter(measured, _broken), _record).alias("records")
    return cleaned.select(F.col("row_id").cast("bigint").alias("row_id"), records).where(F.size("records") > 0)


def _measure(x, bound):
    distance = F.greatest(bound["from_low"] - x, x - bound["from_high"]) / bound["scale"]
    return F.struct(x.alias("x"), distance.alias("k"), bound.alias("bound"))


def _broken(cell):
    x, bound = cell["x"], cell["bound"]
    return F.when(bound["method_used"] == "iqr", (x < bound["lower"]) | (x > bound["upper"])
                  ).otherwise(cell["k"] > bound["start"])


def _record(cell):
    k, bound = cell["k"], cell["bound"]
    severity = F.when(k >= bound["high_at"], "high").when(k >= bound["moderate_at"], "moderate").otherwise("low")
    return F.struct(
        bound["column"].alias("column"), bound["method_used"].alias("method_used"),
        F.least(F.lit(1.0), (k - bound["start"]) / bound["span"]).alias("anomaly_score"),
        severity.alias("severity"), cell["x"].alias("raw_value"), bound["lower"].alias("lower"),
        bound["upper"].alias("upper"), bound["expected_range"].alias("expected_range"),
        bound["column"].alias("primary_driver_feature"))


def _beyond(x, low, high):
    # A hair wider than the bounds: the exact test follows on the few rows that pass.
    slack = 1e-9 * (abs(low) + abs(high))
    return (x < F.lit(low + slack)) | (x > F.lit(high - slack))


def _plain(table, c):
    return ref(c) if table.schema[c].typeName() == "double" else table.number(c)


# -- combination ----------------------------------------------------------------------
#
# Records come in two forms: one row per record, or flagged rows (row_id, records), whose composite
# needs no shuffle. The functions below take either; flagged rows are what the scan gives.

def flagged_rows(table: Table, contamination: float = 0.05, zscore_threshold: float = 3.0,
                 methods=tuple(METHOD_LABELS)) -> DataFrame:
    """(row_id, records): every flagged row with an array of its records, one per method and column.

    The forest's rows, one record each, are joined to the others once.
    """
    bounds = (iqr_bounds(table) if "iqr" in methods else []) + (
        zscore_bounds(table, zscore_threshold) if "zscore" in methods else [])
    cells = _flagged_cells(table, bounds)
    if "isolation_forest" not in methods:
        return cells
    found = forest_records(table, contamination)
    fields = [c for c in found.columns if c != "row_id"]
    drawn = found.select(F.col("row_id").cast("bigint").alias("row_id"), F.array(F.struct(*fields)).alias("drawn"))
    none = F.array().cast(cells.schema["records"].dataType)
    return cells.join(drawn, "row_id", "full").select(
        "row_id", F.concat(F.coalesce("records", none), F.coalesce("drawn", none)).alias("records"))


def anomaly_records(table: Table, contamination: float = 0.05, zscore_threshold: float = 3.0,
                    methods=tuple(METHOD_LABELS)) -> DataFrame:
    """All records, one per row, method and column."""
    return flat(flagged_rows(table, contamination, zscore_threshold, methods))


def flat(records: DataFrame) -> DataFrame:
    """One row per record."""
    return records.select("row_id", F.inline("records")) if "records" in records.columns else records


def by_row(records: DataFrame) -> DataFrame:
    """Flagged rows; single records are put together, at most one per column and method in a row."""
    if "records" in records.columns:
        return records
    fields = [c for c in records.columns if c != "row_id"]
    return records.groupBy("row_id").agg(F.collect_list(F.struct(*fields)).alias("records"))


def _method_count():
    return F.size(F.array_distinct(F.transform("records", lambda r: r["method_used"])))


def _composite():
    best = F.array_max(F.transform("records", lambda r: r["anomaly_score"]))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), best) + CONSENSUS_BONUS * (_method_count() - 1))


def composite_scores(records: DataFrame) -> DataFrame:
    """Best score of each flagged row plus a bonus per further method, at most 1."""
    return by_row(records).select(
        "row_id", _composite().alias("composite_score"), _method_count().alias("methods"))


def with_composite(records: DataFrame) -> DataFrame:
    """Records with their row's composite score: computed inside the row, which is spread last."""
    return by_row(records).select("row_id", _composite().alias("composite_score"), F.inline("records"))


def method_summary(records: DataFrame) -> DataFrame:
    return flat(records).groupBy("method_used").agg(F.count(F.lit(1)).alias("records"))


def anomaly_panel(table: Table, records: DataFrame) -> DataFrame:
    pct = F.round(F.count(F.lit(1)) / F.lit(max(table.rows, 1)) * 100, 1)
    return by_row(records).select(F.size("records").alias("n"), _method_count().alias("methods")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("records"), F.count(F.lit(1)).alias("rows_flagged"),
        F.count_if(F.col("methods") > 1).alias("multi_method_rows"), pct.alias("flagged_pct"))


def method_label() -> Column:
    pairs = [F.lit(x) for item in METHOD_LABELS.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[F.col("method_used")], F.col("method_used"))


def anomaly_table(records: DataFrame, methods=None, severities=None, sort_by: str = "Score",
                  rows: int | None = TABLE_ROWS) -> DataFrame:
    """Record list for display: filtered, sorted, first rows (``rows=None`` for all)."""
    score = F.round("composite_score", 3)
    shown = with_composite(records).select("row_id", "column", method_label().alias("method"), "severity",
                          score.alias("score"), "raw_value", "expected_range")
    if methods is not None:
        shown = shown.where(F.col("method").isin(list(methods)))
    if severities is not None:
        shown = shown.where(F.col("severity").isin(list(severities)))
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    first = {"Score": F.desc("score"), "Row": F.asc("row_id"), "Severity": rank.asc(),
             "Method": F.asc("method")}[sort_by]
    ordered = shown.orderBy(first, "row_id", "column", "method")
    return ordered if rows is None else ordered.limit(rows)


def anomaly_columns(records: DataFrame) -> DataFrame:
    """Records and method labels per column, most records first."""
    labelled = flat(records).select("column", method_label().alias("method"))
    counted = labelled.groupBy("column").agg(
        F.count(F.lit(1)).alias("records"), F.collect_set("method").alias("labels"))
    return counted.select("column", "records",
                          F.array_join(F.array_sort("labels"), ", ").alias("methods")
                          ).orderBy(F.desc("records"), "column")


def labelled_rows(table: Table, records: DataFrame, x: str, y: str) -> DataFrame:
    """Two chosen columns of every row with its status and score."""
    scores = composite_scores(records).select("row_id", "composite_score")
    points = table.df.select(ref(table.row_id).alias("row_id"), ref(x).alias(x), ref(y).alias(y))
    flagged = F.col("composite_score").isNotNull()
    return points.join(scores, "row_id", "left").select(
        "row_id", ref(x), ref(y), F.when(flagged, "Anomaly").otherwise("Normal").alias("label"),
        F.coalesce(F.round("composite_score", 3), F.lit(0.0)).alias("score"))


def driver_features(records: DataFrame, columns: list[str]) -> DataFrame:
    """(ordinal, primary_driver_feature) in the order in which the methods meet them: by method,
    then by the column's place in the table."""
    method = F.array_position(F.array(*[F.lit(m) for m in METHOD_LABELS]), F.col("method_used"))
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("primary_driver_feature"))
    first = flat(records).groupBy("primary_driver_feature").agg(F.min(F.struct(method, place)).alias("at"))
    order = Window.orderBy("at")  # one row per column
    return first.select((F.row_number().over(order) - 1).alias("ordinal"), "primary_driver_feature")


def top_anomaly(records: DataFrame) -> DataFrame:
    """The row with the highest composite score and its strongest record."""
    order = [F.desc("composite_score"), "row_id", F.desc("anomaly_score"), "column", "method_used"]
    return with_composite(records).orderBy(*order).limit(1).select(
        "row_id", "composite_score", "severity", "primary_driver_feature", "column", "method_used")
