"""Data-quality checks, health score and issue table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import longest_null_runs
from ..functions.text import WHITESPACE, rounded, share
from ..functions.values import LONG_TEXT, distinct_counts, few_candidates, few_requests, row_key
from ..functions.wording import ISSUE
from ..sources.table import Table, ref
from .types import column_types, date_layout_requests, is_id_name, of_type

# Name parts of quantities that should not be negative.
NON_NEGATIVE_PARTS = [
    "age", "price", "cost", "amount", "quantity", "count", "salary", "revenue",
    "distance", "weight", "height", "duration", "rate", "score", "size",
]
SAMPLES = 5
MANY_VALUES_PCT = 50
FEW_VALUES = 9
CARDINALITY_MIN_ROWS = 50
HOT_GROUP = 100_000       # members of a duplicate group that one task may meet
HOT_BROADCAST = 50_000    # larger groups that may be broadcast: about 2 MB
SALTS = 256


# -- missing values -------------------------------------------------------------------

def missing_total(table: Table):
    """(missing cells, percent of all cells)."""
    cells = table.rows * len(table.columns)
    missing = sum(table.missing_count(c) for c in table.columns)
    return missing, share(missing, cells)


def missing_facts(table: Table) -> dict[str, tuple]:
    """{column: (count, pct, longest run, pattern)}."""
    return table.once("missing", lambda: _missing_facts(table))


def _missing_facts(table):
    gappy = [c for c in table.columns if table.missing_count(c)]
    runs = {}
    if gappy:
        tests = {c: F.isnull(ref(c)) for c in gappy}
        found = longest_null_runs(table.df, ref(table.row_id), tests, table.stage)
        runs = {r["column"]: r["longest_run"] for r in found.collect()}
    out = {}
    for c in table.columns:
        n, run = table.missing_count(c), runs.get(c, 0)
        pattern = "none" if not n else "clustered" if run > 0.2 * n else "scattered"
        out[c] = (n, share(n, table.rows), run, pattern)
    return out


def missing(table: Table) -> DataFrame:
    rows = [(c, table.missing_count(c), share(table.missing_count(c), table.rows)) for c in table.columns]
    return table.frame(rows, "column string, missing_count bigint, missing_pct double")


def missing_pattern(table: Table) -> DataFrame:
    rows = [(c, n, pct, run, p) for c, (n, pct, run, p) in missing_facts(table).items()]
    return table.frame(rows, """column string, missing_count bigint, missing_pct double,
        longest_run bigint, pattern string""")


# -- duplicates -----------------------------------------------------------------------

def id_column(table: Table) -> str | None:
    return next(iter(of_type(table, "id")), None)


def duplicate_facts(table: Table) -> dict:
    """Exact duplicates and near-duplicate groups from one scan.

    Rows are keyed by everything but the id column; with the id added the key is the whole
    row, so both counts come from the same narrow shuffle.
    """
    return table.once("duplicates", lambda: _duplicate_facts(table))


def _duplicate_facts(table):
    key = id_column(table)
    rest = [c for c in table.columns if c != key]
    if key is None or not rest:
        distinct = table.df.select(row_key(table, table.columns)).distinct().count()
        exact, groups = table.rows - distinct, 0
    else:
        whole = (table.df.select(row_key(table, rest), ref(key).alias("id"))
                 .groupBy("key", "id").agg(F.count(F.lit(1)).alias("n")))
        row = (whole.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("extra"))
               .agg(F.sum("extra"), F.count_if(F.col("n") >= 2))).first()
        exact, groups = row[0] or 0, row[1]
    return {"exact_count": exact, "exact_pct": share(exact, table.rows),
            "id_column": key, "near_groups": groups}


def duplicates(table: Table) -> DataFrame:
    d = duplicate_facts(table)
    return table.frame([(d["exact_count"], d["exact_pct"], d["id_column"], d["near_groups"])],
                       "exact_count bigint, exact_pct double, id_column string, near_groups bigint")


def near_duplicate_groups(table: Table, max_rows: int | None = None) -> DataFrame:
    """(id_column, group_row_id, n): rows equal in all columns but the first id column.

    A group is named by its smallest row id. ``max_rows`` looks at the first rows only;
    by default the whole table is examined.
    """
    groups = _near_groups(table, max_rows)
    if groups is None:
        return table.frame([], "id_column string, group_row_id bigint, n bigint")
    return groups.select(F.lit(id_column(table)).alias("id_column"), "group_row_id", "n")


def near_duplicate_rows(table: Table, max_rows: int | None = None) -> DataFrame:
    """(group_row_id, n, row_id): every member of every group, one row each.

    A group may hold any share of the table. Groups of more than HOT_GROUP members are broadcast
    if they are few enough, so their members stay as scanned; otherwise they and their members are
    dealt over SALTS parts each. Only members of smaller groups meet by their key alone.
    """
    groups = _near_groups(table, max_rows)
    if groups is None:
        return table.frame([], "group_row_id bigint, n bigint, row_id bigint")
    groups = table.stage(groups, "groups")  # used three times below
    key = id_column(table)
    rows = _first_rows(table, max_rows).select(
        row_key(table, [c for c in table.columns if c != key]), ref(table.row_id).alias("row_id"))
    big = F.col("n") > HOT_GROUP
    few, many = groups.where(~big), groups.where(big)
    if many.limit(HOT_BROADCAST + 1).count() <= HOT_BROADCAST:
        hot = rows.join(F.broadcast(many), "key")
    else:
        hot = (rows.withColumn("salt", F.pmod("row_id", F.lit(SALTS)).cast("bigint"))
               .join(many.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt")), ["key", "salt"]))
    cold = rows.join(few, "key")
    return hot.select("group_row_id", "n", "row_id").unionByName(cold.select("group_row_id", "n", "row_id"))


def _first_rows(table, max_rows):
    return table.df if max_rows is None else table.df.orderBy(ref(table.row_id)).limit(max_rows)


def _near_groups(table, max_rows):
    key = id_column(table)
    rest = [c for c in table.columns if c != key]
    if key is None or not rest:
        return None
    rows = _first_rows(table, max_rows).select(row_key(table, rest), ref(table.row_id).alias("row_id"))
    return (rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("group_row_id"))
            .where("n >= 2"))


# -- type violations ------------------------------------------------------------------

def violation_facts(table: Table) -> dict[str, tuple]:
    """{column: (count, first distinct bad values)} for text columns typed as datetime."""
    return table.once("violations", lambda: _violation_facts(table))


def _violation_facts(table):
    kinds = column_types(table)
    checked = [c for c in table.string_columns if kinds[c] in ("numeric", "datetime")]
    if not checked:
        return {}
    bad = [F.when(ref(c).isNotNull() & _parsed(table, c, kinds[c]).isNull(), ref(c)).alias(c)
           for c in checked]
    pairs = (table.df.select(ref(table.row_id).alias("at"), *bad)
             .unpivot(["at"], [ref(c) for c in checked], "column", "value").where("value IS NOT NULL"))
    values = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    order = Window.partitionBy("column").orderBy("at", "value")
    first = values.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLES)
    # Both branches read n and at, so that they share one scan and shuffle.
    samples = first.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("k", "value", "n"))).alias("samples"))
    totals = values.groupBy("column").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    got = {r["column"]: (r["n"], [s["value"] for s in r["samples"]])
           for r in totals.join(F.broadcast(samples), "column").collect()}
    return {c: got[c] for c in checked if c in got}


def _parsed(table, c, kind):
    return table.stamp(c) if kind == "datetime" else ref(c).try_cast("double")


def type_violations(table: Table) -> DataFrame:
    rows = [(c, n, s) for c, (n, s) in violation_facts(table).items()]
    return table.frame(rows, "column string, violation_count bigint, samples array<string>")


# -- cardinality ----------------------------------------------------------------------

def cardinality_facts(table: Table) -> list[tuple]:
    """[(column, kind, distinct values, percent of rows)] in column order."""
    return table.once("cardinality", lambda: _cardinality_facts(table))


def _cardinality_facts(table):
    if table.rows <= CARDINALITY_MIN_ROWS:
        return []
    words = of_type(table, "categorical")
    numbers = few_candidates(table, of_type(table, "numeric"), FEW_VALUES)
    distinct = distinct_counts(table, words + numbers)
    out = []
    for c in table.columns:
        n = distinct.get(c)
        pct = share(n or 0, table.rows)
        if c in words and pct > MANY_VALUES_PCT:
            out.append((c, "high_cardinality_categorical", n, pct))
        elif c in numbers and n <= FEW_VALUES:
            out.append((c, "low_cardinality_numeric", n, pct))
    return out


def cardinality(table: Table) -> DataFrame:
    return table.frame(cardinality_facts(table),
                       "column string, kind string, unique_count bigint, unique_pct double")


# -- whitespace and casing ------------------------------------------------------------

def spelling_facts(table: Table) -> dict[str, tuple]:
    """{column: (surrounding whitespace, casing variants, strict casing variants)}.

    Casing variants: some value, ignoring case and outer whitespace, fills more than one row
    while some trimmed spelling fills exactly one. Strict: two spellings differ only in case.
    """
    return table.once("spelling", lambda: _spelling_facts(table))


def _spelling_facts(table):
    columns = [c for c in table.string_columns if table.count(c)]
    if not columns:
        return {}
    spelled = _spelled(table, columns)
    form = F.xxhash64("trimmed")  # of spellings that are equal but for case
    folded = spelled.groupBy("column", "folded").agg(
        F.count(F.lit(1)).alias("n"), F.min(form).alias("first"), F.max(form).alias("last"), F.bool_or("padded").alias("padded"))
    rows = folded.groupBy("column").agg(
        F.bool_or("padded").alias("padded"), (F.max("n") > 1).alias("repeated"), (F.min("n") == 1).alias("single"),
        F.bool_or(F.col("first") != F.col("last")).alias("strict")).collect()
    # A spelling that fills one row is alone in its group, or one of several there: only then spellings are counted.
    open_columns = [r["column"] for r in rows if r["strict"] and not r["single"]]
    rare = _rare_spellings(table, open_columns) if open_columns else set()
    got = {r["column"]: (r["padded"], r["repeated"] and (r["single"] or r["column"] in rare), r["strict"]) for r in rows}
    return {c: got[c] for c in columns}


def _spelled(table, columns):
    """(column, trimmed, folded, padded) of every value; long folded texts are digests."""
    pairs = (table.df.select(*[ref(c) for c in columns])
             .unpivot([], [ref(c) for c in columns], "column", "value").where("value IS NOT NULL"))
    trimmed = F.btrim("value", F.lit(WHITESPACE))
    return pairs.select("column", trimmed.alias("trimmed"), _digest(F.lower(trimmed)).alias("folded"),
                        (F.col("value") != trimmed).alias("padded"))


def _rare_spellings(table, columns):
    """Those of the columns in which some trimmed spelling fills exactly one row."""
    spellings = (_spelled(table, columns).groupBy("column", _digest(F.col("trimmed")).alias("spelling"))
                 .agg(F.count(F.lit(1)).alias("n")))
    return {r["column"] for r in spellings.groupBy("column").agg((F.min("n") == 1).alias("rare")).collect() if r["rare"]}


def _digest(x):
    return F.when(F.length(x) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(x, 256))).otherwise(x)


def spelling_issues(table: Table, mode: str = "reference") -> dict[str, tuple]:
    pick = 2 if mode == "strict" else 1
    return {c: (f[0], f[pick]) for c, f in spelling_facts(table).items() if f[0] or f[pick]}


def whitespace(table: Table, mode: str = "reference") -> DataFrame:
    rows = [(c, *f) for c, f in spelling_issues(table, mode).items()]
    return table.frame(rows, """column string, has_leading_trailing boolean,
        has_casing_variants boolean""")


# -- unexpected negatives -------------------------------------------------------------

def negative_facts(table: Table) -> dict[str, tuple]:
    named = [c for c in table.number_columns if any(p in c.lower() for p in NON_NEGATIVE_PARTS)]
    counts = {c: table.facts()["negatives", c] for c in named}
    return {c: (n, share(n, table.count(c))) for c, n in counts.items() if n}


def negatives(table: Table) -> DataFrame:
    rows = [(c, n, pct) for c, (n, pct) in negative_facts(table).items()]
    return table.frame(rows, "column string, negative_count bigint, negative_pct double")


# -- health ---------------------------------------------------------------------------

def health_label(score: float) -> str:
    return "Good" if score > 80 else "Fair" if score >= 50 else "Poor"


def check_requests(table: Table) -> dict:
    """Aggregates of the checks that no other fact precedes, for the scan of the facts."""
    numbers = [c for c in table.columns if (table.is_number(c) or table.is_boolean(c)) and not is_id_name(c)]
    return date_layout_requests(table) | few_requests(numbers)


def health_score(table: Table) -> float:
    """0-100: 30 % completeness, 20 % uniqueness, 20 % valid types, 30 % other checks."""
    table.declare(check_requests(table))
    parts = [
        (0.30, max(0.0, 100 - 3 * missing_total(table)[1])),
        (0.20, max(0.0, 100 - 5 * duplicate_facts(table)["exact_pct"])),
        (0.20, 100 * (1 - len(violation_facts(table)) / max(len(table.columns), 1))),
        (0.30, 100.0 - 10 * sum(map(bool, (cardinality_facts(table), spelling_issues(table),
                                           negative_facts(table))))),
    ]
    return rounded(math.fsum(weight * score for weight, score in parts), 1)


def health(table: Table) -> DataFrame:
    score = health_score(table)
    return table.frame([(score, health_label(score))], "health_score double, band string")


# -- issue table ----------------------------------------------------------------------

def issue_rows(table: Table) -> list[tuple]:
    """(column, issue type, severity, detail)."""
    table.declare(check_requests(table))
    rows = []
    for c, (n, pct, _, pattern) in missing_facts(table).items():
        if n:
            level = "High" if pct > 30 else "Medium" if pct > 10 else "Low"
            rows.append((c, "Missing Values", level, ISSUE["missing"].format(n=n, pct=pct, pattern=pattern)))
    d = duplicate_facts(table)
    if d["exact_count"]:
        rows.append(("(all columns)", "Duplicate Rows", "High" if d["exact_pct"] > 10 else "Medium",
                     ISSUE["duplicates"].format(n=d["exact_count"], pct=d["exact_pct"])))
    if d["near_groups"]:
        rows.append((d["id_column"], "Near-Duplicate Rows", "Low",
                     ISSUE["near"].format(n=d["near_groups"], column=d["id_column"])))
    for c, (n, samples) in violation_facts(table).items():
        rows.append((c, "Type Violation", "Medium",
                     ISSUE["violation"].format(n=n, samples=", ".join(samples))))
    for c, kind, n, pct in cardinality_facts(table):
        text = ISSUE["many_values" if kind == "high_cardinality_categorical" else "few_values"]
        rows.append((c, "Cardinality Anomaly", "Low",
                     text.format(n=n, pct=pct)))
    for c, (padded, casing) in spelling_issues(table).items():
        found = [ISSUE[k] for k, seen in (("padding", padded), ("casing", casing)) if seen]
        rows.append((c, "Whitespace / Casing", "Low", ", ".join(found)))
    for c, (n, pct) in negative_facts(table).items():
        rows.append((c, "Unexpected Negatives", "Medium", ISSUE["negatives"].format(n=n, pct=pct)))
    return rows


def issues(table: Table) -> DataFrame:
    return table.frame([(i, *r) for i, r in enumerate(issue_rows(table))],
                       "ordinal bigint, column string, issue_type string, severity string, detail string")
