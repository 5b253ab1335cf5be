"""Questions to a table: schema context, Spark SQL answers, and the common question shapes."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.histogram import histograms
from ..functions.ordered import first_passing
from ..functions.values import value_counts
from ..functions.wording import SCHEMA
from ..sources.table import Table, ref
from .roles import ROLE_LABELS, semantic_roles
from .types import column_types, of_type

SAMPLES = 5
PREVIEW_ROWS = 50


# -- schema context -------------------------------------------------------------------

def first_values(table: Table, k: int = SAMPLES) -> DataFrame:
    """(column, rank, value): the first non-null values of each column in row order.

    Their row ids come first, from null marks alone; then just those rows are read, k per column.
    """
    columns = [c for c in table.columns if table.count(c) and not table.is_nested(c)]
    if not columns:
        return table.frame([], "column string, rank bigint, value string")
    at = ref(table.row_id)
    found = first_passing(table.df, at, {c: ref(c).isNotNull() for c in columns}, k).collect()
    rows = table.df.where(at.isin(sorted({r["at"] for r in found})))
    cells = rows.select(at.alias("at"), *[_shown(table, c).alias(c) for c in columns])
    pairs = cells.unpivot(["at"], [ref(c) for c in columns], "column", "value")
    wanted = table.frame([(r["column"], r["at"], r["rank"]) for r in found], "column string, at bigint, rank int")
    return pairs.join(F.broadcast(wanted), ["column", "at"]).select("column", "rank", "value")


def _shown(table, c):
    """A cell as a literal: text in quotes, with escapes."""
    x = table.text(c)
    if not table.is_string(c):
        return x
    for raw, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(raw), F.lit(code))
    double = x.contains("'") & ~x.contains('"')
    single = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(single)


def schema_context(table: Table) -> DataFrame:
    """(position, column, role, label, samples, min, max, mean) for every column."""
    roles, kinds, facts = semantic_roles(table), column_types(table), table.facts()
    rows = []
    for i, c in enumerate(table.columns):
        role = roles.get(c, kinds[c])
        numbers = (facts["min", c], facts["max", c], facts["mean", c]) if kinds[c] == "numeric" else (
            None, None, None)
        rows.append((i, c, role, ROLE_LABELS.get(role, kinds[c]), *numbers))
    described = table.frame(rows, """position bigint, column string, role string, label string,
        min double, max double, mean double""")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "value")))
    samples = first_values(table).groupBy("column").agg(
        F.array_join(F.transform(ordered, lambda e: e["value"]), ", ").alias("samples"))
    return described.join(samples, "column", "left").select(
        "position", "column", "role", "label",
        F.coalesce("samples", F.lit(SCHEMA["no_samples"])).alias("samples"), "min", "max", "mean")


def schema_text(table: Table) -> str:
    """The schema context as text, one line per column."""
    lines = [SCHEMA["heading"].format(name=table.name, rows=table.rows, columns=len(table.columns))]
    for r in schema_context(table).orderBy("position").collect():
        numbers = SCHEMA["numbers"] if r["min"] is not None else ""
        lines.append((SCHEMA["column"] + numbers).format(**r.asDict()))
    return "\n".join(lines)


# -- SQL questions --------------------------------------------------------------------

@dataclass
class Answer:
    sql: str
    result: DataFrame | None
    preview: list
    note: str
    success: bool
    error: str
    elapsed_ms: float


def ask(table: Table, sql: str, on_error: Callable[[str, str], str] | None = None) -> Answer:
    """Run a query over the table, visible as ``df``; at most one correction by the caller.

    Only queries run: a command is an error, and so is reading any other table, view or file: the
    analysed plan may hold no leaves but the table's own, literal rows and ranges. A view of the
    session named ``df`` is left alone.
    """
    answer = _attempt(table, sql)
    if not answer.success and on_error is not None:
        answer = _attempt(table, on_error(sql, answer.error))
    return answer


def _attempt(table, sql):
    start = time.perf_counter()
    result, preview, note, error = None, [], "", ""
    view = f"tabassay_{uuid.uuid4().hex}"
    table.df.createOrReplaceTempView(view)
    try:
        query = sql.strip().rstrip(";")
        result = table.spark.sql(f"WITH df AS (SELECT * FROM {view}) SELECT * FROM (\n{query}\n)")
        other = foreign_relation(result, table.df)
        if other:
            raise AnalysisException(f"the question reads {other}, which is not the table")
        preview, note = preview_rows(result)
    except PySparkException as failure:
        result, error = None, str(failure)
    finally:
        table.spark.catalog.dropTempView(view)
    elapsed = round((time.perf_counter() - start) * 1000, 1)
    return Answer(sql, result, preview, note, not error, error, elapsed)


OWN_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef"}  # literal rows, ranges, parts of the query


def foreign_relation(result: DataFrame, source: DataFrame) -> str | None:
    """First leaf of the analysed plan, subqueries included, that ``source`` does not read."""
    known = _leaves(source._jdf.queryExecution().analyzed())
    for leaf in _leaves(result._jdf.queryExecution().analyzed()):
        if leaf.nodeName() not in OWN_LEAVES and not any(leaf.sameResult(own) for own in known):
            return leaf.simpleString(25)
    return None


def _leaves(plan) -> list:
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        below = [seq.apply(i) for seq in (node.children(), node.subqueries()) for i in range(seq.size())]
        if not node.children().size():
            found.append(node)
        todo += below
    return found


def preview_rows(result: DataFrame, rows: int = PREVIEW_ROWS):
    """First rows, and the total when there are more; counted only then."""
    shown = result.limit(rows + 1).collect()
    note = SCHEMA["more_rows"].format(n=result.count()) if len(shown) > rows else ""
    return shown[:rows], note


# -- question shapes ------------------------------------------------------------------

def aggregate(table: Table, measure: str, fn: str = "avg", by: list[str] | None = None) -> DataFrame:
    """One measure by groups, e.g. average price by status."""
    call = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
            "median": F.median, "std": F.stddev}[fn]
    return table.df.groupBy(*[ref(c) for c in by or []]).agg(call(ref(measure)).alias("value"))


def rank(table: Table, measure: str, by: str, k: int = 10, fn: str = "sum",
         ascending: bool = False) -> DataFrame:
    """The k groups with the largest (or smallest) aggregate; ties by group."""
    grouped = aggregate(table, measure, fn, [by])
    first = F.asc("value") if ascending else F.desc("value")
    return grouped.orderBy(first, ref(by)).limit(k)


def distribution(table: Table, column: str, bins: int = 10) -> DataFrame:
    """Value counts with shares, or an equal-width histogram for numeric columns."""
    if column in of_type(table, "numeric"):
        return histograms(table, [column], bins)
    counts = value_counts(table, [column])
    total = max(table.count(column), 1)
    return counts.select("value", F.col("n").alias("count"),
                         F.round(F.col("n") / F.lit(total) * 100, 2).alias("pct"))
