"""Report lines from quality, findings and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import quoted, share, title
from ..functions.wording import FINDING, REPORT
from ..operators import anomalies, insights, quality
from ..operators.profile import memory_mb
from ..operators.types import type_count_rows
from ..sources.table import Table

# Order of the types in the one-line summary.
TYPE_ORDER = ["numeric", "categorical", "datetime", "id", "text"]
LISTED_COLUMNS = 3
LISTED_FINDINGS = 6


def quality_lines(table: Table) -> list[str]:
    lines = [REPORT["health"].format(score=quality.health_score(table))]
    total = quality.missing_total(table)[1]
    if total > 0:
        facts = quality.missing_facts(table)
        worst = max(facts, key=lambda c: facts[c][1])
        lines.append(REPORT["missing"].format(total=total, column=worst, pct=facts[worst][1],
                                              pattern=facts[worst][3]))
    else:
        lines.append(REPORT["no_missing"])
    d = quality.duplicate_facts(table)
    some = "duplicates" if d["exact_count"] else "no_duplicates"
    lines.append(REPORT[some].format(n=d["exact_count"], pct=d["exact_pct"]))
    bad = list(quality.violation_facts(table))
    if bad:
        lines.append(REPORT["violations"].format(n=len(bad), columns=quoted(bad[:LISTED_COLUMNS])))
    spelled = quality.spelling_issues(table)
    if spelled:
        lines.append(REPORT["spelling"].format(n=len(spelled)))
    negative = list(quality.negative_facts(table).items())
    if negative:
        listed = [REPORT["negative"].format(column=c, pct=pct)
                  for c, (_, pct) in negative[:LISTED_COLUMNS]]
        lines.append(REPORT["negatives"].format(columns=", ".join(listed)))
    return [f"- {line}" for line in lines]


def insight_lines(table: Table, explanations: dict[int, str] | None = None) -> list[str]:
    rows = insights.finding_rows(table)
    if not rows:
        return [REPORT["no_insights"]]
    texts = explanations or {}
    return [REPORT["insight"].format(
        severity=severity.upper(), title=title(kind), columns=quoted(columns), statistic=statistic,
        explanation=texts.get(i, FINDING["no_explanation"]))
        for i, (columns, kind, statistic, severity, _) in enumerate(rows[:LISTED_FINDINGS])]


def finding_lines(table: Table) -> list[str]:
    return [REPORT["finding"].format(severity=severity.upper(), kind=kind,
                                     columns=", ".join(columns), statistic=statistic)
            for columns, kind, statistic, severity, _ in insights.finding_rows(table)]


def finding_headline(table: Table) -> str:
    rows = insights.finding_rows(table)
    n, k = len(rows), len({c for columns, *_ in rows for c in columns})
    return REPORT["headline"].format(n=n, k=k, insights="insight" if n == 1 else "insights",
                                     columns="column" if k == 1 else "columns")


def anomaly_facts(table: Table, records: DataFrame) -> dict:
    """Panel, per-method counts and top anomaly: one row each. The records are evaluated once."""
    records = table.stage(records, "records")
    summary = {r["method_used"]: r["records"] for r in anomalies.method_summary(records).collect()}
    return {"panel": anomalies.anomaly_panel(table, records).first(),
            "methods": {m: summary[m] for m in anomalies.METHOD_LABELS if m in summary},
            "top": anomalies.top_anomaly(records).first()}


def anomaly_lines(table: Table, records: DataFrame, facts: dict | None = None) -> list[str]:
    facts = facts or anomaly_facts(table, records)
    flagged, top = facts["panel"]["rows_flagged"], facts["top"]
    if not flagged:
        return [REPORT["no_anomalies"]]
    lines = [REPORT["flagged"].format(n=flagged, pct=share(flagged, table.rows, 1))]
    lines += [REPORT["method"].format(label=anomalies.METHOD_LABELS[m], n=n)
              for m, n in facts["methods"].items()]
    multi = facts["panel"]["multi_method_rows"]
    if multi:
        lines.append(REPORT["multi"].format(n=multi))
    lines.append(REPORT["top"].format(row=top["row_id"], column=top["primary_driver_feature"],
                                      score=top["composite_score"]))
    return lines


def types_line(table: Table) -> str:
    counts = dict(type_count_rows(table))
    return ", ".join(f"{counts[t]} {t}" for t in TYPE_ORDER if counts[t]) or "unknown"


def at_a_glance(table: Table, records: DataFrame, facts: dict | None = None) -> DataFrame:
    """(position, metric, value): health, insight and anomaly counts, first insight, top anomaly."""
    table.declare(quality.check_requests(table) | insights.pair_requests(table))  # one scan for both
    facts = facts or anomaly_facts(table, records)
    rows = insights.finding_rows(table)  # first: its value counts serve the score
    score, top = quality.health_score(table), facts["top"]
    first = worst = "None"
    if rows:
        columns, kind, statistic, *_ = rows[0]
        first = REPORT["glance_insight"].format(title=title(kind), columns=quoted(columns),
                                                statistic=statistic)
    if top is not None:
        worst = REPORT["glance_anomaly"].format(
            row=top["row_id"], column=top["primary_driver_feature"], score=top["composite_score"],
            severity=top["severity"])
    pairs = [("Health Score", REPORT["glance_health"].format(
        score=score, band=quality.health_label(score))),
        ("Insight Count", str(len(rows))),
        ("Anomalous Rows", str(facts["panel"]["rows_flagged"])),
        ("Top Insight", first), ("Top Anomaly", worst)]
    return table.frame([(i, *p) for i, p in enumerate(pairs)],
                       "position bigint, metric string, value string")


def report_text(table: Table, records: DataFrame, explanations: dict[int, str] | None = None) -> str:
    table.declare(quality.check_requests(table) | insights.pair_requests(table))  # one scan with the facts
    heading = REPORT["heading"].format(name=table.name, rows=table.rows, columns=len(table.columns),
                                       mb=memory_mb(table), types=types_line(table))
    found = insight_lines(table, explanations)  # first: its value counts serve the quality checks
    parts = {"quality": quality_lines(table), "insights": found, "anomalies": anomaly_lines(table, records)}
    sections = [REPORT[name].format(lines="\n".join(lines)) for name, lines in parts.items()]
    return "\n\n".join([heading, *sections])


def line_frame(table: Table, lines: list[str]) -> DataFrame:
    return table.frame(list(enumerate(lines)), "position bigint, line string")
