"""Statistical findings: skew, correlation, outlier share, dominance, date gaps, contradictions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.histogram import histograms
from ..functions.moments import correlation_frame, number_moments
from ..functions.ordered import gap_moments
from ..functions.text import rounded, share
from ..functions.wording import FINDING
from ..sources.table import Table, ref, small_frame
from .profile import categorical_facts, number_profiles
from .types import date_layout_requests, of_type

MIN_VALUES = 10
# Name parts of columns where the first should not exceed the second.
ORDERED_PAIRS = [
    ("start", "end"), ("begin", "end"), ("from", "to"),
    ("min", "max"), ("low", "high"), ("open", "close"),
]
# Finding severities, most severe first.
SEVERITIES = ["high", "medium", "low"]

_SCHEMA = """ordinal bigint, columns array<string>, finding_type string, statistic string,
    severity string, context string"""
HISTOGRAM_BINS = 40


def _finding(columns, kind, statistic, high, **context):
    return (columns, kind, statistic, "high" if high else "medium",
            json.dumps(context, ensure_ascii=False, separators=(",", ":")))


def skew_findings(table: Table) -> list:
    out = []
    for c, p in number_profiles(table).items():
        skew = p["skewness"]
        if p["count"] >= MIN_VALUES and skew is not None and abs(skew) > 2:
            tail = FINDING["right" if skew > 0 else "left"]
            out.append(_finding([c], "distribution_skew", FINDING["skew"].format(x=skew), abs(skew) > 5,
                                column=c, skewness=rounded(skew, 2), direction=tail,
                                mean=rounded(p["mean"], 2), median=rounded(p["median"], 2)))
    return out


def correlation_findings(table: Table) -> list:
    names = table.number_columns
    strong = sorted(tuple(r) for r in correlation_frame(table).where(F.abs("r") > 0.85).collect())
    return [_finding([names[a], names[b]], "high_correlation", FINDING["correlation"].format(x=r), abs(r) > 0.95,
                     column_a=names[a], column_b=names[b], pearson_r=rounded(r, 2),
                     direction="positive" if r > 0 else "negative")
            for a, b, r in strong]


def outlier_findings(table: Table) -> list:
    wide = {c: p for c, p in number_profiles(table).items()
            if p["count"] >= MIN_VALUES and p["std"]}
    got = table.aggregate({("far", c, p["mean"], p["std"]): F.count_if(F.abs(table.number(c) - F.lit(p["mean"])) > 3 * p["std"])
                           for c, p in wide.items()})
    far = {key[1]: n for key, n in got.items()}
    out = []
    for c, p in wide.items():
        pct = far[c] / p["count"] * 100
        if pct > 5:
            low, high = p["mean"] - 3 * p["std"], p["mean"] + 3 * p["std"]
            out.append(_finding([c], "outlier_prevalence", FINDING["outliers"].format(x=pct), pct > 15,
                                column=c, outlier_pct=rounded(pct, 1), mean=rounded(p["mean"], 2),
                                std=rounded(p["std"], 2),
                                bounds=FINDING["bounds"].format(low=rounded(low, 2),
                                                                high=rounded(high, 2))))
    return out


def dominance_findings(table: Table) -> list:
    facts = categorical_facts(table)
    out = []
    for c in of_type(table, "categorical"):
        if c not in facts or not facts[c]["top_values"]:
            continue
        top = facts[c]["top_values"][0]
        if top["pct"] > 70:
            out.append(_finding([c], "categorical_dominance",
                                FINDING["dominance"].format(value=top["value"], x=top["pct"]),
                                top["pct"] > 90,
                                column=c, dominant_value=top["value"],
                                dominant_pct=rounded(top["pct"], 1),
                                unique_value_count=facts[c]["unique_count"]))
    return out


def gap_facts(table: Table) -> dict:
    """{column: (n, mean gap, std of gaps)} in seconds, for datetime columns."""
    def compute():
        columns = of_type(table, "datetime")
        if not columns:
            return {}
        found = gap_moments(table.df, {c: table.stamp(c) for c in columns}).collect()
        got = {r["column"]: (r["n"], r["mean_gap"], r["std_gap"]) for r in found}
        return {c: got[c] for c in columns if c in got}
    return table.once("gaps", compute)


def gap_text(seconds: float) -> str:
    if seconds < 7200:
        return FINDING["seconds"].format(x=seconds)
    if seconds < 172_800:
        return FINDING["hours"].format(x=seconds / 3600)
    return FINDING["days"].format(x=int(seconds // 86_400))


def date_gap_findings(table: Table) -> list:
    out = []
    for c, (n, mean, std) in gap_facts(table).items():
        if n < MIN_VALUES or not mean:
            continue
        cv = std / mean
        if cv > 0.5:
            out.append(_finding([c], "date_gaps", FINDING["gaps"].format(x=cv), cv > 2,
                                column=c, mean_gap=gap_text(mean), std_gap=gap_text(std),
                                coefficient_of_variation=rounded(cv, 2),
                                note=FINDING["gaps_note"]))
    return out


def ordered_pairs(table: Table) -> list[tuple[str, str]]:
    """Column pairs named like a lower and an upper bound: the first name match for each part."""
    def first(part):
        return next((c for c in table.number_columns if part in c.lower()), None)
    found = [(first(a), first(b)) for a, b in ORDERED_PAIRS]
    return [(a, b) for a, b in found if a and b and a != b]


def pair_requests(table: Table) -> dict:
    want = {}
    for a, b in set(ordered_pairs(table)):
        x, y = ref(a), ref(b)
        want["over", a, b] = F.count_if(x > y)
        want["both", a, b] = F.count_if(x.isNotNull() & y.isNotNull())
    return want


def contradiction_findings(table: Table) -> list:
    pairs = ordered_pairs(table)
    got = table.aggregate(pair_requests(table))
    out = []
    for a, b in pairs:
        n = got["over", a, b]
        if n:
            pct = share(n, got["both", a, b], 1)
            out.append(_finding([a, b], "cross_column_contradiction",
                                FINDING["contradiction"].format(n=n, a=a, b=b),
                                pct > 10, column_a=a, column_b=b,
                                rule_violated=FINDING["rule"].format(a=a, b=b),
                                violation_count=n, violation_pct=pct))
    return out


DETECTORS = [skew_findings, correlation_findings, outlier_findings,
             dominance_findings, date_gap_findings, contradiction_findings]


def finding_rows(table: Table) -> list:
    def detect_all():
        table.declare(date_layout_requests(table) | pair_requests(table))  # with the facts
        return [f for detect in DETECTORS for f in detect(table)]
    return table.once("findings", detect_all)


def finding_frame(table: Table, rows) -> DataFrame:
    return table.frame([(i, *r) for i, r in enumerate(rows)], _SCHEMA)


def findings(table: Table) -> DataFrame:
    """All findings in detection order."""
    return finding_frame(table, finding_rows(table))


def severity_counts(found: DataFrame) -> DataFrame:
    """Findings per severity, most severe first, empty severities left out."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return (found.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))
            .withColumn("rank", rank.cast("int")).orderBy("rank"))


def finding_totals(found: DataFrame) -> DataFrame:
    """(insights, affected columns)."""
    spread = found.select("ordinal", F.explode("columns").alias("column"))
    return spread.agg(F.count_distinct("ordinal").alias("insights"),
                      F.count_distinct("column").alias("affected_columns"))


def explain_findings(found: DataFrame, explanations: DataFrame | None = None) -> DataFrame:
    """Attach caller-supplied (ordinal, explanation, recommended_action); defaults where absent."""
    if explanations is None:
        explanations = small_frame(found.sparkSession, [],
                                   "ordinal bigint, explanation string, recommended_action string")
    joined = found.join(explanations, "ordinal", "left")
    return joined.select(
        *found.columns, F.coalesce("explanation", F.lit(FINDING["no_explanation"])).alias("explanation"),
        F.coalesce("recommended_action", F.lit(FINDING["no_action"])).alias("recommended_action"))


def correlation_matrix(table: Table) -> DataFrame:
    """(column_a, column_b, r) over all ordered pairs, two decimals; empty below two columns."""
    columns, facts = table.number_columns, table.facts()
    if len(columns) < 2:
        return table.frame([], "column_a string, column_b string, r double")
    spread = [table.count(c) > 1 and facts["min", c] != facts["max", c] for c in columns]
    own = table.frame([(i, i, 1.0 if varied else None) for i, varied in enumerate(spread)], "a int, b int, r double")
    known = correlation_frame(table)
    empty = [i for i, c in enumerate(columns) if not table.count(c)]  # columns without values have no sums
    none = table.frame([(min(i, j), max(i, j), None) for i in empty for j in range(len(columns)) if i != j and (j not in empty or i < j)],
                       "a int, b int, r double")
    half = known.unionByName(none)
    name = lambda at: F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(at) + 1)
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(own)
    return both.orderBy("a", "b").select(name("a").alias("column_a"), name("b").alias("column_b"), F.round("r", 2).alias("r"))


def flagged_columns(table: Table) -> list[str]:
    """Number columns of skew, outlier and correlation findings, first seen first."""
    kinds = ("distribution_skew", "outlier_prevalence", "high_correlation")
    seen = [c for columns, kind, *_ in finding_rows(table) if kind in kinds for c in columns]
    return [c for c in dict.fromkeys(seen) if table.is_number(c)]


def flagged_histograms(table: Table) -> DataFrame:
    columns = flagged_columns(table)
    skew = {c: m["skewness"] for c, m in number_moments(table, columns).items()}
    notes = table.frame([(c, rounded(skew.get(c), 2)) for c in columns], "column string, skew double")
    return histograms(table, columns, HISTOGRAM_BINS).join(F.broadcast(notes), "column", "left")
