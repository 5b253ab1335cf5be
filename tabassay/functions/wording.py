"""The texts and number formats of issues, warnings, findings and reports."""

# Details of quality issues.
ISSUE = {
    "missing": "{n} missing ({pct}%, {pattern})",
    "duplicates": "{n} exact duplicates ({pct}%)",
    "near": "{n} row groups identical except in '{column}'",
    "violation": "{n} values can't be cast (e.g. {samples})",
    "many_values": "{n} unique values ({pct}%) — may be free text or an ID column",
    "few_values": "Only {n} unique values — may be categorical",
    "padding": "leading/trailing spaces",
    "casing": "casing variants (e.g. 'Apple' vs 'apple')",
    "negatives": "{n} negative values ({pct}%)",
}

# Warnings of the plain profile.
WARNING = {
    "duplicates": "Dataset contains {n} duplicate row(s).",
    "many_missing": "Column '{column}' is missing {n} value(s) ({pct:.1f}% of rows) "
                    "— consider dropping or imputing.",
    "some_missing": "Column '{column}' has {n} missing value(s) ({pct:.1f}% of rows).",
    "one_value": "Column '{column}' has only one unique value — it may not be useful.",
}

# Statistics and notes of findings.
FINDING = {
    "skew": "skewness={x:.2f}",
    "right": "right-skewed (long tail of high values)",
    "left": "left-skewed (long tail of low values)",
    "correlation": "r={x:.2f}",
    "outliers": "{x:.1f}% outliers (±3σ)",
    "bounds": "{low} to {high}",
    "dominance": "'{value}' in {x:.1f}% of rows",
    "gaps": "gap CV={x:.2f}",
    "gaps_note": "High CV means the time between records is irregular.",
    "contradiction": "{n} rows where {a} > {b}",
    "rule": "{a} should be ≤ {b}",
    "seconds": "{x:.0f} seconds",
    "hours": "{x:.1f} hours",
    "days": "{x} days",
    "no_explanation": "No explanation available.",
    "no_action": "Review this finding manually.",
}

# Expected ranges of anomalies.
RANGE = {
    "iqr": "[{low:.4g}, {high:.4g}]",
    "zscore": "[{low:.4g}, {high:.4g}]  (μ ± {threshold:.1f}σ)",
    "forest": "[{low:.4g}, {high:.4g}]  (primary driver: {column})",
}

# Lines of the reports.
REPORT = {
    "health": "Health score: {score}/100",
    "missing": "Missing data: {total:.1f}% of all cells; worst column is '{column}' "
               "({pct:.1f}% missing, {pattern} pattern)",
    "no_missing": "No missing values detected.",
    "duplicates": "Exact duplicates: {n:,} rows ({pct:.1f}% of dataset)",
    "no_duplicates": "No exact duplicate rows found.",
    "violations": "Type violations in {n} column(s): {columns}",
    "spelling": "Whitespace / casing inconsistencies in {n} column(s)",
    "negatives": "Unexpected negative values: {columns}",
    "negative": "'{column}' ({pct:.1f}%)",
    "no_insights": "- No significant statistical patterns detected.",
    "insight": "- [{severity}] {title} in {columns} ({statistic}): {explanation}",
    "finding": "- [{severity}] {kind} on {columns}: {statistic}",
    "headline": "{n} {insights} found across {k} {columns}",
    "no_anomalies": "- No anomalies detected.",
    "flagged": "- {n:,} rows flagged ({pct}% of dataset)",
    "method": "- {label}: {n:,} records",
    "multi": "- {n} rows flagged by 2+ methods (high confidence)",
    "top": "- Highest-scoring anomaly: row {row}, driven by '{column}' (composite score {score:.2f})",
    "glance_health": "{score}/100 — {band}",
    "glance_insight": "{title} in {columns} ({statistic})",
    "glance_anomaly": "Row {row} — '{column}' (score {score:.2f}, {severity} severity)",
    "heading": "Dataset: {name}\nSize: {rows:,} rows × {columns} columns ({mb:.1f} MB in memory)\n"
               "Column types: {types}",
    "quality": "--- DATA QUALITY ---\n{lines}",
    "insights": "--- STATISTICAL INSIGHTS ---\n{lines}",
    "anomalies": "--- ANOMALY DETECTION ---\n{lines}",
}

# Lines of the schema context.
SCHEMA = {
    "heading": "Dataset: {name}  ({rows:,} rows × {columns} columns)\n\nColumns:",
    "column": "  {column!r:40s} [{label}]  samples: {samples}",
    "numbers": "  |  min={min:.4g}, max={max:.4g}, mean={mean:.4g}",
    "no_samples": "(all null)",
    "more_rows": "... ({n:,} total rows)",
}
