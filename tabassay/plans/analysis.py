"""The whole examination of one table: every operator over shared facts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import anomalies, ask, basic, insights, profile, quality, roles, types
from ..sources.table import Table
from . import report


class Analysis:
    """Lazily computed results for a table; facts and records are computed once and shared."""

    def __init__(self, table: Table, contamination: float = 0.05, zscore_threshold: float = 3.0):
        self.table = table
        self.contamination = contamination
        self.zscore_threshold = zscore_threshold

    # overview
    def types(self) -> DataFrame: return types.type_frame(self.table)
    def roles(self) -> DataFrame: return roles.role_frame(self.table)
    def profile(self) -> DataFrame: return profile.profile_dataset(self.table)
    def summary(self) -> DataFrame: return profile.dataset_summary(self.table)
    def health(self) -> DataFrame: return quality.health(self.table)
    def issues(self) -> DataFrame: return quality.issues(self.table)

    def filtered_issues(self) -> tuple[DataFrame, DataFrame]:
        return roles.filter_issues(self.issues(), self.roles())

    # insights
    def findings(self) -> DataFrame: return insights.findings(self.table)
    def correlation_matrix(self) -> DataFrame: return insights.correlation_matrix(self.table)

    # anomalies
    @cached_property
    def flagged(self) -> DataFrame:
        """Flagged rows with their records, staged once because several tables are built from them."""
        found = anomalies.flagged_rows(self.table, self.contamination, self.zscore_threshold)
        return self.table.stage(found, "records")

    @property
    def records(self) -> DataFrame: return anomalies.flat(self.flagged)

    def composite(self) -> DataFrame: return anomalies.composite_scores(self.flagged)
    def anomaly_table(self, **options) -> DataFrame: return anomalies.anomaly_table(self.flagged, **options)
    def anomaly_columns(self) -> DataFrame: return anomalies.anomaly_columns(self.flagged)

    # questions and reports
    def ask(self, sql: str, on_error=None) -> ask.Answer: return ask.ask(self.table, sql, on_error)
    def schema_context(self) -> DataFrame: return ask.schema_context(self.table)
    def warnings(self) -> DataFrame: return basic.warnings(self.table)
    def at_a_glance(self) -> DataFrame: return report.at_a_glance(self.table, self.flagged)
    def report_text(self) -> str: return report.report_text(self.table, self.flagged)
