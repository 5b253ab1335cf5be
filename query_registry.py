"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sample_views import dq_orders, given, us_orders
from tabassay.operators import (anomalies, ask, basic, forest, insights, profile, quality, roles,
                                types)
from tabassay.plans import report
from tabassay.sources.csv import read_csv
from tabassay.sources.table import scratch_path

UNIVARIATE = ("iqr", "zscore")


def flat(df: DataFrame, digits: int = 4) -> DataFrame:
    """Comparable output: rounded doubles, whole numbers as BIGINT, arrays as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, ", ")
        out.append(c.alias(f.name))
    return df.select(*out)


def top_value_rows(table, columns=None):
    """Categorical top values as rows."""
    found = profile.profile_categorical(table, columns)
    return found.select("column", F.posexplode("top_values").alias("p", "top")).select(
        "column", (F.col("p") + 1).alias("rank"), F.col("top.value").alias("value"),
        F.col("top.count").alias("count"), F.col("top.pct").alias("pct"))


def univariate(table):
    return anomalies.flagged_rows(table, methods=UNIVARIATE)


def lineitem(spark, sf):
    return given(spark, sf, "lineitem")


def documents(spark, sf):
    return given(spark, sf, "documents", "doc_id")


def events(spark, sf):
    return given(spark, sf, "events", "event_id")


def labels(spark, sf):
    return given(spark, sf, "labels", "doc_id")


def part(spark, sf):
    return given(spark, sf, "part", "p_partkey")


def customer(spark, sf):
    return given(spark, sf, "customer", "c_custkey", {"c_acctbal": "amount"})


def dq_csv(spark, sf):
    """The view written as CSV by Spark and read back with inferred types."""
    path = scratch_path(spark, "csv")
    dq_orders(spark, sf).df.drop("row_id").write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_csv(spark, path, "dq_orders", multiline=False)


def breaks_csv(spark, sf):
    """Documents as CSV, whose texts hold line breaks, read back by the reader's own search for them."""
    path = scratch_path(spark, "csv")
    spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_csv(spark, path, "documents")


def supplier(spark, sf):
    return given(spark, sf, "supplier", "s_suppkey")


def pages(spark, sf):
    return given(spark, sf, "pages", "page_id")


def conversations(spark, sf):
    return given(spark, sf, "conversations")


def embeddings(spark, sf):
    return given(spark, sf, "embeddings", "vec_id")


def descriptor(table):
    d = table.descriptor()
    return d.select("name", "row_count", "col_count", F.array_join(F.array_sort(F.transform(
        F.map_entries("column_types"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ", ")
        .alias("column_types"))


def stat_rows(found: DataFrame) -> DataFrame:
    """One row per column and statistic, numbers apart from texts; listed values have rows of their own."""
    pairs = found.select("column", "col_type", F.explode("stats").alias("key", "value"))
    number = F.col("value").try_cast("double")
    return pairs.where("value IS NOT NULL AND key <> 'top_values'").select(
        "column", "col_type", "key", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


def explained(table):
    """Findings with explanations for some of them."""
    given_texts = table.frame([(0, "first", "act"), (3, "third", None), (99, "none", "none")],
                              "ordinal bigint, explanation string, recommended_action string")
    return insights.explain_findings(insights.findings(table), given_texts).select(
        "ordinal", "finding_type", "explanation", "recommended_action")


def forest_rows(table):
    return forest.forest_scores(table).select("row_id", "score")


def sql_answer(table, sql):
    answer = ask.ask(table, sql, lambda failed, error: failed.replace("no_such_column", "l_quantity"))
    return answer.result


def ask_preview(table):
    """First rows of an answer, with the note on the total."""
    answer = ask.ask(table, "SELECT l_orderkey, l_linenumber FROM df WHERE l_quantity > 10 ORDER BY 1, 2")
    return table.frame([(i, *r, answer.note) for i, r in enumerate(answer.preview)],
                       "ordinal bigint, l_orderkey bigint, l_linenumber bigint, note string")


def insights_gaps(table, column):
    return table.frame([(c, *v) for c, v in insights.gap_facts(table).items() if c == column],
                       "column string, n bigint, mean_gap double, std_gap double")


def lines(make):
    return lambda t: report.line_frame(t, make(t))


def queries() -> dict:
    made: dict = {}

    def add(name, source, operator, digits=4):
        made[name] = lambda spark, sf_dir: flat(operator(source(spark, sf_dir)), digits)

    # sources, types, roles
    add("read_csv", dq_csv, lambda t: t.df.drop("row_id"))
    add("read_csv_types", dq_csv, types.type_frame)
    add("read_csv_breaks", breaks_csv, lambda t: t.df.drop("row_id"))
    add("preview", dq_orders, lambda t: t.preview(100))
    add("descriptor", dq_orders, descriptor)
    add("column_types", dq_orders, types.type_frame)
    add("type_counts", dq_orders, types.type_counts)
    add("semantic_roles", dq_orders, roles.role_frame)
    add("semantic_roles_documents", documents, roles.role_frame)
    add("semantic_roles_pages", pages, roles.role_frame)
    add("role_counts", dq_orders, roles.role_counts)
    # profiles
    add("profile_numeric", dq_orders, profile.profile_numeric)
    add("profile_numeric_lineitem", lineitem, profile.profile_numeric)
    add("profile_categorical", dq_orders, lambda t: profile.profile_categorical(t).drop("top_values"))
    add("top_values", dq_orders, top_value_rows)
    add("top_values_lineitem", lineitem, top_value_rows)
    add("profile_datetime", dq_orders, profile.profile_datetime)
    add("profile_datetime_events", events, lambda t: profile.profile_datetime(t, ["ts"]))
    add("profile_datetime_lineitem", lineitem, lambda t: profile.profile_datetime(t, ["l_shipdate"]))
    add("profile_text", dq_orders, profile.profile_text)
    add("profile_text_documents", documents, profile.profile_text)
    add("profile_text_conversations", conversations, profile.profile_text)
    add("profile_id", dq_orders, profile.profile_id)
    add("profile_id_events", events, profile.profile_id)
    add("dataset_summary", dq_orders, profile.dataset_summary)
    add("column_profile", dq_orders, lambda t: profile.column_profile(
        profile.profile_dataset(t), "priority").select(
            "column", "col_type", F.col("stats")["count"].cast("bigint").alias("count"),
            F.col("stats")["unique_count"].cast("bigint").alias("unique_count"),
            F.col("stats")["mode"].alias("mode")))
    add("profile_dataset", dq_orders, lambda t: profile.profile_dataset(t).select(
        "position", "column", "col_type", F.col("stats")["count"].cast("bigint").alias("count"),
        F.col("stats")["null_count"].cast("bigint").alias("null_count")))
    add("profile_dataset_all", dq_orders, lambda t: stat_rows(profile.profile_dataset(t)))
    add("column_profile_all", dq_orders, lambda t: stat_rows(profile.column_profile(profile.profile_dataset(t), "skewed")))
    # quality
    add("missing", dq_orders, quality.missing)
    add("missing_embeddings", embeddings, quality.missing)
    add("missing_pattern", dq_orders, quality.missing_pattern)
    add("duplicates", dq_orders, quality.duplicates)
    add("duplicates_lineitem", lineitem, quality.duplicates)
    add("near_duplicates", dq_orders, quality.near_duplicate_groups)
    add("near_duplicate_rows", dq_orders, quality.near_duplicate_rows)
    add("type_violations", dq_orders, quality.type_violations)
    add("cardinality", dq_orders, quality.cardinality)
    add("cardinality_labels", labels, quality.cardinality)
    add("whitespace", dq_orders, quality.whitespace)
    add("whitespace_strict", dq_orders, lambda t: quality.whitespace(t, "strict"))
    add("negatives", dq_orders, quality.negatives)
    add("negatives_customer", customer, quality.negatives)
    add("health", dq_orders, quality.health)
    add("issues", dq_orders, quality.issues)
    add("issues_actionable", dq_orders, lambda t: roles.filter_issues(
        quality.issues(t), roles.role_frame(t))[0])
    add("issues_suppressed", dq_orders, lambda t: roles.filter_issues(
        quality.issues(t), roles.role_frame(t))[1])
    # insights
    kinds = [("skew", insights.skew_findings), ("correlations", insights.correlation_findings),
             ("outlier_prevalence", insights.outlier_findings),
             ("dominance", insights.dominance_findings), ("date_gaps", insights.date_gap_findings),
             ("contradictions", insights.contradiction_findings)]
    for name, detect in kinds:
        add(name, dq_orders, lambda t, d=detect: insights.finding_frame(t, d(t)))
    add("skew_documents", documents, lambda t: insights.finding_frame(t, insights.skew_findings(t)))
    add("skew_labels", labels, lambda t: insights.finding_frame(t, insights.skew_findings(t)))
    add("date_gaps_events", events, lambda t: t.frame(
        [(c, *v) for c, v in insights.gap_facts(t).items()],
        "column string, n bigint, mean_gap double, std_gap double"))
    add("findings", dq_orders, insights.findings)
    add("findings_explained", dq_orders, lambda t: insights.explain_findings(insights.findings(t)).select(
        "ordinal", "finding_type", "explanation", "recommended_action"))
    add("findings_explained_given", dq_orders, explained)
    add("severity_counts", dq_orders, lambda t: insights.severity_counts(insights.findings(t)))
    add("finding_totals", dq_orders, lambda t: insights.finding_totals(insights.findings(t)))
    add("corr_matrix", dq_orders, insights.correlation_matrix)
    add("corr_matrix_lineitem", lineitem, insights.correlation_matrix)
    add("flagged_hist", dq_orders, insights.flagged_histograms)
    # anomalies
    add("iqr", dq_orders, anomalies.iqr_records)
    add("iqr_events", events, anomalies.iqr_records)
    add("normality", dq_orders, anomalies.normality_frame)
    add("normality_supplier", supplier, anomalies.normality_frame)
    add("zscore", dq_orders, anomalies.zscore_records)
    add("zscore_two", dq_orders, lambda t: anomalies.zscore_records(t, 2.0))
    add("composite", dq_orders, lambda t: anomalies.composite_scores(univariate(t)))
    add("method_summary", dq_orders, lambda t: anomalies.method_summary(univariate(t)))
    add("anomaly_panel", dq_orders, lambda t: anomalies.anomaly_panel(t, univariate(t)))
    add("anomaly_table", dq_orders, lambda t: anomalies.anomaly_table(univariate(t)))
    add("anomaly_table_filtered", dq_orders, lambda t: anomalies.anomaly_table(
        univariate(t), ["IQR"], ["moderate", "low"], "Severity", None))
    add("anomaly_columns", dq_orders, lambda t: anomalies.anomaly_columns(univariate(t)))
    add("labelled_rows", dq_orders, lambda t: anomalies.labelled_rows(t, univariate(t), "amount", "gauss"))
    add("driver_features", dq_orders, lambda t: anomalies.driver_features(univariate(t), t.columns))
    add("top_anomaly", dq_orders, lambda t: anomalies.top_anomaly(univariate(t)))
    add("forest_scores", dq_orders, forest_rows)
    add("forest_records", dq_orders, forest.forest_records)
    add("anomalies_all", dq_orders, anomalies.anomaly_records)
    add("forest_scores_lineitem", lineitem, forest_rows)
    add("composite_all", dq_orders, lambda t: anomalies.composite_scores(anomalies.flagged_rows(t)))
    add("anomaly_panel_all", dq_orders, lambda t: anomalies.anomaly_panel(t, anomalies.flagged_rows(t)))
    add("anomaly_table_all", dq_orders, lambda t: anomalies.anomaly_table(anomalies.flagged_rows(t)))
    add("labelled_rows_all", dq_orders, lambda t: anomalies.labelled_rows(t, anomalies.flagged_rows(t), "amount", "gauss"))
    # plain profile
    add("basic_profile", dq_orders, lambda t: basic.basic_profile(t).drop("dtype"))
    add("basic_profile_types", dq_orders, lambda t: basic.basic_profile(t).select("column", "dtype"))
    add("warnings", dq_orders, basic.warnings)
    add("outlier_counts", dq_orders, basic.outlier_counts)
    add("missing_chart", dq_orders, basic.missing_chart)
    add("hist20", part, basic.number_histograms)
    add("hist20_dq", dq_orders, basic.number_histograms)
    add("value_counts10", dq_orders, basic.value_charts)
    add("value_counts10_part", part, basic.value_charts)
    add("date_like", dq_orders, basic.date_like_frame)
    # questions
    add("schema_context", part, ask.schema_context)
    add("ask_aggregate", lineitem, lambda t: ask.aggregate(t, "l_extendedprice", "avg",
                                                           ["l_returnflag", "l_linestatus"]))
    add("ask_rank", lineitem, lambda t: ask.rank(t, "l_quantity", "l_suppkey", 10))
    add("ask_distribution", lineitem, lambda t: ask.distribution(t, "l_returnflag"))
    add("ask_distribution_numeric", lineitem, lambda t: ask.distribution(t, "l_extendedprice", 20))
    add("ask_sql", lineitem, lambda t: sql_answer(
        t, "SELECT l_linestatus, sum(no_such_column) AS quantity, count(*) AS n FROM df GROUP BY 1"))
    add("ask_preview", lineitem, ask_preview)
    # dates that are not ISO
    add("profile_datetime_us", us_orders, lambda t: profile.profile_datetime(t, ["ship_date"]))
    add("type_violations_us", us_orders, quality.type_violations)
    add("date_gaps_us", us_orders, lambda t: insights_gaps(t, "ship_date"))
    add("date_like_us", us_orders, basic.date_like_frame)
    # reports
    add("quality_bullets", dq_orders, lines(report.quality_lines))
    add("insight_bullets", dq_orders, lines(report.insight_lines))
    add("finding_bullets", dq_orders, lines(lambda t: [report.finding_headline(t), *report.finding_lines(t)]))
    add("anomaly_bullets", dq_orders, lines(lambda t: report.anomaly_lines(t, univariate(t))))
    add("types_line", dq_orders, lines(lambda t: [report.types_line(t)]))
    add("at_a_glance", dq_orders, lambda t: report.at_a_glance(t, univariate(t)))
    add("anomaly_bullets_all", dq_orders, lines(lambda t: report.anomaly_lines(t, anomalies.flagged_rows(t))))
    add("at_a_glance_all", dq_orders, lambda t: report.at_a_glance(t, anomalies.flagged_rows(t)))
    add("report_text_all", dq_orders, lines(lambda t: report.report_text(t, anomalies.flagged_rows(t)).split("\n")))
    add("report_text", dq_orders, lines(lambda t: report.report_text(t, univariate(t)).split("\n")))
    return made
