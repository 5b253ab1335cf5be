import math

import pytest
from conftest import by_column

from tabassay import Analysis, Table
from tabassay.functions.moments import correlation_frame
from tabassay.operators import anomalies, basic, insights, profile, quality, roles
from tabassay.operators.types import column_types


def test_empty_table(table):
    t = table("order_id bigint, amount double, name string, when_date string", [])
    a = Analysis(t)
    assert a.summary().first()["total_rows"] == 0
    assert a.issues().count() == 0 and a.findings().count() == 0
    assert a.records.count() == 0
    assert profile.profile_numeric(t).first()["mean"] is None
    assert quality.health_score(t) == 100.0
    assert "No anomalies detected" in a.report_text()


def test_all_null_column(table):
    t = table("amount double, label string", [(None, None)] * 12)
    p = profile.profile_numeric(t).first()
    assert (p["count"], p["null_count"], p["mean"], p["zero_count"]) == (0, 12, None, 0)
    m = by_column(quality.missing_pattern(t))
    assert m["amount"]["longest_run"] == 12 and m["amount"]["pattern"] == "clustered"
    assert profile.profile_categorical(t).first()["mode"] is None


def test_constant_column(table):
    t = table("a double, b double", [(5.0, float(i)) for i in range(12)])
    p = by_column(profile.profile_numeric(t))["a"]
    assert (p["std"], p["skewness"], p["kurtosis"]) == (0.0, 0.0, 0.0)
    assert [tuple(r) for r in correlation_frame(t).collect() if (r.a, r.b) == (0, 1)] == [(0, 1, None)]
    assert insights.correlation_findings(t) == []
    assert anomalies.iqr_records(t).where("column = 'a'").count() == 0


def test_nan_is_missing(table):
    t = table("x double", [(float("nan"),), (1.0,), (None,), (3.0,)])
    p = profile.profile_numeric(t).first()
    assert (p["count"], p["null_count"], p["mean"], p["max"]) == (2, 2, 2.0, 3.0)


def test_boolean_is_numeric_but_not_a_number(table):
    t = table("flag boolean, x double", [(i % 2 == 0, float(i)) for i in range(12)])
    assert column_types(t)["flag"] == "numeric"
    assert by_column(profile.profile_numeric(t))["flag"]["mean"] == 0.5
    assert t.number_columns == ["x"]
    assert "flag" not in {r.column_a for r in insights.correlation_matrix(t).collect()}


@pytest.mark.parametrize("n,expected", [(9, 0), (10, 1)])
def test_ten_values_for_iqr(table, n, expected):
    rows = [(float(i),) for i in range(n - 1)] + [(1000.0,)]
    assert anomalies.iqr_records(table("x double", rows)).count() == expected


@pytest.mark.parametrize("n,expected", [(3, 0), (4, 1)])
def test_four_values_for_outlier_counts(table, n, expected):
    rows = [(1.0,)] * (n - 1) + [(1000.0,)]
    assert basic.outlier_counts(table("x double", rows)).count() == expected


@pytest.mark.parametrize("n,expected", [(50, 0), (51, 1)])
def test_cardinality_needs_more_than_fifty_rows(table, n, expected):
    assert quality.cardinality(table("x double", [(float(i % 3),) for i in range(n)])).count() == expected


def test_zero_quartile_range(table):
    t = table("x double", [(1.0,)] * 20 + [(9.0,)])
    assert basic.outlier_counts(t).first()["outliers"] == 1
    assert anomalies.iqr_records(t).count() == 0


def test_whitespace_beyond_spaces(table):
    t = table("a string, b string, c string", [(" x", "x\t", "x y"), ("x", "x", "z")])
    assert {c for c, f in quality.spelling_facts(t).items() if f[0]} == {"a", "b"}


def test_null_rows_are_told_apart(table):
    t = table("a bigint, b bigint", [(1, None), (None, 1), (1, None)])
    assert quality.duplicate_facts(t)["exact_count"] == 1


def test_iqr_severity_and_score(table):
    rows = [(float(i),) for i in range(101)] + [(75.0 + 50 * k,) for k in (1.6, 2.5, 6.0)]
    t = table("x double", rows)
    bounds = anomalies.iqr_bounds(t)[0]
    q3, spread = bounds[5], bounds[6]
    for r in anomalies.iqr_records(t).collect():
        k = (r["raw_value"] - q3) / spread
        assert math.isclose(r["anomaly_score"], min(1.0, (k - 1.5) / 3.5), abs_tol=1e-12)
        assert r["severity"] == ("high" if k >= 3 else "moderate" if k >= 2 else "low")


def test_composite_bonus(spark, table):
    rows = [(1, "a", "iqr", 0.2), (1, "b", "iqr", 0.5), (1, "a", "zscore", 0.1), (2, "a", "iqr", 0.95),
            (2, "multivariate", "isolation_forest", 0.9)]
    records = spark.createDataFrame(rows, "row_id bigint, column string, method_used string, anomaly_score double")
    scores = {r["row_id"]: (round(r["composite_score"], 6), r["methods"])
              for r in anomalies.composite_scores(records).collect()}
    assert scores == {1: (0.65, 2), 2: (1.0, 2)}
    both = {r["row_id"]: round(r["composite_score"], 6) for r in anomalies.with_composite(records).collect()}
    assert both == {1: 0.65, 2: 1.0}


def test_contradiction_pairs_take_first_match(table):
    t = table("low_a double, low_b double, highest double", [(5.0, 1.0, 2.0), (1.0, 9.0, 3.0)])
    found = insights.contradiction_findings(t)
    assert [(f[0], f[2]) for f in found] == [(["low_a", "highest"], "1 rows where low_a > highest")]


def test_nested_columns_get_null_counts(spark):
    df = spark.createDataFrame([(0, [1.0], {"a": 1}), (1, None, {"a": 1})],
                               "row_id bigint, v array<double>, m map<string,int>")
    t = Table(df, "nested", "row_id")
    assert by_column(quality.missing(t))["v"]["missing_count"] == 1
    assert column_types(t) == {"v": "nested", "m": "nested"}
    assert roles.semantic_roles(t) == {}
    assert quality.duplicate_facts(t)["exact_count"] == 0


def test_odd_column_names(spark):
    df = spark.createDataFrame([(i, float(i), f"v{i % 3}") for i in range(12)],
                               "row_id bigint, `a.b c` double, `x``y` string")
    t = Table(df, "odd", "row_id")
    assert profile.profile_numeric(t).first()["column"] == "a.b c"
    assert profile.profile_categorical(t).first()["unique_count"] == 3
    assert quality.issues(t).count() >= 0
    assert anomalies.anomaly_records(t).count() == 0


def test_datetime_format_option(table):
    t = table("sale_date string", [("01/02/2024",), ("31/12/2023",), ("x",)],
              datetime_formats={"sale_date": "dd/MM/yyyy"})
    p = profile.profile_datetime(t).first()
    assert (p["count"], p["min_date"], p["date_range_days"]) == (2, "2023-12-31T00:00:00", 32)
    assert quality.violation_facts(t)["sale_date"] == (1, ["x"])
