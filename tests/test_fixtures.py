"""Small tables with values worked out by hand or with separate pandas code."""

import pytest
from conftest import by_column

from tabassay.operators import anomalies, basic, insights, profile, quality, roles, types
from tabassay.operators.types import column_types


@pytest.fixture
def sales(table):
    return table("date string, region string, sales double, category string", [
        ("2024-01-01", "West", 100.0, "A"), ("2024-01-02", "West", 120.0, "B"),
        ("2024-01-03", "East", 90.0, "A"), ("2024-01-04", "East", None, "B"),
        ("2024-01-05", "West", 200.0, "A")])


@pytest.fixture
def people(table):
    return table("name string, score bigint", [("Alice", 90), ("Alice", 90), ("Bob", 85)])


@pytest.fixture
def scores(table):
    return table("score bigint", [(v,) for v in (10, 12, 11, 13, 10, 12, 200)])


@pytest.fixture
def many_labels(table):
    return table("id bigint, label string", [(i + 1, chr(ord("a") + i)) for i in range(21)])


def test_types(sales, many_labels):
    assert column_types(sales) == {"date": "datetime", "region": "categorical", "sales": "numeric",
                                   "category": "categorical"}
    assert column_types(many_labels) == {"id": "id", "label": "categorical"}
    counts = {r["col_type"]: r["columns"] for r in types.type_counts(sales).collect()}
    assert counts == {"numeric": 1, "categorical": 2, "datetime": 1, "text": 0, "id": 0}


def test_roles(many_labels):
    assert roles.semantic_roles(many_labels) == {"id": "id", "label": "categorical_high"}


def test_numeric_profile(sales):
    p = profile.profile_numeric(sales).first()
    assert (p["count"], p["null_count"], p["mean"], p["median"]) == (4, 1, 127.5, 110.0)
    assert (p["p25"], p["p75"], p["std"]) == (97.5, 140.0, 49.9166)
    assert (p["skewness"], p["kurtosis"]) == (1.6462, 2.7043)


def test_missing(sales):
    assert quality.missing_total(sales) == (1, 5.0)
    row = by_column(quality.missing_pattern(sales))["sales"]
    assert (row["missing_pct"], row["longest_run"], row["pattern"]) == (20.0, 1, "clustered")


def test_clean_table_health(sales):
    assert quality.cardinality(sales).count() == 0
    assert quality.whitespace(sales).count() == 0
    assert tuple(quality.health(sales).first()) == (95.5, "Good")


def test_duplicates(people):
    d = quality.duplicate_facts(people)
    assert (d["exact_count"], d["exact_pct"], d["id_column"]) == (1, 33.33, None)
    assert quality.spelling_facts(people)["name"] == (False, True, False)
    assert tuple(quality.health(people).first()) == (77.0, "Fair")


def test_casing_modes(table):
    t = table("fruit string", [("Apple",), ("Apple",), ("apple",), ("apple",)])
    assert quality.spelling_facts(t)["fruit"] == (False, False, True)
    assert quality.whitespace(t).count() == 0
    assert quality.whitespace(t, "strict").count() == 1


def test_perfect_correlations(table):
    t = table("a bigint, b bigint, c bigint, d bigint", [(1, 2, 3, 4), (5, 6, 7, 8)])
    found = insights.correlation_findings(t)
    assert len(found) == 6 and all(f[2] == "r=1.00" and f[3] == "high" for f in found)
    assert basic.chart_columns(t) == ["a", "b", "c"]


def test_many_labels(many_labels):
    assert basic.value_charts(many_labels).count() == 0
    assert quality.near_duplicate_groups(many_labels).count() == 0
    assert quality.health_score(many_labels) == 100.0


def test_no_numbers(table):
    t = table("name string, city string", [("Alice", "NYC"), ("Bob", "LA")])
    assert basic.outlier_counts(t).count() == 0
    assert anomalies.anomaly_records(t).count() == 0


def test_outlier(scores):
    assert [tuple(r) for r in basic.outlier_counts(scores).collect()] == [("score", 1)]
    assert anomalies.iqr_records(scores).count() == 0  # fewer than ten values
    d = quality.duplicate_facts(scores)
    assert (d["exact_count"], d["exact_pct"]) == (2, 28.57)
    assert tuple(quality.health(scores).first()) == (80.0, "Fair")  # Good only above 80


def test_warnings(sales, people):
    assert basic.warning_texts(sales) == ["Column 'sales' has 1 missing value(s) (20.0% of rows)."]
    assert basic.warning_texts(people) == ["Dataset contains 1 duplicate row(s)."]


@pytest.mark.parametrize("name,expected", [
    ("id", True), ("order id", True), ("user_id", True), ("ID_CODE", True),
    ("provider", False), ("MEDICARE ID EFFECTIVE DATE", False)])
def test_id_names(name, expected):
    assert types.is_id_name(name) is expected


def test_role_names():
    made = {n: roles.role_by_name(n) for n in ("address_2", "addr2", "apt", "address", "order notes", "noted", "alt text")}
    assert made == {"address_2": "optional_text", "addr2": "optional_text", "apt": "optional_text", "address": None,
                    "order notes": "free_text", "noted": None, "alt text": "free_text"}


def test_issue_rules(spark, table):
    t = table("order_id bigint, notes string, fax string", [
        (1, "a", None), (2, None, " X"), (3, "b", None)])
    listed = quality.issues(t)
    keep, hide = roles.filter_issues(listed, roles.role_frame(t))
    kept = {(r["column"], r["issue_type"]): r["severity"] for r in keep.collect()}
    assert kept[("notes", "Missing Values")] == "Low"      # downgraded from High
    assert kept[("fax", "Whitespace / Casing")] == "Low"
    assert {(r["column"], r["issue_type"]) for r in hide.collect()} == {("fax", "Missing Values")}


def test_gap_text():
    assert insights.gap_text(90) == "90 seconds"
    assert insights.gap_text(7200) == "2.0 hours"
    assert insights.gap_text(86_400 * 3.7) == "3 days"
