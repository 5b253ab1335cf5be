"""The paths taken on large tables, forced on small ones and checked by brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabassay import Table, read_parquet
from tabassay.functions import moments
from tabassay.functions.ordered import gap_moments, longest_null_runs
from tabassay.functions.quantiles import exact_quantiles
from tabassay.functions.values import few_distinct
from tabassay.operators import anomalies, ask, insights, quality

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 1.0]


def columns_of(n):
    rng = np.random.default_rng(3)
    return {
        "smooth": rng.normal(size=n),
        "heavy_tail": np.exp(rng.normal(size=n) * 6),
        "third_hot": np.where(rng.random(n) < 0.34, 7.0, rng.random(n) * 10),
        "few": rng.integers(0, 3, n).astype(float),
        "constant": np.full(n, 2.5),
        "edge_tie": np.concatenate([np.zeros(n // 2), np.arange(n - n // 2) + 1.0]),
        "far_out": np.concatenate([rng.random(n - 1), [1e18]]),
    }


@pytest.mark.parametrize("limit,sketch", [(10, 200), (50, 40), (400, 1000), (100_000, 4096)])
def test_quantiles_by_narrowing(spark, limit, sketch):
    n = 6000
    data = pd.DataFrame(columns_of(n))
    data.loc[data.index % 7 == 0, "smooth"] = np.nan
    df = spark.createDataFrame(data).select(
        *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in data.columns]).repartition(5)
    counts = {c: int(data[c].notna().sum()) for c in data.columns}
    got = exact_quantiles(df, counts, PROBS, sort_limit=limit, sketch_size=sketch)
    for c in data.columns:
        want = data[c].dropna().quantile(PROBS).to_list()
        assert got[c] == pytest.approx(want, rel=1e-12, abs=1e-12), c


def test_quantiles_direct_equal_narrowed(spark):
    df = spark.range(5000).select(F.pow(F.col("id") % 977, F.lit(2.0)).alias("x"))
    direct = exact_quantiles(df, {"x": 5000}, PROBS)
    narrowed = exact_quantiles(df, {"x": 5000}, PROBS, sort_limit=20, sketch_size=100)
    assert narrowed["x"] == pytest.approx(direct["x"], rel=1e-12)


@pytest.mark.parametrize("seed", range(4))
def test_longest_null_runs(spark, seed):
    rng = random.Random(seed)
    n, width = 500, 70  # more columns than one mask holds
    share = [rng.choice([0.0, 0.1, 0.5, 0.9, 1.0]) for _ in range(width)]
    flags = [[rng.random() < share[c] for c in range(width)] for _ in range(n)]
    start = rng.randrange(n // 2)
    for i in range(start, start + n // 3):
        flags[i][0] = True  # a run across partition borders
    df = spark.createDataFrame([(i * 10, *f) for i, f in enumerate(flags)],
                               ["k", *[f"c{c}" for c in range(width)]]).orderBy(F.rand(1)).repartition(6)
    found = {r["column"]: r["longest_run"] for r in longest_null_runs(
        df, F.col("k"), {f"c{c}": F.col(f"c{c}") for c in range(width)}).collect()}
    for c in range(width):
        best = run = 0
        for i in range(n):
            run = run + 1 if flags[i][c] else 0
            best = max(best, run)
        assert found[f"c{c}"] == best


def test_null_runs_move_no_rows_read_in_order(spark, tmp_path):
    """Several files, runs across their borders: splits are summarised where they are read."""
    rng = random.Random(7)
    flags = [(rng.random() < 0.3, 200 <= i < 420, i >= 550, True, False) for i in range(600)]
    for part in range(6):
        spark.createDataFrame([tuple(None if f else 1 for f in x) for x in flags[part * 100:part * 100 + 100]], ", ".join(f"c{i} int" for i in range(5))
                              ).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t/part={part}")
    t = read_parquet(spark, f"{tmp_path}/t")
    found = longest_null_runs(t.df, F.col("row_id"), {f"c{i}": F.col(f"c{i}").isNull() for i in range(5)})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "mapInPandas" not in plan.replace("MapInPandas", "mapInPandas")  # the staged pieces are read
    got = {r["column"]: r["longest_run"] for r in found.collect()}
    rows = sorted((r.row_id, *(r[f"c{i}"] is None for i in range(5))) for r in t.df.collect())
    for c in range(5):
        best = run = 0
        for r in rows:
            run = run + 1 if r[c + 1] else 0
            best = max(best, run)
        assert got[f"c{c}"] == best, c


def test_gap_moments_with_a_hot_moment(spark):
    rng = np.random.default_rng(5)
    base = pd.Timestamp("2024-01-01")
    even = [base + pd.Timedelta(minutes=int(m)) for m in rng.integers(0, 10_000, 400)]
    hot = [base + pd.Timedelta(minutes=77)] * 300
    other = [base + pd.Timedelta(days=int(d)) for d in rng.integers(0, 900, 700)]
    df = spark.createDataFrame(pd.DataFrame({"a": even + hot, "b": other}))
    got = {r["column"]: r for r in gap_moments(df, {"a": F.col("a"), "b": F.col("b")}).collect()}
    for c, values in (("a", even + hot), ("b", other)):
        gaps = pd.Series(values).sort_values().diff().dropna().dt.total_seconds()
        assert got[c]["n"] == 700
        assert got[c]["mean_gap"] == pytest.approx(gaps.mean(), rel=1e-9)
        assert got[c]["std_gap"] == pytest.approx(gaps.std(), rel=1e-9)


def test_declared_aggregates_share_a_scan(spark):
    """What checks declare is evaluated with the facts: asking for it later runs no job."""
    df = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 7).alias("low_price"), (F.col("id") % 11).alias("high_price"),
                                 F.concat(F.lit("0"), F.col("id") % 9 + 1, F.lit("/12/2024")).alias("ship_date"))
    t = Table(df, "t", "row_id")
    sc = spark.sparkContext
    sc.setJobGroup("declared", "declared")
    jobs = lambda: len(sc.statusTracker().getJobIdsForGroup("declared"))
    t.declare(quality.check_requests(t) | insights.pair_requests(t))
    t.facts()
    once = jobs()
    assert t.layout("ship_date") == "M/d/yyyy" and insights.contradiction_findings(t) and t.rows == 300
    assert jobs() == once and once <= 2
    t = Table(df, "t", "row_id")
    insights.findings(t).collect()
    assert jobs() - once <= 30
    assert t.aggregate(insights.pair_requests(t))["over", "low_price", "high_price"] == sum(i % 7 > i % 11 for i in range(300))


def test_near_duplicates_with_a_hot_group(spark):
    rows = []
    for i in range(3000):
        value = "hot" if i % 3 == 0 else f"v{i // 4}"
        rows.append((i, i + 10, value, None if i % 5 == 0 else 1.0))
    data = pd.DataFrame(rows, columns=["row_id", "order_id", "value", "x"])
    df = spark.createDataFrame(rows, "row_id bigint, order_id bigint, value string, x double")
    t = Table(df.repartition(7), "hot", "row_id")
    want = {}
    for _, g in data.groupby(["value", "x"], dropna=False):
        if len(g) >= 2:
            for r in g["row_id"]:
                want[int(r)] = (int(g["row_id"].min()), len(g))
    got = {r["row_id"]: (r["group_row_id"], r["n"]) for r in quality.near_duplicate_rows(t).collect()}
    assert got == want
    groups = {r["group_row_id"]: r["n"] for r in quality.near_duplicate_groups(t).collect()}
    assert groups == dict(want.values())
    assert quality.duplicate_facts(t)["near_groups"] == len(groups)
    capped = quality.near_duplicate_groups(t, max_rows=300)
    assert capped.agg(F.sum("n")).first()[0] < sum(groups.values())


def test_few_distinct_screen(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), (F.col("id") % 9).alias("nine"),
                                  (F.col("id") % 10).alias("ten"), F.col("id").alias("many"))
    direct = Table(df, "t", "row_id")
    screened = Table(df, "t", "row_id", sort_limit=100)
    for t in (direct, screened):
        assert few_distinct(t, ["nine", "ten", "many"], 9) == {"nine": 9}


def test_first_values_sparse_column(spark):
    n = 4000
    df = spark.range(n).select(
        F.col("id").alias("row_id"), F.col("id").alias("dense"),
        F.when(F.col("id") % 1500 == 1499, F.col("id")).alias("sparse"))
    t = Table(df, "t", "row_id", sort_limit=100)
    got = {}
    for r in ask.first_values(t).collect():
        got.setdefault(r["column"], {})[r["rank"]] = r["value"]
    assert got["dense"] == {i + 1: str(i) for i in range(5)}
    assert got["sparse"] == {1: "1499", 2: "2999"}


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(2000).select(
        F.col("id").alias("row_id"), F.col("id").alias("order_id"),
        F.when(F.col("id") % 13 > 3, F.sin("id") * 100).alias("amount"),
        F.concat(F.lit("n"), F.col("id") % 17).alias("name"))
    results = []
    for parts in (1, 9):
        t = Table(df.repartition(parts, F.xxhash64("row_id")), "t", "row_id")
        results.append((quality.missing_facts(t), quality.duplicate_facts(t), quality.issue_rows(t)))
    assert results[0] == results[1]


@pytest.mark.parametrize("tile, pairs", [(64, 192), (4, 3), (1, 7)])
def test_correlations_by_tiles(spark, monkeypatch, tile, pairs):
    """Tiles and scans of any size give pairwise-complete Pearson."""
    monkeypatch.setattr(moments, "TILE", tile)
    monkeypatch.setattr(moments, "TILE_PAIRS", pairs)
    rng = np.random.default_rng(11)
    n, width = 800, 20
    data = pd.DataFrame(rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) + 1e6,
                        columns=[f"v{i}" for i in range(width)])
    for i in range(0, width, 3):
        data.loc[rng.random(n) < 0.3, f"v{i}"] = np.nan
    data["v1"] = 0.1  # constant
    data["v4"] = np.nan  # no value
    data.insert(0, "row_id", range(n))
    t = Table(spark.createDataFrame(data).repartition(5), "wide", "row_id")
    want = data.drop(columns="row_id").corr()
    got = {(f"v{r.a}", f"v{r.b}"): r.r for r in moments.correlation_frame(t).collect()}
    assert len(got) == (width - 1) * (width - 2) // 2
    for (a, b), r in got.items():
        if "v1" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)
    matrix = {(r.column_a, r.column_b): r.r for r in insights.correlation_matrix(t).collect()}
    assert len(matrix) == width * width and matrix["v0", "v0"] == 1.0
    assert all(matrix[a, b] == matrix[b, a] for a, b in matrix)
    assert all((r is None) == (a in ("v1", "v4") or b in ("v1", "v4")) for (a, b), r in matrix.items())


def test_tile_sums_of_many_columns(spark, monkeypatch):
    """More columns than a scan's tiles hold, so several scans."""
    monkeypatch.setattr(moments, "TILE", 8)
    width = 8 * 21
    df = spark.range(200).select(F.col("id").alias("row_id"), *[((F.col("id") * (i % 17 + 1) + i) % 101).cast("double").alias(f"v{i}") for i in range(width)])
    t = Table(df, "wide", "row_id")
    live = [f"v{i}" for i in range(width)]
    sums = moments.pair_sums(t, live, dict.fromkeys(live, 50.0))
    x = np.array([[(k * (i % 17 + 1) + i) % 101 - 50.0 for i in range(width)] for k in range(200)])
    some = sums.where("b = a + 70").select("a", "b", "xy", "n").collect()
    assert len(some) == width - 70 and sums.count() == width * (width - 1) // 2
    assert all(r.n == 200 and r.xy == pytest.approx(x[:, r.a] @ x[:, r.b]) for r in some)


def test_spread_keeps_rows(spark):
    t = Table(spark.range(1000).coalesce(1).select(F.col("id").alias("row_id"), (F.col("id") % 7).alias("x")),
              "t", "row_id")
    wide = t.spread()
    assert wide.raw.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert wide.rows == 1000 and wide.facts() == t.facts()
    assert wide.spread() is wide
    wide.release()


def test_row_id_must_be_a_whole_number(spark):
    with pytest.raises(ValueError):
        Table(spark.createDataFrame([("a", 1)], "k string, x int"), "t", "k")


def test_composite_moves_no_row(spark, tmp_path):
    """Scores, table and panel of the fences and z-scores come from the scan; grouped records agree."""
    rng = np.random.default_rng(11)
    data = pd.DataFrame({"a": rng.normal(size=4000), "b": rng.normal(size=4000), "c": rng.exponential(size=4000)})
    data.loc[::97, ["a", "b"]] *= 6
    data.loc[5::131, "a"] = np.nan
    spark.createDataFrame(data).write.parquet(f"{tmp_path}/t")
    t = read_parquet(spark, f"{tmp_path}/t")
    rows = anomalies.flagged_rows(t, methods=("iqr", "zscore"))
    for df in (anomalies.composite_scores(rows), anomalies.with_composite(rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.replace("BroadcastExchange", "")  # offsets of the files
    records = anomalies.anomaly_records(t)
    every = anomalies.flagged_rows(t)
    got = {tuple(r) for r in anomalies.composite_scores(every).collect()}
    assert got == {tuple(r) for r in anomalies.composite_scores(records).collect()}
    plain = {}
    for r in records.collect():
        plain.setdefault(r.row_id, []).append(r)
    assert {len({r.method_used for r in found}) for found in plain.values()} >= {1, 2}
    for row, score, n in got:
        found = plain[row]
        assert n == len({r.method_used for r in found})
        assert score == pytest.approx(min(1.0, max(r.anomaly_score for r in found) + 0.15 * (n - 1)))
    panel = anomalies.anomaly_panel(t, every).first()
    assert (panel["records"], panel["rows_flagged"]) == (sum(map(len, plain.values())), len(plain))


def test_distinct_whole_numbers(table):
    """Negative, extreme, scattered and dense values, nulls, and a column without values."""
    from tabassay.functions.values import distinct_counts
    rng = random.Random(2)
    ends = [-2 ** 63, 2 ** 63 - 1, -1, 0, 63, 64, -64, -65]
    rows = [(rng.choice([*ends, None]), rng.randrange(-2 ** 62, 2 ** 62), i // 3, rng.randrange(-128, 128), None) for i in range(900)]
    t = table("ends bigint, far bigint, near int, tiny tinyint, none int", rows)
    want = {c: len({r[i] for r in rows} - {None}) for i, c in enumerate(t.columns)}
    assert distinct_counts(t, t.columns) == want


def test_first_dates_leave_the_facts_in_generated_code(spark):
    """A text by row id takes generated code away from its scan: beside many facts it has one of its own."""
    df = spark.range(300).select(F.col("id").alias("row_id"), *[(F.col("id") % (i + 2)).alias(f"n{i}") for i in range(10)],
                                 F.lit("01/12/2024").alias("ship_date"), F.lit("x").alias("word"))
    t = Table(df, "t", "row_id")
    plans = []

    class Spied:
        def agg(self, *named):
            made = t_df.agg(*named)
            plans.append(made._jdf.queryExecution().executedPlan().toString())
            return made

    t_df, t.df = t.df, Spied()
    insights_requests = quality.check_requests(t) | insights.pair_requests(t)
    assert not any(key == ("layout", "word") for key in insights_requests)  # its name is no date's
    t.declare(insights_requests)
    t.facts()
    assert len(plans) == 2 and "SortAggregate" not in plans[0] and "SortAggregate" in plans[1]
    assert t.layout("ship_date") == "M/d/yyyy" and len(plans) == 2
    assert t.layout("word") is None and len(plans) == 3


def test_quantiles_take_two_scans(spark, tmp_path):
    """One for the sketches, one that counts and keeps values, also where intervals are not empty."""
    n = 250_000
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"a": rng.normal(size=n), "b": rng.exponential(size=n), "c": rng.integers(0, 9, n).astype(float)})
    spark.createDataFrame(data).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    scans = []

    class Counted:
        sparkSession = spark

        def agg(self, *named):
            scans.append("agg")
            return df.agg(*named)

        def select(self, *columns):
            scans.append("select")
            return df.select(*columns)

    got = exact_quantiles(Counted(), {c: n for c in data}, [0.25, 0.5, 0.75])
    for c in data:
        assert got[c] == data[c].quantile([0.25, 0.5, 0.75]).to_list(), c
    assert scans == ["agg", "select"]


def test_large_columns_get_larger_sketches():
    from tabassay.functions.quantiles import LARGEST_SKETCH, SKETCH_SIZE, SORT_LIMIT, _fitting_size, _rank_slack
    assert _fitting_size(10_000) == SKETCH_SIZE and _fitting_size(10 ** 10) == LARGEST_SKETCH
    for n in (1_000_000, 9_000_000, 54_000_000):  # so that the values around a rank are kept in the second scan
        assert 2 * _rank_slack(_fitting_size(n)) * n < SORT_LIMIT


def test_spellings_from_one_grouping(table):
    """Only a column whose groups leave it open counts its spellings; the marks are those of counting all."""
    rows = [("Ab", "AB", "x", "p "), ("Ab", "AB", "y", "p"), ("ab", "ab", "z", "q"), ("c", "ab", "Z", "q"), ("c", "d", "w", None), (" c", "d", "v", None)]
    t = table("rare string, even string, unique string, padded string", rows)
    asked = []
    real = quality._rare_spellings
    quality._rare_spellings = lambda t, columns: asked.append(sorted(columns)) or real(t, columns)
    try:
        assert quality.spelling_facts(t) == {"rare": (True, True, True), "even": (False, False, True),
                                             "unique": (False, True, True), "padded": (True, False, False)}
    finally:
        quality._rare_spellings = real
    assert asked == [["even", "rare"]]


def test_value_counts_serve_distinct_counts(spark, table):
    from tabassay.functions.values import distinct_counts
    from tabassay.operators.profile import categorical_facts
    t = table("word string, other string, gap string", [(f"w{i % 7}", "same", None) for i in range(60)])
    categorical_facts(t)
    sc = spark.sparkContext
    sc.setJobGroup("distinct", "distinct")
    assert distinct_counts(t, ["word", "other", "gap"]) == {"word": 7, "other": 1, "gap": 0}
    assert not sc.statusTracker().getJobIdsForGroup("distinct")
    sc.setJobGroup("other", "other")
