import pytest
from pyspark.sql import functions as F

from tabassay import Table
from tabassay.operators import forest


def points(spark, n=3000, parts=4):
    """A cloud with every hundredth point far away in both dimensions."""
    far = F.col("id") % 100 == 7
    df = spark.range(n).select(
        F.col("id").alias("row_id"),
        (F.sin(F.col("id") * 12.9898) * 2 + F.when(far, 40.0).otherwise(0.0)).alias("x"),
        (F.cos(F.col("id") * 78.233) * 3 - F.when(far, 55.0).otherwise(0.0)).alias("y"),
        F.when(F.col("id") % 50 != 3, (F.col("id") * 37 % 101).cast("double")).alias("gappy"),
        F.when(F.col("id") % 2 == 0, F.lit(1.0)).alias("mostly_missing"))
    return Table(df.repartition(parts, F.xxhash64("row_id")), "points", "row_id")


@pytest.fixture(scope="module")
def scored(spark):
    t = points(spark)
    return t, {r["row_id"]: r["score"] for r in forest.forest_scores(t).collect()}


def test_columns_with_many_gaps_are_left_out(scored):
    assert forest.forest_columns(scored[0]) == ["x", "y", "gappy"]


def test_scores_are_in_range(scored):
    assert len(scored[1]) == 3000 and all(0 < s < 1 for s in scored[1].values())


def test_planted_points_rank_first(scored):
    ranked = sorted(scored[1], key=scored[1].get, reverse=True)
    assert sum(r % 100 == 7 for r in ranked[:30]) >= 29


@pytest.mark.parametrize("parts", [1, 11])
def test_same_scores_for_any_partitioning(spark, scored, parts):
    other = {r["row_id"]: r["score"] for r in forest.forest_scores(points(spark, parts=parts)).collect()}
    assert other == scored[1]


@pytest.mark.parametrize("contamination", [0.01, 0.05, 0.15])
def test_flagged_share(scored, contamination):
    records = forest.forest_records(scored[0], contamination).collect()
    assert len(records) / 3000 == pytest.approx(contamination, abs=0.005)
    assert all(0 <= r["anomaly_score"] <= 1 for r in records)
    assert all(r["severity"] == ("high" if r["anomaly_score"] >= 0.7 else "moderate") for r in records)
    assert len({r["primary_driver_feature"] for r in records}) == 1


def test_scores_agree_with_walking_the_trees(spark, scored):
    """The array walk equals a plain walk over the same trees."""
    t = scored[0]
    columns = forest.forest_columns(t)
    feature, threshold, path, size = forest.fit(t, columns)
    rows = forest.features(t, columns).where("row_id < 40").collect()
    for r in rows:
        x, total = list(r)[1:], 0.0
        for k in range(len(feature)):
            slot = 0
            while slot < len(feature[k]):
                slot = 2 * slot + 1 + (x[feature[k][slot]] > threshold[k][slot])
            total += path[k][slot - len(feature[k])]
        want = 2 ** (-total / forest.GRID / len(feature) / forest.mean_path(size[0]))
        assert scored[1][r["row_id"]] == pytest.approx(want, rel=1e-12)


def test_pool_and_share_thinning_keep_whole_samples(spark):
    """Beyond the pool size every tree still gets its full sample."""
    n = 150_000
    df = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 1009).cast("double").alias("x"),
                               F.sin("id").alias("y"))
    feature, threshold, path, size = forest.fit(Table(df, "t", "row_id"), ["x", "y"], trees=5)
    assert size == [256] * 5 and path.shape == (5, 256) and len(feature) == 5


def test_too_small(table):
    assert forest.forest_records(table("a double, b double", [(1.0, 2.0)] * 9)).count() == 0
    assert forest.forest_records(table("a double", [(float(i),) for i in range(30)])).count() == 0
