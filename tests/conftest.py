import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
for p in (ROOT, ROOT / "tools"):
    sys.path.insert(0, str(p))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Build a Table from literal rows; row ids are the positions."""
    from tabassay import Table

    def make(columns, rows, **options):
        names = [c.split()[0] for c in columns.split(",")]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row_id bigint, {columns}")
        assert df.columns[1:] == names
        return Table(df, "literal", "row_id", **options)
    return make


def by_column(df):
    return {r["column"]: r for r in df.collect()}
