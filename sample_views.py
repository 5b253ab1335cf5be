"""Inputs of the registered queries: the given tables, and a view of orders with planted defects."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tabassay import Table
from tabassay.sources.table import file_row_ids

# Runs unchanged in Spark and DuckDB.
DQ_ORDERS = """
WITH base AS (
  SELECT o_orderkey AS k, o_totalprice AS p, o_orderpriority AS pr, o_orderdate AS od FROM {orders}
), dirty AS (
  SELECT
    k * 4 AS row_id,
    k AS k0,
    k AS order_id,
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 97 = 0 THEN -p ELSE p END AS amount,
    CASE WHEN k BETWEEN 100 AND 399 THEN NULL ELSE p * 0.07 + 1 END AS amount_tax,
    CASE WHEN k % 8 = 0 THEN p * 1.5 ELSE p * 0.9 END AS price_low,
    p AS price_high,
    CASE WHEN k % 50 = 0 THEN p * 1000 ELSE p END AS skewed,
    CAST(CASE WHEN k % 16 = 0 THEN 1000 + k % 7 ELSE k % 5 END AS DOUBLE) AS spiky,
    CAST(k % 3 AS INT) AS tier,
    sqrt(-2 * ln(CAST((k * 7919) % 15000 * 2 + 1 AS DOUBLE) / CAST(30000 AS DOUBLE)))
      * cos(pi() * CAST((k * 104729) % 14983 * 2 + 1 AS DOUBLE) / CAST(14983 AS DOUBLE)) AS gauss,
    CASE WHEN k % 20 = 0 THEN 'HOLD' ELSE 'OK' END AS status,
    CASE WHEN k % 30 = 0 THEN concat(' ', pr) WHEN k % 31 = 0 THEN lower(pr) ELSE pr END AS priority,
    concat('ref-', CAST(k AS STRING)) AS ref_code,
    CASE WHEN k % 40 = 0 THEN 'not-a-date' ELSE substr(CAST(od AS STRING), 1, 10) END AS event_date,
    CASE WHEN k % 2 = 0 THEN NULL ELSE 'x' END AS middle_name,
    concat('order ', CAST(k AS STRING), ' was packed and shipped with priority class ', pr) AS notes
  FROM base
)
SELECT row_id, order_id, amount, amount_tax, price_low, price_high, skewed, spiky, tier, gauss,
       status, priority, ref_code, event_date, middle_name, notes FROM dirty
UNION ALL
SELECT row_id + 1, order_id, amount, amount_tax, price_low, price_high, skewed, spiky, tier, gauss,
       status, priority, ref_code, event_date, middle_name, notes FROM dirty WHERE k0 % 100 = 0
UNION ALL
SELECT row_id + 2, order_id + 1000000, amount, amount_tax, price_low, price_high, skewed, spiky, tier, gauss,
       status, priority, ref_code, event_date, middle_name, notes FROM dirty WHERE k0 % 250 = 1
"""


# Month first, with gaps and texts that are no dates. Runs unchanged in Spark and DuckDB.
US_ORDERS = """
SELECT o_orderkey AS row_id, o_orderkey AS order_id,
  CASE WHEN o_orderkey % 45 = 0 THEN 'soon' WHEN o_orderkey % 77 = 0 THEN NULL
    ELSE concat(substr(CAST(o_orderdate AS STRING), 6, 2), '/', substr(CAST(o_orderdate AS STRING), 9, 2), '/',
                substr(CAST(o_orderdate AS STRING), 1, 4)) END AS ship_date,
  concat(substr(CAST(o_orderdate AS STRING), 6, 2), '/', substr(CAST(o_orderdate AS STRING), 9, 2), '/',
         substr(CAST(o_orderdate AS STRING), 1, 4)) AS paid_date
FROM {orders}
"""


def us_orders(spark: SparkSession, sf_dir: str) -> Table:
    orders = f"parquet.`{sf_dir}/orders.parquet`"
    return Table(spark.sql(US_ORDERS.format(orders=orders)), "us_orders", "row_id")


def dq_orders(spark: SparkSession, sf_dir: str) -> Table:
    orders = f"parquet.`{sf_dir}/orders.parquet`"
    return Table(spark.sql(DQ_ORDERS.format(orders=orders)), "dq_orders", "row_id")


def given(spark: SparkSession, sf_dir: str, name: str, key: str | None = None,
          rename: dict[str, str] | None = None) -> Table:
    """A given table; ``key`` is copied to the technical row id and stays a data column."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if key is None:
        df = file_row_ids(df)
    else:
        df = df.select(df[key].alias("row_id"), "*")
    for old, new in (rename or {}).items():
        df = df.withColumnRenamed(old, new)
    return Table(df, name, "row_id")
