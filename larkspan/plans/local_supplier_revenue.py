"""Revenue per nation from orders served by a supplier of the customer's nation.

A check that session, tables and oracle work together, as planned in
query 5 of the public TPC-H benchmark, "local supplier volume".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.sources import table

# Prices and discounts have two decimals. 12 + 5 digits keep each product in one
# long, and a decimal sum does not depend on the order in which tasks finish.
PRICE = "decimal(12,2)"
DISCOUNT = "decimal(3,2)"
TOLERANCE = 1e-6


def exactly(column: str, kind: str) -> Column:
    """The double ``column`` as a decimal; a value that the decimal can't hold is an error.

    An error are more decimals than ``kind`` has, an overflow and NaN, in any session:
    nothing here depends on the ANSI setting. NULL stays NULL.
    """
    stored = F.col(column)
    held = stored.try_cast(kind)
    # NULL <= x is neither true nor false, so an overflow ends in the error as well.
    close = F.abs(held.cast("double") - stored) <= TOLERANCE
    told = F.concat(F.lit(f"{column} is no {kind}: "), stored.cast("string"))
    return F.when(stored.isNull() | close, held).otherwise(F.raise_error(told).cast(kind))


def local_supplier_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per ASIA nation in 1996: columns ``n_name`` and ``revenue``."""
    asia = table(spark, sf_dir, "region").filter(F.col("r_name") == "ASIA")
    nation = table(spark, sf_dir, "nation").join(
        asia, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi"
    )
    nation_keys = nation.select("n_nationkey")

    customer = (
        table(spark, sf_dir, "customer")
        .join(nation_keys, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
        .select("c_custkey", "c_nationkey")
    )
    supplier = (
        table(spark, sf_dir, "supplier")
        .join(nation_keys, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
        .select("s_suppkey", "s_nationkey")
    )
    # A range on the stored column reaches the parquet scan; year(o_orderdate) would not.
    orders = (
        table(spark, sf_dir, "orders")
        .filter(
            F.expr(
                "o_orderdate >= timestamp_ntz '1996-01-01'"
                " and o_orderdate < timestamp_ntz '1997-01-01'"
            )
        )
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_nationkey")
    )
    revenue = exactly("l_extendedprice", PRICE) * (1 - exactly("l_discount", DISCOUNT))

    # Summing per supplier before the supplier join folds a hot supplier to one row
    # per task, and the join then reuses the aggregate's partitioning. Where the
    # suppliers can be broadcast, Catalyst moves the semi join below the sum instead.
    per_supplier = (
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_suppkey", "c_nationkey")
        .agg(F.sum(revenue).alias("revenue"))
    )
    per_nation = (
        per_supplier.join(
            supplier,
            (F.col("l_suppkey") == F.col("s_suppkey"))
            & (F.col("c_nationkey") == F.col("s_nationkey")),
            "left_semi",
        )
        .groupBy("c_nationkey")
        .agg(F.sum("revenue").alias("revenue"))
    )
    return per_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_name", F.col("revenue").cast("double").alias("revenue")
    )


LOCAL_SUPPLIER_REVENUE_SQL = """
SELECT n_name,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))
                * (1 - CAST(l_discount AS DECIMAL(3,2)))) AS DOUBLE) AS revenue
FROM region
JOIN nation   ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey
JOIN orders   ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey
WHERE r_name = 'ASIA'
  AND o_orderdate >= TIMESTAMP '1996-01-01'
  AND o_orderdate < TIMESTAMP '1997-01-01'
GROUP BY n_nationkey, n_name
"""
