"""Plan shape and skew of the plumbing query."""

import re

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from larkspan.plans.local_supplier_revenue import (
    DISCOUNT,
    LOCAL_SUPPLIER_REVENUE_SQL,
    PRICE,
    exactly,
    local_supplier_revenue,
)
from larkspan.sources import TABLES, table
from tests.oracle_check import assert_same, oracle_rows

SF_DIR = "/root/testdata/sf0.01"


def executed_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan, column):
    return [line for line in plan.splitlines() if "FileScan" in line and column in line]


def test_scans_read_only_what_is_needed(spark, conf):
    conf("spark.sql.maxMetadataStringLength", "1000")
    plan = executed_plan(local_supplier_revenue(spark, SF_DIR))
    (orders,) = scans(plan, "o_orderkey")
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in orders
    assert "LessThan(o_orderdate,1997-01-01T00:00)" in orders
    (lineitem,) = scans(plan, "l_orderkey")
    schema = lineitem.split("ReadSchema: ")[1]
    assert re.findall(r"(\w+):(?:bigint|double|int|string|timestamp)", schema) == [
        "l_orderkey",
        "l_suppkey",
        "l_extendedprice",
        "l_discount",
    ]


def test_lines_are_summed_before_the_supplier_shuffle(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = executed_plan(local_supplier_revenue(spark, SF_DIR))
    lines = plan.splitlines()
    exchanges = [
        i for i, line in enumerate(lines) if "Exchange hashpartitioning(l_suppkey" in line
    ]
    assert len(exchanges) == 1
    assert "partial_sum" in lines[exchanges[0] + 1]


def test_broadcast_suppliers_filter_before_the_sum(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "10m")
    lines = executed_plan(local_supplier_revenue(spark, SF_DIR)).splitlines()
    (exchange,) = [
        i for i, line in enumerate(lines) if "Exchange hashpartitioning(l_suppkey" in line
    ]
    assert "partial_sum" in lines[exchange + 1]
    assert "BroadcastHashJoin [l_suppkey" in lines[exchange + 2]


def test_large_data_plan(spark, conf):
    """A limit between ``nation`` and ``supplier``, where large tables are: the dimensions
    of fixed size are broadcast, the facts are shuffled on their keys."""
    conf("spark.sql.autoBroadcastJoinThreshold", "6000")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "6000")
    df = local_supplier_revenue(spark, "/root/testdata/sf0.1")
    plan = executed_plan(df)
    lines = plan.splitlines()
    joins = [line for line in lines if "Join" in line]
    for key in ("n_regionkey", "c_nationkey", "s_nationkey"):
        assert any("BroadcastHashJoin" in j and key in j for j in joins), plan
    for keys in ("[o_custkey", "[l_orderkey", "[l_suppkey"):
        assert any("SortMergeJoin" in j and keys in j for j in joins), plan
    assert not any("BroadcastExchange" in line and "l_orderkey" in line for line in lines)
    (at,) = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(l_suppkey" in line]
    assert "partial_sum" in lines[at + 1]
    assert assert_same(df, "/root/testdata/sf0.1", LOCAL_SUPPLIER_REVENUE_SQL)


def test_bloom_filter_prunes_the_lines(spark, conf):
    """With the limits lowered to this data, lines are tested against the orders kept
    before they are shuffled, and the result is the same."""
    conf("spark.sql.autoBroadcastJoinThreshold", "3000")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "3000")
    conf("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    conf("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1")
    df = local_supplier_revenue(spark, SF_DIR)
    plan = executed_plan(df)
    assert "might_contain" in plan and "xxhash64(l_orderkey" in plan, plan
    assert assert_same(df, SF_DIR, LOCAL_SUPPLIER_REVENUE_SQL)


PLAIN_SQL = """
    SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue
    FROM region, nation, customer, orders, lineitem, supplier
    WHERE r_name = 'ASIA' AND n_regionkey = r_regionkey AND c_nationkey = n_nationkey
      AND o_custkey = c_custkey AND l_orderkey = o_orderkey AND s_suppkey = l_suppkey
      AND s_nationkey = c_nationkey AND year(o_orderdate) = 1996
    GROUP BY n_name
"""


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_agrees_with_plain_doubles(spark, sf):
    """An oracle that shares no cast with the query."""
    sf_dir = f"/root/testdata/sf{sf}"
    want = dict(oracle_rows(sf_dir, PLAIN_SQL)[1])
    got = {r.n_name: r.revenue for r in local_supplier_revenue(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    assert all(got[n] == pytest.approx(want[n], rel=1e-9) for n in want)


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize(
    ("column", "value"),
    [
        ("l_extendedprice", "100.005"),
        ("l_extendedprice", "1e11"),
        ("l_extendedprice", "double('NaN')"),
        ("l_discount", "0.105"),
    ],
)
def test_inexact_money_is_an_error(spark, conf, ansi, column, value):
    conf("spark.sql.ansi.enabled", ansi)
    kind = PRICE if column == "l_extendedprice" else DISCOUNT
    row = spark.sql(f"SELECT cast({value} as double) AS {column}")
    with pytest.raises(PySparkException, match=f"{column} is no decimal"):
        row.select(exactly(column, kind)).collect()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_exact_money_and_null(spark, conf, ansi):
    conf("spark.sql.ansi.enabled", ansi)
    rows = spark.sql("SELECT * FROM VALUES (100.01D), (9999999999.99D), (NULL) AS t(l_extendedprice)")
    got = [r[0] for r in rows.select(exactly("l_extendedprice", PRICE)).collect()]
    assert [None if x is None else str(x) for x in got] == ["100.01", "9999999999.99", None]


def test_a_line_with_three_decimals_fails_the_query(spark, tmp_path):
    for name in TABLES:
        df = table(spark, "/root/testdata/sf0.001", name)
        if name == "lineitem":
            df = df.withColumn("l_extendedprice", F.col("l_extendedprice") + 0.005)
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    with pytest.raises(PySparkException, match="l_extendedprice is no decimal"):
        local_supplier_revenue(spark, str(tmp_path)).collect()


def test_no_unbounded_operator(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = executed_plan(local_supplier_revenue(spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoop", "BroadcastExchange", "Python"):
        assert operator not in plan
    assert "SinglePartition" not in plan


def hot(column, key, row_key):
    """A third of all rows, chosen by hash, take one key."""
    return F.when(F.hash(row_key) % 3 == 0, F.lit(key)).otherwise(F.col(column))


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    """One customer holds a third of the orders; one order and one supplier each
    hold a third of the lines. All three are ones the query keeps."""
    base = "/root/testdata/sf0.1"
    out = tmp_path_factory.mktemp("skewed")
    sql = """
        SELECT c_custkey, o_orderkey, s_suppkey
        FROM region JOIN nation ON n_regionkey = r_regionkey
        JOIN customer ON c_nationkey = n_nationkey
        JOIN orders ON o_custkey = c_custkey
        JOIN supplier ON s_nationkey = c_nationkey
        WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-02-01'
          AND o_orderdate < TIMESTAMP '1996-03-01'
        ORDER BY ALL LIMIT 1
    """
    custkey, orderkey, suppkey = oracle_rows(base, sql)[1][0]
    for name in TABLES:
        df = table(spark, base, name)
        if name == "orders":
            # The hot order keeps its customer, so that its lines stay in the result.
            df = df.withColumn(
                "o_custkey",
                F.when(F.col("o_orderkey") == orderkey, F.lit(custkey)).otherwise(
                    hot("o_custkey", custkey, "o_orderkey")
                ),
            )
        if name == "lineitem":
            row = F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
            df = df.select("*", row.alias("row_key"))
            df = df.withColumn("l_orderkey", hot("l_orderkey", orderkey, "row_key"))
            df = df.withColumn(
                "l_suppkey", hot("l_suppkey", suppkey, F.hash("row_key") + F.lit(1))
            ).drop("row_key")
        # Many files, as on a cluster: a hot key is split along the map tasks that wrote it.
        df.repartition(16).write.parquet(str(out / f"{name}.parquet"))
    return str(out)


def single_files(skewed_dir, tmp_path):
    """The same tables as one file each, which is what the oracle reads."""
    for name in TABLES:
        duckdb.sql(
            f"COPY (SELECT * FROM read_parquet('{skewed_dir}/{name}.parquet/*.parquet'))"
            f" TO '{tmp_path}/{name}.parquet' (FORMAT parquet)"
        )
    return str(tmp_path)


def test_hot_keys(spark, conf, skewed_dir, tmp_path):
    lineitem = table(spark, skewed_dir, "lineitem")
    for column in ("l_orderkey", "l_suppkey"):
        top = lineitem.groupBy(column).count().agg(F.max("count")).first()[0]
        assert top > 0.3 * lineitem.count()

    # Small limits, so that this little data takes the way of large data.
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.shuffle.partitions", "64")
    conf("spark.sql.files.maxPartitionBytes", "1m")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "8k")
    df = local_supplier_revenue(spark, skewed_dir)
    assert assert_same(df, single_files(skewed_dir, tmp_path), LOCAL_SUPPLIER_REVENUE_SQL)
    final = executed_plan(df).split("== Initial Plan ==")[0]
    joins = [line for line in final.splitlines() if "SortMergeJoin(skew=true)" in line]
    for column in ("[l_orderkey", "[o_custkey"):
        assert any(column in line for line in joins), final


def test_hot_nation(spark, conf, tmp_path):
    """With broadcasting off, customers and suppliers are shuffled on 25 nation keys; one
    nation holds a third of each and is split."""
    base = "/root/testdata/sf0.1"
    asia = "SELECT min(n_nationkey) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"
    ((nation,),) = oracle_rows(base, asia)[1]
    out = tmp_path / "hot"
    for name in TABLES:
        df = table(spark, base, name)
        if name == "customer":
            df = df.withColumn("c_nationkey", hot("c_nationkey", nation, "c_custkey"))
        if name == "supplier":
            df = df.withColumn("s_nationkey", hot("s_nationkey", nation, "s_suppkey"))
        df.repartition(16).write.parquet(str(out / f"{name}.parquet"))
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.shuffle.partitions", "64")
    conf("spark.sql.files.maxPartitionBytes", "64k")
    conf("spark.sql.files.openCostInBytes", "1k")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "2k")
    df = local_supplier_revenue(spark, str(out))
    assert assert_same(df, str(out), LOCAL_SUPPLIER_REVENUE_SQL)
    final = executed_plan(df).split("== Initial Plan ==")[0]
    joins = [line for line in final.splitlines() if "SortMergeJoin(skew=true)" in line]
    assert any("[c_nationkey" in line for line in joins), final
