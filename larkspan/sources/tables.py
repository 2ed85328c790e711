"""The supplied parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The stored schemas.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
        " c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
        " p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
        " value double, props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

TABLES = tuple(SCHEMAS)


def table(spark: SparkSession, sf_dir: str, name: str, checked: bool = True) -> DataFrame:
    """Read one table; the path may be a single file or a directory of parts.

    Only declared columns are read. One that the files lack is an error, as Spark would
    otherwise read it as NULL. Finding that out costs one more listing of the files and a
    small job that reads the footer of one of them, per table; ``checked=False`` leaves it
    out, for tables that are known to be complete. A type that differs is Spark's to judge:
    it widens where it can and fails where it can't.
    """
    if name not in SCHEMAS:
        raise ValueError(f"unknown table {name!r}; expected one of {', '.join(TABLES)}")
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = spark.read.schema(SCHEMAS[name]).parquet(path)
    if checked:
        stored = spark.read.parquet(path).columns
        missing = [c for c in df.columns if c not in stored]
        if missing:
            raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(stored)}")
    return df
