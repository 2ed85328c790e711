import duckdb
import pytest

from larkspan.sources import TABLES, table

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", TABLES)
def test_reads_every_row(spark, name):
    want = duckdb.sql(f"SELECT count(*) FROM '{SF_DIR}/{name}.parquet'").fetchall()[0][0]
    assert table(spark, SF_DIR, name).count() == want


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
@pytest.mark.parametrize("name", TABLES)
def test_declared_schema_is_the_stored_one(spark, name, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    stored = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    assert table(spark, sf_dir, name).schema == stored.schema


def test_trailing_slash(spark):
    assert table(spark, SF_DIR + "/", "region").count() == 5


def test_directory_of_parts(spark, tmp_path):
    orders = table(spark, SF_DIR, "orders")
    orders.repartition(4).write.parquet(str(tmp_path / "orders.parquet"))
    parts = table(spark, str(tmp_path), "orders")
    assert parts.schema == orders.schema
    assert parts.exceptAll(orders).isEmpty() and orders.exceptAll(parts).isEmpty()


def test_unknown_table(spark):
    with pytest.raises(ValueError, match="unknown table 'order'"):
        table(spark, SF_DIR, "order")


@pytest.mark.parametrize("change", ["r_regionkey", "r_regionkey, r_name AS name"])
def test_missing_or_renamed_column_is_an_error(spark, tmp_path, change):
    duckdb.sql(
        f"COPY (SELECT {change} FROM '{SF_DIR}/region.parquet') TO '{tmp_path}/region.parquet' (FORMAT parquet)"
    )
    with pytest.raises(ValueError, match="no column r_name"):
        table(spark, str(tmp_path), "region")
    # Spark's own reading, for those who ask for it.
    names = {r.r_name for r in table(spark, str(tmp_path), "region", checked=False).collect()}
    assert names == {None}


def test_further_columns_are_not_read(spark, tmp_path):
    duckdb.sql(
        f"COPY (SELECT *, 1 AS more FROM '{SF_DIR}/region.parquet') TO '{tmp_path}/region.parquet' (FORMAT parquet)"
    )
    assert table(spark, str(tmp_path), "region").columns == ["r_regionkey", "r_name"]
