"""Copy the star tables with orders and lines repeated under new order keys.

    python tools/grow_tables.py /root/testdata/sf0.1 FOLDER 30

makes FOLDER a table folder for ``bench.py`` with 30 times the orders and lines; the other
tables stay as they are. Key k becomes k, k + step, k + 2 step and so on, where step is
beyond the largest key, so every copy joins as the first does.
"""

from __future__ import annotations

import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from larkspan.sources import table  # noqa: E402

STAR = ("region", "nation", "customer", "supplier", "part")


def grow(spark: SparkSession, source: str, target: str, times: int) -> None:
    step = 1 + table(spark, source, "orders").agg(F.max("o_orderkey")).first()[0]
    copies = spark.range(times).select((F.col("id") * step).alias("moved"))
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        rows = table(spark, source, name)
        grown = rows.crossJoin(F.broadcast(copies)).withColumn(key, F.col(key) + F.col("moved"))
        grown.select(rows.columns).repartition(32).write.parquet(f"{target}/{name}.parquet")
    for name in STAR:
        table(spark, source, name).write.parquet(f"{target}/{name}.parquet")


if __name__ == "__main__":
    cpus = os.environ.get("BENCH_CPUS", "8")
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    grow(session, sys.argv[1], sys.argv[2], int(sys.argv[3]))
    session.stop()
