"""Seconds and shuffled bytes of the plumbing query, without and with a runtime Bloom filter.

    python tools/shuffled_bytes.py FOLDER

Dimensions of fixed size are broadcast and both facts shuffled (broadcast limit 6,000
bytes). The filter's scan limit (10 GB) is lowered to 1 MB, which these tables reach.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from larkspan.plans.local_supplier_revenue import local_supplier_revenue  # noqa: E402

LIMIT = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"


def shuffled(plan) -> int:
    """Bytes written to shuffles by an executed plan, from Spark's own metrics."""
    total, waiting = 0, [plan]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            waiting.append(node.plan())
        else:
            found = node.metrics().get("shuffleBytesWritten")
            total += found.get().value() if found.isDefined() and "Exchange" in name else 0
            children = node.children()
            waiting += [children.apply(i) for i in range(children.size())]
    return total


def main(folder: str) -> None:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "32")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.autoBroadcastJoinThreshold", "6000")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for kind, enabled in (("plain", "false"), ("bloom", "true")):
        spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", enabled)
        spark.conf.set(LIMIT, "1m")
        local_supplier_revenue(spark, folder).collect()
        df = local_supplier_revenue(spark, folder)
        start = time.perf_counter()
        rows = sorted(map(tuple, df.collect()))
        took = round(time.perf_counter() - start, 2)
        mb = round(shuffled(df._jdf.queryExecution().executedPlan()) / 1e6, 1)
        print(json.dumps({"kind": kind, "seconds": took, "shuffled_mb": mb, "rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1].rstrip("/"))
