"""Helpers that several of these operators share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ASCII white space, as the word pattern [^\x20\x09-\x0D]+ has it.
SPACES = " \t\n\x0b\x0c\r"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each application.

    Functions that run there are imported by name, and a cluster need not have the package
    installed or on its path.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def with_package(query):
    """``query``, a function of a session first, with the package sent ahead."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        ship_package(spark)
        return query(spark, *args)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, without a final slash.

    It is the cluster's ``spark.checkpoint.dir``, or the checkpoint folder that the session
    was given. Only where both are unset and all runs in one process, as in tests, a new
    local folder is taken and set; on a cluster that is an error, as each machine would
    write to a disk of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/larkspan-{app}/{name}-{uuid.uuid4().hex}"


def portions(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Rows in portions of ``sizes`` of about ``most``, or one larger row."""
    ends, low = np.cumsum(sizes), 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield slice(low, high)
        low = high


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts the lineage: what follows is neither computed twice nor lost with an
    executor. The tables stay until the shared folder is cleared.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_ids(ids: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows of each label: those whose hashed ``doc_id`` is lowest.

    The choice depends on the ids alone, so a repeated run or task takes the same rows.
    Of a frequent label only ids hashed into the lowest share, which holds about twice
    ``per_label`` of them, are shuffled and ranked.
    """
    share = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / float(1 << 63)
    counts = ids.groupBy(F.col(label).alias("_of")).agg((2.0 * per_label / F.count("*")).alias("_share"))
    order = Window.partitionBy(label).orderBy("_hash", "doc_id")
    return (
        ids.withColumn("_hash", share)
        .join(counts, F.col(label) == F.col("_of"))
        .filter(F.col("_hash") <= F.col("_share"))
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= per_label)
        .select(ids.columns)
    )


# Words of 64 bits in which ids are marked at most: half a million, 8 MB of them.
MARK_WORDS = 1 << 19


def possibly_among(rows: DataFrame, ids: DataFrame, column: str, words: int = MARK_WORDS) -> DataFrame:
    """The ``rows`` whose ``column`` can be among the values that ``ids`` has there.

    Each value of ``ids`` sets the bit of its hash in one of ``words`` words, which are
    broadcast: their number is bounded whatever the ids. Rows whose bit is not set are
    dropped where they are read. All rows of ``ids`` pass, and of others as many as bits are
    set; with as many ids as bits about two thirds pass, so a join has to follow. A null is
    among none.
    """
    names = ["_word", "_marks"]
    while {n.lower() for n in names} & {c.lower() for c in rows.columns}:
        names = [n + "_" for n in names]
    place = F.pmod(F.xxhash64(column), F.lit(words * 64))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    marks = ids.filter(F.col(column).isNotNull()).groupBy(word.alias(names[0])).agg(F.bit_or(bit).alias(names[1]))
    marked = (F.col(names[0]) == word) & (F.col(names[1]).bitwiseAND(bit) != 0)
    return rows.filter(F.col(column).isNotNull()).join(F.broadcast(marks), marked, "left_semi")
