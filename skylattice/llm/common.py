"""Shared helpers: table access, written intermediate tables, connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words: space and the control characters 9 to 13. bytes.split() without
#: arguments cuts at exactly these.
WORD_GAP = "[\\x20\\x09-\\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one of our own if all tasks run
    in this machine's process; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = got.get() if got.isDefined() else None
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Bytes of an Arrow batch: ten thousand long texts at once are more than a Python worker should hold.
BATCH_BYTES = "4m"


def bounded(df: DataFrame) -> DataFrame:
    """df, for a Python stage: batches of its session hold BATCH_BYTES (and the last row) at most."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many _ after it as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read from there: lineage ends here,
    and a lost executor costs nothing. The files go when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def keep(spark: SparkSession, path: str) -> None:
    """A folder under the shared one that goes when the driver's Python ends."""
    _written.append((spark, path))


def discard(df_paths: list[str], spark: SparkSession) -> None:
    """Delete written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in df_paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def last_written() -> str:
    return _written[-1][1]


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                discard([path], spark)
        except Exception:  # the session has ended: its folder goes with it
            return


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (node, root): root is the smallest node that can be reached.

    Alternates large-star and small-star steps, each a join and an aggregate, until the edge set
    stays as it is; every round is written to the shared folder, so lineage does not grow. Nodes
    without an edge have no row. Self-loops, repeated edges and both directions are allowed; edges
    with a null end are ignored.
    """
    spark = edges.sparkSession
    cur = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    path = last_written()
    mark = _mark(cur)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        cur = written(small.where("a <> b").distinct())
        discard([path], spark)
        path, was, mark = last_written(), mark, _mark(cur)
        if was == mark:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free digest of the edge set."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.sum(F.xxhash64("b", "a") % 998_244_353)).first())
