"""Plumbing that several operators share: the shared folder, written tables, Arrow batches, components."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch. Texts may hold 100 KB and more, so Spark's 10,000 rows are too many.
BATCH_ROWS, BATCH_BYTES = 400, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of texts holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Only a local master may have its own."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hearken-"))
        found = sc.getCheckpointDir()
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: whoever owns the folder clears it
        pass


def file_system(uri: str):
    """(Arrow file system, path) of a folder or file; Hadoop's names of S3 are Arrow's s3."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and lost executors cost no recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Removes written tables that nothing reads any more, and lets go of the shuffle files of finished jobs, which else
    stay on disk until the driver happens to collect its garbage."""
    for path in {re.sub("/[^/]*$", "", f) for table in done for f in table.inputFiles()}:
        _remove(spark, path)
    spark.range(1).collect()  # listeners keep the plan of the execution that ended last, and so its shuffle files
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node of undirected `edges`: component is the smallest node reachable.

    Alternating large-star and small-star rounds, each checkpointed; their number grows with the logarithm of
    the longest chain. Hubs only meet aggregates with map-side combining and one-row sides of joins (AQE splits
    a skewed side). Loops and rows with a null end are ignored; no edges give no rows.
    """
    shared_dir(edges.sparkSession)
    a, b = F.least(u, v), F.greatest(u, v)
    now = edges.where(F.col(u) != F.col(v)).select(a.alias("u"), b.alias("v")).distinct().checkpoint()
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select("m", "v").where("m < v").distinct()
        down = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(down, "v").select(
            F.explode(F.array(F.struct(F.col("low").alias("u"), F.col("m").alias("v")), F.struct(F.col("low").alias("u"), F.col("v").alias("v")))).alias("e")
        )
        now = small.select("e.u", "e.v").where("u < v").distinct().checkpoint()
        said = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if said == state:
            break
        state = said
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots.distinct())


def text_of(column: str = "text") -> Column:
    """The text, empty if null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
