"""Indexes, collections and results as Parquet, with a small manifest."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = "fractile-index-1"
#: Rows, and bytes at eight for a number or array element, up to which a side of a join is broadcast.
SMALL, SMALL_BYTES = 100_000, 64_000_000

_written: list[tuple[SparkSession, str]] = []


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows and bytes, else as it is."""
    lists = [F.size(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    width = F.lit(len(df.columns)) + sum((F.greatest(n, F.lit(0)) for n in lists), F.lit(0))
    rows, numbers = df.select(width.alias("n")).limit(SMALL + 1).agg(F.count(F.lit(1)), F.sum("n")).first()
    return F.broadcast(df) if rows <= SMALL and 8 * (numbers or 0) <= SMALL_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its scan has too few tasks to use them, as one small file does; larger inputs stay as they are split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for intermediate tables, which is deleted when the process ends: under spark.checkpoint.dir, or an own folder where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='fractile-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/fractile/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def clear_scratch() -> None:
    """Delete the intermediate tables that this process has written."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            pass


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_index(index: DataFrame, clusters: DataFrame, members: DataFrame, path: str, method: str) -> None:
    """The index partitioned by cluster and sorted so that min/max statistics prune variant, bin and percentile; clusters, members and manifest beside it."""
    rows = index.repartition("cluster_id", "bin_no").sortWithinPartitions("variant", "bin_no", "pctl4", "hist_id")
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("cluster_id").parquet(f"{path}/index")
    save(clusters, f"{path}/clusters")
    save(members, f"{path}/members")
    save(index.sparkSession.createDataFrame([(FORMAT, method)], "format string, method string").coalesce(1), f"{path}/manifest")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """(index, clusters, members, method); the index is a lazy scan."""
    found = spark.read.parquet(f"{path}/manifest").first()
    if found is None or found["format"] != FORMAT:
        raise ValueError(f"no index of format {FORMAT}: {path}")
    index, members = spark.read.parquet(f"{path}/index"), load(spark, f"{path}/members")
    if exists(spark, f"{path}/index-batches"):
        index = index.unionByName(spark.read.parquet(f"{path}/index-batches").drop("batch"))
        members = members.unionByName(load(spark, f"{path}/member-batches").drop("batch"))
    return index.withColumn("cluster_id", F.col("cluster_id").cast("int")), load(spark, f"{path}/clusters"), members, found["method"]


def load_outliers(spark: SparkSession, path: str) -> DataFrame | None:
    """Histograms that came after the index was made and lie beyond its clusters' ranges; queries scan them."""
    return load(spark, f"{path}/outlier-batches").drop("batch") if exists(spark, f"{path}/outlier-batches") else None


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def is_index(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/manifest")


def save_results(queries: DataFrame, results: DataFrame, path: str) -> None:
    save(queries, f"{path}/queries")
    save(results, f"{path}/results")


def load_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, f"{path}/queries"), load(spark, f"{path}/results")


def suppressed(results: DataFrame) -> None:
    """Compute all and keep nothing, for timing."""
    results.write.format("noop").mode("overwrite").save()


def index_size(index: DataFrame) -> DataFrame:
    """n_rows, and bytes at two for a percentile and four for an id."""
    return index.agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) * 6).alias("n_bytes"))
