"""Dataset collections from files, tables and logs."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fractile.operators.profiles import numeric_columns, to_values


def files_in(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Full paths, through the file system that the folder names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(str(s.getPath()) for s in found if str(s.getPath().getName()).endswith(suffix))


def stem(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


#: Files whose schemas are looked up, or that are converted, at a time.
AT_ONCE = 16


def _each(paths: list[str], work: Callable[[str], object]) -> tuple[list[tuple[str, object]], list[tuple[str, str]]]:
    """(path, result) of those for which work succeeds and (path, error) of the others; many at a time, as each is a short job."""
    done, errors = [], []

    def one(path: str) -> None:
        try:
            done.append((path, work(path)))
        except Exception as e:  # noqa: BLE001
            errors.append((path, str(e).splitlines()[0]))

    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(one, paths))
    return sorted(done, key=lambda x: x[0]), sorted(errors)


def csv_to_parquet(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Each CSV file of a folder as Parquet; (file, error) of those that fail, which doesn't stop the others."""
    convert = lambda path: spark.read.csv(path, header=True, inferSchema=True, mode="FAILFAST").write.mode("overwrite").parquet(f"{out}/{stem(path)}.parquet")
    return spark.createDataFrame(_each(files_in(spark, folder, ".csv"), convert)[1], "file string, error string")


def read_collection(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Values (dataset, column, value) of every Parquet file or folder in a folder, each being a dataset; and (file, error) of those that can't be read. Files of one schema are one scan."""
    found, errors = _each(files_in(spark, folder, ".parquet"), lambda path: spark.read.parquet(path).schema)
    by_schema: dict[str, tuple[T.StructType, list[str]]] = {}
    for path, schema in found:
        by_schema.setdefault(schema.json(), (schema, []))[1].append(path)
    values = spark.createDataFrame([], "dataset string, column string, value double")
    inside = re.escape(folder.rstrip("/").rsplit("/", 1)[-1]) + r"/([^/]+)\.parquet(?:/[^/]*)*$"
    for schema, paths in by_schema.values():
        df = spark.read.schema(schema).parquet(*paths)
        if numeric_columns(df):
            name = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), inside, 1)
            values = values.unionByName(to_values(df, name))
    return values, spark.createDataFrame(errors, "file string, error string")


def read_histograms(spark: SparkSession, path: str) -> DataFrame:
    """Histograms made elsewhere, JSON lines with hist_id, edges and counts (or values for shares)."""
    rows = spark.read.schema("hist_id long, edges array<double>, counts array<long>").json(path)
    return rows.withColumn("total", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))


def trace_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, metric, value) of the TRACE lines `time | level | metric, value`."""
    parts = F.split("value", r"\|")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.trim(F.get(parts, F.lit(1))).alias("level"), F.split(F.get(parts, F.lit(2)), ",").alias("said"))
    return rows.where("level = 'TRACE'").select("line", F.trim(F.get("said", F.lit(0))).alias("metric"), F.trim(F.get("said", F.lit(1))).cast("double").alias("value"))


def logs_long(spark: SparkSession, path: str) -> DataFrame:
    return trace_lines(spark, path).select("metric", "value")


def logs_wide(spark: SparkSession, path: str) -> DataFrame:
    """metric and values of each metric in line order; only query_time may come more than once."""
    rows = trace_lines(spark, path).groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("all"))
    values = F.transform("all", lambda x: x["value"])
    twice = (F.col("metric") != "query_time") & (F.size("all") > 1)
    return rows.select("metric", F.when(twice, F.raise_error(F.concat(F.lit("more than one line for "), F.col("metric")))).otherwise(values).alias("values"))


def logs_times(spark: SparkSession, path: str) -> list[float]:
    """The two collection times of a log."""
    times = [r["value"] for r in trace_lines(spark, path).where("metric = 'query_collection_time'").orderBy("line").take(3)]
    if len(times) != 2:
        raise ValueError(f"a log has two collection times, this one {len(times)}")
    return times
