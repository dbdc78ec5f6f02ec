"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it, for Java regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a small side is broadcast; beyond it `attach` salts instead.
BROADCAST_ROWS = 100_000

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or an own one where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='fractile-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and lost executors cost no recomputation beyond it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/fractile/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def map_frames(rows: DataFrame, task: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], key: str, schema: str) -> DataFrame:
    """mapInPandas with the whole-number column key first, which travels as text: pandas would make the numbers of a batch with a null one doubles, and these hold 53 bits."""
    out = rows.withColumn(key, F.col(key).cast("string")).mapInPandas(task, f"{key} string, {schema}")
    return out.withColumn(key, F.col(key).cast("long"))


def drawn(draw: Column, share: float) -> Column:
    """Whether a 64-bit hash falls in the lowest such share of its range."""
    return draw <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))


#: Groups that `rejoin` salts: the largest ones, at most so many. All others hold under 1 / HOT_GROUPS of the rows.
HOT_GROUPS = 1000


def rejoin(rows: DataFrame, groups: DataFrame, key: str, size: str, deal: str, salts: int = 64) -> DataFrame:
    """Inner join of many rows to their groups (one row a key) where a key may hold a third of all rows: the keys of the largest groups, by the column size, are dealt over all salts by the column deal."""
    hot = groups.orderBy(F.desc(size), key).limit(HOT_GROUPS).select(F.col(key).alias("__hot"))
    spread = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    left = rows.join(F.broadcast(hot), rows[key] == F.col("__hot"), "left")
    left = left.withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(deal), F.lit(salts))).otherwise(F.lit(0).cast("long"))).drop("__hot")
    right = groups.join(F.broadcast(hot), groups[key] == F.col("__hot"), "left")
    right = right.withColumn("__salt", F.explode(F.when(F.col("__hot").isNotNull(), spread).otherwise(F.array(F.lit(0).cast("long"))))).drop("__hot")
    return left.join(right, [key, "__salt"]).drop("__salt")


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


def attach(big: DataFrame, small: DataFrame, key: str, salts: int = 64, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join on a possibly hot key, null-safe: small (one row a key, already written) is broadcast while it has at most `limit` rows, else it is repeated once a salt and big is dealt by key and salt."""
    right = small.withColumnRenamed(key, "__key")
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(right), big[key].eqNullSafe(right["__key"]), "left").drop("__key")
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)))
    right = right.withColumn("__salt_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, left[key].eqNullSafe(right["__key"]) & (left["__salt"] == right["__salt_r"]), "left").drop("__key", "__salt", "__salt_r")
