"""Growing a collection: histograms that arrive as a stream enter an index whose clusters stay as they are.

A cluster's edges answer for references beyond them too (none or all of its
members match), which holds for histograms within its range only. Those that no
cluster's range holds are kept as they are beside the index, and queries scan them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fractile.operators.index import create_index
from fractile.plans.store import checkpointed, small


def assigned(hists: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, hist_id): the cluster with the narrowest range that holds a histogram's; histograms that none holds are left out."""
    ends = clusters.select("cluster_id", F.element_at("edges", 1).alias("a"), F.element_at("edges", -1).alias("b"))
    rows = hists.select("hist_id", F.element_at("edges", 1).alias("low"), F.element_at("edges", -1).alias("high"))
    rows = rows.join(small(ends), (F.col("a") <= F.col("low")) & (F.col("high") <= F.col("b")))
    best = rows.groupBy("hist_id").agg(F.min(F.struct((F.col("b") - F.col("a")).alias("span"), "cluster_id")).alias("m"))
    return best.select("m.cluster_id", "hist_id")


def append(batch: DataFrame, clusters: DataFrame, path: str, method: str, batch_id: int) -> None:
    """One batch into its own folders of the index, so that a batch that runs again replaces itself."""
    members = checkpointed(assigned(batch, clusters), "members")
    rows = create_index(batch, members, clusters, method)
    rows.sortWithinPartitions("variant", "bin_no", "pctl4", "hist_id").write.mode("overwrite").parquet(f"{path}/index-batches/batch={batch_id}")
    members.write.mode("overwrite").parquet(f"{path}/member-batches/batch={batch_id}")
    batch.join(members, "hist_id", "left_anti").select("hist_id", "edges", "counts", "total").write.mode("overwrite").parquet(f"{path}/outlier-batches/batch={batch_id}")


def grow(stream: DataFrame, clusters: DataFrame, path: str, checkpoint: str, method: str = "conversion") -> StreamingQuery:
    """stream: (hist_id, edges, counts, total). Runs over what is there and stops."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, k: append(batch, clusters, path, method, k)).start()


def grown(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index rows, members, outliers) that batches have added."""
    return tuple(spark.read.parquet(f"{path}/{name}-batches").drop("batch") for name in ("index", "member", "outlier"))


def without_ids(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """An index or members after the removal of histograms."""
    return rows.join(gone.select("hist_id"), "hist_id", "left_anti").select(*rows.columns)
