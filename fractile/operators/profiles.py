"""Profiles of numeric columns: histograms and moments of long tables (dataset, column, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fractile.functions.histogram import cumulated, round4

LARGEST = float(2**53)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def to_values(df: DataFrame, dataset: Column, columns: list[str] | None = None) -> DataFrame:
    """(dataset, column, value) of every numeric column; only these columns are read."""
    names = columns if columns is not None else numeric_columns(df)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), df[n].cast("double").alias("value")) for n in names]))
    return df.select(dataset.cast("string").alias("dataset"), pairs.alias("p")).select("dataset", "p.column", "p.value")


def kept_values(values: DataFrame) -> DataFrame:
    """Without nulls, NaN and what is not strictly within 2^53 either side of 0."""
    return values.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") > -LARGEST) & (F.col("value") < LARGEST))


def moments(values: DataFrame, *keys: str) -> DataFrame:
    """mean and sample standard deviation of each column with more than one distinct value."""
    keys = keys or ("dataset", "column")
    rows = kept_values(values).groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("a"), F.max("value").alias("b"))
    return rows.where("a < b").drop("a", "b")


def random_bins(low: int, high: int, seed: int = 42) -> Column:
    """A seeded draw between low and high for each dataset and column, the same in every run."""
    return F.lit(low) + F.pmod(F.xxhash64(F.lit(seed), "dataset", "column"), F.lit(high - low + 1))


def automatic_bins() -> Column:
    """The larger of Sturges' and Freedman and Diaconis' counts."""
    n, spread = F.col("total"), F.col("max") - F.col("min")
    width = 2 * (F.col("q3") - F.col("q1")) / F.pow(n, F.lit(1.0 / 3.0))
    sturges = F.ceil(F.log2(n.cast("double")) + 1)
    return F.greatest(sturges, F.when(width > 0, F.ceil(spread / width)).otherwise(sturges)).cast("long")


def histograms(values: DataFrame, bins: Column | None = None, keys: tuple[str, ...] = ("dataset", "column"), scaling: float = 1.0, seed: int = 42) -> DataFrame:
    """One equi-width histogram a key: keys, edges, counts, total, and with scaling another copy number.

    bins may use the keys and the columns nunique, min, max, total; none asks for
    the automatic count. There are at most nunique - 1 bins; the last bin has its
    upper edge. Values are first counted by (key, rounded value), so that a large
    column is combined where it is read.
    """
    counted = kept_values(values).withColumn("value", round4(F.col("value"))).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    stats = [F.count(F.lit(1)).alias("nunique"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("n").alias("total")]
    if bins is None:
        stats += [F.percentile("value", q, F.col("n")).alias(a) for q, a in ((0.25, "q1"), (0.75, "q3"))]
    shape = counted.groupBy(*keys).agg(*stats).where("nunique > 1 AND min < max")
    if scaling != 1.0:
        copies = F.lit(int(scaling)) + (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 20)) < F.lit(int((scaling % 1) * (1 << 20)))).cast("int")
        shape = shape.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
        keys = (*keys, "copy")
    shape = shape.withColumn("n_bins", F.greatest(F.lit(1), F.least(F.col("nunique") - 1, automatic_bins() if bins is None else bins)).cast("int"))
    shape = shape.select(*keys, "min", "max", "n_bins", "total", ((F.col("max") - F.col("min")) / F.col("n_bins")).alias("width"))
    on = [k for k in keys if k != "copy"]
    rows = counted.join(shape.drop("total"), on)
    # The quotient may be off by one bin in the last digit: the edges decide.
    guess = F.least(F.floor((F.col("value") - F.col("min")) / F.col("width")).cast("int"), F.col("n_bins") - 1)
    edge = lambda k: F.col("min") + k * F.col("width")
    rows = rows.withColumn("k", guess)
    rows = rows.withColumn("k", F.when(F.col("value") < edge(F.col("k")), F.col("k") - 1).when((F.col("k") + 1 < F.col("n_bins")) & (F.col("value") >= edge(F.col("k") + 1)), F.col("k") + 1).otherwise(F.col("k")))
    bars = rows.groupBy(*keys, "k").agg(F.sum("n").alias("n"))
    bars = bars.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("bars"))  # as many entries as bins
    out = shape.join(bars, list(keys))
    inner = F.transform(F.sequence(F.lit(0), F.col("n_bins") - 1), lambda i: F.col("min") + i * F.col("width"))
    counts = F.transform(F.sequence(F.lit(0), F.col("n_bins") - 1), lambda i: F.coalesce(F.element_at("bars", i), F.lit(0).cast("long")))
    return out.select(*keys, F.concat(inner, F.array("max")).alias("edges"), counts.alias("counts"), "total")


def densities(hists: DataFrame) -> DataFrame:
    """With the shares of the bins in single precision."""
    return hists.withColumn("densities", F.transform("counts", lambda c: (c / F.col("total")).cast("float")))


def with_ids(hists: DataFrame, *order: str) -> DataFrame:
    """Dense ids from 0 in the order of these columns. Rows are ranked within ranges; only the ranges' sizes come to the driver."""
    order = order or ("dataset", "column")
    parts = hists.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    from fractile.plans.store import checkpointed

    parts = checkpointed(parts, "ids")
    sizes = {r["__part"]: r["count"] for r in parts.groupBy("__part").count().collect()}
    offset, base = 0, []
    for k in sorted(sizes):
        base += [F.lit(k), F.lit(offset)]
        offset += sizes[k]
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    first = F.element_at(F.create_map(*base), F.col("__part")) if base else F.lit(0)
    return parts.withColumn("hist_id", (first + rank).cast("long")).drop("__part")


def prepared(hists: DataFrame) -> DataFrame:
    """With the running sums that all evaluators read."""
    return hists if "cum" in hists.columns else hists.withColumn("cum", cumulated(F.col("counts")))
