"""Mixing sources to target weights by capped water-filling, in DataFrame operations.

Sources share a budget by weight; a source's target stops at `max_epochs` times
its size and what it can't take goes to the others by weight. With sources in
order of cap / weight the stopped ones are a prefix, so one running sum finds
the level at which the rest stand; no repeated rounds are needed.

A source then gives floor(target / size) whole repetitions of each document and
one fractional repetition: documents in the order of a seeded digest of their
doc_id until the remaining words are reached. The document on the boundary
gives just the words that are missing, so each source meets its target to the
word. The boundary is found in two steps (sums of BUCKETS digest ranges, then
the keys of one range), so no task ever orders a whole source.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; null ids share one digest key; rows with equal keys share their
words evenly, rounded down; sources without words have target 0; an empty table
gives an empty one; other columns, whatever their names, pass untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fractile.llm.common import WORD, attach, scratch, table, text_of

BUCKETS = 4096
SEED = 17
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2.0


def _size(docs: DataFrame) -> Column:
    return F.regexp_count(text_of(docs), F.lit(WORD)).cast("long")


def _key(docs: DataFrame, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))))


def water_fill(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """sizes (source, source_size) with target: weights go round the sources by code point, null last."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    rows = rows.withColumns({
        "rank": F.row_number().over(by_level),
        "caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "used": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "weights": F.sum("weight").over(whole),
        "budget": F.lit(share) * F.sum("source_size").over(whole),
    })
    rows = rows.withColumn("level", (F.col("budget") - F.col("caps")) / (F.col("weights") - F.col("used")))
    rows = rows.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")), F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("rank"))).over(whole))
    return rows.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def boundaries(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sized documents, one row per source): target, whole repetitions, and the key at which the fractional repetition ends with how many of that key's words it takes. Both are written to the shared folder."""
    sized = scratch(docs.select("doc_id", "source", _size(docs).alias("size"), _key(docs, seed).alias("key")), "mix-sizes")
    bucket = F.conv(F.substring("key", 1, 3), 16, 10).cast("int")
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    sums = scratch(sums, "mix-buckets")
    targets = water_fill(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole)
    targets = scratch(targets.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long")), "mix-targets")

    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = attach(sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))), targets.select("source", "rest"), "source")
    edge = scratch(ranges.where("before < rest AND before + words >= rest").select("source", "bucket", F.col("before").alias("start"), "rest"), "mix-edges")
    inside = attach(sized.select("source", "size", "key", bucket.alias("b")), edge, "source").where("b = bucket")
    keys = inside.groupBy("source", "key").agg(F.sum("size").alias("words"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    along = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(along), F.lit(0)))
    last = keys.where("before < rest AND before + words >= rest").select(F.col("source").alias("s"), F.col("key").alias("last_key"), (F.col("rest") - F.col("before")).alias("last_words"), F.col("words").alias("last_size"))
    return sized, scratch(targets.join(last, targets["source"].eqNullSafe(last["s"]), "left").drop("s", "rest"), "mix-plan")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words the mix takes of each document."""
    sized, plan = boundaries(docs, weights, share, max_epochs, seed)
    rows = attach(sized, plan, "source")
    part = F.when(F.col("key") < F.col("last_key"), F.col("size")).when(F.col("key") == F.col("last_key"), F.floor(F.col("last_words") * F.col("size") / F.col("last_size")).cast("long")).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.coalesce(part, F.lit(0))).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it; the boundary document of a source comes whole if at least half of it is due. No row is shuffled."""
    _, plan = boundaries(docs, weights, share, max_epochs, seed)
    plan = plan.select(F.col("source").alias("__source"), F.col("whole").alias("__whole"), F.col("last_key").alias("__last"), (2 * F.col("last_words") >= F.col("last_size")).alias("__due"))
    rows = attach(docs.withColumns({"__source": F.col("source"), "__at": _key(docs, seed)}), plan, "__source")
    part = F.when((F.col("__at") < F.col("__last")) | ((F.col("__at") == F.col("__last")) & F.col("__due")), 1).otherwise(0)
    rows = rows.withColumn("__copies", (F.col("__whole") + part).cast("int")).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('17:' || doc_id::VARCHAR) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), o AS (
  SELECT *, row_number() OVER l AS rank,
         coalesce(sum(cap) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS caps,
         coalesce(sum(weight) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS used,
         sum(weight) OVER () AS weights, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget
  FROM w WINDOW l AS (ORDER BY cap / weight, source IS NULL, source)
), v AS (
  SELECT min_by((budget - caps) / (weights - used), rank) AS level FROM o WHERE (budget - caps) / (weights - used) <= cap / weight
), t AS (
  SELECT source, source_size, coalesce(least(cap, weight * level), cap) AS target FROM o LEFT JOIN v ON true
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), r AS (
  SELECT *, floor(target - whole * source_size + 0.5)::BIGINT AS rest FROM p
), k AS (
  SELECT source, key, sum(size)::BIGINT AS words, (coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before FROM d GROUP BY source, key
)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (r.whole * d.size + CASE WHEN k.words = 0 THEN 0 ELSE floor(greatest(0, least(k.words, r.rest - k.before)) * d.size / k.words) END)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.key = d.key
"""
