"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Texts are equal when they are identical without ASCII white space. Three
combining stages shrink each group of copies, and each compares the full
normalised content, which is part of the grouping key: copies meet first inside
their own task (map-side partial aggregation), then under (digest, content,
salt), then under (digest, content). However large a group is, a task gets at
most one row of it for each task before it. The way back from winners to
documents joins on the digest with the largest groups salted. Should two
contents ever share a digest, those digests are joined by content as well.

Defined cases: a null text is an empty one; all empty texts are one group; of
equally long originals the smallest doc_id stays; rows that repeat a doc_id
count in group_size, and leave one row in `drop_copies` where their texts are
equal, the longest; a null doc_id loses against any other, and where all of a
group are null, keep_id is null and kept is true; other columns, whatever their
names, pass untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fractile.llm.common import SPACE, rejoin, scratch, text_of

SALTS = 64


def _beyond() -> Column:
    """One more than the largest doc_id."""
    return F.lit(str(1 << 63)).cast("decimal(20,0)")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _keyed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = text_of(docs)
    content = F.regexp_replace(text, f"{SPACE}+", "")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), content.alias("content"), F.char_length(text).alias("n"))
    return rows.withColumn("digest", digest(F.col("content")))


def _merit() -> Column:
    """More code points first, then the smaller doc_id, a null one last, as one number that a hash aggregate can hold in place."""
    step = F.lit("1" + "0" * 20).cast("decimal(21,0)")
    early = F.coalesce(_beyond() - F.col("doc_id").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (F.col("n").cast("decimal(10,0)") * step + early).cast("decimal(38,0)")


def _combine(keyed: DataFrame, salts: int) -> DataFrame:
    """One row for each content: digest, content, keep_id, group_size."""
    salt = F.pmod(F.xxhash64("doc_id", "n"), F.lit(salts))
    salted = keyed.groupBy("digest", "content", salt.alias("salt")).agg(F.max(_merit()).alias("merit"), F.count(F.lit(1)).alias("size"))
    won = salted.groupBy("digest", "content").agg(F.max("merit").alias("merit"), F.sum("size").alias("group_size"))
    step = F.lit("1" + "0" * 20).cast("decimal(21,0)")
    early = F.col("merit") % step
    return won.select("digest", "content", F.when(early > 0, (_beyond() - early).cast("long")).alias("keep_id"), "group_size")


def winners(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> tuple[DataFrame, DataFrame | None]:
    """The row that stays of each group (digest, keep_id, group_size), written to the shared folder; and, only where contents share a digest, those groups with their content."""
    combined = _combine(_keyed(docs, digest), salts)
    won = scratch(combined.drop("content"), "exact-winners")
    shared = won.groupBy("digest").count().where("count > 1").select("digest")
    if shared.isEmpty():
        return won, None
    shared = scratch(shared, "exact-collisions")
    apart = scratch(combined.join(shared, "digest", "left_semi"), "exact-contents")
    return won.join(shared, "digest", "left_anti"), apart


def exact_groups(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest."""
    won, apart = winners(docs, salts, digest)
    keyed = _keyed(docs, digest)
    out = rejoin(keyed.select("doc_id", "digest"), won, "digest", "group_size", "doc_id", salts).select("doc_id", "keep_id", "group_size", "digest")
    if apart is not None:
        out = out.unionByName(keyed.join(apart, ["digest", "content"]).select("doc_id", "keep_id", "group_size", "digest"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def _staying(rows: DataFrame, verdict: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (with __digest and, if a key, __content) that a verdict keeps, one of each group."""
    stay = verdict.select(F.col("keep_id").alias("__keep_id"), *[F.col(k).alias(f"__of_{k}") for k in keys])
    own = [f"__{k}" for k in keys]
    same = reduce(and_, [rows[f"__{k}"] == stay[f"__of_{k}"] for k in keys])
    named = rows.join(stay.where("__keep_id IS NOT NULL"), same & (rows["doc_id"].cast("long") == stay["__keep_id"]), "left_semi")
    one = Window.partitionBy("doc_id", *own).orderBy(F.desc(F.char_length("text")), "text")
    named = named.withColumn("__row", F.row_number().over(one)).where("__row = 1").drop("__row")
    nameless = rows.where(rows["doc_id"].isNull()).join(stay.where("__keep_id IS NULL"), same, "left_semi")
    longest = F.max_by(F.struct(*[nameless[c] for c in rows.columns]), F.struct(F.char_length("text"), "text"))
    return named.unionByName(nameless.groupBy(*own).agg(longest.alias("__it")).select("__it.*"))


def drop_copies(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows that stay, with all their columns. Different texts under one doc_id are each judged by their own group."""
    won, apart = winners(docs, salts, digest)
    content = F.regexp_replace(text_of(docs), f"{SPACE}+", "")
    rows = docs.withColumn("__digest", digest(content))
    out = _staying(rows, won, ["digest"]).drop("__digest")
    if apart is not None:
        out = out.unionByName(_staying(rows.withColumn("__content", content), apart, ["digest", "content"]).drop("__digest", "__content"))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    from fractile.llm.common import table

    return exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS content FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
       sha256(content) AS text_sha256
FROM d
"""
