"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct word shingles. Documents with equal sets form a
class, and one of each class goes on. From K minima come BANDS keys of ROWS full
minima each, for candidates, and a signature of the low BITS bits of every
minimum, packed into 64-bit words. A pair that shares a key is judged by counting
equal cells: the share m of equal cells becomes (m - c) / (1 - c), c = 2^-BITS
being how often unequal minima agree by chance. Pairs whose estimate is within
MARGIN of the threshold or above are confirmed on the full sets.

A key shared by many documents is not expanded into all pairs. First each of its
documents is compared with the smallest one; what that links is one component.
Then only pairs of different components under a key are left, and all of those
are estimated, in blocks: of a key's largest component each block meets the
blocks of the others. Pairs that may be linked are not listed; a block only says
how its documents hang together by such pairs (a spanning forest), and documents
that hang together form a region. Regions are then compared on full sets, again
largest component against the others in blocks, and only links are given out. So
no link between components is lost and documents that are known to be together
aren't compared again. Results are never more than the documents. What is dealt to
blocks is: a key (or region) of n documents that stay in several components sends
each of them to about n / BLOCK blocks, so a key under which a large share of all
documents falls without hanging together costs quadratic time, in many tasks that
are each bounded. Blocks and chunks of long documents hold fewer, so that the
texts of one have about GROUP_CHARS characters at most, or are two documents. A pair at
the threshold shares no key with a probability of (1 - 0.8^ROWS)^BANDS, 3 in a
million; the estimate loses one below 1 in ten million.

Shingles are compared by 64-bit hashes of their words.

Defined cases: texts that are null, empty or without words have an empty set and
are linked with nothing; with fewer words than a shingle has, the words are the
one shingle; rows that repeat a doc_id are one document, linked by any of its
texts; a null doc_id is linked with nothing and kept; an empty table gives an
empty one; other columns, whatever their names, pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fractile.llm.common import BROADCAST_ROWS, map_frames, rejoin, scratch
from fractile.llm.components import components

ROWS, BANDS, BITS = 5, 32, 4
K = ROWS * BANDS
MARGIN = 0.18
#: Documents of a side in one block of estimates, and in one of confirmations.
BLOCK, FULL_BLOCK = 512, 256
#: Pairs that one copy of a shared document's text serves, and about how many rows small groups are put together to.
CHUNK, TOGETHER = 128, 2000
#: Batches that one task takes where they are more than Spark's partitions would hold.
BATCHES_A_TASK = 8
BATCH_CHARS = 2_000_000
#: Characters of the texts that a group of Python rows holds, and that groups are put together to.
GROUP_CHARS = 32_000_000

_MULTIPLY, _ADD = (np.random.default_rng(20240229).integers(0, 2**63, (2, K, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_GOLDEN, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Similarity:
    """Links are pairs with 100 * intersection >= percent * union."""

    shingle: int = 5
    percent: int = 80

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if not len(a) or not len(b):
            return False
        if 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)):
            return False
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        at = np.searchsorted(large, small)
        at[at == len(large)] = 0
        both = int((large[at] == small).sum())
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of lower-cased (A-Z) words."""
    begin = 0
    while begin < len(texts):
        end, chars = begin, 0
        while end < len(texts) and (end == begin or chars + len(texts[end]) <= BATCH_CHARS):
            chars += len(texts[end])
            end += 1
        words, ends = [], []
        for text in texts[begin:end]:
            words += text.encode().lower().split()
            ends.append(len(words))
        if words:
            codes, distinct = pd.factorize(np.array(words, dtype=object))
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))[codes]
        last = 0
        for stop in ends:
            n, own = stop - last, hashes[last:stop] if words else None
            last = stop
            if not n:
                yield np.zeros(0, np.uint64)
                continue
            count = max(1, n - width + 1)
            out = np.full(count, n if n < width else width, np.uint64)
            for k in range(min(width, n)):
                out = _mixed(out * _GOLDEN + own[k : k + count])
            yield np.unique(out)
        begin = end


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(K, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[None, k : k + 4096] * _MULTIPLY + _ADD).min(axis=1))
    return _mixed(least)


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN
    for part in least.reshape(BANDS, ROWS).T:
        keys = _mixed((keys ^ part) * _GOLDEN)
    return keys.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    cells = (least & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return (cells << np.arange(0, 64, BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarities of signatures (rows of packed words), each of a with each of b."""
    unequal = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        y = a[:, k, None].view(np.uint64) ^ b[None, :, k].view(np.uint64)
        y |= y >> np.uint64(1)
        y |= y >> np.uint64(2)
        unequal += np.bitwise_count(y & np.uint64(0x1111111111111111))
    return corrected(1 - unequal / K)


def corrected(m):
    c = 2.0**-BITS
    return (m - c) / (1 - c)


def _estimate_column(a: str, b: str):
    words = [f"bit_count((z{k} | shiftrightunsigned(z{k}, 2)) & 1229782938247303441L)" for k in range(K * BITS // 64)]
    for k, w in enumerate(words):
        y = f"({a}[{k}] ^ {b}[{k}])"
        words[k] = w.replace(f"z{k}", f"({y} | shiftrightunsigned({y}, 1))")
    return F.lit(1.0) - F.expr(" + ".join(words)) / K


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, n_chars, digest of the set, bands, sig."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text, own in zip(frame["doc_id"], frame["text"], shingle_sets(frame["text"].tolist(), width)):
                if len(own):
                    least = minima(own)
                    rows.append((doc_id, len(own), len(text), xxhash.xxh128_digest(own.tobytes()), band_keys(least), packed(least)))
                else:
                    rows.append((doc_id, 0, len(text), None, None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "n_chars", "digest", "bands", "sig"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return map_frames(rows, task, "doc_id", "n_shingles long, n_chars long, digest binary, bands array<long>, sig array<long>")


def _with_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted (doc, ...) with the documents' texts; documents that aren't wanted stay out of the shuffle where the wanted ones are few."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).where("doc IS NOT NULL")
    ids = wanted.select("doc").distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(ids), "doc", "left_semi")
    return wanted.join(texts, "doc")


def _batches(rows: int, chars: int = 0) -> int:
    """How many batches so many rows, and so many characters of texts, are dealt to."""
    return max(1, -(-rows // TOGETHER), -(-chars // GROUP_CHARS))


def _over_tasks(rows: DataFrame, batches: int, *keys: str) -> DataFrame:
    """rows partitioned by keys into tasks of about BATCHES_A_TASK batches, where Spark's own number of partitions is too small for that."""
    tasks = -(-batches // BATCHES_A_TASK)
    if tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows
    return rows.repartition(tasks, *keys)


def _groups(frame: pd.DataFrame, *names: str) -> Iterator[pd.DataFrame]:
    """The groups of a frame that holds many small ones."""
    frame = frame.sort_values(list(names), kind="stable", ignore_index=True)
    new = np.zeros(len(frame), bool)
    for n in names:
        v = frame[n].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    cuts = [0, *np.flatnonzero(new).tolist(), len(frame)]
    for a, b in zip(cuts, cuts[1:]):
        yield frame.iloc[a:b]


def _links(found: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])


def confirmed(pairs: DataFrame, docs: DataFrame, similarity: Similarity) -> DataFrame:
    """pairs (a, b, n: about how many pairs a has, chars: of b's text) whose full sets are linked. A document with many pairs, or with long ones, meets them in chunks, its text copied once a chunk."""
    per_chunk = F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.floor(F.lit(GROUP_CHARS) / F.col("chars")))).cast("long")
    chars = pairs.agg(F.sum("chars")).first()[0] or 0
    pairs = pairs.withColumn("chunk", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / per_chunk).cast("long")))
    wanted = pairs.select("a", "chunk", F.col("b").alias("doc"), F.lit(False).alias("head"))
    wanted = wanted.union(pairs.select("a", "chunk", F.col("a").alias("doc"), F.lit(True).alias("head")).distinct())
    wanted = scratch(wanted, "near-wanted")
    batches = _batches(8 * wanted.count(), 2 * chars)
    rows = _with_texts(wanted, docs).withColumn("batch", F.pmod(F.xxhash64("a", "chunk"), F.lit(batches)))

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        frame["set"] = pd.Series(list(shingle_sets(frame["text"].tolist(), similarity.shingle)), index=frame.index, dtype=object)
        for group in _groups(frame.drop(columns="text"), "a", "chunk"):
            is_head, sets = group["head"].to_numpy(bool), group["set"].tolist()
            heads = [s for s, h in zip(sets, is_head) if h]
            a = int(group["a"].iloc[0])
            found += [(a, d) for d, s, h in zip(group["doc"].tolist(), sets, is_head) if not h and any(similarity.linked(x, s) for x in heads)]
        return _links(found)

    return _over_tasks(rows, batches, "batch").groupBy("batch").applyInPandas(task, "a long, b long")


def _blocks(rows: DataFrame, comp_of: DataFrame, key: str, block: int, with_texts: bool = False) -> tuple[DataFrame, int]:
    """rows (key, doc, chars) dealt to the blocks in which each pair of different components under a key meets, and the number of batches: key, comp, batch, kind, i, j and side are added. The largest component's blocks meet those of the others, and these each other; keys with one component are left out. Blocks whose texts will be read hold fewer documents where these are long."""
    placed = rows.join(comp_of, rows["doc"] == comp_of["node"], "left").drop("node").withColumn("comp", F.coalesce("component", "doc")).drop("component")
    placed = scratch(placed, "near-placed")
    sizes = placed.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("k"), F.max("chars").alias("longest"), F.sum("chars").alias("chars"))
    sizes = sizes.groupBy(key).agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("total"), F.max("longest").alias("longest"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    per_block = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(GROUP_CHARS // 2) / F.col("longest")))).cast("long") if with_texts else F.lit(block).cast("long")
    sizes = scratch(sizes.select(key, F.col("top.comp").alias("largest"), F.col("top.k").alias("n_big"), (F.col("total") - F.col("top.k")).alias("n_rest"), "chars", per_block.alias("per_block")), "near-mixed")
    total, chars = sizes.agg(F.sum(F.col("n_big") + F.col("n_rest")), F.sum("chars")).first()
    batches = _batches(total or 0, (chars or 0) * with_texts)
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.col("per_block"))).cast("long")
    deal = lambda n: F.pmod(F.xxhash64("doc"), blocks(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    left = placed.join(sizes, key)
    keep = [key, "doc", "comp", F.pmod(F.xxhash64(key), F.lit(batches)).alias("batch")]
    big = left.where("comp = largest").select(*keep, F.lit("x").alias("kind"), deal("n_big").alias("i"), each("n_rest").alias("j"), F.lit(0).alias("side"))
    rest = left.where("comp <> largest").withColumn("own", deal("n_rest"))
    across = rest.select(*keep, F.lit("x").alias("kind"), each("n_big").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))
    among = rest.select(*keep, "own", each("n_rest").alias("other"))
    among = among.select(key, "doc", "comp", "batch", F.lit("r").alias("kind"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    return big.union(across).union(among), batches


class _Sets:
    """Union-find over whatever hashes."""

    def __init__(self) -> None:
        self.up: dict = {}

    def top(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x, y) -> bool:
        x, y = self.top(x), self.top(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _likely(group: pd.DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of a block that differ in component and have at least that estimate, best first."""
    side, comp = group["side"].to_numpy(), group["comp"].to_numpy()
    sig = np.stack(group["sig"].to_list())
    one = np.flatnonzero(side == 0)
    alone = group["kind"].iloc[0] == "r" and group["i"].iloc[0] == group["j"].iloc[0]
    two = one if alone else np.flatnonzero(side == 1)
    if not len(one) or not len(two):
        return one[:0], one[:0]
    e = np.where(comp[one][:, None] != comp[two][None, :], estimates(sig[one], sig[two]), -1.0)
    if alone:
        e = np.triu(e, 1)
    a, b = np.nonzero(e >= least)
    best = np.argsort(-e[a, b], kind="stable")
    return one[a[best]], two[b[best]]


def _regions(rows: DataFrame, reps: DataFrame, comp_of: DataFrame, least: float) -> DataFrame:
    """(doc, region) of the documents that may be linked to one of another component."""

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for group in _groups(frame, "bucket"):
            a, b = _likely(group, least)
            if len(a):
                doc, sets = group["doc"].to_numpy(), _Sets()
                found += [(x, y) for x, y in zip(doc[a].tolist(), doc[b].tolist()) if sets.join(x, y)]
        return _links(found)

    blocks, batches = _blocks(rows, comp_of, "bucket", BLOCK)
    blocks = _over_tasks(blocks.join(reps.select("doc", "sig"), "doc"), batches, "batch", "kind", "i", "j")
    forest = blocks.groupBy("batch", "kind", "i", "j").applyInPandas(task, "a long, b long")
    regions = components(forest).select(F.col("node").alias("doc"), F.col("component").alias("region"))
    return regions.join(reps.select("doc", "chars"), "doc")


def _across(regions: DataFrame, reps: DataFrame, comp_of: DataFrame, docs: DataFrame, similarity: Similarity, least: float) -> DataFrame:
    """Links (a, b) between different components of a region, at least one for each two that are linked."""

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for group in _groups(frame, "region"):
            a, b = _likely(group, least)
            if not len(a):
                continue
            needed = sorted({*a.tolist(), *b.tolist()})
            texts = group["text"].tolist()
            own = dict(zip(needed, shingle_sets([texts[k] for k in needed], similarity.shingle)))
            doc, comp, sets = group["doc"].tolist(), group["comp"].tolist(), _Sets()
            for x, y in zip(a.tolist(), b.tolist()):
                if sets.top(comp[x]) != sets.top(comp[y]) and similarity.linked(own[x], own[y]):
                    sets.join(comp[x], comp[y])
                    found.append((doc[x], doc[y]))
        return _links(found)

    blocks, batches = _blocks(regions, comp_of, "region", FULL_BLOCK, True)
    blocks = scratch(blocks.join(reps.select("doc", "sig"), "doc"), "near-blocks")
    rows = _over_tasks(_with_texts(blocks, docs), batches, "batch", "kind", "i", "j")
    return rows.groupBy("batch", "kind", "i", "j").applyInPandas(task, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept (doc_id = component_id)."""
    least = similarity.percent / 100 - MARGIN
    sketch = scratch(sketches(docs, similarity.shingle), "near-sketches")
    classes = scratch(sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")), "near-classes")
    reps = classes.select(F.col("rep").alias("doc"), F.col("digest").alias("of"))
    reps = sketch.join(reps, (sketch["doc_id"] == F.col("doc")) & (sketch["digest"] == F.col("of"))).select("doc", F.col("n_chars").alias("chars"), "bands", "sig").dropDuplicates(["doc", "sig"])
    reps = scratch(reps, "near-reps")
    keyed = reps.select("doc", "chars", F.explode("bands").alias("bucket"))
    shared = scratch(keyed.groupBy("bucket").agg(F.min("doc").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near-shared")
    member = scratch(rejoin(keyed, shared, "bucket", "n", "doc"), "near-members")

    # A pivot with many documents is copied once for each BLOCK of them.
    copies = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("long")
    star = member.where("doc <> pivot").groupBy("pivot", "doc").agg(F.max("n").alias("n"), F.max("chars").alias("chars")).withColumn("copy", F.pmod(F.xxhash64("doc"), copies("n")))
    star = star.join(reps.select("doc", F.col("sig").alias("s")), "doc")
    pivots = shared.groupBy("pivot").agg(F.max("n").alias("m")).join(reps.select(F.col("doc").alias("pivot"), F.col("sig").alias("t")), "pivot")
    pivots = pivots.select("pivot", "t", F.explode(F.sequence(F.lit(0).cast("long"), copies("m") - 1)).alias("copy"))
    star = star.join(pivots, ["pivot", "copy"]).where(corrected(_estimate_column("s", "t")) >= least)
    star = scratch(star.select(F.col("pivot").alias("a"), F.col("doc").alias("b"), "n", "chars"), "near-star")
    links = scratch(confirmed(star, docs, similarity), "near-links")

    comp = components(links)
    regions = _regions(member.select("bucket", "doc", "chars"), reps, comp, least)
    if not regions.isEmpty():
        added = scratch(_across(regions, reps, comp, docs, similarity, least), "near-links-across")
        if not added.isEmpty():
            comp = components(links.union(added))
    groups = classes.join(comp, classes["rep"] == comp["node"], "left").select("digest", "members", F.coalesce("component", "rep").alias("component_id"))
    groups = scratch(groups, "near-groups")
    named = rejoin(sketch.where("digest IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "digest"), groups, "digest", "members", "doc_id")
    alone = sketch.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = named.select("doc_id", "n_shingles", "component_id").union(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """docs with one document of each group of near duplicates; all columns stay."""
    verdict = near_duplicates(docs, similarity).where("NOT kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(scratch(verdict, "near-gone"), docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    from fractile.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"), Similarity(shingle=2))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), t AS (
  SELECT s.*, n.n FROM s JOIN n USING (doc_id)
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y
), least_of AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least_of ON x = d.doc_id
"""
