"""From raw documents to packed sequences: each stage reads what the one before wrote.

Documents that are predicted toxic go, then exact copies, then all but one of
each group of near duplicates (five-word shingles, similarity 0.8); the rest is
mixed to the sources' target weights, which repeats and drops whole documents,
and packed.
"""

from __future__ import annotations

from fractile.llm import exact, mixing, neardup, packing, toxicity
from fractile.llm.common import scratch, table


def toxic(spark, docs, sf_dir):
    return toxicity.drop_toxic(docs, toxicity.train_on(spark, docs, sf_dir))


def copies(spark, docs, sf_dir):
    return exact.drop_copies(docs)


def near_copies(spark, docs, sf_dir):
    return neardup.drop_near_copies(docs)


def mixture(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def packed(spark, docs, sf_dir):
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [("toxicity", toxic), ("exact_dedup", copies), ("near_dedup", near_copies), ("mixing", mixture), ("packing", packed)]

#: The toxicity model, MinHash and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over documents, each but the last written to the shared folder and read again; the folders are deleted when the process ends."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
