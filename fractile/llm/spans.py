"""Spans of text findings and their digest columns, shared by the secret and personal-data scans."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fractile.llm.common import map_frames

#: start, end (exclusive, in code points), kind
Span = tuple[int, int, str]


def joined(spans: Sequence[Span], kinds: Sequence[str]) -> str:
    """kind:start:end, by start, then kind as listed, comma-joined."""
    at = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], at[s[2]], s[1])))


def scan_documents(docs: DataFrame, base: Callable[[str], list[Span]], own: Callable[[list[str]], list[list[Span]]], base_kinds: Sequence[str], own_kinds: Sequence[str]) -> DataFrame:
    """doc_id, n_<base kind> ..., base_sha256, spans, n_<own kind> ..., n_spans. Nothing is shuffled; null texts are empty ones and every row gives one row."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            rows = []
            for doc_id, text, more in zip(frame["doc_id"].tolist(), texts, own(texts)):
                found = base(text)
                digest = hashlib.sha256(joined(found, base_kinds).encode()).hexdigest()
                count = lambda spans, kinds: [sum(k == s[2] for s in spans) for k in kinds]
                rows.append((doc_id, *count(found, base_kinds), digest, joined([*found, *more], [*base_kinds, *own_kinds]), *count(more, own_kinds), len(found) + len(more)))
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", *[f"n_{k}" for k in base_kinds], "base_sha256", "spans", *[f"n_{k}" for k in own_kinds], "n_spans"]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    types = [*[f"n_{k} long" for k in base_kinds], "base_sha256 string", "spans string", *[f"n_{k} long" for k in own_kinds], "n_spans long"]
    return map_frames(rows, task, "doc_id", ", ".join(types))
