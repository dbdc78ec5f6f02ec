"""License scan by an exact set-similarity join, in DataFrame operations only.

A text is cut into blocks at empty lines. Of a block only the words that some
template has matter; they become ranks in the order of how many blocks of all
documents have them, rarest first. A template of n words is contained when at
least alpha = ceil(threshold n) of them are in the block. Then at least one of
its n - alpha + 1 rarest words is: those prefixes, with positions, are the index
that block words are looked up in. A hit counts only if the block has alpha
words at all (length) and if what precedes and follows the hit on both sides can
still add up to alpha (position). Survivors are verified on the whole sets, so
every block and template above the threshold is found.

Some notices are published in paragraphs (BREAKS). Such a template is also found
across blocks: its paragraphs' shares must each reach the threshold in blocks
that follow each other, with at most one other block (the address in the Apache
notice) between, and together the template's; blocks without template words
don't count, and blocks that hold the whole template are left to the above. A
notice over several blocks counts as one license block. SQL compares single
blocks only, so it has fewer labels on such texts.

Templates are few and fixed, so their index travels as literals in the plan and
documents aren't shuffled; only the words' block counts are aggregated.

Base places of phrases are counted in the text's words written with single
spaces between.

Defined cases: a null or empty text has no words, places or labels and score 0;
rows are handled one by one, so repeated rows repeat their result and null ids
stay null; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fractile.llm.common import scratch, table, text_of

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices in words, under the labels that the method adds.
TEMPLATES = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "warranty-disclaimer": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-notice": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of the license or at your option any later version",
    "lgpl-notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-notice": "this work is licensed under a creative commons attribution international license to view a copy of this license visit",
    "unlicense-notice": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}
#: The words that begin the second paragraph of a notice as it is published.
BREAKS = {"apache-notice": "unless required by", "bsd-notice": "redistributions of source", "unlicense-notice": "anyone is free"}
THRESHOLD = 0.8
#: How much a phrase alone says, as a score.
PHRASE_SCORE = 0.9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_EMPTY_LINE = r"\n[ \t\r]*\n"


@dataclass(frozen=True)
class Template:
    label: str
    words: frozenset[str]
    alpha: int


def templates(texts: dict[str, str], threshold: float) -> list[Template]:
    return [Template(k, w, math.ceil(threshold * len(w) - 1e-9)) for k, t in sorted(texts.items()) if (w := frozenset(t.split()))]


def _spaced(text: Column) -> Column:
    """The words with one space before and after each."""
    return F.concat(F.lit(" "), F.regexp_replace(text, _BETWEEN, " "), F.lit(" "))


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, _BETWEEN, " ")), " ")


def _n_words(spaced: Column) -> Column:
    """Words of a text written so; runs of spaces stand only at its ends."""
    inner = F.trim(spaced)
    return F.when(inner == "", 0).otherwise(F.char_length(inner) - F.char_length(F.translate(inner, " ", "")) + 1).cast("long")


def prepared(docs: DataFrame, phrases: dict[str, str], found: list[Template]) -> DataFrame:
    """doc_id, the base columns, and of each block the words that templates have."""
    lowered = F.translate(text_of(docs), _UPPER, _LOWER)
    rows = docs.select(docs["doc_id"], lowered.alias("t")).withColumn("s", _spaced(F.col("t")))
    pattern = lambda words: f"(?<= )(?:{words})(?= )"
    every = pattern("|".join(phrases))
    places = sum((F.regexp_count("s", F.lit(pattern(p))) for p in phrases), F.lit(0)).cast("long")
    rows = rows.withColumn("n_base", F.when(F.expr(" OR ".join(f"contains(s, ' {p} ')" for p in phrases)), places).otherwise(F.lit(0).cast("long")))
    before_first = F.regexp_extract("s", "(?s)^(.*?)" + every, 1)
    before_last = F.regexp_extract("s", "(?s)^(.*)" + every, 1)
    has = F.col("n_base") > 0
    vocabulary = F.lit(sorted(set().union(*(t.words for t in found))))
    blocks = F.transform(F.split("t", _EMPTY_LINE), lambda b: F.array_intersect(_words(b), vocabulary))
    shortest = min((t.alpha for t in found), default=1)
    return rows.select(
        "doc_id", _n_words(F.col("s")).alias("n_words"), "n_base",
        F.when(has, _n_words(before_first)).alias("first_word"), F.when(has, _n_words(before_last)).alias("last_word"),
        F.array_compact(F.array(*[F.when(F.contains("s", F.lit(f" {p} ")), F.lit(k)) for p, k in phrases.items()])).alias("base"),
        blocks.alias("blocks"), F.lit(shortest).alias("shortest"),
    )


def word_ranks(rows: DataFrame, found: list[Template]) -> dict[str, int]:
    """Template words by how many blocks have them, rarest first, ties by the word. There are as many rows as the templates have words."""
    counts = rows.select(F.explode("blocks").alias("block")).select(F.explode("block").alias("word")).groupBy("word").count().collect()
    seen = {r["word"]: r["count"] for r in counts}
    return {w: k for k, w in enumerate(sorted(set().union(*(t.words for t in found)), key=lambda w: (seen.get(w, 0), w)))}


def contained(blocks: Column, found: list[Template], ranks: dict[str, int]) -> Column:
    """For each block the (template number, share of it) of every template that it contains to the threshold."""
    ordered = [sorted(ranks[w] for w in t.words) for t in found]
    index: dict[int, list[tuple[int, int, int, int]]] = {}
    for k, (t, own) in enumerate(zip(found, ordered)):
        for p, rank in enumerate(own[: len(own) - t.alpha + 1]):
            index.setdefault(rank, []).append((k, p, len(own), t.alpha))
    entry = lambda e: F.struct(*[F.lit(v).alias(n) for n, v in zip(("t", "p", "n", "alpha"), e)])
    postings = F.array(*[F.array(*map(entry, index[r])) if r in index else F.lit(None) for r in range(len(ranks))])
    rank_of = F.map_from_arrays(F.lit(list(ranks)), F.lit(list(ranks.values())))
    sets = F.array(*map(F.lit, ordered))

    def of(block: Column) -> Column:
        own = F.array_sort(F.transform(block, lambda w: F.element_at(rank_of, w)))

        def hits(b: Column) -> Column:
            fits = lambda e, i: (e["alpha"] <= F.size(b)) & (F.least(e["p"], i) + 1 + F.least(e["n"] - e["p"] - 1, F.size(b) - i - 1) >= e["alpha"])
            at = F.transform(b, lambda r, i: F.transform(F.filter(F.coalesce(F.element_at(postings, r + 1), F.array().cast("array<struct<t:int,p:int,n:int,alpha:int>>")), lambda e: fits(e, i)), lambda e: F.struct(e["t"].alias("t"), e["alpha"].alias("alpha"), e["n"].alias("n"))))
            candidates = F.array_distinct(F.flatten(at))
            shared = F.transform(candidates, lambda c: F.struct(c["t"].alias("t"), c["alpha"].alias("alpha"), c["n"].alias("n"), F.size(F.array_intersect(F.element_at(sets, c["t"] + 1), b)).alias("both")))
            return F.transform(F.filter(shared, lambda c: c["both"] >= c["alpha"]), lambda c: F.struct(c["t"].alias("t"), (c["both"] / c["n"]).alias("share")))

        return F.flatten(F.transform(F.array(own), hits))

    return F.transform(F.filter(blocks, lambda b: F.size(b) >= F.lit(min(t.alpha for t in found))), of)


def parted(found: list[Template], texts: dict[str, str], threshold: float) -> list[tuple[Template, list[Template]]]:
    """The templates that are published in two paragraphs, with those paragraphs."""
    out = []
    for t in found:
        first, begin, rest = texts[t.label].partition(BREAKS.get(t.label, "\0"))
        if begin:
            out.append((t, [part for own in (first, begin + rest) for part in templates({t.label: own}, threshold)]))
    return out


def across(blocks: Column, pairs: list[tuple[Template, list[Template]]]) -> Column:
    """(label, share) of each place where a template's two paragraphs stand in blocks that follow each other."""
    shared = lambda b, t: F.size(F.array_intersect(b, F.lit(sorted(t.words))))

    def of(own: Column, t: Template, first: Template, second: Template) -> Column:
        begins = lambda b: (F.size(b) >= first.alpha) & (shared(b, first) >= first.alpha) & (shared(b, t) < t.alpha)
        ends = lambda b: (F.size(b) >= second.alpha) & (shared(b, second) >= second.alpha) & (shared(b, t) < t.alpha)

        def place(b: Column, i: Column) -> Column:
            after = F.filter(F.slice(own, i + 2, 2), ends)
            both = F.when(begins(b), F.array_max(F.transform(after, lambda c: shared(F.array_union(b, c), t))))
            return F.struct(F.lit(t.label).alias("label"), F.when(both >= t.alpha, both / len(t.words)).alias("share"))

        return F.filter(F.transform(own, place), lambda h: h["share"].isNotNull())

    own = F.filter(blocks, lambda b: F.size(b) > 0)
    some = F.exists(blocks, lambda b: F.size(b) >= min(p.alpha for _, parts in pairs for p in parts))
    none = F.array().cast("array<struct<label:string,share:double>>")
    return F.when(some, F.concat(none, *[of(own, t, *parts) for t, parts in pairs])).otherwise(none)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, texts: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks: the number of license blocks."""
    found = templates(texts, threshold)
    rows = scratch(prepared(docs, phrases, found), "license-words")
    rows = rows.withColumn("hit", contained(F.col("blocks"), found, word_ranks(rows, found)))
    pairs = parted(found, texts, threshold)
    rows = rows.withColumn("over", across(F.col("blocks"), pairs) if pairs else F.array().cast("array<struct<label:string,share:double>>"))
    all_hits = F.flatten("hit")
    names = F.lit([t.label for t in found])
    own = F.transform(all_hits, lambda h: F.element_at(names, h["t"] + 1))
    best = F.coalesce(F.array_max(F.concat(F.transform(all_hits, lambda h: h["share"]), F.col("over.share"))), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", own, F.col("over.label")))), ",").alias("labels"),
        F.greatest(best, F.when(F.col("n_base") > 0, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
        (F.size(F.filter("hit", lambda h: F.size(h) > 0)) + F.size("over")).cast("long").alias("license_blocks"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    longest = max(len(p.split()) for p in PHRASES)
    columns = ", ".join(f"unnest(w[{k + 1}:]) AS w{k}" for k in range(longest))
    at = lambda p: " AND ".join(f"w{k} = '{x}'" for k, x in enumerate(p.split()))
    places = " UNION ALL ".join(f"SELECT id, i, '{k}' AS label FROM x WHERE {at(p)}" for p, k in PHRASES.items())
    rows = ", ".join(f"('{t.label}', {sorted(t.words)!r}, {t.alpha})" for t in templates(TEMPLATES, THRESHOLD))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d
), x AS (
  SELECT id, unnest(range(len(w))) AS i, {columns} FROM w
), p AS (
  SELECT id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM ({places}) GROUP BY id
), b AS (
  SELECT id, k, list_distinct(regexp_extract_all(block, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS words
  FROM (SELECT id, unnest(range(len(blocks))) AS k, unnest(blocks) AS block FROM (SELECT id, regexp_split_to_array(t, '\n[ \t\r]*\n') AS blocks FROM d))
), m AS (
  SELECT id, k, label, len(list_intersect(words, template))::DOUBLE / len(template) AS share
  FROM b, (VALUES {rows}) AS t(label, template, alpha) WHERE len(list_intersect(words, template)) >= alpha
), l AS (
  SELECT id, list(label) AS own, max(share) AS best, count(DISTINCT k) AS license_blocks FROM m GROUP BY id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels,
       greatest(coalesce(best, 0.0), CASE WHEN n_base > 0 THEN {PHRASE_SCORE} ELSE 0.0 END)::DOUBLE AS score,
       coalesce(license_blocks, 0)::BIGINT AS license_blocks
FROM w LEFT JOIN p USING (id) LEFT JOIN l USING (id)
"""


SQL = _sql()
