"""Toxicity by maximum-scoring segments.

Word scores are log-odds between toxic and clean labelled documents under an
informative Dirichlet prior (the words' shares in both together); words whose
likelihood-ratio root isn't above what chance gives the largest of so many words
all get one small negative score. A linear-time scan finds
every maximal scoring segment of a document. How high the best one is for a
document of that length follows an extreme-value law, P(S >= x) = 1 -
exp(-K n exp(-lambda x)): lambda solves sum p exp(lambda s) = 1 over clean words
and K is its maximum-likelihood value on clean documents, with documents without
a segment as censored ones. A two-feature logistic model, fitted on documents
whose words were scored by the other half of the training rows, turns the
extreme-value score and the number of significant segments into a probability.

Training reads at most `train_rows` labelled rows, those with the smallest
seeded digests. Only words and labels enter it.

Defined cases: a null or empty text has no segments and the score of a text
without evidence; without training rows of both classes every score is the share
of toxic rows (0 if there are none); labels repeated for a document count once,
toxic if any says so; null labels and ids are not trained on; ids come
back whole, null ones as null; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fractile.llm.common import drawn, map_frames, scratch

TRAIN_ROWS = 20_000
THRESHOLD = 0.7
#: Strength of the prior in documents, and what it gives each word at least.
PRIOR, LEAST_PRIOR = 5.0, 0.5
LEAST_DOCS = 4
NEUTRAL = -0.08
SIGNIFICANT = 0.01
_PUNCTUATION = {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) != "'"} | {c: " " for c in map(ord, "«»„“”‘’…–—¡¿")}


def words_of(text: str) -> list[str]:
    return text.lower().translate(_PUNCTUATION).split()


@dataclass
class WordModel:
    """Scores of toxic words and the extreme-value law of what clean documents reach by chance."""

    scores: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1e-3

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Every maximal scoring segment as (first word, end, score), by the linear-time algorithm of Ruzzo and Tompa; runs of neutral words are one step."""
        scores = self.scores
        hits = [(i, scores[w]) for i, w in enumerate(words) if w in scores]
        found: list[list[float]] = []  # first, end, sum before, sum after
        total, at = 0.0, 0
        for i, s in hits:
            total += NEUTRAL * (i - at)
            before, total, at = total, total + s, i + 1
            new = [i, i + 1, before, total]
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= new[2]:
                    j -= 1
                if j < 0 or found[j][3] >= new[3]:
                    found.append(new)
                    break
                new = [found[j][0], new[1], found[j][2], new[3]]
                del found[j:]
        return [(int(a), int(b), y - x) for a, b, x, y in found]

    def surprise(self, score: float, n: int) -> float:
        """lambda S - ln(K n): large when chance doesn't explain the segment."""
        return self.lam * score - math.log(self.k * max(n, 1))

    def significant(self, score: float, n: int) -> bool:
        return -math.expm1(-math.exp(-self.surprise(score, n))) <= SIGNIFICANT

    def features(self, words: list[str]) -> tuple[float, float, list[tuple[int, int, float]]]:
        found = [s for s in self.segments(words) if self.significant(s[2], len(words))]
        best = max((s[2] for s in found), default=0.0)
        surprise = max(-10.0, min(40.0, self.surprise(best, len(words)))) if found else -10.0
        return surprise / 10.0, math.log1p(len(found)), found


def fit_words(counts: pd.DataFrame, toxic_docs: int, clean_docs: int) -> WordModel:
    """counts: word, toxic, clean (documents of each class with the word); words with few toxic documents may be left out."""
    model = WordModel()
    if not toxic_docs or not clean_docs or counts.empty:
        return model
    t, c = counts["toxic"].to_numpy(float), counts["clean"].to_numpy(float)
    prior = LEAST_PRIOR + PRIOR * (t + c) / (toxic_docs + clean_docs)
    odds = lambda y, n: np.log((y + prior) / np.maximum(n + PRIOR + 1 - y - prior, 0.5))
    delta = odds(t, toxic_docs) - odds(c, clean_docs)
    share = toxic_docs / (toxic_docs + clean_docs)
    total = np.maximum(t + c, 1)
    xlogx = lambda y, p: np.where(y > 0, y * np.log(np.maximum(y, 1e-9) / (total * p)), 0.0)
    root = np.sqrt(2 * np.maximum(0.0, xlogx(t, share) + xlogx(c, 1 - share)))
    # The largest of that many chance values stays below, as for normal ones.
    strong = (root >= 0.5 + math.sqrt(2 * math.log(max(2, len(counts))))) & (delta >= 1.0) & (t >= LEAST_DOCS)
    model.scores = dict(zip(counts["word"][strong], np.minimum(delta[strong], 8.0).tolist()))
    return model


def fit_law(model: WordModel, clean: pd.DataFrame) -> WordModel:
    """clean: n words, best score, and hits (toxic words) of clean documents."""
    n = np.maximum(clean["n"].to_numpy(float), 1)
    best = clean["best"].to_numpy(float)
    scores = np.array(list(model.scores.values()) or [1.0])
    share = (clean["hits"].sum() + 1.0) / (n.sum() + 1000.0)
    mean = lambda lam: share * np.exp(lam * scores).mean() + (1 - share) * math.exp(lam * NEUTRAL)
    low, high = 0.0, 1.0
    while mean(high) < 1 and high < 64:
        low, high = high, high * 2
    if share * scores.mean() + (1 - share) * NEUTRAL >= 0:
        low = high = 0.05
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    model.lam = max(low, 0.05)
    model.k = ((best > 0).sum() + 0.5) / (n * np.exp(-model.lam * best)).sum() if len(n) else 1e-3
    return model


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method, the constant last."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicityModel:
    words: WordModel
    weights: list[float] | None
    base: float

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]], list[str]]:
        if self.weights is None:
            return self.base, [], []
        words = words_of(text)
        a, b, found = self.words.features(words)
        z = self.weights[0] * a + self.weights[1] * b + self.weights[2]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), found, words


def _training_rows(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """text, toxic and a fold of at most train_rows labelled documents."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.withColumn("draw", F.xxhash64(F.lit(29), "doc_id"))
    total = rows.count()
    if total > train_rows:
        share = 1.2 * train_rows / total + 1e-6
        rows = rows.where(drawn(F.col("draw"), min(1.0, share))).orderBy("draw").limit(train_rows)
    rows = rows.select(F.col("doc_id").alias("__id"), "toxic", F.pmod("draw", F.lit(2)).cast("int").alias("fold"))
    return docs.select("doc_id", "text").join(F.broadcast(rows), docs["doc_id"] == F.col("__id")).select(F.coalesce("text", F.lit("")).alias("text"), "toxic", "fold")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on the labelled documents given; held-out rows must be taken out of labels before."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], Counter] = {}
        for frame in frames:
            for text, toxic, fold in zip(frame["text"], frame["toxic"], frame["fold"]):
                c = seen.setdefault((int(toxic), int(fold)), Counter())
                c.update(set(words_of(text)))
                c[""] += 1
        for (toxic, fold), c in seen.items():
            yield pd.DataFrame({"word": list(c), "fold": fold, "toxic": [n * (toxic > 0) for n in c.values()], "clean": [n * (toxic <= 0) for n in c.values()]})

    rows = scratch(_training_rows(docs, labels, train_rows), "toxicity-training")
    part = lambda name, k: F.sum(F.when(F.col("fold") == k, F.col(name)).otherwise(0)).alias(f"{name}{k}")
    counts = rows.mapInPandas(count, "word string, fold int, toxic long, clean long").groupBy("word").agg(*[part(n, k) for n in ("toxic", "clean") for k in (0, 1)])
    counts = counts.where(f"toxic0 + toxic1 >= {LEAST_DOCS}").orderBy("word").toPandas()
    sums = counts[counts["word"] == ""]
    toxic, clean = ([int(sums[f"{n}{k}"].sum()) for k in (0, 1)] for n in ("toxic", "clean"))
    counts = counts[counts["word"] != ""].reset_index(drop=True)
    n_rows = rows.count()
    base = sum(toxic) / n_rows if n_rows else 0.0
    if not sum(toxic) or sum(toxic) == n_rows:
        return ToxicityModel(WordModel(), None, base)

    def model(folds: tuple[int, ...]) -> WordModel:
        c = pd.DataFrame({"word": counts["word"], **{n: sum(counts[f"{n}{k}"] for k in folds) for n in ("toxic", "clean")}})
        return fit_words(c, sum(toxic[k] for k in folds), sum(clean[k] for k in folds))

    halves, whole = [model((1,)), model((0,))], model((0, 1))  # halves[k] has not seen fold k

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, is_toxic, fold in zip(frame["text"], frame["toxic"], frame["fold"]):
                words = words_of(text)
                m = halves[int(fold)]
                found = [s for _, _, s in m.segments(words)]
                out.append((int(is_toxic), int(fold), len(words), max(found, default=0.0), sum(w in m.scores for w in words), found))
            yield pd.DataFrame(out, columns=["toxic", "fold", "n", "best", "hits", "all"])

    seen = rows.mapInPandas(scan, "toxic int, fold int, n long, best double, hits long, all array<double>").toPandas()
    quiet = seen[seen["toxic"] <= 0]
    for m in (*halves, whole):
        fit_law(m, quiet)
    x = []
    for fold, n, found in zip(seen["fold"], seen["n"], seen["all"]):
        m = halves[fold]
        real = [s for s in found if m.significant(s, n)]
        x.append((max(-10.0, min(40.0, m.surprise(max(real), n))) / 10.0 if real else -1.0, math.log1p(len(real))))
    weights = fit_logistic(np.array(x), (seen["toxic"] > 0).to_numpy(float))
    return ToxicityModel(whole, weights.tolist(), base)


def word_places(text: str) -> list[tuple[int, int]]:
    """Where the words of words_of stand in the text itself, which may be shorter than in lower case."""
    lowered = text.lower()
    places = [m.span() for m in re.finditer(r"\S+", lowered.translate(_PUNCTUATION))]
    if len(lowered) == len(text):
        return places
    origin = [k for k, c in enumerate(text) for _ in c.lower()]
    return [(origin[a], origin[b - 1] + 1) for a, b in places]


def passages_of(text: str, found: list[tuple[int, int, float]]) -> str:
    """start:end in code points of the text of each significant passage."""
    if not found:
        return ""
    places = word_places(text)
    return ",".join(f"{places[a][0]}:{places[b - 1][1]}" for a, b, _ in found)


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, passages (start:end, in code points of the text)."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                score, found, _ = model.score(text)
                out.append((doc_id, score, int(score >= threshold), passages_of(text, found)))
            yield pd.DataFrame(out, columns=["doc_id", "score", "predicted", "passages"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return map_frames(rows, task, "doc_id", "score double, predicted int, passages string")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that are predicted toxic; all columns stay and nothing is shuffled."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t or "")[0] for t in texts], dtype=float)

    return docs.where(score(F.coalesce(docs["text"].cast("string"), F.lit(""))) < threshold)


def held_out(column):
    """Rows whose labels aren't learned from."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(3)) == 1


def train_on(spark, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    from fractile.llm.common import table

    labels = table(spark, sf_dir, "labels")
    return train(docs, labels.where(~held_out(labels["doc_id"])))


def query(spark, sf_dir: str) -> DataFrame:
    from fractile.llm.common import table

    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train_on(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "passages")


def is_held_out(doc_id: int) -> bool:
    """The same in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
