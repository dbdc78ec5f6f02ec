"""Clamped cubic splines through bin middles: fitted once a histogram in numpy batches, integrated by column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = ("knots", "values", "slopes", "upto")


def fit(edges: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of histograms with equally many bins, one a row: the knots (first edge, bin middles, last edge), the spline's values and slopes there, both 0 at the ends, and its integral up to them."""
    x = np.hstack([edges[:, :1], (edges[:, :-1] + edges[:, 1:]) / 2, edges[:, -1:]])
    y = np.pad(counts, ((0, 0), (1, 1)))
    h, slopes = np.diff(x), np.zeros(x.shape)
    rise = np.diff(y) / h
    main, right = 2 * (h[:, :-1] + h[:, 1:]), 3 * (h[:, 1:] * rise[:, :-1] + h[:, :-1] * rise[:, 1:])
    inner = main.shape[1]
    for k in range(1, inner):  # equal second derivatives at inner knots, solved for all rows at once
        f = h[:, k + 1] / main[:, k - 1]
        main[:, k] -= f * h[:, k - 1]
        right[:, k] -= f * right[:, k - 1]
    for k in range(inner - 1, -1, -1):
        slopes[:, k + 1] = (right[:, k] - h[:, k] * slopes[:, k + 2]) / main[:, k]
    pieces = h * (y[:, :-1] + y[:, 1:]) / 2 + h**2 * (slopes[:, :-1] - slopes[:, 1:]) / 12
    return x, y, slopes, np.pad(np.cumsum(pieces, axis=1), ((0, 0), (1, 0)))


@F.pandas_udf(T.StructType([T.StructField(p, T.ArrayType(T.DoubleType())) for p in PARTS]))
def _fitted(edges: pd.Series, counts: pd.Series) -> pd.DataFrame:
    out = {p: np.empty(len(edges), object) for p in PARTS}
    n_bins = counts.map(len).to_numpy()
    for n in np.unique(n_bins):
        rows = np.flatnonzero(n_bins == n)
        found = fit(np.stack(edges.iloc[rows].to_list()).astype(float), np.stack(counts.iloc[rows].to_list()).astype(float))
        for p, values in zip(PARTS, found):
            for r, v in zip(rows, values):
                out[p][r] = v
    return pd.DataFrame(out)


def with_spline(hists: DataFrame) -> DataFrame:
    """With the fitted spline of each histogram in a column of that name."""
    return hists.withColumn("spline", _fitted("edges", "counts"))


def _integral(spline: Column, s: Column, x: Column) -> Column:
    """From the first knot to x, which lies between knots s and s + 1."""
    get = lambda p, k: F.get(spline[p], k)
    w = get("knots", s + 1) - get("knots", s)
    t = (x - get("knots", s)) / w
    ends = get("values", s) * (t - t * t * t + t * t * t * t / 2) + get("values", s + 1) * (t * t * t - t * t * t * t / 2)
    bends = get("slopes", s) * (t * t / 2 - 2 * t * t * t / 3 + t * t * t * t / 4) + get("slopes", s + 1) * (t * t * t * t / 4 - t * t * t / 3)
    return get("upto", s) + w * (ends + w * bends)


def share_below(spline: Column, edges: Column, counts: Column, i: Column, x: Column) -> Column:
    """The share of bin i's mass that the spline puts below x, a place in the bin; 0 of an empty bin."""
    low, high = _integral(spline, i, F.get(edges, i)), _integral(spline, i + 1, F.get(edges, i + 1))
    at = _integral(spline, F.when(x < F.get(spline["knots"], i + 1), i).otherwise(i + 1), x)
    return F.when((F.get(counts, i) > 0) & (high != low), (at - low) / (high - low)).otherwise(0.0)
