"""Column expressions over histograms (edges ARRAY<DOUBLE>, counts, cum): everything stays in one row, so no bins are exploded and nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fractile.functions.spline import share_below

#: Decimals that values, edges and percentiles are rounded to.
PRECISION = 4
SCALE = 10_000.0


def round4(x: Column) -> Column:
    """Half-even to four decimals."""
    return F.rint(x * SCALE) / SCALE


def scaled(x: Column) -> Column:
    """A share as a whole number of ten-thousandths, half-even: exact to compare."""
    return F.rint(x * SCALE).cast("int")


def at(values: Column, k: Column) -> Column:
    """values[k] from 0, and 0 outside."""
    return F.coalesce(F.get(values, k.cast("int")), F.lit(0))


def cumulated(counts: Column, zero: Column | None = None) -> Column:
    """0 and the running sums, one longer than counts."""
    start = F.array(F.lit(0).cast("long") if zero is None else zero)
    return F.aggregate(counts, start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def edges_below(edges: Column, x: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e < x))


def edges_upto(edges: Column, x: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e <= x))


def mass(edges: Column, counts: Column, cum: Column, op: Column, ref: Column, mode: str, edge_compat: bool = True, spline: Column | None = None) -> Column:
    """How much of a histogram may (over), must (under), or on a linear share (continuous_value) or a fitted spline's (cubic_spline) does satisfy `value op ref`.

    With edge_compat a reference that equals a bin's upper edge counts that bin
    twice for lt and le in all modes but under, as the engine
    that this one replaces does; without it, once.
    """
    if mode not in ("over", "under", "continuous_value", "cubic_spline"):
        raise ValueError(f"unknown estimation mode: {mode}")
    total = F.element_at(cum, -1)
    k = edges_below(edges, ref)
    n = F.size(edges)
    i = k - 1
    own = at(counts, i)
    on_edge = F.get(edges, k) == ref
    low, high = F.get(edges, i), F.get(edges, k)
    if mode == "cubic_spline":
        below = share_below(spline, edges, counts, i, ref)
        inside_low, inside_high = own * below, own * (1 - below)
    else:
        inside_low = {"over": own, "under": F.lit(0), "continuous_value": own * ((ref - low) / (high - low))}[mode]
        inside_high = {"over": own, "under": F.lit(0), "continuous_value": own * ((high - ref) / (high - low))}[mode]
    edge_low = own
    if mode == "over":
        edge_low = own + F.when((op == "le") & (k < n - 1), at(counts, k)).otherwise(0)
    if edge_compat:
        edge_low = edge_low + inside_low
    less = at(cum, i) + F.when(on_edge, edge_low).otherwise(inside_low)
    edge_high = F.when(op == "gt", -at(counts, k)).otherwise(0) if mode == "under" else F.lit(0)
    more = total - at(cum, k) + F.when(on_edge, edge_high).otherwise(inside_high)
    lower = op.isin("lt", "le")
    return F.when(k == 0, F.when(lower, F.lit(0)).otherwise(total)).when(k == n, F.when(lower, total).otherwise(F.lit(0))).when(lower, less).otherwise(more)


def satisfied(part: Column, total: Column, percentile: Column, mode: str, edge_compat: bool = True) -> Column:
    """Whether part / total, rounded, reaches the percentile. Counted modes compare whole ten-thousandths; a linear share is compared with the percentile in single precision if edge_compat."""
    if mode in ("over", "under"):
        return scaled(part / total) >= scaled(percentile)
    bound = percentile.cast("float").cast("double") if edge_compat else percentile
    return round4(part / total) >= bound


def distribution(edges: Column, counts: Column, cum: Column, x: Column, spline: Column | None = None) -> Column:
    """The share of a histogram below x if values spread evenly within bins, or as a fitted spline says."""
    total = F.element_at(cum, -1)
    k = edges_below(edges, x)
    i = k - 1
    low, high = F.get(edges, i), F.get(edges, k)
    below = (x - low) / (high - low) if spline is None else share_below(spline, edges, counts, i, x)
    inside = (at(cum, i) + at(counts, i) * below) / total
    return F.when(k == 0, F.lit(0.0)).when(k == F.size(edges), F.lit(1.0)).otherwise(inside)


def surely_below(edges: Column, cum: Column, x: Column) -> Column:
    """The share in bins that end at or before x."""
    return at(cum, F.greatest(edges_upto(edges, x) - 1, F.lit(0))) / F.element_at(cum, -1)


def maybe_below(edges: Column, cum: Column, x: Column) -> Column:
    """The share in bins that begin before x."""
    return at(cum, F.least(edges_below(edges, x), F.size(edges) - 1)) / F.element_at(cum, -1)


#: A Chebyshev fit of the complementary error function, relative error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    tail = t * F.exp(-x * x + poly) / 2
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)
