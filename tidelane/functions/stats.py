"""Correlation, effective sample size, t-tail p-values, false-discovery adjustment and the gates' predicates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .moments import once

PERIOD_DAYS, MIN_EFFECTIVE = 7, 2.0


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over rows where both are known; NULL below two rows or for a constant side; within +-1."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    # corr() divides by zero for a constant side before ``varies`` is asked
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def pearson_where(condition: Column, x: str, y: str) -> Column:
    """Pearson correlation over the rows that meet a condition."""
    return pearson(F.when(condition, F.col(x)), F.when(condition, F.col(y)))


def overlap_factor(horizon: Column, period: int = PERIOD_DAYS) -> Column:
    return F.greatest(F.lit(1.0), horizon / F.lit(float(period)))


def effective_n(n: Column, horizon: Column, period: int = PERIOD_DAYS) -> Column:
    """Observations of overlapping windows, counted as the non-overlapping ones they amount to."""
    return n.cast("double") / overlap_factor(horizon, period)


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series (DLMF 5.11.1) ten steps up, and back by the recurrence."""
    w = z + 10
    v = 1 / (w * w)
    series = (1 / 12 - v * (1 / 360 - v * (1 / 1260 - v * (1 / 1680 - v * (1 / 1188 - v * (691 / 360360)))))) / w
    product = z
    for k in range(1, 10):
        product = product * (z + k)
    return (w - 0.5) * F.ln(w) - w + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def _beta_fraction(p: Column, q: Column, z: Column) -> Column:
    """The continued fraction of the incomplete beta function (DLMF 8.17.22), from its far end. With q or p one half and
    z below (p + 1) / (p + q + 2) it has settled to double precision after at most 54 terms, whatever the other is."""

    def step(f: Column, m: Column) -> Column:
        odd = -(p + m - 1) * (p + q + m - 1) * z / ((p + 2 * m - 2) * (p + 2 * m - 1))
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        return 1 + odd / (1 + even / f)

    return F.aggregate(F.sequence(F.lit(64), F.lit(1), F.lit(-1)), F.lit(1.0), step)


def incomplete_beta(x: Column, rest: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for x in (0, 1); ``rest`` is 1 - x, given by the caller who
    may know it to more digits."""
    given = F.struct(x.alias("x"), rest.alias("y"), a.cast("double").alias("a"), b.cast("double").alias("b"))

    def turned(g: Column) -> Column:
        swap = g["x"] > (g["a"] + 1) / (g["a"] + g["b"] + 2)
        pick = lambda c, d, name: F.when(swap, g[c]).otherwise(g[d]).alias(name)
        return F.struct(swap.alias("swap"), pick("b", "a", "p"), pick("a", "b", "q"), pick("y", "x", "z"), pick("x", "y", "w"))

    def value(t: Column) -> Column:
        p, q = t["p"], t["q"]
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.ln(t["z"]) + q * F.ln(t["w"])) / p
        return once(front / _beta_fraction(p, q, t["z"]), lambda v: F.when(t["swap"], 1 - v).otherwise(v))

    return once(once(given, turned), value)


def two_tailed_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t with (fractional) df degrees of freedom."""
    square = F.when(t != 0, t * t)
    return F.when(t == 0, 1.0).otherwise(incomplete_beta(df / (df + square), square / (df + square), df / 2, F.lit(0.5)))


def p_value(r: Column, n_effective: Column) -> Column:
    """Two-tailed p of a correlation, NULL unless the effective n exceeds 2; exactly 0 for |r| = 1. With
    t = r * sqrt(df / (1 - r * r)) the beta function's argument is 1 - r * r itself."""
    known = r.isNotNull() & (n_effective > MIN_EFFECTIVE)
    inside = known & (F.abs(r) < 1) & (r != 0)
    part = F.when(inside, r)
    tail = incomplete_beta((1 - part) * (1 + part), part * part, F.when(inside, n_effective - 2) / 2, F.lit(0.5))
    return F.when(known, F.when(F.abs(r) >= 1, 0.0).when(r == 0, 1.0).otherwise(tail))


def _p_range(p: str) -> Column:
    """A number that grows with p: 256 ranges of equal width, the lowest of them cut 16 times an octave."""
    low = F.greatest(F.lit(0), F.lit(9999) + F.floor((F.log2(p) + 8) * 16))
    return F.when(F.col(p) >= 1 / 256, F.lit(10000) + F.floor(F.col(p) * 256)).when(F.col(p) > 0, low).otherwise(F.lit(0)).cast("int")


def benjamini_hochberg(rows: DataFrame, run: list[str], p: str = "p_value", q: str = "q_value") -> DataFrame:
    """Adds ``q`` and ``n_tests_adjusted`` over the rows of each run that have a p.

    Ranks are taken over distinct p-values with their counts (equal p share rank and q). Those are dealt into fixed
    ranges of p, ranked inside each range, and joined with what lies below (counts) and above (the least q) the
    range, which is one row a range; so no task sees a run as a whole. Rows get their q back by an equi-join.
    """
    part = [*run, "_range"]
    distinct = rows.where(F.col(p).isNotNull()).groupBy(*run, p).agg(F.count("*").alias("_c")).withColumn("_range", _p_range(p))
    ranges = Window.partitionBy(*run).orderBy("_range")
    counts = distinct.groupBy(*part).agg(F.sum("_c").alias("_n")).select(
        *part, F.sum("_n").over(Window.partitionBy(*run)).alias("n_tests_adjusted"), F.coalesce(F.sum("_n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below")
    )
    inside = Window.partitionBy(*part).orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    ranked = distinct.join(counts, part).withColumn("_rank", F.col("_below") + F.sum("_c").over(inside))
    ranked = ranked.withColumn("_q", F.col(p) * F.col("n_tests_adjusted") / F.col("_rank"))
    above = ranked.groupBy(*part).agg(F.min("_q").alias("_least")).select(*part, F.min("_least").over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("_above"))
    from_here = F.min("_q").over(Window.partitionBy(*part).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.withColumn("_here", from_here).join(above, part).select(*run, p, F.least(F.lit(1.0), "_here", "_above").alias(q), "n_tests_adjusted")
    return rows.join(out, [*run, p], "left").select(*rows.columns, q, "n_tests_adjusted")


def passes_gate(q: Column, consistency: Column, folds: Column, max_q: float = 0.05, min_consistency: float = 0.70, min_folds: int = 5) -> Column:
    """All three thresholds; anything unknown fails."""
    return F.coalesce((q <= max_q) & (folds >= min_folds) & (consistency >= min_consistency), F.lit(False))


def directional_consistency(full: Column, folds: Column) -> tuple[Column, Column]:
    """(share, folds) of an array of fold statistics: of those that are known, how many have the sign of ``full``; a
    zero fold agrees with nothing, and both are NULL where ``full`` is zero or unknown or no fold is known."""
    known = F.filter(folds, lambda r: r.isNotNull())
    directed = full.isNotNull() & (full != 0) & (F.size(known) > 0)
    agree = F.size(F.filter(known, lambda r: F.signum(r) == F.signum(full)))
    return F.when(directed, agree / F.size(known)), F.when(directed, F.size(known))
