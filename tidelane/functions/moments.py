"""Second moments of two columns that can be merged: rows are summed up once in blocks, and whatever is a union of
blocks is had from their sums without the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUMS, ENDS = ("sx", "sy", "xx", "yy", "xy"), {"x0": F.array_min, "x1": F.array_max, "y0": F.array_min, "y1": F.array_max}


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.transform(F.array(value), use)[0]


def moments(pairs: Column) -> Column:
    """The moments of an array of (x, y), all known: n, sums, sums of squares and products, and the ranges (a side is
    constant where its range is empty). Plain sums are cheap to take and to merge, but lose digits where values are
    far from zero for their spread: give them about some number near their mean, the same one for all blocks."""

    def of(p: Column) -> Column:
        total = lambda f: F.aggregate(p, F.lit(0.0), lambda t, w: t + f(w["x"], w["y"]))
        sums = [lambda x, y: x, lambda x, y: y, lambda x, y: x * x, lambda x, y: y * y, lambda x, y: x * y]
        return F.struct(F.size(p).cast("long").alias("n"), *[total(f).alias(c) for c, f in zip(SUMS, sums)], *[end(p[c[0]]).alias(c) for c, end in ENDS.items()])

    return once(pairs, of)


def merged(blocks: Column) -> Column:
    """The moments of all rows of an array of blocks, as a struct."""
    n = F.aggregate(blocks, F.lit(0).cast("long"), lambda t, b: t + b["n"])
    total = lambda c: F.aggregate(blocks, F.lit(0.0), lambda t, b: t + F.coalesce(b[c], F.lit(0.0)))
    return F.struct(n.alias("n"), *[total(c).alias(c) for c in SUMS], *[end(blocks[c]).alias(c) for c, end in ENDS.items()])


def correlation(m: Column) -> Column:
    """Pearson's r of moments; NULL below two rows or for a constant side; within +-1."""
    about = lambda s, a, b: m["n"] * m[s] - m[a] * m[b]
    square = lambda s, a: F.sqrt(F.greatest(F.lit(0.0), about(s, a, a)))
    r = F.try_divide(about("xy", "sx", "sy"), square("xx", "sx") * square("yy", "sy"))
    return F.when((m["x0"] < m["x1"]) & (m["y0"] < m["y1"]), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
