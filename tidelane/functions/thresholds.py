"""Percentile thresholds of the full record and gap-aware run lengths below them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import RANGE, earlier, joined, ranged, so_far, with_previous

LEVELS = (5, 10, 20)


def thresholds(rows: DataFrame, keys: list[str], value: str = "value", levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """keys, p05, p10, ...: exact interpolated percentiles of the values known; NULL for a key without any.

    By selection: values are counted, map-side first, and lie in ranges by sampled splitters; the counts of the ranges
    say which range holds a rank, and only those are put in order. No task sees all values of a key.
    """
    known = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    parts = ranged(known, keys, ["_v"])
    counts = parts.groupBy(*keys, RANGE).agg(F.sum("_c").alias("_n"))
    counts = counts.select(*keys, RANGE, "_n", F.coalesce(F.sum("_n").over(earlier(keys)), F.lit(0)).alias("_below"))
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    place = lambda p: F.lit(p / 100) * (F.col("_total") - 1)
    wanted = total.select(*keys, F.explode(F.array_distinct(F.array(*[f(place(p)).cast("long") for p in levels for f in (F.floor, F.ceil)]))).alias("_rank"))
    of = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    held = wanted.alias("w").join(counts.alias("c"), of("w", "c")).where((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_n")))
    held = held.select(*[F.col(f"w.{k}").alias(k) for k in keys], RANGE, "_below", "_rank").groupBy(*keys, RANGE, "_below").agg(F.collect_list("_rank").alias("_ranks"))
    some = joined(parts, held, keys).where(F.col("_ranks").isNotNull())
    some = some.withColumn("_upto", F.col("_below") + F.sum("_c").over(so_far(keys, ["_v"])))
    picked = some.select(*keys, "_v", F.explode(F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_c")))).alias("_rank"))
    values = picked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    at = lambda f, p: F.try_element_at("_at", f(place(p)).cast("long"))
    between = lambda p: F.when(at(F.floor, p) == at(F.ceil, p), at(F.floor, p)).otherwise((F.ceil(place(p)) - place(p)) * at(F.floor, p) + (place(p) - F.floor(place(p))) * at(F.ceil, p))
    limits = total.alias("t").join(values.alias("v"), of("t", "v")).select(*[F.col(f"t.{k}").alias(k) for k in keys], *[between(p).alias(f"p{p:02d}") for p in levels])
    every = rows.select(*keys).distinct()
    return every.alias("e").join(limits.alias("l"), of("e", "l"), "left").select(*[F.col(f"e.{k}").alias(k) for k in keys], *[f"p{p:02d}" for p in levels])


def run_lengths(rows: DataFrame, keys: list[str], limits: dict[str, str], date: str = "date", value: str = "value") -> DataFrame:
    """Adds a column for each entry of ``limits`` (new name -> column of the threshold): days in a row strictly below
    it, 0 on a day that is not, and NULL (unknown) from a calendar gap or a missing value until the first day that is
    not below. A record's first day counts as the start of a run.

    A segmented scan: in a range each row counts the days below and the unknown ones so far, and what those counts
    were at the last reset; a range hands its totals and its last reset on. All thresholds go in one pass.
    """
    parts = with_previous(ranged(rows, keys, [date]), keys, [date], {"_previous": date})
    gap = F.coalesce(F.datediff(F.col(date), F.col("_previous")) > 1, F.lit(False)) | F.col(value).isNull()
    flags, local, ends = {}, {}, []
    upto = so_far(keys, [date])
    for name, limit in limits.items():
        low, reset = f"_low_{name}", f"_reset_{name}"
        flags |= {reset: F.coalesce(F.col(value) >= F.col(limit), F.lit(False)), low: F.coalesce(F.col(value) < F.col(limit), F.lit(False))}
        flags[f"_odd_{name}"] = ~flags[reset] & gap
        counts = F.struct(F.count_if(low).over(upto).alias("low"), F.count_if(f"_odd_{name}").over(upto).alias("odd"))
        local[f"_counts_{name}"] = counts
        ends.append(F.max_by(f"_counts_{name}", date).alias(f"_total_{name}"))
        ends.append(F.max_by(F.when(F.col(reset), F.col(f"_counts_{name}")), F.when(F.col(reset), F.col(date))).alias(f"_at_{name}"))
    marked = parts.withColumns(flags).withColumns(local)
    summary = marked.groupBy(*keys, RANGE).agg(*ends)
    sums = {f"_{part}_{name}": F.coalesce(F.sum(F.col(f"_total_{name}.{part}")).over(earlier(keys)), F.lit(0)) for name in limits for part in ("low", "odd")}
    summary = summary.withColumns(sums)
    # the counts at the last reset before a range, in counts from the key's first row
    whole = {f"_at_{name}": F.when(F.col(f"_at_{name}").isNotNull(), F.struct(*[(F.col(f"_at_{name}.{part}") + F.col(f"_{part}_{name}")).alias(part) for part in ("low", "odd")])) for name in limits}
    summary = summary.withColumns(whole)
    summary = summary.select(*keys, RANGE, *[F.struct(F.col(f"_low_{n}").alias("low"), F.col(f"_odd_{n}").alias("odd"), F.last(f"_at_{n}", ignorenulls=True).over(earlier(keys)).alias("reset")).alias(f"_in_{n}") for n in limits])
    found = joined(marked, summary, keys)
    for name in limits:
        here = F.last(F.when(F.col(f"_reset_{name}"), F.col(f"_counts_{name}")), ignorenulls=True).over(upto)
        since = lambda part, name=name: F.when(F.col("_here").isNotNull(), F.col(f"_counts_{name}.{part}") - F.col(f"_here.{part}")).otherwise(F.col(f"_counts_{name}.{part}") + F.col(f"_in_{name}.{part}") - F.coalesce(F.col(f"_in_{name}.reset.{part}"), F.lit(0)))
        run = F.when(F.col(f"_reset_{name}"), 0).when(since("odd") > 0, None).otherwise(since("low"))
        found = found.withColumn("_here", here).withColumn(name, run.cast("int"))
    return found.select(*rows.columns, *limits)
