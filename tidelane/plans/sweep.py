"""Lag x horizon x regime sweep of correlations between features and forward returns."""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.regimes import REGIMES, direction
from ..functions.moments import correlation, merged, moments
from ..functions.stats import MIN_EFFECTIVE, benjamini_hochberg, directional_consistency, effective_n, p_value, passes_gate
from ..functions.targets import HORIZONS
from ..session import stage
from .features import Feature, collapsing

FOLDS, MIN_TRAIN = 5, 26
PAIR = ["feature_name", "site_id", "horizon_days", "lag_days", "regime"]
SERIES_LAG = ["feature_name", "site_id", "lag_days"]


def lag_axis(low: int = -21, high: int = 21) -> list[int]:
    if low > high:
        raise ValueError("the lag range is inverted")
    return list(range(low, high + 1))


def single_observation(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Series all of whose days have one observation: their mean, minimum and maximum are one number."""
    return daily.groupBy(*keys).agg(F.bool_and(F.col("n_observations") == 1).alias("single")).where("single").drop("single")


def series_columns(features: DataFrame) -> DataFrame:
    """feature_name, site_id, series_column: the anomaly where a series has any, else the value."""
    return features.groupBy("feature_name", "site_id").agg(F.bool_or(F.col("anomaly").isNotNull()).alias("_a")).select("feature_name", "site_id", F.when(F.col("_a"), "anomaly").otherwise("value").alias("series_column"))


def skips(spark: SparkSession, single: DataFrame, features: tuple[Feature, ...]) -> DataFrame:
    """site_id, feature_name, kept, reason: duplicates that the grid leaves out at sites with single observations."""
    table = spark.createDataFrame(collapsing(features) or [], "param_code string, kept string, feature_name string")
    return single.join(table, "param_code").select("site_id", "feature_name", "kept", F.concat(F.lit("one series with "), "kept", F.lit(": every day has a single observation")).alias("reason"))


def build_grid(
    sites: DataFrame, names: list[str], columns: DataFrame, lags: list[int], horizons: tuple[int, ...] = HORIZONS, regimes: tuple[str, ...] = REGIMES, skipped: DataFrame | None = None,
) -> DataFrame:
    """One row for each cell; sites without rows stay, to be recorded as such. The axes are short tables that are
    exploded along the sites, the only side that grows."""
    axis = lambda values, name: F.explode(F.array(*map(F.lit, values))).alias(name)
    cells = sites.select("site_id").distinct().select("site_id", axis(names, "feature_name"))
    if skipped is not None:
        cells = cells.join(skipped.select("site_id", "feature_name"), ["site_id", "feature_name"], "left_anti")
    cells = cells.join(columns, ["feature_name", "site_id"], "left").withColumn("series_column", F.coalesce("series_column", F.lit("value")))
    return cells.select("*", axis(horizons, "horizon_days")).select("*", axis(regimes, "regime")).select("*", axis(lags, "lag_days"))


def chosen_series(features: DataFrame, columns: DataFrame) -> DataFrame:
    """feature_name, site_id, date, value: the column that each series is scanned on."""
    picked = features.join(columns, ["feature_name", "site_id"])
    return picked.select("feature_name", "site_id", "date", F.when(F.col("series_column") == "anomaly", F.col("anomaly")).otherwise(F.col("value")).alias("value"))


def by_day(series: DataFrame, until: Column) -> DataFrame:
    """feature_name, site_id, day, fdate, x, regimes: the last known value of each series on every calendar day from
    its first to ``until``, with the regimes of its own date (which come from the full series, NULLs included)."""
    keys = ["feature_name", "site_id"]
    known = direction(series, keys).where(F.col("value").isNotNull())
    last = F.least(F.coalesce(F.date_sub(F.lead("date").over(Window.partitionBy(*keys).orderBy("date")), 1), until), until)
    spans = known.withColumn("_last", last).where(F.col("date") <= F.col("_last"))
    both = F.array_compact(F.array(F.col("regime"), F.lit("all")))
    return spans.select(*keys, F.explode(F.sequence("date", "_last")).alias("day"), F.col("date").alias("fdate"), F.col("value").alias("x"), both.alias("regimes"))


def matched(series: DataFrame, weeks: DataFrame, lags: list[int]) -> DataFrame:
    """feature_name, site_id, lag_days, fdate, x, regimes and the columns of ``weeks`` (``week`` among them): each
    series as of ``week - lag``, once for all horizons and regimes, dealt by series and lag, since there may be fewer
    series than cores."""
    cells = weeks.withColumn("lag_days", F.explode(F.array(*map(F.lit, lags)))).withColumn("day", F.date_sub("week", F.col("lag_days")))
    return by_day(series, cells.agg(F.max("day")).scalar()).join(cells, "day").repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), *SERIES_LAG)


def pair_moments(series: DataFrame, targets: DataFrame, lags: list[int], horizons: tuple[int, ...] = HORIZONS, n_folds: int = FOLDS, min_train: int = MIN_TRAIN) -> DataFrame:
    """feature_name, site_id, horizon_days, lag_days, regime, blocks: for each pair the mergeable moments of its weeks
    before testing and of each walk-forward fold (``fold`` NULL and from 0), all that any correlation of the pair needs.

    A series and lag has its weeks once, in order, for all horizons and regimes: the members of a pair are filtered
    from that list, and folds are slices of what is left, so no row of a pair is ever made or shuffled. Testing starts
    with the first week more than a horizon after the pair's ``min_train``-th. A list is as long as the calendar has
    weeks. The result is small and written, since several expressions read each block.
    """
    value = lambda h: F.max(F.when(F.col("horizon_days") == h, F.col("value"))).alias(f"y{h}")
    known = targets.where(F.col("value").isNotNull() & F.col("horizon_days").isin(*horizons))
    weeks = known.groupBy(F.col("week_ending").alias("week")).agg(*map(value, horizons))
    rows = matched(series, weeks, lags).withColumn("d", F.unix_date("week"))
    lists = rows.groupBy(*SERIES_LAG).agg(F.avg("x").alias("_mean"), F.sort_array(F.collect_list(F.struct("d", "x", "regimes", *[f"y{h}" for h in horizons]))).alias("weeks"))

    def members(r: str, h: int) -> Column:
        held = F.filter("weeks", lambda w: F.array_contains(w["regimes"], r) & w[f"y{h}"].isNotNull())
        return F.struct(F.lit(r).alias("regime"), F.lit(h).alias("horizon_days"), F.transform(held, lambda w: F.struct(w["d"].alias("d"), (w["x"] - F.col("_mean")).alias("x"), w[f"y{h}"].alias("y"))).alias("members"))

    pairs = lists.select(*SERIES_LAG, F.inline(F.array(*[members(r, h) for r in REGIMES for h in horizons])))
    until = F.try_element_at("members", F.lit(min_train))["d"] + F.col("horizon_days")
    pairs = pairs.withColumn("_until", until).withColumn("_first", F.when(F.col("_until").isNotNull(), F.size(F.filter("members", lambda w: w["d"] <= F.col("_until")))))
    pairs = pairs.withColumn("_block", F.floor((F.size("members") - F.col("_first")) / n_folds).cast("int"))
    cut = lambda fold, start, n: F.struct(fold.cast("int").alias("fold"), (start + 1).cast("int").alias("start"), n.cast("int").alias("n"))
    rest = F.size("members") - F.col("_first")
    tested = F.transform(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: cut(f, F.col("_first") + f * F.col("_block"), F.when(f < n_folds - 1, F.col("_block")).otherwise(rest - f * F.col("_block"))))
    cuts = F.when(F.col("_block") > 0, F.concat(F.array(cut(F.lit(None), F.lit(0), F.col("_first"))), tested)).otherwise(F.array(cut(F.lit(None), F.lit(0), F.size("members"))))
    blocks = F.transform(F.filter("_cuts", lambda c: c["n"] > 0), lambda c: F.struct(c["fold"].alias("fold"), moments(F.slice("members", c["start"], c["n"])).alias("m")))
    return stage(pairs.where(F.size("members") > 0).withColumn("_cuts", cuts).select(*PAIR, blocks.alias("blocks")), "pairs")


def align(series: DataFrame, targets: DataFrame, lags: list[int]) -> DataFrame:
    """feature_name, site_id, horizon_days, lag_days, regime, week, fdate, x, y: each series as of ``week - lag``, once
    for each regime of the matched date.

    Every series is carried forward to calendar days, so weeks and lags meet it by an equi-join on the anchor day,
    once for all horizons. Weeks whose target is unknown drop out.
    """
    known = targets.where(F.col("value").isNotNull()).groupBy(F.col("week_ending").alias("week")).agg(F.collect_list(F.struct("horizon_days", F.col("value").alias("y"))).alias("ys"))
    each = matched(series, known, lags).select("feature_name", "site_id", "lag_days", "week", "fdate", "x", "ys", F.explode("regimes").alias("regime"))
    return each.select("feature_name", "site_id", "lag_days", "regime", "week", "fdate", "x", F.inline("ys"))


def with_folds(rows: DataFrame, keys: list[str], week: str, horizon: Column, horizons: tuple[int, ...], n_folds: int = FOLDS, min_train: int = MIN_TRAIN) -> DataFrame:
    """Adds ``fold``, the walk-forward test block of a row, NULL before testing starts; a key has a week once.

    Testing starts at the first week with ``min_train`` weeks more than a horizon before it; the weeks from there
    make ``n_folds`` equal blocks, the last taking the remainder. Too few weeks give no fold. A range frame needs a
    literal bound, so days are counted in parts of the horizon: "more than a horizon before" is one bound for all.
    """
    unit = lcm(*horizons)
    in_order = Window.partitionBy(*keys).orderBy("_d")
    whole = Window.partitionBy(*keys)
    train = F.count("*").over(in_order.rangeBetween(Window.unboundedPreceding, -(unit + 1)))
    out = rows.withColumn("_d", F.unix_date(week).cast("long") * (F.lit(unit) / horizon).cast("long"))
    out = out.withColumns({"_train": train, "_ord": F.row_number().over(in_order) - 1, "_n": F.count("*").over(whole)})
    out = out.withColumn("_first", F.min(F.when(F.col("_train") >= min_train, F.col("_ord"))).over(whole))
    block = F.floor((F.col("_n") - F.col("_first")) / n_folds)
    fold = F.least(F.floor((F.col("_ord") - F.col("_first")) / F.when(block > 0, block)), F.lit(n_folds - 1))
    testing = (F.col("_ord") >= F.col("_first")) & (block > 0)
    return out.withColumn("fold", F.when(testing, fold).cast("int")).drop("_d", "_train", "_ord", "_n", "_first")


def folds(rows: DataFrame, keys: list[str], week: str, horizon: str, horizons: tuple[int, ...], n_folds: int = FOLDS, min_train: int = MIN_TRAIN) -> DataFrame:
    """keys (the horizon among them), fold, train_start, train_end, n_train, test_start, test_end, n_test."""
    weeks = rows.select(*keys, week).distinct()
    blocks = with_folds(weeks, keys, week, F.col(horizon), horizons, n_folds, min_train).where("fold IS NOT NULL")
    tests = blocks.groupBy(*keys, "fold").agg(F.min(week).alias("test_start"), F.max(week).alias("test_end"), F.count("*").alias("n_test"))
    train = tests.join(weeks.withColumnRenamed(week, "_w"), keys).where(F.col("_w") < F.date_sub("test_start", F.col(horizon)))
    return train.groupBy(*keys, "fold", "test_start", "test_end", "n_test").agg(F.min("_w").alias("train_start"), F.max("_w").alias("train_end"), F.count("*").alias("n_train"))


def leaking(folds_: DataFrame, horizon: Column) -> DataFrame:
    """Folds whose training reaches into their test block; has to be empty."""
    return folds_.where(F.date_add("train_end", horizon) >= F.col("test_start"))


def measurements(pairs: DataFrame) -> DataFrame:
    """One row for each pair of ``pair_moments``: status, statistic, p, n, effective n, folds, consistency."""
    horizon = F.col("horizon_days")
    full = pairs.select(*PAIR, merged(F.transform("blocks", lambda b: b["m"])).alias("_m"), F.transform(F.filter("blocks", lambda b: b["fold"].isNotNull()), lambda b: correlation(b["m"])).alias("_folds"))
    full = full.select(*PAIR, F.col("_m.n").alias("n_observations"), correlation(F.col("_m")).alias("_r"), "_folds")
    full = full.withColumn("_n_eff", effective_n(F.col("n_observations"), horizon))
    measured = F.col("_r").isNotNull() & (F.col("_n_eff") > MIN_EFFECTIVE)
    full = full.withColumns({"statistic": F.when(measured, F.col("_r")), "n_effective": F.when(measured, F.col("_n_eff"))})
    share, known = directional_consistency(F.col("statistic"), F.col("_folds"))
    status = F.when(F.col("statistic").isNull(), "insufficient_observations").when(F.size("_folds") == 0, "insufficient_folds").otherwise("scanned")
    return full.select(
        *PAIR, status.alias("status"), "statistic", p_value(F.col("statistic"), F.col("n_effective")).alias("p_value"), "n_observations", "n_effective",
        F.when(F.col("statistic").isNotNull(), F.coalesce(known, F.size("_folds"))).alias("folds"), share.alias("directional_consistency"),
    )


def adjusted(grid: DataFrame, measured: DataFrame, run_id: int) -> DataFrame:
    """Every grid cell with its measurement, q over the run and the gate; cells without rows are recorded as such."""
    run = F.lit(run_id).cast("long").alias("run_id")
    tested = benjamini_hochberg(measured.select("*", run), ["run_id"]).drop("run_id", "n_tests_adjusted")
    return grid.join(tested, PAIR, "left").withColumns({
        "status": F.coalesce("status", F.lit("insufficient_observations")), "n_observations": F.coalesce("n_observations", F.lit(0).cast("long")), "run_id": run,
        "n_tests_adjusted": measured.agg(F.count("p_value")).scalar(), "passes_gate": passes_gate(F.col("q_value"), F.col("directional_consistency"), F.col("folds")),
    })


def sweep(features: DataFrame, targets: DataFrame, sites: DataFrame, names: list[str], lags: list[int], run_id: int, horizons: tuple[int, ...] = HORIZONS, skipped: DataFrame | None = None, n_folds: int = FOLDS, min_train: int = MIN_TRAIN) -> DataFrame:
    """The whole scan: one row for each cell of the grid; an empty grid is an error. Measured pairs, one row each, are
    written to the shared folder; no row of theirs is."""
    columns = series_columns(features)
    grid = build_grid(sites, names, columns, lags, horizons, skipped=skipped)
    if not (names and lags and horizons) or grid.isEmpty():
        raise ValueError("the grid is empty: no site, feature, lag or horizon is left to scan")
    pairs = pair_moments(chosen_series(features, columns), targets, lags, horizons, n_folds, min_train)
    return adjusted(grid, stage(measurements(pairs), "measured"), run_id)


def run_summary(runs: DataFrame, signals: DataFrame) -> DataFrame:
    """Runs, newest first, with counts of their rows by outcome; a run without rows stays with zeros."""
    per = signals.groupBy("run_id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("passes_gate")).alias("n_passing"), F.count_if(F.col("status") == "scanned").alias("n_scanned"),
        F.count_if(F.col("p_value").isNotNull()).alias("n_tested"), F.count_if(F.col("passes_gate") & (F.col("lag_days") < 0)).alias("n_passing_negative_lag"),
    )
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_rows", "n_passing", "n_scanned", "n_tested", "n_passing_negative_lag")}
    return runs.join(per, "run_id", "left").withColumns(zero).orderBy(F.desc("run_id"))


def strongest_signal(signals: DataFrame, feature: str) -> DataFrame:
    """site_id, run_id, q_value: the smallest q in the latest run that scanned the feature at each site."""
    rows = signals.where(F.col("feature_name") == feature)
    latest = rows.groupBy("site_id").agg(F.max("run_id").alias("run_id"))
    return rows.join(latest, ["site_id", "run_id"]).groupBy("site_id", "run_id").agg(F.min("q_value").alias("q_value"))


def tallies(rows: DataFrame, result: str, by: list[str] | None = None) -> DataFrame:
    """How many rows have each result, by further columns if given: gate results of analog queries, states of runs."""
    return rows.groupBy(*(by or []), result).agg(F.count("*").alias("n"))


def lag_signs(signals: DataFrame) -> DataFrame:
    """run_id, regime, n_negative, n_positive: passing rows whose feature lags or leads the week."""
    passed = F.coalesce("passes_gate", F.lit(False))
    return signals.groupBy("run_id", "regime").agg(F.count_if(passed & (F.col("lag_days") < 0)).alias("n_negative"), F.count_if(passed & (F.col("lag_days") > 0)).alias("n_positive"))
