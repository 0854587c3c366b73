"""Nearest-analog queries for many (site, as_of) pairs in one job.

``queries`` is a table (query_id, site_id, as_of). Everything a query sees is cut off at its own as_of date. Events,
their counts and the spread of the features only depend on what precedes, so each site's series is folded once and
queries read it at their date; only the events that a query compares are expanded for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.targets import log_return
from ..operators.asof import asof_backward
from ..operators.ranges import ranged, running_count, with_previous
from ..session import stage


@dataclass(frozen=True)
class Parameters:
    entry_feature: str = "days_below_p10"
    run_length: int = 1
    separation_days: int = 90
    features: tuple[str, ...] = ("discharge_mean", "discharge_min", "days_below_p05", "days_below_p10", "days_below_p20")
    k: int = 10
    window_days: int = 21
    lookback_days: int = 14
    min_analogs: int = 4
    min_consistency: float = 0.70
    condition_feature: str = "discharge_min"


def detections(series: DataFrame, keys: list[str], date: str, value: str, run_length: int) -> DataFrame:
    """Dates on which the entry condition holds; each is judged by its own row, never by a later one."""
    return series.where(F.col(value) >= run_length).select(*keys, date)


def collapse(found: DataFrame, keys: list[str], date: str, separation_days: int) -> DataFrame:
    """keys, event_start, n_detections: a detection more than ``separation_days`` after the one before begins an event."""
    parts = with_previous(ranged(found.select(*keys, date), keys, [date]), keys, [date], {"_before": date})
    new = F.coalesce(F.datediff(F.col(date), F.col("_before")) > separation_days, F.lit(True))
    numbered = running_count(parts, keys, [date], new, "_event")
    return numbered.groupBy(*keys, "_event").agg(F.min(date).alias("event_start"), F.count("*").alias("n_detections")).drop("_event")


def site_events(features: DataFrame, p: Parameters) -> DataFrame:
    """site_id, event_start, n_detections of the entry condition over whole records."""
    rows = features.where(F.col("feature_name") == p.entry_feature)
    return collapse(detections(rows, ["site_id"], "date", "value", p.run_length), ["site_id"], "date", p.separation_days)


def states(features: DataFrame, p: Parameters) -> DataFrame:
    """site_id, date, inside, n_raw, n_events, start: on each date of the entry feature whether the condition holds,
    and what has been detected so far."""
    rows = features.where(F.col("feature_name") == p.entry_feature)
    order = Window.partitionBy("site_id").orderBy("date")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.col("value") >= p.run_length, F.lit(False))
    before = F.last(F.when(inside, F.col("date")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("inside") & F.coalesce(F.datediff("date", F.col("_before")) > p.separation_days, F.lit(True))
    marked = rows.select("site_id", "date", inside.alias("inside"), before.alias("_before")).withColumn("_new", new)
    count = lambda c: F.sum(F.col(c).cast("long")).over(so_far)
    return marked.select("site_id", "date", "inside", count("inside").alias("n_raw"), count("_new").alias("n_events"), F.last(F.when(F.col("_new"), F.col("date")), ignorenulls=True).over(so_far).alias("start"))


def query_events(queries: DataFrame, features: DataFrame, p: Parameters) -> tuple[DataFrame, DataFrame]:
    """(events by site, one summary row by query: raw detections, events, query_start where the condition holds)."""
    found = asof_backward(queries, states(features, p), ["site_id"], "as_of", "date", ["inside", "n_raw", "n_events", "start"], long_series=False)  # as long as what ``states`` folds
    zero = F.lit(0).cast("long")
    summary = found.select(
        *queries.columns, F.coalesce("n_raw", zero).alias("n_raw_detections"), F.coalesce("n_events", zero).alias("n_collapsed_events"), F.when(F.col("inside"), F.col("start")).alias("query_start")
    )
    return site_events(features, p), summary


def eligible(events: DataFrame, summary: DataFrame, window_days: int) -> DataFrame:
    """query_id, site_id, as_of, event_start, n_detections: events of the query's site whose outcome window closed by
    as_of and before the query's own event began. Such an event is over by then: its detections are all known."""
    asking = summary.where(F.col("query_start").isNotNull()).select("query_id", "site_id", "as_of", "query_start")
    end = F.date_add("event_start", window_days)
    return asking.join(events, "site_id").where((end <= F.col("as_of")) & (end < F.col("query_start"))).drop("query_start")


_ALWAYS = "DATE '0001-01-01'"


def first_anomalies(features: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """site_id, epochs, first_<name>: when each feature first has an anomaly, and the dates on which that changes
    which column is read."""
    rows = features.where(F.col("feature_name").isin(list(names)))
    first = rows.groupBy("site_id").agg(*[F.min(F.when((F.col("feature_name") == n) & F.col("anomaly").isNotNull(), F.col("date"))).alias(f"first_{n}") for n in names])
    return first.withColumn("epochs", F.array_distinct(F.array_compact(F.array(F.expr(_ALWAYS), *[F.col(f"first_{n}") for n in names]))))


def epoch_of(as_of: str) -> Column:
    return F.array_max(F.filter("epochs", lambda e: e <= F.col(as_of)))


def vectors(features: DataFrame, firsts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """site_id, epoch, date, a column for each feature, and mean_ and sd_ over all complete vectors up to the date.

    A feature reads its anomaly if it has any by the query's as_of, else its value; as_of dates between two first
    anomalies of a site agree on that, and make an epoch. Only complete vectors are rows.
    """
    rows = features.where(F.col("feature_name").isin(list(names)))
    pick = lambda n, c: F.max(F.when(F.col("feature_name") == n, F.col(c)))
    wide = rows.groupBy("site_id", "date").agg(*[pick(n, "value").alias(f"v_{n}") for n in names], *[pick(n, "anomaly").alias(f"a_{n}") for n in names])
    each = wide.join(firsts, "site_id").withColumn("epoch", F.explode("epochs"))
    chosen = [F.when(F.col(f"first_{n}") <= F.col("epoch"), F.col(f"a_{n}")).otherwise(F.col(f"v_{n}")).alias(n) for n in names]
    full = each.select("site_id", "epoch", "date", *chosen).dropna("any", subset=list(names))
    so_far = Window.partitionBy("site_id", "epoch").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return full.select("*", *[c.over(so_far).alias(f"mean_{n}") for n, c in ((n, F.avg(n)) for n in names)], *[_spread(n, so_far).alias(f"sd_{n}") for n in names])


def _spread(c: str, over=None) -> Column:
    """Population spread; exactly 0 for a constant."""
    low, high, sd = ((f if over is None else f.over(over)) for f in (F.min(c), F.max(c), F.stddev_pop(c)))
    return F.when(low == high, 0.0).otherwise(sd)


def scale(population: DataFrame, names: tuple[str, ...], keys: list[str]) -> DataFrame:
    """Population mean and spread of each dimension; the spread of a constant is exactly 0."""
    return population.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in names], *[_spread(c).alias(f"sd_{c}") for c in names])


def require_population(population: DataFrame) -> DataFrame:
    """Nothing to standardise against is an error, not a spread of zero."""
    if population.isEmpty():
        raise ValueError("the population is empty: there are no observations to standardise against")
    return population


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd == 0, 0.0).otherwise((x - mean) / F.nullif(sd, F.lit(0.0)))


def distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Unweighted Euclidean distance."""
    total = F.lit(0.0)
    for name in a:
        total = total + F.pow(a[name] - b[name], F.lit(2.0))
    return F.sqrt(total)


def ranked(pairs: DataFrame, names: tuple[str, ...], k: int) -> DataFrame:
    """query_id, event_start, distance, rank: the k nearest pairs of each query by z-scored distance, ties by date.
    ``pairs`` has q_<name> and e_<name> of both sides, and mean_<name> and sd_<name>."""
    z = lambda side, c: z_score(F.col(f"{side}_{c}"), F.col(f"mean_{c}"), F.col(f"sd_{c}"))
    d = distance({c: z("q", c) for c in names}, {c: z("e", c) for c in names})
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "event_start"))
    return pairs.select("query_id", "event_start", d.alias("distance")).withColumn("rank", rank).where(F.col("rank") <= k)


def k_nearest(vecs: DataFrame, candidates: DataFrame, p: Parameters) -> DataFrame:
    """The k nearest candidate dates (query_id, event_start) of each query to its as_of date, where ``vecs`` holds each
    query's own population (query_id, as_of, date, features)."""
    names = p.features
    here = vecs.where(F.col("date") == F.col("as_of")).select("query_id", *[F.col(c).alias(f"q_{c}") for c in names])
    there = vecs.select("query_id", F.col("date").alias("event_start"), *[F.col(c).alias(f"e_{c}") for c in names])
    pairs = candidates.join(there, ["query_id", "event_start"]).join(here, "query_id").join(scale(vecs, names, ["query_id"]), "query_id")
    return ranked(pairs, names, p.k)


def nearest_events(candidates: DataFrame, vecs: DataFrame, firsts: DataFrame, p: Parameters) -> DataFrame:
    """The k nearest of the candidate events (query_id, site_id, as_of, event_start), standardised over all that was
    known at as_of. A query without a complete vector on its own date has none."""
    names = p.features
    moments = [f"{m}_{c}" for c in names for m in ("mean", "sd")]
    at = candidates.join(firsts.select("site_id", "epochs"), "site_id").withColumn("epoch", epoch_of("as_of")).drop("epochs")
    here = vecs.select("site_id", "epoch", F.col("date").alias("as_of"), *[F.col(c).alias(f"q_{c}") for c in names], *moments)
    there = vecs.select("site_id", "epoch", F.col("date").alias("event_start"), *[F.col(c).alias(f"e_{c}") for c in names])
    return ranked(at.join(there, ["site_id", "epoch", "event_start"]).join(here, ["site_id", "epoch", "as_of"]), names, p.k)


def outcomes(events: DataFrame, rates: DataFrame, week: str, rate: str, window_days: int, keys: list[str] | None = None) -> DataFrame:
    """Adds reason and log_return: the move from the last week at or before event_start to the last at or before its
    end. A week without a rate is matched, not skipped. The series' reach is judged first, on all weeks.
    One rate series may serve any number of events: without keys both sides are one series, carried in ranges."""
    keys = keys or []
    rows = events.withColumn("_end", F.date_add("event_start", window_days))
    first = asof_backward(rows, rates.select(*keys, week, F.col(rate).alias("_r0")), keys, "event_start", week, ["_r0"]).drop(week)
    both = asof_backward(first, rates.select(*keys, week, F.col(rate).alias("_r1")), keys, "_end", week, ["_r1"]).drop(week)
    reach = rates.groupBy(*keys).agg(F.max(week).alias("_reach"))
    joined = both.join(reach, keys, "left") if keys else both.withColumn("_reach", reach.scalar())
    reason = (
        F.when(F.col("_reach").isNull() | (F.col("_reach") < F.col("_end")), "series_does_not_reach")
        .when(F.col("_r0").isNull(), "no_rate_at_start").when(F.col("_r1").isNull(), "no_rate_at_end").otherwise("complete")
    )
    move = F.when(reason == "complete", log_return(F.col("_r0").cast("double"), F.col("_r1").cast("double")))
    return joined.select(*events.columns, reason.alias("reason"), move.alias("log_return"))


def gate(summary: DataFrame, measured: DataFrame, p: Parameters) -> DataFrame:
    """One verdict for each query: no_current_event, insufficient_analogs, incomplete_outcomes,
    inconsistent_direction or passed, in the order of the checks. A tie of directions goes up; zero moves agree with
    neither side."""
    complete = F.col("reason") == "complete"
    per = measured.groupBy("query_id").agg(
        F.count("*").alias("_selected"), F.count_if(complete).alias("_complete"),
        F.count_if(F.col("log_return") > 0).alias("_up"), F.count_if(F.col("log_return") < 0).alias("_down"),
    )
    zero = F.lit(0).cast("long")
    j = summary.join(per, "query_id", "left")
    for c in ("_selected", "_complete", "_up", "_down"):
        j = j.withColumn(c, F.coalesce(c, zero))
    up = F.col("_up") >= F.col("_down")
    agree = F.greatest("_up", "_down")
    incomplete = F.col("_selected") > F.col("_complete")
    verdict = (
        F.when(F.col("query_start").isNull(), "no_current_event").when(F.col("_selected") == 0, "insufficient_analogs").when(incomplete, "incomplete_outcomes")
        .when(F.col("_complete") < p.min_analogs, "insufficient_analogs").when(agree / F.nullif(F.col("_complete"), zero) < p.min_consistency, "inconsistent_direction").otherwise("passed")
    )
    return j.select(
        *summary.columns, verdict.alias("verdict"), F.col("_complete").alias("n_analogs"), F.when(incomplete, zero).otherwise(agree).alias("n_consistent"),
        (F.col("_selected") - F.col("_complete")).alias("n_incomplete"), F.when(verdict == "passed", F.when(up, 1).otherwise(-1)).alias("direction"),
    )


def percent(x: Column) -> Column:
    return (F.exp(x) - 1) * 100


def estimates(verdicts: DataFrame, measured: DataFrame) -> DataFrame:
    """Median and range in percent, for passed queries only."""
    rows = measured.join(verdicts.where("verdict = 'passed'").select("query_id"), "query_id")
    return rows.groupBy("query_id").agg(percent(F.median("log_return")).alias("median_pct"), percent(F.min("log_return")).alias("low_pct"), percent(F.max("log_return")).alias("high_pct"))


def condition(queries: DataFrame, features: DataFrame, p: Parameters) -> DataFrame:
    """query_id, change, anomaly, n_years at as_of; the change needs both exact dates, each half may be NULL alone."""
    rows = features.where(F.col("feature_name") == p.condition_feature).select("site_id", "date", "value", "anomaly", "climatology_n_years")
    now = rows.select("site_id", F.col("date").alias("as_of"), F.col("value").alias("_now"), "anomaly", F.col("climatology_n_years").alias("n_years"))
    past = rows.select("site_id", F.date_add("date", p.lookback_days).alias("as_of"), F.col("value").alias("_past"))
    return queries.join(now, ["site_id", "as_of"], "left").join(past, ["site_id", "as_of"], "left").select("query_id", (F.col("_now") - F.col("_past")).alias("change"), "anomaly", "n_years")


def site_label(name: Column) -> Column:
    """'Some River at Place, ST' -> 'Place'; a name of another shape stays as it is."""
    tail = F.trim(F.get(F.split(F.substring_index(name, " at ", -1), ","), F.lit(0)))
    return F.when(tail == "", name).otherwise(tail)


def sentences(rows: DataFrame, p: Parameters, series: str = "discharge", rate: str = "spot", since: Column | None = None) -> DataFrame:
    """Adds ``sentence``: what the series does now, then the estimate or the reason there is none. The verdict decides
    the form, never the presence of numbers. Refusals that count events name the year of ``since``, where given."""
    horizon = F.lit("") if since is None else F.when(since.isNotNull(), F.concat(F.lit(" since "), F.date_format(since, "yyyy"))).otherwise("")
    amount = lambda x: F.format_number(F.abs(x), 0)
    # half to even, and the sign of what rounds to zero stays
    signed = lambda x: F.when((x < 0) & (F.bround(x, 0) == 0), "-0%").otherwise(F.format_string("%+.0f%%", F.bround(x, 0)))
    weeks, d = divmod(p.window_days, 7)
    span = (f"{weeks} week" + "s" * (weeks != 1)) if d == 0 else f"{p.window_days} day" + "s" * (p.window_days != 1)
    moved = (
        F.when(F.col("change").isNull(), F.lit(f"has no measured {p.lookback_days}-day change"))
        .otherwise(F.concat(F.when(F.col("change") < 0, "has fallen ").otherwise("has risen "), amount(F.col("change")), F.lit(f" cfs in {p.lookback_days} days")))
    )
    unusual = F.when(
        F.col("anomaly").isNotNull() & F.col("n_years").isNotNull(),
        F.concat(F.lit("and is now "), amount(F.col("anomaly")), F.lit(" cfs "), F.when(F.col("anomaly") < 0, "below").otherwise("above"), F.lit(" the "), F.col("n_years").cast("string"), F.lit("-year seasonal median")),
    ).otherwise("and has no seasonal baseline deep enough to compare against")
    now = F.concat(F.concat_ws(" ", F.col("river"), F.lit(f"{series} at"), F.col("label"), moved, unusual), F.lit("."))
    n = F.col("n_analogs").cast("string")
    told = F.concat(
        F.lit("The last "), n, F.lit(f" times {series} moved like this, the {rate} barge rate "), F.when(F.col("direction") == 1, "rose").otherwise("fell"), F.lit(", "),
        signed(F.col("low_pct")), F.lit(" to "), signed(F.col("high_pct")), F.lit(f" within {span} - median "), signed(F.col("median_pct")), F.lit(", "),
        F.col("n_consistent").cast("string"), F.lit(" of "), n, F.lit(" directionally consistent."),
    )
    why = (
        F.when(F.col("verdict") == "no_current_event", F.concat("label", F.lit(" is not in a low-water condition on "), F.date_format("as_of", "yyyy-MM-dd"), F.lit(", so there is no condition to find analogs for")))
        .when(F.col("verdict") == "incomplete_outcomes", F.concat(F.col("n_incomplete").cast("string"), F.lit(" of "), (F.col("n_analogs") + F.col("n_incomplete")).cast("string"), F.lit(" comparable events"), horizon, F.lit(" have no measurable rate move over the outcome window")))
        .when(F.col("verdict") == "insufficient_analogs", F.concat(n, F.when(F.col("n_analogs") == 1, " comparable event").otherwise(" comparable events"), horizon, F.lit(f", below the {p.min_analogs} required")))
        .otherwise(F.concat(F.col("n_consistent").cast("string"), F.lit(" of "), n, F.lit(" comparable events"), horizon, F.lit(" moved the rate in the same direction, below the threshold required")))
    )
    refused = F.concat(F.lit("Insufficient history: "), why, F.lit(". No estimate offered."))
    return rows.withColumn("sentence", F.concat_ws(" ", now, F.when(F.col("verdict") == "passed", told).otherwise(refused)))


@dataclass
class Answers:
    verdicts: DataFrame  # one row by query
    matches: DataFrame  # query_id, rank, event_start, distance, reason, log_return
    estimates: DataFrame  # passed queries only
    condition: DataFrame


def answer(queries: DataFrame, features: DataFrame, rates: DataFrame, week: str, rate: str, p: Parameters | None = None) -> Answers:
    """All queries at once; refusals are answers too."""
    p = p or Parameters()
    events, summary = query_events(queries, features, p)
    firsts = first_anomalies(features, p.features)
    # read by several later stages
    summary, vecs = stage(summary, "summary"), stage(vectors(features, firsts, p.features), "vectors")
    near = stage(nearest_events(eligible(events, summary, p.window_days), vecs, firsts, p), "nearest")
    # one rate series: an outcome depends on the date alone
    moves = outcomes(near.select("event_start").distinct(), rates, week, rate, p.window_days)
    measured = stage(near.join(moves, "event_start").select("query_id", "event_start", "distance", "rank", "reason", "log_return"), "matches")
    verdicts = stage(gate(summary, measured, p), "verdicts")
    return Answers(verdicts, measured, estimates(verdicts, measured), condition(queries, features, p))


def conclusions(a: Answers, sites: DataFrame, p: Parameters | None = None, since: Column | None = None) -> dict[str, DataFrame]:
    """Three tables by kind of verdict; only passed ones have estimate columns. ``sites``: site_id, name, river, and
    what ``since`` reads."""
    p = p or Parameters()
    named = a.verdicts.join(sites.select("site_id", "river", site_label(F.col("name")).alias("label"), *([] if since is None else [since.alias("_since")])), "site_id", "left")
    rows = sentences(named.join(a.condition, "query_id", "left").join(a.estimates, "query_id", "left"), p, since=None if since is None else F.col("_since"))
    common = ["query_id", "site_id", "as_of", "sentence", "n_raw_detections", "n_collapsed_events"]
    found = F.col("verdict")
    matches = a.matches.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "event_start", "distance"))).alias("matches"))
    return {
        "passed": rows.where(found == "passed").join(matches, "query_id", "left").select(*common, "n_analogs", "n_consistent", F.lit(p.window_days).alias("window_days"), "median_pct", "low_pct", "high_pct", "matches"),
        "refused": rows.where(~found.isin("passed", "no_current_event")).select(*common, F.col("verdict").alias("reason"), "n_analogs", F.lit(p.min_analogs).alias("required"), "n_incomplete"),
        "no_current_event": rows.where(found == "no_current_event").select(*common),
    }
