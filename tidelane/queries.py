"""The registered time-series queries over the driver's tables, each beside SQL that says the same.

Stand-ins: ``orders`` by priority are the gauges' daily series, ``lineitem`` by return flag the weekly rates, and
``events`` by type the instantaneous readings.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from datetime import date as Date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import moments, regimes, seasonal, stats, targets, thresholds
from .operators import asof, incremental, quality, reads, series
from .plans import analogs, features, health, reports, sweep
from .session import stage
from .sources import landed, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- stand-in tables ------------------------------------------------------------------------------------------


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("site_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))
    return series.daily_stats(rows, ["site_id"]).withColumn("param_code", F.lit("00060"))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.date_add(F.to_date(F.date_trunc("week", "l_shipdate")), 6)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("location"), week.alias("week_ending"))
    return rows.agg(F.avg("l_extendedprice").alias("rate"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """week_ending, rate over all locations: the one series that targets and outcomes are taken from."""
    week = F.date_add(F.to_date(F.date_trunc("week", "l_shipdate")), 6)
    return table(spark, sf_dir, "lineitem").groupBy(week.alias("week_ending")).agg(F.avg("l_extendedprice").alias("rate"))


def lows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, date, value: daily minima."""
    return daily(spark, sf_dir).select("site_id", "date", F.col("value_min").alias("value"))


def runs_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lows(spark, sf_dir)
    limits = thresholds.thresholds(rows, ["site_id"], levels=(10,)).withColumnRenamed("p10", "_p10")
    return thresholds.run_lengths(rows.join(limits, "site_id"), ["site_id"], {"run": "_p10"}).drop("_p10")


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.build_features(daily(spark, sf_dir), ["site_id"], features.registry(min_years=5, exact=False))  # sums as the SQL's, for what is printed


DAILY = """daily AS (
    SELECT o_orderpriority AS site_id, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS value_mean,
           min(o_totalprice) AS value_min, max(o_totalprice) AS value_max, count(o_totalprice) AS n_observations
    FROM orders GROUP BY 1, 2)"""
WEEKLY = """weekly AS (
    SELECT l_returnflag AS location, CAST(date_trunc('week', l_shipdate) AS DATE) + 6 AS week_ending, avg(l_extendedprice) AS rate
    FROM lineitem GROUP BY 1, 2)"""
RATES = """rates AS (
    SELECT CAST(date_trunc('week', l_shipdate) AS DATE) + 6 AS week_ending, avg(l_extendedprice) AS rate FROM lineitem GROUP BY 1)"""
LOWS = f"{DAILY}, lows AS (SELECT site_id, date, value_min AS value FROM daily)"


def _runs_sql(level: int, name: str) -> str:
    return f"""{name}_limits AS (SELECT site_id, quantile_cont(value, {level / 100}) AS limit_ FROM lows GROUP BY 1),
    {name}_1 AS (SELECT l.*, value >= limit_ AS reset, value < limit_ AS below,
                  NOT (value >= limit_) AND coalesce(date - lag(date) OVER (PARTITION BY site_id ORDER BY date) > 1, false) AS unk
           FROM lows l JOIN {name}_limits USING (site_id)),
    {name}_2 AS (SELECT *, sum(CAST(reset AS INT)) OVER (PARTITION BY site_id ORDER BY date) AS seg FROM {name}_1),
    {name} AS (SELECT site_id, date, value,
                    CAST(CASE WHEN reset THEN 0 WHEN max(CAST(unk AS INT)) OVER w = 1 THEN NULL
                         ELSE sum(CAST(below AS INT)) OVER w END AS INT) AS run
             FROM {name}_2 WINDOW w AS (PARTITION BY site_id, seg ORDER BY date))"""


RUNS = f"{LOWS}, {_runs_sql(10, 'runs')}"
FOLDED = """CAST(dayofyear(date) - CASE WHEN dayofyear(date) >= 60 AND day(last_day(make_date(CAST(year(date) AS INT), 2, 1))) = 29 THEN 1 ELSE 0 END AS INT)"""
CLIMATE = f"""{DAILY}, d AS (SELECT site_id, date, value_mean AS value, {FOLDED} AS doy FROM daily),
    medians AS (SELECT site_id, doy, median(value) AS m FROM d GROUP BY 1, 2),
    spread AS (SELECT site_id, (doy - 1 + k + 365) % 365 + 1 AS doy, m FROM medians, generate_series(-7, 7) g(k)),
    years AS (SELECT DISTINCT site_id, (doy - 1 + k + 365) % 365 + 1 AS doy, year(date) AS y FROM d, generate_series(-7, 7) g(k)),
    climate AS (SELECT * FROM (SELECT site_id, doy, avg(m) AS baseline FROM spread GROUP BY 1, 2)
                JOIN (SELECT site_id, doy, count(DISTINCT y) AS n_years FROM years GROUP BY 1, 2) USING (site_id, doy))"""


def _seasonal_sql(column: str, k: str) -> str:
    """CTE seasonal<k>: the climatology and anomalies of a daily column, from five years on."""
    body = CLIMATE.removeprefix(f"{DAILY}, ").replace("value_mean AS value", f"{column} AS value")
    for name in ("climate", "medians", "spread", "years"):
        body = re.sub(rf"\b{name}\b", f"{name}{k}", body)
    body = re.sub(r"\bd AS \(", f"d{k} AS (", re.sub(r"\bFROM d\b", f"FROM d{k}", body))
    return f"""{body}, seasonal{k} AS (SELECT site_id, date, value, CASE WHEN n_years >= 5 THEN value - baseline END AS anomaly, CAST(coalesce(n_years, 0) AS INT) AS n_years
        FROM d{k} LEFT JOIN climate{k} USING (site_id, doy))"""


FEATURES = f"""{LOWS}, {_runs_sql(5, "runs5")}, {_runs_sql(10, "runs")}, {_runs_sql(20, "runs20")}, {_seasonal_sql("value_mean", "1")}, {_seasonal_sql("value_min", "2")},
    features AS (
        SELECT 'discharge_mean' AS feature_name, site_id, date, value, anomaly, n_years FROM seasonal1
        UNION ALL SELECT 'discharge_min', site_id, date, value, anomaly, n_years FROM seasonal2
        UNION ALL SELECT 'days_below_p05', site_id, date, CAST(run AS DOUBLE), NULL, NULL FROM runs5
        UNION ALL SELECT 'days_below_p10', site_id, date, CAST(run AS DOUBLE), NULL, NULL FROM runs
        UNION ALL SELECT 'days_below_p20', site_id, date, CAST(run AS DOUBLE), NULL, NULL FROM runs20)"""


# --- daily series from two sources ----------------------------------------------------------------------------


def _two_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Readings exist on two days of three; published daily means on all."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("site_id"), "ts", F.col("value"))
    published = rows.groupBy("site_id", F.to_date("ts").alias("date")).agg(F.avg("value").alias("value")).withColumn("stat_cd", F.lit("00003"))
    return rows.where(F.day("ts") % 3 != 0), published


TWO = """e AS (SELECT event_type AS site_id, CAST(ts AS DATE) AS date, value, day(ts) % 3 <> 0 AS iv FROM events),
    iv AS (SELECT site_id, date, avg(value) AS value_mean, min(value) AS value_min, max(value) AS value_max, count(value) AS n FROM e WHERE iv GROUP BY 1, 2),
    dv AS (SELECT site_id, date, avg(value) AS v FROM e GROUP BY 1, 2)"""


@query(f"""WITH {TWO}
    SELECT site_id, date, round(value_mean, 4) AS value, 'iv' AS source FROM iv
    UNION ALL SELECT site_id, date, round(v, 4), 'dv' FROM dv WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.site_id = dv.site_id AND iv.date = dv.date)""")
def gauge_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.gauge_series(*_two_sources(spark, sf_dir), ["site_id"]), "value")


@query(f"""WITH {TWO}
    SELECT site_id, date, round(value_mean, 4) AS value_mean, value_min, value_max, CAST(n AS INTEGER) AS n_observations, 'iv' AS source FROM iv
    UNION ALL SELECT site_id, date, round(v, 4), round(v, 4), round(v, 4), 1, 'dv' FROM dv WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.site_id = dv.site_id AND iv.date = dv.date)""")
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.rollup(*_two_sources(spark, sf_dir), ["site_id"]), "value_mean", "value_min", "value_max")


# --- merges ---------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sinks.last_wins(rows, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


def _merge_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    target = rows.where("o_orderkey % 5 <> 0").withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END"))
    source = rows.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END"))
    return target, source


MERGE = """t AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0),
    s AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0)"""


@query(f"""WITH {MERGE} SELECT s.*, CASE WHEN t.o_orderkey IS NULL THEN 'insert' ELSE 'update' END AS change FROM s LEFT JOIN t USING (o_orderkey)
    WHERE t.o_orderkey IS NULL OR s.o_orderstatus IS DISTINCT FROM t.o_orderstatus OR s.o_totalprice IS DISTINCT FROM t.o_totalprice""")
def upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.changes(*_merge_sides(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query(f"WITH {MERGE} SELECT * FROM s UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)")
def upsert_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.merged(*_merge_sides(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query(f"WITH {RUNS} SELECT site_id, date, value, run FROM runs WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
def rebuild_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.window_of(runs_below(spark, sf_dir), "date", "1998-01-01", "1998-12-31")


# --- incremental windows --------------------------------------------------------------------------------------


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of the priorities found in the data, with a floor, and one site that never reported."""
    floor = F.make_date(F.lit(1995), F.lit(1), F.lit(1))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("site_id")).distinct().withColumn("floor", floor)
    return known.unionByName(spark.range(1).select(F.lit("0-SILENT").alias("site_id"), F.lit(None).cast("date").alias("floor")))


SITES = """sites AS (SELECT DISTINCT o_orderpriority AS site_id, DATE '1995-01-01' AS floor FROM orders UNION ALL SELECT '0-SILENT', CAST(NULL AS DATE))"""


@query(f"""WITH {SITES}, n AS (SELECT o_orderpriority AS site_id, max(CAST(o_orderdate AS DATE)) AS newest FROM orders GROUP BY 1)
    SELECT site_id, newest, CAST(coalesce(newest - 7, DATE '2002-01-01' - 30) AS DATE) AS start FROM sites LEFT JOIN n USING (site_id)""")
def poll_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = incremental.resume_points(_sites(spark, sf_dir), daily(spark, sf_dir), "site_id", "date")
    return incremental.poll_starts(points, F.lit(Date(2002, 1, 1)), "7 DAYS", "30 DAYS").select("site_id", "newest", F.col("start").cast("date").alias("start"))


@query(f"""WITH {SITES}, reg AS (SELECT * FROM sites UNION ALL SELECT '9-NEW', DATE '1996-06-01'), n AS (SELECT o_orderpriority AS site_id, max(CAST(o_orderdate AS DATE)) AS newest FROM orders GROUP BY 1)
    SELECT site_id, newest, coalesce(newest, floor) AS start, CASE WHEN coalesce(newest, floor) IS NULL THEN 'refused' WHEN newest IS NOT NULL THEN 'resume' ELSE 'from_floor' END AS status
    FROM reg LEFT JOIN n USING (site_id)""")
def backfill_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with data, a registered one without any, and one without data or floor."""
    new = spark.range(1).select(F.lit("9-NEW").alias("site_id"), F.make_date(F.lit(1996), F.lit(6), F.lit(1)).alias("floor"))
    points = incremental.resume_points(_sites(spark, sf_dir).unionByName(new), daily(spark, sf_dir), "site_id", "date")
    return incremental.backfill_starts(points, "floor").select("site_id", "newest", "start", "status")


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = daily(spark, sf_dir).groupBy("site_id").agg(F.date_sub(F.min("date"), 400).alias("a"), F.max("date").alias("b"))
    return incremental.tiles(spans, "site_id", "a", "b", 180, half_open=False)


TILES = f"""{DAILY}, spans AS (SELECT site_id, min(date) - 400 AS a, max(date) AS b FROM daily GROUP BY 1),
    tiles AS (SELECT site_id, CAST(a + 180 * CAST(k AS INT) AS DATE) AS w_start, CAST(least(a + 180 * CAST(k AS INT) + 179, b) AS DATE) AS w_end FROM spans, generate_series(0, 200) g(k) WHERE a + 180 * CAST(k AS INT) <= b),
    cover AS (SELECT t.site_id, w_start, w_end, count(d.date) AS n_readings, min(d.date) AS first_date FROM tiles t LEFT JOIN daily d ON d.site_id = t.site_id AND d.date BETWEEN w_start AND w_end GROUP BY 1, 2, 3)"""


@query(f"WITH {TILES} SELECT * FROM tiles")
def backfill_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir)


@query(f"WITH {TILES} SELECT * FROM cover")
def window_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.window_coverage(_tiles(spark, sf_dir), daily(spark, sf_dir), "site_id", "date", 180).select("site_id", "w_start", "w_end", "n_readings", "first_date")


INSTANTS = """spans AS (SELECT event_type AS site_id, date_trunc('day', min(ts)) - INTERVAL 5 DAYS AS a, max(ts) AS b FROM events GROUP BY 1),
    tiles AS (SELECT site_id, a + INTERVAL 2 DAYS * CAST(k AS INT) AS w_start, least(a + INTERVAL 2 DAYS * (CAST(k AS INT) + 1), b) AS w_end FROM spans, generate_series(0, 400) g(k) WHERE a + INTERVAL 2 DAYS * CAST(k AS INT) < b)"""


@query(f"""WITH {INSTANTS} SELECT t.site_id, w_start, w_end, count(e.ts) AS n_readings, min(e.ts) AS first_ts FROM tiles t
    LEFT JOIN events e ON e.event_type = t.site_id AND e.ts >= w_start AND e.ts < w_end GROUP BY 1, 2, 3""")
def instant_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings in half-open windows of instants; a reading at the very end of a range is in none."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("site_id"), F.col("ts").cast("timestamp").alias("ts"))
    spans = rows.groupBy("site_id").agg((F.date_trunc("day", F.min("ts")) - F.expr("INTERVAL 5 DAYS")).alias("a"), F.max("ts").alias("b"))
    cover = incremental.window_coverage(incremental.tiles(spans, "site_id", "a", "b", 2, half_open=True), rows, "site_id", "ts", 2, half_open=True)
    return cover.select("site_id", "w_start", "w_end", "n_readings", F.col("first_date").alias("first_ts"))


WALKS = f"""{DAILY}, starts AS (SELECT site_id, coalesce(max(date) FILTER (WHERE site_id IN ('1-URGENT', '3-MEDIUM') AND year(date) < 1996), DATE '1993-01-01') AS a, NOT coalesce(bool_or(site_id IN ('1-URGENT', '3-MEDIUM') AND year(date) < 1996), false) AS seed, max(date) AS b FROM daily GROUP BY 1),
    walk AS (SELECT site_id, seed, CAST(a + 180 * CAST(k AS INT) AS DATE) AS w_start, CAST(least(a + 180 * CAST(k AS INT) + 179, b) AS DATE) AS w_end FROM starts, generate_series(0, 200) g(k) WHERE a + 180 * CAST(k AS INT) <= b),
    walked AS (SELECT w.site_id, w.seed, w_start, count(d.date) AS n_readings, min(d.date) AS first_date FROM walk w LEFT JOIN daily d ON d.site_id = w.site_id AND d.date BETWEEN w_start AND w_end GROUP BY 1, 2, 3)"""


@query(f"""WITH {WALKS} SELECT site_id, count(*) AS n_windows, count(*) FILTER (WHERE n_readings = 0) AS n_empty, CAST(sum(n_readings) AS BIGINT) AS n_readings, min(first_date) AS first_date, seed AS walked_from_seed,
    CASE WHEN seed THEN min(first_date) END AS record_start FROM walked GROUP BY site_id, seed""")
def site_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sites resume from what is stored of their first years; the others walk from a floor before their record."""
    days = daily(spark, sf_dir)
    stored = days.where(F.col("site_id").isin("1-URGENT", "3-MEDIUM") & (F.year("date") < 1996))
    registry = days.select("site_id").distinct().withColumn("floor", F.make_date(F.lit(1993), F.lit(1), F.lit(1)))
    starts = incremental.backfill_starts(incremental.resume_points(registry, stored, "site_id", "date"), "floor")
    spans = starts.join(days.groupBy("site_id").agg(F.max("date").alias("b")), "site_id").select("site_id", F.col("start").alias("a"), "b")
    cover = incremental.window_coverage(incremental.tiles(spans, "site_id", "a", "b", 180, half_open=False), days, "site_id", "date", 180)
    return incremental.site_results(cover, starts, "site_id")


@query(f"""WITH {TILES}, gaps AS (SELECT site_id, min(date) - 400 AS gap_start, min(date) - 150 AS gap_end, 'before the record' AS note FROM daily GROUP BY 1)
    SELECT c.site_id, w_start, w_end, note, note IS NOT NULL AS explained FROM cover c
    LEFT JOIN gaps g ON g.site_id = c.site_id AND gap_start <= w_start AND w_end <= gap_end WHERE n_readings = 0""")
def explain_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = incremental.window_coverage(_tiles(spark, sf_dir), daily(spark, sf_dir), "site_id", "date", 180)
    gaps = daily(spark, sf_dir).groupBy("site_id").agg(F.date_sub(F.min("date"), 400).alias("gap_start"), F.date_sub(F.min("date"), 150).alias("gap_end"))
    gaps = gaps.withColumns({"source": F.lit("dv"), "note": F.lit("before the record")})
    return incremental.explain_empty(cover, gaps, "site_id", "dv").select("site_id", "w_start", "w_end", "note", "explained")


@query(f"""WITH {WEEKLY}, reg AS (SELECT l_returnflag AS location, CAST(count(*) AS BIGINT) AS seeded FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
    SELECT location, seeded, coalesce(n, 0) AS received, a AS first_period, b AS last_period, coalesce(coalesce(n, 0) < seeded, false) AS truncated, n_null, 100.0 * n_null / n AS pct_null
    FROM reg LEFT JOIN (SELECT location, count(*) AS n, min(week_ending) AS a, max(week_ending) AS b, count(*) FILTER (WHERE rate IS NULL) AS n_null FROM weekly GROUP BY 1) USING (location)""")
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_returnflag").alias("location")).agg(F.count("*").alias("seeded"))
    return reports.load_report(reg, weekly(spark, sf_dir), "location", "week_ending", "seeded", "rate")


# --- as-of, offsets and targets -------------------------------------------------------------------------------


def _site_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week every seven days from four weeks before each site's record to four weeks after it."""
    spans = daily(spark, sf_dir).groupBy("site_id").agg(F.date_sub(F.min("date"), 28).alias("a"), F.date_add(F.max("date"), 28).alias("b"))
    return spans.select("site_id", F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias("week_ending"))


def _weeks_and_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _site_weeks(spark, sf_dir), daily(spark, sf_dir).select("site_id", "date", "value_min")


SITE_WEEKS = """site_weeks AS (SELECT site_id, CAST(a + 7 * CAST(k AS INT) AS DATE) AS week_ending
    FROM (SELECT site_id, min(date) - 28 AS a, max(date) + 28 AS b FROM daily GROUP BY 1), generate_series(0, 2000) g(k) WHERE a + 7 * CAST(k AS INT) <= b)"""
ASOF = f"""{DAILY}, {SITE_WEEKS}, days AS (SELECT site_id, date, value_min FROM daily), weeks AS (SELECT * FROM site_weeks)"""


@query(f"WITH {ASOF} SELECT w.site_id, w.week_ending, d.date, d.value_min FROM weeks w ASOF LEFT JOIN days d ON w.site_id = d.site_id AND w.week_ending >= d.date")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks, days = _weeks_and_days(spark, sf_dir)
    return asof.asof_backward(weeks, days, ["site_id"], "week_ending", "date", ["value_min"])


@query(ORACLE_SQL["asof_backward"])
def asof_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join for series that are known to be short (some years of days), each carried by one task."""
    weeks, days = _weeks_and_days(spark, sf_dir)
    return asof.asof_backward(weeks, days, ["site_id"], "week_ending", "date", ["value_min"], long_series=False)


@query(f"""WITH {ASOF}, lagged AS (SELECT site_id, week_ending, CAST(k AS INT) AS lag_days, CAST(week_ending - CAST(k AS INT) AS DATE) AS anchor FROM weeks, generate_series(-21, 21, 7) g(k))
    SELECT l.site_id, l.week_ending, l.lag_days, d.date, d.value_min FROM lagged l ASOF JOIN days d ON l.site_id = d.site_id AND l.anchor >= d.date""")
def asof_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks, days = _weeks_and_days(spark, sf_dir)
    lags = list(range(-21, 22, 7))
    return asof.asof_lagged(weeks, days, ["site_id"], "week_ending", "date", "value_min", lags)


RETURNS = """returns AS (SELECT a.location, a.week_ending, CAST(h AS INT) AS horizon_days, CASE WHEN a.rate > 0 AND b.rate > 0 THEN ln(b.rate / a.rate) END AS value
    FROM weekly a CROSS JOIN (VALUES (7), (14), (21)) x(h) LEFT JOIN weekly b ON b.location = a.location AND b.week_ending = a.week_ending + h)"""


@query(f"WITH {WEEKLY}, {RETURNS} SELECT location, week_ending, horizon_days, round(value, 8) AS value FROM returns")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(targets.forward_returns(weekly(spark, sf_dir), ["location"], "week_ending", "rate"), "value", digits=8)


@query(f"WITH {WEEKLY}, {RETURNS} SELECT location, horizon_days, count(value) AS n_weeks FROM returns GROUP BY 1, 2")
def resolvable_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.resolvable_weeks(weekly(spark, sf_dir), ["location"], "week_ending", "rate")


@query(f"""WITH {DAILY}, {SITE_WEEKS} SELECT w.site_id, w.week_ending, round_even(CAST(sum(CAST(d.value_mean AS DECIMAL(28, 6))) AS DOUBLE) / count(d.value_mean), 0) AS trailing_mean
    FROM site_weeks w LEFT JOIN daily d ON d.site_id = w.site_id AND d.date BETWEEN w.week_ending - 6 AND w.week_ending GROUP BY 1, 2""")
def weekly_trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.trailing_mean(_site_weeks(spark, sf_dir), daily(spark, sf_dir), ["site_id"], "week_ending", "date", "value_mean")


def _whole_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, value: daily means over all sites."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("value"))


WHOLE = "whole AS (SELECT 'all' AS site_id, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS value_mean, min(o_totalprice) AS value_min FROM orders GROUP BY 2)"


@query(f"""WITH {WHOLE}, {RATES} SELECT w.week_ending, round(w.rate, 4) AS pct_of_tariff, round_even(CAST(sum(CAST(d.value_mean AS DECIMAL(28, 6))) AS DOUBLE) / count(d.value_mean), 0) AS discharge
    FROM rates w LEFT JOIN whole d ON d.date BETWEEN w.week_ending - 6 AND w.week_ending
    WHERE w.week_ending BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY w.week_ending, w.rate""")
def weekly_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = rates(spark, sf_dir).withColumnRenamed("rate", "pct_of_tariff")
    return rounded(reports.weekly_extract(weeks, _whole_days(spark, sf_dir), Date(1998, 1, 1), Date(1998, 12, 31), "value", "discharge"), "pct_of_tariff")


EXTRACTS = f"""{WHOLE}, {RATES}, {_seasonal_sql("value_mean", "1").replace("FROM daily", "FROM whole")},
    days AS (SELECT 'raw' AS kind, date, value FROM seasonal1 UNION ALL SELECT 'deseasonalized', date, anomaly FROM seasonal1)"""


@query(f"""WITH {EXTRACTS} SELECT CAST(year(w.week_ending) AS VARCHAR) || '_' || k.kind || '.csv' AS file, w.week_ending, round(w.rate, 4) AS pct_of_tariff, round_even(CAST(sum(CAST(d.value AS DECIMAL(28, 6))) AS DOUBLE) / count(d.value), 0) AS value
    FROM rates w CROSS JOIN (VALUES ('raw'), ('deseasonalized')) k(kind) LEFT JOIN days d ON d.kind = k.kind AND d.date BETWEEN w.week_ending - 6 AND w.week_ending
    WHERE year(w.week_ending) IN (1997, 1998) GROUP BY k.kind, w.week_ending, w.rate""")
def weekly_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four extract files as one table: raw and deseasonalized, of two years."""
    weeks = rates(spark, sf_dir).withColumnRenamed("rate", "pct_of_tariff")
    days = _whole_days(spark, sf_dir)
    files = reports.extracts(weeks, days, seasonal.anomalies(days, [], min_years=5), (1997, 1998))
    parts = [df.select(F.lit(name).alias("file"), "week_ending", F.round("pct_of_tariff", 4).alias("pct_of_tariff"), F.col(df.columns[-1]).alias("value")) for name, df in files.items()]
    return sinks.union_all(parts)


@query(f"""WITH {LOWS} SELECT a.site_id, a.date, a.value, round(a.value - b.value, 4) AS change FROM lows a LEFT JOIN lows b ON b.site_id = a.site_id AND b.date = a.date - 14""")
def change_over_14_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.change_over(lows(spark, sf_dir), ["site_id"], "date", "value", 14), "change")


# --- features -------------------------------------------------------------------------------------------------


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).select("site_id", "date", F.col("value_mean").alias("value"))


@query(f"WITH {CLIMATE} SELECT site_id, CAST(doy AS INTEGER) AS doy, round(baseline, 6) AS baseline, CAST(n_years AS INTEGER) AS n_years FROM climate")
def climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seasonal.climatology(_means(spark, sf_dir), ["site_id"]), "baseline", digits=6)


def _anomaly_sql(years: int) -> str:
    return f"""WITH {CLIMATE} SELECT site_id, date, round(value, 6) AS value, round(CASE WHEN n_years >= {years} THEN value - baseline END, 6) AS anomaly,
        CAST(coalesce(n_years, 0) AS INTEGER) AS climatology_n_years FROM d LEFT JOIN climate USING (site_id, doy)"""


@query(_anomaly_sql(5))
def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seasonal.anomalies(_means(spark, sf_dir), ["site_id"], min_years=5), "value", "anomaly", digits=6)


@query(_anomaly_sql(8))
def anomaly_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven calendar years are below the default of eight: every anomaly is NULL and keeps its year count."""
    return rounded(seasonal.anomalies(_means(spark, sf_dir), ["site_id"]), "value", "anomaly", digits=6)


@query(f"WITH {LOWS} SELECT site_id, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 4) AS p{p:02d}" for p in (5, 10, 20)) + " FROM lows GROUP BY 1")
def percentile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(thresholds.thresholds(lows(spark, sf_dir), ["site_id"]), "p05", "p10", "p20")


@query(f"WITH {RUNS} SELECT site_id, date, value, run FROM runs")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_below(spark, sf_dir)


@query(f"WITH {FEATURES} SELECT site_id, feature_name, count(*) AS n, count(value) AS n_value, count(anomaly) AS n_anomaly, round(sum(value), 2) AS total FROM features GROUP BY 1, 2")
def feature_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registered features, summed up by series."""
    rows = feature_table(spark, sf_dir)
    return rows.groupBy("site_id", "feature_name").agg(F.count("*").alias("n"), F.count("value").alias("n_value"), F.count("anomaly").alias("n_anomaly"), F.round(F.sum("value"), 2).alias("total"))


@query(f"WITH {FEATURES} SELECT site_id, date, feature_name, round(value, 6) AS value, round(anomaly, 6) AS anomaly, n_years AS climatology_n_years FROM features")
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole long feature table."""
    return rounded(feature_table(spark, sf_dir), "value", "anomaly", digits=6)


REGIME = f"""{RUNS}, reg AS (SELECT site_id, date, run AS value, CASE WHEN date - lag(date) OVER w <= 1 THEN CASE WHEN run > lag(run) OVER w THEN 'onset' WHEN run < lag(run) OVER w THEN 'recovery' END END AS regime
    FROM runs WINDOW w AS (PARTITION BY site_id ORDER BY date))"""


def _run_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_below(spark, sf_dir).select("site_id", "date", F.col("run").alias("value"))


@query(f"WITH {REGIME} SELECT * FROM reg")
def regime_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.direction(_run_values(spark, sf_dir), ["site_id"])


@query(f"WITH {REGIME} SELECT site_id, date, regime FROM reg WHERE regime IS NOT NULL UNION ALL SELECT site_id, date, 'all' FROM reg WHERE value IS NOT NULL")
def regime_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.members(_run_values(spark, sf_dir), ["site_id"])


# --- sweep ----------------------------------------------------------------------------------------------------


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.forward_returns(rates(spark, sf_dir), [], "week_ending", "rate")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of every feature of every site against forward returns, at every lag and in every regime."""
    rows = stage(feature_table(spark, sf_dir), "features")
    return sweep.pair_moments(sweep.chosen_series(rows, sweep.series_columns(rows)), _targets(spark, sf_dir), sweep.lag_axis())


ALIGNED = f"""{FEATURES}, {RATES}, y AS (SELECT a.week_ending AS week, CAST(h AS INT) AS horizon_days, CASE WHEN a.rate > 0 AND b.rate > 0 THEN ln(b.rate / a.rate) END AS y
        FROM rates a CROSS JOIN (VALUES (7), (14), (21)) x(h) JOIN rates b ON b.week_ending = a.week_ending + h),
    columns AS (SELECT feature_name, site_id, bool_or(anomaly IS NOT NULL) AS anom FROM features GROUP BY 1, 2),
    chosen AS (SELECT feature_name, site_id, date, CASE WHEN anom THEN anomaly ELSE value END AS x FROM features JOIN columns USING (feature_name, site_id)),
    reg AS (SELECT *, CASE WHEN date - lag(date) OVER w <= 1 THEN CASE WHEN x > lag(x) OVER w THEN 'onset' WHEN x < lag(x) OVER w THEN 'recovery' END END AS regime FROM chosen WINDOW w AS (PARTITION BY feature_name, site_id ORDER BY date)),
    known AS (SELECT * FROM reg WHERE x IS NOT NULL),
    lagged AS (SELECT feature_name, site_id, week, CAST(k AS INT) AS lag_days, CAST(week - CAST(k AS INT) AS DATE) AS anchor FROM (SELECT DISTINCT feature_name, site_id FROM known), (SELECT DISTINCT week FROM y WHERE y IS NOT NULL), generate_series(-21, 21) g(k)),
    matched AS (SELECT l.feature_name, l.site_id, l.week, l.lag_days, d.x, d.regime FROM lagged l ASOF JOIN known d ON l.site_id = d.site_id AND l.feature_name = d.feature_name AND l.anchor >= d.date),
    members AS (SELECT feature_name, site_id, week, lag_days, x, 'all' AS regime FROM matched UNION ALL SELECT feature_name, site_id, week, lag_days, x, regime FROM matched WHERE regime IS NOT NULL),
    aligned AS (SELECT feature_name, site_id, horizon_days, lag_days, regime, week, x, y FROM members JOIN y USING (week) WHERE y IS NOT NULL)"""
CORR = "CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END"


@query(f"""WITH {ALIGNED} SELECT feature_name, site_id, horizon_days, lag_days, regime, count(*) AS n, round({CORR}, 7) AS r, round(count(*) / greatest(1.0, horizon_days / 7.0), 6) AS n_effective FROM aligned GROUP BY 1, 2, 3, 4, 5""")
def correlation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moments.merged(F.transform("blocks", lambda b: b["m"]))
    out = _pairs(spark, sf_dir).select(*sweep.PAIR, m.alias("m")).select(*sweep.PAIR, F.col("m.n").alias("n"), F.round(moments.correlation(F.col("m")), 7).alias("r"))
    return out.withColumn("n_effective", F.round(stats.effective_n(F.col("n"), F.col("horizon_days")), 6))


FOLD = """fw AS (SELECT DISTINCT location, horizon_days, week_ending AS week FROM returns WHERE value IS NOT NULL),
    f1 AS (SELECT *, (SELECT count(*) FROM fw b WHERE b.location = a.location AND b.horizon_days = a.horizon_days AND b.week < a.week - a.horizon_days) AS train,
                  row_number() OVER (PARTITION BY location, horizon_days ORDER BY week) - 1 AS ord, count(*) OVER (PARTITION BY location, horizon_days) AS n FROM fw a),
    f2 AS (SELECT *, min(ord) FILTER (WHERE train >= 26) OVER (PARTITION BY location, horizon_days) AS first FROM f1),
    blocks AS (SELECT location, horizon_days, week, CAST(least((ord - first) // ((n - first) // 5), 4) AS INT) AS fold FROM f2 WHERE ord >= first AND n - first >= 5)"""


def _fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.forward_returns(weekly(spark, sf_dir), ["location"], "week_ending", "rate").where("value IS NOT NULL").withColumnRenamed("week_ending", "week")


@query(f"""WITH {WEEKLY}, {RETURNS}, {FOLD}, t AS (SELECT location, horizon_days, fold, min(week) AS test_start, max(week) AS test_end, count(*) AS n_test FROM blocks GROUP BY 1, 2, 3)
    SELECT t.location, t.horizon_days, fold, test_start, test_end, n_test, min(w.week) AS train_start, max(w.week) AS train_end, count(*) AS n_train
    FROM t JOIN fw w ON w.location = t.location AND w.horizon_days = t.horizon_days AND w.week < test_start - t.horizon_days GROUP BY ALL""")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.folds(_fold_rows(spark, sf_dir), ["location", "horizon_days"], "week", "horizon_days", (7, 14, 21))


@query(f"""WITH {WEEKLY}, {RETURNS}, {FOLD}, t AS (SELECT location, horizon_days, fold, min(week) AS test_start FROM blocks GROUP BY 1, 2, 3),
    e AS (SELECT t.*, (SELECT max(w.week) FROM fw w WHERE w.location = t.location AND w.horizon_days = t.horizon_days AND w.week < test_start - t.horizon_days) AS train_end FROM t)
    SELECT location, horizon_days, count(*) AS n_folds, count(*) FILTER (WHERE train_end + horizon_days >= test_start) AS n_leaking, min(CAST(test_start - train_end AS INT)) AS least_gap FROM e GROUP BY 1, 2""")
def fold_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds, those whose training reaches into their test block, and the least gap between the two."""
    folds = walk_forward_folds(spark, sf_dir)
    bad = sweep.leaking(folds, F.col("horizon_days")).groupBy("location", "horizon_days").agg(F.count("*").alias("n_leaking"))
    every = folds.groupBy("location", "horizon_days").agg(F.count("*").alias("n_folds"), F.min(F.datediff("test_start", "train_end")).alias("least_gap"))
    return every.join(bad, ["location", "horizon_days"], "left").withColumn("n_leaking", F.coalesce("n_leaking", F.lit(0).cast("long")))


BH = """p AS (SELECT o_orderpriority AS run, o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN floor(o_totalprice % 997) * floor(o_totalprice % 997) / 999983 END AS p FROM orders),
    r AS (SELECT *, count(p) OVER (PARTITION BY run ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank, count(p) OVER (PARTITION BY run) AS m FROM p WHERE p IS NOT NULL),
    q AS (SELECT run, o_orderkey, least(1.0, min(p * m / rank) OVER (PARTITION BY run ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q, m FROM r)"""


def _supplied_p(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Orders as tests of five runs, with p-values made of their prices, unknown for one in four."""
    part = F.floor(F.col("o_totalprice") % 997)
    p = F.when(F.col("o_orderkey") % 4 != 0, part * part / F.lit(999983))
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), "o_orderkey", p.alias("p"), *more)


@query(f"WITH {BH} SELECT p.run, p.o_orderkey, round(q, 8) AS q_value, m AS n_tests_adjusted FROM p LEFT JOIN q USING (run, o_orderkey)")
def bh_qvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _supplied_p(spark, sf_dir)
    return stats.benjamini_hochberg(rows, ["run"], "p").select("run", "o_orderkey", F.round("q_value", 8).alias("q_value"), "n_tests_adjusted")


# --- run logs on supplied p-values: SQL has no t distribution, so these take p from the data -------------------

SIGNALS = f"""{BH}, signals AS (
    SELECT CAST(substr(o.o_orderpriority, 1, 1) AS BIGINT) AS run_id, 'days_' || lower(o_orderstatus) AS feature_name, 'c' || CAST(o_custkey % 7 AS VARCHAR) AS site_id, o.o_orderkey AS cell, CAST(o.o_orderkey % 43 - 21 AS INT) AS lag_days,
           CASE o.o_orderkey % 3 WHEN 0 THEN 'onset' WHEN 1 THEN 'recovery' ELSE 'all' END AS regime, p.p AS p_value, q.q AS q_value,
           CASE WHEN p.p IS NULL THEN 'insufficient_observations' WHEN o.o_orderkey % 5 = 0 THEN 'insufficient_folds' ELSE 'scanned' END AS status,
           coalesce(q.q <= 0.05 AND o.o_orderkey % 5 <> 0 AND o_custkey % 10 >= 4, false) AS passes_gate
    FROM orders o JOIN p USING (o_orderkey) LEFT JOIN q USING (o_orderkey))"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.benjamini_hochberg(_supplied_p(spark, sf_dir, "o_orderstatus", "o_custkey"), ["run"], "p")
    key, folds = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 5 != 0, 5).otherwise(0)
    return rows.select(
        F.substring("run", 1, 1).cast("long").alias("run_id"), F.concat(F.lit("days_"), F.lower("o_orderstatus")).alias("feature_name"), F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("site_id"),
        key.alias("cell"), (key % 43 - 21).cast("int").alias("lag_days"), F.when(key % 3 == 0, "onset").when(key % 3 == 1, "recovery").otherwise("all").alias("regime"), F.col("p").alias("p_value"), "q_value",
        F.when(F.col("p").isNull(), "insufficient_observations").when(folds == 0, "insufficient_folds").otherwise("scanned").alias("status"),
        stats.passes_gate(F.col("q_value"), F.when(F.col("o_custkey") % 10 >= 4, 0.8).otherwise(0.5), folds).alias("passes_gate"),
    )


@query(f"""WITH {SIGNALS} SELECT r.run_id, count(s.cell) AS n_rows, count(*) FILTER (WHERE passes_gate) AS n_passing, count(*) FILTER (WHERE status = 'scanned') AS n_scanned,
    count(p_value) AS n_tested, count(*) FILTER (WHERE passes_gate AND lag_days < 0) AS n_passing_negative_lag FROM (VALUES (1), (2), (3), (4), (5), (6)) r(run_id) LEFT JOIN signals s USING (run_id) GROUP BY 1""")
def logged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome counts of five logged runs and of one without rows."""
    return sweep.run_summary(spark.range(1, 7).select(F.col("id").alias("run_id")), _signals(spark, sf_dir))


@query(f"""WITH {SIGNALS}, k AS (SELECT *, bool_or(passes_gate) OVER (PARTITION BY run_id) AS any_ FROM signals WHERE q_value IS NOT NULL),
    t AS (SELECT run_id, cell, round(q_value, 8) AS q_value, row_number() OVER (PARTITION BY run_id ORDER BY q_value, cell) AS rank FROM k WHERE passes_gate OR NOT any_) SELECT run_id, cell, q_value, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 10""")
def logged_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.best_rows(_signals(spark, sf_dir), "run_id", "q_value", ["cell"], 10).select("run_id", "cell", F.round("q_value", 8).alias("q_value"), "rank")


@query(f"""WITH {SIGNALS}, f AS (SELECT * FROM signals WHERE feature_name = 'days_f'), l AS (SELECT site_id, max(run_id) AS run_id FROM f GROUP BY 1)
    SELECT site_id, run_id, round(min(q_value), 8) AS q_value FROM f JOIN l USING (site_id, run_id) GROUP BY 1, 2""")
def logged_strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sweep.strongest_signal(_signals(spark, sf_dir), "days_f"), "q_value", digits=8)


@query(f"""WITH {SIGNALS} SELECT run_id, feature_name, site_id, cell, round(q_value, 8) AS q_value FROM signals WHERE run_id = 2 AND feature_name SIMILAR TO 'days_[fo]' AND passes_gate
    ORDER BY signals.q_value NULLS LAST, cell LIMIT 200 OFFSET 3""")
def logged_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of one run's passing rows for a pattern of features, smallest q first."""
    rows = _signals(spark, sf_dir)
    page = reports.read_signals(rows, 2, passing_only=True, feature="days_[fo]", limit=200, offset=3, order=("cell",))
    return page.select("run_id", "feature_name", "site_id", "cell", F.round("q_value", 8).alias("q_value"))


@query(f"""WITH {SIGNALS} SELECT run_id, regime, count(*) FILTER (WHERE passes_gate AND lag_days < 0) AS n_negative, count(*) FILTER (WHERE passes_gate AND lag_days > 0) AS n_positive FROM signals GROUP BY 1, 2""")
def logged_lag_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.lag_signs(_signals(spark, sf_dir))


@query(f"WITH {SIGNALS} SELECT run_id, status, count(*) AS n FROM signals GROUP BY 1, 2")
def logged_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.tallies(_signals(spark, sf_dir), "status", ["run_id"])


def _grid_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Five features at each site and one site without rows."""
    return _sites(spark, sf_dir), stage(feature_table(spark, sf_dir), "features")  # columns, regimes and as-of matches read it


@query(f"""WITH {SITES}, n(feature_name) AS (VALUES ('discharge_mean'), ('discharge_min'), ('days_below_p05'), ('days_below_p10'), ('days_below_p20'))
    SELECT site_id, feature_name, CAST(h AS INTEGER) AS horizon_days, regime, CAST(k AS INTEGER) AS lag_days,
           CASE WHEN feature_name LIKE 'discharge%' AND site_id <> '0-SILENT' THEN 'anomaly' ELSE 'value' END AS series_column
    FROM sites, n, (VALUES (7), (14), (21)) a(h), (VALUES ('onset'), ('recovery'), ('all')) b(regime), generate_series(-21, 21) g(k)""")
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, rows = _grid_parts(spark, sf_dir)
    names = [f.name for f in features.registry()]
    grid = sweep.build_grid(sites, names, sweep.series_columns(rows), sweep.lag_axis())
    return grid.select("site_id", "feature_name", "horizon_days", "regime", "lag_days", "series_column")


@query("""WITH days AS (SELECT CAST(o_custkey AS VARCHAR) AS site_id, CAST(o_orderdate AS DATE) AS date, count(o_totalprice) AS n FROM orders GROUP BY 1, 2), single AS (SELECT site_id FROM days GROUP BY 1 HAVING bool_and(n = 1))
    SELECT site_id, 'discharge_min' AS feature_name, 'discharge_mean' AS kept, 'one series with discharge_mean: every day has a single observation' AS reason FROM single""")
def single_observation_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sites: those that never order twice a day have one series, not three."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("site_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))
    days = series.daily_stats(rows, ["site_id"]).withColumn("param_code", F.lit("00060"))
    return sweep.skips(spark, sweep.single_observation(days, ["site_id", "param_code"]), features.registry())


def _swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, rows = _grid_parts(spark, sf_dir)
    names = [f.name for f in features.registry()]
    out = sweep.sweep(rows, _targets(spark, sf_dir), sites, names, sweep.lag_axis(), run_id=1)
    for column, digits in (("statistic", 7), ("p_value", 8), ("q_value", 8), ("n_effective", 6), ("directional_consistency", 8)):
        out = rounded(out, column, digits=digits)
    return out


FOLDS_OF_PAIRS = """a AS (SELECT DISTINCT feature_name, site_id, horizon_days, lag_days, regime, week FROM aligned),
    a1 AS (SELECT *, row_number() OVER p - 1 AS ord, count(*) OVER (PARTITION BY feature_name, site_id, horizon_days, lag_days, regime) AS n,
                  CASE horizon_days WHEN 7 THEN count(*) OVER (p RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 8 DAY PRECEDING)
                       WHEN 14 THEN count(*) OVER (p RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 15 DAY PRECEDING)
                       ELSE count(*) OVER (p RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 22 DAY PRECEDING) END AS train
           FROM a WINDOW p AS (PARTITION BY feature_name, site_id, horizon_days, lag_days, regime ORDER BY week)),
    a2 AS (SELECT *, min(ord) FILTER (WHERE train >= 26) OVER (PARTITION BY feature_name, site_id, horizon_days, lag_days, regime) AS first FROM a1),
    ab AS (SELECT feature_name, site_id, horizon_days, lag_days, regime, week, least((ord - first) // ((n - first) // 5), 4) AS fold FROM a2 WHERE ord >= first AND n - first >= 5)"""


#: p of a correlation r with ne effective observations: I_x(a, 1/2) with a = (ne - 2) / 2 and x = 1 - r * r, by the
#: continued fraction on the side where it converges.
P_VALUE = """(SELECT CASE WHEN r IS NULL OR ne <= 2 THEN NULL WHEN abs(r) >= 1 THEN 0.0 WHEN r = 0 THEN 1.0 WHEN swap THEN 1 - v ELSE v END FROM (
        SELECT swap, exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(z) + q * ln(w)) / p
            / list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(400, 0, -1), lambda m: m::DOUBLE)), lambda f, m:
                1 - (p + m - 1) * (p + q + m - 1) * z / ((p + 2 * m - 2) * (p + 2 * m - 1)) / (1 + m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)) / f)) AS v
        FROM (SELECT swap, CASE WHEN swap THEN 0.5 ELSE a END AS p, CASE WHEN swap THEN a ELSE 0.5 END AS q, CASE WHEN swap THEN r * r ELSE x END AS z, CASE WHEN swap THEN x ELSE r * r END AS w
              FROM (SELECT (ne - 2) / 2 AS a, (1 - r) * (1 + r) AS x, (1 - r) * (1 + r) > ((ne - 2) / 2 + 1) / ((ne - 2) / 2 + 2.5) AS swap))))"""
SWEPT = f"""{ALIGNED}, {FOLDS_OF_PAIRS},
    full_r AS (SELECT feature_name, site_id, horizon_days, lag_days, regime, {CORR} AS r, count(*) AS n, count(*) / greatest(1.0, horizon_days / 7.0) AS ne FROM aligned GROUP BY 1, 2, 3, 4, 5),
    fold_r AS (SELECT feature_name, site_id, horizon_days, lag_days, regime, fold, {CORR} AS fr FROM aligned JOIN ab USING (feature_name, site_id, horizon_days, lag_days, regime, week) GROUP BY 1, 2, 3, 4, 5, 6),
    measured AS (SELECT feature_name, site_id, horizon_days, lag_days, regime, n, CASE WHEN ne > 2 THEN r END AS r, CASE WHEN r IS NOT NULL AND ne > 2 THEN ne END AS ne FROM full_r),
    tested AS (SELECT feature_name, site_id, horizon_days, lag_days, regime, count(*) AS n_folds, count(fr) AS n_known, count(*) FILTER (WHERE sign(fr) = sign(r)) AS n_agree
        FROM measured JOIN fold_r USING (feature_name, site_id, horizon_days, lag_days, regime) GROUP BY 1, 2, 3, 4, 5),
    with_p AS (SELECT *, {P_VALUE} AS p FROM measured),
    ranked AS (SELECT *, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank, count(*) OVER () AS m FROM with_p WHERE p IS NOT NULL),
    q AS (SELECT *, least(1, min(p * m / rank) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM ranked),
    grid AS (SELECT site_id, feature_name, CAST(h AS INTEGER) AS horizon_days, regime, CAST(k AS INTEGER) AS lag_days,
           CASE WHEN feature_name LIKE 'discharge%' AND site_id <> '0-SILENT' THEN 'anomaly' ELSE 'value' END AS series_column
        FROM (SELECT DISTINCT o_orderpriority AS site_id FROM orders UNION ALL SELECT '0-SILENT'), (VALUES ('discharge_mean'), ('discharge_min'), ('days_below_p05'), ('days_below_p10'), ('days_below_p20')) f(feature_name),
             (VALUES (7), (14), (21)) a(h), (VALUES ('onset'), ('recovery'), ('all')) b(regime), generate_series(-21, 21) g(k)),
    swept AS (SELECT feature_name, site_id, horizon_days, lag_days, regime, series_column,
            CASE WHEN x.r IS NULL THEN 'insufficient_observations' WHEN n_folds IS NULL THEN 'insufficient_folds' ELSE 'scanned' END AS status,
            x.r AS statistic, x.p AS p_value, coalesce(x.n, 0) AS n_observations, x.ne AS n_effective,
            CASE WHEN x.r IS NOT NULL THEN CAST(CASE WHEN x.r <> 0 AND n_known > 0 THEN n_known ELSE coalesce(n_folds, 0) END AS INTEGER) END AS folds,
            CASE WHEN x.r <> 0 AND n_known > 0 THEN CAST(n_agree AS DOUBLE) / n_known END AS directional_consistency, q.q AS q_value, CAST(1 AS BIGINT) AS run_id,
            (SELECT count(*) FROM q) AS n_tests_adjusted
        FROM grid LEFT JOIN with_p x USING (feature_name, site_id, horizon_days, lag_days, regime) LEFT JOIN tested USING (feature_name, site_id, horizon_days, lag_days, regime)
             LEFT JOIN q USING (feature_name, site_id, horizon_days, lag_days, regime)),
    signals AS (SELECT * REPLACE (round(statistic, 7) AS statistic, round(p_value, 8) AS p_value, round(q_value, 8) AS q_value, round(n_effective, 6) AS n_effective, round(directional_consistency, 8) AS directional_consistency),
            coalesce(q_value <= 0.05 AND folds >= 5 AND directional_consistency >= 0.7, false) AS passes_gate FROM swept)"""


@query(f"WITH {SWEPT} SELECT * FROM signals")
def full_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of all five features, 43 lags, three horizons and three regimes."""
    return _swept(spark, sf_dir)


@query(f"""WITH {ALIGNED}, {FOLDS_OF_PAIRS},
    full_r AS (SELECT feature_name, site_id, horizon_days, lag_days, regime, {CORR} AS r, count(*) / greatest(1.0, horizon_days / 7.0) AS ne FROM aligned GROUP BY 1, 2, 3, 4, 5),
    fold_r AS (SELECT feature_name, site_id, horizon_days, lag_days, regime, fold, {CORR} AS fr FROM aligned JOIN ab USING (feature_name, site_id, horizon_days, lag_days, regime, week) GROUP BY 1, 2, 3, 4, 5, 6)
    SELECT feature_name, site_id, horizon_days, lag_days, regime, CAST(count(fr) AS INTEGER) AS folds, round(CAST(count(*) FILTER (WHERE sign(fr) = sign(r)) AS DOUBLE) / count(fr), 8) AS directional_consistency
    FROM full_r JOIN fold_r USING (feature_name, site_id, horizon_days, lag_days, regime) WHERE r IS NOT NULL AND r <> 0 AND ne > 2 GROUP BY 1, 2, 3, 4, 5 HAVING count(fr) > 0""")
def fold_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sweep.measurements(_pairs(spark, sf_dir)).where("directional_consistency IS NOT NULL")
    return rounded(rows.select(*sweep.PAIR, "folds", "directional_consistency"), "directional_consistency", digits=8)


@query(f"""WITH {SWEPT} SELECT r.run_id, count(s.status) AS n_rows, count(*) FILTER (WHERE passes_gate) AS n_passing, count(*) FILTER (WHERE status = 'scanned') AS n_scanned,
    count(p_value) AS n_tested, count(*) FILTER (WHERE passes_gate AND lag_days < 0) AS n_passing_negative_lag FROM (VALUES (1::BIGINT), (2::BIGINT)) r(run_id) LEFT JOIN signals s USING (run_id) GROUP BY 1""")
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged run and its outcome counts, and a run without rows."""
    runs = spark.range(1, 3).select(F.col("id").alias("run_id"))
    return sweep.run_summary(runs, _swept(spark, sf_dir))


@query(f"""WITH {SWEPT}, k AS (SELECT *, bool_or(passes_gate) OVER () AS any_ FROM signals WHERE q_value IS NOT NULL),
    t AS (SELECT * EXCLUDE (any_), CAST(row_number() OVER (ORDER BY q_value, feature_name, site_id, horizon_days, lag_days, regime) AS INTEGER) AS rank FROM k WHERE passes_gate OR NOT any_) SELECT * FROM t WHERE rank <= 10""")
def sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten smallest q of the run: passing rows, or all if none passes."""
    return reads.best_rows(_swept(spark, sf_dir), "run_id", "q_value", ["feature_name", "site_id", "horizon_days", "lag_days", "regime"], 10)


@query(f"WITH {SWEPT} SELECT site_id, run_id, min(q_value) AS q_value FROM signals WHERE feature_name = 'days_below_p10' GROUP BY 1, 2")
def strongest_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.strongest_signal(_swept(spark, sf_dir), "days_below_p10")


# --- analogs --------------------------------------------------------------------------------------------------

P30 = replace(analogs.Parameters(), separation_days=30)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date of every site."""
    return daily(spark, sf_dir).select(F.concat_ws("/", "site_id", F.col("date").cast("string")).alias("query_id"), "site_id", F.col("date").alias("as_of"))


EVENTS = f"""{RUNS}, det AS (SELECT site_id, date, coalesce(date - lag(date) OVER (PARTITION BY site_id ORDER BY date) > 30, true) AS new FROM runs WHERE run >= 1),
    ev AS (SELECT site_id, date, sum(CAST(new AS INT)) OVER (PARTITION BY site_id ORDER BY date) AS e FROM det)"""


@query(f"WITH {EVENTS} SELECT site_id, min(date) AS event_start, count(*) AS n_detections FROM ev GROUP BY site_id, e")
def collapsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analogs.detections(_run_values(spark, sf_dir), ["site_id"], "date", "value", 1)
    return analogs.collapse(found, ["site_id"], "date", 30)


QUERY_BODY = """q AS (SELECT site_id || '/' || CAST(date AS VARCHAR) AS query_id, site_id, date AS as_of FROM daily),
    h AS (SELECT q.query_id, q.as_of, r.date, r.run FROM q JOIN runs r ON r.site_id = q.site_id AND r.date <= q.as_of),
    det AS (SELECT *, coalesce(date - lag(date) OVER (PARTITION BY query_id ORDER BY date) > 30, true) AS new FROM h WHERE run >= 1),
    ev AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY query_id ORDER BY date) AS e FROM det),
    events AS (SELECT query_id, as_of, min(date) AS event_start, count(*) AS n FROM ev GROUP BY query_id, as_of, e),
    cnt AS (SELECT query_id, CAST(sum(n) AS BIGINT) AS raw, count(*) AS col, max(event_start) AS s FROM events GROUP BY 1),
    lastv AS (SELECT query_id, arg_max(coalesce(run, -1), date) AS l FROM h GROUP BY 1),
    summ AS (SELECT q.*, coalesce(raw, 0) AS n_raw_detections, coalesce(col, 0) AS n_collapsed_events, CASE WHEN l >= 1 THEN s END AS query_start FROM q LEFT JOIN cnt USING (query_id) LEFT JOIN lastv USING (query_id)),
    elig AS (SELECT e.query_id, e.event_start, e.n AS n_detections FROM events e JOIN summ USING (query_id) WHERE event_start + 21 <= e.as_of AND event_start + 21 < query_start)"""
QUERY = f"{RUNS}, {QUERY_BODY}"
NAMES = [f.name for f in features.registry()]


def _verdict_sql(separation: int, consistency: float) -> str:
    """CTE verdicts: each query's population, scales, neighbours and outcomes from its own history, one by one."""
    wide = ", ".join(f"max(CASE WHEN feature_name = '{n}' THEN value END) AS v_{n}, max(CASE WHEN feature_name = '{n}' THEN anomaly END) AS a_{n}, min(CASE WHEN feature_name = '{n}' AND anomaly IS NOT NULL THEN date END) AS f_{n}" for n in NAMES)
    first = ", ".join(f"min(f_{n}) AS f_{n}" for n in NAMES)
    pick = ", ".join(f"CASE WHEN first.f_{n} <= c.as_of THEN a_{n} ELSE v_{n} END AS {n}" for n in NAMES)
    moments = ", ".join(f"avg({n}) AS m_{n}, CASE WHEN min({n}) = max({n}) THEN 0 ELSE stddev_pop({n}) END AS s_{n}" for n in NAMES)
    dist = " + ".join(f"(CASE WHEN s_{n} = 0 THEN 0 ELSE (here.{n} - m_{n}) / s_{n} - (there.{n} - m_{n}) / s_{n} END) ** 2" for n in NAMES)
    full = " AND ".join(f"{n} IS NOT NULL" for n in NAMES)
    return f"""{FEATURES}, {RATES}, {QUERY_BODY.replace("> 30", f"> {separation}")}, wide AS (SELECT site_id, date, {wide} FROM features GROUP BY 1, 2), first AS (SELECT site_id, {first} FROM wide GROUP BY 1),
    asking AS (SELECT query_id, site_id, as_of FROM summ WHERE query_id IN (SELECT query_id FROM elig)),
    population AS (SELECT c.query_id, c.as_of, w.date, {pick} FROM asking c JOIN first USING (site_id) JOIN wide w ON w.site_id = c.site_id AND w.date <= c.as_of),
    complete AS (SELECT * FROM population WHERE {full}), scales AS (SELECT query_id, {moments} FROM complete GROUP BY 1),
    distances AS (SELECT e.query_id, e.event_start, sqrt({dist}) AS distance FROM elig e JOIN complete there ON there.query_id = e.query_id AND there.date = e.event_start
        JOIN complete here ON here.query_id = e.query_id AND here.date = here.as_of JOIN scales ON scales.query_id = e.query_id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, event_start) AS rank FROM distances) WHERE rank <= 10),
    starts AS (SELECT DISTINCT event_start, event_start + 21 AS e_end FROM near),
    moved AS (SELECT x.event_start, r0, r1.rate AS r1, CASE WHEN (SELECT max(week_ending) FROM rates) < x.e_end THEN 'short' WHEN r0 IS NULL OR r1.rate IS NULL THEN 'unknown' ELSE 'complete' END AS reason
        FROM (SELECT s.*, r.rate AS r0 FROM starts s ASOF LEFT JOIN rates r ON s.event_start >= r.week_ending) x ASOF LEFT JOIN rates r1 ON x.e_end >= r1.week_ending),
    per AS (SELECT query_id, count(*) AS sel, count(*) FILTER (WHERE reason = 'complete') AS com, count(*) FILTER (WHERE reason = 'complete' AND r1 > r0) AS up, count(*) FILTER (WHERE reason = 'complete' AND r1 < r0) AS down FROM near JOIN moved USING (event_start) GROUP BY 1),
    verdicts AS (SELECT s.query_id, s.site_id, s.as_of, s.n_raw_detections, s.n_collapsed_events, s.query_start,
        CASE WHEN query_start IS NULL THEN 'no_current_event' WHEN coalesce(sel, 0) = 0 THEN 'insufficient_analogs' WHEN sel > com THEN 'incomplete_outcomes' WHEN com < 4 THEN 'insufficient_analogs'
             WHEN greatest(up, down) / com < {consistency} THEN 'inconsistent_direction' ELSE 'passed' END AS verdict,
        coalesce(com, 0) AS n_analogs, CASE WHEN sel > com THEN 0 ELSE coalesce(greatest(up, down), 0) END AS n_consistent, coalesce(sel - com, 0) AS n_incomplete FROM summ s LEFT JOIN per USING (query_id))"""


@query(f"WITH {QUERY} SELECT query_id, site_id, as_of, n_raw_detections, n_collapsed_events, query_start FROM summ")
def query_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analogs.query_events(_queries(spark, sf_dir), feature_table(spark, sf_dir), P30)[1]


@query(f"WITH {QUERY} SELECT query_id, event_start, n_detections FROM elig")
def eligible_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, summary = analogs.query_events(_queries(spark, sf_dir), feature_table(spark, sf_dir), P30)
    return analogs.eligible(events, summary, 21).select("query_id", "event_start", "n_detections")


@query(f"""WITH {DAILY}, v AS (SELECT site_id, date, value_mean AS a, value_min AS b FROM daily),
    m AS (SELECT site_id, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM v GROUP BY 1),
    z AS (SELECT v.site_id, date, (a - ma) / sa AS za, (b - mb) / sb AS zb FROM v JOIN m USING (site_id)),
    last AS (SELECT site_id, max(date) AS date FROM v GROUP BY 1),
    d AS (SELECT c.site_id AS query_id, c.date AS event_start, sqrt((q.za - c.za) ** 2 + (q.zb - c.zb) ** 2) AS distance FROM z c JOIN last l USING (site_id) JOIN z q ON q.site_id = l.site_id AND q.date = l.date WHERE c.date < l.date - 21)
    SELECT query_id, event_start, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, event_start) AS rank FROM d) WHERE rank <= 10""")
def nearest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten days most like the last one of each site, by two z-scored dimensions."""
    rows = daily(spark, sf_dir).select(F.col("site_id").alias("query_id"), "date", "value_mean", "value_min")
    last = rows.groupBy("query_id").agg(F.max("date").alias("as_of"))
    vecs = rows.join(last, "query_id")
    candidates = vecs.where(F.col("date") < F.date_sub("as_of", 21)).select("query_id", F.col("date").alias("event_start"))
    near = analogs.k_nearest(vecs, candidates, replace(P30, features=("value_mean", "value_min")))
    return rounded(near, "distance", digits=6)


OUTCOME = f"""{EVENTS}, {RATES}, r AS (SELECT week_ending, CASE WHEN week(week_ending) % 9 = 0 THEN NULL ELSE rate END AS rate FROM rates),
    e AS (SELECT site_id, min(date) AS event_start, min(date) + 21 AS e_end FROM ev GROUP BY site_id, e),
    o1 AS (SELECT e.*, r.rate AS r0 FROM e ASOF LEFT JOIN r ON e.event_start >= r.week_ending),
    o2 AS (SELECT o1.*, r.rate AS r1 FROM o1 ASOF LEFT JOIN r ON o1.e_end >= r.week_ending),
    o3 AS (SELECT *, CASE WHEN (SELECT max(week_ending) FROM r) < e_end THEN 'series_does_not_reach' WHEN r0 IS NULL THEN 'no_rate_at_start' WHEN r1 IS NULL THEN 'no_rate_at_end' ELSE 'complete' END AS reason FROM o2)"""


@query(f"WITH {OUTCOME} SELECT site_id, event_start, reason, round(CASE WHEN reason = 'complete' THEN ln(r1 / r0) END, 8) AS log_return FROM o3")
def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_event_outcomes(spark, sf_dir), "log_return", digits=8)


def _event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = analogs.collapse(analogs.detections(_run_values(spark, sf_dir), ["site_id"], "date", "value", 1), ["site_id"], "date", 30).select("site_id", "event_start")
    weeks = rates(spark, sf_dir).withColumn("rate", F.when(F.weekofyear("week_ending") % 9 != 0, F.col("rate")))
    return analogs.outcomes(events, weeks, "week_ending", "rate", 21)


@query(f"""WITH {OUTCOME}, g AS (SELECT site_id || '/' || CAST(year(event_start) AS VARCHAR) AS query_id, count(*) AS sel, count(*) FILTER (WHERE reason = 'complete') AS com,
        count(*) FILTER (WHERE reason = 'complete' AND r1 > r0) AS up, count(*) FILTER (WHERE reason = 'complete' AND r1 < r0) AS down FROM o3 GROUP BY 1)
    SELECT query_id, CASE WHEN sel > com THEN 'incomplete_outcomes' WHEN com < 4 THEN 'insufficient_analogs' WHEN greatest(up, down) / com < 0.5 THEN 'inconsistent_direction' ELSE 'passed' END AS verdict,
           com AS n_analogs, CASE WHEN sel > com THEN 0 ELSE greatest(up, down) END AS n_consistent, sel - com AS n_incomplete FROM g""")
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict by site and year over the events that began in it."""
    rows = _event_outcomes(spark, sf_dir).withColumn("query_id", F.concat_ws("/", "site_id", F.year("event_start").cast("string"))).drop("site_id")
    summary = rows.select("query_id").distinct().withColumn("query_start", F.lit(Date(2001, 1, 1)))
    verdicts = analogs.gate(summary, rows, replace(P30, min_consistency=0.5))
    return verdicts.select("query_id", "verdict", "n_analogs", "n_consistent", "n_incomplete")


@query(f"""WITH {OUTCOME} SELECT site_id AS query_id, round((exp(median(ln(r1 / r0))) - 1) * 100, 6) AS median_pct, round((exp(min(ln(r1 / r0))) - 1) * 100, 6) AS low_pct, round((exp(max(ln(r1 / r0))) - 1) * 100, 6) AS high_pct
    FROM o3 WHERE reason = 'complete' GROUP BY 1""")
def outcome_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _event_outcomes(spark, sf_dir).where("reason = 'complete'").withColumnRenamed("site_id", "query_id")
    passed = rows.select("query_id").distinct().withColumn("verdict", F.lit("passed"))
    return rounded(analogs.estimates(passed, rows), "median_pct", "low_pct", "high_pct", digits=6)


def _answers(spark: SparkSession, sf_dir: str, p: analogs.Parameters) -> analogs.Answers:
    table_ = stage(feature_table(spark, sf_dir), "features")  # read by several stages of the answer
    return analogs.answer(_queries(spark, sf_dir), table_, rates(spark, sf_dir), "week_ending", "rate", p)


def _named_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir).select("site_id", F.concat(F.lit("Long River at "), "site_id", F.lit(", ZZ")).alias("name"), F.lit("Long River").alias("river"))


@query(f"WITH {_verdict_sql(30, 0.7)} SELECT query_id, site_id, as_of, n_raw_detections, n_collapsed_events, query_start, verdict, n_analogs, n_consistent, n_incomplete FROM verdicts")
def analog_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, P30).verdicts.drop("direction")


@query(f"WITH {_verdict_sql(30, 0.5)} SELECT site_id, verdict, count(*) AS n FROM verdicts GROUP BY 1, 2")
def conclusion_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries of each site end in each verdict."""
    return sweep.tallies(_answers(spark, sf_dir, replace(P30, min_consistency=0.5)).verdicts, "verdict", ["site_id"])


@query(f"WITH {_verdict_sql(30, 0.7)} SELECT query_id, event_start, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM near")
def analog_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that every query is compared with, nearest first."""
    return rounded(_answers(spark, sf_dir, P30).matches.select("query_id", "event_start", "distance", "rank"), "distance", digits=6)


def _told_sql(separation: int, consistency: float, since: bool = False) -> str:
    """CTE told: verdicts, estimates and the sentence of every query. A refusal counts events, and names the year since
    which they were looked for where that is known."""
    horizon = "' since ' || CAST(year(first_date) AS VARCHAR)" if since else "''"
    return f"""{_verdict_sql(separation, consistency)},
    ranges AS (SELECT query_id, (exp(median(ln(r1 / r0))) - 1) * 100 AS median_pct, (exp(min(ln(r1 / r0))) - 1) * 100 AS low_pct, (exp(max(ln(r1 / r0))) - 1) * 100 AS high_pct, string_agg(CAST(event_start AS VARCHAR), ',' ORDER BY rank) AS starts
        FROM near JOIN moved USING (event_start) GROUP BY 1),
    conditions AS (SELECT n.site_id, n.date AS as_of, n.value - p.value AS change, n.anomaly, n.n_years FROM seasonal2 n LEFT JOIN seasonal2 p ON p.site_id = n.site_id AND p.date = n.date - 14),
    since_ AS (SELECT site_id, min(date) AS first_date FROM daily GROUP BY 1),
    told AS (SELECT v.*, median_pct, low_pct, high_pct, starts, 'Long River discharge at ' || site_id || ' ' ||
            CASE WHEN change IS NULL THEN 'has no measured 14-day change' ELSE CASE WHEN change < 0 THEN 'has fallen ' ELSE 'has risen ' END || format('{{:,}}', CAST(round_even(abs(change), 0) AS BIGINT)) || ' cfs in 14 days' END || ' ' ||
            CASE WHEN anomaly IS NULL THEN 'and has no seasonal baseline deep enough to compare against'
                 ELSE 'and is now ' || format('{{:,}}', CAST(round_even(abs(anomaly), 0) AS BIGINT)) || ' cfs ' || CASE WHEN anomaly < 0 THEN 'below' ELSE 'above' END || ' the ' || CAST(n_years AS VARCHAR) || '-year seasonal median' END || '. ' ||
            CASE WHEN verdict = 'passed' THEN 'The last ' || n_analogs || ' times discharge moved like this, the spot barge rate ' || CASE WHEN up >= down THEN 'rose' ELSE 'fell' END || ', ' || printf('%+.0f%%', round_even(low_pct, 0)) || ' to ' || printf('%+.0f%%', round_even(high_pct, 0))
                    || ' within 3 weeks - median ' || printf('%+.0f%%', round_even(median_pct, 0)) || ', ' || n_consistent || ' of ' || n_analogs || ' directionally consistent.'
                 ELSE 'Insufficient history: ' || CASE verdict WHEN 'no_current_event' THEN site_id || ' is not in a low-water condition on ' || CAST(as_of AS VARCHAR) || ', so there is no condition to find analogs for'
                    WHEN 'incomplete_outcomes' THEN n_incomplete || ' of ' || (n_analogs + n_incomplete) || ' comparable events' || {horizon} || ' have no measurable rate move over the outcome window'
                    WHEN 'insufficient_analogs' THEN n_analogs || CASE WHEN n_analogs = 1 THEN ' comparable event' ELSE ' comparable events' END || {horizon} || ', below the 4 required'
                    ELSE n_consistent || ' of ' || n_analogs || ' comparable events' || {horizon} || ' moved the rate in the same direction, below the threshold required' END || '. No estimate offered.' END AS sentence
        FROM verdicts v LEFT JOIN per USING (query_id) LEFT JOIN ranges USING (query_id) LEFT JOIN conditions USING (site_id, as_of) LEFT JOIN since_ USING (site_id))"""


COMMON = "query_id, site_id, as_of, sentence, n_raw_detections, n_collapsed_events"


@query(f"WITH {_told_sql(30, 0.5)} SELECT {COMMON}, n_analogs, n_consistent, CAST(21 AS INTEGER) AS window_days, round(median_pct, 6) AS median_pct, round(low_pct, 6) AS low_pct, round(high_pct, 6) AS high_pct, starts AS matches FROM told WHERE verdict = 'passed'")
def conclusions_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with an estimate; their analogs by date, nearest first."""
    p = replace(P30, min_consistency=0.5)
    rows = analogs.conclusions(_answers(spark, sf_dir, p), _named_sites(spark, sf_dir), p)["passed"]
    dates = F.array_join(F.transform("matches", lambda m: m["event_start"].cast("string")), ",")
    return rounded(rows.withColumn("matches", dates), "median_pct", "low_pct", "high_pct", digits=6)


@query(f"WITH {_told_sql(90, 0.7, True)} SELECT {COMMON}, verdict AS reason, n_analogs, CAST(4 AS INTEGER) AS required, n_incomplete FROM told WHERE verdict NOT IN ('passed', 'no_current_event')")
def conclusions_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals at the default separation of 90 days, with the year since which events were looked for."""
    p = analogs.Parameters()
    sites = _named_sites(spark, sf_dir).join(daily(spark, sf_dir).groupBy("site_id").agg(F.min("date").alias("first_date")), "site_id", "left")
    return analogs.conclusions(_answers(spark, sf_dir, p), sites, p, since=F.col("first_date"))["refused"]


@query(f"WITH {_told_sql(30, 0.7)} SELECT {COMMON} FROM told WHERE verdict = 'no_current_event'")
def conclusions_no_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analogs.conclusions(_answers(spark, sf_dir, P30), _named_sites(spark, sf_dir), P30)["no_current_event"]


@query(f"""WITH {CLIMATE.replace('value_mean AS value', 'value_min AS value')}, q AS (SELECT site_id || '/' || CAST(date AS VARCHAR) AS query_id, site_id, date AS as_of FROM daily)
    SELECT query_id, round(n.value - p.value, 4) AS change, round(CASE WHEN n_years >= 5 THEN n.value - baseline END, 6) AS anomaly, CAST(n_years AS INTEGER) AS n_years
    FROM q LEFT JOIN d n ON n.site_id = q.site_id AND n.date = q.as_of LEFT JOIN climate c ON c.site_id = n.site_id AND c.doy = n.doy LEFT JOIN d p ON p.site_id = q.site_id AND p.date = q.as_of - 14""")
def current_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analogs.condition(_queries(spark, sf_dir), feature_table(spark, sf_dir), P30)
    return rounded(rounded(out, "change"), "anomaly", digits=6)


# --- readers, reports and quality -----------------------------------------------------------------------------


@query(f"WITH {SITES}, {DAILY} SELECT site_id, floor, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS n_days FROM sites LEFT JOIN daily USING (site_id) GROUP BY 1, 2")
def gauge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.read_gauges(_sites(spark, sf_dir), daily(spark, sf_dir))


@query(f"WITH {DAILY} SELECT site_id, date, round(value_mean, 4) AS value_mean FROM daily WHERE site_id = '2-HIGH' AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' ORDER BY date LIMIT 100 OFFSET 50")
def series_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = reports.read_series(daily(spark, sf_dir), _sites(spark, sf_dir), "2-HIGH", Date(1997, 1, 1), Date(1999, 12, 31), limit=100, offset=50)
    return rounded(page.select("site_id", "date", "value_mean"), "value_mean")


@query(f"""WITH {WEEKLY} SELECT location, week_ending, 'nearby' AS horizon, round(rate, 2) AS pct_of_tariff FROM weekly WHERE location = 'R' AND week_ending BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' ORDER BY week_ending LIMIT 500""")
def rates_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = weekly(spark, sf_dir).select("location", "week_ending", F.lit("nearby").alias("horizon"), F.round("rate", 2).cast("decimal(18,6)").alias("pct_of_tariff"))
    return reports.read_rates(rates, Date(1996, 1, 1), Date(1998, 12, 31), segment="R")


@query("""SELECT l_shipmode AS lock, week_ending, commodity, tons FROM (
    SELECT l_linestatus AS l_shipmode, CAST(date_trunc('week', l_shipdate) AS DATE) + 6 AS week_ending, l_returnflag AS commodity, sum(l_quantity) AS tons FROM lineitem GROUP BY 1, 2, 3)
    WHERE commodity = 'A' AND week_ending BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' ORDER BY week_ending, lock LIMIT 300""")
def movements_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.date_add(F.to_date(F.date_trunc("week", "l_shipdate")), 6).alias("week_ending")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("lock"), week, F.col("l_returnflag").alias("commodity")).agg(F.sum("l_quantity").cast("decimal(18,6)").alias("tons"))
    return reports.read_movements(rows, Date(1996, 1, 1), Date(1998, 12, 31), commodity="A", limit=300)


@query(f"""WITH {SWEPT} SELECT * FROM signals WHERE feature_name LIKE 'days\\_%' ESCAPE '\\' ORDER BY q_value NULLS LAST, feature_name, site_id, horizon_days, lag_days, regime LIMIT 500""")
def signals_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of one run's rows for a pattern of features, smallest q first."""
    return reports.read_signals(_swept(spark, sf_dir), 1, feature="days_*")


@query("SELECT o_orderkey, o_clerk FROM (SELECT o_orderkey, o_orderpriority AS o_clerk FROM orders) WHERE o_clerk SIMILAR TO '[1-3]-.*H.*'")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.glob(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("o_clerk")), "o_clerk", "[1-3]-*H*")


@query("""SELECT o_orderpriority, count(*) AS n_rows, count(*) FILTER (WHERE v IS NULL) AS n_null, count(*) FILTER (WHERE v = 0) AS n_zero, round(count(*) FILTER (WHERE v IS NULL) * 100.0 / count(*), 6) AS pct_null
    FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_totalprice END AS v FROM orders) GROUP BY 1""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.expr("CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_totalprice END").alias("v"))
    return rounded(reports.completeness(rows, "o_orderpriority", "v", zeros=True), "pct_null", digits=6)


@query(f"""WITH {RUNS} SELECT CASE WHEN run < 0 THEN 0 WHEN run >= 6 THEN 7 ELSE CAST(floor(run) AS BIGINT) + 1 END AS bucket, count(*) AS n, round(avg(value), 4) AS mean_value FROM runs WHERE run IS NOT NULL GROUP BY 1""")
def run_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs_below(spark, sf_dir).withColumn("run", F.col("run").cast("double"))
    return rounded(series.histogram(rows, "run", 0, 6, 6, {"mean_value": F.avg("value")}), "mean_value")


JOINED = f"""{RUNS}, {RATES}, j AS (SELECT r.site_id, CAST(run AS DOUBLE) AS value, CAST(h AS INT) AS horizon_days, ln(b.rate / a.rate) AS target FROM runs r JOIN rates a ON a.week_ending = r.date CROSS JOIN (VALUES (7), (14), (21)) x(h)
        JOIN rates b ON b.week_ending = a.week_ending + h WHERE run IS NOT NULL AND a.rate > 0 AND b.rate > 0)"""


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run_values(spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    return series.with_targets(rows, _targets(spark, sf_dir))


@query(f"""WITH {JOINED} SELECT site_id, horizon_days, CASE WHEN value < 0 THEN 0 WHEN value >= 6 THEN 7 ELSE CAST(floor(value) AS BIGINT) + 1 END AS bucket, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(target), 7) AS mean_target FROM j GROUP BY 1, 2, 3""")
def histogram_of_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run lengths on the very dates of the weeks, with the mean move that followed."""
    more = {"low": F.min("value"), "high": F.max("value"), "mean_target": F.round(F.avg("target"), 7)}
    return series.histogram(_joined(spark, sf_dir), "value", 0, 6, 6, more, ["site_id", "horizon_days"])


@query(f"""WITH {JOINED}, s AS (SELECT * FROM j WHERE value BETWEEN 0 AND 2) SELECT site_id, horizon_days, (SELECT count(*) FROM s WHERE s.site_id = j.site_id AND s.horizon_days = j.horizon_days) AS n_low,
    round((SELECT CASE WHEN min(value) < max(value) AND min(target) < max(target) THEN corr(value, target) END FROM s WHERE s.site_id = j.site_id AND s.horizon_days = j.horizon_days), 7) AS r_low, round(corr(value, target), 7) AS r FROM j GROUP BY 1, 2""")
def subset_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of short runs alone beside that of all."""
    low = F.col("value").between(0, 2)
    return _joined(spark, sf_dir).groupBy("site_id", "horizon_days").agg(F.count_if(low).alias("n_low"), F.round(stats.pearson_where(low, "value", "target"), 7).alias("r_low"), F.round(stats.pearson("value", "target"), 7).alias("r"))


@query("SELECT event_type, count(*) AS n_rows, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def raw_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.raw_coverage(table(spark, sf_dir, "events"), "event_type", "ts")


@query(f"WITH {WEEKLY} SELECT max(week_ending) AS newest, CAST(DATE '2002-01-01' - max(week_ending) AS INTEGER) AS days_since FROM weekly")
def publication_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.publication_lag(weekly(spark, sf_dir), "week_ending", F.lit(Date(2002, 1, 1)))


@query(f"""WITH {RUNS}, p AS (SELECT run FROM runs ORDER BY site_id, date LIMIT 500) SELECT (SELECT count(*) FROM p) AS n_shown, (SELECT count(*) FROM p WHERE run IS NULL) AS n_null, (SELECT count(*) FROM runs) AS n_total, (SELECT count(*) FROM runs) > 500 AS truncated""")
def page_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs_below(spark, sf_dir)
    return reports.page_completeness(reads.page(rows, ["site_id", "date"]), rows, "run")


def _limits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tables = {"orders": (table(spark, sf_dir, "orders"), "o_orderdate"), "events": (table(spark, sf_dir, "events"), "ts"), "none": (table(spark, sf_dir, "orders").limit(0), "o_orderdate"), "broken": (table(spark, sf_dir, "part"), "no_such_column")}
    limits = spark.createDataFrame([("orders", "a", 86400 * 4000), ("events", "b", 86400), ("none", "c", 86400 * 9000), ("broken", "d", 86400 * 9000)], "table string, job_name string, max_staleness_s long")
    return health.newest_rows(tables), limits


NOW = "TIMESTAMP '2024-02-01 00:00:00'"


@query(f"""SELECT 'orders' AS "table", 'a' AS job_name, (SELECT CAST(epoch({NOW} - max(o_orderdate)) AS BIGINT) FROM orders) AS age_s, (SELECT epoch({NOW} - max(o_orderdate)) > 86400 * 4000 FROM orders) AS stale
    UNION ALL SELECT 'events', 'b', (SELECT CAST(epoch({NOW}) AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT) FROM events), (SELECT CAST(epoch({NOW}) AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT) > 86400 FROM events)
    UNION ALL SELECT 'none', 'c', NULL, true UNION ALL SELECT 'broken', 'd', NULL, true""")
def table_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest, limits = _limits(spark, sf_dir)
    return health.freshness(newest, limits, F.expr(NOW)).select("table", "job_name", "age_s", "stale")


def _overdue(spark: SparkSession, sf_dir: str, gap_s: int = 86400 * 3) -> DataFrame:
    """Events as a job log: types are jobs, one value in ten a failure."""
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("job_name"), F.col("ts").alias("finished_at"), F.when(F.col("event_id") % 10 == 0, "failed").otherwise("success").alias("status"))
    cadences = runs.select("job_name").distinct().withColumn("max_gap_s", F.lit(gap_s)).unionByName(spark.range(1).select(F.lit("never").alias("job_name"), F.lit(86400).alias("max_gap_s")))
    return health.overdue(runs, cadences, F.expr(NOW))


OVERDUE = f"""r AS (SELECT event_type AS job_name, max(ts) FILTER (WHERE event_id % 10 <> 0) AS last_success FROM events GROUP BY 1),
    od AS (SELECT job_name, 259200 AS max_gap_s, last_success, CAST(epoch({NOW}) AS BIGINT) - CAST(floor(epoch(last_success)) AS BIGINT) > 259200 AS overdue FROM r UNION ALL SELECT 'never', 86400, NULL, true)"""


@query(f"WITH {OVERDUE} SELECT * FROM od")
def overdue_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overdue(spark, sf_dir)


@query(f"""WITH {OVERDUE}, s AS ({ORACLE_SQL["table_freshness"]}) SELECT (SELECT count(*) FROM od WHERE overdue) AS n_overdue, (SELECT count(*) FROM s WHERE stale) AS n_stale, (SELECT count(*) FROM od WHERE overdue) + (SELECT count(*) FROM s WHERE stale) > 0 AS degraded""")
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest, limits = _limits(spark, sf_dir)
    return health.health(_overdue(spark, sf_dir), health.freshness(newest, limits, F.expr(NOW)))


BY_TYPE = "f AS (SELECT event_type AS job_name, max(ts) AS newest, (SELECT max(ts) FROM events) AS latest FROM events GROUP BY 1)"


def _by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("table")).agg(F.max("ts").alias("newest"))
    return rows.withColumn("error", F.lit(None).cast("string"))


@query(f"""WITH {OVERDUE.replace("259200", "3600")}, {BY_TYPE} SELECT od.job_name, last_success FROM od JOIN f USING (job_name)
    WHERE overdue AND CAST(epoch({NOW}) AS BIGINT) - CAST(floor(epoch(newest)) AS BIGINT) <= CASE WHEN job_name < 'e' THEN 86400 ELSE 864000000 END""")
def overdue_but_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that the log calls overdue while what they load is fresh: log and data disagree."""
    newest = _by_type(spark, sf_dir)
    limits = newest.select("table", F.col("table").alias("job_name"), F.when(F.col("table") < "e", 86400).otherwise(864000000).cast("long").alias("max_staleness_s"))
    return health.overdue_but_fresh(_overdue(spark, sf_dir, 3600), health.freshness(newest, limits, F.expr(NOW))).select("job_name", "last_success")


@query(f"""WITH {BY_TYPE}, g AS (SELECT *, CAST(floor(epoch(latest)) AS BIGINT) - CAST(floor(epoch(newest)) AS BIGINT) AS lag_s FROM f)
    SELECT job_name AS "table", lag_s, CAST(CASE WHEN job_name < 'e' THEN 7260 ELSE 7200 END AS BIGINT) AS max_staleness_s, CASE WHEN job_name < 'e' THEN 7260 ELSE 7200 END < 3600 + lag_s + 3600 AS below_floor FROM g""")
def staleness_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds against cycle + observed lag + cycle: hourly tables, each as late as it is behind the newest of all."""
    newest = _by_type(spark, sf_dir)
    lag = newest.agg(F.max(F.unix_timestamp("newest"))).scalar() - F.unix_timestamp("newest")
    limits = newest.select("table", F.col("table").alias("job_name"), F.when(F.col("table") < "e", 7260).otherwise(7200).cast("long").alias("max_staleness_s"), F.lit(3600).alias("cycle_s"), lag.alias("lag_s"))
    return health.freshness(newest, limits, F.expr(NOW)).select("table", "lag_s", "max_staleness_s", "below_floor")


@query("""SELECT o_orderkey, unnest(list_filter([CASE WHEN NOT (o_totalprice < 200000) THEN 'price_range' END, CASE WHEN NOT (o_orderstatus <> 'F' OR o_totalprice > 50000) THEN 'filled_is_large' END], lambda x: x IS NOT NULL)) AS rule FROM orders""")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"price_range": F.col("o_totalprice") < 200000, "filled_is_large": (F.col("o_orderstatus") != "F") | (F.col("o_totalprice") > 50000)}
    return quality.violations(table(spark, sf_dir, "orders"), rules, ["o_orderkey"])


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1")
def unseen_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unseen(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


COPY = "count(*) AS n_rows, min(o_orderdate) AS first, max(o_orderdate) AS last, count(o_orderstatus) AS n_extra, sum(CAST(o_totalprice AS DECIMAL(28, 6))) AS total"


@query(f"""WITH a AS (SELECT {COPY} FROM orders), b AS (SELECT {COPY} FROM orders WHERE o_orderstatus <> 'P') SELECT 'whole' AS copy, a.n_rows, CAST(a.total AS DOUBLE) AS total, a = a AS same FROM a
    UNION ALL SELECT 'partial', b.n_rows, CAST(b.total AS DOUBLE), a = b FROM a, b""")
def copy_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy with rows in another order, and one that lacks some."""
    a = table(spark, sf_dir, "orders")
    copies = {"whole": a.repartition(7, "o_custkey"), "partial": a.where("o_orderstatus <> 'P'")}
    print_ = lambda x: quality.fingerprint(x, "o_orderdate", "o_totalprice", "o_orderstatus")
    parts = [quality.same_copy(print_(a), print_(c)).join(print_(c)).select(F.lit(name).alias("copy"), "n_rows", F.col("total").cast("double").alias("total"), "same") for name, c in copies.items()]
    return sinks.union_all(parts)


@query("""SELECT 'orders' AS "table", (SELECT count(*) FROM orders) AS recorded, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS restored, 'differs' AS status
    UNION ALL SELECT 'part', (SELECT count(*) FROM part), NULL, 'missing' UNION ALL SELECT 'nation', NULL, (SELECT count(*) FROM nation), 'unexpected'""")
def counts_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("orders", "part", "nation", "region")}
    recorded = quality.table_counts({"orders": t["orders"], "part": t["part"], "region": t["region"]})
    restored = quality.table_counts({"orders": t["orders"].where("o_orderstatus = 'O'"), "nation": t["nation"], "region": t["region"]})
    return quality.compare_counts(recorded, restored)


@query("SELECT DISTINCT e.event_type FROM events e WHERE e.event_type NOT IN (SELECT o_orderstatus FROM orders)")
def unregistered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("event_type"))
    return series.unregistered(table(spark, sf_dir, "events"), registry, "event_type")


@query("""SELECT event_id, TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE) AS k, json_extract_string(props, '$.k') IS NOT NULL AND TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE) IS NULL AS malformed FROM events""")
def optional_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.get_json_object("props", "$.k")
    value, bad = landed.optional(raw, "double")
    return table(spark, sf_dir, "events").select("event_id", value.alias("k"), bad.alias("malformed"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_rollup(spark, sf_dir)
