"""Registered queries over landed bodies: the tables are composed into the JSON that the sources publish, written as
text, one body a line, and parsed back, so that SQL over the same tables judges parsers, rejects and the stream.

Every fault is planted by the row's own number: values that are sentinels, words or blanks, times without an offset,
dates with one, missing keys, months that are none, bodies that are errors, empty or no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import query, table
from .session import scratch
from .sources import landed, sinks
from .streaming.landing import merge_stream


def _land(bodies: DataFrame, column: str, name: str) -> str:
    path = scratch(bodies.sparkSession, name)
    bodies.select(column).write.text(path)
    return path


def _every(n: int, key: str) -> Column:
    return F.col(key) % n == 0


# --- time-series bodies: events by type, at most 500 points a body ----------------------------------------------

EVENTS = """e AS (SELECT event_id AS id, event_id // 500 AS block, event_type, ts, value FROM events),
    points AS (SELECT *, CASE WHEN block % 17 <> 0 THEN event_type END AS site_id, CASE WHEN block % 19 <> 0 THEN CASE WHEN block % 2 = 0 THEN '00060' ELSE '00065' END END AS param_code,
            CASE WHEN id % 11 = 0 THEN -999999 WHEN id % 13 = 0 THEN NULL ELSE value END AS v FROM e),
    kept AS (SELECT * FROM points WHERE NOT (id % 11 = 0 AND block % 3 = 0))"""


def _series_bodies(spark: SparkSession, sf_dir: str, time: Column) -> str:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr("event_id div 500").alias("block"), "event_type", "ts", F.col("value").cast("string").alias("value"))
    raw = F.when(_every(11, "id"), "-999999").when(_every(13, "id"), "n/a").otherwise(F.col("value"))
    point = F.struct(raw.alias("value"), F.when(_every(2, "id"), F.array(F.lit("P"))).otherwise(F.array(F.lit("A"), F.lit("e"))).alias("qualifiers"), time.alias("dateTime"))
    series = e.groupBy("event_type", "block").agg(F.collect_list(point).alias("points"))
    site = F.when(~_every(17, "block"), F.array(F.struct(F.col("event_type").alias("value"))))
    param = F.when(~_every(19, "block"), F.array(F.struct(F.when(_every(2, "block"), "00060").otherwise("00065").alias("value"))))
    nothing = F.when(_every(3, "block"), "-999999").when(F.col("block") % 3 == 1, "none")
    options = F.when(~_every(23, "block"), F.array(F.struct(F.lit("Other").alias("name"), F.lit("x").alias("optionCode")), F.struct(F.lit(" Statistic ").alias("name"), F.when(_every(5, "block"), "00001").otherwise("00003").alias("optionCode"))))
    one = F.struct(
        F.struct(site.alias("siteCode")).alias("sourceInfo"),
        F.struct(param.alias("variableCode"), nothing.alias("noDataValue"), F.struct(options.alias("option")).alias("options")).alias("variable"),
        F.array(F.struct(F.col("points").alias("value"))).alias("values"),
    )
    return _land(series.select(F.to_json(F.struct(F.struct(F.array(one).alias("timeSeries")).alias("value"))).alias("body")), "body", "series")


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No offset every seventh, five hours west every fifth, else UTC."""
    text = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    west = F.concat(text(F.col("ts") - F.expr("interval 5 hours")), F.lit("-05:00"))
    time = F.when(_every(7, "id"), text(F.col("ts"))).when(_every(5, "id"), west).otherwise(F.concat(text(F.col("ts")), F.lit("Z")))
    return landed.series_points(spark, _series_bodies(spark, sf_dir, time), lines=True)


@query(f"WITH {EVENTS} SELECT site_id, epoch_us(ts) AS us, param_code, v AS value, CASE WHEN id % 2 = 0 THEN 'P' ELSE 'A,e' END AS qualifiers FROM kept WHERE site_id IS NOT NULL AND param_code IS NOT NULL AND v IS NOT NULL AND id % 7 <> 0")
def landed_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = landed.instantaneous_readings(_instants(spark, sf_dir)).rows
    return rows.select("site_id", F.unix_micros("ts").alias("us"), "param_code", "value", F.array_join("qualifiers", ",").alias("qualifiers"))


@query(f"""WITH {EVENTS} SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN site_id IS NULL THEN 'no_site' END, CASE WHEN param_code IS NULL THEN 'no_param' END,
    CASE WHEN v IS NULL THEN 'bad_value' END, CASE WHEN id % 7 = 0 THEN 'time_without_offset' END], lambda r: r IS NOT NULL)) AS reason FROM kept) GROUP BY 1""")
def landed_instant_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reason and how many points have it; a point may have several."""
    rejects = landed.instantaneous_readings(_instants(spark, sf_dir)).rejects
    return rejects.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


DAILY_POINTS = f"""{EVENTS}, daily_points AS (SELECT *, CAST(ts AS DATE) AS date, CASE WHEN block % 23 <> 0 THEN CASE WHEN block % 5 = 0 THEN '00001' ELSE '00003' END END AS stat_cd FROM kept)"""


def _days(spark: SparkSession, sf_dir: str) -> landed.Parsed:
    """Calendar dates at midnight without an offset, every seventh with one."""
    day = F.date_format("ts", "yyyy-MM-dd'T'00:00:00.000")
    return landed.daily_readings(landed.series_points(spark, _series_bodies(spark, sf_dir, F.when(_every(7, "id"), F.concat(day, F.lit("-05:00"))).otherwise(day)), lines=True))


@query(f"WITH {DAILY_POINTS} SELECT site_id, date, param_code, stat_cd, v AS value FROM daily_points WHERE site_id IS NOT NULL AND param_code IS NOT NULL AND stat_cd IS NOT NULL AND v IS NOT NULL AND id % 7 <> 0")
def landed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).rows.select("site_id", "date", "param_code", "stat_cd", "value")


@query(f"""WITH {DAILY_POINTS} SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN site_id IS NULL THEN 'no_site' END, CASE WHEN param_code IS NULL THEN 'no_param' END, CASE WHEN stat_cd IS NULL THEN 'no_statistic' END,
    CASE WHEN v IS NULL THEN 'bad_value' END, CASE WHEN id % 7 = 0 THEN 'date_with_offset' END], lambda r: r IS NOT NULL)) AS reason FROM daily_points) GROUP BY 1""")
def landed_day_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).rejects.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type wants one parameter, those that begin with c or later two; one site never reported."""
    known = table(spark, sf_dir, "events").select(F.col("event_type").alias("site_id")).distinct()
    two = F.when(F.col("site_id") >= "d", F.array(F.lit("00060"), F.lit("00065"))).otherwise(F.array(F.lit("00060")))
    silent = spark.range(1).select(F.lit("silent").alias("site_id"), F.array(F.lit("00065")).alias("available_params"))
    return landed.load_gauges(known.withColumn("available_params", two).unionByName(silent))


REQUESTED = f"""{EVENTS}, requested AS (SELECT event_type AS site_id, unnest(CASE WHEN event_type >= 'd' THEN ['00060', '00065'] ELSE ['00060'] END) AS param_code FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT 'silent', '00065')"""


@query(f"WITH {REQUESTED} SELECT * FROM requested EXCEPT SELECT site_id, param_code FROM points")
def absent_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested series that no body holds."""
    return landed.absent_series(landed.requested_pairs(_registry(spark, sf_dir)), _instants(spark, sf_dir), ["site_id", "param_code"])


@query(f"WITH {REQUESTED} SELECT site_id, param_code, count(*) AS n, CAST(sum(CAST(v AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM kept JOIN requested USING (site_id, param_code) WHERE v IS NOT NULL AND id % 7 <> 0 GROUP BY 1, 2")
def requested_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the requested series; others in the same bodies are dropped."""
    rows = landed.instantaneous_readings(_instants(spark, sf_dir)).rows
    mine = landed.only_requested(rows, landed.requested_pairs(_registry(spark, sf_dir)), ["site_id", "param_code"])
    return mine.groupBy("site_id", "param_code").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


# --- weekly records: orders in three datasets, line items as movements --------------------------------------------

RATES = """r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 29 <> 0 AND o_orderkey % 31 <> 0 THEN o_orderpriority END AS location, CAST(o_orderdate AS DATE) AS week_ending, ['nearby', '1_month', '3_month'][o_orderkey % 3 + 1] AS horizon,
        CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS rate, o_orderkey % 4 <> 0 AND (o_orderkey % 37 = 0 OR o_orderkey % 41 = 0) AS bad_rate, o_orderkey % 7 = 0 AS bad_date, month(o_orderdate) AS month,
        o_orderkey % 3 <> 0 AND o_orderkey % 43 <> 0 AND o_orderkey % 47 <> 0 AND o_orderkey % 53 = 0 AS no_month, o_orderkey % 3 <> 0 AND (o_orderkey % 43 = 0 OR o_orderkey % 47 = 0) AS bad_month FROM orders)"""


def _rates(spark: SparkSession, sf_dir: str) -> landed.Parsed:
    key, day = "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00.000")
    record = F.struct(
        F.when(_every(7, key), F.concat(day, F.lit("Z"))).otherwise(day).alias("date"),
        F.when(_every(29, key), None).when(_every(31, key), " ").otherwise(F.col("o_orderpriority")).alias("location"),
        F.when(_every(4, key), None).when(_every(37, key), "").when(_every(41, key), "n/a").otherwise(F.col("o_totalprice").cast("decimal(18,4)").cast("string")).alias("rate"),
        F.when(_every(43, key), "13").when(_every(47, key), "May").when(_every(53, key), None).otherwise(F.month("o_orderdate").cast("string")).alias("rate_month"),
    )
    bodies = table(spark, sf_dir, "orders").select((F.col(key) % 3).alias("d"), F.to_json(record).alias("body"))
    names = list(landed.HORIZONS)
    return landed.rate_records(spark, {name: _land(bodies.where(F.col("d") == i), "body", name) for i, name in enumerate(names)}, lines=True)


@query(f"WITH {RATES} SELECT location, week_ending, horizon, rate AS pct_of_tariff, CASE WHEN horizon <> 'nearby' THEN CAST(month AS INTEGER) END AS rate_month FROM r WHERE location IS NOT NULL AND NOT bad_rate AND NOT bad_date AND NOT no_month AND NOT bad_month")
def landed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of three datasets, each of its own horizon; a rate that was not published is NULL, a blank one a reject."""
    return _rates(spark, sf_dir).rows.select("location", "week_ending", "horizon", F.col("pct_of_tariff").cast("double").alias("pct_of_tariff"), "rate_month")


@query(f"""WITH {RATES} SELECT horizon, reason, count(*) AS n FROM (SELECT horizon, unnest(list_filter([CASE WHEN location IS NULL THEN 'no_location' END, CASE WHEN bad_date THEN 'bad_date' END, CASE WHEN bad_rate THEN 'bad_rate' END,
    CASE WHEN no_month THEN 'no_rate_month' END, CASE WHEN bad_month THEN 'bad_rate_month' END], lambda x: x IS NOT NULL)) AS reason FROM r) GROUP BY 1, 2""")
def landed_rate_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir).rejects.select("horizon", F.explode("reasons").alias("reason")).groupBy("horizon", "reason").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_returnflag AS lock, CAST(l_shipdate AS DATE) AS week_ending, l_linestatus AS commodity, (l_orderkey + l_partkey) % 5 AS f, l_quantity AS q, (l_orderkey + l_partkey) % 9 = 0 AS no_lock FROM lineitem)
    SELECT lock, week_ending, commodity, CASE f WHEN 1 THEN 0.0 WHEN 2 THEN NULL ELSE CAST(q AS DOUBLE) END AS tons FROM m WHERE f <> 0 AND NOT no_lock""")
def landed_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tons that are 0, not published and malformed stay three things."""
    f = (F.col("l_orderkey") + F.col("l_partkey")) % 5
    tons = F.when(f == 0, "12 t").when(f == 1, "0").when(f == 2, None).otherwise(F.col("l_quantity").cast("string"))
    lock = F.when((F.col("l_orderkey") + F.col("l_partkey")) % 9 != 0, F.col("l_returnflag"))
    record = F.struct(F.date_format("l_shipdate", "yyyy-MM-dd'T'00:00:00.000").alias("date"), lock.alias("lock"), F.col("l_linestatus").alias("commodity"), tons.alias("tons"))
    path = _land(table(spark, sf_dir, "lineitem").select(F.to_json(record).alias("body")), "body", "movements")
    return landed.movement_records(spark, path, lines=True).rows.select("lock", "week_ending", "commodity", F.col("tons").cast("double").alias("tons"))


@query("""SELECT CASE o_orderkey % 6 WHEN 0 THEN 'rows' WHEN 1 THEN 'empty_page' WHEN 2 THEN 'error_object' WHEN 3 THEN 'other_json' ELSE 'outside_record' END AS outcome, count(*) AS n FROM orders GROUP BY 1""")
def body_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with rows, empty pages, error objects, other JSON, and bodies that are no JSON at all, cut ones too."""
    kind, record = F.col("o_orderkey") % 6, F.to_json(F.struct("o_orderkey", "o_orderpriority"))
    error = F.to_json(F.struct(F.lit(True).alias("error"), F.col("o_orderpriority").alias("message")))
    body = F.when(kind == 0, F.concat(F.lit("["), record, F.lit("]"))).when(kind == 1, "[]").when(kind == 2, error).when(kind == 3, record).when(kind == 4, F.concat(F.lit("No data for "), "o_orderpriority")).otherwise(F.concat(F.lit("["), record))
    path = _land(table(spark, sf_dir, "orders").select(body.alias("body")), "body", "pages")
    return landed.classify_bodies(spark, path, lines=True).groupBy("outcome").agg(F.count("*").alias("n"))


# --- the stream ---------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS batch, year(o_orderdate) AS y, o_totalprice AS p, o_orderkey % 5 = 0 AS revised FROM orders)
    SELECT k, CAST(y + CASE WHEN batch = 2 THEN 1 ELSE 0 END AS INTEGER) AS y, CASE WHEN batch = 1 AND k % 4 = 0 THEN NULL ELSE p + 10 * batch + CASE WHEN revised THEN 1 ELSE 0 END END AS v FROM b""")
def merged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of landed files through the stream, which starts anew for each from its checkpoint, and once more
    for nothing: late rows revise earlier ones, become NULL or move to another partition, and a batch repeats keys."""
    base, orders = scratch(spark, "stream"), table(spark, sf_dir, "orders")
    key, stream = F.col("o_orderkey"), dict(schema="k long, y int, v double, n int", table=f"{base}/table", keys=["k"], values=["y", "v"], partition="y", seq="n", checkpoint=f"{base}/checkpoint")
    for batch in range(3):
        value = F.when(F.lit(batch == 1) & (key % 4 == 0), None).otherwise(F.col("o_totalprice") + 10 * batch)
        rows = orders.where(key % [1, 2, 3][batch] == 0).select(key.alias("k"), (F.year("o_orderdate") + (1 if batch == 2 else 0)).alias("y"), value.alias("v"), F.lit(1).alias("n"))
        again = rows.where(F.col("k") % 5 == 0).select("k", "y", (F.col("v") + 1).alias("v"), F.lit(2).alias("n"))
        rows.unionByName(again).write.mode("append").json(f"{base}/landing")
        merge_stream(spark, f"{base}/landing", **stream).awaitTermination()
    merge_stream(spark, f"{base}/landing", **stream).awaitTermination()
    return sinks.read_table(spark, f"{base}/table", "k long, y int, v double").select("k", "y", "v")
