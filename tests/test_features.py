"""Hand-computed vectors of the daily series, climatology, run lengths and targets."""

from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane import queries
from tidelane.functions import regimes, seasonal, targets, thresholds
from tidelane.operators import asof, series
from tidelane.operators.ranges import ranged as ranged_rows
from tidelane.plans import analogs, features

DAY = date(2023, 1, 1)


def days(values, start=DAY, site="a"):
    return [(site, start + timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "site_id string, date date, value double")


def sum_plainly(values):
    total = 0.0  # ``sum`` makes up for what is rounded off
    for v in values:
        total += v
    return total


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_rollup_of_one_utc_day(spark):
    rows = [("a", datetime(2024, 3, 1, h), "00060", v) for h, v in zip((0, 6, 12, 23), (200000.0, 100000.0, 150000.0, 250000.0))]
    iv = spark.createDataFrame(rows, "site_id string, ts timestamp, param_code string, value double")
    dv = spark.createDataFrame([("a", date(2024, 3, 1), "00060", "00003", 999999.0), ("a", date(2024, 3, 2), "00060", "00003", 121000.0), ("a", date(2024, 3, 2), "00060", "00001", 5.0)], "site_id string, date date, param_code string, stat_cd string, value double")
    out = series.rollup(iv, dv, ["site_id", "param_code"]).orderBy("date").collect()
    assert [(r.value_min, r.value_mean, r.value_max, r.source, r.n_observations) for r in out] == [(100000, 175000, 250000, "iv", 4), (121000, 121000, 121000, "dv", 1)]
    assert [(r.value, r.source) for r in series.gauge_series(iv, dv, ["site_id", "param_code"]).orderBy("date").collect()] == [(175000, "iv"), (121000, "dv")]


def test_folded_day_of_year(spark):
    dates = ["2020-02-29", "2020-02-28", "2020-03-01", "2021-03-01", "2020-12-31", "2021-12-31"]
    df = spark.createDataFrame([(d,) for d in dates], "d string").select(seasonal.folded_day(F.to_date("d")).alias("n"))
    assert [r.n for r in df.collect()] == [59, 59, 60, 60, 365, 365]


def test_climatology_and_guard(spark):
    rows = [("a", date(y, 10, 11), 200000.0 if y < 2022 else 20000.0) for y in range(2012, 2023)]
    out = {r.date.year: r for r in seasonal.anomalies(frame(spark, rows), ["site_id"]).collect()}
    assert out[2022].anomaly == -180000 and out[2022].climatology_n_years == 11
    few = seasonal.anomalies(frame(spark, rows[:3]), ["site_id"]).collect()
    assert all(r.anomaly is None and r.climatology_n_years == 3 for r in few)
    assert [r.anomaly for r in seasonal.anomalies(frame(spark, [("a", date(y, 5, 1), 100.0) for y in range(2000, 2008)]), ["site_id"]).collect()] == [0.0] * 8
    alone = seasonal.anomalies(frame(spark, [("a", DAY, None)]), ["site_id"]).collect()
    assert alone[0].climatology_n_years == 0 and alone[0].anomaly is None


def test_baseline_is_free_of_summation_order(spark):
    medians = [5997.32, 7945.13, 16971.96, 21363.51, 21698.59, 23099.49, 23688.38, 23721.14, 23993.73, 28919.52, 29506.23, 36731.25, 37184.68, 42461.32, 52943.95]
    rng = random.Random(7)
    rows = [r for i in range(60) for r in days(rng.sample(medians, 15), date(2023, 6, 1), f"s{i}")]
    middle = seasonal.climatology(frame(spark, rows), ["site_id"]).where(F.col("doy") == 159)
    assert {r.baseline for r in middle.collect()} == {math.fsum(medians) / 15} and 17132.58 - math.fsum(medians) / 15 == -9282.5
    odd = frame(spark, days([1.0, math.inf, 3.0], date(2023, 6, 1)) + days([1.0, math.nan], date(2023, 6, 1), "b"))
    found = {r.site_id: r.baseline for r in seasonal.climatology(odd, ["site_id"]).where(F.col("doy") == 153).collect()}
    assert found["a"] == math.inf and math.isnan(found["b"])


def test_registered_anomalies_add_up_as_their_sql(spark, tmp_path):
    # by day from 14 to 28 April; the mean is 26415.08, and the sum in SQL's order (last day first) a little above
    by_day = [23099.49, 21698.59, 23721.14, 21363.51, 16971.96, 23993.73, 23688.38, 37184.68, 7945.13, 29506.23, 36731.25, 5997.32, 42461.32, 28919.52, 52943.95]
    baseline = sum_plainly(reversed(by_day)) / 15
    assert 17132.58 - math.fsum(by_day) / 15 == -9282.5 and 17132.58 - baseline < -9282.5
    rows = [("a", datetime(2001, 4, 14 + i), v) for i, v in enumerate(by_day)] + [("a", datetime(y, 4, 21), v) for y, v in zip(range(1997, 2001), (17132.58, 20000.0, 40000.0, 50000.0))]
    rows += [("b", *r[1:]) for r in rows]
    random.Random(3).shuffle(rows)
    spark.createDataFrame(rows, "o_orderpriority string, o_orderdate timestamp, o_totalprice double").repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    found = queries.feature_table(spark, str(tmp_path)).where("feature_name = 'discharge_min' AND date = DATE '1997-04-21'").withColumn("told", F.format_number(F.abs("anomaly"), 0)).collect()
    assert [(r.anomaly, r.told, r.climatology_n_years) for r in found] == [(17132.58 - baseline, "9,283", 5)] * 2


def test_climatology_wraps_at_year_end(spark):
    rows = [("a", date(y, 12, 31), 10.0) for y in range(2000, 2008)] + [("a", date(y, 1, 3), 20.0) for y in range(2000, 2008)]
    out = {r.doy: r for r in seasonal.climatology(frame(spark, rows), ["site_id"]).collect()}
    assert out[1].baseline == 15 and out[1].n_years == 8 and out[365].baseline == 15 and 20 not in out


def test_percentiles(spark):
    out = thresholds.thresholds(frame(spark, days(range(100, 1001, 100))), ["site_id"]).first()
    assert (round(out.p05, 6), round(out.p10, 6), round(out.p20, 6)) == (145, 190, 280)


@pytest.mark.parametrize(
    "rows, expected",
    [
        (days([90, 80, 70, 110, 60, 50]), [1, 2, 3, 0, 1, 2]),
        (days([99, 100, 99, 100]), [1, 0, 1, 0]),
        (days([50, 50, 50], date(2023, 1, 1)) + days([50, 50, 150, 80], date(2023, 8, 15)), [1, 2, 3, None, None, 0, 1]),
        (days([50, None, 50, 120, 50]), [1, None, None, 0, 1]),
        (days([50]) + days([150], date(2023, 2, 1)), [1, 0]),
    ],
)
def test_run_lengths(spark, rows, expected):
    df = frame(spark, rows).withColumn("limit", F.lit(100.0))
    assert column(thresholds.run_lengths(df, ["site_id"], {"run": "limit"}).drop("limit"), "run") == expected


def runs_by_hand(rows, limit):
    """One pass over a site's rows (date, value) in order."""
    out, run, unknown, before = [], 0, False, None
    for day, value in rows:
        gap = before is not None and (day - before).days > 1
        if value is not None and value >= limit:
            run, unknown = 0, False
            out.append(0)
        else:
            unknown |= gap or value is None
            run += value is not None
            out.append(None if unknown else run)
        before = day
    return out


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_long_series_lie_in_many_ranges(spark, monkeypatch, ranges):
    """One key with nearly all rows: run lengths, percentiles, events and as-of matches over any number of ranges."""
    for module in (thresholds, analogs, asof):
        monkeypatch.setattr(module, "ranged", partial(ranged_rows, ranges=ranges))
    r = random.Random(ranges)
    rows = []
    for site, n in (("long", 900), ("short", 5), ("none", 3)):
        day = date(2010, 1, 1)
        for _ in range(n):
            day += timedelta(days=r.choice([1] * 12 + [2, 30]))
            rows.append((site, day, None if site == "none" or r.random() < 0.05 else float(r.choice([r.randint(0, 400), 7, 200]))))
    df = spark.createDataFrame(r.sample(rows, len(rows)), "site_id string, date date, value double").repartition(3)
    limits = thresholds.thresholds(df, ["site_id"], levels=(5, 10, 50))
    for x in limits.collect():
        known = [v for s, _, v in rows if s == x.site_id and v is not None]
        want = np.percentile(known, [5, 10, 50]).tolist() if known else [None] * 3
        assert [x.p05, x.p10, x.p50] == [w if w is None else pytest.approx(w) for w in want]
    got = thresholds.run_lengths(df.withColumns({"a": F.lit(150.0), "b": F.lit(350.0)}), ["site_id"], {"low": "a", "high": "b"}).orderBy("site_id", "date").collect()
    for site in ("long", "short", "none"):
        own = [(d, v) for s, d, v in rows if s == site]
        assert [x.low for x in got if x.site_id == site] == runs_by_hand(own, 150.0) and [x.high for x in got if x.site_id == site] == runs_by_hand(own, 350.0)
    found = [(s, d) for s, d, v in rows if v is not None and v > 370]
    events = analogs.collapse(spark.createDataFrame(found, "site_id string, date date").repartition(4), ["site_id"], "date", 20).collect()
    want, last = [], {}
    for s, d in found:
        if s not in last or (d - last[s]).days > 20:
            want.append([s, d, 0])
        want[-1][2] += 1
        last[s] = d
    assert sorted((e.site_id, e.event_start, e.n_detections) for e in events) == sorted(map(tuple, want)) and len(want) > 5
    # as of: no key at all, so that everything is one series
    asked = [(i, date(2009, 12, 1) + timedelta(days=r.randint(0, 2600))) for i in range(300)]
    right = [(d, v) for s, d, v in rows if s == "long"]
    out = asof.asof_backward(spark.createDataFrame(asked, "i int, t date").repartition(3), spark.createDataFrame(right, "d date, v double").repartition(2), [], "t", "d", ["v"])
    best = lambda t: max((x for x in right if x[0] <= t), default=(None, None), key=lambda x: x[0])
    assert {x.i: (x.d, x.v) for x in out.collect()} == {i: best(t) for i, t in asked}


def test_forward_returns(spark):
    weeks = lambda values: spark.createDataFrame([(DAY + timedelta(days=7 * i), v) for i, v in enumerate(values)], "week date, rate double")
    out = targets.forward_returns(weeks([100.0, 200.0, 100.0]), [], "week", "rate", (7,))
    assert column(out, "value", "week") == [math.log(2), -math.log(2), None]
    gap = targets.forward_returns(weeks([500.0, None, 800.0]), [], "week", "rate", (7, 14))
    assert column(gap.where("horizon_days = 7"), "value", "week") == [None, None, None]
    assert column(gap.where("horizon_days = 14"), "value", "week") == [pytest.approx(math.log(1.6)), None, None]
    n = {r.horizon_days: r.n_weeks for r in targets.resolvable_weeks(weeks([100.0, 110.0, 120.0, 130.0, 140.0]), [], "week", "rate").collect()}
    assert n == {7: 4, 14: 3, 21: 2}
    assert column(targets.forward_returns(weeks([0.0, 5.0]), [], "week", "rate", (7,)), "value", "week") == [None, None]


def test_regimes(spark):
    assert column(regimes.direction(frame(spark, days([1, None, 5])), ["site_id"]), "regime") == [None, None, None]
    assert column(regimes.direction(frame(spark, days([58, 51, 44, 37, 30])), ["site_id"]), "regime") == [None, *["recovery"] * 4]
    gap = frame(spark, days([1, 2]) + days([3], date(2023, 2, 1)))
    assert column(regimes.direction(gap, ["site_id"]), "regime") == [None, "onset", None]
    assert regimes.members(gap, ["site_id"]).where("regime = 'all'").count() == 3


def test_registry(spark):
    names = [f.name for f in features.registry()]
    assert len(set(names)) == 5
    with pytest.raises(ValueError):
        features.checked(features.registry() * 2, ["value_mean", "value_min"])
    with pytest.raises(ValueError):
        features.checked(features.registry(), ["value_mean"])
    daily = frame(spark, days([5, 4, 3, 2, 1])).select("site_id", "date", F.col("value").alias("value_mean"), F.col("value").alias("value_min"), F.lit("00060").alias("param_code"))
    out = features.build_features(daily, ["site_id"])
    assert out.groupBy("feature_name").count().count() == 5 and out.count() == 25
    assert features.collapsing(features.registry()) == [("00060", "discharge_mean", "discharge_min")]
