"""As-of joins, merges, incremental windows, reads and quality rules."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidelane.operators import asof, incremental, quality, reads, series
from tidelane.sources import sinks

D = date(2020, 1, 1)


def test_asof_backward_against_a_loop(spark):
    random.seed(5)
    right = [(k, D + timedelta(days=random.randrange(900)), random.choice([None, 1.0, 2.0, 3.0])) for k in "ab" for _ in range(60)]
    right = list({(k, d): (k, d, v) for k, d, v in right}.values())
    left = [(k, i, D + timedelta(days=random.randrange(-30, 1000))) for k in "abc" for i in range(50)]
    r = spark.createDataFrame(right, "k string, d date, v double")
    left_df = spark.createDataFrame(left, "k string, i int, t date")
    expected = {}
    for k, i, t in left:
        match = max(((d, v) for kk, d, v in right if kk == k and d <= t), key=lambda x: x[0], default=(None, None))
        expected[k, i] = match
    for long in (True, False):
        out = {(x.k, x.i): (x.d, x.v) for x in asof.asof_backward(left_df, r, ["k"], "t", "d", ["v"], long_series=long).collect()}
        assert out == expected


def test_asof_lagged_reads_known_values_only(spark):
    weeks = spark.createDataFrame([("a", D)], "k string, w date")
    rows = spark.createDataFrame([("a", D - timedelta(days=8), 1.0), ("a", D - timedelta(days=7), None), ("a", D + timedelta(days=6), 9.0)], "k string, d date, x double")
    lags = [7, -7, 30]
    out = {r.lag_days: (r.d, r.x) for r in asof.asof_lagged(weeks, rows, ["k"], "w", "d", "x", lags).collect()}
    assert out == {7: (D - timedelta(days=8), 1.0), -7: (D + timedelta(days=6), 9.0)}


def test_trailing_mean_keeps_weeks_without_days(spark):
    weeks = spark.createDataFrame([(D,), (D + timedelta(days=7),)], "w date")
    daily = spark.createDataFrame([(D - timedelta(days=6), 1.0), (D - timedelta(days=7), 100.0), (D, 2.0)], "d date, v double")
    out = series.trailing_mean(weeks, daily, [], "w", "d", "v").orderBy("w").collect()
    assert [r.trailing_mean for r in out] == [2.0, None]  # 1.5 rounds half to even


@pytest.mark.parametrize("parts", [1, 2, 3, 6])
def test_trailing_mean_does_not_depend_on_the_order_of_rows(spark, parts):
    values = [284823.1, 284823.2, 284823.4, 284823.3, 284824.9, 284824.1]  # the mean is 284823.5, and not in doubles
    rows = [(date(2000, 3, 6 + i), v) for i, v in enumerate(values)]
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: -r[1])):
        daily = spark.createDataFrame(order, "d date, v double").repartition(parts)
        weeks = spark.createDataFrame([(date(2000, 3, 12),)], "w date")
        assert series.trailing_mean(weeks, daily, [], "w", "d", "v").first().trailing_mean == 284824.0


def test_merge_changes_and_rerun(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    rows = spark.createDataFrame([(1, 2020, None), (2, 2020, 5.0), (3, 2021, 7.0)], "k int, y int, v double")
    assert sinks.write_merge(spark, path, rows, ["k"], ["y", "v"], "y") == 3
    assert sinks.write_merge(spark, path, rows, ["k"], ["y", "v"], "y") == 0
    later = spark.createDataFrame([(1, 2020, 0.0), (3, 2021, 7.0), (4, 2022, 1.0)], "k int, y int, v double")
    assert sinks.write_merge(spark, path, later, ["k"], ["y", "v"], "y") == 2
    got = {r.k: r.v for r in sinks.read_table(spark, path, rows.schema).collect()}
    assert got == {1: 0.0, 2: 5.0, 3: 7.0, 4: 1.0}


def test_merge_moves_a_key_to_another_partition(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    schema = "k int, p string, v int"
    assert sinks.write_merge(spark, path, spark.createDataFrame([(1, "x/ y", 10), (2, "z", 5), (3, "z", 6)], schema), ["k"], ["v"], "p") == 3
    moved = spark.createDataFrame([(1, "y", 11), (2, "z", 7)], schema)
    assert sinks.write_merge(spark, path, moved, ["k"], ["v"], "p") == 2
    assert sorted(map(tuple, sinks.read_table(spark, path, schema).select("k", "p", "v").collect())) == [(1, "y", 11), (2, "z", 7), (3, "z", 6)]
    assert sinks.write_merge(spark, path, moved, ["k"], ["v"], "p") == 0
    with pytest.raises(ValueError, match="several source rows"):
        sinks.write_merge(spark, path, spark.createDataFrame([(9, "y", 1), (9, "y", 2)], schema), ["k"], ["v"], "p")


def test_windowed_builds_write_only_their_window(spark, tmp_path):
    from tidelane.plans import features

    days = spark.createDataFrame([("s", D + timedelta(days=i), float(100 + i % 37)) for i in range(800)], "site_id string, date date, value double")
    rolled = days.select("site_id", "date", F.col("value").alias("value_mean"), F.col("value").alias("value_min"), F.lit("00060").alias("param_code"))
    path = f"file://{tmp_path}/features"
    n = features.write_features(spark, path, rolled, ["site_id"], "2020-06-01", "2020-06-30", features.registry(min_years=2))
    assert n == 30 * 5
    assert features.write_features(spark, path, rolled, ["site_id"], "2020-06-01", "2020-07-01", features.registry(min_years=2)) == 5
    full = features.build_features(rolled, ["site_id"], features.registry(min_years=2)).where("date between '2020-06-01' and '2020-07-01'")
    written = sinks.read_table(spark, path, full.withColumn("year", F.year("date")).schema)
    assert written.select(full.columns).exceptAll(full).isEmpty() and full.count() == written.count()
    weekly = spark.createDataFrame([(D + timedelta(days=7 * i), 100.0 + i) for i in range(40)], "w date, rate double")
    path = f"file://{tmp_path}/targets"
    assert features.write_targets(spark, path, weekly, "w", "rate", "t", "2020-01-01", "2020-01-31") == 5 * 3
    assert features.write_targets(spark, path, weekly, "w", "rate", "t", "2020-01-01", "2020-01-31") == 0
    with pytest.raises(ValueError):
        features.write_targets(spark, path, weekly, "w", "rate", "t", "2020-02-01", "2020-01-31")


def test_a_crash_or_another_writer_leaves_one_version(spark, tmp_path, monkeypatch):
    path, schema = f"file://{tmp_path}/table", "k int, p string, v int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    held = lambda **k: sorted(map(tuple, sinks.read_table(spark, path, schema, **k).select("k", "p", "v").collect()))
    assert held() == []
    sinks.write_merge(spark, path, rows((1, "x", 1), (2, "y", 2)), ["k"], ["v"], "p")
    moved = rows((1, "y", 5), (3, None, 3))

    def crash(*_):
        raise OSError("stopped")

    with monkeypatch.context() as m:  # data is written, the version is not
        m.setattr(sinks, "_commit", crash)
        with pytest.raises(OSError):
            sinks.write_merge(spark, path, moved, ["k"], ["v"], "p")
    assert held() == [(1, "x", 1), (2, "y", 2)]
    real = sinks._commit

    def late(spark, path, version, parts):  # another job commits between this one's reading and its commit
        monkeypatch.setattr(sinks, "_commit", real)
        assert sinks.write_merge(spark, path, rows((9, "x", 9)), ["k"], ["v"], "p") == 1
        real(spark, path, version, parts)

    monkeypatch.setattr(sinks, "_commit", late)
    with pytest.raises(sinks.Conflict):
        sinks.write_merge(spark, path, moved, ["k"], ["v"], "p")
    assert held() == [(1, "x", 1), (2, "y", 2), (9, "x", 9)]
    assert sinks.write_merge(spark, path, moved, ["k"], ["v"], "p") == 2
    after = [(1, "y", 5), (2, "y", 2), (3, None, 3), (9, "x", 9)]
    assert held() == after
    assert held(version=1) == [(1, "x", 1), (2, "y", 2)]
    assert sinks.expire(spark, path) >= 2 and held() == after
    assert sinks.write_merge(spark, path, moved, ["k"], ["v"], "p") == 0


def test_analog_log_keeps_refusals_and_counts_a_batch_once(spark, tmp_path):
    queries, matches = f"file://{tmp_path}/queries", f"file://{tmp_path}/matches"
    q = spark.createDataFrame([("a", "passed"), ("b", "insufficient_analogs")], "query_id string, gate_result string")
    m = spark.createDataFrame([("a", 1, 0.5)], "query_id string, rank int, distance double")
    assert [sinks.append_analogs(queries, matches, q, m, batch) for batch in ("2024/1", "2024/1", "2024/2", "2024/2")] == [2, 0, 2, 0]
    assert sinks.read_batches(spark, queries, queries, q.schema).count() == 4
    assert sinks.read_batches(spark, queries, matches, m.schema).groupBy("query_id").count().collect() == [("a", 2)]


def test_what_was_known_on_a_day(spark):
    rows = spark.createDataFrame([(D + timedelta(days=i),) for i in range(5)], "d date")
    assert reads.through(rows, "d", D + timedelta(days=2)).count() == 3


def test_extracts_of_two_years(spark):
    from tidelane.plans import reports

    weeks = spark.createDataFrame([(date(y, 3, 7 + k), 250.0 + k) for y in (2021, 2022, 2023) for k in (0, 7)], "week_ending date, pct_of_tariff double")
    raw = spark.createDataFrame([(date(2022, 3, 1) + timedelta(days=i), float(i)) for i in range(14)], "date date, value double")
    out = reports.extracts(weeks, raw, raw.withColumn("anomaly", F.col("value") - 100))
    assert list(out) == ["2022_raw.csv", "2022_deseasonalized.csv", "2023_raw.csv", "2023_deseasonalized.csv"]
    assert [tuple(r) for r in out["2022_raw.csv"].collect()] == [(date(2022, 3, 7), 250.0, 3.0), (date(2022, 3, 14), 257.0, 10.0)]
    assert [r.discharge_anomaly for r in out["2022_deseasonalized.csv"].collect()] == [-97.0, -90.0]
    assert [r.discharge for r in out["2023_raw.csv"].collect()] == [None, None]


def test_last_wins_and_window(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, seq int, v string")
    assert {r.k: r.v for r in sinks.last_wins(rows, ["k"], "seq").collect()} == {1: "b", 2: "c"}
    with pytest.raises(ValueError):
        sinks.window_of(rows, "k", "2021-01-02", "2021-01-01")


def test_run_log_counts_have_to_agree(spark, tmp_path):
    runs, rows = f"file://{tmp_path}/runs", f"file://{tmp_path}/rows"
    run = spark.createDataFrame([(1, 2)], "run_id long, grid_size int")
    cells = spark.createDataFrame([(1, "x", None), (1, "y", 0.5)], "run_id long, cell string, q double")
    assert sinks.append_run(runs, rows, run, cells, 2) == 2
    with pytest.raises(ValueError, match="grid is empty"):
        sinks.append_run(runs, rows, run, cells, 0)
    assert sinks.append_run(runs, rows, run, cells, 2) == 0
    second = run.withColumn("run_id", F.lit(2).cast("long")), cells.withColumn("run_id", F.lit(2).cast("long"))
    with pytest.raises(ValueError, match="2 rows for a grid of 3"):
        sinks.append_run(runs, rows, *second, 3)
    logged = lambda: (sinks.read_batches(spark, runs, runs, run.schema).count(), sinks.read_batches(spark, runs, rows, cells.schema).count())
    assert logged() == (1, 2)  # a refused run leaves nothing to be read
    assert sinks.append_run(runs, rows, *second, 2) == 2 and logged() == (2, 4)


def test_extract_writes_null_as_empty(spark, tmp_path):
    sinks.write_extract(spark.createDataFrame([("2022-01-01", None), ("2022-01-08", 0.0)], "w string, v double").coalesce(1), f"file://{tmp_path}/x")
    text = next(tmp_path.joinpath("x").glob("part-*.csv")).read_text()
    assert text == "w,v\n2022-01-01,\n2022-01-08,0.0\n"


def test_tiles_and_known_gaps(spark):
    spans = spark.createDataFrame([("s", date(2020, 1, 1), date(2020, 1, 25))], "k string, a date, b date")
    tiles = incremental.tiles(spans, "k", "a", "b", 10, half_open=False)
    assert [(r.w_start.day, r.w_end.day) for r in tiles.orderBy("w_start").collect()] == [(1, 10), (11, 20), (21, 25)]
    half = incremental.tiles(spans.select("k", F.col("a").cast("timestamp").alias("a"), F.col("b").cast("timestamp").alias("b")), "k", "a", "b", 12, half_open=True)
    assert [(r.w_start.day, r.w_end.day) for r in half.orderBy("w_start").collect()] == [(1, 13), (13, 25)]
    rows = spark.createDataFrame([("s", date(2020, 1, 3)), ("s", date(2020, 1, 25))], "k string, d date")
    cover = incremental.window_coverage(tiles, rows, "k", "d", 10)
    assert [r.n_readings for r in cover.orderBy("w_start").collect()] == [1, 0, 1]
    gaps = lambda a, b: spark.createDataFrame([("s", "dv", date(2020, 1, a), date(2020, 1, b), "n")], "k string, source string, gap_start date, gap_end date, note string")
    assert [r.explained for r in incremental.explain_empty(cover, gaps(11, 20), "k", "dv").collect()] == [True]
    assert [r.explained for r in incremental.explain_empty(cover, gaps(12, 30), "k", "dv").collect()] == [False]
    assert [r.explained for r in incremental.explain_empty(cover, gaps(11, 20), "k", "iv").collect()] == [False]


def test_names_that_a_registry_lacks(spark):
    names = spark.createDataFrame([(x,) for x in "abbcccdd"], "k string")
    registry = spark.createDataFrame([(x,) for x in "bbbbbdddde"], "k string")
    out = series.unregistered(names, registry, "k")
    assert sorted(r.k for r in out.collect()) == ["a", "c"]
    assert [r.k for r in series.unregistered(names.where("k > 'c'"), registry.limit(0), "k").collect()] == ["d"]
    join = out._jdf.queryExecution().optimizedPlan()
    assert [join.nodeName(), *[join.children().apply(i).nodeName() for i in (0, 1)]] == ["Join", "Aggregate", "Aggregate"]  # no repeats meet


def test_since_start(spark):
    reg = spark.createDataFrame([("a",), ("b",)], "k string")
    data = spark.createDataFrame([("a", date(2020, 1, 10))], "k string, d date")
    starts = incremental.poll_starts(incremental.resume_points(reg, data, "k", "d"), F.lit(date(2020, 3, 1)), "7 DAYS", "30 DAYS")
    rows = spark.createDataFrame([("a", date(2020, 1, 2)), ("a", date(2020, 1, 3)), ("b", date(2020, 1, 30)), ("b", date(2020, 1, 31))], "k string, d date")
    assert sorted((r.k, r.d.day) for r in incremental.since_start(rows, starts, "k", "d").collect()) == [("a", 3), ("b", 31)]


def test_reads_refuse(spark):
    df = spark.createDataFrame([(i, f"days_{i}") for i in range(5)], "i int, name string")
    for bad in (0, 5001):
        with pytest.raises(ValueError):
            reads.page(df, ["i"], limit=bad)
    with pytest.raises(ValueError):
        reads.page(df, ["i"], offset=-1)
    with pytest.raises(ValueError):
        reads.date_range(df, "i", date(2020, 1, 2), date(2020, 1, 1))
    with pytest.raises(ValueError):
        reads.date_range(df, "i", date(2010, 1, 1), date(2020, 1, 1))
    with pytest.raises(ValueError):
        reads.date_range(df, "i", None, date(2020, 1, 1))
    with pytest.raises(ValueError):
        reads.alias_value("a", "b")
    with pytest.raises(ValueError):
        reads.require_known(spark.createDataFrame([("z",)], "k string"), spark.createDataFrame([("a",)], "k string"), "k")
    assert [r.i for r in reads.page(df, ["i"], 2, 1).collect()] == [1, 2]
    assert reads.glob(df, "name", "days_[0-2]").count() == 3 and reads.glob(df, "name", "days_[!0-2]").count() == 2 and reads.glob(df, "name", "DAYS*").count() == 0


def test_best_rows(spark):
    rows = spark.createDataFrame([(1, "a", 0.3, False), (1, "b", 0.2, False), (2, "a", 0.01, True), (2, "b", 0.001, False), (2, "c", None, False)], "run_id int, f string, q double, passes_gate boolean")
    out = {(r.run_id, r.f) for r in reads.best_rows(rows, "run_id", "q", ["f"], 1).collect()}
    assert out == {(1, "b"), (2, "a")}


def test_quality(spark):
    rows = spark.createDataFrame([(1, 5.0, 3.0), (2, None, 3.0), (3, 1.0, 2.0)], "k int, lo double, hi double")
    out = quality.violations(rows, {"ordered": F.col("lo") <= F.col("hi"), "small": F.col("hi") < 3}, ["k"]).collect()
    assert {(r.k, r.rule) for r in out} == {(1, "ordered"), (1, "small"), (2, "small")}
    a = quality.fingerprint(rows, "k", "hi", "lo")
    assert quality.same_copy(a, a).first().same and not quality.same_copy(a, quality.fingerprint(rows.where("k > 1"), "k", "hi", "lo")).first().same
