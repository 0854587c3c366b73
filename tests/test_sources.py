"""Landed JSON: every record is a row or a reject with its reason."""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal

import pytest

from tidelane.plans import reports
from tidelane.sources import landed
from tidelane.sources.sinks import read_table
from tidelane.streaming.landing import merge_stream


def body(site, param, points, no_data="-999999.0", options=None):
    variable = {"variableCode": [{"value": param}], "noDataValue": no_data, "options": {"option": options or []}}
    values = [{"value": [{"value": v, "qualifiers": q, "dateTime": t} for v, t, q in points]}]
    return {"sourceInfo": {"siteCode": [{"value": site}]}, "variable": variable, "values": values}


def write(path, *series):
    path.write_text(json.dumps({"value": {"timeSeries": list(series)}}))
    return f"file://{path}"


def test_instantaneous(spark, tmp_path):
    points = [("100.5", "2024-03-10T01:30:00.000-05:00", ["P"]), ("-999999", "2024-03-10T02:00:00.000-05:00", ["P"]), ("7", "2024-03-10T03:00:00", ["A"]), ("x", "2024-03-10T04:00:00Z", None), ("0", "2024-03-10T05:00:00Z", None)]
    raw = landed.series_points(spark, write(tmp_path / "iv.json", body("07032000", "00060", points), body("07010000", "00065", [("5", "2024-01-01T00:00:00Z", None)], no_data="none")))
    out = landed.instantaneous_readings(raw)
    rows = {(r.site_id, r.ts): r.value for r in out.rows.collect()}
    assert rows == {("07032000", datetime(2024, 3, 10, 6, 30)): 100.5, ("07032000", datetime(2024, 3, 10, 5)): 0.0, ("07010000", datetime(2024, 1, 1)): 5.0}
    assert sorted(r.reasons[0] for r in out.rejects.collect()) == ["bad_value", "time_without_offset"]
    wanted = spark.createDataFrame([("07032000", "00060"), ("07374000", "00060")], "site_id string, param_code string")
    assert [r.site_id for r in landed.absent_series(wanted, raw, ["site_id", "param_code"]).collect()] == ["07374000"]
    assert landed.only_requested(out.rows, wanted, ["site_id", "param_code"]).count() == 2


def test_daily(spark, tmp_path):
    option = [{"name": "Agency", "optionCode": "1"}, {"name": " Statistic ", "optionCode": "00003"}]
    good = body("07032000", "00060", [("10", "2024-03-10T00:00:00.000", None), ("-999999", "2024-03-11T00:00:00.000", None), ("12", "2024-03-12T00:00:00.000-05:00", None)], options=option)
    out = landed.daily_readings(landed.series_points(spark, write(tmp_path / "dv.json", good, body("1", "00060", [("1", "2024-03-10", None)]))))
    assert [(r.date, r.stat_cd, r.value) for r in out.rows.collect()] == [(date(2024, 3, 10), "00003", 10.0)]
    assert sorted(r.reasons[0] for r in out.rejects.collect()) == ["date_with_offset", "no_statistic"]


def test_empty_body(spark, tmp_path):
    raw = landed.series_points(spark, write(tmp_path / "none.json"))
    assert landed.instantaneous_readings(raw).rows.count() == 0


def test_rates_tell_absent_zero_and_malformed_apart(spark, tmp_path):
    near = [{"date": "2024-01-06T00:00:00.000", "location": "X", "rate": "312.5000"}, {"date": "2024-01-13T00:00:00.000", "location": "X"}, {"date": "2024-01-20T00:00:00.000", "location": "X", "rate": None}, {"date": "2024-01-27T00:00:00.000", "location": "X", "rate": "0"}, {"date": "2024-02-03T00:00:00.000", "location": "X", "rate": " "}, {"date": "2024-02-10T00:00:00.000", "location": "X", "rate": "n/a"}, {"date": "2024-02-10", "rate": "5"}]
    ahead = [{"date": "2024-01-06T00:00:00.000", "location": "X", "rate": "300", "rate_month": "2"}, {"date": "2024-01-06T00:00:00.000", "location": "Y", "rate": "300", "rate_month": "13"}, {"date": "2024-01-06T00:00:00.000", "location": "Z", "rate": "300"}]
    for name, rows in (("a", near), ("b", ahead)):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    out = landed.rate_records(spark, {"nearby": f"file://{tmp_path}/a.json", "forward_1_month": f"file://{tmp_path}/b.json"})
    got = {(r.week_ending, r.horizon): (r.pct_of_tariff, r.rate_month) for r in out.rows.collect()}
    assert got == {(date(2024, 1, 6), "nearby"): (Decimal("312.5"), None), (date(2024, 1, 13), "nearby"): (None, None), (date(2024, 1, 20), "nearby"): (None, None), (date(2024, 1, 27), "nearby"): (Decimal(0), None), (date(2024, 1, 6), "1_month"): (Decimal(300), 2)}
    assert sorted(r.reasons[0] for r in out.rejects.collect()) == ["bad_rate", "bad_rate", "bad_rate_month", "no_location", "no_rate_month"]
    with pytest.raises(ValueError):
        landed.rate_records(spark, {"unknown": "x"})


def test_movements_and_completeness(spark, tmp_path):
    rows = [{"date": "2024-01-06T00:00:00.000", "lock": "L27", "commodity": "Corn", "tons": "0"}, {"date": "2024-01-06T00:00:00.000", "lock": "L27", "commodity": "Wheat"}, {"date": "2024-01-06T00:00:00.000", "lock": "L27", "commodity": "Soy", "tons": "12.5"}, {"date": "2024-01-06T00:00:00.000", "commodity": "Soy", "tons": "1"}]
    (tmp_path / "m.json").write_text(json.dumps(rows))
    out = landed.movement_records(spark, f"file://{tmp_path}/m.json")
    assert {r.commodity: r.tons for r in out.rows.collect()} == {"Corn": 0, "Wheat": None, "Soy": Decimal("12.5")}
    assert [r.reasons for r in out.rejects.collect()] == [["no_lock"]]
    c = reports.completeness(out.rows, "lock", "tons", zeros=True).first()
    assert (c.n_rows, c.n_null, c.n_zero) == (3, 1, 1)


def test_classified_bodies(spark, tmp_path):
    for name, text in (("rows", '[{"a": 1}]'), ("empty", "[]"), ("error", '{"error": true, "message": "no"}'), ("other", '{"a": 1}'), ("text", "No sites found")):
        (tmp_path / name).write_text(text)
    out = {r.file.rsplit("/", 1)[-1]: r.outcome for r in landed.classify_bodies(spark, f"file://{tmp_path}").collect()}
    assert out == {"rows": "rows", "empty": "empty_page", "error": "error_object", "other": "other_json", "text": "outside_record"}


def test_registry(spark):
    reg = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a"])], "site_id string, available_params array<string>")
    assert landed.requested_pairs(landed.load_gauges(reg, ["1"])).count() == 2
    with pytest.raises(ValueError):
        landed.load_gauges(reg, ["9"])
    with pytest.raises(ValueError):
        landed.load_gauges(reg.limit(0))
    with pytest.raises(ValueError):
        landed.series_values(reg, ["site_id"], "secret", ("value",))


def test_stream_merges_what_landed(spark, tmp_path):
    landing, table, ck = tmp_path / "in", f"file://{tmp_path}/table", f"file://{tmp_path}/ck"
    landing.mkdir()
    args = dict(schema="k int, y int, v double, n int", table=table, keys=["k"], values=["y", "v"], partition="y", seq="n", checkpoint=ck)
    (landing / "1.json").write_text('{"k": 1, "y": 2020, "v": 1.0, "n": 1}\n{"k": 1, "y": 2020, "v": 2.0, "n": 2}\n')
    merge_stream(spark, f"file://{landing}", **args).awaitTermination(120)
    (landing / "2.json").write_text('{"k": 1, "y": 2020, "v": 3.0, "n": 3}\n{"k": 2, "y": 2021, "v": null, "n": 4}\n')
    merge_stream(spark, f"file://{landing}", **args).awaitTermination(120)
    assert {r.k: r.v for r in read_table(spark, table, args["schema"].replace(", n int", "")).collect()} == {1: 3.0, 2: None}
