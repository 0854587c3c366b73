"""Declared schemas; nothing is inferred."""

from __future__ import annotations

GAUGES = "site_id string, name string, river string, available_params array<string>, native_cadence_minutes int, iv_record_start date, dv_record_start date"
KNOWN_GAPS = "site_id string, source string, gap_start date, gap_end date, note string"
INSTANT = "site_id string, ts timestamp, param_code string, value double, qualifiers array<string>"
DAILY = "site_id string, date date, param_code string, stat_cd string, value double, qualifiers array<string>"
RATES = "location string, week_ending date, horizon string, pct_of_tariff decimal(18,6), rate_month int"
MOVEMENTS = "lock string, week_ending date, commodity string, tons decimal(18,6)"
FEATURES = "date date, site_id string, feature_name string, value double, anomaly double, climatology_n_years int"
TARGETS = "week_ending date, target_name string, horizon_days int, value double"
JOB_RUNS = "run_id long, job_name string, started_at timestamp, finished_at timestamp, status string, rows_written long"

#: Bodies of the time-series service: every leaf a string, so that parsing decides what is valid.
SERIES_BODY = (
    "value struct<timeSeries: array<struct<"
    "sourceInfo: struct<siteCode: array<struct<value: string>>>,"
    "variable: struct<variableCode: array<struct<value: string>>, noDataValue: string,"
    " options: struct<option: array<struct<name: string, optionCode: string>>>>,"
    "values: array<struct<value: array<struct<value: string, qualifiers: array<string>, dateTime: string>>>>>>>"
)
RATE_BODY = "date string, location string, rate string, rate_month string"
MOVEMENT_BODY = "date string, lock string, commodity string, tons string"
