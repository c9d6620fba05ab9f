"""Declared schemas and the small dimensions of sources, metrics and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CAPTURE = (
    "release_id long, source_id string, seq long, url string, fetch_url string, captured_at timestamp, status_code int, etag string, last_modified string, "
    "cache_control string, server_date string, body string, response_bytes long, content_hash string, latency struct<total:long,ttfb:long,body_read:long,parse:long>, error string"
)
OBSERVATION = (
    "release_id long, source_id string, seq long, captured_at timestamp, country string, metric_id string, event_name string, row_label string, column_label string, period date, "
    "from_period date, actual double, previous double, forecast double, unit string, seasonality string, value_method string, confidence string, release_date date, sentence string, warnings array<string>"
)
SERIES = "series_id string, period date, level double, direct_mom double, direct_yoy double, footnote string"
SOURCE = "source_id string, name string, url string, source_type string, kind string, priority int, official boolean, is_primary boolean, is_value boolean, confidence string"
METRIC = "metric_id string, event_name string, row_label string, column_label string, number_index int, group_code string, item_code string, kind string, seasonality string, unit string, lo double, hi double, tolerance double"
RELEASE = "release_id long, country string, event_name string, event_time timestamp, tz string, expected_period date, expected_release_date date, lead interval day to second, window interval day to second"
SCHEDULE = "publisher string, reference_period date, release_ts timestamp"
REJECT = "release_id long, source_id string, seq long, stage string, reason string"


def dim_sources(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SOURCE)


def dim_metrics(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, METRIC)


def dim_releases(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RELEASE)


#: The values that each indicator may take.
BOUNDS = {"policy_rate": (-1.0, 25.0), "cpi": (-5.0, 5.0), "ppi": (-50.0, 50.0), "gdp": (-30.0, 30.0), "unemployment": (0.0, 30.0), "core_cpi": (-10.0, 10.0)}
