"""Queries that run as streams over the given tables, and the folder scan."""

from __future__ import annotations

from corvida.session import load
from corvida.sources import files
from corvida.streaming import metrics


def _stream(spark, d, name):
    return spark.readStream.schema(load(spark, d, name).schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


def stream_hourly_metrics(spark, d):
    return metrics.hourly_complete(_stream(spark, d, "events"))


def stream_settle_once(spark, d):
    return metrics.settle_once(_stream(spark, d, "evidence_pointers").select("pointer_id"), ["pointer_id"])


def scan_folder(spark, d):
    """Files of the data folder but for partial ones; a table kept as a folder is none."""
    return files.scan_folder(spark, d, rules=["*.crc", "_*"]).select("name", "media_type", "held")


SQL = {
    "stream_settle_once": "SELECT DISTINCT pointer_id FROM evidence_pointers",
    "stream_hourly_metrics": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2",
}
QUERIES = {f.__name__: f for f in (stream_hourly_metrics, stream_settle_once, scan_folder)}
