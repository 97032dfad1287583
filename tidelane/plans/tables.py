"""The driver's tables as the engine's: a user is a match, events are readings, spends and phase clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, seq, ts_ms, kind, amount): the clock is read without any time zone."""
    second = F.expr("extract(second from ts)")
    ms = F.unix_date(F.to_date("ts")).cast("long") * 86_400_000 + F.hour("ts") * 3_600_000 + F.minute("ts") * 60_000 + F.floor(second * 1000).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("match_id"), F.col("event_id").alias("seq"), ms.alias("ts_ms"), F.col("event_type").alias("kind"), F.col("value").alias("amount"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks read floor(value); an error is a reading that failed."""
    e = events(spark, sf_dir).where("kind in ('view', 'click', 'error')")
    return e.withColumn("value", F.when(F.col("kind") != "error", F.floor("amount").cast("long")))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups are clicks of phase 1 to 3."""
    return events(spark, sf_dir).where("kind = 'signup'").withColumn("phase", (F.col("seq") % 3 + 1).cast("int"))


def spends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("kind = 'purchase'").withColumn("cost", F.floor("amount").cast("long"))


#: The same tables for SQL.
CTE = """WITH ev AS (
  SELECT user_id AS match_id, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, event_type AS kind, value AS amount FROM events),
rd AS (SELECT *, CASE WHEN kind <> 'error' THEN CAST(floor(amount) AS BIGINT) END AS value FROM ev WHERE kind IN ('view', 'click', 'error')),
ck AS (SELECT *, CAST(seq % 3 + 1 AS INTEGER) AS phase FROM ev WHERE kind = 'signup'),
ef AS (SELECT * FROM ck QUALIFY ts_ms = max(ts_ms) OVER (PARTITION BY match_id, phase)),
sp AS (SELECT *, CAST(floor(amount) AS BIGINT) AS cost FROM ev WHERE kind = 'purchase'),
tl0 AS (
  SELECT match_id, ts_ms, 0 AS rank, seq, NULL::BIGINT AS value, phase FROM ef
  UNION ALL SELECT match_id, ts_ms, 1, seq, value, NULL FROM rd),
tl AS (
  SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY ts_ms, rank, seq ROWS UNBOUNDED PRECEDING) AS cur,
    last_value(value IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY ts_ms, rank, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old,
    coalesce(last_value(phase IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY ts_ms, rank, seq ROWS UNBOUNDED PRECEDING), 0) AS now,
    max(ts_ms) OVER (PARTITION BY match_id) AS end_all FROM tl0),
seg AS (
  SELECT match_id, ts_ms AS start_ms, coalesce(lead(ts_ms) OVER w, end_all) AS end_ms, cur AS value, now AS phase,
    CASE WHEN lead(ts_ms) OVER w IS NULL THEN 'end' WHEN lead(phase) OVER w IS NOT NULL THEN 'phase' ELSE 'value' END AS end_reason
  FROM tl WHERE (value IS NOT NULL AND value IS DISTINCT FROM old) OR (phase IS NOT NULL AND cur IS NOT NULL)
  WINDOW w AS (PARTITION BY match_id ORDER BY ts_ms, rank, seq)),
nb AS (
  SELECT *, coalesce(prev = next AND value <> prev, false) AS glitch FROM (
    SELECT match_id, seq, ts_ms, value, lag(value) OVER w AS prev, lead(value) OVER w AS next, lag(ts_ms) OVER w AS prev_ts
    FROM rd WHERE value IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY ts_ms, seq))),
nb2 AS (SELECT *, coalesce(lag(glitch) OVER (PARTITION BY match_id ORDER BY ts_ms, seq), false) AS was_glitch FROM nb),
ov AS (
  SELECT match_id, ts_ms, rank, seq, phase, now, end_all, CASE WHEN phase IS NOT NULL THEN false ELSE value > [60, 50, 40, 30][now + 1] END AS over
  FROM tl WHERE phase IS NOT NULL OR value IS NOT NULL),
ov2 AS (SELECT *, coalesce(lag(over) OVER (PARTITION BY match_id ORDER BY ts_ms, rank, seq), false) AS was FROM ov),
run AS (
  SELECT match_id, phase, start_ms, end_ms FROM (
    SELECT match_id, now AS phase, ts_ms AS start_ms, over, coalesce(lead(ts_ms) OVER (PARTITION BY match_id ORDER BY ts_ms, rank, seq), end_all) AS end_ms
    FROM ov2 WHERE over <> was OR phase IS NOT NULL) WHERE over),
hole0 AS (SELECT match_id, ts_ms - 14400000 AS a, ts_ms AS b FROM ck),
hole1 AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY match_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hole0),
hole2 AS (SELECT *, sum(fresh) OVER (PARTITION BY match_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM hole1),
hole AS (SELECT match_id, min(a) AS a, max(b) AS b FROM hole2 GROUP BY match_id, g),
touch AS (SELECT r.*, h.a, h.b FROM run r LEFT JOIN hole h ON h.match_id = r.match_id AND h.b > r.start_ms AND h.a < r.end_ms),
gap AS (
  SELECT match_id, phase, start_ms AS s0, end_ms AS e0, start_ms, coalesce(min(a), end_ms) AS end_ms FROM touch GROUP BY match_id, phase, start_ms, end_ms
  UNION ALL
  SELECT match_id, phase, start_ms, end_ms, b, coalesce(lead(a) OVER (PARTITION BY match_id, phase, start_ms, end_ms ORDER BY a), end_ms) FROM touch WHERE b IS NOT NULL),
piece AS (SELECT match_id, phase, greatest(start_ms, s0) AS start_ms, least(end_ms, e0) AS end_ms FROM gap WHERE greatest(start_ms, s0) < least(end_ms, e0))
"""
