"""Phase tracking and segments of constant value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered(*order: str):
    """One match's rows in time order, up to the current one."""
    return Window.partitionBy("match_id").orderBy(*(order or ("ts_ms", "rank", "seq")))


def last_clicks(clicks: DataFrame) -> DataFrame:
    """(match_id, phase, ts_ms): the last click of each phase."""
    return clicks.groupBy("match_id", "phase").agg(F.max("ts_ms").alias("ts_ms"))


def effective_clicks(clicks: DataFrame) -> DataFrame:
    """Clicks at the time of their phase's last one; two in the same millisecond both count."""
    last = Window.partitionBy("match_id", "phase")
    return clicks.withColumn("last_", F.max("ts_ms").over(last)).where("ts_ms = last_").drop("last_")


def merged(readings: DataFrame, clicks: DataFrame) -> DataFrame:
    """The timeline (match_id, ts_ms, rank, seq, value, phase): clicks come before readings of the same time."""
    a = clicks.select("match_id", "ts_ms", F.lit(0).alias("rank"), "seq", F.lit(None).cast("long").alias("value"), F.col("phase").cast("int").alias("phase"))
    b = readings.select("match_id", "ts_ms", F.lit(1).alias("rank"), "seq", F.col("value").cast("long").alias("value"), F.lit(None).cast("int").alias("phase"))
    return a.unionByName(b)


def with_phase(timeline: DataFrame) -> DataFrame:
    """timeline with `now`, the phase in force at each row; 0 before any click."""
    return timeline.withColumn("now", F.coalesce(F.last("phase", True).over(ordered().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))


def segments(timeline: DataFrame) -> DataFrame:
    """(match_id, start_ms, end_ms, value, phase, end_reason) of runs of one value, cut at phase clicks.

    Missing readings neither end nor start a run. A click before the first value sets the phase alone. The last
    segment ends with the match's last row of any kind; segments without length stay.
    """
    upto, before = ordered().rowsBetween(Window.unboundedPreceding, 0), ordered().rowsBetween(Window.unboundedPreceding, -1)
    x = with_phase(timeline).withColumn("cur", F.last("value", True).over(upto)).withColumn("old", F.last("value", True).over(before))
    x = x.withColumn("end_all", F.max("ts_ms").over(Window.partitionBy("match_id")))
    change = F.col("value").isNotNull() & ~F.col("value").eqNullSafe(F.col("old"))
    cut = F.col("phase").isNotNull() & F.col("cur").isNotNull()
    x = x.where(change | cut)
    after = ordered()
    reason = F.when(F.lead("ts_ms").over(after).isNull(), "end").when(F.lead("phase").over(after).isNotNull(), "phase").otherwise("value")
    return x.select(
        "match_id",
        F.col("ts_ms").alias("start_ms"),
        F.coalesce(F.lead("ts_ms").over(after), F.col("end_all")).alias("end_ms"),
        F.col("cur").alias("value"),
        F.col("now").alias("phase"),
        reason.alias("end_reason"),
    )


def weighted_by_phase(cut: DataFrame) -> DataFrame:
    """(match_id, phase, weighted_s): seconds times value; milliseconds are summed as integers and divided once."""
    ms = (F.col("end_ms") - F.col("start_ms")) * F.col("value")
    return cut.groupBy("match_id", "phase").agg((F.sum(ms) / 1000.0).alias("weighted_s"))


def status_pivot(cut: DataFrame, status: str, names: list[str]) -> DataFrame:
    """(match_id, phase, <name>_ms...): time in each status; 0 where there is none."""
    ms = F.col("end_ms") - F.col("start_ms")
    return cut.groupBy("match_id", "phase").agg(*[F.coalesce(F.sum(F.when(F.col(status) == n, ms)), F.lit(0)).alias(f"{n}_ms") for n in names])
