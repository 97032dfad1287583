"""Readings replayed on another clock, and bounds of the clock from changes that two recordings both show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane import constants as C


def stretched(rows: DataFrame, factor: float) -> DataFrame:
    """rows (match_id, ts_ms) with the time since the match's first row multiplied by factor, rounded to milliseconds."""
    first = F.min("ts_ms").over(Window.partitionBy("match_id"))
    return rows.withColumn("ts_ms", F.round(first + (F.col("ts_ms") - first) * F.lit(float(factor))).cast("long"))


def paused(rows: DataFrame, at: int, length: int, step: int = C.CAPTURE_INTERVAL_MS) -> DataFrame:
    """rows (match_id, seq, ts_ms) with a pause of length ms before each match's row number `at` (from 0, at least 1).

    Rows from there on come later by length; copies of the row before, one each step ms, fill the pause. `copy` is 0
    for a row itself and counts its copies from 1. Matches of no more than `at` rows have no pause.
    """
    w = Window.partitionBy("match_id")
    x = rows.withColumn("n_", F.row_number().over(w.orderBy("ts_ms", "seq")) - 1).withColumn("of_", F.count("*").over(w))
    late = F.when((F.col("of_") > at) & (F.col("n_") >= at), length).otherwise(0)
    copies = F.when((F.col("of_") > at) & (F.col("n_") == at - 1), length // step).otherwise(0)
    x = x.withColumn("ts_ms", F.col("ts_ms") + late).withColumn("copy", F.explode(F.sequence(F.lit(0), copies)))
    return x.withColumn("ts_ms", F.col("ts_ms") + F.col("copy") * step).drop("n_", "of_")


def change_bounds(changes: DataFrame, rows: DataFrame, offset: int = 0, window: int = 2500) -> DataFrame:
    """(match_id, seq, low, high): the offset of rows' clock over changes' clock lies between low and high.

    changes (match_id, seq, old_ms, new_ms, old_key, new_key) were seen between two moments of one clock; rows
    (match_id, seq, ts_ms, key) run on the other one, `offset` ahead by a first guess. The first step of rows from the
    old key to the new one counts, if its start is later than old_ms - window and no later than new_ms + window by
    that guess. A change without such a step has no row, nor have changes from or to null keys. The join is by
    equality of match and both keys.
    """
    w = Window.partitionBy("match_id").orderBy("ts_ms", "seq")
    steps = rows.select("match_id", F.col("key").alias("old_key"), F.lead("key").over(w).alias("new_key"), F.col("ts_ms").alias("from_ms"), F.lead("ts_ms").over(w).alias("until_ms"))
    met = changes.join(steps.where("old_key <> new_key"), ["match_id", "old_key", "new_key"])
    met = met.where((F.col("from_ms") > F.col("old_ms") + (offset - window)) & (F.col("from_ms") <= F.col("new_ms") + (offset + window)))
    first = met.groupBy("match_id", "seq", "old_ms", "new_ms").agg(F.min(F.struct("from_ms", "until_ms")).alias("s"))
    return first.select("match_id", "seq", (F.col("s.from_ms") - F.col("new_ms")).alias("low"), (F.col("s.until_ms") - F.col("old_ms")).alias("high"))


def changes_seen(changes: DataFrame, rows: DataFrame, offset: int = 0, window: int = 2500) -> DataFrame:
    """changes (see change_bounds) with seen: whether rows make the same step near that time."""
    found = change_bounds(changes, rows, offset, window).select("match_id", "seq", F.lit(True).alias("seen_"))
    return changes.join(found, ["match_id", "seq"], "left").withColumn("seen", F.coalesce("seen_", F.lit(False))).drop("seen_")
