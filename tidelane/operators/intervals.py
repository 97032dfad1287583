"""Threshold runs, interval subtraction, membership and overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane.operators.phases import ordered, with_phase


def threshold_runs(timeline: DataFrame, thresholds: Column) -> DataFrame:
    """(match_id, phase, start_ms, end_ms) of runs of readings above the threshold of the phase in force.

    A run opens at the first reading above, closes at the first one not above, at a phase click (it belongs to the
    phase before) or at the match's last row of any kind. Missing readings keep it open. `thresholds` is an array by
    phase.
    """
    x = with_phase(timeline).withColumn("end_all", F.max("ts_ms").over(Window.partitionBy("match_id")))
    x = x.withColumn("epoch", F.sum(F.when(F.col("phase").isNotNull(), 1).otherwise(0)).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn(
        "over",
        F.when(F.col("phase").isNotNull(), F.lit(False)).when(F.col("value").isNotNull(), F.col("value") > F.get(thresholds, F.col("now"))),
    ).where("over is not null")
    x = x.withColumn("was", F.coalesce(F.lag("over").over(ordered()), F.lit(False)))
    x = x.where("over <> was or phase is not null")
    x = x.withColumn("end_ms", F.coalesce(F.lead("ts_ms").over(ordered()), F.col("end_all")))
    return x.where("over").select("match_id", F.col("now").alias("phase"), F.col("ts_ms").alias("start_ms"), "end_ms")


def merged_holes(holes: DataFrame) -> DataFrame:
    """(match_id, g, from_ms, to_ms): overlapping and touching holes as one, numbered from 1 in each match."""
    w = Window.partitionBy("match_id").orderBy("from_ms", "to_ms")
    reach = F.max("to_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = holes.where("from_ms <= to_ms").select("match_id", "from_ms", "to_ms", F.coalesce((F.col("from_ms") > reach).cast("int"), F.lit(1)).alias("fresh"))
    x = x.withColumn("g", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("match_id", "g").agg(F.min("from_ms").alias("from_ms"), F.max("to_ms").alias("to_ms"))


def _last_hole(runs: DataFrame, holes: DataFrame, at: str, edge: str, out: str, own_first: bool) -> DataFrame:
    """runs with out: the number of the last hole whose edge is at or before `at` (before it, if own_first), 0 where none is."""
    side = holes.select("match_id", F.col(edge).alias("t_"), F.lit(1 if own_first else 0).alias("o_"), F.col("g").alias("g_"))
    both = runs.withColumn("t_", F.col(at)).withColumn("o_", F.lit(0 if own_first else 1)).unionByName(side, allowMissingColumns=True)
    w = Window.partitionBy("match_id").orderBy("t_", "o_").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn(out, F.coalesce(F.max("g_").over(w), F.lit(0))).where(F.col("g_").isNull())
    return seen.drop("t_", "o_", "g_")


def subtract(runs: DataFrame, holes: DataFrame, least_ms: int = 0) -> DataFrame:
    """runs (match_id, start_ms, end_ms, ...) cut by the match's holes (match_id, from_ms, to_ms), pieces of least_ms or more.

    Holes may overlap and touch, and so may runs; an empty hole parts a run. Runs that holes cover whole vanish, empty
    runs too, and equal runs count once. Two sweeps number the last hole that ends by a run's start and the last one that
    begins before its end; the gaps between holes from the one to the other meet the run by their number.
    """
    merged, far = merged_holes(holes), 2**62
    numbered = _last_hole(_last_hole(runs.distinct(), merged, "start_ms", "to_ms", "low_", False), merged, "end_ms", "from_ms", "high_", True)
    gaps = merged.select("match_id", F.col("g").alias("g_"), F.col("to_ms").alias("after_"), F.lit(None).cast("long").alias("before_"))
    gaps = gaps.unionByName(merged.select("match_id", (F.col("g") - 1).alias("g_"), F.lit(None).cast("long").alias("after_"), F.col("from_ms").alias("before_")))
    gaps = gaps.groupBy("match_id", "g_").agg(F.coalesce(F.max("after_"), F.lit(-far)).alias("after_"), F.coalesce(F.max("before_"), F.lit(far)).alias("before_"))
    pieces = numbered.withColumn("g_", F.explode(F.sequence("low_", F.greatest("low_", "high_")))).join(gaps, ["match_id", "g_"], "left")
    a = F.greatest(F.col("start_ms"), F.coalesce("after_", F.lit(-far)))
    b = F.least(F.col("end_ms"), F.coalesce("before_", F.lit(far)))
    cut = pieces.withColumn("a_", a).withColumn("b_", b).where("b_ > a_").where(F.col("b_") - F.col("a_") >= least_ms)
    kept = [c for c in runs.columns if c not in ("start_ms", "end_ms")]
    return cut.select(*kept, F.col("a_").alias("start_ms"), F.col("b_").alias("end_ms"))


def inside(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """points with `inside`: whether any interval of the match holds ts_ms, ends included. Matches meet by equality.

    Overlapping intervals are merged by their running end, so each point looks at the last start before it alone.
    """
    a = intervals.select("match_id", F.col("start_ms").alias("t_"), F.lit(0).alias("o_"), F.col("end_ms").alias("e_"))
    cols = [F.col(c) for c in points.columns]
    b = points.withColumn("t_", F.col("ts_ms")).withColumn("o_", F.lit(1))
    both = b.unionByName(a, allowMissingColumns=True)
    reach = F.max("e_").over(Window.partitionBy("match_id").orderBy("t_", "o_").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("inside", F.coalesce(reach >= F.col("t_"), F.lit(False))).where("o_ = 1").select(*cols, "inside")


def inside_each(points: DataFrame, intervals: DataFrame, by: str, names: tuple[str, ...], prefix: str) -> DataFrame:
    """points with a flag prefix + name for each name: as inside, for the intervals whose `by` is that name, all in one window."""
    a = intervals.select("match_id", F.col("start_ms").alias("t_"), F.lit(0).alias("o_"), F.col("end_ms").alias("e_"), F.col(by).alias("by_"))
    both = points.withColumn("t_", F.col("ts_ms")).withColumn("o_", F.lit(1)).unionByName(a, allowMissingColumns=True)
    w = Window.partitionBy("match_id").orderBy("t_", "o_").rowsBetween(Window.unboundedPreceding, 0)
    flags = [F.coalesce(F.max(F.when(F.col("by_") == n, F.col("e_"))).over(w) >= F.col("t_"), F.lit(False)).alias(f"{prefix}{n}") for n in names]
    return both.select("*", *flags).where("o_ = 1").select(*points.columns, *[f"{prefix}{n}" for n in names])


def max_overlap(spans: DataFrame) -> DataFrame:
    """(match_id, at, until, depth): the first stretch that most spans cover; ends come before starts at one place."""
    edges = spans.select("match_id", F.col("start_ms").alias("x"), F.lit(1).alias("d")).unionByName(
        spans.select("match_id", F.col("end_ms").alias("x"), F.lit(-1).alias("d"))
    )
    w = Window.partitionBy("match_id").orderBy("x", "d")
    sweep = edges.withColumn("depth", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("x").over(w))
    first = Window.partitionBy("match_id").orderBy(F.col("depth").desc(), "x", F.col("until").asc_nulls_last())
    return sweep.withColumn("n", F.row_number().over(first)).where("n = 1").select("match_id", F.col("x").alias("at"), "until", "depth")
