"""Percentiles, fits and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane.operators import running


def lower_percentiles(rows: DataFrame, keys: list[str], value: str, percents: dict[str, int], size: int = running.PART_ROWS) -> DataFrame:
    """(keys, a column for each of percents): the element at (n - 1) * percent div 100 of the sorted values of the keys.

    Values are counted, counts are summed along the values in parts, and the value at which the sum passes the rank is
    picked: no task holds all values of a key. Nulls are no values; keys without any have null. Values are finite numbers.
    """
    counts = rows.groupBy(*keys, value).agg(F.when(F.col(value).isNotNull(), F.count("*")).otherwise(0).alias("n_"))
    totals = counts.groupBy(*keys).agg(F.sum("n_").alias("all_"))
    summed = running.running_sum(counts.where(F.col(value).isNotNull()), keys, value, "n_", "up_to_", size)
    renamed = totals.select(*[F.col(k).alias(f"{k}_") for k in keys], "all_")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    ranks = {out: F.expr(f"((all_ - 1) * {percent}) div 100") for out, percent in percents.items()}
    here = {out: (F.col("up_to_") - F.col("n_") <= rank) & (rank < F.col("up_to_")) for out, rank in ranks.items()}
    picked = [F.max(F.when(hit, F.col(value))).alias(out) for out, hit in here.items()]
    found = renamed.join(summed, same, "left").groupBy(*[f"{k}_" for k in keys]).agg(*picked)
    return found.select(*[F.col(f"{k}_").alias(k) for k in keys], *percents)


def quarter_medians(rows: DataFrame, value: str) -> DataFrame:
    """(match_id, quarter 0 to 3, median): lower medians by quarter of the match's time; null for a quarter without rows."""
    last = F.max("ts_ms").over(Window.partitionBy("match_id"))
    x = rows.withColumn("last", last).withColumn("quarter", F.expr("cast(least(ts_ms * 4 div greatest(last, 1), 3) as int)"))
    found = lower_percentiles(x, ["match_id", "quarter"], value, {"median": 50})
    grid = rows.select("match_id").distinct().withColumn("quarter", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return grid.join(found, ["match_id", "quarter"], "left")


def least_squares(pairs: DataFrame) -> DataFrame:
    """(match_id, slope, intercept) of y over x; slope 1 where x does not vary."""
    fit = pairs.groupBy("match_id").agg(F.regr_slope("y", "x").alias("b"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    slope = F.coalesce("b", F.lit(1.0))
    return fit.select("match_id", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def anchored_slope(pairs: DataFrame) -> DataFrame:
    """(match_id, slope) of the line through the origin."""
    return pairs.groupBy("match_id").agg((F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("slope"))


def hough(votes: DataFrame, speeds: list[float], bin_ms: float) -> DataFrame:
    """(match_id, speed_no, bin, score): each match's best line y = offset + x / speed by weighted votes over offsets.

    A bin's score is its own and its two neighbours' weight. Ties go to the slower speed and the lower bin.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("speed_no"), F.lit(s).alias("speed")) for i, s in enumerate(speeds)])).alias("g")
    x = votes.select("match_id", "x", "y", "w", grid).withColumn("bin", F.floor((F.col("y") - F.col("x") / F.col("g.speed")) / bin_ms))
    # each vote counts in its bin's score and its neighbours'
    spread = x.select("match_id", F.col("g.speed_no").alias("speed_no"), "bin", "w", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"))
    scores = spread.groupBy("match_id", "speed_no", (F.col("bin") + F.col("d")).alias("bin")).agg(F.sum("w").alias("score"), F.max(F.col("d") == 0).alias("own")).where("own")
    best = Window.partitionBy("match_id").orderBy(F.col("score").desc(), "speed_no", "bin")
    return scores.withColumn("n", F.row_number().over(best)).where("n = 1").select("match_id", "speed_no", "bin", "score")


def vote_mode(votes: DataFrame) -> DataFrame:
    """(match_id, centre, n): the commonest bin and the weighted centre of it and its neighbours; one vote a sample and bin."""
    n = votes.select("match_id", "sample", "bin").distinct().groupBy("match_id", "bin").agg(F.count("*").alias("n"))
    best = n.withColumn("r", F.row_number().over(Window.partitionBy("match_id").orderBy(F.col("n").desc(), "bin"))).where("r = 1")
    near = n.alias("n").join(best.select("match_id", F.col("bin").alias("top"), F.col("n").alias("most")).alias("b"), "match_id").where("n.bin between top - 1 and top + 1")
    return near.groupBy("match_id").agg((F.sum(F.col("n.bin") * F.col("n.n")) / F.sum("n.n")).alias("centre"), F.max("most").alias("n"))


def anchored_windows(rows: DataFrame, size_ms: int, step_ms: int) -> DataFrame:
    """(match_id, window, first_ms, n): overlapping windows counted from the match's first row, none after the one that reaches its last."""
    all_ = Window.partitionBy("match_id")
    x = rows.withColumn("t0", F.min("ts_ms").over(all_)).withColumn("t1", F.max("ts_ms").over(all_))
    at = F.col("ts_ms") - F.col("t0")
    hi = F.expr(f"(ts_ms - t0) div {step_ms}")
    lo = F.greatest(F.lit(0).cast("long"), F.floor((at - size_ms) / step_ms) + 1)
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0") - size_ms) / step_ms) + 1)
    x = x.withColumn("lo", lo).withColumn("hi", F.least(hi, last)).where("lo <= hi").withColumn("window", F.explode(F.sequence("lo", "hi")))
    return x.groupBy("match_id", "window").agg((F.min("t0") + F.col("window") * step_ms).alias("first_ms"), F.count("*").alias("n"))
