"""Drops, glitches, spikes and broken invariants of reading series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane.operators import asof


def neighbours(series: DataFrame) -> DataFrame:
    """series (match_id, ts_ms, seq, value, not null) with prev, next, prev_ts and glitch: A-B-A, where B is a misread."""
    w = Window.partitionBy("match_id").orderBy("ts_ms", "seq")
    x = series.where("value is not null").withColumn("prev", F.lag("value").over(w)).withColumn("next", F.lead("value").over(w)).withColumn("prev_ts", F.lag("ts_ms").over(w))
    return x.withColumn("glitch", F.coalesce((F.col("prev") == F.col("next")) & (F.col("value") != F.col("prev")), F.lit(False)))


def drops(series: DataFrame, gap_ms: int) -> DataFrame:
    """(match_id, seq, at_ms, slack_ms, delta): falls between readings at most gap_ms apart of which none is a glitch."""
    w = Window.partitionBy("match_id").orderBy("ts_ms", "seq")
    x = neighbours(series).withColumn("was_glitch", F.coalesce(F.lag("glitch").over(w), F.lit(False)))
    x = x.where((F.col("value") < F.col("prev")) & (F.col("ts_ms") - F.col("prev_ts") <= gap_ms) & ~F.col("glitch") & ~F.col("was_glitch"))
    return x.select(
        "match_id",
        "seq",
        ((F.col("prev_ts") + F.col("ts_ms")) / 2.0).alias("at_ms"),
        ((F.col("ts_ms") - F.col("prev_ts")) / 2.0).alias("slack_ms"),
        (F.col("prev") - F.col("value")).alias("delta"),
    )


def is_spike(by: int) -> Column:
    """Of neighbours: whether a reading is more than `by` below both neighbours or above both; not where it lacks one."""
    low, high = F.least("prev", "next"), F.greatest("prev", "next")
    both = F.col("prev").isNotNull() & F.col("next").isNotNull()
    return both & ((F.col("value") + by < low) | (F.col("value") > high + by))


def spikes(series: DataFrame, by: int) -> DataFrame:
    """Readings more than `by` below both neighbours or above both."""
    return neighbours(series).where(is_spike(by)).select("match_id", "seq", "ts_ms", "prev", "value", "next")


def merged_drops(rows: DataFrame, columns: list[str], gap_ms: int) -> DataFrame:
    """(match_id, seq, at_ms, slack_ms, a fall of each column, 0 where it did not fall): a row for each reading with a drop.

    Each column falls between its own readings (see drops); a reading's falls are one row, which lies between it and
    the latest of the readings that its columns fell from.
    """
    w = Window.partitionBy("match_id").orderBy("ts_ms", "seq")
    part = None
    for c in columns:
        x = neighbours(
            rows.select("match_id", "seq", "ts_ms", F.col(c).alias("value"))
        ).withColumn("was_glitch", F.coalesce(F.lag("glitch").over(w), F.lit(False)))
        x = x.where((F.col("value") < F.col("prev")) & (F.col("ts_ms") - F.col("prev_ts") <= gap_ms) & ~F.col("glitch") & ~F.col("was_glitch"))
        x = x.select("match_id", "seq", "ts_ms", "prev_ts", *[(F.col("prev") - F.col("value") if k == c else F.lit(0)).cast("long").alias(k) for k in columns])
        part = x if part is None else part.unionByName(x)
    one = part.groupBy("match_id", "seq", "ts_ms").agg(F.max("prev_ts").alias("prev_ts"), *[F.sum(c).alias(c) for c in columns])
    return one.select(
        "match_id",
        "seq",
        ((F.col("prev_ts") + F.col("ts_ms")) / 2.0).alias("at_ms"),
        ((F.col("ts_ms") - F.col("prev_ts")) / 2.0).alias("slack_ms"),
        *columns,
    )


def large_increases(series: DataFrame, refunds: DataFrame, by: int, before_ms: int, after_ms: int) -> DataFrame:
    """Rises above `by` after a reading that is no glitch, without a refund from before_ms before to after_ms after.

    The last refund up to after_ms after each rise is carried to it; the rise stays if that one is too old.
    """
    w = Window.partitionBy("match_id").orderBy("ts_ms", "seq")
    x = neighbours(series).withColumn(
        "was_glitch",
        F.coalesce(F.lag("glitch").over(w), F.lit(False)),
    ).where((F.col("value") > F.col("prev") + by) & ~F.col("was_glitch"))
    rise = x.select("match_id", "seq", F.col("ts_ms").alias("at_"), (F.col("ts_ms") + after_ms).alias("ts_ms"), (F.col("value") - F.col("prev")).alias("rise"))
    back = refunds.select("match_id", "ts_ms", F.lit(0).cast("long").alias("seq"), F.col("ts_ms").alias("refund_"))
    had = asof.backward(rise, back, "refund_", "last_")
    return had.where(F.col("last_").isNull() | (F.col("last_") < F.col("at_") - before_ms)).select("match_id", "seq", F.col("at_").alias("ts_ms"), "rise")


def invariant_runs(rows: DataFrame, broken: Column) -> DataFrame:
    """(match_id, first_ms, frames) of runs of rows where `broken` is true; a null ends a run."""
    w = Window.partitionBy("match_id").orderBy("ts_ms", "seq")
    x = rows.withColumn("bad", F.coalesce(broken, F.lit(False))).withColumn("n", F.row_number().over(w))
    x = x.where("bad").withColumn("island", F.col("n") - F.row_number().over(w))
    return x.groupBy("match_id", "island").agg(F.min("ts_ms").alias("first_ms"), F.count("*").alias("frames")).drop("island")


def frozen_runs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(match_id, n, ts_ms, run): the rows numbered in order, and the number of the row that began each one's frozen run.

    A run goes on while no column shows another value than it has shown since the run began; nulls fit any. A row
    differs from what its columns showed last; `late` is the latest of those rows that it differs from. It ends every run
    that began by then, so one that differs from the row before it begins a run for certain. Between such rows, which
    cut a match into stretches, a fold over the few that differ from an earlier one decides.
    """
    w = Window.partitionBy("match_id").orderBy("ts_ms", "seq")
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    x = rows.select("match_id", "seq", "ts_ms", *columns).withColumn("n", F.row_number().over(w))
    x = x.withColumns({f"last_{c}": F.last(F.when(F.col(c).isNotNull(), F.struct("n", F.col(c).alias("v"))), True).over(back) for c in columns})
    differs = [F.when(F.col(c) != F.col(f"last_{c}.v"), F.col(f"last_{c}.n")) for c in columns]
    x = x.select("match_id", "n", "ts_ms", F.array_max(F.array(*differs)).alias("late"))
    sure = (F.col("n") == 1) | F.coalesce(F.col("late") == F.col("n") - 1, F.lit(False))
    x = x.withColumn("from", F.max(F.when(sure, F.col("n"))).over(Window.partitionBy("match_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    # in each stretch: a row begins a run if the one before it had begun by `late`
    ends = x.where("late >= from").groupBy("match_id", "from").agg(F.sort_array(F.collect_list(F.struct("n", "late"))).alias("ends"))
    step = lambda starts, e: F.when(F.element_at(starts, -1) <= e["late"], F.concat(starts, F.array(e["n"]))).otherwise(starts)
    starts = ends.select("match_id", F.explode(F.aggregate("ends", F.array("from"), step)).alias("start"))
    starts = starts.unionByName(x.where("n = from").select("match_id", F.col("n").alias("start"))).distinct().select("match_id", F.col("start").alias("n"), F.lit(True).alias("fresh"))
    marked = x.join(starts, ["match_id", "n"], "left")
    over = Window.partitionBy("match_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select("match_id", "n", "ts_ms", F.max(F.when(F.col("fresh"), F.col("n"))).over(over).alias("run"))


def longest_frozen(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(match_id, from_ms, to_ms) of each match's longest stretch without a changed number, the first of equals; none without length."""
    spans = frozen_runs(rows, columns).groupBy("match_id", "run").agg(F.min("ts_ms").alias("from_ms"), F.max("ts_ms").alias("to_ms"))
    best = spans.groupBy("match_id").agg(F.max_by(F.struct("from_ms", "to_ms"), F.struct(F.col("to_ms") - F.col("from_ms"), -F.col("run"))).alias("x"))
    return best.select("match_id", "x.*").where("to_ms > from_ms")


def sharp_change(rows: DataFrame, totals: list[str], counts: list[str], jump: int, count_jump: int) -> DataFrame:
    """rows with `changed`: the first field, in the given order, that moved by its jump or appeared or disappeared."""
    w = Window.partitionBy("match_id").orderBy("ts_ms", "seq")
    first = F.row_number().over(w) == 1
    tests = []
    for names, least in ((totals, jump), (counts, count_jump)):
        for c in names:
            old = F.lag(c).over(w)
            tests.append(F.when((F.col(c).isNull() != old.isNull()) | (F.abs(F.col(c) - old) >= least), F.lit(c)))
    return rows.withColumn("changed", F.when(~first, F.coalesce(*tests)))
