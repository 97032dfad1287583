"""Dimension lookups, spatial and key joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A dimension up to this many rows is broadcast.
BROADCAST_ROWS = 100_000


def fits(dim: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return dim.limit(rows + 1).count() <= rows


def small(dim: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """dim, marked for broadcast if it has no more than `rows` rows."""
    return F.broadcast(dim) if fits(dim, rows) else dim


def named(facts: DataFrame, dim: DataFrame, on: list[str], name: str, unknown: Column, amounts: list[str]) -> DataFrame:
    """facts with the dimension's name and amounts; a miss gets `unknown`, zeros and miss = true."""
    found = facts.join(small(dim).withColumn("hit_", F.lit(True)), on, "left")
    out = found.withColumn("miss", F.col("hit_").isNull()).withColumn(name, F.coalesce(F.col(name), unknown))
    for a in amounts:
        out = out.withColumn(a, F.coalesce(F.col(a), F.lit(0)))
    return out.drop("hit_")


def misses(looked_up: DataFrame, on: list[str]) -> DataFrame:
    return looked_up.where("miss").groupBy(*on).agg(F.count("*").alias("n"))


def cells(points: DataFrame, x: str, y: str) -> DataFrame:
    """points with (cx, cy): the decimetre cell, cut towards 0."""
    return points.withColumn("cx", (F.col(x) * 10).cast("long")).withColumn("cy", (F.col(y) * 10).cast("long"))


def around(points: DataFrame) -> DataFrame:
    """points (cx, cy, ...) nine times, with each cell to look in: i = 0 for its own, then those around, x before y from -1."""
    order = [(0, 0)] + [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]
    cell = [F.struct(F.lit(i).alias("i"), (F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for i, (dx, dy) in enumerate(order)]
    return points.withColumn("c_", F.explode(F.array(*cell))).drop("cx", "cy").select("*", "c_.*").drop("c_")


def nearby(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """left (key, cx, cy) with `what` of the right row of its cell, else of the first of the cells around (see around).

    Of several rows in one cell the least `what` counts. Nine cells a row are looked up by equality.
    """
    one = right.groupBy("cx", "cy").agg(F.min(what).alias(what))
    best = around(left.select(key, "cx", "cy")).join(one, ["cx", "cy"]).groupBy(key).agg(F.min_by(what, "i").alias(what))
    return left.join(best, key, "left")


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys)


def compare(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys with expected, actual and correct; null equals null."""
    e, a = expected.select(*keys, F.col(value).alias("expected")), actual.select(*keys, F.col(value).alias("actual"))
    return e.join(a, keys, "full").withColumn("correct", F.col("expected").eqNullSafe(F.col("actual")))


def accuracy(compared: DataFrame, field: str) -> DataFrame:
    """(field, correct, total), with a row `all` for the whole."""
    out = compared.rollup(field).agg(F.sum(F.col("correct").cast("long")).alias("correct"), F.count("*").alias("total"))
    return out.withColumn(field, F.coalesce(F.col(field), F.lit("all")))


def conflicting(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that were given more than one value."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: later duplicates win."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")
