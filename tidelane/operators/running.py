"""Running values of long groups in parts: order inside a part, and what came before it from the parts' totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one part, about.
PART_ROWS = 20_000


def _same(keys: list[str]) -> Column:
    """The keys equal the columns of their names with an underscore; null equals null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return out


def with_part(rows: DataFrame, keys: list[str], order: str, size: int = PART_ROWS) -> DataFrame:
    """rows with part_, a number that ascends with `order` in each of the keys, so that large ones have parts of `size` rows or so.

    order is a finite number. The range of keys with more rows is cut into equal widths, as many as it has times `size`
    rows; where rows crowd at one end parts are uneven, but no result depends on the cut. Smaller keys are one part.
    """
    own = [F.col(k).alias(f"{k}_") for k in keys]
    span = rows.groupBy(*own).agg(F.min(order).alias("low_"), F.max(order).alias("high_"), F.count("*").alias("n_")).where(f"n_ > {size}")
    span = span.withColumn("width_", F.expr(f"greatest((high_ - low_) / (1 + n_ div {size}), 1e-300D)")).drop("high_", "n_")
    near = rows.join(span, _same(keys), "left").withColumn("part_", F.coalesce(F.floor((F.col(order) - F.col("low_")) / F.col("width_")).cast("long"), F.lit(0)))
    return near.drop(*[f"{k}_" for k in keys], "low_", "width_")


def running_sum(rows: DataFrame, keys: list[str], order: str, value: str, out: str, size: int = PART_ROWS) -> DataFrame:
    """rows with out: the sum of value up to and with each row of its keys by order, nulls as 0."""
    parted = with_part(rows, keys, order, size)
    totals = parted.groupBy(*keys, "part_").agg(F.sum(value).alias("sum_"))
    along = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("part_").alias("part__"), F.sum("sum_").over(along).alias("before_"))
    inside = Window.partitionBy(*keys, "part_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parted.withColumn("in_", F.sum(value).over(inside)).join(before, _same(keys) & (F.col("part_") == F.col("part__")))
    summed = summed.withColumn(out, F.coalesce("before_", F.lit(0)) + F.coalesce("in_", F.lit(0)))
    return summed.drop("part_", "part__", "in_", "before_", *[f"{k}_" for k in keys])


def as_of(rows: DataFrame, keys: list[str], order: str, out: str, sure: str, maybe: str | None = None) -> DataFrame:
    """rows with out: what rows of the same keys before this place in order have set, null where nothing has.

    A value in column `sure` overwrites; one in `maybe` holds only where nothing was set before it, so that the last sure
    value counts, or without any the first other one. Rows at one place do not see each other. One window by the keys, no
    range condition.
    """
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.last(sure, True).over(w), F.first(maybe, True).over(w)) if maybe else F.last(sure, True).over(w))
