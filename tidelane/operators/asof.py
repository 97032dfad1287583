"""As-of joins by union and carry-forward; no range join is planned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def backward(left: DataFrame, right: DataFrame, value: str, out: str, keys: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """left with the value of the last right row at or before its time, null where none is; ties go to the greater seq.

    Null values of right are carried over.
    """
    r = right.select(*keys, "ts_ms", F.lit(0).alias("side_"), F.col("seq").alias("order_"), F.col(value).alias("carry_"))
    both = left.withColumn("side_", F.lit(1)).withColumn("order_", F.lit(0).cast("long")).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("ts_ms", "side_", "order_").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("carry_", True).over(w)).where("side_ = 1").drop("side_", "order_", "carry_")


def forward_or_last(left: DataFrame, right: DataFrame, value: str, out: str, keys: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """left with the value of the first right row at or after its time, else of the last right row."""
    r = right.select(*keys, "ts_ms", F.lit(1).alias("side_"), F.col("seq").alias("order_"), F.col(value).alias("carry_"))
    both = left.withColumn("side_", F.lit(0)).withColumn("order_", F.lit(0).cast("long")).unionByName(r, allowMissingColumns=True)
    ahead = Window.partitionBy(*keys).orderBy("ts_ms", "side_", "order_").rowsBetween(0, Window.unboundedFollowing)
    back = Window.partitionBy(*keys).orderBy("ts_ms", "side_", "order_").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.coalesce(F.first("carry_", True).over(ahead), F.last("carry_", True).over(back))).where("side_ = 0").drop("side_", "order_", "carry_")


def clock(times: DataFrame, knots: DataFrame, before: float, after: float) -> DataFrame:
    """times (match_id, seq, x) mapped through the match's knots (match_id, x, y): linear between, the end speeds outside.

    At a knot's x the later of two knots with that x holds.
    """
    w = Window.partitionBy("match_id").orderBy("x", "y")
    k = knots.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).withColumn("fx", F.first("x").over(w)).withColumn("fy", F.first("y").over(w))
    carry = k.select("match_id", "x", F.lit(0).alias("side_"), F.struct(F.col("x").alias("kx"), F.col("y").alias("ky"), "nx", "ny").alias("k"), F.struct("fx", "fy").alias("f"), F.col("y").alias("y_"))
    both = times.withColumn("side_", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    order = Window.partitionBy("match_id").orderBy("x", "side_", "y_").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("k", F.last("k", True).over(order)).withColumn("f", F.max("f").over(Window.partitionBy("match_id")))
    kx, ky, nx, ny = (F.col(f"k.{c}") for c in ("kx", "ky", "nx", "ny"))
    y = F.when(F.col("k").isNull(), F.col("f.fy") - (F.col("f.fx") - F.col("x")) * before).when(nx.isNull(), ky + (F.col("x") - kx) * after).otherwise(ky + (ny - ky) * (F.col("x") - kx) / (nx - kx))
    return both.where("side_ = 1").select(*times.columns, y.alias("y"))


def agreement(samples: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """samples with agrees: whether their key is that of the row in effect at their time, or of the one before or after it.

    Null keys agree with nothing; a sample before the first row has none in effect and does not agree.
    """
    w = Window.partitionBy("match_id").orderBy("ts_ms", "seq")
    near = rows.select("match_id", "ts_ms", "seq", F.array(F.col(key), F.lag(key).over(w), F.lead(key).over(w)).alias("near_"))
    found = backward(samples, near, "near_", "keys_")
    return found.withColumn("agrees", F.coalesce(F.exists("keys_", lambda k: k == F.col(key)), F.lit(False))).select(*samples.columns, "agrees")
