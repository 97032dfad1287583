"""The panel's layout: a box for each group's total and villagers, and for idle villagers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Pixels of the panel at scale 1.
MARGIN, STEP = 263, 125
GROUPS = ("wood", "food", "gold", "stone", "population")
TOTAL, VILLAGERS, WIDER = (64, 25, 65, 22), (22, 47, 37, 16), 10
IDLE_AFTER, IDLE_Y = 92, 37


def layout(spark: SparkSession) -> DataFrame:
    """(baseline_margin, name, x_px, y_px, w_px, h_px, split_pct): every group is a step right of the one before; the
    population's total is wider, and idle villagers stand behind it."""
    i, last = F.col("i"), F.col("i") == len(GROUPS) - 1
    group = spark.range(len(GROUPS)).select(F.col("id").alias("i"), F.get(F.array(*[F.lit(g) for g in GROUPS]), F.col("id").cast("int")).alias("g"))

    def box(name, x, y, w, h):
        return group.select(
            F.concat("g", F.lit(name)).alias("name"),
            (x + i * STEP).alias("x_px"),
            F.lit(y).alias("y_px"),
            w.alias("w_px"),
            F.lit(h).alias("h_px"),
            F.lit(1.0).alias("split_pct"),
            last.alias("last"),
        )

    totals = box("_total", F.lit(TOTAL[0]), TOTAL[1], F.lit(TOTAL[2]) + F.when(last, WIDER).otherwise(0), TOTAL[3])
    villagers = box("_vils", F.lit(VILLAGERS[0]), VILLAGERS[1], F.lit(VILLAGERS[2]), VILLAGERS[3])
    idle = totals.where("last").select(
        F.lit("idle_vils").alias("name"),
        (F.col("x_px") + IDLE_AFTER).alias("x_px"),
        F.lit(IDLE_Y).alias("y_px"),
        F.lit(VILLAGERS[2]).alias("w_px"),
        F.lit(VILLAGERS[3]).alias("h_px"),
        "split_pct",
        "last",
    )
    boxes = totals.unionByName(villagers).unionByName(idle).drop("last")
    return boxes.select(
        F.lit(MARGIN).alias("baseline_margin"),
        "name",
        *[F.col(c).cast("double").alias(c) for c in ("x_px", "y_px", "w_px", "h_px", "split_pct")],
    )


def write_layout(boxes: DataFrame, path: str) -> None:
    """One JSON document in the form that read_ui_map reads."""
    element = F.struct("x_px", "y_px", "w_px", "h_px", "split_pct")
    one = boxes.groupBy("baseline_margin").agg(F.map_from_entries(F.collect_list(F.struct("name", element))).alias("elements"))
    one.coalesce(1).write.mode("overwrite").json(path)
