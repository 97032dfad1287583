"""Costs and how well a drop pays them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity(cost: list[Column], delta: list[Column], fraction: float = 0.4) -> Column:
    """1 for exactly the cost; null where a charged resource fell by less than fraction of it, or nothing is charged."""
    num, den, ok = F.lit(0.0), F.lit(0.0), F.lit(True)
    for c, d in zip(cost, delta, strict=True):
        need = c > 0
        ok = ok & (~need | (d >= fraction * c))
        num = num + F.when(need, c * F.least(c, d).cast("double") / F.greatest(c, d)).otherwise(0.0)
        den = den + F.when(need, c.cast("double")).otherwise(0.0)
    return F.when(ok & (den > 0), num / den)


def is_spend(cost: list[Column]) -> Column:
    out = F.lit(False)
    for c in cost:
        out = out | F.coalesce(c > 0, F.lit(False))
    return out


def wall_cost(per_tile: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Upper bound of a wall's cost: tiles along the longer side."""
    return per_tile * (F.greatest(F.abs(x2 - x1), F.abs(y2 - y1)) + 1)


def market_sale(code: Column, hundreds: Column) -> Column:
    """What a sale takes: struct(name, food, wood, stone); another code is Unknown and takes nothing."""
    amount = (hundreds * 100).cast("long")
    take = lambda k: F.when(code == k, amount).otherwise(F.lit(0).cast("long"))
    name = F.when(code == 0, "food").when(code == 1, "wood").when(code == 2, "stone").otherwise("Unknown")
    return F.struct(name.alias("name"), take(0).alias("food"), take(1).alias("wood"), take(2).alias("stone"))
