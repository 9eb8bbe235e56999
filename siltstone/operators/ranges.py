"""Joins on ranges, by bins: an equi-join that the planner can deal out, then the exact condition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width)).cast("long")


#: A range has its bins at the first level where it touches about so many; a level's bins are as many times as wide as the one's below.
_FAN = 16


def point_in_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs with ``low <= point <= high`` (and equal ``on`` columns). No pair is compared that shares no bin.

    ``width`` should be near the usual range's length: then a range has about two bins. Longer ranges have bins of a wider level, 17 at
    most, and points are looked up at each level that there is, so a long range doesn't become very many rows. A full bin is split by AQE.
    """
    on = on or []
    level = F.greatest(F.ceil(F.log((F.col(high) - F.col(low)) / F.lit(width)) / F.lit(math.log(_FAN))) - 1, F.lit(0)).cast("int")
    r = ranges.where(F.col(low) <= F.col(high)).withColumn("__level", F.when(F.col(high) - F.col(low) > width, level).otherwise(0))
    levels = [x[0] for x in r.select("__level").distinct().collect()] or [0]  # some tens: a number's digits
    scaled = lambda value: F.floor(value / (F.lit(width) * F.pow(F.lit(float(_FAN)), "__level"))).cast("long")
    r = r.withColumn("__bin", F.explode(F.sequence(scaled(F.col(low)), scaled(F.col(high)))))
    p = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__bin", scaled(F.col(point)))
    return p.join(r, [*on, "__level", "__bin"]).where(F.col(point).between(F.col(low), F.col(high))).drop("__level", "__bin")


def overlaps(a: DataFrame, b: DataFrame, a_range: tuple[str, str], b_range: tuple[str, str], width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs whose closed ranges overlap, each pair once: in the first bin that both are in."""
    on = on or []
    sides = []
    for df, (low, high), name in ((a, a_range, "__a"), (b, b_range, "__b")):
        first = _bin(F.col(low), width)
        sides.append(df.where(F.col(low) <= F.col(high)).withColumns({name: first, "__bin": F.explode(F.sequence(first, _bin(F.col(high), width)))}))
    pairs = sides[0].join(sides[1], [*on, "__bin"])
    exact = (F.col(a_range[0]) <= F.col(b_range[1])) & (F.col(b_range[0]) <= F.col(a_range[1])) & (F.col("__bin") == F.greatest("__a", "__b"))
    return pairs.where(exact).drop("__bin", "__a", "__b")


def within_time(a: DataFrame, b: DataFrame, a_time: str, b_time: str, after: str, on: list[str]) -> DataFrame:
    """Pairs with equal ``on`` columns where b comes at most ``after`` later than a; time is cut so that a busy key is many tasks."""
    left = a.withColumn("__w", F.explode(F.array(F.window(a_time, after)["start"], F.window(F.col(a_time) + F.expr(f"INTERVAL {after}"), after)["start"])))
    right = b.withColumn("__w", F.window(b_time, after)["start"])
    return left.join(right, [*on, "__w"]).where(F.col(b_time).between(F.col(a_time), F.col(a_time) + F.expr(f"INTERVAL {after}"))).drop("__w")
