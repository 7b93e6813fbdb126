"""Spheres, grid joins and nearest points in three dimensions."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolith.functions import maths


def cells_covering(origin: tuple[float, float, float], radius: float) -> list[int]:
    """Cells of the box around a sphere."""
    low = [math.floor((v - radius) / maths.CELL) + maths.HALF for v in origin]
    high = [math.floor((v + radius) / maths.CELL) + maths.HALF for v in origin]
    return [(a * maths.SPAN + b) * maths.SPAN + c for a in range(low[0], high[0] + 1) for b in range(low[1], high[1] + 1) for c in range(low[2], high[2] + 1)]


def in_sphere(origin: tuple[float, float, float], radius: float, cell: str | None = None, most_cells: int = 2000) -> Column:
    """Whether (x, y, z) lies in a sphere, its border included: cells and box prune partitions and
    row groups, the squared distance decides. Null coordinates are outside."""
    x, y, z = (F.col(c) for c in "xyz")
    box = x.between(origin[0] - radius, origin[0] + radius) & y.between(origin[1] - radius, origin[1] + radius) & z.between(origin[2] - radius, origin[2] + radius)
    test = box & (maths.d2(x, y, z, *origin) <= radius * radius)
    if cell and len(cells := cells_covering(origin, radius)) <= most_cells:
        test = F.col(cell).isin(cells) & test
    return test


def within(points: DataFrame, origin: tuple[float, float, float], radius: float, limit: int | None = None, key: str = "address") -> DataFrame:
    """Points in a sphere, nearest first, with ``distance_ly`` and whether the limit cut some."""
    found = points.where(in_sphere(origin, radius)).withColumn("distance_ly", maths.distance(F.col("x"), F.col("y"), F.col("z"), *origin))
    if limit is None:
        return found
    head = found.orderBy("distance_ly", key).limit(limit + 1)
    order = Window.orderBy("distance_ly", key)  # over limit + 1 rows at most
    ranked = head.withColumn("__rank", F.row_number().over(order))
    return ranked.withColumn("truncated", F.max("__rank").over(Window.partitionBy()) > limit).where(F.col("__rank") <= limit).drop("__rank")


def grid_join(left: DataFrame, right: DataFrame, radius: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points at most ``radius`` apart that agree in ``on``. Points meet in grid cells as
    wide as the radius, the right side in its own cell, the left side in that cell and its 26
    neighbours, so each pair meets once. Coordinates are x, y, z; the right side's columns get ``_r``."""
    at = lambda p, c: F.floor(F.col(p) / radius).cast("long").alias(c)
    step = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip("abc", s))) for s in itertools.product((-1, 0, 1), repeat=3)))
    near = left.withColumn("__step", F.explode(step))
    moved = [(F.floor(F.col(p) / radius).cast("long") + F.col(f"__step.{c}")).alias(n) for p, c, n in (("x", "a", "gx"), ("y", "b", "gy"), ("z", "c", "gz"))]
    near = near.select(*left.columns, *moved)
    other = right.select(*(F.col(c) if c in on else F.col(c).alias(f"{c}_r") for c in right.columns))
    other = other.select("*", at("x_r", "gx"), at("y_r", "gy"), at("z_r", "gz"))
    pairs = near.join(other, [*on, "gx", "gy", "gz"]).drop("gx", "gy", "gz")
    d2 = maths.d2(*(F.col(c) for c in ("x", "y", "z", "x_r", "y_r", "z_r")))
    return pairs.where(d2 <= radius * radius).withColumn("distance_ly", F.sqrt(d2))


def absent_near(points: DataFrame, known: DataFrame, within_ly: float = 0.1) -> DataFrame:
    """Points with no known point at less than ``within_ly``."""
    here = points.withColumn("__id", F.monotonically_increasing_id()) if "__id" not in points.columns else points
    hits = grid_join(here, known.select("x", "y", "z"), within_ly).where(F.col("distance_ly") < within_ly).select("__id").distinct()
    return here.join(hits, "__id", "left_anti").drop("__id")


def toward(points: DataFrame, start: tuple[float, float, float], goal: tuple[float, float, float], radius: float, spread: float = 0.5) -> DataFrame:
    """Points in reach of ``start`` inside the cone to ``goal`` (cosine of at least ``spread``)."""
    along = [g - s for g, s in zip(goal, start)]
    size = math.sqrt(sum(v * v for v in along)) or 1.0
    away = [F.col(c) - s for c, s in zip("xyz", start)]
    reach = F.sqrt(sum((v * v for v in away), F.lit(0.0)))
    cosine = sum((v * (a / size) for v, a in zip(away, along)), F.lit(0.0)) / reach
    return points.where(in_sphere(start, radius)).withColumn("distance_ly", reach).where((reach > 0) & (cosine >= spread))


def segment_distance(a: tuple[float, float, float], b: tuple[float, float, float]) -> Column:
    """Distance of (x, y, z) from a segment."""
    along = [q - p for p, q in zip(a, b)]
    size2 = sum(v * v for v in along)
    from_a = [F.col(c) - p for c, p in zip("xyz", a)]
    part = sum((v * s for v, s in zip(from_a, along)), F.lit(0.0)) / (size2 or 1.0)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))
    return F.sqrt(sum(((v - part * s) * (v - part * s) for v, s in zip(from_a, along)), F.lit(0.0)))


def missing_cells(points: DataFrame, origin: tuple[float, float, float], radius: float) -> DataFrame:
    """Cells of a box that hold no point."""
    spark = points.sparkSession
    low = [math.floor((v - radius) / maths.CELL) + maths.HALF for v in origin]
    high = [math.floor((v + radius) / maths.CELL) + maths.HALF for v in origin]
    cells = spark.range(low[0], high[0] + 1).toDF("a")
    for name, a, b in (("b", low[1], high[1]), ("c", low[2], high[2])):
        cells = cells.withColumn(name, F.explode(F.sequence(F.lit(a), F.lit(b))))
    cells = cells.select(((F.col("a") * maths.SPAN + F.col("b")) * maths.SPAN + F.col("c")).alias("cell"))
    return cells.join(points.where("cell is not null").select("cell").distinct(), "cell", "left_anti")


def sectors(points: DataFrame, start: tuple[float, float, float], keep: int, key: str = "address") -> DataFrame:
    """The ``keep`` farthest points in each of the 27 directions from ``start``."""
    sign = lambda c, s: F.signum(F.round((F.col(c) - s) / 50.0)).cast("int")
    named = points.withColumn("sector", (sign("x", start[0]) + 1) * 9 + (sign("y", start[1]) + 1) * 3 + sign("z", start[2]) + 1)
    far = maths.d2(F.col("x"), F.col("y"), F.col("z"), *start)
    # one task never holds a whole sector: the best of each partition go on to the final choice
    salted = named.withColumn("__d2", far).withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(32)))
    order = [F.col("__d2").desc(), F.col(key)]
    first = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("sector", "__salt").orderBy(*order))).where(F.col("__rank") <= keep)
    return first.withColumn("__rank", F.row_number().over(Window.partitionBy("sector").orderBy(*order))).where(F.col("__rank") <= keep).drop("__rank", "__salt", "__d2")


def coarse_flags(points: DataFrame, flag: str, edge: float) -> DataFrame:
    """Union of bit flags in cells of ``edge`` light years."""
    at = lambda c: F.floor(F.col(c) / edge).cast("long")
    return points.groupBy(at("x").alias("cx"), at("y").alias("cy"), at("z").alias("cz")).agg(F.bit_or(flag).alias("flags"), F.count("*").alias("points"))
