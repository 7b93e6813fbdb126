"""Knowledge of systems, stars and bodies: overlays, nearest stars, lookups and briefings of routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolith.functions import classes, maths, strings
from astrolith.operators.spatial import grid_join, in_sphere, within


def with_overlay(points: DataFrame, learned: DataFrame) -> DataFrame:
    """``points`` (address, class) with the classes learned since (address, class), which win."""
    newer = learned.select("address", F.col("class").alias("__learned"))
    return points.join(newer, "address", "left").withColumn("class", F.coalesce("__learned", "class")).drop("__learned")


def sphere_answer(index: DataFrame, learned: DataFrame, facts: DataFrame, origin: tuple[float, float, float], radius: float, most: int) -> DataFrame:
    """Stars of a sphere with the newest class and what is known of their systems; those without
    any class are left out. ``index``: address, name, class, x, y, z, cell."""
    hits = with_overlay(within(index, origin, radius, most), learned)
    shown = hits.withColumn("subtype", classes.subtype_of(F.col("class"))).where("class is not null and class <> 'Unknown'")
    return shown.join(facts.select("address", "population", "controlling_power", "power_state"), "address", "left")


def system_info(systems: DataFrame, stars: DataFrame, names: Column) -> DataFrame:
    """What is known of systems by name, with their main star; provisional ones (negative addresses) are none."""
    rows = systems.where(names & (F.col("address") > 0))
    star = stars.select("address", classes.subtype_of(F.col("class")).alias("star"), classes.scoopable(F.col("class")).alias("scoopable"))
    return rows.join(star, "address", "left")


def first_hand(stored: DataFrame, seen: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Stored facts under what a commander saw, wherever that is not null; rows of either side."""
    mine = seen.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    both = stored.join(mine, key, "full_outer")
    return both.select(key, *(F.coalesce(f"__{f}", f).alias(f) for f in fields))


def distinct_materials(materials: DataFrame) -> DataFrame:
    """The vocabulary of materials, in order."""
    return materials.select("material").distinct().orderBy("material")


def resolve_materials(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(asked, material): what was typed against the vocabulary, alike but for signs, case and a plural."""
    known = vocabulary.select("material", strings.material_key(F.col("material")).alias("__key"))
    return asked.withColumn("__key", strings.material_key(F.col("asked"))).join(known, "__key").select("asked", "material")


def exact_points(index: DataFrame, names: list[str]) -> DataFrame:
    """Points of given names, whatever the case."""
    return index.where(F.lower("name").isin(*(n.strip().lower() for n in names)))


def nearest_scoopable(points: DataFrame, stars: DataFrame, reach: float) -> DataFrame:
    """(address, scoop, distance_ly): the nearest other star within reach that refuels a ship; ties to the
    smaller address. Points without one are left out."""
    fuel = stars.where(classes.scoopable(F.col("class"))).select("address", "x", "y", "z")
    pairs = grid_join(points.select("address", "x", "y", "z"), fuel, reach).where("address <> address_r")
    best = pairs.groupBy("address").agg(F.min(F.struct("distance_ly", "address_r")).alias("b"))
    return best.select("address", F.col("b.address_r").alias("scoop"), F.col("b.distance_ly").alias("distance_ly"))


def nearest_cell(cells: DataFrame, origin: tuple[float, float, float], size: float) -> DataFrame:
    """The occupied cell (cx, cy, cz) whose centre is nearest."""
    centre = [(F.col(c) + 0.5) * size for c in ("cx", "cy", "cz")]
    return cells.withColumn("distance_ly", maths.distance(*centre, *origin)).orderBy("distance_ly", "cx", "cy", "cz").limit(1)


def lookup_stars(asked: DataFrame, stars: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known stars of the ids asked for, and the queue of lookups with the others added once."""
    ids = asked.where("address > 0").select("address").distinct()
    known = stars.join(ids, "address", "left_semi")
    fresh = ids.join(stars.select("address"), "address", "left_anti").join(queue.select("address"), "address", "left_anti")
    return known, queue.select("address").unionByName(fresh)


def stale_cells(cells: DataFrame, now: str, days: float) -> DataFrame:
    """Cells (or bodies) whose last sweep is older than so many days, or that were never swept."""
    return cells.where(F.coalesce(F.col("swept_at") < F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(int(days))), F.lit(True)))


def map_rows(bodies: DataFrame, column: str) -> DataFrame:
    """(body_id, key, value) of the entries of a map of signals or materials."""
    return bodies.select("body_id", F.explode(column).alias("key", "value"))


def signal(column: str, key: str) -> Column:
    return F.coalesce(F.element_at(F.col(column), F.lit(key)), F.lit(0))


def best_docks(stations: DataFrame) -> DataFrame:
    """(system_address, dock_id, dock): where to dock in a system: the most large pads, then medium ones, a market
    if that is told, then the least arrival distance (unknown first). Carriers, settlements and places without a
    name or a pad are none."""
    pads = [F.coalesce(c, F.lit(0)) for c in ("pad_large", "pad_medium", "pad_small")]
    rows = stations.where(~F.coalesce("is_carrier", F.lit(False)) & F.col("station").isNotNull() & (F.greatest(*pads) > 0) & ~F.coalesce(F.lower("station_type").contains("settlement"), F.lit(False)))
    market = (-F.col("has_market").cast("int")) if "has_market" in stations.columns else F.lit(0)
    order = F.struct((-pads[0]).alias("large"), (-pads[1]).alias("medium"), market.alias("market"), F.coalesce("arrival_ls", F.lit(-1.0)).alias("ls"), F.col("id").alias("id"), F.col("station").alias("station"))
    best = rows.groupBy("system_address").agg(F.min(order).alias("b"))
    return best.select("system_address", F.col("b.id").alias("dock_id"), F.col("b.station").alias("dock"))


def briefing(hops: DataFrame, systems: DataFrame, stations: DataFrame, pledged: str | None, reach: float) -> DataFrame:
    """Each hop of plotted routes (route, hop, address, x, y, z, class): its leg and the next, whether its
    star refuels, is a hazard and must boost the next leg, who holds it, and where to dock."""
    w = Window.partitionBy("route").orderBy("hop")
    prev = [F.lag(c).over(w) for c in ("x", "y", "z")]
    leg = F.coalesce(maths.distance(F.col("x"), F.col("y"), F.col("z"), *prev), F.lit(0.0))
    rows = hops.withColumn("leg_ly", leg).withColumn("next_ly", F.coalesce(F.lead("leg_ly").over(w), F.lit(0.0)))
    hazard = classes.hazardous(F.col("class"))
    rows = rows.withColumn("scoopable", classes.scoopable(F.col("class"))).withColumn("hazard", hazard)
    rows = rows.withColumn("boost_needed", F.when(hazard & (F.col("next_ly") > 0), F.col("next_ly") > reach + 0.01))
    facts = systems.select("address", "controlling_power", "power_state", "population")
    rows = rows.join(facts, "address", "left").join(best_docks(stations).withColumnRenamed("system_address", "address"), "address", "left")
    opposing = F.lit(False) if pledged is None else F.coalesce(F.lower("controlling_power") != pledged.lower(), F.lit(False))
    return rows.withColumn("opposing", opposing)


def route_totals(brief: DataFrame) -> DataFrame:
    """Each route's length, first hop that does not refuel, and longest run of such hops (the start does not count)."""
    w = Window.partitionBy("route").orderBy("hop")
    rows = brief.withColumn("__dry", (~F.col("scoopable") & (F.col("hop") > 0)).cast("int"))
    rows = rows.withColumn("__island", F.sum(1 - F.col("__dry")).over(w))
    runs = rows.groupBy("route", "__island").agg(F.sum("__dry").alias("dry"), F.sum("leg_ly").alias("ly"), F.min(F.when(F.col("__dry") == 1, F.col("hop"))).alias("first"))
    return runs.groupBy("route").agg(F.sum("ly").alias("total_ly"), F.min("first").alias("first_unscoopable"), F.max("dry").alias("longest_dry"))


# The farthest companion that still lets a ship refuel, in light seconds, and the buckets of distances to it.
COMPANION_LS, COMPANION_BUCKETS = 1500.0, 63


def companion_bucket(ls: Column, most: float = COMPANION_LS) -> Column:
    """Logarithmic bucket (from 1) of a companion's distance."""
    scaled = F.log(F.greatest(F.lit(1.0), F.least(ls, F.lit(most)))) / F.log(F.lit(most)) * (COMPANION_BUCKETS - 1)
    return (1 + F.least(F.floor(scaled), F.lit(COMPANION_BUCKETS - 1))).cast("int")


def companion_ls(bucket: Column, most: float = COMPANION_LS) -> Column:
    """The distance that a bucket stands for; null for none."""
    middle = (bucket - 1 + 0.5) / (COMPANION_BUCKETS - 1)
    return F.when(bucket.between(1, COMPANION_BUCKETS), F.least(F.pow(F.lit(most), middle), F.lit(most)))


def rings_near(systems: DataFrame, bodies: DataFrame, rings: DataFrame, origin: tuple[float, float, float], radius: float) -> DataFrame:
    """Rings of bodies in a sphere with their kind and hotspots (0 without any), and how far their systems are."""
    near = systems.where(in_sphere(origin, radius, "cell")).withColumn("distance_ly", maths.distance(F.col("x"), F.col("y"), F.col("z"), *origin))
    rows = rings.join(bodies, "body_id").join(near.withColumnRenamed("name", "system"), F.col("system_address") == F.col("address"))
    return rows.select("body_id", "body", "ring", strings.ring_kind(F.col("ring_class")).alias("kind"), F.coalesce("hotspots", F.lit(0)).alias("hotspots"), "system", "distance_ly")


def resolve_marks(marks: DataFrame, systems: DataFrame) -> DataFrame:
    """(mark, address): marks by their address where a system has it, those without one by name, whatever the case. Two
    equi joins instead of one on either."""
    by_id = marks.withColumn("__key", F.lower("name")).join(systems.select("address", F.col("address").alias("__a")), "address", "left")
    named = by_id.join(systems.select(F.lower("name").alias("__key"), F.col("address").alias("__b")), "__key", "left")
    return named.select("mark", F.coalesce("__a", F.when(F.col("address").isNull(), F.col("__b"))).alias("address"))


def completed(names: DataFrame, prefixes: tuple[str, ...], limit: int) -> DataFrame:
    """(name, kind) that begin with any of the prefixes, whatever the case, in order."""
    hit = F.lit(False)
    for p in prefixes:
        hit |= F.lower("name").startswith(p.lower())
    return names.where(hit).orderBy("name", "kind").limit(limit)


def enrichment(asked: DataFrame, cache: DataFrame, now: str, days: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Cached answers (address, answer, fetched_at) no older than some days, and the queue of what a job outside is to fetch: each
    missing or old address once, never fetched ones first, no more than ``most`` in a run."""
    ids = asked.select("address").distinct()
    rows = ids.join(cache, "address", "left").withColumn("__fresh", F.coalesce(F.col("fetched_at") >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)), F.lit(False)))
    return rows.where("__fresh").drop("__fresh"), rows.where("not __fresh").orderBy(F.col("fetched_at").asc_nulls_first(), "address").limit(most).select("address")


def located(rows: DataFrame, systems: DataFrame) -> DataFrame:
    """Rows (system_address, ...) with their system's position and cell, kept by the join instead of by a trigger."""
    place = systems.select(F.col("address").alias("system_address"), "x", "y", "z")
    return rows.join(place, "system_address").withColumn("cell", maths.cell(F.col("x"), F.col("y"), F.col("z")))
