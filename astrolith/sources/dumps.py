"""Line-delimited dumps: one JSON object on a line, inside an array or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from astrolith.functions import classes, times

COORDS = "coords struct<x: double, y: double, z: double>"
STATION = "struct<id: bigint, name: string, type: string, distanceToArrival: double, landingPads: map<string, int>, updateTime: string, market: struct<commodities: array<struct<symbol: string, buyPrice: bigint, sellPrice: bigint, supply: bigint, demand: bigint>>, prohibitedCommodities: array<string>, updateTime: string>, outfitting: struct<modules: array<struct<symbol: string>>, updateTime: string>, shipyard: struct<ships: array<struct<symbol: string>>, updateTime: string>>"
BODY = f"struct<id64: bigint, name: string, type: string, subType: string, mainStar: boolean, isLandable: boolean, volcanismType: string, distanceToArrival: double, materials: map<string, double>, signals: struct<signals: map<string, bigint>>, rings: array<struct<name: string, type: string, signals: struct<signals: map<string, bigint>>>>, updateTime: string, stations: array<{STATION}>>"
SYSTEM = f"id64 bigint, name string, {COORDS}, population bigint, allegiance string, government string, primaryEconomy string, security string, controllingPower string, powerState string, powers array<string>, date string, factions array<struct<name: string, influence: double>>, stations array<{STATION}>, bodies array<{BODY}>"


def read_lines(spark: SparkSession, path: str, schema: str | StructType, parts: int | None = None) -> DataFrame:
    """Objects of a dump, gzipped or plain; other lines are skipped. What does not parse keeps its text
    in ``corrupt``. Gzip cannot be split: ``parts`` spreads what follows."""
    text = spark.read.text(path).where(F.ltrim("value").startswith("{")).select(F.regexp_replace(F.trim("value"), r",\s*$", "").alias("value"), F.col("_metadata.file_path").alias("file"))
    if parts:
        text = text.repartition(parts)
    kept = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = StructType([*kept.fields]).add("corrupt", "string")
    return text.select("file", F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("r")).select("file", "r.*")


def dump_kind(file: Column) -> Column:
    """``galaxy_1day.json.gz`` as ``galaxy_1day``."""
    return F.regexp_extract(file, r"([^/]+?)\.json(\.gz)?$", 1)


def systems_of(dump: DataFrame) -> DataFrame:
    need = F.col("id64").isNotNull() & F.col("name").isNotNull() & F.col("coords").isNotNull()
    return dump.where(need).select(F.col("id64").alias("address"), "name", "coords.x", "coords.y", "coords.z", "population", "security", "allegiance", "government", F.col("primaryEconomy").alias("economy"), F.col("controllingPower").alias("controlling_power"), F.col("powerState").alias("power_state"), "powers", times.parse_ts(F.col("date")).alias("observed_at"))


def stations_of(dump: DataFrame, verdict: Column | None = None) -> DataFrame:
    """Stations of systems and of their bodies. ``verdict`` ('full', 'stations', 'skip') says by system
    how deep to go; only a full visit reaches bodies."""
    seen = dump.withColumn("__verdict", verdict if verdict is not None else F.lit("full")).where("__verdict <> 'skip'")
    own = seen.select(F.col("id64").alias("system_address"), F.explode("stations").alias("s"))
    of_bodies = seen.where("__verdict = 'full'").select(F.col("id64").alias("system_address"), F.explode("bodies").alias("b")).select("system_address", F.explode("b.stations").alias("s"))
    return own.unionByName(of_bodies)


def board_operations(stations: DataFrame) -> DataFrame:
    """Market, outfitting, shipyard and identity as operations of their own, each with its time."""
    rows = []
    for kind, items in (("market", "s.market.commodities.symbol"), ("outfitting", "s.outfitting.modules.symbol"), ("shipyard", "s.shipyard.ships.symbol")):
        rows.append(stations.where(f"s.{kind} is not null").select(F.col("s.id").alias("station_id"), F.lit(kind).alias("kind"), times.parse_ts(F.col(f"s.{kind}.updateTime")).alias("observed_at"), F.col(items).alias("symbols")))
    rows.append(stations.select(F.col("s.id").alias("station_id"), F.lit("identity").alias("kind"), times.parse_ts(F.col("s.updateTime")).alias("observed_at"), F.array().cast("array<string>").alias("symbols")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def bodies_of(dump: DataFrame) -> DataFrame:
    """Bodies worth keeping: landable ones, and those with materials, rings or signals."""
    rows = dump.select(F.col("id64").alias("system_address"), F.explode("bodies").alias("b"))
    some = F.coalesce(F.col("b.isLandable"), F.lit(False)) | (F.coalesce(F.size("b.materials"), F.lit(0)) > 0) | (F.coalesce(F.size("b.rings"), F.lit(0)) > 0) | F.col("b.signals").isNotNull()
    return rows.where(some).select("system_address", F.col("b.id64").alias("body_id"), F.col("b.name").alias("body"), F.col("b.subType").alias("sub_type"), F.col("b.volcanismType").alias("volcanism"), F.col("b.isLandable").alias("landable"), F.col("b.distanceToArrival").alias("distance_ls"), F.col("b.materials").alias("materials"), F.col("b.rings").alias("rings"), F.col("b.signals.signals").alias("signals"))


def hotspots_of(bodies: DataFrame) -> DataFrame:
    ring = bodies.select("body_id", F.explode("rings").alias("r"))
    return ring.select("body_id", F.col("r.name").alias("ring"), F.explode("r.signals.signals").alias("material", "count"))


def main_stars_of(dump: DataFrame) -> DataFrame:
    rows = dump.select(F.col("id64").alias("address"), F.explode("bodies").alias("b")).where("b.type = 'Star' and b.mainStar")
    return rows.select("address", classes.star_from_subtype(F.col("b.subType")).alias("cls"), F.lit("dump").alias("source"), times.parse_ts(F.col("b.updateTime")).alias("observed_at"))


NIGHTLY = "systemId64 bigint, type string, subType string, isMainStar boolean, updateTime string"


def nightly_stars(spark: SparkSession, path: str) -> DataFrame:
    """(address, cls, source, observed_at) of the main stars in a nightly file of bodies, one on a line."""
    rows = read_lines(spark, path, NIGHTLY).where("systemId64 > 0 and type = 'Star' and isMainStar")
    return rows.select(F.col("systemId64").alias("address"), classes.star_from_subtype(F.col("subType")).alias("cls"), F.lit("nightly").alias("source"), times.parse_ts(F.col("updateTime")).alias("observed_at"))


ROUTE = "result struct<system_jumps: array<struct<system: string, id64: bigint, x: double, y: double, z: double, neutron_star: boolean, jumps: int>>>"


def imported_hops(spark: SparkSession, path: str) -> DataFrame:
    """(hop, address, name, x, y, z, class, jumps) of a finished route that another planner made."""
    rows = spark.read.schema(ROUTE).json(path, multiLine=True).select(F.posexplode("result.system_jumps").alias("hop", "h"))
    return rows.select("hop", F.col("h.id64").alias("address"), F.col("h.system").alias("name"), "h.x", "h.y", "h.z", F.when(F.col("h.neutron_star"), "Neutron").alias("class"), F.coalesce("h.jumps", F.lit(1)).alias("jumps"))
