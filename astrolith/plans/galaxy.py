"""Domain tables as projections of a star schema: systems from customers, stations from
suppliers, commodities from parts, boards from line items, bodies from parts and orders.

Each projection is written once for Spark (DataFrame) and once as SQL text for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astrolith.functions import classes, maths
from astrolith.sources import published

#: The moment that queries count ages from.
NOW = "2001-12-01 00:00:00"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    base = _read(spark, sf_dir, "customer").select(
        k.alias("address"), F.col("c_name").alias("name"),
        ((k * 37) % 401 - 200).cast("double").alias("x"), ((k * 53) % 211 - 105).cast("double").alias("y"), ((k * 71) % 307 - 153).cast("double").alias("z"),
        F.floor(F.abs("c_acctbal") * 100).cast("long").alias("population"),
        F.when(k % 5 != 0, F.concat(F.lit("Power "), (k % 5).cast("string"))).alias("controlling_power"),
        F.when(k % 3 == 0, "Exploited").when(k % 3 == 1, "Stronghold").alias("power_state"),
        F.col("c_mktsegment").alias("economy"),
    )
    return base.withColumn("cell", maths.cell(F.col("x"), F.col("y"), F.col("z")))


SYSTEMS_SQL = """systems AS (SELECT c_custkey AS address, c_name AS name, CAST((c_custkey*37)%401-200 AS DOUBLE) AS x, CAST((c_custkey*53)%211-105 AS DOUBLE) AS y, CAST((c_custkey*71)%307-153 AS DOUBLE) AS z,
  CAST(floor(abs(c_acctbal)*100) AS BIGINT) AS population, CASE WHEN c_custkey%5<>0 THEN 'Power '||(c_custkey%5) END AS controlling_power,
  CASE c_custkey%3 WHEN 0 THEN 'Exploited' WHEN 1 THEN 'Stronghold' END AS power_state, c_mktsegment AS economy FROM customer)"""

KINDS = ("Coriolis Starport", "Planetary Port", "Outpost", "Fleet Carrier", "Settlement", "Construction Depot", None)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    kind = F.coalesce(*(F.when(s % 7 == n, F.lit(v)) for n, v in enumerate(KINDS) if v))
    return _read(spark, sf_dir, "supplier").select(
        s.alias("id"), s.alias("system_address"), F.col("s_name").alias("station"), kind.alias("station_type"), F.when(s % 11 != 0, ((s * 97) % 5000).cast("double")).alias("arrival_ls"),
        F.when(s % 4 == 0, 8).when(s % 4 == 1, 0).alias("pad_large"), F.when(s % 4 != 3, 4).alias("pad_medium"), F.when(s % 4 != 3, 6).alias("pad_small"),
        (F.coalesce(s % 7, F.lit(0)) == 3).alias("is_carrier"),
    ).withColumn("class", classes.station_class(F.col("station_type")))


STATIONS_SQL = """stations AS (SELECT s_suppkey AS id, s_suppkey AS system_address, s_name AS station, CASE s_suppkey%7 WHEN 0 THEN 'Coriolis Starport' WHEN 1 THEN 'Planetary Port' WHEN 2 THEN 'Outpost' WHEN 3 THEN 'Fleet Carrier' WHEN 4 THEN 'Settlement' WHEN 5 THEN 'Construction Depot' END AS station_type,
  CASE WHEN s_suppkey%11<>0 THEN CAST((s_suppkey*97)%5000 AS DOUBLE) END AS arrival_ls, CASE s_suppkey%4 WHEN 0 THEN 8 WHEN 1 THEN 0 END AS pad_large, CASE WHEN s_suppkey%4<>3 THEN 4 END AS pad_medium, CASE WHEN s_suppkey%4<>3 THEN 6 END AS pad_small,
  s_suppkey%7=3 AS is_carrier, CASE s_suppkey%7 WHEN 0 THEN 'starport' WHEN 1 THEN 'planetary_port' WHEN 2 THEN 'outpost' WHEN 3 THEN 'carrier' WHEN 4 THEN 'settlement' WHEN 5 THEN 'construction_depot' ELSE 'other' END AS class FROM supplier)"""


#: Goods that stations trade.
GOODS = 400


def _symbol(part, letter: str = "c"):
    return F.concat(F.lit(letter), (part % GOODS).cast("string"))


def commodities(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = (F.col("p_partkey") % GOODS).alias("part")
    rows = _read(spark, sf_dir, "part").groupBy(good).agg(F.min("p_name").alias("name"), F.min("p_type").alias("category"))
    return rows.select(_symbol(F.col("part")).alias("symbol"), "name", "category", "part")


COMMODITIES_SQL = "commodities AS (SELECT 'c'||(p_partkey%400) AS symbol, min(p_name) AS name, min(p_type) AS category, p_partkey%400 AS part FROM part GROUP BY p_partkey%400)"


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board rows as observed, several for a station and commodity, over the 60 days before ``NOW``."""
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    floor_price = F.floor(900 + p * 0.1).cast("long")
    age = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 1440
    return _read(spark, sf_dir, "lineitem").select(
        s.alias("station_id"), _symbol(p).alias("symbol"), (floor_price + (s * 13) % 97).alias("buy_price"), (floor_price + (s * 29) % 131).alias("sell_price"),
        F.col("l_quantity").cast("long").alias("supply"), (F.col("l_quantity") * 20).cast("long").alias("demand"), F.timestamp_seconds(F.unix_timestamp(F.lit(NOW).cast("timestamp")) - age * 3600).alias("observed_at"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"),
    )


SIGHTINGS_SQL = """sightings AS (SELECT l_suppkey AS station_id, 'c'||(l_partkey%400) AS symbol, CAST(floor(900+l_partkey*0.1) AS BIGINT)+(l_suppkey*13)%97 AS buy_price, CAST(floor(900+l_partkey*0.1) AS BIGINT)+(l_suppkey*29)%131 AS sell_price,
  CAST(l_quantity AS BIGINT) AS supply, CAST(l_quantity*20 AS BIGINT) AS demand, TIMESTAMP '2001-12-01 00:00:00' - to_hours(CAST((l_orderkey*7+l_linenumber*13)%1440 AS BIGINT)) AS observed_at, l_orderkey AS "order", l_linenumber AS line FROM lineitem)"""


def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row for each station and commodity."""
    row = F.struct("observed_at", "order", "line", "buy_price", "sell_price", "supply", "demand")
    return sightings(spark, sf_dir).groupBy("station_id", "symbol").agg(F.max(row).alias("r")).select("station_id", "symbol", "r.buy_price", "r.sell_price", "r.supply", "r.demand", "r.observed_at")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boards, as a table that is made once and kept in order of its commodities."""
    return published.stored(spark, "market", f"{sf_dir}/lineitem.parquet", lambda: newest_rows(spark, sf_dir), ["symbol", "station_id"])


MARKET_SQL = """market AS (SELECT station_id, symbol, buy_price, sell_price, supply, demand, observed_at FROM (SELECT *, row_number() OVER (PARTITION BY station_id, symbol ORDER BY observed_at DESC, "order" DESC, line DESC, buy_price DESC, sell_price DESC, supply DESC, demand DESC) AS rn FROM sightings) WHERE rn=1)"""


def prohibited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_tax > 0.06 and l_discount > 0.07").select(F.col("l_suppkey").alias("station_id"), _symbol(F.col("l_partkey"), "C").alias("symbol")).distinct()


PROHIBITED_SQL = "prohibited AS (SELECT DISTINCT l_suppkey AS station_id, 'C'||(l_partkey%400) AS symbol FROM lineitem WHERE l_returnflag='R' AND l_tax>0.06 AND l_discount>0.07)"


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the services of each station."""
    s = F.col("s_suppkey")
    names = F.array(F.when(s % 2 == 0, "Material Trader"), F.when(s % 3 == 0, "tech_broker"), F.when(s % 5 == 0, "blackmarket"))
    return _read(spark, sf_dir, "supplier").select(s.alias("station_id"), F.explode(F.array_compact(names)).alias("service"))


SERVICES_SQL = "services AS (SELECT s_suppkey AS station_id, 'Material Trader' AS service FROM supplier WHERE s_suppkey%2=0 UNION ALL SELECT s_suppkey, 'tech_broker' FROM supplier WHERE s_suppkey%3=0 UNION ALL SELECT s_suppkey, 'blackmarket' FROM supplier WHERE s_suppkey%5=0)"


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(
        p.alias("body_id"), (p % 1000).alias("system_address"), F.concat(F.lit("Body "), p.cast("string")).alias("body"),
        F.when(p % 4 == 0, "Rocky body").when(p % 4 == 1, "Icy body").when(p % 4 == 2, "High metal content world").otherwise("Rocky Ice world").alias("sub_type"),
        F.when(p % 3 == 0, "Rocky Magma").when(p % 3 == 1, "No volcanism").alias("volcanism"), (p % 2 == 0).alias("landable"), ((p * 31) % 9000).cast("double").alias("distance_ls"),
    )


BODIES_SQL = """bodies AS (SELECT p_partkey AS body_id, p_partkey%1000 AS system_address, 'Body '||p_partkey AS body, CASE p_partkey%4 WHEN 0 THEN 'Rocky body' WHEN 1 THEN 'Icy body' WHEN 2 THEN 'High metal content world' ELSE 'Rocky Ice world' END AS sub_type,
  CASE p_partkey%3 WHEN 0 THEN 'Rocky Magma' WHEN 1 THEN 'No volcanism' END AS volcanism, p_partkey%2=0 AS landable, CAST((p_partkey*31)%9000 AS DOUBLE) AS distance_ls FROM part)"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of bodies with the counts of their hotspots, null without any."""
    p = F.col("p_partkey")
    letter = F.explode(F.array(F.lit("A"), F.lit("B"))).alias("letter")
    base = _read(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(p, letter)
    return base.select(p.alias("body_id"), F.concat(F.lit("Body "), p.cast("string"), F.lit(" "), "letter", F.lit(" Ring")).alias("ring"), F.when(p % 2 == 0, "eRingClass_MetalRich").otherwise("eRingClass_Icy").alias("ring_class"), F.when(F.col("letter") == "A", p % 4).alias("hotspots"))


RINGS_SQL = """rings AS (SELECT p_partkey AS body_id, 'Body '||p_partkey||' '||letter||' Ring' AS ring, CASE WHEN p_partkey%2=0 THEN 'eRingClass_MetalRich' ELSE 'eRingClass_Icy' END AS ring_class, CASE WHEN letter='A' THEN p_partkey%4 END AS hotspots FROM part, (VALUES ('A'),('B')) AS l(letter) WHERE p_partkey%3=0)"""


STEMS = ("hpt_pulselaser_fixed_small", "hpt_cannon_gimbal_large", "hpt_shieldbooster_size0_class5", "int_hyperdrive_size5_class5", "int_cargorack_size4_class1", "int_hullreinforcement_size2_class2")
HULLS = ("eagle", "vulture", "type9", "cutter", "asp", "sidewinder", "anaconda", "python")


def _pick(names: tuple[str, ...], k):
    return F.element_at(F.array(*(F.lit(n) for n in names)), (k + 1).cast("int"))


def outfitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules on offer: a stem and a number as symbol; no price known, or only other coins."""
    n, s = F.col("n"), F.col("station_id")
    rows = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("station_id"), (F.col("l_partkey") % 60).alias("n")).agg(F.max("l_shipdate").cast("timestamp").alias("observed_at"))
    symbol = F.concat(_pick(STEMS, n % 6), F.lit("_"), F.floor(n / 6).cast("string"))
    return rows.select("station_id", symbol.alias("symbol"), F.when(n % 5 == 0, 0).when(n % 5 != 1, 1000 * n + s).cast("long").alias("credits_price"), F.when(n % 5 == 0, n + 10).cast("long").alias("merc_price"), "observed_at")


OUTFITTING_SQL = """outfitting AS (SELECT l_suppkey AS station_id, CASE n%6 WHEN 0 THEN 'hpt_pulselaser_fixed_small' WHEN 1 THEN 'hpt_cannon_gimbal_large' WHEN 2 THEN 'hpt_shieldbooster_size0_class5' WHEN 3 THEN 'int_hyperdrive_size5_class5' WHEN 4 THEN 'int_cargorack_size4_class1' ELSE 'int_hullreinforcement_size2_class2' END||'_'||(n//6) AS symbol,
  CASE WHEN n%5=0 THEN 0 WHEN n%5<>1 THEN 1000*n+l_suppkey END AS credits_price, CASE WHEN n%5=0 THEN n+10 END AS merc_price, o AS observed_at FROM (SELECT l_suppkey, l_partkey%60 AS n, max(l_shipdate) AS o FROM lineitem GROUP BY 1,2))"""


def shipyard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_suppkey").alias("station_id"), _pick(HULLS, F.col("l_orderkey") % 8).alias("symbol")).distinct()
    return rows.withColumn("credits_price", F.lit(None).cast("long"))


SHIPYARD_SQL = "shipyard AS (SELECT DISTINCT l_suppkey AS station_id, CASE l_orderkey%8 WHEN 0 THEN 'eagle' WHEN 1 THEN 'vulture' WHEN 2 THEN 'type9' WHEN 3 THEN 'cutter' WHEN 4 THEN 'asp' WHEN 5 THEN 'sidewinder' WHEN 6 THEN 'anaconda' ELSE 'python' END AS symbol FROM lineitem WHERE l_quantity>30)"


def powered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems with the powers that are present, and stations' factions."""
    k = F.col("address")
    powers = F.array_compact(F.array(F.when(k % 2 == 0, "Power 1"), F.when(k % 3 == 0, "Power 2"), F.when(k % 7 == 0, "Power 4")))
    return systems(spark, sf_dir).withColumn("powers", powers).withColumn("controlling_faction", F.concat(F.lit(" Faction "), (k % 9).cast("string"), F.lit(" ")))


POWERED_SQL = "powered AS (SELECT *, list_filter([CASE WHEN address%2=0 THEN 'Power 1' END, CASE WHEN address%3=0 THEN 'Power 2' END, CASE WHEN address%7=0 THEN 'Power 4' END], lambda x: x IS NOT NULL) AS powers, ' Faction '||(address%9)||' ' AS controlling_faction FROM systems)"


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of main stars, of three systems in four: class, when it was seen, and by whom."""
    k = F.col("c_custkey")
    names = ("Neutron", "WhiteDwarf", "BlackHole", "K", "G", "M", "T", "Exotic")
    rows = _read(spark, sf_dir, "customer").where("c_custkey % 4 <> 3")
    return rows.select(k.alias("address"), _pick(names, k % 8).alias("class"), F.timestamp_seconds(F.unix_timestamp(F.lit(NOW).cast("timestamp")) - (k % 90) * 86400).alias("observed_at"), F.when(k % 5 == 0, "navroute").otherwise("scan").alias("source"))


STARS_SQL = "stars AS (SELECT c_custkey AS address, CASE c_custkey%8 WHEN 0 THEN 'Neutron' WHEN 1 THEN 'WhiteDwarf' WHEN 2 THEN 'BlackHole' WHEN 3 THEN 'K' WHEN 4 THEN 'G' WHEN 5 THEN 'M' WHEN 6 THEN 'T' ELSE 'Exotic' END AS class, TIMESTAMP '2001-12-01 00:00:00' - to_days(CAST(c_custkey%90 AS INTEGER)) AS observed_at, CASE WHEN c_custkey%5=0 THEN 'navroute' ELSE 'scan' END AS source FROM customer WHERE c_custkey%4<>3)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal: one commander per user, one file per commander and day."""
    return _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("commander"), F.col("ts").cast("timestamp").alias("ts"), F.date_format("ts", "yyyy-MM-dd").alias("file"), F.col("event_id").alias("offset"), F.col("event_type").alias("event"), "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("props").alias("raw"),
    )


EVENTS_SQL = "ev AS (SELECT user_id AS commander, ts, strftime(ts, '%Y-%m-%d') AS file, event_id AS \"offset\", event_type AS event, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, props AS raw FROM events)"

ORDER = ("ts", "file", "offset")


def replay(*partition: str):
    """The one order in which journals are read: time, file, offset."""
    return Window.partitionBy(*partition).orderBy(*ORDER)


GALAXY_SQL = "WITH " + ",\n".join((SYSTEMS_SQL, STATIONS_SQL, COMMODITIES_SQL, SIGHTINGS_SQL, MARKET_SQL, PROHIBITED_SQL, SERVICES_SQL, BODIES_SQL, RINGS_SQL, EVENTS_SQL, OUTFITTING_SQL, SHIPYARD_SQL, POWERED_SQL, STARS_SQL))
