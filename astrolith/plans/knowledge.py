"""Queries over what is known of systems, stars, bodies and plotted routes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from astrolith.functions import classes
from astrolith.operators import places
from astrolith.plans import galaxy as g
from astrolith.plans.galaxy import GALAXY_SQL, NOW
from astrolith.registry import query

HERE = (10.0, -20.0, 30.0)
SUBTYPE_SQL = "CASE class WHEN 'Neutron' THEN 'Neutron Star' WHEN 'BlackHole' THEN 'Black Hole' WHEN 'WhiteDwarf' THEN 'White Dwarf (D) Star' WHEN 'Proto' THEN 'T Tauri Star' WHEN 'Exotic' THEN 'Wolf-Rayet Star' ELSE class||' Star' END"
INDEX_SQL = ", ix AS (SELECT address, name, x, y, z, CASE WHEN address%3=0 THEN 'M' WHEN address%3=1 THEN 'Unknown' END AS class FROM systems), ov AS (SELECT ix.address, ix.name, x, y, z, coalesce(s.class, ix.class) AS class FROM ix LEFT JOIN stars s ON s.address=ix.address)"


def _index(spark, d):
    k = F.col("address")
    return g.systems(spark, d).withColumn("class", F.when(k % 3 == 0, "M").when(k % 3 == 1, "Unknown")).select("address", "name", "x", "y", "z", "cell", "class")


def _placed_stars(spark, d):
    return _index(spark, d).drop("class").join(g.stars(spark, d).select("address", "class"), "address")


@query(GALAXY_SQL + INDEX_SQL + f""" SELECT h.address, h.name, {SUBTYPE_SQL} AS subtype, round(h.ly,6) AS distance_ly, population, controlling_power, power_state FROM (SELECT *, sqrt((x-10)*(x-10)+(y+20)*(y+20)+(z-30)*(z-30)) AS ly FROM ov WHERE (x-10)*(x-10)+(y+20)*(y+20)+(z-30)*(z-30)<=10000 ORDER BY ly, address LIMIT 120) h
LEFT JOIN systems s ON s.address=h.address WHERE class IS NOT NULL AND class<>'Unknown'""")  # fmt: skip
def sphere_known(spark, d):
    rows = places.sphere_answer(_index(spark, d), g.stars(spark, d), g.systems(spark, d), HERE, 100.0, 120)
    return rows.select("address", "name", "subtype", F.round("distance_ly", 6).alias("distance_ly"), "population", "controlling_power", "power_state")


@query(GALAXY_SQL + INDEX_SQL + " SELECT class, count(*) AS n FROM ov GROUP BY class")
def stars_overlaid(spark, d):
    return places.with_overlay(_index(spark, d), g.stars(spark, d)).groupBy("class").agg(F.count("*").alias("n"))


@query(GALAXY_SQL + f" SELECT s.address, s.name, population, economy, CASE WHEN st.address IS NOT NULL THEN {SUBTYPE_SQL} END AS star, CASE WHEN st.address IS NOT NULL THEN class IN ('O','B','A','F','G','K','M') END AS scoopable FROM systems s LEFT JOIN stars st ON st.address=s.address WHERE s.address>0 AND contains(lower(s.name),'7')")
def system_facts(spark, d):
    return places.system_info(g.systems(spark, d), g.stars(spark, d), F.lower("name").contains("7")).select("address", "name", "population", "economy", "star", "scoopable")


@query(GALAXY_SQL + " SELECT address, CASE WHEN address%6=0 THEN 'seen' ELSE economy END AS economy, CASE WHEN address%6=0 AND address%4<>0 THEN address ELSE population END AS population FROM systems UNION ALL SELECT -1, 'seen', NULL")
def system_first_hand(spark, d):
    systems = g.systems(spark, d)
    seen = systems.where("address % 6 = 0").select("address", F.lit("seen").alias("economy"), F.when(F.col("address") % 4 != 0, F.col("address")).alias("population"))
    seen = seen.unionAll(spark.range(1).select(F.lit(-1).cast("long"), F.lit("seen"), F.lit(None).cast("long")))
    return places.first_hand(systems.select("address", "economy", "population"), seen, "address", ["economy", "population"])


MATERIALS_SQL = ", mats AS (SELECT p_partkey AS body_id, replace(p_name,' ','-')||'s' AS material FROM part)"


def _materials(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_partkey").alias("body_id"), F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("s")).alias("material"))


@query(GALAXY_SQL + MATERIALS_SQL + " SELECT DISTINCT material FROM mats")
def materials_distinct(spark, d):
    return places.distinct_materials(_materials(spark, d))


@query(GALAXY_SQL + MATERIALS_SQL + " SELECT DISTINCT upper(p_name) AS asked, replace(p_name,' ','-')||'s' AS material FROM part")
def materials_resolved(spark, d):
    asked = spark.read.parquet(f"{d}/part.parquet").select(F.upper("p_name").alias("asked")).distinct()
    return places.resolve_materials(asked, places.distinct_materials(_materials(spark, d)))


@query(GALAXY_SQL + " SELECT address, name, x, y, z FROM systems WHERE lower(name) IN ('customer#000000005','customer#000000077')")
def names_exact(spark, d):
    return places.exact_points(_index(spark, d), [" CUSTOMER#000000005 ", "customer#000000077", "nowhere"]).select("address", "name", "x", "y", "z")


@query(GALAXY_SQL + """, f AS (SELECT st.address, s.x, s.y, s.z FROM stars st JOIN systems s ON s.address=st.address WHERE class IN ('O','B','A','F','G','K','M')),
p AS (SELECT a.address, f.address AS scoop, sqrt((a.x-f.x)*(a.x-f.x)+(a.y-f.y)*(a.y-f.y)+(a.z-f.z)*(a.z-f.z)) AS ly FROM systems a JOIN f ON f.address<>a.address AND (a.x-f.x)*(a.x-f.x)+(a.y-f.y)*(a.y-f.y)+(a.z-f.z)*(a.z-f.z)<=900)
SELECT address, scoop, round(ly,6) AS distance_ly FROM p QUALIFY row_number() OVER (PARTITION BY address ORDER BY ly, scoop)=1""")  # fmt: skip
def stars_nearest_scoop(spark, d):
    found = places.nearest_scoopable(g.systems(spark, d), _placed_stars(spark, d), 30.0)
    return found.withColumn("distance_ly", F.round("distance_ly", 6))


@query(GALAXY_SQL + ", c AS (SELECT DISTINCT CAST(floor(x/50) AS BIGINT) AS cx, CAST(floor(y/50) AS BIGINT) AS cy, CAST(floor(z/50) AS BIGINT) AS cz FROM systems WHERE population>500000) SELECT cx, cy, cz, round(sqrt(((cx+0.5)*50-10)*((cx+0.5)*50-10)+((cy+0.5)*50+20)*((cy+0.5)*50+20)+((cz+0.5)*50-30)*((cz+0.5)*50-30)),6) AS distance_ly FROM c ORDER BY 4, cx, cy, cz LIMIT 1")
def cells_nearest(spark, d):
    at = lambda c, n: F.floor(F.col(c) / 50).cast("long").alias(n)
    cells = g.systems(spark, d).where("population > 500000").select(at("x", "cx"), at("y", "cy"), at("z", "cz")).distinct()
    return places.nearest_cell(cells, HERE, 50.0).withColumn("distance_ly", F.round("distance_ly", 6))


@query(GALAXY_SQL + ", a AS (SELECT DISTINCT o_custkey AS address FROM orders WHERE o_custkey>0) SELECT a.address, CASE WHEN s.address IS NOT NULL THEN 'known' ELSE 'queued' END AS answer, class FROM a LEFT JOIN stars s ON s.address=a.address UNION ALL SELECT -5, 'queued', NULL")
def stars_lookup(spark, d):
    asked = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("address"))
    waiting = spark.range(1).select(F.lit(-5).cast("long").alias("address")).unionAll(asked.where("o_custkey % 8 = 3").distinct().join(g.stars(spark, d).select("address"), "address", "left_anti"))
    known, queue = places.lookup_stars(asked, g.stars(spark, d), waiting)
    return known.select("address", F.lit("known").alias("answer"), "class").unionAll(queue.select("address", F.lit("queued"), F.lit(None).cast("string")))


@query(GALAXY_SQL + " SELECT s.address, st.observed_at AS swept_at FROM systems s LEFT JOIN stars st ON st.address=s.address WHERE st.observed_at IS NULL OR st.observed_at<TIMESTAMP '2001-12-01 00:00:00'-INTERVAL 30 DAY")
def cells_stale(spark, d):
    cells = g.systems(spark, d).select("address").join(g.stars(spark, d).select("address", F.col("observed_at").alias("swept_at")), "address", "left")
    return places.stale_cells(cells, NOW, 30)


def _signals(spark, d):
    b = F.col("body_id")
    signals = F.map_filter(F.create_map(F.lit("$Bio;"), b % 4, F.lit("$Geo;"), b % 3, F.lit("Painite"), b % 5), lambda k, v: v > 0)
    return g.bodies(spark, d).select("body_id", signals.alias("signals"))


@query(GALAXY_SQL + " SELECT * FROM (SELECT body_id, '$Bio;' AS key, body_id%4 AS value FROM bodies UNION ALL SELECT body_id, '$Geo;', body_id%3 FROM bodies UNION ALL SELECT body_id, 'Painite', body_id%5 FROM bodies) WHERE value>0")
def bodies_signals(spark, d):
    return places.map_rows(_signals(spark, d), "signals")


@query(GALAXY_SQL + " SELECT body_id, body_id%4 AS bio, body_id%5 AS painite, 0 AS none FROM bodies")
def bodies_signal_counts(spark, d):
    return _signals(spark, d).select("body_id", places.signal("signals", "$Bio;").alias("bio"), places.signal("signals", "Painite").alias("painite"), places.signal("signals", "Void Opal").cast("int").alias("none"))


HOPS_SQL = """, hp AS (SELECT r.route, CAST(r.hop AS INTEGER) AS hop, s.address, s.x, s.y, s.z, coalesce(st.class,'Unknown') AS class FROM (SELECT o_orderkey%50 AS route, o_custkey, row_number() OVER (PARTITION BY o_orderkey%50 ORDER BY o_orderkey)-1 AS hop FROM orders) r JOIN systems s ON s.address=r.o_custkey LEFT JOIN stars st ON st.address=s.address),
lg AS (SELECT *, coalesce(sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(y-lag(y) OVER w)*(y-lag(y) OVER w)+(z-lag(z) OVER w)*(z-lag(z) OVER w)),0) AS leg_ly FROM hp WINDOW w AS (PARTITION BY route ORDER BY hop)),
nx AS (SELECT *, coalesce(lead(leg_ly) OVER (PARTITION BY route ORDER BY hop),0) AS next_ly, class IN ('O','B','A','F','G','K','M') AS scoopable, class IN ('WhiteDwarf','Neutron','BlackHole') AS hazard FROM lg)"""


def _hops(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") % 50).alias("route"), "o_orderkey", F.col("o_custkey").alias("address"))
    hops = orders.withColumn("hop", F.row_number().over(Window.partitionBy("route").orderBy("o_orderkey")) - 1).drop("o_orderkey")
    points = g.systems(spark, d).select("address", "x", "y", "z").join(g.stars(spark, d).select("address", "class"), "address", "left").withColumn("class", F.coalesce("class", F.lit("Unknown")))
    return hops.join(points, "address")


def _brief(spark, d):
    return places.briefing(_hops(spark, d), g.systems(spark, d), g.stations(spark, d), "power 2", 120.0)


@query(GALAXY_SQL + HOPS_SQL + """, dk AS (SELECT system_address, id, station FROM stations WHERE NOT is_carrier AND station IS NOT NULL AND greatest(coalesce(pad_large,0),coalesce(pad_medium,0),coalesce(pad_small,0))>0 AND NOT coalesce(contains(lower(station_type),'settlement'),false) QUALIFY row_number() OVER (PARTITION BY system_address ORDER BY coalesce(pad_large,0) DESC, coalesce(pad_medium,0) DESC, arrival_ls ASC NULLS FIRST, id)=1)
SELECT route, hop, n.address, round(leg_ly,6) AS leg_ly, round(next_ly,6) AS next_ly, scoopable, hazard, CASE WHEN hazard AND next_ly>0 THEN next_ly>120.01 END AS boost_needed, coalesce(lower(controlling_power)<>'power 2',false) AS opposing, dk.id AS dock_id, dk.station AS dock FROM nx n LEFT JOIN systems s ON s.address=n.address LEFT JOIN dk ON dk.system_address=n.address""")  # fmt: skip
def routes_briefed(spark, d):
    return _brief(spark, d).select("route", "hop", "address", F.round("leg_ly", 6).alias("leg_ly"), F.round("next_ly", 6).alias("next_ly"), "scoopable", "hazard", "boost_needed", "opposing", "dock_id", "dock")


@query(GALAXY_SQL + HOPS_SQL + """, dr AS (SELECT *, CASE WHEN NOT scoopable AND hop>0 THEN 1 ELSE 0 END AS dry FROM nx), isl AS (SELECT *, sum(1-dry) OVER (PARTITION BY route ORDER BY hop ROWS UNBOUNDED PRECEDING) AS g FROM dr)
SELECT route, round(sum(ly),6) AS total_ly, CAST(min(f) AS INTEGER) AS first_unscoopable, CAST(max(n) AS BIGINT) AS longest_dry FROM (SELECT route, g, sum(leg_ly) AS ly, min(CASE WHEN dry=1 THEN hop END) AS f, sum(dry) AS n FROM isl GROUP BY route, g) GROUP BY route""")  # fmt: skip
def routes_totalled(spark, d):
    return places.route_totals(_brief(spark, d)).withColumn("total_ly", F.round("total_ly", 6))


@query("SELECT s_suppkey AS id, CAST(1+least(floor(ln(greatest(1.0,least(CAST((s_suppkey*97)%5000 AS DOUBLE),1500.0)))/ln(1500.0)*62),62) AS INTEGER) AS bucket, round(least(pow(1500.0,(least(floor(ln(greatest(1.0,least(CAST((s_suppkey*97)%5000 AS DOUBLE),1500.0)))/ln(1500.0)*62),62)+0.5)/62),1500.0),6) AS ls FROM supplier")
def functions_companion(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 97) % 5000).cast("double").alias("at"))
    return rows.select("id", places.companion_bucket(F.col("at")).alias("bucket")).withColumn("ls", F.round(places.companion_ls(F.col("bucket")), 6))


@query(GALAXY_SQL + f" SELECT address, {SUBTYPE_SQL} AS subtype, class AS back FROM stars")
def functions_subtypes(spark, d):
    """A class's subtype reads back as the class."""
    rows = g.stars(spark, d).select("address", classes.subtype_of(F.col("class")).alias("subtype"))
    return rows.withColumn("back", classes.star_from_subtype(F.col("subtype")))


@query(GALAXY_SQL + ", a AS (SELECT DISTINCT o_custkey AS address FROM orders), r AS (SELECT a.address, class, observed_at, coalesce(observed_at>=TIMESTAMP '2001-12-01'-INTERVAL 20 DAY,false) AS f FROM a LEFT JOIN stars s ON s.address=a.address) SELECT address, class AS answer FROM r WHERE f UNION ALL (SELECT address, 'queued' FROM r WHERE NOT f ORDER BY observed_at ASC NULLS FIRST, address LIMIT 300)")
def stars_enriched(spark, d):
    cache = g.stars(spark, d).select("address", F.col("class").alias("answer"), F.col("observed_at").alias("fetched_at"))
    asked = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("address"))
    known, queue = places.enrichment(asked, cache, NOW, 20, 300)
    return known.select("address", "answer").unionAll(queue.select("address", F.lit("queued")))


@query(GALAXY_SQL + " SELECT id, (CAST(floor(x/100) AS BIGINT)+1024)*2048*2048+(CAST(floor(y/100) AS BIGINT)+1024)*2048+CAST(floor(z/100) AS BIGINT)+1024 AS cell FROM stations JOIN systems ON address=system_address")
def stations_located(spark, d):
    return places.located(g.stations(spark, d), g.systems(spark, d)).select("id", "cell")
