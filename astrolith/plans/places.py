"""Queries over systems, stations, bodies and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolith.functions import classes, maths, strings
from astrolith.operators import boards, spatial
from astrolith.operators import places as known
from astrolith.plans import galaxy as g
from astrolith.plans.galaxy import GALAXY_SQL
from astrolith.registry import query

HERE = (10.0, -20.0, 30.0)


@query(GALAXY_SQL + " SELECT address, name, round(sqrt((x-10)*(x-10)+(y+20)*(y+20)+(z-30)*(z-30)),6) AS distance_ly, (SELECT count(*) FROM systems WHERE (x-10)*(x-10)+(y+20)*(y+20)+(z-30)*(z-30)<=6400)>50 AS truncated FROM systems WHERE (x-10)*(x-10)+(y+20)*(y+20)+(z-30)*(z-30)<=6400 ORDER BY sqrt((x-10)*(x-10)+(y+20)*(y+20)+(z-30)*(z-30)), address LIMIT 50")
def systems_within(spark, d):
    return spatial.within(g.systems(spark, d), HERE, 80.0, 50).select("address", "name", F.round("distance_ly", 6).alias("distance_ly"), "truncated")


@query(GALAXY_SQL + " SELECT address, (CAST(floor(x/100) AS BIGINT)+1024)*2048*2048+(CAST(floor(y/100) AS BIGINT)+1024)*2048+CAST(floor(z/100) AS BIGINT)+1024 AS cell FROM systems")
def systems_cells(spark, d):
    return g.systems(spark, d).select("address", "cell")


@query(GALAXY_SQL + " SELECT a.address AS a, b.address AS b, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)),6) AS distance_ly FROM systems a JOIN systems b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)<=400 AND a.address<b.address")
def systems_grid_join(spark, d):
    p = g.systems(spark, d).select("address", "x", "y", "z")
    return spatial.grid_join(p, p, 20.0).where("address < address_r").select(F.col("address").alias("a"), F.col("address_r").alias("b"), F.round("distance_ly", 6).alias("distance_ly"))


@query(GALAXY_SQL + " SELECT address FROM systems a WHERE NOT EXISTS (SELECT 1 FROM systems b WHERE b.address%2=1 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)<0.01)")
def systems_unknown(spark, d):
    p = g.systems(spark, d).select("address", "x", "y", "z")
    return spatial.absent_near(p, p.where("address % 2 = 1")).select("address")


@query(GALAXY_SQL + " SELECT address, round(distance_ly,6) AS distance_ly FROM (SELECT *, sqrt((x-10)*(x-10)+(y+20)*(y+20)+(z-30)*(z-30)) AS distance_ly, ((x-10)*90+(y+20)*20+(z-30)*-30)/sqrt(90*90+20*20+30*30) AS along FROM systems) WHERE distance_ly>0 AND (x-10)*(x-10)+(y+20)*(y+20)+(z-30)*(z-30)<=22500 AND along/distance_ly>=0.5")
def systems_toward(spark, d):
    return spatial.toward(g.systems(spark, d), HERE, (100.0, 0.0, 0.0), 150.0).select("address", F.round("distance_ly", 6).alias("distance_ly"))


@query(GALAXY_SQL + ", p AS (SELECT *, greatest(0, least(1, ((x-10)*90+(y+20)*20+(z-30)*-30)/9400.0)) AS t FROM systems) SELECT address FROM p WHERE sqrt((x-10-90*t)*(x-10-90*t)+(y+20-20*t)*(y+20-20*t)+(z-30+30*t)*(z-30+30*t))<=30.5")
def systems_corridor(spark, d):
    return g.systems(spark, d).where(spatial.segment_distance(HERE, (100.0, 0.0, 0.0)) <= 30.5).select("address")


@query(GALAXY_SQL + " SELECT sector, address FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY d2 DESC, address) AS rn FROM (SELECT address, (CAST(sign(round(x/50.0)) AS INTEGER)+1)*9+(CAST(sign(round(y/50.0)) AS INTEGER)+1)*3+CAST(sign(round(z/50.0)) AS INTEGER)+1 AS sector, x*x+y*y+z*z AS d2 FROM systems)) WHERE rn<=5")
def systems_sectors(spark, d):
    return spatial.sectors(g.systems(spark, d), (0.0, 0.0, 0.0), 5).select("sector", "address")


@query(GALAXY_SQL + " SELECT cell FROM (SELECT (a*2048+b)*2048+c AS cell FROM range(1021,1027) t1(a), range(1021,1027) t2(b), range(1021,1027) t3(c)) WHERE cell NOT IN (SELECT (CAST(floor(x/100) AS BIGINT)+1024)*2048*2048+(CAST(floor(y/100) AS BIGINT)+1024)*2048+CAST(floor(z/100) AS BIGINT)+1024 FROM systems)")
def systems_missing_cells(spark, d):
    return spatial.missing_cells(g.systems(spark, d), (0.0, 0.0, 0.0), 250.0)


@query(GALAXY_SQL + " SELECT CAST(floor(x/50) AS BIGINT) AS cx, CAST(floor(y/50) AS BIGINT) AS cy, CAST(floor(z/50) AS BIGINT) AS cz, bit_or(address%8) AS flags, count(*) AS points FROM systems GROUP BY 1,2,3")
def systems_coarse_flags(spark, d):
    return spatial.coarse_flags(g.systems(spark, d).withColumn("flag", F.col("address") % 8), "flag", 50.0)


@query(GALAXY_SQL + """, near AS (SELECT st.*, sqrt((x-10)*(x-10)+(y+20)*(y+20)+(z-30)*(z-30)) AS distance_ly FROM stations st JOIN systems sy ON sy.address=st.system_address WHERE (x-10)*(x-10)+(y+20)*(y+20)+(z-30)*(z-30)<=90000 AND st.id IN (SELECT station_id FROM services WHERE replace(replace(lower(service),' ',''),'_','')='materialtrader')),
head AS (SELECT * FROM near ORDER BY distance_ly, id LIMIT 40) SELECT id, station, round(distance_ly,6) AS distance_ly FROM head WHERE coalesce(pad_large,0)>0 ORDER BY distance_ly, id LIMIT 10""")  # fmt: skip
def stations_with_service(spark, d):
    found = boards.stations_near(g.systems(spark, d), g.stations(spark, d), g.services(spark, d), HERE, 300.0, "material_trader", 10, 4, "large")
    return found.select("id", "station", F.round("distance_ly", 6).alias("distance_ly"))


@query(GALAXY_SQL + " SELECT sy.address, coalesce(n, 0) AS stations FROM systems sy LEFT JOIN (SELECT system_address, count(*) AS n FROM stations GROUP BY 1) c ON c.system_address=sy.address")
def systems_station_counts(spark, d):
    counts = g.stations(spark, d).groupBy(F.col("system_address").alias("address")).agg(F.count("*").alias("n"))
    return g.systems(spark, d).join(counts, "address", "left").select("address", F.coalesce("n", F.lit(0)).alias("stations"))


@query(GALAXY_SQL + " SELECT id, station, class, CASE class WHEN 'starport' THEN 0 WHEN 'planetary_port' THEN 1 WHEN 'outpost' THEN 2 WHEN 'carrier' THEN 3 WHEN 'construction_depot' THEN 4 WHEN 'settlement' THEN 5 ELSE 6 END AS rank, class IN ('starport','planetary_port','outpost','carrier') AS dockable, CASE WHEN pad_large>0 THEN 'large' WHEN pad_medium>0 THEN 'medium' WHEN pad_small>0 THEN 'small' END AS pad FROM stations")
def stations_classed(spark, d):
    return g.stations(spark, d).select("id", "station", "class", classes.class_rank(F.col("class")).alias("rank"), classes.is_dockable(F.col("class")).alias("dockable"), classes.largest_pad(F.col("pad_large"), F.col("pad_medium"), F.col("pad_small")).alias("pad"))


@query("SELECT name, kind FROM (SELECT c_name AS name, 'system' AS kind FROM customer UNION ALL SELECT s_name, 'station' FROM supplier) WHERE starts_with(lower(name), 'customer#00000000') OR starts_with(lower(name), 'supplier#00000001') ORDER BY name, kind LIMIT 20")
def names_completed(spark, d):
    names = g.systems(spark, d).select("name", F.lit("system").alias("kind")).unionAll(g.stations(spark, d).select("station", F.lit("station")))
    return known.completed(names, ("Customer#00000000", "supplier#00000001"), 20)


@query("SELECT DISTINCT controlling_power, power_state FROM (" + GALAXY_SQL + " SELECT * FROM systems)")
def systems_powers(spark, d):
    return g.systems(spark, d).select("controlling_power", "power_state").distinct()


@query(GALAXY_SQL + """ SELECT b.body_id, b.body, r.ring, CASE r.ring_class WHEN 'eRingClass_MetalRich' THEN 'Metal Rich' ELSE 'Icy' END AS kind, coalesce(r.hotspots,0) AS hotspots, sy.name AS system, round(sqrt((x-10)*(x-10)+(y+20)*(y+20)+(z-30)*(z-30)),6) AS distance_ly FROM rings r JOIN bodies b ON b.body_id=r.body_id JOIN systems sy ON sy.address=b.system_address
WHERE (x-10)*(x-10)+(y+20)*(y+20)+(z-30)*(z-30)<=10000""")  # fmt: skip
def mining_rings(spark, d):
    rows = known.rings_near(g.systems(spark, d), g.bodies(spark, d), g.rings(spark, d), HERE, 100.0)
    return rows.withColumn("distance_ly", F.round("distance_ly", 6))


@query(GALAXY_SQL + """ SELECT ground, landable, count(*) AS n FROM (SELECT landable, CASE WHEN sub_type='Rocky Ice world' THEN 'rocky-ice' WHEN sub_type='High metal content world' THEN 'high-metal-content' WHEN sub_type='Icy body' THEN 'icy' WHEN volcanism='Rocky Magma' THEN 'rock 80%+ [rocky magma]' ELSE 'rock 80%+ [none]' END AS ground FROM bodies) GROUP BY 1,2""")
def mining_grounds(spark, d):
    return g.bodies(spark, d).groupBy(classes.ground(F.col("sub_type"), F.col("volcanism")).alias("ground"), "landable").agg(F.count("*").alias("n"))


@query(GALAXY_SQL + """ SELECT r.ring, b.body FROM rings r JOIN bodies b ON b.body=regexp_extract(r.ring, '^(.*) [A-Z] Ring$', 1)""")
def mining_ring_parents(spark, d):
    return g.rings(spark, d).select("ring", strings.ring_parent(F.col("ring")).alias("body")).join(g.bodies(spark, d).select("body"), "body").select("ring", "body")


@query(GALAXY_SQL + """, marks AS (SELECT c_custkey AS mark, CASE WHEN c_custkey%2=0 THEN c_custkey END AS address, upper(c_name) AS name FROM customer) SELECT mark, coalesce(a.address, b.address) AS address FROM marks m LEFT JOIN systems a ON a.address=m.address LEFT JOIN systems b ON m.address IS NULL AND lower(b.name)=lower(m.name)""")
def marks_resolved(spark, d):
    systems = g.systems(spark, d)
    marks = systems.select(F.col("address").alias("mark"), F.when(F.col("address") % 2 == 0, F.col("address")).alias("address"), F.upper("name").alias("name"))
    return known.resolve_marks(marks, systems)
