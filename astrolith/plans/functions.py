"""Queries that apply scalar functions to columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolith.functions import classes, maths, strings, times
from astrolith.plans import galaxy as g
from astrolith.plans.galaxy import GALAXY_SQL
from astrolith.registry import query


@query(r"""SELECT p_partkey AS id, lower(replace(p_name,' ','_')) AS canonical, contains(p_name,' ') AS displayed, regexp_replace(regexp_replace(lower(p_name),'[^a-z0-9]','','g'),'s$','') AS key, replace(lower(p_name),'-','') AS compact, upper(substring(p_name,1,1))||substring(p_name,2) AS title, split_part(lower(replace(p_name,' ','_')),'_',1) AS kind, CASE WHEN p_partkey%2=0 THEN 'High Tech' ELSE 'Prison Colony' END AS shown,
 CASE WHEN p_partkey>=1000000 THEN printf('%.1fm', round(p_partkey/1000000.0,1)) WHEN p_partkey>=1000 THEN printf('%.1fk', round(p_partkey/1000.0,1)) ELSE CAST(p_partkey AS VARCHAR) END AS short FROM part""")
def functions_strings(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    under = F.regexp_replace("p_name", " ", "_")
    economy = F.when(F.col("p_partkey") % 2 == 0, strings.economy_name(F.lit("$economy_HighTech;"))).otherwise(strings.government_name(F.lit("$government_PrisonColony;")))
    return p.select(F.col("p_partkey").alias("id"), strings.canonical_symbol(F.concat(F.lit(" $"), under, F.lit("_Name; "))).alias("canonical"), strings.is_display_name(F.col("p_name")).alias("displayed"), strings.material_key(F.col("p_name")).alias("key"), strings.compact(F.col("p_name")).alias("compact"), strings.title_first(F.col("p_name")).alias("title"), strings.mission_kind(F.concat(F.lit("Mission_"), under)).alias("kind"), economy.alias("shown"), strings.short_number(F.col("p_partkey")).alias("short"))


@query("SELECT p_partkey AS id, CASE p_partkey%6 WHEN 0 THEN 'Neutron' WHEN 1 THEN 'WhiteDwarf' WHEN 2 THEN 'BlackHole' WHEN 3 THEN 'Proto' WHEN 4 THEN 'K' ELSE 'Exotic' END AS cls, CAST(CASE p_partkey%6 WHEN 0 THEN 4.0 WHEN 1 THEN 1.5 ELSE 1.0 END AS DOUBLE) AS boost, p_partkey%6=4 AS scoop, p_partkey%6 IN (0,1,2) AS hazard FROM part")
def functions_stars(spark, d):
    k = F.col("p_partkey") % 6
    subtype = F.when(k == 0, "Neutron Star").when(k == 1, "White Dwarf (DA) Star").when(k == 2, "Supermassive Black Hole").when(k == 3, "T Tauri Star").when(k == 4, "K (Yellow-Orange) Star").otherwise("CN Star")
    cls = classes.star_from_subtype(subtype)
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), cls.alias("cls"), classes.boost(cls).cast("double").alias("boost"), classes.scoopable(cls).alias("scoop"), classes.hazardous(cls).alias("hazard"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts,'%Y-W%W') AS week, round((epoch(TIMESTAMP '2024-02-01')-floor(epoch(ts)))/3600.0,6) AS age_h, date_trunc('second', ts) AS parsed FROM events")
def functions_times(spark, d):
    ts = F.col("ts")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", times.iso(ts).alias("iso"), times.week(ts).alias("week"), F.round(times.age_hours(ts, F.lit("2024-02-01").cast("timestamp")), 6).alias("age_h"), times.parse_ts(times.iso(ts)).alias("parsed"))


@query(GALAXY_SQL + """ SELECT address, round(sqrt(x*x+y*y+z*z),6) AS ly, CASE WHEN x=0 AND y=0 AND z=0 THEN 0 ELSE CAST(greatest(1,ceil(sqrt(x*x+y*y+z*z)/25.0)) AS BIGINT) END AS jumps, round(60+CASE WHEN x=0 AND y=0 AND z=0 THEN 0 ELSE greatest(1,ceil(sqrt(x*x+y*y+z*z)/25.0)) END*18+150+0.5*address/1000.0+95,6) AS seconds,
 CAST(greatest(5, round(5+sqrt(x*x+y*y+z*z)*(1000+500+25000)/200000.0)) AS BIGINT) AS tritium, round(population*pow(0.5, address/900.0),6) AS decayed, round(round((1-(1-2.5/100)*(1-(address%30)/100.0))*1000)/10,6) AS discount FROM systems""")  # fmt: skip
def functions_travel(spark, d):
    s = g.systems(spark, d)
    ly = maths.distance(F.col("x"), F.col("y"), F.col("z"), 0.0, 0.0, 0.0)
    return s.select("address", F.round(ly, 6).alias("ly"), maths.jump_count(ly, 25.0).alias("jumps"), F.round(maths.leg_seconds(ly, F.col("address").cast("double"), 25.0), 6).alias("seconds"), maths.carrier_fuel(ly, 1000.0, 500.0).alias("tritium"), F.round(maths.decayed(F.col("population"), F.col("address"), 900.0), 6).alias("decayed"), F.round(maths.discount(F.lit(2.5), (F.col("address") % 30).cast("double")), 6).alias("discount"))


@query("SELECT t, round(40.0*(200*25.0/15.0)/((200*25.0/15.0)+least(t,200)),6) AS reach FROM (SELECT p_partkey AS t FROM part)")
def functions_range(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("t"), F.round(maths.range_at_tons(F.col("p_partkey"), maths.Ship()), 6).alias("reach"))


DRIVE = maths.Drive(mass=400.0, capacity=32.0, per_jump=5.0, optimal_mass=1800.0)


@query("""SELECT id, round(1800.0/(400.0+f)*pow(5.0/0.012,1/2.45),6) AS reach, round(0.012*pow(dist*(400.0+f)/1800.0,2.45),6) AS burn, CASE WHEN dist<=1800.0/(400.0+f)*pow(5.0/0.012,1/2.45)+0.001 AND 0.012*pow(dist*(400.0+f)/1800.0,2.45)<=5.001 AND f-0.012*pow(dist*(400.0+f)/1800.0,2.45)>=-0.001 THEN round(greatest(f-0.012*pow(dist*(400.0+f)/1800.0,2.45),0),6) END AS fuel_left FROM (SELECT p_partkey AS id, CAST(p_partkey%33 AS DOUBLE) AS f, (p_partkey*7)%600/10.0 AS dist FROM part)""")
def functions_fuel(spark, d):
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), (k % 33).cast("double").alias("f"), ((k * 7) % 600 / 10.0).alias("dist"))
    f, dist = F.col("f"), F.col("dist")
    return rows.select("id", F.round(DRIVE.base_range(f), 6).alias("reach"), F.round(DRIVE.burn(dist, f), 6).alias("burn"), F.round(DRIVE.after(dist, f), 6).alias("fuel_left"))


@query("""SELECT id, CASE WHEN same THEN CASE WHEN d>0 THEN 1 WHEN d<0 THEN CAST(pow(6,-d) AS BIGINT) END WHEN d=0 THEN 6 WHEN d>0 THEN 2 ELSE CAST(pow(6,1-d) AS BIGINT) END AS pay, CASE WHEN same THEN CASE WHEN d>0 THEN CAST(pow(3,d) AS BIGINT) WHEN d<0 THEN 1 END WHEN d<=0 THEN 1 ELSE CAST(pow(3,d-1) AS BIGINT) END AS get, CASE a WHEN 1 THEN 300 WHEN 2 THEN 250 WHEN 3 THEN 200 WHEN 4 THEN 150 ELSE 100 END AS cap
 FROM (SELECT p_partkey AS id, p_partkey%5+1 AS a, (p_partkey%5)-((p_partkey//5)%5) AS d, (p_partkey//25)%2=0 AS same FROM part)""")
def functions_materials(spark, d):
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), (k % 5 + 1).alias("a"), (F.floor(k / 5) % 5 + 1).alias("b"), (F.floor(k / 25) % 2 == 0).alias("same"))
    ratio = maths.trader_ratio(F.col("a"), F.col("b"), F.col("same"))
    return rows.select("id", ratio["pay"].alias("pay"), ratio["get"].alias("get"), maths.material_cap(F.col("a")).alias("cap"))


@query("SELECT address, x, y, z FROM (" + GALAXY_SQL + " SELECT address, CAST(x+1024 AS BIGINT) AS x, CAST(y+1024 AS BIGINT) AS y, CAST(z+1024 AS BIGINT) AS z FROM systems)")
def functions_morton(spark, d):
    """Keys read back as the coordinates that they were made of."""
    s = g.systems(spark, d)
    key = maths.morton(F.col("x") + 1024, F.col("y") + 1024, F.col("z") + 1024, 12)
    return s.select("address", key.alias("key")).select("address", *(maths.morton_axis(F.col("key"), n, 12).alias(c) for n, c in enumerate("xyz")))


@query("SELECT o_orderkey AS id, CAST(floor((plain*53.0+boosted*73.0+inj*1800.0+(stops*120.0+pass*6.0+t/1.245))*10) AS BIGINT) AS score FROM (SELECT o_orderkey, o_orderkey%50 AS plain, o_orderkey%7 AS boosted, o_orderkey%3 AS inj, o_orderkey%5 AS stops, o_orderkey%4 AS pass, CAST(o_orderkey%30 AS DOUBLE) AS t FROM orders)")
def functions_route_score(spark, d):
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), maths.route_score(k % 50, k % 7, k % 3, k % 5, k % 4, (k % 30).cast("double")).alias("score"))


@query("SELECT o_orderkey AS id, array_to_string(list_filter([trim(x) for x in string_split(' '||o_orderpriority||', ,'||o_orderstatus||' ,',',')], lambda x: x<>''),'|') AS parts FROM orders")
def functions_lists(spark, d):
    text = F.concat(F.lit(" "), "o_orderpriority", F.lit(", ,"), "o_orderstatus", F.lit(" ,"))
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.array_join(strings.split_list(text), "|").alias("parts"))


@query("SELECT p_partkey AS id, p_partkey%3=0 AS callsign, array_to_string(list_sort(list_distinct([lower(p_type), 'gold', 'silver', lower(p_type)])),',') AS symbols, CASE WHEN p_partkey%2=0 THEN p_name ELSE p_type END AS shown, CASE p_partkey%4 WHEN 0 THEN 'Metallic' WHEN 1 THEN 'Rocky' WHEN 2 THEN 'Icy' END AS ring, CASE p_partkey%5 WHEN 0 THEN 'raw' WHEN 1 THEN 'raw' WHEN 2 THEN 'manufactured' WHEN 3 THEN 'encoded' END AS trader FROM part")
def functions_names(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.format_string("A%02d-X%02d", k % 100, k % 77)).otherwise(F.format_string("Port %d", k))
    symbols = strings.symbol_set(F.array(F.upper("p_type"), F.lit("Gold"), F.lit("silver"), F.col("p_type")))
    material = F.when(k % 4 == 0, "gold").when(k % 4 == 1, "cobalt").when(k % 4 == 2, "water").otherwise("tritium")
    economy = F.when(k % 5 == 0, "Extraction").when(k % 5 == 1, "REFINERY").when(k % 5 == 2, "industrial").when(k % 5 == 3, "High Tech").otherwise("Tourism")
    rows = spark.read.parquet(f"{d}/part.parquet")
    return rows.select(k.alias("id"), strings.is_callsign(name).alias("callsign"), F.array_join(symbols, ",").alias("symbols"), strings.localised(F.when(k % 2 == 0, F.col("p_name")), F.col("p_type")).alias("shown"), classes.ring_hint(material).alias("ring"), classes.trader_kind(economy).alias("trader"))


LADDER = ["Harmless", "Mostly Harmless", "Novice", "Competent", "Expert", "Master", "Dangerous", "Deadly", "Elite"]


@query("SELECT p_partkey AS id, CASE WHEN p_partkey%16<9 THEN (['" + "','".join(LADDER) + "'])[p_partkey%16+1] WHEN p_partkey%16<14 THEN 'Elite '||(['I','II','III','IV','V'])[p_partkey%16-8] ELSE 'rank '||(p_partkey%16) END AS rank, p_partkey+CAST(p_size AS BIGINT)*36028797018963968 AS body FROM part")
def functions_ranks(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet")
    return rows.select(F.col("p_partkey").alias("id"), classes.rank_name(F.col("p_partkey") % 16, LADDER).alias("rank"), maths.body_id64(F.col("p_partkey"), F.col("p_size")).alias("body"))


@query(GALAXY_SQL + ' SELECT "offset", CAST(floor(epoch(ts))-floor(epoch(TIMESTAMP \'2024-01-03 04:05:06\')) AS BIGINT) AS seconds FROM ev')
def functions_seconds(spark, d):
    return g.events(spark, d).select("offset", times.seconds_between(F.lit("2024-01-03 04:05:06").cast("timestamp"), F.col("ts")).alias("seconds"))


@query(GALAXY_SQL + " SELECT CASE WHEN event IN ('view','click') THEN 'journal' ELSE 'commodity' END AS kind, CASE WHEN event IN ('view','click') THEN event END AS event, count(*) AS n FROM ev GROUP BY 1,2")
def feed_statistics(spark, d):
    from astrolith.streaming import feed

    kind = F.when(F.col("event").isin("view", "click"), "journal").otherwise("commodity")
    return feed.statistics(g.events(spark, d).select(kind.alias("kind"), F.to_json(F.struct("event")).alias("message")))


@query(GALAXY_SQL + " SELECT max(ts) AS last, max(ts)>=TIMESTAMP '2024-01-30 23:58:00'-INTERVAL 5 MINUTE AS alive FROM ev")
def feed_alive(spark, d):
    from astrolith.streaming import feed

    return feed.liveness(g.events(spark, d).select(F.col("ts").alias("gateway")), F.lit("2024-01-30 23:58:00").cast("timestamp"))


@query("SELECT c_custkey AS address, '{\"address\":'||c_custkey||',\"name\":\"'||c_name||'\",\"provenance\":\"boards\",\"as_of\":\"2001-12-01T00:00:00Z\"}' AS document FROM customer")
def results_documented(spark, d):
    from astrolith.streaming import feed

    rows = g.systems(spark, d).select("address", "name")
    documents = feed.result_documents(rows, "boards", F.lit(g.NOW).cast("timestamp"))
    return documents.select(F.get_json_object("document", "$.address").cast("long").alias("address"), "document")
