"""Queries over merges and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolith.operators import merge
from astrolith.plans import galaxy as g
from astrolith.plans.galaxy import GALAXY_SQL
from astrolith.registry import query

SPLIT = "TIMESTAMP '2001-11-15 00:00:00'"


@query(GALAXY_SQL + " SELECT station_id, symbol, buy_price, observed_at FROM (SELECT *, max(observed_at) OVER (PARTITION BY station_id) AS last FROM sightings) WHERE observed_at=last")
def merge_newest_snapshots(spark, d):
    return merge.newest_snapshots(g.sightings(spark, d), "station_id").select("station_id", "symbol", "buy_price", "observed_at")


BOARDS_SQL = f""", old AS (SELECT station_id, symbol, max(buy_price) AS buy_price, any_value(observed_at) AS observed_at FROM (SELECT *, max(observed_at) OVER (PARTITION BY station_id) AS last FROM sightings WHERE observed_at<{SPLIT}) WHERE observed_at=last GROUP BY station_id, symbol),
marks AS (SELECT station_id, max(observed_at) AS observed_at FROM sightings WHERE observed_at<{SPLIT} GROUP BY station_id), arr AS (SELECT station_id, max(observed_at) AS arrived FROM sightings WHERE observed_at>={SPLIT} AND station_id%3<>0 GROUP BY station_id),
app AS (SELECT a.station_id, arrived FROM arr a LEFT JOIN marks m ON m.station_id=a.station_id WHERE m.observed_at IS NULL OR arrived>m.observed_at),
fresh AS (SELECT station_id, symbol, buy_price, observed_at FROM (SELECT s.*, row_number() OVER (PARTITION BY s.station_id, symbol ORDER BY "order" DESC, line DESC) AS rn FROM sightings s JOIN app ON app.station_id=s.station_id AND app.arrived=s.observed_at WHERE s.station_id%5<>0) WHERE rn=1)"""


@query(GALAXY_SQL + BOARDS_SQL + " SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE station_id NOT IN (SELECT station_id FROM app)")
def merge_boards(spark, d):
    """New snapshots replace boards as wholes; every fifth station's is empty and clears its board."""
    seen = g.sightings(spark, d)
    split = F.lit("2001-11-15 00:00:00").cast("timestamp")
    before, after = seen.where(F.col("observed_at").cast("timestamp") < split), seen.where((F.col("observed_at").cast("timestamp") >= split) & (F.col("station_id") % 3 != 0))
    old = merge.newest_snapshots(before, "station_id").groupBy("station_id", "symbol").agg(F.max("buy_price").alias("buy_price"), F.first("observed_at").alias("observed_at"))
    marks = before.groupBy("station_id").agg(F.max("observed_at").alias("observed_at"))
    incoming = after.where("station_id % 5 <> 0").select("station_id", "symbol", "buy_price", "observed_at", F.struct("order", "line").alias("pos"))
    rows, _ = merge.replace_boards(old, marks, incoming, after.select("station_id", "observed_at"))
    return rows


FACTS_SQL = f""", st AS (SELECT c_custkey AS address, CASE WHEN c_custkey%4<>0 THEN c_mktsegment END AS economy, CASE WHEN c_custkey%3=0 THEN 'low' END AS security, TIMESTAMP '2000-06-01' + to_days(CAST(c_custkey%50 AS INTEGER)) AS observed_at FROM customer WHERE c_custkey%10<8),
inc AS (SELECT address, arg_max(struct_pack(e:=economy, s:=security), (observed_at, coalesce(economy,''), coalesce(security,''))) AS n, max(observed_at) AS newest FROM (SELECT o_custkey AS address, CASE WHEN o_orderkey%3=0 THEN o_orderpriority END AS economy, CASE WHEN o_orderkey%2=0 THEN o_orderstatus END AS security, TIMESTAMP '2000-06-01' + to_days(CAST(o_orderkey%60 AS INTEGER)) + to_seconds(CAST(o_orderkey AS INTEGER)) AS observed_at FROM orders) GROUP BY address)"""


@query(GALAXY_SQL + FACTS_SQL + """ SELECT coalesce(st.address, inc.address) AS address, CASE WHEN st.observed_at IS NULL OR newest>st.observed_at THEN coalesce(n.e, economy) ELSE coalesce(economy, n.e) END AS economy, CASE WHEN st.observed_at IS NULL OR newest>st.observed_at THEN coalesce(n.s, security) ELSE coalesce(security, n.s) END AS security, greatest(st.observed_at, newest) AS observed_at FROM st FULL OUTER JOIN inc ON inc.address=st.address""")
def merge_facts(spark, d):
    k = F.col("c_custkey")
    start = F.lit("2000-06-01").cast("timestamp")
    later = lambda days, seconds: (start + F.make_interval(days=days.cast("int"), secs=seconds)).alias("observed_at")
    stored = spark.read.parquet(f"{d}/customer.parquet").where(k % 10 < 8).select(k.alias("address"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("economy"), F.when(k % 3 == 0, "low").alias("security"), later(k % 50, F.lit(0)))
    o = F.col("o_orderkey")
    incoming = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("address"), F.when(o % 3 == 0, F.col("o_orderpriority")).alias("economy"), F.when(o % 2 == 0, F.col("o_orderstatus")).alias("security"), later(o % 60, o))
    return merge.fill_facts(stored, incoming, "address", ["economy", "security"])


@query(GALAXY_SQL + """ SELECT address, source, cls FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY cls<>'Unknown' DESC, source<>'navroute' DESC, observed_at DESC, source DESC, cls DESC) AS rn FROM (SELECT o_custkey AS address, CASE o_orderkey%3 WHEN 0 THEN 'navroute' WHEN 1 THEN 'scan' ELSE 'dump' END AS source, CASE WHEN o_orderkey%5=0 THEN 'Unknown' ELSE o_orderstatus END AS cls, o_orderdate AS observed_at FROM orders)) WHERE rn=1""")
def merge_stars(spark, d):
    o = F.col("o_orderkey")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("address"), F.when(o % 3 == 0, "navroute").when(o % 3 == 1, "scan").otherwise("dump").alias("source"), F.when(o % 5 == 0, "Unknown").otherwise(F.col("o_orderstatus")).alias("cls"), F.col("o_orderdate").alias("observed_at"))
    return merge.prefer_sources(rows, "address").select("address", "source", "cls")


@query(GALAXY_SQL + " SELECT id, CASE WHEN id%4=0 THEN id+1000 ELSE -id END AS system_address FROM stations")
def merge_promoted(spark, d):
    stations = g.stations(spark, d).select("id", (-F.col("id")).alias("system_address"))
    known = g.stations(spark, d).where("id % 4 = 0").select((-F.col("id")).alias("provisional"), (F.col("id") + 1000).alias("real"))
    return merge.promote(stations, known).select("id", "system_address")


@query(GALAXY_SQL + """ SELECT m.station_id, m.symbol, coalesce(p.c, 0) AS credits, p.v AS variants FROM market m LEFT JOIN (SELECT station_id, symbol, CAST(min(CASE WHEN price>0 THEN price END) AS BIGINT) AS c, array_to_string(list_sort(list_distinct(list(variant))), ',') AS v FROM (SELECT station_id, symbol, CASE WHEN line%2=0 THEN buy_price ELSE 0 END AS price, line AS variant FROM sightings WHERE supply>10) GROUP BY 1,2) p ON p.station_id=m.station_id AND p.symbol=m.symbol""")
def merge_prices(spark, d):
    seen = g.sightings(spark, d).where("supply > 10").select("station_id", "symbol", F.when(F.col("line") % 2 == 0, F.col("buy_price")).otherwise(0).alias("price"), F.col("line").alias("variant"))
    found = merge.patch_prices(g.market(spark, d).select("station_id", "symbol"), seen)
    return found.select("station_id", "symbol", "credits", F.array_join("variants", ",").alias("variants"))


def _versions(spark, d):
    rows = g.systems(spark, d).select("address", "economy", "population")
    old = rows.where("address % 7 <> 0")
    new = rows.where("address % 5 <> 0").withColumn("population", F.when(F.col("address") % 3 == 0, F.col("population") + 1).otherwise(F.col("population")))
    return old, new


VERSIONS_SQL = ", o AS (SELECT address, economy, population FROM systems WHERE address%7<>0), n AS (SELECT address, economy, CASE WHEN address%3=0 THEN population+1 ELSE population END AS population FROM systems WHERE address%5<>0)"


@query(GALAXY_SQL + VERSIONS_SQL + " SELECT coalesce(o.address,n.address) AS address, CASE WHEN o.address IS NULL THEN 'add' WHEN n.address IS NULL THEN 'retract' ELSE 'update' END AS op, CASE WHEN n.address IS NULL THEN o.economy ELSE n.economy END AS economy, CASE WHEN n.address IS NULL THEN o.population ELSE n.population END AS population FROM o FULL OUTER JOIN n ON n.address=o.address WHERE o.address IS NULL OR n.address IS NULL OR o.population<>n.population")
def difference_of_indexes(spark, d):
    return merge.difference(*_versions(spark, d), ["address"], ["economy", "population"])


@query(GALAXY_SQL + VERSIONS_SQL + " SELECT side, count(*) AS n FROM (SELECT CASE WHEN o.address IS NULL THEN 'new' WHEN n.address IS NULL THEN 'old' ELSE 'both' END AS side FROM o FULL OUTER JOIN n ON n.address=o.address) GROUP BY side")
def difference_presence(spark, d):
    return merge.presence(*_versions(spark, d), ["address"])


@query(GALAXY_SQL + VERSIONS_SQL + " SELECT address, economy, population FROM n")
def overlay_applied(spark, d):
    """The old index with the difference applied is the new one."""
    old, new = _versions(spark, d)
    steps = merge.difference(old, new, ["address"], ["economy", "population"]).withColumn("step", F.lit(1))
    net = merge.net_operations(steps, ["address"], ["economy", "population"])
    return merge.apply_operations(old, net, ["address"], ["economy", "population"])


@query(GALAXY_SQL + """, s AS (SELECT "offset"//4 AS id, "offset" AS step, CASE WHEN "offset"%4=0 THEN 'add' WHEN "offset"%4=3 AND event='error' THEN 'retract' WHEN "offset"%4=3 AND event='signup' THEN 'add' ELSE 'update' END AS op, value FROM ev), w AS (SELECT *, lag(op) OVER (PARTITION BY id ORDER BY step) AS b FROM s),
 a AS (SELECT id, arg_min(op, step) AS f, arg_max(op, step) AS z, arg_max(value, step) AS value, bool_or(coalesce((op='add' AND b IN ('add','update')) OR (op<>'add' AND b='retract'), false)) AS bad FROM w GROUP BY id),
 r AS (SELECT id, CASE WHEN bad THEN 'error' WHEN f='add' AND z='retract' THEN NULL WHEN f='add' THEN 'add' WHEN z='add' THEN 'update' ELSE z END AS op, value FROM a) SELECT * FROM r WHERE op IS NOT NULL""")  # fmt: skip
def overlay_net(spark, d):
    """Every event is a step of one of the chains of four: added, updated twice, and then as its kind says."""
    place, event = F.col("offset") % 4, F.col("event")
    op = F.when(place == 0, "add").when((place == 3) & (event == "error"), "retract").when((place == 3) & (event == "signup"), "add").otherwise("update")
    steps = g.events(spark, d).select(F.floor(F.col("offset") / 4).cast("long").alias("id"), F.col("offset").alias("step"), op.alias("op"), "value")
    return merge.net_operations(steps, ["id"], ["value"])


@query(GALAXY_SQL + " SELECT symbol, min(part) AS part, count(*) AS n FROM (SELECT lower(trim(replace(name,' ','_'))) AS symbol, part FROM commodities) GROUP BY symbol")
def merge_symbols(spark, d):
    """Symbols in the feed's wrapping fold onto one canonical form."""
    wrapped = F.concat(F.lit("$"), F.upper(F.regexp_replace("name", " ", "_")), F.lit("_Name;"))
    rows = g.commodities(spark, d).select(F.when(F.col("part") % 2 == 0, wrapped).otherwise(F.regexp_replace("name", " ", "_")).alias("symbol"), "part")
    return merge.folded_symbols(rows, "symbol", "part")


SOURCE_SQL = """, st AS (SELECT CASE WHEN c_custkey%5=0 THEN -c_custkey ELSE c_custkey END AS address, c_name AS name, CASE WHEN c_custkey%4<>0 THEN c_mktsegment END AS economy, CASE WHEN c_custkey%3=0 THEN TIMESTAMP '1996-01-01' END AS source_at, CASE WHEN c_custkey%2=0 THEN TIMESTAMP '1998-06-01' END AS feed_at FROM customer WHERE c_custkey%7<>6),
raw AS (SELECT o_custkey AS address, CASE WHEN o_custkey%11=0 THEN 'Customer#000000003' ELSE upper('Customer#'||lpad(CAST(o_custkey AS VARCHAR),9,'0')) END AS name, CASE WHEN o_orderkey%3<>0 THEN o_orderpriority END AS economy, o_orderdate AS seen FROM orders),
n AS (SELECT address, (max((seen, name, coalesce(economy,''), economy))) AS r FROM raw GROUP BY address), nn AS (SELECT address, r[1] AS seen, r[2] AS name, r[4] AS economy, lower(r[2]) AS k FROM n),
re AS (SELECT k, min(address) AS real FROM nn WHERE address NOT IN (SELECT address FROM st) GROUP BY k), hd AS (SELECT CASE WHEN address<0 THEN coalesce(real,address) ELSE address END AS address, name, economy, source_at, feed_at, lower(name) AS k FROM st LEFT JOIN re ON re.k=lower(st.name)),
ow AS (SELECT k, min(address) AS owner FROM hd GROUP BY k), ok AS (SELECT nn.* FROM nn LEFT JOIN ow ON ow.k=nn.k WHERE owner IS NULL OR owner=nn.address), ok2 AS (SELECT * FROM ok QUALIFY address=min(address) OVER (PARTITION BY k)),
jn AS (SELECT coalesce(h.address,o.address) AS address, h.name AS hn, h.economy AS he, source_at, feed_at, o.name AS n2, o.economy AS ne, seen, seen IS NOT NULL AND (source_at IS NULL OR source_at<seen) AND (feed_at IS NULL OR feed_at<seen) AS w FROM hd h FULL OUTER JOIN ok2 o ON o.address=h.address)"""


@query(GALAXY_SQL + SOURCE_SQL + " SELECT address, CASE WHEN w THEN coalesce(n2,hn) ELSE hn END AS name, CASE WHEN w THEN coalesce(ne,he) ELSE he END AS economy, CASE WHEN w THEN seen ELSE source_at END AS source_at, feed_at FROM jn")
def merge_source_systems(spark, d):
    """Stored systems, every fifth provisional, under newer and older rows of a dump, some under a name that is taken."""
    k, o = F.col("c_custkey"), F.col("o_custkey")
    time = lambda v: F.lit(v).cast("timestamp")
    stored = spark.read.parquet(f"{d}/customer.parquet").where(k % 7 != 6).select(F.when(k % 5 == 0, -k).otherwise(k).alias("address"), F.col("c_name").alias("name"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("economy"), F.when(k % 3 == 0, time("1996-01-01")).alias("source_at"), F.when(k % 2 == 0, time("1998-06-01")).alias("feed_at"))
    name = F.when(o % 11 == 0, "Customer#000000003").otherwise(F.upper(F.concat(F.lit("Customer#"), F.lpad(o.cast("string"), 9, "0"))))
    incoming = spark.read.parquet(f"{d}/orders.parquet").select(o.alias("address"), name.alias("name"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("economy"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return merge.source_systems(stored, incoming, ["economy"])


def _body_versions(spark, d):
    b = F.col("body_id")
    time = lambda days: F.lit("2001-01-01").cast("timestamp") + F.make_interval(days=days.cast("int"))
    base = g.bodies(spark, d)
    stored = base.where(b % 5 != 0).select("body_id", "body", "sub_type", (b % 3).alias("bio"), time(b % 10).alias("observed_at"))
    incoming = base.where(b % 2 == 0).select("body_id", "body", F.upper("sub_type").alias("sub_type"), F.when(b % 4 == 0, b % 7).alias("bio"), time(b % 15).alias("observed_at"))
    return stored, incoming


BODY_SQL = """, old AS (SELECT body_id, body, sub_type, body_id%3 AS bio, TIMESTAMP '2001-01-01'+to_days(CAST(body_id%10 AS INTEGER)) AS observed_at FROM bodies WHERE body_id%5<>0), inc AS (SELECT body_id, body, upper(sub_type) AS sub_type, CASE WHEN body_id%4=0 THEN body_id%7 END AS bio, TIMESTAMP '2001-01-01'+to_days(CAST(body_id%15 AS INTEGER)) AS observed_at FROM bodies WHERE body_id%2=0),
bj AS (SELECT coalesce(o.body_id,i.body_id) AS body_id, i.body_id IS NOT NULL AND (o.observed_at IS NULL OR o.observed_at<=i.observed_at) AS w, o.body AS ob, i.body AS ib, o.sub_type AS os, i.sub_type AS "is", o.bio AS obio, i.bio AS ibio, o.observed_at AS oo, i.observed_at AS io FROM old o FULL OUTER JOIN inc i ON i.body_id=o.body_id)"""


@query(GALAXY_SQL + BODY_SQL + ' SELECT body_id, CASE WHEN w THEN ib ELSE ob END AS body, CASE WHEN w THEN "is" ELSE os END AS sub_type, CASE WHEN w THEN coalesce(ibio,obio) ELSE obio END AS bio, CASE WHEN w THEN io ELSE oo END AS observed_at FROM bj')
def merge_bodies(spark, d):
    return merge.merge_bodies(*_body_versions(spark, d), ["body", "sub_type"], ["bio"])[0]


@query(GALAXY_SQL + BODY_SQL + """, wr AS (SELECT body_id FROM bj WHERE w), os2 AS (SELECT body_id, ring FROM rings), ins AS (SELECT body_id, ring||' II' AS ring FROM rings WHERE body_id%4=0)
SELECT 'all' AS kind, body_id, ring FROM os2 WHERE body_id NOT IN (SELECT body_id FROM wr) UNION ALL SELECT 'all', body_id, ring FROM ins WHERE body_id IN (SELECT body_id FROM wr) UNION ALL SELECT 'given', body_id, ring FROM os2 WHERE body_id NOT IN (SELECT body_id FROM ins WHERE body_id IN (SELECT body_id FROM wr)) UNION ALL SELECT 'given', body_id, ring FROM ins WHERE body_id IN (SELECT body_id FROM wr)""")  # fmt: skip
def merge_children(spark, d):
    """Rings go with a written body; hotspots only if new ones come."""
    _, written = merge.merge_bodies(*_body_versions(spark, d), ["body", "sub_type"], ["bio"])
    stored = g.rings(spark, d).select("body_id", "ring")
    incoming = stored.where("body_id % 4 = 0").select("body_id", F.concat("ring", F.lit(" II")).alias("ring"))
    parts = [merge.replace_children(stored, incoming, written, given).select(F.lit(name).alias("kind"), "body_id", "ring") for name, given in (("all", False), ("given", True))]
    return parts[0].unionAll(parts[1])


@query(GALAXY_SQL + """, st AS (SELECT body_id, ring, m AS material, CAST(2 AS BIGINT) AS count FROM rings, (VALUES ('Gold'),('Tritium')) v(m)), inc AS (SELECT b.system_address, ring, 'Painite' AS material, b.body_id%6 AS count FROM rings r JOIN bodies b ON b.body_id=r.body_id WHERE r.body_id%2=0 UNION ALL SELECT 3, 'No such place', 'Gold', 9),
fr AS (SELECT b.body_id, i.ring, i.material, i.count FROM inc i JOIN bodies b ON b.system_address=i.system_address AND b.body=regexp_extract(i.ring,'^(.*) [A-Z] Ring$',1)) SELECT * FROM st WHERE (body_id, ring) NOT IN (SELECT (body_id, ring) FROM fr) UNION ALL SELECT * FROM fr""")  # fmt: skip
def merge_hotspots(spark, d):
    rings = g.rings(spark, d).select("body_id", "ring")
    stored = rings.withColumn("material", F.explode(F.array(F.lit("Gold"), F.lit("Tritium")))).withColumn("count", F.lit(2).cast("long"))
    incoming = rings.where("body_id % 2 = 0").join(g.bodies(spark, d).select("body_id", "system_address"), "body_id").select("system_address", "ring", F.lit("Painite").alias("material"), (F.col("body_id") % 6).alias("count"))
    stray = spark.range(1).select(F.lit(3).cast("long"), F.lit("No such place"), F.lit("Gold"), F.lit(9).cast("long"))
    return merge.replace_hotspots(stored, incoming.unionAll(stray), g.bodies(spark, d))


@query(GALAXY_SQL + " SELECT body_id, body, CASE WHEN body_id%2=0 AND body_id%3<>0 THEN body_id%5 WHEN body_id%5<>0 THEN 1 END AS bio, CASE WHEN body_id%5<>0 THEN 4 WHEN body_id%2=0 THEN body_id END AS geo FROM (SELECT * FROM bodies WHERE body_id%5<>0 OR body_id%2=0)")
def merge_signals(spark, d):
    b = F.col("body_id")
    base = g.bodies(spark, d)
    stored = base.where(b % 5 != 0).select("body_id", "body", F.lit(1).cast("long").alias("bio"), F.lit(4).cast("long").alias("geo"))
    incoming = base.where(b % 2 == 0).select("body_id", "body", F.when(b % 3 != 0, b % 5).alias("bio"), F.when(b % 5 == 0, b).alias("geo"))
    return merge.merge_signals(stored, incoming, ["bio", "geo"], ["body"])


@query(GALAXY_SQL + ", dim AS (SELECT DISTINCT CAST(dense_rank() OVER (ORDER BY name) AS BIGINT)*10 AS id, name FROM commodities WHERE name<'cold'), f AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name NOT IN (SELECT name FROM dim)) SELECT id, name FROM dim UNION ALL SELECT (SELECT max(id) FROM dim)+row_number() OVER (ORDER BY name), name FROM f")
def merge_interned(spark, d):
    from pyspark.sql import Window

    dim = g.commodities(spark, d).where("name < 'cold'").select("name").distinct().withColumn("id", F.dense_rank().over(Window.orderBy("name")).cast("long") * 10)
    return merge.interned(dim, spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name")))


@query(GALAXY_SQL + """, mk AS (SELECT station_id, max(observed_at) AS a FROM market GROUP BY 1), bd AS (SELECT m.station_id, 'own'||(m.station_id%3) AS symbol, CASE WHEN m.station_id%4=0 THEN mk.a+INTERVAL 1 HOUR ELSE mk.a END AS observed_at FROM mk m JOIN mk ON mk.station_id=m.station_id WHERE m.station_id%2=0 UNION ALL SELECT -1, 'own', TIMESTAMP '2030-01-01'),
nw AS (SELECT bd.* FROM bd JOIN mk ON mk.station_id=bd.station_id WHERE observed_at>a) SELECT station_id, symbol, observed_at FROM market WHERE station_id NOT IN (SELECT station_id FROM nw) UNION ALL SELECT * FROM nw""")  # fmt: skip
def merge_fused(spark, d):
    report = g.market(spark, d).select("station_id", "symbol", "observed_at")
    marks = report.groupBy("station_id").agg(F.max("observed_at").alias("a")).where("station_id % 2 = 0")
    board = marks.select("station_id", F.concat(F.lit("own"), (F.col("station_id") % 3).cast("string")).alias("symbol"), F.when(F.col("station_id") % 4 == 0, F.col("a") + F.expr("interval 1 hour")).otherwise(F.col("a")).alias("observed_at"))
    stray = spark.range(1).select(F.lit(-1).cast("long"), F.lit("own"), F.lit("2030-01-01").cast("timestamp"))
    return merge.fuse_board(report, board.unionAll(stray))


STAR_SQL = ", inc AS (SELECT o_custkey AS address, arg_max(CASE o_orderkey%3 WHEN 0 THEN 'K' WHEN 1 THEN 'T' ELSE 'Neutron' END, o_orderkey) AS class FROM orders GROUP BY 1)"


@query(GALAXY_SQL + STAR_SQL + " SELECT 'save' AS how, address, class FROM stars WHERE address NOT IN (SELECT address FROM inc) UNION ALL SELECT 'save', address, class FROM inc UNION ALL SELECT 'unknown', address, class FROM stars UNION ALL SELECT 'unknown', address, class FROM inc WHERE address NOT IN (SELECT address FROM stars)")
def merge_star_saves(spark, d):
    o = F.col("o_orderkey")
    incoming = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("address"), F.when(o % 3 == 0, "K").when(o % 3 == 1, "T").otherwise("Neutron").alias("class"), o.alias("pos"))
    stored = g.stars(spark, d).select("address", "class")
    parts = [merge.save_stars(stored, incoming, known).select(F.lit(how).alias("how"), "address", "class") for how, known in (("save", False), ("unknown", True))]
    return parts[0].unionAll(parts[1])


@query("SELECT c_custkey AS address, unnest([c_custkey, c_custkey+1, c_custkey+2]) AS body, unnest(CASE WHEN c_custkey%2=0 THEN ['a','b'] ELSE ['a','b','c'] END) AS kind FROM customer")
def rows_unnested(spark, d):
    k = F.col("c_custkey")
    kinds = F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("address"), F.array(k, k + 1, k + 2).alias("body"), kinds.alias("kind"))
    return merge.unnested(rows, "body", "kind")


@query(GALAXY_SQL + " SELECT \"offset\", event FROM ev WHERE NOT (event IN ('view','click') AND ts<TIMESTAMP '2024-01-20')")
def events_pruned(spark, d):
    return merge.pruned(g.events(spark, d), ("view", "click"), "2024-01-20").select("offset", "event")


@query(GALAXY_SQL + " SELECT 'material' AS kind, event AS name, count(*) AS count FROM ev GROUP BY event UNION ALL SELECT 'cargo', symbol, count(*) FROM market GROUP BY symbol")
def holdings_listed(spark, d):
    count = lambda df, c: df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("count"))
    return merge.holdings(count(g.events(spark, d), "event"), count(g.market(spark, d), "symbol"))
