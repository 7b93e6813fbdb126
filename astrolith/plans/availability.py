"""Queries over modules and ships on offer, powers, discounts and requests."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from astrolith.functions import discounts
from astrolith.operators import boards
from astrolith.plans import galaxy as g
from astrolith.plans.galaxy import GALAXY_SQL
from astrolith.plans.trading import WIDE
from astrolith.registry import query

NEAR_SQL = ", near AS (SELECT st.id, st.station, sy.name AS system, sqrt(sy.x*sy.x+sy.y*sy.y+sy.z*sy.z) AS distance_ly, sy.controlling_power, sy.power_state, is_carrier, pad_large, pad_medium, pad_small FROM stations st JOIN systems sy ON sy.address=st.system_address WHERE sy.x*sy.x+sy.y*sy.y+sy.z*sy.z<=40000)"
SMALL_SQL = "(coalesce(pad_large,0)>0 OR coalesce(pad_medium,0)>0 OR coalesce(pad_small,0)>0) AND NOT is_carrier"


def _shown(rows, *more):
    return rows.select("id", "station", "system", "symbol", F.round("distance_ly", 6).alias("distance_ly"), *more)


@query(GALAXY_SQL + NEAR_SQL + f" SELECT n.id, station, system, symbol, round(distance_ly,6) AS distance_ly, credits_price, merc_price, observed_at FROM outfitting a JOIN near n ON n.id=a.station_id WHERE {SMALL_SQL} AND contains(lower(symbol),'pulselaser') AND (credits_price IS NULL OR credits_price>0) ORDER BY n.distance_ly, n.id, symbol LIMIT 100")
def outfitting_search(spark, d):
    rows = boards.availability(g.systems(spark, d), g.stations(spark, d), g.outfitting(spark, d), WIDE, " PulseLaser ", credits_only=True)
    return _shown(rows, "credits_price", "merc_price", "observed_at")


@query(GALAXY_SQL + NEAR_SQL + " SELECT n.id, station, system, symbol, round(distance_ly,6) AS distance_ly, credits_price, merc_price FROM outfitting a JOIN near n ON n.id=a.station_id WHERE coalesce(pad_large,0)>0 AND symbol IN ('int_hyperdrive_size5_class5_3','int_cargorack_size4_class1_0','hpt_cannon_gimbal_large_4') AND controlling_power IN ('Power 1','Power 3') ORDER BY n.distance_ly, n.id, symbol LIMIT 100")
def outfitting_exact(spark, d):
    """A set of symbols, in any coin, carriers included, where large pads are, in two powers' space."""
    search = replace(WIDE, carriers=True, min_pad="large", powers=("Power 1", "Power 3"))
    wanted = ("int_hyperdrive_size5_class5_3", " INT_cargorack_size4_class1_0", "hpt_cannon_gimbal_large_4", "")
    return _shown(boards.availability(g.systems(spark, d), g.stations(spark, d), g.outfitting(spark, d), search, symbols=wanted), "credits_price", "merc_price")


@query(GALAXY_SQL + NEAR_SQL + f" SELECT n.id, station, system, symbol, round(distance_ly,6) AS distance_ly FROM shipyard a JOIN near n ON n.id=a.station_id WHERE {SMALL_SQL} AND contains(symbol,'a') ORDER BY n.distance_ly, n.id, symbol LIMIT 100")
def shipyard_search(spark, d):
    return _shown(boards.availability(g.systems(spark, d), g.stations(spark, d), g.shipyard(spark, d), WIDE, "a"))


@query("""WITH s AS (SELECT l_suppkey AS market_id, 'm'||(l_partkey%50) AS symbol, CAST(date_trunc('year', l_shipdate) AS TIMESTAMP) AS ts, CAST(l_quantity AS BIGINT)-10 AS credits, CAST(l_linenumber AS BIGINT)-2 AS merc, l_orderkey AS variant FROM lineitem),
n AS (SELECT market_id, max(ts) AS ts FROM s GROUP BY 1) SELECT market_id, symbol, ts, coalesce(min(CASE WHEN credits>0 THEN credits END),0) AS credits, coalesce(min(CASE WHEN merc>0 THEN merc END),0) AS merc, coalesce(array_to_string(list_sort(list(CASE WHEN merc>0 THEN variant END) FILTER (WHERE merc>0)),','),'') AS variants FROM s JOIN n USING (market_id, ts) GROUP BY 1,2,3""")  # fmt: skip
def outfitting_seen(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    symbol = F.concat(F.lit(" M"), (F.col("l_partkey") % 50).cast("string"))
    seen = rows.select(F.col("l_suppkey").alias("market_id"), symbol.alias("symbol"), F.date_trunc("year", "l_shipdate").alias("ts"), (F.col("l_quantity").cast("long") - 10).alias("credits"), (F.col("l_linenumber").cast("long") - 2).alias("merc"), F.col("l_orderkey").alias("variant"))
    return boards.seen_prices(seen).withColumn("variants", F.array_join("variants", ","))


def _covers_sql(k: int, r: discounts.Rule) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    test = ["elite"] if r.elite else []
    if r.kind == "ships":
        test.append(f"ship AND symbol IN ({','.join(map(q, r.symbols))})")
    if r.kind == "weapons":
        test.append("NOT ship AND starts_with(symbol,'hpt_') AND NOT (" + " OR ".join(f"contains(symbol,{q(u)})" for u in discounts.UTILITY) + ")")
    if r.kind == "modules":
        test.append("NOT ship AND (" + " OR ".join(f"contains(symbol,{q(u)})" for u in r.symbols) + ")")
    test += [f"NOT contains(symbol,{q(x)})" for x in r.excluding]
    test += [f"lower({c})=lower({q(v)})" for c, v in (("station", r.station), ("system", r.system), ("power", r.power)) if v]
    if r.states:
        test.append(f"state IN ({','.join(map(q, r.states))})")
    return f"SELECT id, symbol, {r.percent} AS percent, {k} AS rule FROM items WHERE {' AND '.join(f'({t})' for t in test) or 'true'}"


#: Places that rules name, dealt out to stations and systems.
PLACES = (("Daedalus", "Sol"), ("Jameson Memorial", "Shinrarta Dezhra"), ("Attilius Orbital", "CD-43 11917"), ("Irkutsk", "Alioth"), ("Some Port", "Some System"))
POWERS = ("Jerome Archer", "Denton Patreus", "Li Yong-Rui", "Edmund Mahon")
STATES = ("Stronghold", "Fortified", "Exploited")
_case = lambda c, names: f"CASE {c} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"
ITEMS_SQL = f""", items AS (SELECT i.station_id AS id, symbol, ship, {_case('i.station_id%6', [p[0] for p in PLACES])} AS station, {_case('i.station_id%6', [p[1] for p in PLACES])} AS system, {_case('i.station_id%5', POWERS)} AS power, {_case('i.station_id%4', STATES)} AS state, i.station_id%2=0 AS elite
 FROM (SELECT station_id, symbol, false AS ship FROM outfitting UNION ALL SELECT station_id, symbol, true FROM shipyard) i)"""


def _items(spark, d):
    both = g.outfitting(spark, d).select("station_id", "symbol", F.lit(False).alias("ship")).unionAll(g.shipyard(spark, d).select("station_id", "symbol", F.lit(True)))
    s = F.col("station_id")
    named = lambda names, n: F.get(F.array(*(F.lit(x) for x in names)), (s % n).cast("int"))
    return both.select(s.alias("id"), "symbol", "ship", named([p[0].upper() for p in PLACES], 6).alias("station"), named([p[1] for p in PLACES], 6).alias("system"), named(POWERS, 5).alias("power"), named(STATES, 4).alias("state"), (s % 2 == 0).alias("elite"))


def _discounted(spark, d):
    found = discounts.discounts(*(F.col(c) for c in ("ship", "symbol", "station", "system", "power", "state", "elite")))
    return _items(spark, d).withColumn("discounts", found)


@query(GALAXY_SQL + ITEMS_SQL + ", r AS (" + " UNION ALL ".join(_covers_sql(k, r) for k, r in enumerate(discounts.RULES)) + ") SELECT id, symbol, CAST(row_number() OVER (PARTITION BY id, symbol ORDER BY percent DESC, rule)-1 AS INTEGER) AS place, CAST(percent AS DOUBLE) AS percent, CAST(rule AS INTEGER) AS rule FROM r")
def discounts_applied(spark, d):
    rows = _discounted(spark, d).select("id", "symbol", F.posexplode("discounts").alias("place", "x"))
    return rows.select("id", "symbol", "place", F.col("x.percent").alias("percent"), F.col("x.rule").cast("int").alias("rule"))


@query(GALAXY_SQL + ITEMS_SQL + ", r AS (" + " UNION ALL ".join(_covers_sql(k, r) for k, r in enumerate(discounts.RULES)) + ") SELECT i.id, symbol FROM items i JOIN stations st ON st.id=i.id WHERE (i.id, symbol) IN (SELECT (id, symbol) FROM r) AND lower(power)='jerome archer' AND NOT is_carrier")
def discounts_filtered(spark, d):
    """What of a search's rows stays: discounted, in one power's space, at no carrier."""
    rows = _discounted(spark, d).withColumnRenamed("power", "controlling_power").join(g.stations(spark, d).select("id", "is_carrier"), "id")
    return boards.post_filter(rows, True, "jerome archer", False).select("id", "symbol")


def _power_sql(power: str, mode: str, state: str) -> str:
    controls = f"coalesce(lower(controlling_power)=lower('{power}'), false)"
    present = f"({controls} OR len(list_filter(powers, lambda x: lower(x)=lower('{power}')))>0)"
    place = {"present": present, "undermining": f"{present} AND NOT {controls}", "controls": controls}[mode]
    held = {"none": "power_state IS NULL AND controlling_power IS NULL", "": "true"}.get(state, f"lower(power_state)=lower('{state}')")
    return f"SELECT address, '{mode}' AS mode, '{state}' AS state FROM powered WHERE {place} AND {held}"


ASKED = (("power 1", "controls", "stronghold"), ("Power 2", "present", ""), ("Power 4", "undermining", "Exploited"))


@query(GALAXY_SQL + " " + " UNION ALL ".join(_power_sql(*x) for x in ASKED) + " UNION ALL SELECT address, 'any', 'none' FROM powered WHERE power_state IS NULL AND controlling_power IS NULL")
def systems_powerplay(spark, d):
    rows = g.powered(spark, d)
    parts = [rows.where(boards.power_ok(p, m, s or None)).select("address", F.lit(m).alias("mode"), F.lit(s).alias("state")) for p, m, s in ASKED]
    parts.append(rows.where(boards.power_ok(None, state="None")).select("address", F.lit("any").alias("mode"), F.lit("none").alias("state")))
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query(GALAXY_SQL + " SELECT address FROM powered WHERE lower(trim(controlling_faction))='faction 4'")
def systems_of_faction(spark, d):
    return g.powered(spark, d).where(boards.faction_ok("FACTION 4")).select("address")


REQUEST = ["Customer#000000012", "customer#000000003", "CUSTOMER#000000007", "nowhere", "Customer#000000003"]


@query(GALAXY_SQL + " SELECT id, station, place, is_carrier, CAST(row_number() OVER (ORDER BY place, is_carrier, station, id) AS INTEGER) AS at FROM (SELECT st.id, station, is_carrier, CAST(list_position(['customer#000000012','customer#000000003','customer#000000007','nowhere'], lower(name)) AS BIGINT) AS place FROM stations st JOIN systems sy ON sy.address=st.system_address) WHERE place>0")
def stations_requested(spark, d):
    from pyspark.sql import Window

    rows = g.stations(spark, d).join(g.systems(spark, d).select(F.col("address").alias("system_address"), F.col("name").alias("system")), "system_address")
    found = boards.requested(rows, REQUEST)
    return found.select("id", "station", "place", "is_carrier", F.row_number().over(Window.orderBy("place", "is_carrier", "station", "id")).alias("at"))


@query(GALAXY_SQL + ", c AS (SELECT symbol, name FROM commodities UNION ALL SELECT 'b'||symbol, CASE WHEN part%2=0 THEN '' END FROM commodities UNION ALL SELECT lower(name), NULL FROM commodities WHERE part=7) SELECT symbol, name FROM c WHERE lower(symbol)=(SELECT lower(name) FROM commodities WHERE part=7) OR lower(name)=(SELECT lower(name) FROM commodities WHERE part=7) ORDER BY (name IS NULL OR name=''), symbol LIMIT 1")
def market_exact(spark, d):
    """A name that a nameless variant has as its symbol: the row with a name comes first."""
    rows = g.commodities(spark, d).select("symbol", "name", "part")
    one = rows.where("part = 7").first()
    nameless = rows.select(F.concat(F.lit("b"), "symbol").alias("symbol"), F.when(F.col("part") % 2 == 0, "").alias("name"))
    variant = rows.where("part = 7").select(F.lower("name").alias("symbol"), F.lit(None).cast("string").alias("name"))
    return boards.exact_commodity(rows.select("symbol", "name").unionAll(nameless).unionAll(variant), one.name)


@query(GALAXY_SQL + ", p AS (SELECT station_id, CASE WHEN station_id%2=0 THEN p.symbol ELSE upper(c.name) END AS symbol FROM prohibited p JOIN commodities c ON c.symbol=lower(p.symbol)) SELECT DISTINCT p.station_id, c.symbol FROM p JOIN commodities c ON lower(p.symbol)=c.symbol OR lower(p.symbol)=lower(c.name)")
def market_banned(spark, d):
    """Forbidden goods listed by symbol at every other station and by name at the rest."""
    goods = g.commodities(spark, d)
    listed = g.prohibited(spark, d).join(goods.select(F.col("symbol").alias("good"), "name"), F.lower("symbol") == F.col("good"))
    listed = listed.select("station_id", F.when(F.col("station_id") % 2 == 0, F.col("symbol")).otherwise(F.upper("name")).alias("symbol"))
    return boards.banned_goods(listed, goods)


@query(GALAXY_SQL + " SELECT station_id, symbol, observed_at FROM market WHERE observed_at>=TIMESTAMP '2001-11-28 12:00:00'")
def market_since(spark, d):
    return boards.fresh_since(g.market(spark, d), "2001-11-28 12:00:00").select("station_id", "symbol", "observed_at")


@query(GALAXY_SQL + " SELECT 'systems' AS name, count(*) AS n FROM systems UNION ALL SELECT 'stations', count(*) FROM stations UNION ALL SELECT 'market', count(*) FROM market UNION ALL SELECT 'bodies', count(*) FROM bodies UNION ALL SELECT 'events', count(*) FROM ev")
def tables_counted(spark, d):
    return boards.table_counts({"systems": g.systems(spark, d), "stations": g.stations(spark, d), "market": g.market(spark, d), "bodies": g.bodies(spark, d), "events": g.events(spark, d)})


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE starts_with(lower(s_name||'_%'), 'supplier#00000001') ")
def names_prefixed(spark, d):
    rows = g.stations(spark, d).select("id", F.col("station").alias("name"))
    return rows.where(boards.prefixed(F.concat("name", F.lit("_%")), " Supplier#00000001"))
