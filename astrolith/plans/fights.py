"""Queries over fights, merits, missions, ships and phases of the journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolith.operators import combat, journal
from astrolith.plans import galaxy as g
from astrolith.plans.events import ORDER_SQL, SESSION_SQL, _sessions
from astrolith.plans.galaxy import GALAXY_SQL
from astrolith.registry import query

SINCE = "2024-01-10 00:00:00"
KILLS_SQL = """, kl AS (SELECT commander, ts, file, "offset", CASE WHEN k%3=0 THEN 'faction_kill_bond' ELSE 'bounty' END AS kind, CAST(floor(value*100) AS BIGINT) AS reward, CASE WHEN k%20<>0 THEN 'ship '||(k%20) END AS target_ship, CASE WHEN k%9<>0 THEN 'Faction '||(k%9) END AS faction FROM ev WHERE event='purchase'),
inc AS (SELECT *, CASE k%5 WHEN 0 THEN 'died' WHEN 1 THEN 'interdicted' WHEN 2 THEN 'interdiction' WHEN 3 THEN 'escaped_interdiction' ELSE 'other' END AS kind FROM ev WHERE event='error')"""


def _kills(spark, d):
    """Kills as the journal writes them, read out of its lines."""
    k = F.col("k")
    bond = k % 3 == 0
    reward = F.floor(F.col("value") * 100).cast("long")
    line = F.struct(F.when(bond, reward).alias("Reward"), F.when(~bond, reward).alias("TotalReward"), F.when(k % 20 != 0, F.concat(F.lit("ship "), (k % 20).cast("string"))).alias("Target"), F.when(k % 9 != 0, F.concat(F.lit("Faction "), (k % 9).cast("string"))).alias("VictimFaction"))
    rows = g.events(spark, d).where("event = 'purchase'").withColumn("raw", F.to_json(line)).withColumn("event", F.when(bond, "FactionKillBond").otherwise("Bounty"))
    return combat.kills_of(rows)


def _incidents(spark, d):
    k = F.col("k") % 5
    event = F.when(k == 0, "Died").when(k == 1, "Interdicted").when(k == 2, "Interdiction").when(k == 3, "EscapeInterdiction").otherwise("Scanned")
    return combat.incidents_of(g.events(spark, d).where("event = 'error'").withColumn("event", event))


@query(GALAXY_SQL + KILLS_SQL + ' SELECT commander, "offset", kind, reward, target_ship, faction FROM kl')
def kills_read(spark, d):
    return _kills(spark, d).select("commander", "offset", "kind", "reward", "target_ship", "faction")


@query(GALAXY_SQL + KILLS_SQL + f" SELECT a.*, b.* FROM (SELECT count(*) AS kills, CAST(coalesce(sum(CASE WHEN kind='bounty' THEN reward END),0) AS BIGINT) AS bounty_credits, CAST(coalesce(sum(CASE WHEN kind<>'bounty' THEN reward END),0) AS BIGINT) AS bond_credits FROM kl WHERE ts>=TIMESTAMP '{SINCE}') a, (SELECT count(*) FILTER (WHERE kind='died') AS deaths, count(*) FILTER (WHERE kind='interdicted') AS interdicted, count(*) FILTER (WHERE kind='interdiction') AS interdictions_made, count(*) FILTER (WHERE kind='escaped_interdiction') AS escaped FROM inc WHERE ts>=TIMESTAMP '{SINCE}') b")
def combat_summary(spark, d):
    return combat.summary(_kills(spark, d), _incidents(spark, d), SINCE)


@query(GALAXY_SQL + KILLS_SQL + f" (SELECT 'target' AS list, coalesce(target_ship,'(unknown)') AS name, count(*) AS n FROM kl WHERE ts>=TIMESTAMP '{SINCE}' GROUP BY 2 ORDER BY n DESC, name LIMIT 15) UNION ALL (SELECT 'faction', coalesce(faction,'(unknown)'), CAST(coalesce(sum(reward),0) AS BIGINT) AS n FROM kl WHERE ts>=TIMESTAMP '{SINCE}' GROUP BY 2 ORDER BY n DESC, 2 LIMIT 15)")
def combat_tops(spark, d):
    kills = _kills(spark, d)
    targets = combat.top(kills, "target_ship", SINCE, F.count("*"))
    factions = combat.top(kills, "faction", SINCE, F.coalesce(F.sum("reward"), F.lit(0)))
    return targets.select(F.lit("target").alias("list"), "name", "n").unionAll(factions.select(F.lit("faction"), "name", "n"))


SHIP_SQL = SESSION_SQL + f""", tm AS (SELECT *, CAST(floor((epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY commander, session {ORDER_SQL}))/1e6) AS BIGINT) AS gap FROM se), ss AS (SELECT commander*100000+CAST(session AS BIGINT) AS id, CASE WHEN commander%7<>0 THEN commander%7 END AS ship_id, 'type'||(commander%4) AS ship, CASE WHEN session%3<>0 THEN 'Name '||CAST(session AS BIGINT) ELSE '' END AS ship_name, min(ts) AS entered_ts, CAST(sum(coalesce(least(gap,600),0)) AS BIGINT) AS secs, count(*) FILTER (WHERE event='purchase') AS kills, count(*) FILTER (WHERE event='error') AS died FROM tm GROUP BY commander, session),
kk AS (SELECT commander*100000+CAST(session AS BIGINT) AS session_id, CASE WHEN k%4<>0 THEN k END AS ttk_s, gap AS interval_s FROM tm WHERE event='purchase'), kj AS (SELECT kk.*, ship_id, ship FROM kk JOIN ss ON ss.id=session_id WHERE entered_ts>=TIMESTAMP '{SINCE}'),
st AS (SELECT ship_id, ship, list_sort(list(ttk_s) FILTER (WHERE ttk_s IS NOT NULL)) AS t, list_sort(list(interval_s) FILTER (WHERE interval_s IS NOT NULL)) AS i FROM kj GROUP BY 1,2)"""


@query(GALAXY_SQL + SHIP_SQL + f""" SELECT s.ship_id, s.ship, coalesce(arg_max(ship_name, (entered_ts, ship_name)) FILTER (WHERE ship_name<>''),'') AS ship_name, count(*) AS sessions, CAST(sum(secs) AS BIGINT) AS secs, CAST(sum(kills) AS BIGINT) AS kills, CAST(sum(died) AS BIGINT) AS died,
 any_value(CAST(floor((t[(len(t)+1)//2]+t[len(t)//2+1])/2.0) AS BIGINT)) AS median_ttk_s, any_value(CASE WHEN len(t)>=10 THEN t[len(t)*9//10] END) AS p90_ttk_s, any_value(CAST(floor((i[(len(i)+1)//2]+i[len(i)//2+1])/2.0) AS BIGINT)) AS median_interval_s
 FROM ss s LEFT JOIN st ON st.ship_id IS NOT DISTINCT FROM s.ship_id AND st.ship=s.ship WHERE entered_ts>=TIMESTAMP '{SINCE}' GROUP BY s.ship_id, s.ship""")  # fmt: skip
def combat_by_ship(spark, d):
    rows = _sessions(spark, d)
    gap = F.floor((F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(journal.replay("commander", "session"))) / 1e6).cast("long")
    rows = rows.withColumn("gap", gap).withColumn("id", F.col("commander") * 100000 + F.col("session"))
    c = F.col("commander")
    own = rows.groupBy("id", F.when(c % 7 != 0, c % 7).alias("ship_id"), F.concat(F.lit("type"), (c % 4).cast("string")).alias("ship"), F.when(F.col("session") % 3 != 0, F.concat(F.lit("Name "), F.col("session").cast("string"))).otherwise("").alias("ship_name"))
    sessions = own.agg(F.min("ts").alias("entered_ts"), F.sum(F.coalesce(F.least("gap", F.lit(600)), F.lit(0))).alias("secs"), F.count_if(F.col("event") == "purchase").alias("kills"), F.count_if(F.col("event") == "error").alias("died"))
    kills = rows.where("event = 'purchase'").select(F.col("id").alias("session_id"), F.when(F.col("k") % 4 != 0, F.col("k")).alias("ttk_s"), F.col("gap").alias("interval_s"))
    return combat.by_ship(sessions, kills, SINCE)


@query(GALAXY_SQL + " SELECT strftime(ts,'%Y-W%W') AS bucket, CAST(sum(k) AS BIGINT) AS merits, count(*) AS awards, max(\"offset\") AS total FROM ev WHERE event='click' GROUP BY 1")
def merits_by_week(spark, d):
    merits = g.events(spark, d).where("event = 'click'").select("ts", F.col("k").alias("merits"), F.col("offset").alias("total"))
    return combat.merit_timeline(merits, "week")


@query(GALAXY_SQL + KILLS_SQL + ' SELECT "offset", kind, reward FROM kl ORDER BY ts DESC, file DESC, "offset" DESC LIMIT 40')
def kills_recent(spark, d):
    return combat.recent(_kills(spark, d), 40).select("offset", "kind", "reward")


@query(GALAXY_SQL + f" SELECT CAST(coalesce(sum(\"offset\"*7-k*(\"offset\"%5)),0) AS BIGINT) AS profit, count(*) AS sales FROM ev WHERE event='view' AND ts BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '2024-01-20 00:00:00'")
def sales_profit(spark, d):
    sales = g.events(spark, d).where("event = 'view'").select("ts", (F.col("offset") * 7).alias("total_sale"), F.col("k").alias("avg_paid"), (F.col("offset") % 5).alias("count"))
    return combat.trade_profit(sales, SINCE, "2024-01-20 00:00:00")


@query(GALAXY_SQL + " SELECT source, count(*) AS n, CAST(sum(CASE WHEN class IN ('O','B','A','F','G','K','M') THEN 1 ELSE 0 END) AS BIGINT) AS scoopable FROM stars GROUP BY source")
def stars_by_source(spark, d):
    return combat.source_counts(g.stars(spark, d))


@query(GALAXY_SQL + """, m AS (SELECT commander, max((ts,file,"offset",k%30)) FILTER (WHERE event='signup') AS p, max((ts,file,"offset",k%30)) FILTER (WHERE event='view') AS l, max(ts) FILTER (WHERE event='error') AS c FROM (SELECT * REPLACE (CASE WHEN event='view' AND "offset"%9<>0 THEN 'x' WHEN event='error' AND "offset"%7<>0 THEN 'x' ELSE event END AS event) FROM ev) GROUP BY 1)
SELECT commander, p[4] AS target FROM m WHERE p IS NOT NULL AND NOT coalesce(c>=p[1],false) AND NOT coalesce(p[4]=l[4],false) AND NOT coalesce(p[1]<l[1],false)""")  # fmt: skip
def nav_targets(spark, d):
    event, n = F.col("event"), F.col("offset")
    place = F.col("k") % 30
    return combat.nav_targets(g.events(spark, d), event == "signup", place, (event == "error") & (n % 7 == 0), (event == "view") & (n % 9 == 0), place)


@query(GALAXY_SQL + f""", n AS (SELECT commander, event AS a, lead(event) OVER w AS b, (epoch_us(lead(ts) OVER w)-epoch_us(ts))/1e6 AS s FROM ev WINDOW w AS (PARTITION BY commander {ORDER_SQL})), p AS (SELECT commander, CASE WHEN a='view' AND b='click' AND s BETWEEN 60 AND 50000 THEN 'dock' WHEN a='click' AND b='view' AND s BETWEEN 30 AND 90000 THEN 'jump' END AS phase, s FROM n),
m AS (SELECT commander, phase, median(s) AS m FROM p WHERE phase IS NOT NULL GROUP BY 1,2 HAVING count(*)>=3) SELECT c.commander, v.phase, round(coalesce(m.m, v.prior),6) AS seconds FROM (SELECT DISTINCT commander FROM ev) c CROSS JOIN (VALUES ('dock',95.0),('jump',45.0)) v(phase, prior) LEFT JOIN m ON m.commander=c.commander AND m.phase=v.phase""")  # fmt: skip
def phases_timed(spark, d):
    phases = {"dock": ("view", "click", 60.0, 50000.0, 95.0), "jump": ("click", "view", 30.0, 90000.0, 45.0)}
    return combat.phase_times(g.events(spark, d), phases).withColumn("seconds", F.round("seconds", 6))


@query(GALAXY_SQL + " SELECT commander, round(coalesce(avg(CASE WHEN event='view' AND commander%5<>0 THEN k END),20.0),6) AS minutes FROM ev GROUP BY commander")
def carriers_cadence(spark, d):
    jumps = g.events(spark, d).select("commander", F.when((F.col("event") == "view") & (F.col("commander") % 5 != 0), F.col("k")).alias("minutes"))
    return combat.cadence(jumps, 20.0).withColumn("minutes", F.round("minutes", 6))


def _mission_rows(spark, d):
    """Sign-ups accept, purchases complete, errors fail, and views list the open ones."""
    event, k = F.col("event"), F.col("k")
    status = F.when(event == "signup", "accepted").when(event == "purchase", "completed").when(event == "error", "failed").when(event == "view", "listed")
    expiry = F.when(k % 3 != 0, F.col("ts") + F.expr("interval 9 days"))
    listed = F.array(k % 7, (k + 1) % 7, (k + 3) % 7, (k + 4) % 7, (k + 5) % 7)
    rows = g.events(spark, d).select("commander", "ts", "file", "offset", (k % 7).alias("mission"), status.alias("status"), expiry.alias("expiry"), F.when(event == "view", listed).alias("open_missions"))
    return rows.where("status is not null")


MISSIONS_SQL = """, mr AS (SELECT commander, (ts,file,"offset") AS o, ts, k%7 AS mission, CASE event WHEN 'signup' THEN 'accepted' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'listed' END AS status, CASE WHEN k%3<>0 THEN ts+INTERVAL 9 DAY END AS expiry, [k%7,(k+1)%7,(k+3)%7,(k+4)%7,(k+5)%7] AS om FROM ev WHERE event IN ('signup','purchase','error','view')),
ac AS (SELECT commander, mission, max((o, expiry)) AS a FROM mr WHERE status='accepted' GROUP BY 1,2), ed AS (SELECT ac.commander, ac.mission, min((r.o, CASE WHEN r.status='listed' THEN 'completed' ELSE r.status END)) AS e FROM ac JOIN mr r ON r.commander=ac.commander AND r.o>a[1] AND ((r.status='listed' AND NOT list_contains(om, ac.mission)) OR (r.status IN ('completed','failed') AND r.mission=ac.mission)) GROUP BY 1,2),
nw AS (SELECT commander, max(ts) AS now FROM mr GROUP BY 1), ms AS (SELECT ac.commander, ac.mission, coalesce(e[2], CASE WHEN a[2]<now THEN 'expired' ELSE 'accepted' END) AS status, a[1][1] AS accepted_at, a[2] AS expiry FROM ac LEFT JOIN ed ON ed.commander=ac.commander AND ed.mission=ac.mission JOIN nw ON nw.commander=ac.commander)"""


@query(GALAXY_SQL + MISSIONS_SQL + " SELECT * FROM ms")
def events_missions(spark, d):
    return combat.missions(_mission_rows(spark, d))


BOARD_SQL = MISSIONS_SQL + ", bd AS (SELECT commander, mission, CASE WHEN status IN ('accepted','expired') THEN 'active' ELSE 'ready' END AS status, accepted_at, expiry, CASE WHEN mission%2=0 THEN 'Giver' ELSE 'GIVER' END||(mission%3) AS faction, CASE WHEN mission<>6 THEN 'Target '||((mission+commander)%2) END AS target_faction, CASE WHEN mission%4<>1 THEN 'Sys '||(mission%2) END AS target_system, mission*3+1 AS kill_count, mission*1000 AS reward, mission%2=1 AS wing FROM ms)"


def _board(spark, d):
    m = F.col("mission")
    rows = combat.missions(_mission_rows(spark, d)).withColumn("status", F.when(F.col("status").isin("accepted", "expired"), "active").otherwise("ready"))
    text = lambda head, v: F.concat(F.lit(head), v.cast("string"))
    return rows.withColumns({
        "faction": F.concat(F.when(m % 2 == 0, "Giver").otherwise("GIVER"), (m % 3).cast("string")), "target_faction": F.when(m != 6, text("Target ", (m + F.col("commander")) % 2)),
        "target_system": F.when(m % 4 != 1, text("Sys ", m % 2)), "kill_count": m * 3 + 1, "reward": m * 1000, "wing": m % 2 == 1,
    })


@query(GALAXY_SQL + BOARD_SQL + " SELECT commander, mission, status, CAST(row_number() OVER (PARTITION BY commander ORDER BY CASE status WHEN 'active' THEN 0 ELSE 1 END, expiry ASC NULLS LAST, accepted_at, mission) AS INTEGER) AS place FROM bd")
def missions_displayed(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("commander").orderBy(*combat.display_order()))
    return _board(spark, d).select("commander", "mission", "status", place.alias("place"))


@query(GALAXY_SQL + BOARD_SQL + """, pt AS (SELECT commander, target_faction, count(*) AS n FROM bd WHERE target_faction IS NOT NULL GROUP BY 1,2), pk AS (SELECT commander, arg_min(target_faction, (-n, target_faction)) AS target_faction, CAST(sum(n) AS BIGINT) AS alln FROM pt GROUP BY 1), mi AS (SELECT b.* FROM bd b JOIN pk USING (commander, target_faction)),
gv AS (SELECT commander, lower(faction) AS giver, count(*) AS n, sum(kill_count) AS kills, sum(CASE WHEN status='active' THEN kill_count ELSE 0 END) AS op, sum(reward) AS v, sum(CASE WHEN status='ready' THEN reward ELSE 0 END) AS vr, sum(CASE WHEN wing THEN reward ELSE 0 END) AS vs FROM mi GROUP BY 1,2),
sy AS (SELECT commander, arg_min(target_system, (-n, target_system)) AS target_system FROM (SELECT commander, target_system, count(*) AS n FROM mi WHERE target_system IS NOT NULL GROUP BY 1,2) GROUP BY 1)
SELECT p.commander, p.target_faction, target_system, count(*) AS givers, count(*) FILTER (WHERE n>1) AS duplicates, CAST(sum(n) AS BIGINT) AS missions, any_value(alln)-CAST(sum(n) AS BIGINT) AS other_targets, CAST(max(kills) AS BIGINT) AS kills_needed, CAST(max(op) AS BIGINT) AS kills_remaining, CAST(sum(kills) AS BIGINT) AS kills_credited, CAST(sum(v) AS BIGINT) AS value, CAST(sum(vr) AS BIGINT) AS value_ready, CAST(sum(vs) AS BIGINT) AS value_shareable
FROM gv JOIN pk p USING (commander) LEFT JOIN sy USING (commander) GROUP BY p.commander, p.target_faction, target_system""")  # fmt: skip
def missions_stacked(spark, d):
    return combat.stacks(_board(spark, d))


def ship_parts(spark, d):
    """Views are snapshots of all stored ships, clicks are transfers; every eighth station's system has a carrier."""
    ev = g.events(spark, d).select("commander", "ts", "file", "offset", "event", "k")
    k, n = F.col("k"), F.col("offset")
    snapshots = ev.where("event = 'view'").select("commander", "ts", "file", "offset", F.concat(F.lit("Sys "), (k % 30).cast("string")).alias("system"), F.concat(F.lit("Dock "), (k % 30).cast("string")).alias("station"), (k % 30).alias("market_id"))
    listed = ev.where("event = 'view'").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(5)))).where((n + F.col("j")) % 3 != 0)
    j = F.col("j")
    ships = listed.select(
        "commander", "ts", "file", "offset", j.cast("long").alias("ship_id"), F.when((n + j) % 5 != 0, F.concat(F.lit("type"), j.cast("string"))).alias("ship_type"), F.when((n + j) % 4 == 1, F.concat(F.lit(" Name "), (k % 9).cast("string"), F.lit(" "))).when((n + j) % 4 == 2, "  ").alias("name"),
        (j % 2 == 0).alias("here"), ((n + j) % 7 == 0).alias("in_transit"), F.when((n + j) % 6 != 0, F.concat(F.lit("Far "), (k % 11).cast("string"))).alias("system"), F.when((n + j) % 8 != 0, (k + j) % 40).alias("market_id"),
    )
    transfers = ev.where("event = 'click'").select("commander", "ts", "file", "offset", (k % 8).alias("ship_id"), F.when(n % 3 == 0, F.concat(F.lit("type"), (k % 8).cast("string"))).alias("ship_type"), F.when(n % 6 != 0, (k * 3) % 45).alias("market_id"), F.when(n % 5 != 0, 600 + k * 9000).alias("seconds"))
    docks = g.stations(spark, d).select(F.col("id").alias("market_id"), "station", F.concat(F.lit("Home "), F.col("system_address").cast("string")).alias("system"))
    carriers = g.stations(spark, d).where("is_carrier").select(F.col("id").alias("carrier_id"), F.concat(F.lit("CAR-"), F.col("id").cast("string")).alias("callsign"), F.when(F.col("id") % 2 == 0, "Now here").alias("system"))
    return snapshots, ships, transfers, docks, carriers


@query()
def ships_located(spark, d):
    *parts, carriers = ship_parts(spark, d)
    found = combat.whereabouts(combat.ship_locations(*parts), carriers, "2024-01-31 00:00:00")
    return found.select("commander", "ship_id", "ship_type", "name", "status", "system", "station", "market_id", "arrival", "minutes", "as_of", "age_hours")


@query(GALAXY_SQL + """ SELECT commander, engineer, rank, progress FROM (SELECT commander, (ts,file,"offset") AS o, unnest(CASE WHEN event='view' THEN ['Eng '||(k%4), 'Eng '||(k%5+4)] ELSE ['Eng '||(k%9)] END) AS engineer, CAST(k%6 AS INTEGER) AS rank, event AS progress FROM ev WHERE event IN ('view','click')) QUALIFY row_number() OVER (PARTITION BY commander, engineer ORDER BY o DESC)=1""")
def engineers_known(spark, d):
    """Views hold a list of engineers, clicks a single one, as JSON."""
    k = F.col("k")
    name = lambda v: F.concat(F.lit("Eng "), v.cast("string"))
    one = lambda v: F.struct(name(v).alias("Engineer"), (k % 6).cast("int").alias("Rank"), F.col("event").alias("Progress"))
    raw = F.when(F.col("event") == "view", F.to_json(F.struct(F.array(one(k % 4), one(k % 5 + 4)).alias("Engineers")))).otherwise(F.to_json(one(k % 9)))
    return combat.engineers(g.events(spark, d).where("event in ('view', 'click')").withColumn("raw", raw)).select("commander", "engineer", "rank", "progress")


@query("SELECT p_partkey AS id, list_transform([0,1,2,3], lambda s: CASE WHEN s=p_partkey%4 THEN 'slot'||s||':item:grade5' ELSE 'slot'||s||':item:'||CASE WHEN s%2=0 THEN 'grade1' ELSE '-' END END) AS modules FROM part".replace(" AS modules", "").replace("SELECT p_partkey AS id, list_transform", "SELECT p_partkey AS id, array_to_string(list_transform").replace("END END)", "END END), ',') AS modules"))
def loadouts_patched(spark, d):
    """One slot's engineering set in a loadout read from JSON."""
    p = F.col("p_partkey")
    slot = lambda n: F.struct(F.lit(f"slot{n}").alias("slot"), F.lit("item").alias("item"), F.lit("grade1" if n % 2 == 0 else None).cast("string").alias("engineering"))
    raw = F.to_json(F.array(*(slot(n) for n in range(4))))
    rows = spark.read.parquet(f"{d}/part.parquet").select(p.alias("id"), F.from_json(raw, "array<struct<slot: string, item: string, engineering: string>>").alias("modules"))
    patched = combat.patch_slot(F.col("modules"), F.concat(F.lit("slot"), (F.col("id") % 4).cast("string")), F.lit("grade5"))
    shown = F.transform(patched, lambda m: F.concat_ws(":", m["slot"], m["item"], F.coalesce(m["engineering"], F.lit("-"))))
    return rows.select("id", F.array_join(shown, ",").alias("modules"))


@query(GALAXY_SQL + ' SELECT commander, event, "offset", k FROM ev QUALIFY row_number() OVER (PARTITION BY commander, event ORDER BY ts DESC, file DESC, "offset" DESC)=1')
def events_resumed(spark, d):
    """The state of an earlier run and the events since give what all events give."""
    ev = g.events(spark, d).select("commander", "event", "ts", "file", "offset", "k")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    state = journal.latest(ev.where(F.col("ts") < cut), "commander", "event")
    return combat.resumed(state, ev.where(F.col("ts") >= cut), ("commander", "event")).select("commander", "event", "offset", "k")


@query(GALAXY_SQL + " SELECT count(DISTINCT commander) AS commanders, count(*) AS events FROM ev")
def commanders_counted(spark, d):
    return g.events(spark, d).agg(F.countDistinct("commander").alias("commanders"), F.count("*").alias("events"))


@query()
def requests_limited(spark, d):
    rows = g.events(spark, d).select((F.col("commander") % 4).alias("source"), "ts", F.col("offset").alias("id"))
    return combat.rate_limited(rows, 36_000.0, 40, 1200.0, 5).groupBy("source", "passed").agg(F.count("*").alias("n"))


def _lines(spark, d, kind: str, name: str, line):
    return g.events(spark, d).where(F.col("event") == kind).withColumn("raw", F.to_json(line)).withColumn("event", F.lit(name))


@query(GALAXY_SQL + " SELECT commander, \"offset\", 'good '||(k%40) AS commodity, k AS market_id, \"offset\"%9 AS count, k*7 AS total_sale, CASE WHEN k%4<>0 THEN k END AS avg_paid FROM ev WHERE event='view'")
def sales_read(spark, d):
    k, n = F.col("k"), F.col("offset") % 9
    line = F.struct(F.concat(F.lit("good "), (k % 40).cast("string")).alias("Type"), k.alias("MarketID"), F.when(n > 0, n).alias("Count"), (k * 7).alias("TotalSale"), F.when(k % 4 != 0, k).alias("AvgPricePaid"))
    return combat.sales_of(_lines(spark, d, "view", "MarketSell", line)).select("commander", "offset", "commodity", "market_id", "count", "total_sale", "avg_paid")


@query(GALAXY_SQL + " SELECT commander, \"offset\", 'Power '||(k%5) AS power, k AS merits, k*100 AS total FROM ev WHERE event='click'")
def merits_read(spark, d):
    k = F.col("k")
    line = F.struct(F.concat(F.lit("Power "), (k % 5).cast("string")).alias("Power"), k.alias("MeritsGained"), (k * 100).alias("TotalMerits"))
    return combat.merits_of(_lines(spark, d, "click", "PowerplayMerits", line)).select("commander", "offset", "power", "merits", "total")


@query(GALAXY_SQL + f" SELECT commander, \"offset\", CASE WHEN k%2=0 THEN 'raw' ELSE '' END AS trader, CASE WHEN k%3=0 THEN 'Iron' ELSE 'iron' END AS paid, k AS paid_qty, 'zinc' AS received, CAST(CASE WHEN k%5=0 THEN 0 ELSE 2 END AS BIGINT) AS received_qty FROM ev WHERE event='click' AND k%7<>0 AND ts>=TIMESTAMP '{SINCE}'")
def trades_read(spark, d):
    k = F.col("k")
    paid = F.struct(F.lit("iron").alias("Material"), F.when(k % 3 == 0, "Iron").alias("Material_Localised"), k.alias("Quantity"))
    received = F.when(k % 7 != 0, F.struct(F.lit("zinc").alias("Material"), F.when(k % 5 != 0, 2).alias("Quantity")))
    rows = combat.material_trades(_lines(spark, d, "click", "MaterialTrade", F.struct(F.when(k % 2 == 0, "raw").alias("TraderType"), paid.alias("Paid"), received.alias("Received"))), SINCE)
    return rows.select("commander", "offset", "trader", "paid", "paid_qty", "received", "received_qty")


@query(GALAXY_SQL + """ SELECT commander, CAST(s AS INTEGER) AS slot, 'int_'||(k%9+s) AS item, 'Sys '||k AS system FROM (SELECT * FROM ev WHERE event='view' QUALIFY row_number() OVER (PARTITION BY commander ORDER BY ts DESC, file DESC, "offset" DESC)=1), (VALUES (0),(1),(2)) v(s) WHERE s<k%4""")
def modules_stored(spark, d):
    k = F.col("k")
    one = lambda s: F.when(k % 4 > s, F.struct(F.lit(s).alias("StorageSlot"), F.concat(F.lit("int_"), (k % 9 + s).cast("string")).alias("Name"), F.concat(F.lit("Sys "), k.cast("string")).alias("StarSystem")))
    return combat.stored_modules(_lines(spark, d, "view", "StoredModules", F.struct(F.array_compact(F.array(one(0), one(1), one(2))).alias("Items"))))
