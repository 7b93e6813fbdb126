"""Queries over the journal, and the feed's batch half."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolith.functions import times
from astrolith.operators import journal as j
from astrolith.plans import galaxy as g
from astrolith.plans.galaxy import GALAXY_SQL
from astrolith.registry import query
from astrolith.streaming import feed

ORDER_SQL = 'ORDER BY ts, file, "offset"'


def _is(*kinds):
    return F.col("event").isin(*kinds)


@query(GALAXY_SQL + " SELECT event, count(*) AS n FROM ev GROUP BY event")
def events_histogram(spark, d):
    return j.histogram(g.events(spark, d))


@query(GALAXY_SQL + f' SELECT commander, event, "offset", k FROM (SELECT *, row_number() OVER (PARTITION BY commander, event ORDER BY ts DESC, file DESC, "offset" DESC) AS rn FROM ev) WHERE rn=1')
def events_latest(spark, d):
    return j.latest(g.events(spark, d), "commander", "event").select("commander", "event", "offset", "k")


@query(GALAXY_SQL + f' SELECT "offset", last_value(CASE WHEN event=\'view\' THEN k END IGNORE NULLS) OVER (PARTITION BY commander {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS place FROM ev')
def events_carry_forward(spark, d):
    return j.carry_forward(g.events(spark, d), _is("view"), F.col("k"), "place").select("offset", "place")


@query(GALAXY_SQL + f""" SELECT "offset", CASE WHEN epoch_us(ts)-epoch_us(c.ts)<=86400000000 THEN c."offset" END AS cause_offset, CASE WHEN epoch_us(ts)-epoch_us(c.ts)<=86400000000 THEN c.event END AS cause_event, candidates FROM
 (SELECT *, last_value(CASE WHEN event IN ('click','signup') THEN struct_pack(ts:=ts, "offset":="offset", event:=event) END IGNORE NULLS) OVER (PARTITION BY commander {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c,
 count(CASE WHEN event IN ('click','signup') THEN 1 END) OVER (PARTITION BY commander ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS candidates FROM ev) WHERE event='purchase'""")  # fmt: skip
def events_as_of(spark, d):
    return j.as_of(g.events(spark, d), _is("purchase"), _is("click", "signup"), 86400.0).select("offset", "cause_offset", "cause_event", "candidates")


SESSION_SQL = f""", se AS (SELECT *, sum(greatest(CASE WHEN event='signup' THEN 1 ELSE 0 END, prev)) OVER (PARTITION BY commander {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, lag(CASE WHEN event='error' THEN 1 ELSE 0 END, 1, 0) OVER (PARTITION BY commander {ORDER_SQL}) AS prev FROM ev))"""


def _sessions(spark, d):
    return j.sessions(g.events(spark, d), _is("signup"), _is("error"))


@query(GALAXY_SQL + SESSION_SQL + f""" SELECT commander, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS events, round(sum(coalesce(least(gap,600.0),0)),3) AS active, CAST(sum(CASE WHEN event='purchase' THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(sum(CASE WHEN event='purchase' THEN value ELSE 0 END),4) AS total
 FROM (SELECT *, (epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY commander, session {ORDER_SQL}))/1e6 AS gap FROM se) GROUP BY commander, session HAVING sum(CASE WHEN event='purchase' THEN 1 ELSE 0 END)>0""")  # fmt: skip
def events_sessions(spark, d):
    found = j.session_summary(_sessions(spark, d), _is("purchase"))
    return found.withColumns({"active": F.round("active", 3), "total": F.round("total", 4)})


@query(GALAXY_SQL + SESSION_SQL + f', gp AS (SELECT commander, session, CAST(floor((epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY commander, session {ORDER_SQL}))/1e6) AS BIGINT) AS gap FROM se WHERE event IN (\'click\',\'view\')), l AS (SELECT commander, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS xs, count(gap) AS n FROM gp GROUP BY commander)' + " SELECT commander, n, CAST(floor((xs[n//2+1]+xs[(n-1)//2+1])/2.0) AS BIGINT) AS median_gap, xs[n//2+1] AS upper_gap, CASE WHEN n>=10 THEN xs[n*9//10] END AS p90_gap FROM l WHERE n>0")
def events_gap_medians(spark, d):
    gaps = j.intervals(_sessions(spark, d), _is("click", "view"), ("commander", "session"))
    lists = gaps.where("gap_s is not null").groupBy("commander").agg(F.sort_array(F.collect_list(F.floor("gap_s").cast("long"))).alias("xs"))
    xs = F.col("xs")
    return lists.select("commander", F.size(xs).cast("long").alias("n"), j.integer_median(xs).alias("median_gap"), j.upper_median(xs).alias("upper_gap"), j.p90(xs).alias("p90_gap"))


@query(GALAXY_SQL + " SELECT event, CASE WHEN count(CASE WHEN value BETWEEN 2 AND 40 THEN value END)>=5 THEN round(median(CASE WHEN value BETWEEN 2 AND 40 THEN value END),6) END AS middle FROM ev GROUP BY event")
def events_bounded_median(spark, d):
    return g.events(spark, d).groupBy("event").agg(F.round(j.bounded_median("value", 2.0, 40.0, 5), 6).alias("middle"))


def _timeline_sql(fmt: str) -> str:
    return GALAXY_SQL + f""" SELECT bucket, coalesce(kills,0) AS kills, round(coalesce(earned,0),4) AS earned, coalesce(incidents,0) AS incidents FROM (SELECT strftime(ts,'{fmt}') AS bucket, count(*) AS kills, sum(value) AS earned FROM ev WHERE event='purchase' GROUP BY 1) a
 FULL OUTER JOIN (SELECT strftime(ts,'{fmt}') AS bucket, count(*) AS incidents FROM ev WHERE event='error' AND k<30 GROUP BY 1) b USING (bucket)"""  # fmt: skip


def _timeline(spark, d, unit):
    rows = j.timeline(g.events(spark, d), unit, _is("purchase"), _is("error") & (F.col("k") < 30))
    return rows.withColumn("earned", F.round("earned", 4))


@query(_timeline_sql("%Y-%m-%dT%H"))
def events_timeline_hour(spark, d):
    return _timeline(spark, d, "hour")


@query(_timeline_sql("%Y-%m-%d"))
def events_timeline_day(spark, d):
    return _timeline(spark, d, "day")


@query(_timeline_sql("%Y-W%W"))
def events_timeline_week(spark, d):
    return _timeline(spark, d, "week")


@query(GALAXY_SQL + f""" SELECT commander, CAST(stock AS BIGINT) AS stock FROM (SELECT commander, s-least(min(s) OVER (PARTITION BY commander, era {ORDER_SQL} ROWS UNBOUNDED PRECEDING),0) AS stock, row_number() OVER (PARTITION BY commander ORDER BY ts DESC, file DESC, "offset" DESC) AS rn FROM
 (SELECT *, sum(dl) OVER (PARTITION BY commander, era {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN event IN ('signup','click') THEN k WHEN event='error' THEN -k ELSE 0 END AS dl, sum(CASE WHEN event='signup' THEN 1 ELSE 0 END) OVER (PARTITION BY commander {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS era FROM ev)) q) WHERE rn=1""")  # fmt: skip
def events_inventory(spark, d):
    delta = F.when(_is("signup", "click"), F.col("k")).when(_is("error"), -F.col("k")).otherwise(F.lit(0))
    return j.clamped_inventory(g.events(spark, d), delta, _is("signup"), ("commander",)).select("commander", "stock")


@query(GALAXY_SQL + """ SELECT commander, arg_max(k, (ts, file, "offset")) FILTER (WHERE event='view') AS system, max(ts) FILTER (WHERE event='view') AS system_at, arg_max(value, (ts, file, "offset")) FILTER (WHERE event='purchase') AS balance, max(ts) FILTER (WHERE event='purchase') AS balance_at FROM ev GROUP BY commander""")
def events_last_values(spark, d):
    return j.last_values(g.events(spark, d), {"system": F.when(_is("view"), F.col("k")), "balance": F.when(_is("purchase"), F.col("value"))}, ("commander",))


@query(GALAXY_SQL + """, b AS (SELECT commander, arg_max(value,(ts,file,"offset")) AS v, max((ts,file,"offset")) AS since FROM ev WHERE event='signup' GROUP BY commander) SELECT b.commander, round(any_value(v)+coalesce(sum(CASE e.event WHEN 'purchase' THEN -e.value WHEN 'click' THEN e.value END),0),4) AS credits FROM b LEFT JOIN ev e ON e.commander=b.commander AND e.event IN ('purchase','click') AND (e.ts,e.file,e."offset")>since GROUP BY b.commander""")
def events_credits(spark, d):
    return j.credit_estimate(g.events(spark, d), "signup", {"purchase": -1, "click": 1}).withColumn("credits", F.round("credits", 4))


@query(GALAXY_SQL + f""", s AS (SELECT commander, (ts,file,"offset") AS o, (epoch_us(ts)-lag(epoch_us(ts)) OVER w)/1e6 AS dt, lag(value) OVER w - value AS dr FROM ev WINDOW w AS (PARTITION BY commander {ORDER_SQL})), r AS (SELECT commander, dr/dt AS rate, row_number() OVER (PARTITION BY commander ORDER BY o DESC) AS rn FROM s WHERE dt>0 AND dr>0.3),
 l AS (SELECT commander, list_sort(list(rate)) AS xs FROM r WHERE rn<=15 GROUP BY commander) SELECT c.commander, round(coalesce(xs[len(xs)//2+1], 0.01),8) AS rate FROM (SELECT DISTINCT commander FROM ev) c LEFT JOIN l ON l.commander=c.commander""")  # fmt: skip
def events_burn_rates(spark, d):
    return j.burn_rates(g.events(spark, d), F.col("value")).withColumn("rate", F.round("rate", 8))


@query(GALAXY_SQL + """ SELECT commander, target, (max(b)-min(a))/1e6 AS ttk_s FROM (SELECT commander, target, era, CASE WHEN event='click' THEN epoch_us(ts) END AS a, CASE WHEN event='purchase' THEN epoch_us(ts) END AS b FROM
 (SELECT commander, k%5 AS target, event, ts, coalesce(sum(CASE WHEN event='purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY commander, k%5 ORDER BY ts, file, "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS era FROM ev WHERE event IN ('click','purchase'))) GROUP BY commander, target, era HAVING min(a) IS NOT NULL AND max(b) IS NOT NULL AND max(b)>=min(a)""")  # fmt: skip
def events_lock_to_kill(spark, d):
    rows = g.events(spark, d).where(_is("click", "purchase")).withColumn("target", F.col("k") % 5).withColumn("event", F.when(_is("click"), "lock").otherwise("kill"))
    return j.lock_to_kill(rows)


@query(GALAXY_SQL + " SELECT raw, count(*) AS n FROM ev GROUP BY raw HAVING count(*)>1")
def events_repeated(spark, d):
    return j.repeated(g.events(spark, d), "raw")


@query(GALAXY_SQL + """ SELECT commander, CAST(k//10 AS BIGINT) AS source, sum(CASE WHEN event='purchase' THEN 1 ELSE 0 END) AS kills, count(*) AS n FROM ev GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY commander ORDER BY count(*) DESC, CAST(k//10 AS BIGINT))=1""".replace("sum(CASE WHEN event='purchase' THEN 1 ELSE 0 END)", "CAST(sum(CASE WHEN event='purchase' THEN 1 ELSE 0 END) AS BIGINT)"))
def events_dominant_source(spark, d):
    rows = g.events(spark, d).withColumn("source", F.floor(F.col("k") / 10).cast("long"))
    return j.dominant(rows, "commander", "source", _is("purchase"))


@query(GALAXY_SQL + """ SELECT "offset" FROM (SELECT "offset", max(CASE WHEN event='signup' THEN ts END) OVER (PARTITION BY commander) AS s, ts, commander FROM ev) WHERE ts>=s AND ts<=s+INTERVAL 3 HOUR""")
def events_in_window(spark, d):
    ev = g.events(spark, d)
    start = ev.where(_is("signup")).groupBy("commander").agg(F.max("ts").alias("start"))
    return j.in_windows(ev, start.withColumn("until", F.col("start") + F.expr("interval 3 hours"))).select("offset")


@query(GALAXY_SQL + """ SELECT "offset" AS id, (ts, file, "offset") > (TIMESTAMP '2024-01-15 00:00:00', '2024-01-15', 0) AS later FROM ev WHERE (ts, file, "offset") > (TIMESTAMP '2024-01-15 00:00:00', '2024-01-15', 0) ORDER BY ts, file, "offset" LIMIT 500""")
def events_page(spark, d):
    after = F.struct(F.lit("2024-01-15 00:00:00").cast("timestamp"), F.lit("2024-01-15"), F.lit(0).cast("long"))
    ev = g.events(spark, d)
    key = F.struct("ts", "file", "offset")
    return ev.where(key > after).orderBy("ts", "file", "offset").limit(500).select(F.col("offset").alias("id"), F.lit(True).alias("later"))


def _moved(spark, d):
    return g.events(spark, d).select(F.when(_is("view"), "jump").when(_is("click"), "dock").when(_is("error"), "scan").otherwise("kill").alias("kind"), "ts", ((F.col("k") * 37) % 401 - 200).cast("double").alias("x"), ((F.col("k") * 53) % 211 - 105).cast("double").alias("y"), ((F.col("k") * 71) % 307 - 153).cast("double").alias("z"))


@query(GALAXY_SQL + """, m AS (SELECT CASE event WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.4 WHEN 'error' THEN 0.5 ELSE 1.0 END AS w, floor(epoch(TIMESTAMP '2024-01-20 00:00:00'))-floor(epoch(ts)) AS age, CAST(floor(((k*37)%401-200)/100.0) AS BIGINT) AS cx, CAST(floor(((k*71)%307-153)/100.0) AS BIGINT) AS cz, (k*53)%211-105 AS y FROM ev),
 h AS (SELECT cx, cz, sum(w*pow(0.5, age/900.0)) AS heat, sum(w*pow(0.5, age/120.0)) AS fast, sum(w*pow(0.5, age/900.0)*y)/sum(w*pow(0.5, age/900.0)) AS y FROM m WHERE age>=0 GROUP BY cx, cz) SELECT cx, cz, round(heat,6) AS heat, round(fast,6) AS fast, round(y,6) AS y, round(least(1.0,greatest(0.0,fast/heat)),6) AS rising FROM h WHERE heat>=0.01""")  # fmt: skip
def feed_heat(spark, d):
    cells = feed.heat(_moved(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return cells.select("cx", "cz", *(F.round(c, 6).alias(c) for c in ("heat", "fast", "y", "rising")))


@query(GALAXY_SQL + """ SELECT seq FROM (SELECT "offset" AS seq, k AS key, ts + to_microseconds(CAST(((k*7919+"offset"*104729)%86400)*1000000 AS BIGINT)) AS stamp, max(ts + to_microseconds(CAST(((k*7919+"offset"*104729)%86400)*1000000 AS BIGINT))) OVER (PARTITION BY k ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ev) WHERE b IS NULL OR stamp>b""")
def feed_gate(spark, d):
    rows = g.events(spark, d).select(F.col("k").alias("key"), F.col("offset").alias("seq"), F.timestamp_micros(F.unix_micros("ts") + ((F.col("k") * 7919 + F.col("offset") * 104729) % 86400) * 1_000_000).alias("at"))
    return feed.gate_batch(rows).select("seq")


@query(GALAXY_SQL + """, c AS (SELECT 'k'||k AS value, count(*) AS n FROM ev GROUP BY 1), t AS (SELECT value FROM c ORDER BY n DESC, value LIMIT 20) SELECT CASE WHEN value IN (SELECT value FROM t) THEN value ELSE 'other' END AS value, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def feed_guarded(spark, d):
    return feed.guarded(g.events(spark, d).select(F.concat(F.lit("k"), F.col("k").cast("string")).alias("value")), "value", 20)


@query(GALAXY_SQL + """ SELECT op, key, stamp AS "at" FROM (SELECT ts AS stamp, event, k, "offset" AS o FROM ev), LATERAL (SELECT unnest(CASE WHEN event='view' THEN ['market'] WHEN event='click' THEN ['system'] WHEN event='signup' THEN ['system','identity'] WHEN event='error' THEN [] ELSE ['star'] END) AS op) q, LATERAL (SELECT CASE op WHEN 'market' THEN k WHEN 'identity' THEN k+100 ELSE k END AS key) p""".replace("ts AS stamp", "date_trunc('second', ts) AS stamp"))
def feed_operations(spark, d):
    ev = g.events(spark, d)
    stamp = times.iso(F.col("ts"))
    body = lambda **kv: F.to_json(F.struct(stamp.alias("timestamp"), *(v.alias(k) for k, v in kv.items())))
    k = F.col("k")
    kind = F.when(_is("view"), "commodity").otherwise("journal")
    message = (
        F.when(_is("view"), body(marketId=k)).when(_is("click"), body(event=F.lit("FSDJump"), SystemAddress=k)).when(_is("signup"), body(event=F.lit("Location"), SystemAddress=k, MarketID=k + 100))
        .when(_is("error"), body(event=F.lit("Music"))).otherwise(body(event=F.lit("Scan"), SystemAddress=k, StarType=F.lit("N")))
    )
    return feed.operations(ev.select(kind.alias("kind"), message.alias("message"))).select("op", "key", "at")


@query()
def events_callouts(spark, d):
    rows = g.events(spark, d).select("commander", "ts", "file", "offset", F.col("event").alias("kind"), (F.col("k") % 3).cast("string").alias("text"))
    return j.suppressed_repeats(rows, F.when(F.col("kind") == "error", 86400.0).otherwise(43200.0))
