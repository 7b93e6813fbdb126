"""Queries over blueprints, materials, builds and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolith.operators import engineering as eng
from astrolith.plans import galaxy as g
from astrolith.plans.galaxy import GALAXY_SQL
from astrolith.registry import query

BLUEPRINT_SQL = """, bp AS (SELECT DISTINCT 'Module '||(l_partkey%8) AS module, 'Blueprint '||(l_partkey%5) AS name, CAST(l_linenumber%5+1 AS BIGINT) AS grade, 'Material '||(l_suppkey%20) AS material, CAST(l_suppkey%4+1 AS BIGINT) AS quantity, 'Eng '||(l_suppkey%9) AS engineer FROM lineitem),
need AS (SELECT DISTINCT module, name, grade, material, quantity FROM bp), pl AS (SELECT o_orderkey AS plan, 'Module '||(o_orderkey%8) AS module, 'Blueprint '||(o_custkey%5) AS name, o_orderkey%3 AS from_grade, o_orderkey%3+1+o_custkey%3 AS target FROM orders)"""


def _blueprints(spark, d):
    text = lambda head, c, n: F.concat(F.lit(head), (F.col(c) % n).cast("string"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.select(text("Module ", "l_partkey", 8).alias("module"), text("Blueprint ", "l_partkey", 5).alias("name"), (F.col("l_linenumber") % 5 + 1).cast("long").alias("grade"), text("Material ", "l_suppkey", 20).alias("material"), (F.col("l_suppkey") % 4 + 1).cast("long").alias("quantity"), text("Eng ", "l_suppkey", 9).alias("engineer")).distinct()


def _needs(spark, d, **how):
    text = lambda head, c, n: F.concat(F.lit(head), (F.col(c) % n).cast("string"))
    first = F.col("o_orderkey") % 3
    plans = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("plan"), text("Module ", "o_orderkey", 8).alias("module"), text("Blueprint ", "o_custkey", 5).alias("name"), first.alias("from_grade"), (first + 1 + F.col("o_custkey") % 3).alias("target"))
    return eng.requirements(plans, _blueprints(spark, d).drop("engineer").distinct(), **how)


@query("WITH" + BLUEPRINT_SQL[1:] + """ SELECT 'once' AS how, plan, material, CAST(sum(quantity) AS BIGINT) AS need FROM pl JOIN need USING (module, name) WHERE grade>from_grade AND grade<=target GROUP BY 2,3
UNION ALL SELECT 'real', plan, material, CAST(sum(quantity*CASE WHEN grade<target THEN grade ELSE 1 END) AS BIGINT) FROM pl JOIN need USING (module, name) WHERE grade>from_grade AND grade<=target GROUP BY 2,3
UNION ALL SELECT 'full', plan, material, CAST(sum(quantity*grade) AS BIGINT) FROM pl JOIN need USING (module, name) WHERE grade>from_grade AND grade<=target GROUP BY 2,3""")  # fmt: skip
def plans_required(spark, d):
    parts = [_needs(spark, d, **how).select(F.lit(name).alias("how"), "plan", "material", "need") for name, how in (("once", {}), ("real", {"realistic": True}), ("full", {"realistic": True, "complete": True}))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("WITH" + BLUEPRINT_SQL[1:] + """, rq AS (SELECT plan, material, CAST(sum(quantity) AS BIGINT) AS need FROM pl JOIN need USING (module, name) WHERE grade>from_grade AND grade<=target GROUP BY 1,2), hv AS (SELECT lower('MATERIAL '||(s_suppkey%25)) AS k, CAST(sum(s_suppkey%7) AS BIGINT) AS have FROM supplier WHERE s_suppkey%20<>3 GROUP BY 1),
ln AS (SELECT plan, material, need, coalesce(have,0) AS have FROM rq LEFT JOIN hv ON k=lower(material)) SELECT *, bool_and(have>=need) OVER (PARTITION BY plan) AS fully_met FROM ln""")  # fmt: skip
def plans_gaps(spark, d):
    s = F.col("s_suppkey")
    inventory = spark.read.parquet(f"{d}/supplier.parquet").where(s % 20 != 3).select(F.concat(F.lit("MATERIAL "), (s % 25).cast("string")).alias("material"), (s % 7).alias("count"))
    return eng.gaps(_needs(spark, d), inventory)


@query("WITH" + BLUEPRINT_SQL[1:] + " SELECT module, name, array_to_string(list_sort(list(DISTINCT grade)),',') AS grades, array_to_string(list_sort(list(DISTINCT engineer)),',') AS engineers FROM bp GROUP BY 1,2 HAVING contains(lower(name),'rial 7') OR contains(lower(module),'rial 7') OR bool_or(contains(lower(material),'rial 7'))")
def blueprints_found(spark, d):
    rows = eng.blueprint_names(_blueprints(spark, d), " RIAL 7")
    return rows.select("module", "name", F.array_join(F.transform("grades", lambda x: x.cast("string")), ",").alias("grades"), F.array_join("engineers", ",").alias("engineers"))


@query("WITH" + BLUEPRINT_SQL[1:] + ", en AS (SELECT 'Eng '||s AS engineer, CASE WHEN s%2=0 THEN 'Unlocked' ELSE 'Known' END AS progress, s AS rank FROM (VALUES (0),(1),(2),(4),(5),(6)) v(s)) SELECT DISTINCT module, name, grade, b.engineer, coalesce(progress,'Unknown') AS progress, coalesce(progress='Unlocked' AND rank>=grade,false) AS unlocked FROM bp b LEFT JOIN en ON en.engineer=b.engineer")
def blueprints_open(spark, d):
    known = spark.createDataFrame([(f"Eng {s}", "Unlocked" if s % 2 == 0 else "Known", s) for s in (0, 1, 2, 4, 5, 6)], "engineer string, progress string, rank int")
    return eng.access(_blueprints(spark, d), known)


@query(GALAXY_SQL + " SELECT DISTINCT commander, lower(item) AS item FROM (SELECT commander, 'Int_'||(k%6) AS item FROM ev WHERE event='purchase' UNION ALL SELECT commander, unnest(['INT_'||(k%4), 'hpt_'||(k%3)]) FROM ev WHERE event='view')")
def unlocks_proved(spark, d):
    ev, k = g.events(spark, d), F.col("k")
    text = lambda head, n: F.concat(F.lit(head), (k % n).cast("string"))
    return eng.unlock_proofs(ev.where("event = 'purchase'").select("commander", text("Int_", 6).alias("item")), ev.where("event = 'view'").select("commander", F.array(text("INT_", 4), text("hpt_", 3)).alias("modules")))


def stock(spark, d):
    """Materials of each commander: ten groups of five grades of two kinds, filled by the journal."""
    held = g.events(spark, d).groupBy("commander", (F.col("k") % 30).alias("slot")).agg((F.sum("k") * 7 % 301).alias("count"))
    every = g.events(spark, d).select("commander").distinct().withColumn("slot", F.explode(F.expr("sequence(0L, 29L)")))
    s = F.col("slot")
    grade = (s % 5 + 1).cast("int")
    from astrolith.functions import maths

    rows = every.join(held, ["commander", "slot"], "left")
    return rows.select("commander", F.when(s < 15, "raw").otherwise("encoded").alias("kind"), F.concat(F.lit("group "), F.floor(s / 5).cast("string")).alias("group"), grade.alias("grade"), F.concat(F.lit("m"), F.lpad(s.cast("string"), 2, "0")).alias("material"), F.least(F.coalesce("count", F.lit(0)), maths.material_cap(grade)).cast("long").alias("count"))


@query()
def materials_traded(spark, d):
    return eng.trades(stock(spark, d), eng.Policy(source=0.6, floor=0.3, up=True, room=0.5))


MODULE_SQL = "mo AS (SELECT l_orderkey AS build, CAST(l_quantity AS DOUBLE) AS mass, l_linenumber<>2 AS \"on\", l_linenumber%2=0 AS hardpoint, l_tax*10 AS power, CASE WHEN l_linenumber=3 THEN l_discount*100 END AS pgen, CASE WHEN l_linenumber=1 THEN 1000.0+l_quantity END AS optmass, CASE WHEN l_linenumber=1 THEN 5.0 END AS maxfuel, CASE WHEN l_linenumber=1 THEN 0.012 END AS fuelmul, CASE WHEN l_linenumber=1 THEN 2.45 END AS fuelpower, CASE WHEN l_linenumber=4 THEN 10.5 END AS booster_ly FROM lineitem)"


@query("WITH " + MODULE_SQL + """, t AS (SELECT build, sum(mass) AS m, sum(coalesce(pgen,0)) AS power_capacity, sum(CASE WHEN "on" AND NOT hardpoint THEN power ELSE 0 END) AS power_retracted, sum(CASE WHEN "on" THEN power ELSE 0 END) AS power_deployed, sum(coalesce(booster_ly,0)) AS b, max(optmass) AS o FROM mo GROUP BY 1), x AS (SELECT o_orderkey AS build, 200.0+o_orderkey%50+coalesce(m,0) AS light, 16.0 AS fuel, o_custkey%100 AS cargo, 0.5 AS reserve, t.* EXCLUDE (build, m) FROM orders LEFT JOIN t ON t.build=o_orderkey)
SELECT build, round(light,4) AS unladen_mass, round(light+fuel+reserve,4) AS full_mass, round(o/(light+fuel)*pow(5.0/0.012,1/2.45)+b,4) AS jump_unladen, round(o/(light+fuel+cargo)*pow(5.0/0.012,1/2.45)+b,4) AS jump_laden, round(o/(light+5.0)*pow(5.0/0.012,1/2.45)+b,4) AS jump_max, round(coalesce(power_capacity,0),4) AS power_capacity, round(coalesce(power_retracted,0),4) AS power_retracted, round(coalesce(power_deployed,0),4) AS power_deployed FROM x""")  # fmt: skip
def builds_summed(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    drive = lambda v, name: F.when(n == 1, v).cast("double").alias(name)
    modules = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_orderkey").alias("build"), q.cast("double").alias("mass"), (n != 2).alias("on"), (n % 2 == 0).alias("hardpoint"), (F.col("l_tax") * 10).alias("power"), F.when(n == 3, F.col("l_discount") * 100).alias("pgen"),
        drive(1000.0 + q, "optmass"), drive(F.lit(5.0), "maxfuel"), drive(F.lit(0.012), "fuelmul"), drive(F.lit(2.45), "fuelpower"), F.when(n == 4, 10.5).alias("booster_ly"),
    )
    o = F.col("o_orderkey")
    hulls = spark.read.parquet(f"{d}/orders.parquet").select(o.alias("build"), (200.0 + o % 50).alias("hull_mass"), F.lit(0.5).alias("reserve"), F.lit(16.0).alias("fuel"), (F.col("o_custkey") % 100).cast("double").alias("cargo"))
    found = eng.build_summary(modules, hulls)
    return found.select("build", *(F.round(c, 4).alias(c) for c in found.columns[1:]))


CATALOG = [(f"{stem}_size{size}_class{grade}", name, str(size), rating) for stem, name in (("int_shield", "Shield Generator"), ("int_biweave", "Bi-Weave Shield Generator"), ("int_scoop", "Fuel Scoop")) for size in (3, 5) for grade, rating in ((1, "A"), (2, "C"))]
SHIPS = [("type9_military", "Type-10 Defender"), ("type9", "Type-9 Heavy"), ("krait_light", "Krait Phantom"), ("krait_mkii", "Krait Mk II"), ("asp", "Asp Explorer")]
TYPED = ["Shield Generator", "5a bi-weave", "5a shield generator", "int_scoop_size3_class1", "fuel", "3 weave", "9z nothing", "  "]


def _catalog_sql() -> str:
    rows = ",".join(f"('{s}','{n}','{c}','{r}')" for s, n, c, r in CATALOG)
    return f"cat AS (SELECT * FROM (VALUES {rows}) v(symbol, name, class, rating))"


def _typed(spark, words):
    return spark.createDataFrame([(x,) for x in words], "asked string")


@query("WITH " + _catalog_sql() + """ SELECT 'Shield Generator' AS asked, symbol FROM cat WHERE name='Shield Generator' UNION ALL SELECT '5a bi-weave', symbol FROM cat WHERE name LIKE 'Bi-Weave%' AND class='5' AND rating='A' UNION ALL SELECT '5a shield generator', symbol FROM cat WHERE name='Shield Generator' AND class='5' AND rating='A'
UNION ALL SELECT 'int_scoop_size3_class1', 'int_scoop_size3_class1' UNION ALL SELECT 'fuel', symbol FROM cat WHERE contains(name,'Fuel') UNION ALL SELECT '3 weave', symbol FROM cat WHERE contains(name,'Weave') AND class='3'""")  # fmt: skip
def modules_resolved(spark, d):
    return eng.resolve_modules(_typed(spark, TYPED), spark.createDataFrame(CATALOG, "symbol string, name string, class string, rating string"))


@query("SELECT * FROM (VALUES ('type-10','type9_military'),('TYPE9','type9'),('phantom','krait_light'),('krait mk ii','krait_mkii'),('Explorer','asp')) v(asked, symbol)")
def ships_resolved(spark, d):
    return eng.resolve_ships(_typed(spark, ["type-10", "TYPE9", "phantom", "krait mk ii", "krait", "Explorer", "??"]), spark.createDataFrame(SHIPS, "symbol string, name string"))


@query(GALAXY_SQL + " SELECT DISTINCT name FROM commodities WHERE contains(regexp_replace(lower(name),'[^a-z0-9]','','g'),'rod') ORDER BY NOT starts_with(regexp_replace(lower(name),'[^a-z0-9]','','g'),'rod'), name LIMIT 10".replace("SELECT DISTINCT name FROM commodities", "SELECT name FROM (SELECT DISTINCT name FROM commodities)"))
def names_offered(spark, d):
    return eng.complete_names(g.commodities(spark, d), "Rod", 10)


@query(GALAXY_SQL + " SELECT symbol, name FROM commodities WHERE contains(lower(name),'gear') OR contains(lower(symbol),'gear')")
def catalog_searched(spark, d):
    return eng.search_catalog(g.commodities(spark, d), "GEAR").select("symbol", "name")


@query(GALAXY_SQL + " SELECT 'C'||k AS symbol, coalesce(name,'(unknown: C'||k||')') AS name FROM (SELECT DISTINCT l_partkey%450 AS k FROM lineitem) LEFT JOIN commodities ON symbol='c'||k")
def catalog_named(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("C"), (F.col("l_partkey") % 450).cast("string")).alias("symbol")).distinct()
    return eng.display_names(rows, g.commodities(spark, d))


@query("SELECT doc_id, n, octet_length(encode(c))<=100 AND (octet_length(encode(text))<=100 OR octet_length(encode(substring(text,1,n+1)))>100) AS whole FROM (SELECT doc_id, text, list_max(list_filter(range(0,101), lambda n: octet_length(encode(substring(text,1,n)))<=100)) AS m, CASE WHEN octet_length(encode(text))<=100 THEN length(text) ELSE m END AS n, substring(text,1,n) AS c FROM documents)".replace("list_filter(range", "list_filter(range").replace("SELECT doc_id, n,", "SELECT doc_id, CAST(n AS INTEGER) AS n,"))
def texts_clipped(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").withColumn("c", eng.clipped(F.concat(F.col("text")), 100))
    fits = (F.octet_length("c") <= 100) & ((F.octet_length("text") <= 100) | (F.octet_length(F.col("text").substr(F.lit(1), F.length("c") + 1)) > 100))
    return rows.select("doc_id", F.length("c").alias("n"), fits.alias("whole"))


@query()
def names_heard(spark, d):
    heard = g.commodities(spark, d).select(F.translate("name", "aeiou", "eaiuo").alias("heard")).distinct()
    return eng.sounds_like(heard, g.commodities(spark, d).select("name").distinct())


@query("SELECT p_partkey AS id, CASE WHEN k=4 THEN NULL ELSE 'asp' END AS ship, CASE WHEN k<>4 AND p_partkey%2=0 THEN 'Name' END AS ship_name, CASE WHEN k NOT IN (2,4) THEN 280.5 END AS unladen_mass, CASE WHEN k<>4 THEN 32.0 END AS capacity, CASE WHEN k<>4 THEN 30.0+p_partkey END AS max_range, CASE WHEN k IN (1,3) THEN 64.0 ELSE 0.0 END AS cargo, CASE WHEN k NOT IN (3,4) THEN CAST(p_partkey%7+2 AS INTEGER) END AS drive_size, CASE WHEN k NOT IN (3,4) THEN (['E','D','C','B','A'])[p_partkey%5+1] END AS drive_rating, CASE WHEN k=4 THEN NULL WHEN k=3 THEN 1 ELSE 2 END AS modules, CASE k WHEN 4 THEN 'unreadable' WHEN 2 THEN 'missing UnladenMass' WHEN 3 THEN 'no drive' END AS problem FROM (SELECT *, p_partkey%6 AS k FROM part)".replace("p_partkey%6 AS k", "CASE WHEN p_partkey%6=5 THEN 0 ELSE p_partkey%6 END AS k"))
def loadouts_pasted(spark, d):
    """Journal lines, lists of builds, ones without a mass or a drive, and what is no build at all."""
    p = F.col("p_partkey")
    k = F.when(p % 6 == 5, 0).otherwise(p % 6)
    drive = F.struct(F.lit("FrameShiftDrive").alias("Slot"), F.format_string("Int_Hyperdrive_Size%d_Class%d", p % 7 + 2, p % 5 + 1).alias("Item"))
    modules = F.when(k == 3, F.array(F.struct(F.lit("Slot").alias("Slot"), F.lit("Int_Scoop").alias("Item")))).otherwise(F.array(drive, F.struct(F.lit("Slot").alias("Slot"), F.lit("Int_Scoop").alias("Item"))))
    build = F.struct(F.lit(" Asp ").alias("Ship"), F.when(p % 2 == 0, " Name ").otherwise(" ").alias("ShipName"), F.when(k != 2, 280.5).alias("UnladenMass"), (30.0 + p).alias("MaxJumpRange"), F.when(k.isin(1, 3), 64.0).alias("CargoCapacity"), F.struct(F.lit(32.0).alias("Main")).alias("FuelCapacity"), modules.alias("Modules"))
    text = F.when(k == 4, "not a build").when(k == 1, F.to_json(F.array(F.struct(build.alias("data"))))).otherwise(F.to_json(build))
    return eng.pasted_loadouts(spark.read.parquet(f"{d}/part.parquet").select(p.alias("id"), text.alias("text")))
