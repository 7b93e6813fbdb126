"""Blueprints, materials and builds: requirements, gaps, trades of materials, and names of catalogs."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolith.functions import maths


def rolls(grade: Column, target: Column, realistic: bool, complete: bool) -> Column:
    """How often a grade is rolled: once, or as it really goes: as often as its number below the target,
    the target too if it is to be completed."""
    if not realistic:
        return F.lit(1)
    return F.when((grade < target) | F.lit(complete), F.greatest(grade, F.lit(1))).otherwise(1)


def requirements(plans: DataFrame, blueprints: DataFrame, realistic: bool = False, complete: bool = False) -> DataFrame:
    """(plan, material, need): materials of all grades after ``from_grade`` up to ``target`` of each planned blueprint, pooled.

    ``plans``: plan, module, name, from_grade, target; ``blueprints``: module, name, grade, material, quantity."""
    steps = plans.join(blueprints, ["module", "name"]).where("grade > from_grade and grade <= target")
    need = F.col("quantity") * rolls(F.col("grade"), F.col("target"), realistic, complete)
    return steps.groupBy("plan", "material").agg(F.sum(need).alias("need"))


def gaps(needs: DataFrame, inventory: DataFrame) -> DataFrame:
    """(plan, material, need, have, fully_met): what each plan needs against what is held (material, count), whatever
    the case; a plan is met if all of its lines are."""
    held = inventory.groupBy(F.lower("material").alias("__key")).agg(F.sum("count").alias("have"))
    lines = needs.withColumn("__key", F.lower("material")).join(held, "__key", "left").drop("__key").withColumn("have", F.coalesce("have", F.lit(0)))
    met = lines.groupBy("plan").agg(F.bool_and(F.col("have") >= F.col("need")).alias("fully_met"))
    return lines.join(met, "plan")


def blueprint_names(blueprints: DataFrame, text: str) -> DataFrame:
    """(module, name, grades, engineers) of blueprints whose name, module or a material holds the text."""
    key = text.strip().lower()
    rows = blueprints.groupBy("module", "name").agg(F.array_sort(F.collect_set("grade")).alias("grades"), F.array_sort(F.collect_set("engineer")).alias("engineers"), F.max(F.lower("material").contains(key)).alias("__m"))
    return rows.where(F.lower("name").contains(key) | F.lower("module").contains(key) | F.col("__m")).drop("__m")


def access(blueprints: DataFrame, engineers: DataFrame) -> DataFrame:
    """(module, name, grade, engineer, progress, unlocked): who offers a blueprint and whether a commander may use them;
    ``engineers``: engineer, progress, rank."""
    offers = blueprints.select("module", "name", "grade", "engineer").distinct()
    rows = offers.join(engineers.select("engineer", "progress", "rank"), "engineer", "left")
    return rows.select("module", "name", "grade", "engineer", F.coalesce("progress", F.lit("Unknown")).alias("progress"), F.coalesce((F.col("progress") == "Unlocked") & (F.col("rank") >= F.col("grade")), F.lit(False)).alias("unlocked"))


def unlock_proofs(sales: DataFrame, loadouts: DataFrame) -> DataFrame:
    """(commander, item) that a broker sold or that is fitted: each once, whatever the case. ``loadouts``: commander, modules."""
    fitted = loadouts.select("commander", F.explode("modules").alias("item"))
    both = sales.select("commander", "item").unionByName(fitted)
    return both.select("commander", F.lower("item").alias("item")).where("item is not null").distinct()


@dataclass(frozen=True)
class Policy:
    """What a material trader may give: ``source``: share of its cap from which a material is one, ``floor``: share
    that it keeps; ``bottom``: whether low grades are filled first; ``room``: share of the cap down to which the
    two top grades are emptied into others."""

    source: float = 0.9
    floor: float = 0.5
    least_grade: int = 1
    bottom: bool = True
    across: bool = True
    up: bool = False
    room: float | None = None


def trades(stock: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(commander, step, give, give_qty, receive, receive_qty, way): trades that empty nearly full materials into
    others, greedily: down their group, across, up, and for room in the top grades.

    ``stock``: commander, kind, group, grade, material, count, all tradeable materials of each commander. Which trades are tried, in
    which order, between which bounds, is a join and its sort keys; only the running stock is a fold, by commander."""
    g = lambda p, c: F.col(f"{p}.{c}")
    cap = lambda p: maths.material_cap(g(p, "grade"))
    is_source = (F.col("grade") >= policy.least_grade) & (F.col("count") >= F.ceil(maths.material_cap(F.col("grade")) * policy.source))
    rows = stock.withColumn("source", is_source)
    pairs = rows.where("source").alias("s").join(rows.alias("d"), ["commander", "kind"]).where(g("s", "material") != g("d", "material"))
    own, step = g("s", "group") == g("d", "group"), g("s", "grade") - g("d", "grade")
    ways = [F.when(own & (step > 0) & ~g("d", "source"), F.lit(0))]
    if policy.across:
        ways.append(F.when(~own & (step >= 0) & ~g("d", "source"), F.lit(1)))
    if policy.up:
        ways.append(F.when(own & (step < 0) & ~g("d", "source"), F.lit(2)))
    way = F.array(F.coalesce(*ways, F.lit(None).cast("int")))
    floor = F.floor(cap("s") * policy.floor)
    ratio = maths.trader_ratio(g("s", "grade"), g("d", "grade"), own)
    if policy.room is not None:
        top = (g("s", "grade") >= 4) & (g("d", "grade") >= 4) & (own | step.isin(0, 1))
        way = F.array_append(way, F.when(top, F.lit(3)))
    tried = pairs.withColumn("way", F.explode(F.array_compact(way)))
    room = F.col("way") == 3
    ceiling = lambda p: F.floor(cap(p) * (policy.room or 1.0))
    near = F.when(step == 0, 0).otherwise(F.when(room, 1).otherwise(F.lit(1 if policy.bottom else -1) * g("d", "grade") + 100))
    near = F.when(F.col("way") == 2, g("d", "grade")).otherwise(near)
    order = F.struct("way", (-g("s", "grade")).alias("a"), g("s", "group").alias("b"), g("s", "material").alias("c"), F.when(room & own, -1).otherwise(near).alias("d"), g("d", "group").alias("e"), g("d", "grade").alias("f"), g("d", "material").alias("h"))
    tried = tried.select(
        "commander", order.alias("order"), "way", g("s", "material").alias("give"), g("d", "material").alias("receive"), g("s", "count").alias("have"), g("d", "count").alias("held"),
        F.when(room, F.greatest(ceiling("s"), floor)).otherwise(floor).alias("stop"), F.when(room, ceiling("d")).otherwise(cap("d")).alias("until"), ratio["pay"].alias("pay"), ratio["get"].alias("get"),
    ).where("pay is not null")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("order", key=lambda c: c.map(lambda x: tuple(x.values()) if isinstance(x, dict) else tuple(x)))
        now = dict(zip(part["receive"], part["held"])) | dict(zip(part["give"], part["have"]))
        out = []
        for r in part.itertuples():
            n = min((now[r.give] - r.stop) // r.pay, (r.until - now[r.receive]) // r.get)
            if n > 0:
                now[r.give] -= n * r.pay
                now[r.receive] += n * r.get
                out.append((r.commander, len(out), r.give, n * r.pay, r.receive, n * r.get, ("down", "across", "up", "room")[r.way]))
        return pd.DataFrame(out, columns=["commander", "step", "give", "give_qty", "receive", "receive_qty", "way"])

    return tried.groupBy("commander").applyInPandas(fold, "commander long, step int, give string, give_qty long, receive string, receive_qty long, way string")


def build_summary(modules: DataFrame, hulls: DataFrame) -> DataFrame:
    """Masses, jump ranges and power of builds. ``modules``: build, mass, on, hardpoint, power, pgen, and of the drive optmass, maxfuel, fuelmul,
    fuelpower (others null), booster_ly; ``hulls``: build, hull_mass, reserve, fuel, cargo. No drive, no range."""
    on = F.when(F.coalesce("on", F.lit(True)), F.coalesce("power", F.lit(0.0))).otherwise(0.0)
    drive = F.max(F.when(F.col("optmass").isNotNull(), F.struct("optmass", "maxfuel", "fuelmul", "fuelpower")))
    totals = modules.groupBy("build").agg(F.sum("mass").alias("__mass"), F.sum(F.coalesce("pgen", F.lit(0.0))).alias("power_capacity"), F.sum(F.when(~F.coalesce("hardpoint", F.lit(False)), on).otherwise(0.0)).alias("power_retracted"), F.sum(on).alias("power_deployed"), F.sum(F.coalesce("booster_ly", F.lit(0.0))).alias("__booster"), drive.alias("__d"))
    rows = hulls.join(totals, "build", "left")
    light = F.col("hull_mass") + F.coalesce("__mass", F.lit(0.0))
    d = lambda c: F.col(f"__d.{c}")
    good = (d("optmass") > 0) & (d("maxfuel") > 0) & (d("fuelmul") > 0) & (d("fuelpower") > 0)
    jump = lambda mass: F.when(good & (mass > 0), d("optmass") / mass * F.pow(d("maxfuel") / d("fuelmul"), 1.0 / d("fuelpower")) + F.col("__booster"))
    return rows.select(
        "build", light.alias("unladen_mass"), (light + F.col("fuel") + F.col("reserve")).alias("full_mass"), jump(light + F.col("fuel")).alias("jump_unladen"), jump(light + F.col("fuel") + F.col("cargo")).alias("jump_laden"),
        jump(light + F.least(F.coalesce(d("maxfuel"), F.lit(0.0)), F.col("fuel"))).alias("jump_max"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("power_capacity", "power_retracted", "power_deployed")),
    )


def flat(c: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def _small(catalog: DataFrame, most: int = 20_000) -> DataFrame:
    """A catalog for a broadcast, once its size is seen to be bounded."""
    if catalog.limit(most + 1).count() > most:
        raise ValueError(f"a catalog of more than {most} entries")
    return F.broadcast(catalog)


def resolve_modules(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """(asked, symbol): the modules that typed words mean. A symbol stands for itself; a leading size and rating narrow
    ("5a shield"); exact names win over those that hold the words; a rating that none has is dropped.

    ``catalog``: symbol, name, class, rating."""
    words = F.regexp_extract(F.lower(F.trim("asked")), r"^(?:([0-9])([a-i])?\s+)?(.*)$", 3)
    part = lambda k: F.nullif(F.regexp_extract(F.lower(F.trim("asked")), r"^(?:([0-9])([a-i])?\s+)?(.*)$", k), F.lit(""))
    rows = asked.select("asked", flat(words).alias("__want"), part(1).alias("__size"), part(2).alias("__rating"), F.lower(F.trim("asked")).alias("__typed")).where("__want <> ''")
    table = catalog.select("symbol", flat(F.col("name")).alias("__name"), F.col("class").alias("__class"), F.lower("rating").alias("__rate"))
    # the catalog is small; the words are what grows
    hits = rows.join(_small(table), (F.col("__typed") == F.col("symbol")) | (F.col("__name").contains(F.col("__want")) & F.coalesce(F.col("__class") == F.col("__size"), F.lit(True))))
    typed = F.col("__typed") == F.col("symbol")
    rated = F.coalesce(F.col("__rate") == F.col("__rating"), F.lit(True))
    exact = F.col("__name") == F.col("__want")
    rank = F.when(typed, 0).when(exact & rated, 1).when(rated, 2).when(exact, 3).otherwise(4)
    ranked = hits.withColumn("__rank", rank)
    best = ranked.groupBy("asked").agg(F.min("__rank").alias("__rank"))
    return ranked.join(best, ["asked", "__rank"]).select("asked", "symbol")


def resolve_ships(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """(asked, symbol): the hull of that symbol or name, or the only one that holds the words."""
    table = catalog.select("symbol", flat(F.col("symbol")).alias("__s"), flat(F.col("name")).alias("__n"))
    rows = asked.select("asked", flat(F.col("asked")).alias("__q")).where("__q <> ''")
    hits = rows.join(_small(table), F.col("__s").contains(F.col("__q")) | F.col("__n").contains(F.col("__q")))
    exact = (F.col("__s") == F.col("__q")) | (F.col("__n") == F.col("__q"))
    found = hits.groupBy("asked").agg(F.min(F.when(exact, F.col("symbol"))).alias("exact"), F.min("symbol").alias("one"), F.count("*").alias("n"))
    return found.select("asked", F.coalesce("exact", F.when(F.col("n") == 1, F.col("one"))).alias("symbol")).where("symbol is not null")


def complete_names(catalog: DataFrame, text: str, most: int = 10) -> DataFrame:
    """Names that hold the text, wherever; those that begin with it first."""
    key = flat(F.lit(text))
    rows = catalog.select("name").distinct().where(flat(F.col("name")).contains(key))
    return rows.orderBy(~flat(F.col("name")).startswith(key), "name").limit(most)


def search_catalog(catalog: DataFrame, text: str) -> DataFrame:
    key = text.lower()
    return catalog.where(F.lower("name").contains(key) | F.lower("symbol").contains(key)).orderBy("name", "symbol")


def display_names(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """``rows`` (symbol, ...) with the catalog's name, or a mark that it is unknown."""
    named = catalog.groupBy(F.lower("symbol").alias("__key")).agg(F.min("name").alias("__name"))
    out = rows.withColumn("__key", F.lower("symbol")).join(named, "__key", "left")
    return out.withColumn("name", F.coalesce("__name", F.concat(F.lit("(unknown: "), "symbol", F.lit(")")))).drop("__key", "__name")


def clipped(c: Column, most: int) -> Column:
    """The longest prefix of whole characters of at most ``most`` bytes."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda n: F.octet_length(c.substr(F.lit(1), n)) <= most)
    return F.when(F.octet_length(c) <= most, c).otherwise(c.substr(F.lit(1), F.array_max(fits)))


def sounds_like(heard: DataFrame, names: DataFrame) -> DataFrame:
    """(heard, name, distance): names that sound alike, the nearest spelling first; ties by name."""
    coded = names.select("name", F.soundex("name").alias("__code"))
    hits = heard.select("heard", F.soundex("heard").alias("__code")).join(coded, "__code")
    near = F.levenshtein(F.lower("heard"), F.lower("name"))
    best = hits.groupBy("heard").agg(F.min(F.struct(near.alias("distance"), "name")).alias("b"))
    return best.select("heard", F.col("b.name").alias("name"), F.col("b.distance").alias("distance"))


LOADOUT = "struct<Ship: string, ShipName: string, UnladenMass: double, MaxJumpRange: double, CargoCapacity: double, FuelCapacity: struct<Main: double>, Modules: array<struct<Slot: string, Item: string>>>"


def pasted_loadouts(pasted: DataFrame) -> DataFrame:
    """(id, ship, ship_name, unladen_mass, capacity, max_range, cargo, drive_size, drive_rating, modules, problem) of pasted builds (id, text): a
    journal line, or a list of builds of which the first counts. ``problem`` says what keeps one from being used."""
    text = F.trim("text")
    many = F.get(F.from_json(text, f"array<struct<data: {LOADOUT}>>"), F.lit(0))["data"]
    build = F.when(text.startswith("["), many).otherwise(F.from_json(text, LOADOUT))
    rows = pasted.select("id", build.alias("b")).withColumn("__items", F.transform("b.Modules", lambda m: F.lower(m["Item"])))
    drive = F.get(F.filter("__items", lambda x: x.contains("int_hyperdrive")), F.lit(0))
    part = lambda pattern: F.nullif(F.regexp_extract(drive, pattern, 1), F.lit(""))
    rating = F.element_at(F.array(*(F.lit(x) for x in "EDCBA")), F.coalesce(part(r"class([1-5])"), F.lit("5")).cast("int"))
    lacks = F.array_compact(F.array(*(F.when(F.col(f"b.{c}").isNull(), n) for c, n in (("UnladenMass", "UnladenMass"), ("FuelCapacity.Main", "FuelCapacity"), ("MaxJumpRange", "MaxJumpRange")))))
    problem = F.when(F.col("b.Ship").isNull() & F.col("b.Modules").isNull(), "unreadable").when(F.size(lacks) > 0, F.concat(F.lit("missing "), F.array_join(lacks, ", "))).when(drive.isNull(), "no drive")
    return rows.select(
        "id", F.lower(F.trim("b.Ship")).alias("ship"), F.nullif(F.trim("b.ShipName"), F.lit("")).alias("ship_name"), F.col("b.UnladenMass").alias("unladen_mass"), F.col("b.FuelCapacity.Main").alias("capacity"), F.col("b.MaxJumpRange").alias("max_range"),
        F.coalesce("b.CargoCapacity", F.lit(0.0)).alias("cargo"), F.when(drive.isNotNull(), F.coalesce(part(r"size([0-9])"), F.lit("5")).cast("int")).alias("drive_size"), F.when(drive.isNotNull(), rating).alias("drive_rating"), F.size("__items").alias("modules"), problem.alias("problem"),
    )
