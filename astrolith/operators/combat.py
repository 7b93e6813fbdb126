"""Rollups of fights, merits, missions and whereabouts from the journal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolith.functions import times
from astrolith.operators.journal import ORDER, latest, replay


# What journal events count as, kills and incidents.
KILLS = {"Bounty": "bounty", "FactionKillBond": "faction_kill_bond", "CapShipBond": "capship_bond", "PVPKill": "pvp"}
INCIDENTS = {"Died": "died", "Interdicted": "interdicted", "Interdiction": "interdiction", "EscapeInterdiction": "escaped_interdiction"}


def _field(*keys: str) -> Column:
    """The first of some fields of a journal line that is there."""
    return F.coalesce(*(F.get_json_object("raw", f"$.{k}") for k in keys))


def _kind(names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("event")]


def kills_of(events: DataFrame) -> DataFrame:
    """Bounties, bonds and duels out of raw journal lines (commander, ts, file, offset, event, raw)."""
    rows = events.where(F.col("event").isin(*KILLS))
    return rows.select("commander", *ORDER, _kind(KILLS).alias("kind"), _field("TotalReward", "Reward").cast("long").alias("reward"), _field("Target_Localised", "Target").alias("target_ship"), _field("VictimFaction_Localised", "VictimFaction").alias("faction"))


def incidents_of(events: DataFrame) -> DataFrame:
    rows = events.where(F.col("event").isin(*INCIDENTS))
    return rows.select("commander", *ORDER, _kind(INCIDENTS).alias("kind"))


def sales_of(events: DataFrame) -> DataFrame:
    """Sales at markets."""
    number = lambda k: _field(k).cast("long")
    return events.where("event = 'MarketSell'").select("commander", *ORDER, _field("Type").alias("commodity"), number("MarketID").alias("market_id"), F.coalesce(number("Count"), F.lit(0)).alias("count"), number("SellPrice").alias("sell_price"), number("TotalSale").alias("total_sale"), number("AvgPricePaid").alias("avg_paid"))


def merits_of(events: DataFrame) -> DataFrame:
    rows = events.where("event = 'PowerplayMerits'")
    return rows.select("commander", *ORDER, _field("Power").alias("power"), _field("MeritsGained").cast("long").alias("merits"), _field("TotalMerits").cast("long").alias("total"))


def material_trades(events: DataFrame, since: str) -> DataFrame:
    """Trades at material traders from a time on; lines without both sides are left out."""
    side = lambda k: _field(f"{k}.Material_Localised", f"{k}.Material")
    count = lambda k: F.coalesce(_field(f"{k}.Quantity").cast("long"), F.lit(0))
    rows = events.where((F.col("event") == "MaterialTrade") & (F.col("ts") >= F.lit(since).cast("timestamp")))
    out = rows.select("commander", *ORDER, F.coalesce(_field("TraderType"), F.lit("")).alias("trader"), side("Paid").alias("paid"), count("Paid").alias("paid_qty"), side("Received").alias("received"), count("Received").alias("received_qty"))
    return out.where("paid is not null and received is not null")


def stored_modules(events: DataFrame) -> DataFrame:
    """(commander, slot, item, system): the modules of each commander's newest list of them."""
    newest = latest(events.where("event = 'StoredModules'").select("commander", *ORDER, "raw"), "commander")
    items = F.from_json(F.get_json_object("raw", "$.Items"), "array<struct<StorageSlot: int, Name: string, StarSystem: string>>")
    return newest.select("commander", F.explode(items).alias("m")).select("commander", F.col("m.StorageSlot").alias("slot"), F.col("m.Name").alias("item"), F.col("m.StarSystem").alias("system"))


def summary(kills: DataFrame, incidents: DataFrame, since: str) -> DataFrame:
    """One row: kills with their bounties and other rewards, and the incidents of each kind."""
    late = F.col("ts") >= F.lit(since).cast("timestamp")
    paid = lambda test: F.coalesce(F.sum(F.when(test, F.col("reward"))), F.lit(0))
    a = kills.where(late).agg(F.count("*").alias("kills"), paid(F.col("kind") == "bounty").alias("bounty_credits"), paid(F.col("kind") != "bounty").alias("bond_credits"))
    named = {"deaths": "died", "interdicted": "interdicted", "interdictions_made": "interdiction", "escaped": "escaped_interdiction"}
    b = incidents.where(late).agg(*(F.count_if(F.col("kind") == k).alias(n) for n, k in named.items()))
    return a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one").drop("__one")  # one row each


def top(kills: DataFrame, by: str, since: str, value: Column, most: int = 15) -> DataFrame:
    """The groups of ``by`` with the greatest ``value``; ties by name, null as (unknown)."""
    rows = kills.where(F.col("ts") >= F.lit(since).cast("timestamp")).groupBy(F.coalesce(by, F.lit("(unknown)")).alias("name")).agg(value.alias("n"))
    return rows.orderBy(F.desc("n"), "name").limit(most)


def ranked_stats(rows: DataFrame, key: tuple[str, ...], value: str) -> DataFrame:
    """(key, n, median, p90) of integers by rank, without gathering a group: the median's floor of
    the middles, and the nearest rank from ten values on."""
    some = rows.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("__v"))
    ranked = some.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy("__v"))).withColumn("__n", F.count("*").over(Window.partitionBy(*key)))
    n = F.col("__n")
    at = lambda place: F.max(F.when(F.col("__r") == place, F.col("__v")))
    middle = F.floor((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2).cast("long")
    return ranked.groupBy(*key).agg(F.max("__n").alias("n"), middle.alias("median"), at(F.when(n >= 10, F.floor(n * 9 / 10))).alias("p90"))


def by_ship(sessions: DataFrame, kills: DataFrame, since: str) -> DataFrame:
    """Each ship's sessions from a time on: the sums of their numbers, its last name, and the medians of
    its kills' times. ``sessions``: id, ship_id, ship, ship_name, entered_ts and numbers;
    ``kills``: session_id, ttk_s, interval_s."""
    own = ("id", "ship_id", "ship", "ship_name", "entered_ts")
    rows = sessions.where(F.col("entered_ts") >= F.lit(since).cast("timestamp"))
    named = F.when(F.col("ship_name") != "", F.struct("entered_ts", "ship_name"))
    sums = rows.groupBy("ship_id", "ship").agg(F.coalesce(F.max(named)["ship_name"], F.lit("")).alias("ship_name"), F.count("*").alias("sessions"), *(F.sum(c).alias(c) for c in sessions.columns if c not in own))
    timed = kills.join(rows.select(F.col("id").alias("session_id"), "ship_id", "ship"), "session_id")
    out = sums
    for value, names in (("ttk_s", {"median": "median_ttk_s", "p90": "p90_ttk_s"}), ("interval_s", {"median": "median_interval_s"})):
        stats = ranked_stats(timed, ("ship_id", "ship"), value).select(F.col("ship_id").alias("__id"), F.col("ship").alias("__ship"), *(F.col(a).alias(b) for a, b in names.items()))
        out = out.join(stats, F.col("ship_id").eqNullSafe(F.col("__id")) & (F.col("ship") == F.col("__ship")), "left").drop("__id", "__ship")
    return out


def merit_timeline(merits: DataFrame, unit: str) -> DataFrame:
    """(bucket, merits, awards, total): sums, counts and the greatest total of each bucket."""
    return merits.groupBy(times.bucket(F.col("ts"), unit).alias("bucket")).agg(F.sum("merits").alias("merits"), F.count("*").alias("awards"), F.max("total").alias("total"))


def recent(events: DataFrame, most: int) -> DataFrame:
    return events.orderBy(*(F.desc(c) for c in ORDER)).limit(most)


def trade_profit(sales: DataFrame, since: str, until: str) -> DataFrame:
    """Credits over what was paid, of the sales of a followed time."""
    rows = sales.where((F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("ts") <= F.lit(until).cast("timestamp")))
    return rows.agg(F.coalesce(F.sum(F.col("total_sale") - F.col("avg_paid") * F.col("count")), F.lit(0)).alias("profit"), F.count("*").alias("sales"))


def source_counts(stars: DataFrame) -> DataFrame:
    from astrolith.functions.classes import scoopable

    return stars.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.when(scoopable(F.col("class")), 1).otherwise(0)).alias("scoopable"))


def nav_targets(events: DataFrame, plotted: Column, target: Column, cleared: Column, located: Column, place: Column) -> DataFrame:
    """(commander, target) of each newest plotted target that is neither cleared since (or at the
    same time), nor reached, nor older than the newest location."""
    last = lambda test, v: F.max(F.when(test, F.struct(*ORDER, v.alias("v"))))
    rows = events.groupBy("commander").agg(last(plotted, target).alias("p"), last(located, place).alias("l"), F.max(F.when(cleared, F.col("ts"))).alias("c"))
    open_ = F.col("p").isNotNull() & ~F.coalesce(F.col("c") >= F.col("p.ts"), F.lit(False))
    gone = F.coalesce(F.col("p.v") == F.col("l.v"), F.lit(False)) | F.coalesce(F.col("p.ts") < F.col("l.ts"), F.lit(False))
    return rows.where(open_ & ~gone).select("commander", F.col("p.v").alias("target"))


def phase_times(events: DataFrame, phases: dict[str, tuple[str, str, float, float, float]], least: int = 3) -> DataFrame:
    """(commander, phase, seconds): the median time from an event to the one right after it, of those that lie
    in bounds; under ``least`` samples the phase's prior. ``phases``: (first, next, low, high, prior)."""
    w = replay("commander")
    rows = events.select("commander", F.col("event").alias("a"), F.lead("event").over(w).alias("b"), ((F.unix_micros(F.lead("ts").over(w)) - F.unix_micros("ts")) / 1e6).alias("s"))
    phase = F.coalesce(*(F.when((F.col("a") == a) & (F.col("b") == b) & F.col("s").between(low, high), name) for name, (a, b, low, high, _) in phases.items()))
    known = rows.withColumn("phase", phase).where("phase is not null").groupBy("commander", "phase").agg(F.median("s").alias("m"), F.count("*").alias("n")).where(F.col("n") >= least)
    every = events.select("commander").distinct().withColumn("phase", F.explode(F.array(*(F.lit(p) for p in phases))))
    prior = F.create_map(*(x for name, p in phases.items() for x in (F.lit(name), F.lit(p[4]))))[F.col("phase")]
    return every.join(known, ["commander", "phase"], "left").select("commander", "phase", F.coalesce("m", prior).alias("seconds"))


def cadence(jumps: DataFrame, default: float) -> DataFrame:
    """(commander, minutes): the mean of the measured minutes of carriers' jumps, or the default."""
    return jumps.groupBy("commander").agg(F.coalesce(F.avg("minutes"), F.lit(default)).alias("minutes"))


def missions(events: DataFrame) -> DataFrame:
    """(commander, mission, status, accepted_at, expiry): a mission is as its first later event says (completed,
    failed, abandoned), where a list of open missions (status 'listed', ``open_missions``) that lacks it completes it;
    accepted again it starts anew. One that is still open past its expiry, as of the commander's
    last event, is expired. Lists are matched by number, so no list meets all missions."""
    w = replay("commander")
    listed = F.col("status") == "listed"
    rows = events.withColumn("__lists", F.sum(F.when(listed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct(*ORDER)
    key = ["commander", "mission"]
    accepted = rows.where("status = 'accepted'").groupBy(*key).agg(F.max(F.struct(order.alias("o"), F.col("expiry").alias("expiry"), F.col("__lists").alias("lists"))).alias("a"))
    later = rows.where(~listed & (F.col("status") != "accepted")).select(*key, order.alias("o"), "status").join(accepted.select(*key, F.col("a.o").alias("since")), key).where("o > since")
    own = later.groupBy(*key).agg(F.min(F.struct("o", "status")).alias("e"))
    # the lists right after the acceptance that still have the mission are those numbered without a gap
    lists = rows.where(listed).select("commander", F.col("__lists").alias("n"), order.alias("o"), "open_missions")
    held = lists.select("commander", "n", F.explode(F.array_distinct("open_missions")).alias("mission")).join(accepted.select(*key, F.col("a.lists").alias("lists")), key).where("n > lists")
    held = held.withColumn("__run", F.col("n") - F.row_number().over(Window.partitionBy(*key).orderBy("n")))
    kept = held.where("__run = lists").groupBy(*key).agg(F.count("*").alias("kept"))
    first = accepted.join(kept, key, "left").withColumn("n", F.col("a.lists") + F.coalesce("kept", F.lit(0)) + 1)
    missing = first.join(lists.select("commander", "n", F.struct("o", F.lit("completed").alias("status")).alias("m")), ["commander", "n"], "left")
    ends = rows.groupBy("commander").agg(F.max("ts").alias("now"))
    out = missing.join(own, key, "left").join(ends, "commander")
    status = F.least("e", "m")["status"]
    open_ = F.when(F.col("a.expiry") < F.col("now"), "expired").otherwise("accepted")
    return out.select(*key, F.coalesce(status, open_).alias("status"), F.col("a.o.ts").alias("accepted_at"), F.col("a.expiry").alias("expiry"))


# The order of missions on display.
STATUS_RANK = ("active", "ready")


def display_order() -> list[Column]:
    """By status, expiry (none last), acceptance and id."""
    rank = F.coalesce(*(F.when(F.col("status") == s, k) for k, s in enumerate(STATUS_RANK)), F.lit(len(STATUS_RANK)))
    return [rank.asc(), F.col("expiry").asc_nulls_last(), F.col("accepted_at").asc(), F.col("mission").asc()]


def stacks(missions: DataFrame) -> DataFrame:
    """Each commander's stack of kill missions (commander, mission, faction, target_faction, target_system, kill_count,
    reward, wing, status active or ready): the target with the most missions (ties by name), kills that are needed and remain as the most of any giver, and
    values by kind. Givers differ by more than case."""
    kills = missions.where("kill_count is not null and target_faction is not null")
    per = kills.groupBy("commander", "target_faction").agg(F.count("*").alias("n"))
    pick = per.groupBy("commander").agg(F.min(F.struct((-F.col("n")).alias("n"), "target_faction"))["target_faction"].alias("target_faction"), F.sum("n").alias("__all"))
    mine = kills.join(pick, ["commander", "target_faction"])
    ready = F.col("status") == "ready"
    when = lambda test, c: F.sum(F.when(test, F.col(c)).otherwise(0))
    giver = mine.groupBy("commander", "target_faction", F.lower("faction").alias("giver")).agg(
        F.count("*").alias("missions"), F.count_if(ready).alias("ready"), F.sum("kill_count").alias("kills"), when(F.col("status") == "active", "kill_count").alias("open_kills"),
        F.sum(F.coalesce("reward", F.lit(0))).alias("value"), when(ready, "reward").alias("value_ready"), when(F.col("wing"), "reward").alias("value_shareable"),
    )
    out = giver.groupBy("commander", "target_faction").agg(
        F.count("*").alias("givers"), F.count_if(F.col("missions") > 1).alias("duplicates"), F.sum("missions").alias("missions"), F.max("kills").alias("kills_needed"), F.max("open_kills").alias("kills_remaining"),
        F.sum("kills").alias("kills_credited"), F.sum("value").alias("value"), F.sum("value_ready").alias("value_ready"), F.sum("value_shareable").alias("value_shareable"),
    )
    place = mine.where("target_system is not null").groupBy("commander", "target_system").agg(F.count("*").alias("n"))
    place = place.groupBy("commander").agg(F.min(F.struct((-F.col("n")).alias("n"), "target_system"))["target_system"].alias("target_system"))
    out = out.join(pick.select("commander", "__all"), "commander").withColumn("other_targets", F.col("__all") - F.col("missions")).drop("__all")
    return out.join(place, "commander", "left")


def ship_locations(snapshots: DataFrame, ships: DataFrame, transfers: DataFrame, docks: DataFrame) -> DataFrame:
    """Where each stored ship is, after snapshots of all ships and transfers since.

    ``snapshots``: commander, ts, file, offset, system, station, market_id; ``ships``: commander, ts, file, offset of their
    snapshot, ship_id, ship_type, name, here, in_transit, system, market_id; ``transfers``: commander, ts, file, offset, ship_id,
    ship_type, market_id, seconds; ``docks``: market_id, station, system. A ship that the newest snapshot lacks
    and that no transfer has named since is gone; one that a snapshot lacked starts anew. Values are
    last ones by replay order: no fold in Python."""
    order = F.struct(*ORDER)
    w = replay("commander")
    numbered = snapshots.withColumn("__n", F.row_number().over(w))
    total = numbered.groupBy("commander").agg(F.max("__n").alias("__total"))
    here = numbered.select("commander", *ORDER, "__n", *(F.col(c).alias(f"__{c}") for c in ("system", "station", "market_id")))
    seen = ships.join(here, ["commander", *ORDER])
    kind = F.when(F.col("here"), "here").when(F.coalesce("in_transit", F.lit(False)), "transit").otherwise("remote")
    at = lambda c, other: F.when(F.col("here"), F.col(f"__{c}")).otherwise(other).alias(c)
    name = F.when(F.trim("name") != "", F.trim("name"))
    a = seen.select("commander", *ORDER, "ship_id", "ship_type", name.alias("name"), kind.alias("kind"), at("system", F.col("system")), at("station", F.lit(None).cast("string")), at("market_id", F.col("market_id")), F.lit(None).cast("long").alias("seconds"), "__n")
    b = transfers.select("commander", *ORDER, "ship_id", "ship_type", F.lit(None).cast("string").alias("name"), F.lit("transfer").alias("kind"), F.lit(None).cast("string").alias("system"), F.lit(None).cast("string").alias("station"), "market_id", "seconds")
    # a transfer follows as many snapshots as came before it
    marks = numbered.select("commander", *ORDER, F.lit(1).alias("__s")).unionByName(b.select("commander", *ORDER, F.lit(0).alias("__s")))
    counted = marks.withColumn("__n", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__s = 0").drop("__s")
    b = b.join(counted, ["commander", *ORDER])
    rows = a.unionByName(b)
    own = Window.partitionBy("commander", "ship_id").orderBy(*ORDER)
    present = F.sum(F.when(F.col("kind") != "transfer", 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__era", F.col("__n") - present).withColumn("__last", F.max("__era").over(Window.partitionBy("commander", "ship_id"))).where("__era = __last")
    rows = rows.withColumn("__present", F.sum(F.when(F.col("kind") != "transfer", 1).otherwise(0)).over(Window.partitionBy("commander", "ship_id")))
    # the market that holds after each row, and the dock that it names
    era = Window.partitionBy("commander", "ship_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    sets_market = F.col("kind").isin("here", "transfer") | ((F.col("kind") == "remote") & F.col("market_id").isNotNull())
    now = F.last(F.when(sets_market, F.struct(F.col("market_id").alias("m"))), ignorenulls=True).over(era)["m"]
    rows = rows.withColumn("__market", now).join(docks.select(F.col("market_id").alias("__market"), F.col("station").alias("__dock"), F.col("system").alias("__place")), "__market", "left")
    pick = lambda test, v: F.max(F.when(test, F.struct(order.alias("o"), v.alias("v"))))["v"]
    k = F.col("kind")
    moved = (k == "transfer") & F.col("market_id").isNotNull()
    system = F.when(k == "transfer", F.col("__place")).otherwise(F.col("system"))
    station = F.when(k == "here", F.col("station")).otherwise(F.col("__dock"))
    arrival = F.when(k == "transfer", F.col("ts") + F.make_interval(secs=F.col("seconds")))
    out = rows.groupBy("commander", "ship_id", "__era").agg(
        pick(F.col("ship_type").isNotNull(), F.col("ship_type")).alias("ship_type"), pick(F.col("name").isNotNull(), F.col("name")).alias("name"),
        pick((k == "here") | moved | ((k == "remote") & F.col("system").isNotNull()), system).alias("system"),
        pick((k == "here") | moved | ((k == "remote") & F.col("__dock").isNotNull()), station).alias("station"),
        pick(F.lit(True), F.col("__market")).alias("market_id"), pick(F.lit(True), k.isin("transit", "transfer")).alias("in_transit"),
        pick(k != "transit", arrival).alias("arrival"), F.max("ts").alias("as_of"), F.max("__n").alias("__n"), F.max("__present").alias("__present"), F.max(F.when(k != "transfer", F.col("__n"))).alias("__at"),
    )
    # present in the newest snapshot, or named by a transfer since
    kept = out.join(total, "commander", "left").where("__total is null or coalesce(__at, -1) = __total or __n = __total")
    return kept.drop("__era", "__n", "__present", "__at", "__total")


def whereabouts(locations: DataFrame, carriers: DataFrame, now: str) -> DataFrame:
    """Locations with a status: aboard a carrier (whose current system wins), in transit, arrived, or stored."""
    known = carriers.select(F.col("carrier_id").alias("market_id"), "callsign", F.col("system").alias("__system"))
    at = F.lit(now).cast("timestamp")
    minutes = F.floor((F.unix_timestamp("arrival") - F.unix_timestamp(at)) / 60).cast("long")
    rows = locations.join(known, "market_id", "left").withColumn("minutes", minutes)
    aboard = F.col("callsign").isNotNull()
    status = F.when(aboard, "aboard_carrier").when(F.col("in_transit"), F.when(F.col("minutes") <= 0, "arrived").otherwise("in_transit")).otherwise("stored")
    age = F.greatest(F.lit(0.0), F.round((F.unix_timestamp(at) - F.unix_timestamp("as_of")) / 360.0) / 10.0)
    rows = rows.withColumn("status", status).withColumn("system", F.when(aboard, F.coalesce("__system", "system")).otherwise(F.col("system")))
    return rows.withColumn("station", F.when(aboard, F.col("callsign")).otherwise(F.col("station"))).withColumn("age_hours", age).drop("__system", "callsign")


def engineers(events: DataFrame, schema: str = "array<struct<Engineer: string, Rank: int, Progress: string>>") -> DataFrame:
    """The last state of each (commander, engineer), from lists of all of them and from single ones (raw JSON)."""
    one = F.array(F.struct(*(F.get_json_object("raw", f"$.{k}").cast(t).alias(k) for k, t in (("Engineer", "string"), ("Rank", "int"), ("Progress", "string")))))
    many = F.from_json(F.get_json_object("raw", "$.Engineers"), schema)
    rows = events.select("commander", *ORDER, F.explode(F.coalesce(many, one)).alias("e")).where("e.Engineer is not null")
    return latest(rows.select("commander", *ORDER, F.col("e.Engineer").alias("engineer"), F.col("e.Rank").alias("rank"), F.col("e.Progress").alias("progress")), "commander", "engineer")


def patch_slot(modules: Column, slot: Column, engineering: Column) -> Column:
    """A loadout's modules (slot, item, engineering) with the engineering of one slot set."""
    return F.transform(modules, lambda m: F.struct(m["slot"].alias("slot"), m["item"].alias("item"), F.when(m["slot"] == slot, engineering).otherwise(m["engineering"]).alias("engineering")))


def resumed(state: DataFrame, events: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Latest event by key from a stored state and the events since: the same as from all events."""
    return latest(state.unionByName(events.select(state.columns)), *key)


def rate_limited(requests: DataFrame, window: float, most: int, burst: float, burst_most: int) -> DataFrame:
    """Requests (source, ts, id) with whether they pass: ``burst_most`` in each burst, and of those that pass
    that, ``most`` in each window. A window begins with its source's first request after the one before,
    so each depends on the last: a fold by source, from window to window."""

    def places(at: np.ndarray, seconds: float) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        i = 0
        while i < len(at):
            j = int(np.searchsorted(at, at[i] + seconds, "left"))
            out[i:j] = np.arange(j - i)
            i = j
        return out

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ts", "id"], kind="stable")
        at = part["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        passed = places(at, burst) < burst_most
        passed[passed] = places(at[passed], window) < most
        return part.assign(passed=passed)

    return requests.select("source", "ts", "id").groupBy("source").applyInPandas(fold, "source long, ts timestamp, id long, passed boolean")
