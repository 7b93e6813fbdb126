"""Merges: strictly newer wins, boards replace as wholes, facts fill gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest_snapshots(rows: DataFrame, key: str, at: str = "observed_at") -> DataFrame:
    """All rows of each key's newest snapshot."""
    last = rows.groupBy(key).agg(F.max(at).alias(at))
    return rows.join(last, [key, at], "left_semi")


def replace_boards(stored: DataFrame, marks: DataFrame, incoming: DataFrame, arrivals: DataFrame, key: str = "station_id", item: str = "symbol", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Boards after incoming snapshots, and their watermarks.

    ``marks`` and ``arrivals`` hold (key, observed_at) of stored and incoming snapshots, empty
    ones included: a newer snapshot replaces all rows of its key, also by none. Equal times
    apply only if not ``strict``. Of one item's several rows the last (greatest ``pos``) counts."""
    newest = arrivals.groupBy(key).agg(F.max("observed_at").alias("arrived"))
    both = marks.join(newest, key, "full_outer")
    newer = F.col("observed_at").isNull() | ((F.col("arrived") > F.col("observed_at")) if strict else (F.col("arrived") >= F.col("observed_at")))
    both = both.withColumn("apply", F.col("arrived").isNotNull() & newer)
    applied = both.where("apply").select(key, F.col("arrived").alias("observed_at"))
    order = Window.partitionBy(key, item).orderBy(F.desc("pos"))
    fresh = incoming.join(applied, [key, "observed_at"], "left_semi").withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank", "pos")
    kept = stored.join(applied.select(key), key, "left_anti")
    marks = both.select(key, F.when(F.col("apply"), F.col("arrived")).otherwise(F.col("observed_at")).alias("observed_at"))
    return kept.unionByName(fresh), marks


def fill_facts(stored: DataFrame, incoming: DataFrame, key: str, facts: list[str], at: str = "observed_at", fill_gaps: bool = True, gated: bool = True) -> DataFrame:
    """Facts by key: newer incoming values win where they are not null; with ``fill_gaps`` older
    ones fill what was never learned. The time is the later one; ungated merges ignore it."""
    new = incoming.groupBy(key).agg(F.max(F.struct(at, *facts)).alias("n")).select(key, "n")
    both = stored.join(new, key, "full_outer")
    wins = F.lit(True) if not gated else F.col(at).isNull() | (F.col(f"n.{at}") > F.col(at))
    pick = lambda c: F.when(wins, F.coalesce(f"n.{c}", c)).otherwise(F.coalesce(F.col(c), F.col(f"n.{c}")) if fill_gaps else F.col(c)).alias(c)
    return both.select(key, *(pick(c) for c in facts), F.greatest(at, f"n.{at}").alias(at))


def prefer_sources(rows: DataFrame, key: str, weak: str = "navroute") -> DataFrame:
    """One observation for each key: any known one of a strong source beats the weak source, then the newer."""
    known = F.when(F.col("cls") != "Unknown", 1).otherwise(0)
    strong = F.when(F.col("source") != weak, 1).otherwise(0)
    best = F.max(F.struct(known.alias("known"), strong.alias("strong"), "observed_at", "source", "cls"))
    return rows.groupBy(key).agg(best.alias("b")).select(key, "b.cls", "b.source", "b.observed_at")


def promote(stations: DataFrame, promotions: DataFrame) -> DataFrame:
    """Stations of provisional systems (negative addresses) under their real addresses."""
    known = promotions.select(F.col("provisional").alias("system_address"), "real")
    return stations.join(known, "system_address", "left").withColumn("system_address", F.coalesce("real", "system_address")).drop("real")


def patch_prices(board: DataFrame, seen: DataFrame) -> DataFrame:
    """Least positive price of each (station, symbol) seen, and its variants in order, onto the board."""
    least = seen.groupBy("station_id", "symbol").agg(F.min(F.when(F.col("price") > 0, F.col("price"))).alias("credits"), F.array_sort(F.collect_set("variant")).alias("variants"))
    return board.join(least, ["station_id", "symbol"], "left").withColumn("credits", F.coalesce("credits", F.lit(0).cast("long")))


def difference(old: DataFrame, new: DataFrame, key: list[str], facts: list[str]) -> DataFrame:
    """What turns ``old`` into ``new``: add, update or retract by key; what is equal is left out."""
    pack = lambda df, n: df.select(*key, F.struct(*facts).alias(n))
    both = pack(old, "a").join(pack(new, "b"), key, "full_outer")
    op = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "retract").when(~F.col("a").eqNullSafe(F.col("b")), "update")
    return both.withColumn("op", op).where("op is not null").select(*key, "op", F.when(F.col("op") == "retract", F.col("a")).otherwise(F.col("b")).alias("facts")).select(*key, "op", "facts.*")


def net_operations(steps: DataFrame, key: list[str], facts: list[str]) -> DataFrame:
    """One operation for each key from an ordered chain (``step``, ``op``), and whether the chain is
    consistent: an add follows nothing or a retract, the others follow what exists. An add that is
    retracted again leaves none."""
    w = Window.partitionBy(*key).orderBy("step")
    before = F.lag("op").over(w)
    wrong = ((F.col("op") == "add") & before.isin("add", "update")) | ((F.col("op") != "add") & (before == "retract"))
    rows = steps.withColumn("__wrong", F.coalesce(wrong, F.lit(False)))
    net = rows.groupBy(*key).agg(F.min_by("op", "step").alias("first_op"), F.max(F.struct("step", "op", *facts)).alias("z"), F.max("__wrong").alias("inconsistent"))
    last = F.col("z.op")
    op = F.when(F.col("inconsistent"), "error").when((F.col("first_op") == "add") & (last == "retract"), F.lit(None)).when(F.col("first_op") == "add", "add").when(last == "add", "update").otherwise(last)
    return net.select(*key, op.alias("op"), *(F.col(f"z.{c}").alias(c) for c in facts)).where("op is not null")


def apply_operations(base: DataFrame, net: DataFrame, key: list[str], facts: list[str]) -> DataFrame:
    """Base rows with a net operation each applied; errors stay out and are to be counted first."""
    patch = net.where("op <> 'error'").select(*key, "op", F.struct(*facts).alias("n"))
    both = base.select(*key, F.struct(*facts).alias("o")).join(patch, key, "full_outer").where("op is null or op <> 'retract'")
    return both.select(*key, F.when(F.col("op").isNotNull(), F.col("n")).otherwise(F.col("o")).alias("f")).select(*key, "f.*")


def presence(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """How many keys are in both, only in the old, only in the new."""
    a, b = old.select(*key).distinct().withColumn("a", F.lit(1)), new.select(*key).distinct().withColumn("b", F.lit(1))
    where = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "old").otherwise("both")
    return a.join(b, key, "full_outer").groupBy(where.alias("side")).agg(F.count("*").alias("n"))


def source_systems(stored: DataFrame, incoming: DataFrame, facts: list[str]) -> DataFrame:
    """Systems (address, name, facts, source_at, feed_at) after rows of a dump (address, name, facts, at).

    A provisional row (negative address) of the same name takes the real address, unless that
    is there already. A row whose name another address holds is skipped; so are all but the smallest of
    several new addresses of one name. A row counts if it is newer than both times; its nulls change nothing."""
    new = incoming.groupBy("address").agg(F.max(F.struct("at", "name", *facts)).alias("n")).select("address", F.lower("n.name").alias("__name"), "n")
    real = new.join(stored.select("address"), "address", "left_anti").groupBy("__name").agg(F.min("address").alias("__real"))
    held = stored.withColumn("__name", F.lower("name")).join(real, "__name", "left")
    held = held.withColumn("address", F.when(F.col("address") < 0, F.coalesce("__real", "address")).otherwise(F.col("address"))).drop("__real")
    owner = held.groupBy("__name").agg(F.min("address").alias("__owner"))
    new = new.join(owner, "__name", "left").where("__owner is null or __owner = address").drop("__owner")
    new = new.join(new.groupBy("__name").agg(F.min("address").alias("__first")), "__name").where("address = __first or __name is null").select("address", "n")
    both = held.drop("__name").join(new, "address", "full_outer")
    older = lambda c: F.col(c).isNull() | (F.col(c) < F.col("n.at"))
    wins = F.col("n").isNotNull() & older("source_at") & older("feed_at")
    pick = lambda c: F.when(wins, F.coalesce(f"n.{c}", c)).otherwise(F.col(c)).alias(c)
    return both.select("address", pick("name"), *(pick(c) for c in facts), F.when(wins, F.col("n.at")).otherwise(F.col("source_at")).alias("source_at"), "feed_at")


def merge_bodies(stored: DataFrame, incoming: DataFrame, facts: list[str], sticky: list[str]) -> tuple[DataFrame, DataFrame]:
    """Bodies (body_id, facts, sticky, observed_at) after incoming ones, and the ids that were written. Equal times
    apply again; ``sticky`` facts keep what is known where the new value is null."""
    new = incoming.groupBy("body_id").agg(F.max(F.struct("observed_at", *facts, *sticky)).alias("n"))
    both = stored.join(new, "body_id", "full_outer").withColumn("__wins", F.col("n").isNotNull() & (F.col("observed_at").isNull() | (F.col("observed_at") <= F.col("n.observed_at"))))
    pick = lambda c, new: F.when(F.col("__wins"), new).otherwise(F.col(c)).alias(c)
    bodies = both.select("body_id", *(pick(c, F.col(f"n.{c}")) for c in (*facts, "observed_at")), *(pick(c, F.coalesce(f"n.{c}", c)) for c in sticky))
    return bodies, both.where("__wins").select("body_id")


def replace_children(stored: DataFrame, incoming: DataFrame, written: DataFrame, given_only: bool = False, key: str = "body_id") -> DataFrame:
    """Children (materials, rings, hotspots) of the written parents replaced by those that came with them;
    with ``given_only`` parents that came without any keep theirs."""
    fresh = incoming.join(written, key, "left_semi")
    gone = fresh.select(key).distinct() if given_only else written
    return stored.join(gone, key, "left_anti").unionByName(fresh)


def replace_hotspots(stored: DataFrame, incoming: DataFrame, bodies: DataFrame) -> DataFrame:
    """Hotspots (body_id, ring, material, count) after signals of rings (system_address, ring, material, count).
    The parent is the body that the ring's name names in its system; rings without one are skipped. No
    time is compared: what comes replaces that ring's."""
    from astrolith.functions.strings import ring_parent

    parents = bodies.groupBy("system_address", F.col("body").alias("__parent")).agg(F.min("body_id").alias("body_id"))
    placed = incoming.withColumn("__parent", ring_parent(F.col("ring"))).join(parents, ["system_address", "__parent"])
    fresh = placed.groupBy("body_id", "ring", "material").agg(F.max("count").alias("count"))
    return stored.join(fresh.select("body_id", "ring").distinct(), ["body_id", "ring"], "left_anti").unionByName(fresh)


def merge_signals(bodies: DataFrame, incoming: DataFrame, signals: list[str], facts: list[str]) -> DataFrame:
    """Signals of bodies: non-null values replace, whatever their time; unknown bodies are added with ``facts``."""
    new = incoming.select("body_id", F.struct(*facts, *signals).alias("n"))
    known = F.col("__known").isNotNull()
    both = bodies.withColumn("__known", F.lit(1)).join(new, "body_id", "full_outer")
    keep = [F.when(known, F.col(c)).otherwise(F.col(f"n.{c}")).alias(c) for c in facts]
    return both.select("body_id", *keep, *(F.coalesce(f"n.{c}", c).alias(c) for c in signals))


def interned(dimension: DataFrame, names: DataFrame) -> DataFrame:
    """The dimension (id, name) with names that it lacks, under ids from the greatest one on, in order of the
    names. Only the new names are numbered together."""
    fresh = names.where("name is not null").select("name").distinct().join(dimension.select("name"), "name", "left_anti")
    top = dimension.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    numbered = fresh.withColumn("__n", F.row_number().over(Window.orderBy("name"))).join(F.broadcast(top))  # one row
    return dimension.select("id", "name").unionByName(numbered.select((F.col("__top") + F.col("__n")).alias("id"), "name"))


def fuse_board(report: DataFrame, board: DataFrame) -> DataFrame:
    """A report's rows (station_id, symbol, observed_at, ...) with a client's own board in place of those of its
    station, if the report has that station and the board is newer than all its rows."""
    marks = report.groupBy("station_id").agg(F.max("observed_at").alias("__at"))
    newer = board.join(marks, "station_id").where("observed_at > __at").drop("__at")
    return report.join(newer.select("station_id").distinct(), "station_id", "left_anti").unionByName(newer.select(report.columns))


def save_stars(stored: DataFrame, incoming: DataFrame, if_unknown: bool = False) -> DataFrame:
    """Learned stars by address: an incoming one replaces what is stored, or with ``if_unknown`` stays out
    where something is; of several incoming ones the last (greatest ``pos``) counts."""
    last = incoming.groupBy("address").agg(F.max(F.struct("pos", *(c for c in stored.columns if c != "address"))).alias("n")).select("address", *(F.col(f"n.{c}").alias(c) for c in stored.columns if c != "address"))
    if if_unknown:
        return stored.unionByName(last.join(stored.select("address"), "address", "left_anti"))
    return stored.join(last.select("address"), "address", "left_anti").unionByName(last)


def unnested(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each place of parallel arrays; shorter ones give nulls."""
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, F.inline(F.arrays_zip(*columns)))


def pruned(events: DataFrame, kinds: tuple[str, ...], cutoff: str) -> DataFrame:
    """The log without events of some kinds that are older than the cutoff."""
    return events.where(~(F.col("event").isin(*kinds) & (F.col("ts") < F.lit(cutoff).cast("timestamp"))))


def holdings(materials: DataFrame, cargo: DataFrame) -> DataFrame:
    """(kind, name, count) of both."""
    return materials.select(F.lit("material").alias("kind"), "name", "count").unionByName(cargo.select(F.lit("cargo").alias("kind"), "name", "count"))


def folded_symbols(rows: DataFrame, symbol: str, item: str) -> DataFrame:
    """(symbol, item, n): the canonical form of symbols, however wrapped, with its least item and how many fold onto it."""
    from astrolith.functions.strings import canonical_symbol

    return rows.groupBy(canonical_symbol(F.col(symbol)).alias("symbol")).agg(F.min(item).alias(item), F.count("*").alias("n"))
