"""Folds of an append-only journal: windows in replay order (time, file, offset)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolith.functions import times

ORDER = ("ts", "file", "offset")


def replay(*partition: str):
    return Window.partitionBy(*partition).orderBy(*ORDER)


def latest(events: DataFrame, *key: str) -> DataFrame:
    """The last event of each key."""
    row = F.struct(*ORDER, *(c for c in events.columns if c not in (*ORDER, *key)))
    return events.groupBy(*key).agg(F.max(row).alias("__r")).select(*key, "__r.*")


def histogram(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.count("*").alias("n"))


def carry_forward(events: DataFrame, condition: Column, value: Column, name: str, partition: tuple[str, ...] = ("commander",)) -> DataFrame:
    """The last value that an earlier event with ``condition`` gave."""
    before = replay(*partition).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(name, F.last(F.when(condition, value), ignorenulls=True).over(before))


def as_of(events: DataFrame, awards: Column, causes: Column, seconds: float, partition: tuple[str, ...] = ("commander",)) -> DataFrame:
    """Each award with the last cause before it, if that is no more than ``seconds`` old, and
    how many causes lie within that time."""
    before = replay(*partition).rowsBetween(Window.unboundedPreceding, -1)
    cause = F.when(causes, F.struct(F.col("ts").alias("ts"), F.col("offset").alias("offset"), F.col("event").alias("event"), F.col("value").alias("value")))
    micros = F.unix_micros("ts")
    near = Window.partitionBy(*partition).orderBy("__micros").rangeBetween(-int(seconds * 1_000_000), 0)
    seen = events.withColumn("__micros", micros).withColumn("__cause", F.last(cause, ignorenulls=True).over(before)).withColumn("candidates", F.count(F.when(causes, 1)).over(near))
    found = seen.where(awards).withColumn("__cause", F.when(F.unix_micros("ts") - F.unix_micros("__cause.ts") <= int(seconds * 1_000_000), F.col("__cause")))
    return found.select(*events.columns, F.col("__cause.offset").alias("cause_offset"), F.col("__cause.event").alias("cause_event"), F.col("__cause.value").alias("cause_value"), "candidates")


def sessions(events: DataFrame, opens: Column, closes: Column, partition: tuple[str, ...] = ("commander",)) -> DataFrame:
    """``session``: how many boundaries came up to each event; an opening event starts a session,
    a closing one is the last of its own."""
    start = F.when(opens, 1).otherwise(0)
    ended = F.lag(F.when(closes, 1).otherwise(0), 1, 0).over(replay(*partition))
    return events.withColumn("session", F.sum(F.greatest(start, ended)).over(replay(*partition).rowsBetween(Window.unboundedPreceding, 0)))


def session_summary(events: DataFrame, qualifies: Column, idle_cap: float = 600.0, partition: tuple[str, ...] = ("commander",)) -> DataFrame:
    """Sessions with a qualifying event: span, events, and active seconds, in which no gap counts for more than ``idle_cap``."""
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(replay(*partition, "session"))
    rows = events.withColumn("__gap", F.coalesce(F.least(gap / 1e6, F.lit(idle_cap)), F.lit(0.0)))
    out = rows.groupBy(*partition, "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"), F.sum("__gap").alias("active"), F.sum(F.when(qualifies, 1).otherwise(0)).alias("hits"), F.sum(F.when(qualifies, F.col("value")).otherwise(0.0)).alias("total"))
    return out.where("hits > 0")


def intervals(events: DataFrame, condition: Column, partition: tuple[str, ...]) -> DataFrame:
    """Seconds since the previous such event of the partition."""
    rows = events.where(condition)
    return rows.withColumn("gap_s", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(replay(*partition))) / 1e6)


def timeline(events: DataFrame, unit: str, left: Column, right: Column) -> DataFrame:
    """Two kinds of events counted by bucket, buckets of either kind."""
    at = times.bucket(F.col("ts"), unit).alias("bucket")
    a = events.where(left).groupBy(at).agg(F.count("*").alias("kills"), F.sum("value").alias("earned"))
    b = events.where(right).groupBy(at).agg(F.count("*").alias("incidents"))
    return a.join(b, "bucket", "full_outer").select("bucket", F.coalesce("kills", F.lit(0)).alias("kills"), F.coalesce("earned", F.lit(0.0)).alias("earned"), F.coalesce("incidents", F.lit(0)).alias("incidents"))


def integer_median(values: Column) -> Column:
    """Even counts: the floor of the mean of both middles. ``values``: a sorted array of integers."""
    n = F.size(values)
    upper, lower = F.get(values, F.floor(n / 2).cast("int")), F.get(values, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, F.floor((upper + lower) / 2).cast("long"))


def upper_median(values: Column) -> Column:
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def p90(values: Column) -> Column:
    """Nearest rank; null under ten values."""
    n = F.size(values)
    return F.when(n >= 10, F.get(values, (F.floor(n * 9 / 10) - 1).cast("int")))


def bounded_median(column: str, low: float, high: float, least: int) -> Column:
    """Mean of the middles of what lies in bounds, null under ``least`` samples."""
    inside = F.when(F.col(column).between(low, high), F.col(column))
    return F.when(F.count(inside) >= least, F.median(inside))


def clamped_inventory(events: DataFrame, delta: Column, resets: Column, key: tuple[str, ...]) -> DataFrame:
    """Stock after all events: reset events set it, others add to it, and it never falls below zero.

    A clamped running sum is the running sum less its lowest value so far below zero, so
    no state is folded in Python."""
    w = replay(*key)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("__era", F.sum(F.when(resets, 1).otherwise(0)).over(upto)).withColumn("__d", delta)
    inner = Window.partitionBy(*key, "__era").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__sum", F.sum("__d").over(inner))
    rows = rows.withColumn("stock", F.col("__sum") - F.least(F.min("__sum").over(inner), F.lit(0)))
    return latest(rows.drop("__d", "__sum", "__era"), *key)


def last_values(events: DataFrame, fields: dict[str, Column], key: tuple[str, ...]) -> DataFrame:
    """The last value of each field that is not null, with its time."""
    aggs = []
    for name, c in fields.items():
        at = F.when(c.isNotNull(), F.struct(*ORDER))
        aggs += [F.max_by(c, at).alias(name), F.max(at)["ts"].alias(f"{name}_at")]
    return events.groupBy(*key).agg(*aggs)


def credit_estimate(events: DataFrame, base: str, signs: dict[str, int]) -> DataFrame:
    """The last ``base`` event's value plus the signed values of what followed it."""
    start = events.where(F.col("event") == base).groupBy("commander").agg(F.max(F.struct(*ORDER, "value")).alias("b"))
    sign = F.create_map(*(F.lit(x) for kv in signs.items() for x in kv))[F.col("event")]
    later = events.where(F.col("event").isin(*signs)).join(start, "commander").where(F.struct(*ORDER) > F.struct("b.ts", "b.file", "b.offset"))
    moved = later.groupBy("commander").agg(F.sum(F.col("value") * sign).alias("moved"))
    return start.join(moved, "commander", "left").select("commander", (F.col("b.value") + F.coalesce("moved", F.lit(0.0))).alias("credits"))


def burn_rates(events: DataFrame, used: Column, last: int = 15, prior: float = 0.01) -> DataFrame:
    """Upper median of the last samples of use per second, or a prior where there are none."""
    w = replay("commander")
    rows = events.withColumn("__dt", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6).withColumn("__drop", F.lag(used).over(w) - used)
    good = F.when((F.col("__dt") > 0) & (F.col("__drop") > 0.3), F.struct(F.struct(*(F.col(c) for c in ORDER)).alias("o"), (F.col("__drop") / F.col("__dt")).alias("rate")))
    kept = rows.select("commander", good.alias("g")).where("g is not null").withColumn("__rank", F.row_number().over(Window.partitionBy("commander").orderBy(F.desc("g.o")))).where(F.col("__rank") <= last)
    rates = kept.groupBy("commander").agg(upper_median(F.sort_array(F.collect_list("g.rate"))).alias("rate"))
    return events.select("commander").distinct().join(rates, "commander", "left").withColumn("rate", F.coalesce("rate", F.lit(prior)))


def lock_to_kill(events: DataFrame) -> DataFrame:
    """Seconds from the first lock on a target since its last kill to its next kill.

    ``events``: commander, target, event in ('lock', 'kill'). Pure windows: kills number the
    eras of a target, the first lock of an era belongs to the kill that ends it."""
    w = replay("commander", "target")
    kills_before = F.sum(F.when(F.col("event") == "kill", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumn("__era", F.coalesce(kills_before, F.lit(0)))
    return rows.groupBy("commander", "target", "__era").agg(F.min(F.when(F.col("event") == "lock", F.unix_micros("ts"))).alias("a"), F.max(F.when(F.col("event") == "kill", F.unix_micros("ts"))).alias("b")).where("a is not null and b is not null and b >= a").select("commander", "target", ((F.col("b") - F.col("a")) / 1e6).alias("ttk_s"))


def suppressed_repeats(rows: DataFrame, seconds: Column) -> DataFrame:
    """Callouts (commander, kind, text, ts) that pass a repeat gate, with how many were suppressed since
    the last that did. A window starts anew only when one passes, so the fold is sequential
    in each (commander, kind, text): rows stream by in order, and only the last that passed is held."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last, held = None, 0, 0
        for rows in batches:
            at = rows["ts"].astype("datetime64[us]").astype("int64").tolist()
            passed, counts = [], []
            for k, (one, now, gate) in enumerate(zip(zip(rows["commander"], rows["kind"], rows["text"]), at, (rows["gate"] * 1e6).tolist())):
                if one == key and now - last < gate:
                    held += 1
                    continue
                passed.append(k)
                counts.append(held if one == key else 0)
                key, last, held = one, now, 0
            yield rows.iloc[passed][["commander", "kind", "text", "ts"]].assign(suppressed=counts)

    keys = ["commander", "kind", "text"]
    dealt = rows.select(*keys, *ORDER, seconds.alias("gate")).repartition(*keys).sortWithinPartitions(*keys, *ORDER)
    return dealt.mapInPandas(fold, "commander long, kind string, text string, ts timestamp, suppressed long")


def in_windows(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events (commander, ts) in their commander's windows (commander, start, until); one without an end is still open."""
    both = events.join(windows, "commander")
    return both.where((F.col("ts") >= F.col("start")) & (F.col("until").isNull() | (F.col("ts") <= F.col("until"))))


def repeated(events: DataFrame, by: str, least: int = 2) -> DataFrame:
    """(by, n) of what stands in the log several times."""
    return events.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def dominant(rows: DataFrame, key: str, group: str, hit: Column) -> DataFrame:
    """(key, group, kills, n): each key's group with the most rows, the smaller on ties, and how many of them are hits."""
    counts = rows.groupBy(key, group).agg(F.sum(F.when(hit, 1).otherwise(0)).alias("kills"), F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("__n"), group, "kills")).alias("b"))
    return best.select(key, f"b.{group}", "b.kills", (-F.col("b.__n")).alias("n"))
