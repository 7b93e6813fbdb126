"""Structured Streaming over the feed. Batch and stream share every transformation."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# What an event adds to a cell, by kind, and half-lives in seconds.
WEIGHTS = {"jump": 1.0, "dock": 0.4, "scan": 0.5, "kill": 1.0}
SLOW, FAST, FLOOR, MOST_CELLS = 900.0, 120.0, 0.01, 20_000


def operations(messages: DataFrame) -> DataFrame:
    """Envelopes (kind, message, gateway) as none to several operations (op, key, at, body)."""
    get = lambda p: F.get_json_object("message", p)
    at = F.try_to_timestamp(get("$.timestamp"))
    make = lambda op, key: F.struct(F.lit(op).alias("op"), key.cast("long").alias("key"), at.alias("at"), F.col("message").alias("body"))
    system, station = get("$.SystemAddress"), F.coalesce(get("$.marketId"), get("$.MarketID"))
    event = get("$.event")
    ops = F.array_compact(F.array(
        F.when((F.col("kind") == "commodity") & station.isNotNull(), make("market", station)),
        F.when((F.col("kind") == "outfitting") & station.isNotNull(), make("outfitting", station)),
        F.when((F.col("kind") == "shipyard") & station.isNotNull(), make("shipyard", station)),
        F.when((F.col("kind") == "journal") & event.isin("FSDJump", "Location", "CarrierJump") & system.isNotNull(), make("system", system)),
        F.when((F.col("kind") == "journal") & event.isin("Docked", "Location") & station.isNotNull(), make("identity", station)),
        F.when((F.col("kind") == "journal") & (event == "Scan") & get("$.StarType").isNotNull() & system.isNotNull(), make("star", system)),
    ))
    return messages.select(F.explode(ops).alias("o")).select("o.*").where("at is not null")


def gate_batch(rows: DataFrame, key: str = "key", at: str = "at") -> DataFrame:
    """What a gate that starts empty lets through of an ordered batch: rows newer than all before."""
    from pyspark.sql import Window

    before = F.max(at).over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(at) > F.col("__before"))).drop("__before")


def gate_stream(rows: DataFrame) -> DataFrame:
    """The same over a stream of (key, at, seq): a watermark for each key, kept as state, drops rows
    that are not newer; a global watermark would drop late keys and keep stale rows."""

    def newer(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("seq")
        at = rows["at"].astype("datetime64[us]").astype("int64").to_numpy()
        marks = np.maximum.accumulate(np.concatenate([[state.get[0] if state.exists else np.iinfo(np.int64).min], at]))
        if len(at):
            state.update((int(marks[-1]),))
        yield rows.loc[at > marks[:-1], ["key", "at", "seq"]]

    return rows.groupBy("key").applyInPandasWithState(newer, "key long, at timestamp, seq long", "mark long", "append", GroupStateTimeout.NoTimeout)


def batched_sink(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, attempts: int = 5, pause: float = 0.25, once: bool = False, dead: str | None = None):
    """Micro-batches of 250 ms to ``apply``; a batch that fails is tried again with growing
    pauses. After the last attempt it goes to the ``dead`` folder, to be looked into, or without one it is
    dropped. ``apply`` must be idempotent by batch id."""

    def run(rows: DataFrame, batch: int) -> None:
        for k in range(attempts):
            try:
                return apply(rows, batch)
            except Exception as problem:  # noqa: BLE001
                print(f"batch {batch}, attempt {k + 1}: {problem}")
                time.sleep(pause * 2**k)
        if dead:
            rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(dead)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="250 milliseconds")).start()


class Recorder:
    """A sink that only keeps what it was given: (batch, rows), for tests and replays."""

    def __init__(self):
        self.batches: list[tuple[int, list]] = []

    def __call__(self, rows: DataFrame, batch: int) -> None:
        self.batches.append((batch, rows.collect()))


def result_documents(rows: DataFrame, provenance: str, as_of: Column) -> DataFrame:
    """Each row as a JSON document that says where it comes from and when it was true."""
    return rows.select(F.to_json(F.struct(*rows.columns, F.lit(provenance).alias("provenance"), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("as_of")), {"ignoreNullFields": "false"}).alias("document"))


def heat(events: DataFrame, now: Column, edge: float = 100.0, weights: dict[str, float] = WEIGHTS, most: int = MOST_CELLS) -> DataFrame:
    """Decayed activity of each cell (kind, ts, x, y, z): slow and fast sums, how fast it rises, and the weighted height."""
    weight = F.create_map(*(F.lit(v) for kv in weights.items() for v in kv))[F.col("kind")]
    age = F.unix_timestamp(now) - F.unix_timestamp("ts")
    at = lambda c: F.floor(F.col(c) / edge).cast("long")
    slow, fast = weight * F.pow(0.5, age / SLOW), weight * F.pow(0.5, age / FAST)
    cells = events.where(age >= 0).groupBy(at("x").alias("cx"), at("z").alias("cz")).agg(F.sum(slow).alias("heat"), F.sum(fast).alias("fast"), (F.sum(slow * F.col("y")) / F.sum(slow)).alias("y"))
    cells = cells.where(F.col("heat") >= FLOOR).withColumn("rising", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("fast") / F.col("heat"))))
    return cells.orderBy(F.desc("heat"), "cx", "cz").limit(most)


def heat_stream(events: DataFrame, edge: float = 100.0) -> DataFrame:
    """Minute sums by cell over a stream; readers decay them to their own moment, since a minute's
    sum decays as one."""
    weight = F.create_map(*(F.lit(v) for kv in WEIGHTS.items() for v in kv))[F.col("kind")]
    at = lambda c: F.floor(F.col(c) / edge).cast("long")
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 minute"), at("x").alias("cx"), at("z").alias("cz")).agg(F.sum(weight).alias("weight"), F.sum(weight * F.col("y")).alias("wy"))


def liveness(messages: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    return messages.agg(F.max("gateway").alias("last")).withColumn("alive", F.col("last") >= now - F.make_interval(mins=F.lit(minutes)))


def statistics(messages: DataFrame) -> DataFrame:
    event = F.when(F.col("kind") == "journal", F.get_json_object("message", "$.event"))
    return messages.groupBy("kind", event.alias("event")).agg(F.count("*").alias("n"))


def guarded(telemetry: DataFrame, column: str, most: int) -> DataFrame:
    """Counts by value, all but the ``most`` largest as one ``other``."""
    counts = telemetry.groupBy(column).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), column).limit(most).select(column, F.lit(True).alias("__top"))
    return counts.join(F.broadcast(top), column, "left").groupBy(F.when(F.col("__top"), F.col(column)).otherwise("other").alias(column)).agg(F.sum("n").alias("n"))
