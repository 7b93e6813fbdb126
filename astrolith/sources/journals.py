"""Journal files, companion documents, feed frames and catalogs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_order(path: Column) -> Column:
    """A key that sorts journal files by time, in both forms of their names."""
    name = F.element_at(F.split(path, "/"), -1)
    new = F.regexp_extract(name, r"^Journal\w*\.(\d{4}-\d{2}-\d{2}T\d{6})\.(\d+)", 1)
    old = F.regexp_extract(name, r"^Journal\w*\.(\d{12})\.(\d+)", 1)
    part = F.lpad(F.regexp_extract(name, r"\.(\d+)\.log$", 1), 3, "0")
    stamp = F.when(new != "", F.regexp_replace(new, "[-T]", "")).when(old != "", F.concat(F.lit("20"), old))
    return F.concat_ws(".", stamp, part)


def journal_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, raw): complete lines with their byte offsets; a last line without its newline
    waits. Offsets are a running sum over each file's lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\n").alias("lines"))
    lines = whole.select("file", F.posexplode(F.slice("lines", F.lit(1), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("n", "raw"))
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sized = lines.withColumn("offset", F.coalesce(F.sum(F.octet_length("raw").cast("long") + 1).over(before), F.lit(0).cast("long")))
    return sized.select("file", "offset", F.rtrim(F.regexp_replace("raw", "\r$", "")).alias("raw")).where("raw <> ''")


def tail(lines: DataFrame, checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (file, offset, raw) from each file's checkpoint (file, next) on, and the checkpoints after them. A file that
    is shorter than its checkpoint was written anew and is read from its start."""
    ends = lines.groupBy("file").agg(F.max(F.col("offset") + F.octet_length("raw")).alias("__end"))
    known = ends.join(checkpoints, "file", "left").withColumn("__from", F.when(F.col("next") <= F.col("__end") + 2, F.col("next")).otherwise(0)).select("file", "__from", "__end")
    fresh = lines.join(known, "file").where(F.col("offset") >= F.coalesce("__from", F.lit(0))).select(lines.columns)
    after = checkpoints.join(ends.select("file"), "file", "left_anti").select("file", "next").unionByName(ends.select("file", (F.col("__end") + 1).alias("next")))
    return fresh, after


def latest_documents(documents: DataFrame) -> DataFrame:
    """The newest document (name, ts, raw) of each name."""
    return documents.groupBy("name").agg(F.max(F.struct("ts", "raw")).alias("d")).select("name", "d.ts", "d.raw")


def journal_events(lines: DataFrame) -> DataFrame:
    get = lambda p: F.get_json_object("raw", p)
    return lines.select("file", "offset", F.try_to_timestamp(get("$.timestamp")).alias("ts"), get("$.event").alias("event"), get("$.SystemAddress").cast("long").alias("system_address"), get("$.MarketID").cast("long").alias("market_id"), "raw").where("event is not null")


def append_new(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Lines not yet stored, by (file, offset)."""
    return found.join(stored.select("file", "offset"), ["file", "offset"], "left_anti")


def by_commander(events: DataFrame) -> DataFrame:
    """Each file's events under the first FID that the file names."""
    fid = F.get_json_object("raw", "$.FID")
    owner = events.groupBy("file").agg(F.min_by(fid, F.when(fid.isNotNull(), F.col("offset"))).alias("fid"))
    return events.join(owner, "file", "left")


def attribute_document(scores: DataFrame) -> DataFrame:
    """Which commander a companion document belongs to. ``scores``: document, commander, kind ('exact',
    'distance', 'mismatch', 'unknown'), distance, and total (of a hold or locker).

    One commander takes all; of several with exact scores none takes a document with a non-zero total,
    else all do; without exact ones the nearest does if the next is twice as far."""
    n = scores.groupBy("document").agg(
        F.count("*").alias("all"), F.count_if(F.col("kind") == "exact").alias("exact"), F.max("total").alias("most"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "distance", F.struct("distance", "commander")))).alias("near"),
    )
    both = scores.join(n, "document")
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    nearest = (F.col("exact") == 0) & (F.col("commander") == first["commander"]) & (second.isNull() | (second["distance"] >= 2 * first["distance"]))
    exact = (F.col("kind") == "exact") & ((F.col("exact") == 1) | (F.coalesce("most", F.lit(0)) == 0))
    return both.where((F.col("all") == 1) | exact | nearest).select("document", "commander")


def inflate(frames: DataFrame, column: str = "frame") -> DataFrame:
    """Text of zlib frames; null for what does not inflate. Batches go through Arrow."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(raw) -> str | None:
            try:
                return zlib.decompress(raw).decode("utf-8", "replace")
            except (zlib.error, TypeError):
                return None

        for batch in batches:
            yield batch.map(one)

    return frames.withColumn("text", text(column))


def payloads(texts: DataFrame) -> DataFrame:
    """(kind, software, gateway, message) of envelopes, by the schema that they name; other schemas are kept as ``other``."""
    ref = F.get_json_object("text", "$['$schemaRef']")
    tail = F.element_at(F.split(ref, "/schemas/"), 2)
    kind = F.regexp_extract(tail, "^([a-z]+)/", 1)
    known = ("commodity", "outfitting", "shipyard", "journal", "navroute", "fssbodysignals")
    return texts.select(F.when(kind.isin(*known), kind).otherwise("other").alias("kind"), tail.alias("schema"), F.get_json_object("text", "$.header.softwareName").alias("software"), F.try_to_timestamp(F.get_json_object("text", "$.header.gatewayTimestamp")).alias("gateway"), F.get_json_object("text", "$.message").alias("message"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A CSV catalog with a header and quoted fields; column names in lower case."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"')
    return rows.toDF(*(c.strip().lower() for c in rows.columns))


def fixture(spark: SparkSession, path: str, field: str) -> DataFrame:
    """One JSON document's list as rows."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("r")).select("r.*")
