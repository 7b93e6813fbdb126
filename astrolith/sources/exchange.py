"""Snapshots for exchange: sections as Parquet under a manifest that says what they must hold."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astrolith.operators import merge
from astrolith.sources.published import file_system

FORMAT = 1


def digest(rows: DataFrame) -> tuple[int, int]:
    """Rows, and a hash of them that does not depend on their order."""
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return found.n, int(found.h) % (1 << 64)


def write_snapshot(spark: SparkSession, path: str, sections: dict[str, DataFrame]) -> None:
    """Write all sections, then the manifest: a snapshot without one is not finished."""
    entries = {}
    for name, rows in sections.items():
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        stored = spark.read.parquet(f"{path}/{name}")
        count, hashed = digest(stored)
        entries[name] = {"rows": count, "hash": str(hashed), "schema": stored.schema.json()}
    fs, at = file_system(spark, path)
    out = fs.create(at(f"{path}/manifest.json"), True)
    out.write(bytearray(json.dumps({"format": FORMAT, "sections": entries}).encode()))
    out.close()


def read_snapshot(spark: SparkSession, path: str, check: bool = True) -> dict[str, DataFrame]:
    """The sections of a snapshot whose format, schemas, counts and hashes are as its manifest says."""
    text = "".join(r.value for r in spark.read.text(f"{path}/manifest.json", wholetext=True).collect())
    manifest = json.loads(text)
    if manifest.get("format") != FORMAT:
        raise ValueError(f"format {manifest.get('format')} is not {FORMAT}")
    out = {}
    for name, entry in manifest["sections"].items():
        rows = spark.read.parquet(f"{path}/{name}")
        if rows.schema.json() != entry["schema"]:
            raise ValueError(f"section {name} has another schema")
        if check and digest(rows) != (entry["rows"], int(entry["hash"])):
            raise ValueError(f"section {name} is damaged")
        out[name] = rows
    return out


def merge_boards(stored: DataFrame, marks: DataFrame, sections: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Stored boards and their watermarks after a snapshot's ``market`` and ``watermarks``: stations of which it knows a newer board."""
    market = sections["market"].join(sections["watermarks"], "station_id").withColumn("pos", F.lit(0))
    return merge.replace_boards(stored, marks, market.select(*stored.columns, "pos"), sections["watermarks"])


def dictionary_encoded(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with dense ids (from 0, in order of the values) for a column, and the dictionary (id, value). Null stays null.
    Only the distinct values are numbered together."""
    values = rows.select(F.col(column).alias("value")).where("value is not null").distinct()
    dictionary = values.withColumn("id", F.row_number().over(Window.orderBy("value")) - 1).select("id", "value")
    encoded = rows.join(dictionary, rows[column] == dictionary["value"], "left").drop("value", column).withColumnRenamed("id", column)
    return encoded.select(rows.columns), dictionary
