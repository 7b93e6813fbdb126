"""Point indexes and published versions of tables."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolith.functions import maths

INDEX = {"address": "bigint", "x": "double", "y": "double", "z": "double", "cell": "bigint"}


def write_index(points: DataFrame, path: str, parts: int | None = None) -> None:
    """Points in order of cells, so that row groups and files skip what a sphere does not touch."""
    rows = points.withColumn("cell", maths.cell(F.col("x"), F.col("y"), F.col("z"))).where("cell is not null")
    rows = rows.repartitionByRange(parts, "cell") if parts else rows.repartitionByRange("cell")
    rows.sortWithinPartitions("cell").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    have = dict(rows.dtypes)
    wrong = {k: have.get(k) for k, t in INDEX.items() if have.get(k) != t}
    if wrong:
        raise ValueError(f"not a point index: {wrong}")
    return rows


def extract_index(spark: SparkSession, source: str, target: str, predicate: str) -> None:
    write_index(read_index(spark, source).where(predicate), target)


def file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="astrolith-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def settled(rows: DataFrame, label: str = "settled") -> DataFrame:
    """``rows`` written to the shared folder and read again: their lineage, and what a plan thinks of their size, end at
    files that outlive any executor."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for t in tables:
        fs, path = file_system(t.sparkSession, t.stored_at)
        fs.delete(path(t.stored_at), True)


def stored(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], order: list[str]) -> DataFrame:
    """A table derived from the files at ``source``, written once and read again while they stay as they are. Rows lie in
    order of ``order``, so that a filter on its first column skips files and row groups."""
    fs, path = file_system(spark, source)
    files = fs.globStatus(path(source)) or []
    state = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)
    key = hashlib.sha256(f"{source} {state} {spark.sparkContext.applicationId}".encode()).hexdigest()[:20]
    target = f"{shared_folder(spark)}/stored-{name}-{key}"
    fs, path = file_system(spark, target)
    if not fs.exists(path(f"{target}/_SUCCESS")):
        build().repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)


def publish(spark: SparkSession, root: str, product: str, version: int, rows: DataFrame, keep: int = 2) -> None:
    """Write a version, then swap the manifest that names it, then prune old versions. Readers see
    the old or the new version as a whole. Any Hadoop file system will do."""
    target = f"{root}/{product}/version={version}"
    rows.write.mode("overwrite").parquet(target)
    fs, path = file_system(spark, root)
    manifest, fresh = path(f"{root}/{product}/manifest.json"), path(f"{root}/{product}/manifest.json.new")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps({"product": product, "version": version}).encode()))
    out.close()
    if fs.exists(manifest):
        fs.delete(manifest, False)
    fs.rename(fresh, manifest)
    versions = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path(f"{root}/{product}")) if s.getPath().getName().startswith("version="))
    for old in [v for v in versions if v < version][: -(keep - 1) or None] if keep > 1 else [v for v in versions if v < version]:
        fs.delete(path(f"{root}/{product}/version={old}"), True)


def current(spark: SparkSession, root: str, product: str) -> DataFrame:
    row = spark.read.json(f"{root}/{product}/manifest.json").first()
    return spark.read.parquet(f"{root}/{product}/version={row['version']}")
