"""Training-data pipeline over ``documents``: fit documents, one of each near-duplicate group,
without repeated passages, without personal data, packed into binary-length sequences.

Every stage takes (spark, docs, sf_dir); its result is written and read again as the docs
of the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolith.llm.common import materialise, table
from astrolith.llm.cotrain import keep_fit
from astrolith.llm.minhash import keep_one
from astrolith.llm.packing import pack_binary
from astrolith.llm.pii import sanitise
from astrolith.llm.suffixdedup import strip_repeats


#: Similarity of word shingles, in percent, from which texts are near-duplicates. The bands of
#: op9 miss a pair right at it with probability (1 - 0.8^7)^36, 2.1e-4.
SIMILAR = 80
#: Words of the shortest passage that may not stand twice: all over 50.
PASSAGE = 51


def _resized(docs: DataFrame) -> DataFrame:
    """n_chars follows the changed texts."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_fit(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, SIMILAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _resized(strip_repeats(docs, PASSAGE))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _resized(sanitise(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_binary(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", packing)]

#: Models, sketches and suffix sorting are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
