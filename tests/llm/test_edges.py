"""Nulls, blanks, long texts, repeated rows, clashing columns and empty tables in every operator."""

import math
import zlib

import pytest
from pyspark.sql import functions as F

from astrolith.llm import common, cotrain, ivfpq, langid, maxscore, minhash, packing, pieces, pii, ring, suffixdedup
from tests.llm.docs import ROWS, documents, empty

LABELS = "doc_id long, quality int, toxic int"
ON_DOCS = {
    "langid": lambda d: langid.identify(d, 50),
    "pieces": pieces.encode_pieces,
    "pii": pii.personal_spans,
    "suffixes": suffixdedup.dedup_digest,
    "ring": ring.shard_ring,
    "minhash": minhash.near_duplicates,
    "packing": packing.pack_binary,
}


@pytest.mark.parametrize("name", ON_DOCS)
def test_awkward_rows(spark, name):
    rows = ON_DOCS[name](documents(spark)).collect()
    ids = [r.doc_id for r in rows]
    if name == "packing":
        assert set(ids) == {r[0] for r in ROWS}
        assert sum(r.start == 0 for r in rows) == len(ROWS)
    else:
        assert sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", ON_DOCS)
def test_empty_table(spark, name):
    assert ON_DOCS[name](empty(spark)).collect() == []


@pytest.mark.parametrize("stage", [suffixdedup.strip_repeats, pii.sanitise, minhash.keep_one])
def test_stages_keep_columns(spark, stage):
    docs = documents(spark)
    out = stage(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r.uid == "own uid" and r.spans == "own spans" for r in rows)
    assert stage(empty(spark)).collect() == []
    if stage is minhash.keep_one:
        assert sorted((r.doc_id for r in rows), key=str) == sorted([1, 2, 3, 4, 5, 8, 9, 10, 11, 13, None, None], key=str)
    else:
        assert len(rows) == len(ROWS)


def test_unlike_texts_of_one_id_stay(spark):
    """Components are told apart by their own label, whatever the ids of their rows."""
    text = lambda name: " ".join(f"{name}{k}" for k in range(30))
    rows = [(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (7, text("c")), (None, text("d")), (8, text("c")), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in minhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (None, None), (9, "")], key=str)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, None), (8, 0, 0), (10, 0, 1), (None, 1, 0), (11, None, 0)], LABELS)
    rows = {r.doc_id: r for r in cotrain.quality(documents(spark), labels).collect()}
    assert rows[1].score == 0 and not rows[1].kept and rows[3].score == 0
    assert all(0 <= r.score <= 1 for r in rows.values())
    none = spark.createDataFrame([], LABELS)
    assert {r.doc_id: r.score for r in cotrain.quality(documents(spark), none).collect()}[4] == 1
    assert cotrain.quality(empty(spark), labels).collect() == []
    kept = cotrain.keep_fit(documents(spark), labels)
    assert kept.columns == documents(spark).columns and all(r.text.strip() for r in kept.collect())


VECTORS = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (40, None), (50, [0.5, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (100, [0.0, 0.0]), (100, [0.25, 0.5]), (1, [1.0, 0.0]), (2, [-3.0]), (None, [1.0, 1.0]), (3, [1e30, 1e-30])]


def test_vector_edges(spark):
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    inner = maxscore.top_inner(v).collect()
    assert {r.query_id for r in inner} == {0, 20, 100}
    first = sorted((r["rank"], r.vec_id, r.score) for r in inner if r.query_id == 0)
    assert first[0][1] == 3 and first[1][1:] == (1, 4096) and first[2][1:] == (20, 4096)
    assert all(r.vec_id != r.query_id for r in inner)
    near = ivfpq.nearest(v, every=20).collect()
    assert {r.query_id for r in near} == {0, 20, 100} and all(r.vec_id not in (40, 50, 60, 80) for r in near)
    assert [r.vec_id for r in sorted(near, key=lambda r: r["rank"]) if r.query_id == 0][:2] == [1, 3]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert maxscore.top_inner(none).collect() == [] and ivfpq.nearest(none).collect() == []


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 8, 12, 30])
def test_few_vectors_are_all_found(spark, n):
    """Every query gets k rows, or all others where there are fewer, whatever lists they lie in."""
    rows = [(k, [math.cos(2.4 * k), math.sin(2.4 * k)]) for k in range(n)] + [(0, [0.1 * k, 1.0]) for k in range(4)]
    near = ivfpq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1).collect()
    count = {k: sum(r.query_id == k for r in near) for k in range(n)}
    asked = {k: len({tuple(r[1]) for r in rows if r[0] == k}) for k in range(n)}
    assert count == {k: asked[k] * min(5, sum(r[0] != k for r in rows)) for k in range(n)}


def test_packed_ids_lie_in_one_piece(spark):
    rows = packing.pack_binary(documents(spark)).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and len(r.ids) == r.length
        assert zlib.crc32(b"".join(int(k).to_bytes(4, "little") for k in r.ids)) == r.ids_crc32
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    one = sorted(by[11], key=lambda r: r.start)
    assert one[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(one, one[1:]))
    assert one[-1].start + one[-1].length == one[0].doc_tokens and one[-1].ids[-1] == packing.END_ID


def test_samples_are_full_whatever_is_alike(spark):
    """Exactly k distinct rows where there are as many, with null keys and with one row ten thousand times."""
    rows = spark.range(300).selectExpr("cast(null as long) as id", "id % 150 as n").unionAll(spark.range(10_000).selectExpr("7L as id", "7L as n"))
    for k in (1, 10, 100, 151, 500):
        got = common.least_hashes(rows, k).to_pylist()
        assert len(got) == min(k, 151) == len({(r["id"], r["n"]) for r in got})
    assert common.least_hashes(rows.limit(0), 5).num_rows == 0


def test_languages_with_null_and_equal_ids(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.lit(None).cast("long").alias("doc_id"), "text", "lang")
    docs = docs.unionAll(docs.limit(1).crossJoin(spark.range(2000)).drop("id"))
    rows = langid.identify(docs, 100).collect()
    assert len(rows) == docs.count() and sum(r.lang_pred == "und" for r in rows) < 0.05 * len(rows)


def test_quality_with_one_id_for_many_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.when(F.col("doc_id") % 3 == 0, 3).otherwise(F.col("doc_id")).alias("doc_id"), "text", "lang", "source")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = cotrain.quality(docs, labels).collect()
    assert len(rows) == docs.count() and len({r.score for r in rows}) > 10


def test_search_with_more_equal_vectors_than_the_sample(spark, monkeypatch):
    monkeypatch.setattr(ivfpq, "SAMPLE", 5)
    rows = [(k, [1.0, 2.0]) for k in range(100)] + [(100 + k, [float(k), 1.0]) for k in range(3)]
    near = ivfpq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1).collect()
    assert {k: sum(r.query_id == k for r in near) for k in range(103)} == dict.fromkeys(range(103), 5)
    assert sorted(r.vec_id for r in near if r.query_id == 0) == [1, 2, 3, 4, 5]


def test_every_vector_of_an_id_is_a_query(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    inner = sorted((r["rank"], r.vec_id, r.score) for r in maxscore.top_inner(v).collect())
    assert inner == [(1, 1, 4096), (1, 2, 8192), (2, 1, 0), (2, 2, 0)]
    near = sorted((r["rank"], r.vec_id, r.score) for r in ivfpq.nearest(v, every=20).collect())
    assert near == [(1, 1, 1.0), (1, 2, 1.0), (2, 1, 0.0), (2, 2, 0.0)]
