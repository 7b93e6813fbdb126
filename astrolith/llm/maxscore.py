"""Exact top-k by integer inner product with MaxScore.

A query's terms are its dimensions, and a shard's list for a term holds the values of its rows
there. With the terms in order of their score bounds, a suffix whose bounds cannot lift any
row to the threshold is non-essential: rows are scored on the essential lists first, and
the others are probed, a few terms at a time, only for rows that may still compete.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.llm.vectors import SHARD_ROWS, best, finite, matrix, search_blocks, widened

SCALE = 64
#: Rows of a shard whose postings are traversed together, and terms that are probed together.
STRIDE, PROBE = 2048, 8
#: Queries that one task searches a shard for.
QUERY_ROWS = 512
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class Shard:
    """Postings of one block of rows: a list of values for each dimension, rows in order of id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.lists = np.ascontiguousarray(values[order].T)
        self.high = self.lists.max(axis=1, initial=-np.inf) if self.lists.size else np.zeros(len(self.lists))
        self.low = self.lists.min(axis=1, initial=np.inf) if self.lists.size else np.zeros(len(self.lists))
        self.widest = float(np.abs(self.lists).max(initial=0))

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, list]:
        """Ids and scores of the k best rows but the query's own."""
        if self.widest * float(np.abs(query).max(initial=0)) * max(len(query), 1) >= 2**53:
            return self._wide(own, query, k)
        bound = np.maximum(query * self.high, query * self.low)
        terms = np.argsort(-bound, kind="stable")
        rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0.0]])  # bound of the terms from k on
        weights = query[terms]
        ids, scores, threshold = np.zeros(0, np.int64), np.zeros(0), -np.inf
        for a in range(0, len(self.ids), STRIDE):
            rows = np.arange(a, min(a + STRIDE, len(self.ids)))
            rows = rows[self.ids[rows] != own]
            # essential terms: without them no row reaches the threshold
            n = int(np.argmax(rest < threshold)) if (rest < threshold).any() else len(terms)
            n = max(n, min(PROBE, len(terms)))
            partial = weights[:n] @ self.lists[terms[:n], a : a + STRIDE][:, rows - a] if len(rows) else np.zeros(0)
            while True:
                keep = partial + rest[n] >= threshold
                rows, partial = rows[keep], partial[keep]
                if n == len(terms) or not len(rows):
                    break
                m = min(n + PROBE, len(terms))
                partial = partial + weights[n:m] @ self.lists[np.ix_(terms[n:m], rows)]
                n = m
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, partial])
            if len(ids) > k:
                order = np.lexsort([ids, -scores])[:k]
                ids, scores = ids[order], scores[order]
            if len(ids) == k:
                threshold = scores.min()
        return ids, scores.astype(np.int64).tolist()

    def _wide(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, list]:
        """The same for values whose products leave the exact range of doubles."""
        weights = [int(x) for x in query]
        rows = np.flatnonzero(self.ids != own)
        scores = [sum(w * int(x) for w, x in zip(weights, self.lists[:, r])) for r in rows]
        order = sorted(range(len(rows)), key=lambda x: (-scores[x], self.ids[rows[x]]))[:k]
        return self.ids[rows[order]], [min(max(scores[x], _LEAST), _MOST) for x in order]


def _build(table: pa.Table) -> Shard:
    values = matrix(table.column("v").combine_chunks())
    return Shard(table.column("vec_id").to_numpy(), np.floor(SCALE * values))


def _answer(k: int):
    def run(shard: Shard, table: pa.Table) -> Iterator[tuple]:
        width = len(shard.lists)
        queries = np.floor(SCALE * matrix(table.column("v").combine_chunks()))
        queries = widened(queries, max(width, queries.shape[1]))[:, : max(width, 1)]
        for own, name, query in zip(table.column("vec_id").to_pylist(), table.column("query").to_pylist(), queries):
            ids, scores = shard.top(own, query[:width], k)
            yield np.full(len(ids), name), np.full(len(ids), own), ids, np.array(scores, np.int64)

    return run


def top_inner(vectors: DataFrame, every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows of ``vectors`` (vec_id,
    embedding) by the inner product of floor(64 x).

    Vectors that are null or hold null or non-finite components take no part, nor do rows
    without an id. Shorter vectors count as filled up with zeros. Of rows with one id each is a
    candidate, for all queries but those of its id, and each different vector is a query.
    Every shard meets the queries in blocks, each pair of them in its own group of rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & finite("embedding")).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("query", F.xxhash64("vec_id", "v"))
    asked = F.col("vec_id") % every == 0
    size = rows.agg(F.count("*").alias("rows"), F.count_if(asked).alias("queries")).first()
    shards, blocks = max(1, -(-size.rows // shard_rows)), max(1, -(-size.queries // query_rows))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod("query", F.lit(n)).cast("int")
    searched = rows.withColumn("shard", part(shards)).withColumn("block", each(blocks)).withColumn("is_query", F.lit(False))
    queries = rows.where(asked).dropDuplicates(["vec_id", "query"]).withColumn("block", part(blocks)).withColumn("shard", each(shards)).withColumn("is_query", F.lit(True))
    columns = ["shard", "block", "is_query", "vec_id", "query", "v"]
    tasks = max(shards * blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = searched.select(columns).unionAll(queries.select(columns)).repartition(tasks, "shard", "block").sortWithinPartitions("shard", "block", "is_query", "vec_id")
    run = search_blocks(("shard", "block"), _build, _answer(k), ["query", "query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.int64()])
    return best(both.mapInArrow(run, "query long, query_id long, vec_id long, score long"), k)
