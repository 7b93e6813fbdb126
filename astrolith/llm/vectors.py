"""What both vector searches need: valid rows as matrices, and streams of blocks in which
the rows to search come before the queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolith.llm.common import release

#: Rows that one block of the searched table holds.
SHARD_ROWS = 16_384


def finite(column: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    wrong = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(wrong, F.lit(False))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max(initial=0)) if width is None else width
    if len(flat) == width * len(lengths):
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ok = col < width
    out[row[ok], col[ok]] = flat[ok]
    return out


def widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def search_blocks(key: tuple[str, ...], build: Callable[[pa.Table], object], answer: Callable[[object, pa.Table], Iterator[tuple]], names: list[str], types: list[pa.DataType]):
    """For mapInArrow over rows sorted by key and ``is_query``: ``build`` makes an index of each
    key's rows, ``answer`` yields arrays of the columns ``names`` for batches of its queries."""

    def flush(index, parts):
        found = [x for x in answer(index, pa.concat_tables(parts)) if len(x[-1])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*found), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in (*key, "is_query")]
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if (at := tuple(k[a] for k in keys[:-1])) != now:
                    now, rows, index = at, [], None
                if not keys[-1][a]:
                    rows.append(part)
                elif rows or index is not None:
                    if index is None:
                        index, rows = build(pa.concat_tables(rows)), []
                    yield from flush(index, [part])
        release()

    return run


def best(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best rows of all blocks, ranked from 1; ties go to the smaller id. ``query`` tells
    apart the queries of one id."""
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
