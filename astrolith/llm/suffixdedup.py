"""Removal of repeated byte strings by suffix sorting.

A first pass finds where a string of ``DEPTH`` bytes could start twice: the least hash of the
GRAM-byte windows in a string (the leftmost, on ties) depends on the string alone, so equal
strings pick equal anchors at equal distances. Only suffixes whose anchor occurs again are
sorted: they meet in the anchor's bucket, which ``suffixes.repeated_starts`` sorts by
difference-cover ranks.

Passages of a number of words go the same way: a text becomes the hashes of its words, eight
bytes each, and only strings that start with a word count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.llm.common import KEY, PASSAGES, SPANS, discard, joined_bytes, materialise, mix, row_key, text_chunks, words_at
from astrolith.llm.shingles import word_hashes
from astrolith.llm.suffixes import repeated_starts

DEPTH = 400
GRAM = 128
#: Words of the shortest passage that counts as repeated: all over 50.
PASSAGE = 51
#: Bytes of a word in the sequences by which passages of words are found.
WORD = 8
STEP_BYTES = 2 << 20
#: Longer texts are cut into segments that overlap by all but a unit of a string; each start lies in one.
SEGMENT = 4 << 20
_LOW = np.uint64((1 << 24) - 1)
_ANCHOR = "uid long, h long, ck long, pos long, a int, b int"


def anchors(data: np.ndarray, segments: list[tuple[int, int]], depth: int = DEPTH, gram: int = GRAM, unit: int = 1) -> tuple[np.ndarray, ...]:
    """Runs (first, last, anchor, hash) of starts in the (begin, end) segments of ``data``
    whose ``depth``-byte strings pick the same anchor. With a ``unit`` of WORD bytes all of it
    lies on whole words, and only they are starts."""
    none = np.zeros(0, np.int64)
    if unit > 1:
        words = np.ascontiguousarray(data).view("<u8").astype(np.uint64)
        found = _anchors(mix(words), 1, [(s // unit, e // unit) for s, e in segments], depth // unit, gram // unit, len(words)) if len(words) >= depth // unit else (none, none, none, none.view(np.uint64))
        return (*(f * unit for f in found[:3]), found[3])
    if len(data) < depth:
        return none, none, none, none.view(np.uint64)
    return _anchors(mix(words_at(np.concatenate([data, np.zeros(7, np.uint8)]))), 8, segments, depth, gram, len(data))


def _anchors(x: np.ndarray, size: int, segments: list[tuple[int, int]], depth: int, gram: int, n: int) -> tuple[np.ndarray, ...]:
    """The same from hashes ``x`` of ``size`` units at every place, all lengths in units."""
    none = np.zeros(0, np.int64)
    while size < gram:
        x = mix(x[:-size] * np.uint64(0x9E3779B97F4A7C15) + x[size:])
        size *= 2
    x = x[: n - gram + 1]
    key = (x & ~_LOW) | (np.arange(len(x), dtype=np.uint64) & _LOW)
    width = depth - gram + 1
    blocks = -(-len(key) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max)
    full[: len(key)] = key
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - depth + 1], ahead[width - 1 : width + n - depth])
    valid = np.zeros(n - depth + 2, np.int8)
    for s, e in segments:
        if e - s >= depth:
            valid[s] += 1
            valid[e - depth + 1] -= 1
    at = np.flatnonzero(np.cumsum(valid)[:-1])
    if not len(at):
        return none, none, none, none.view(np.uint64)
    picked = least[at]
    new = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1]) | (np.diff(at) != 1)]))
    first, last = at[new], at[np.concatenate([new[1:] - 1, [len(at) - 1]])]
    anchor = first + (((picked[new] & _LOW).astype(np.int64) - first) & int(_LOW))
    return first, last, anchor, x[anchor]


def _segments(offsets: np.ndarray, depth: int = DEPTH, unit: int = 1) -> Iterator[tuple[int, int, int]]:
    """(row, begin, end): texts, long ones in overlapping segments."""
    for row, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for b in range(s, max(e, s + 1), SEGMENT):
            yield row, b, min(e, b + SEGMENT + depth - unit)


def _scan(depth: int, unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", STEP_BYTES):
            data, offsets = joined_bytes(batch.column("text"))
            uids = batch.column("uid").to_numpy()
            whole = list(_segments(offsets, depth, unit))
            parts = [whole] if len(data) <= 2 * SEGMENT else [[x] for x in whole]
            for part in parts:
                low, high = part[0][1], part[-1][2]
                piece = data[low:high]
                first, last, anchor, h = anchors(piece, [(s - low, e - low) for _, s, e in part], depth, unit=unit)
                view = memoryview(np.ascontiguousarray(piece))
                reach = (anchor - first).tolist()
                ck = np.fromiter((xxhash.xxh3_64_intdigest(view[f : g + depth], r) for f, g, r in zip(first.tolist(), last.tolist(), reach)), np.uint64, len(first))
                row = np.searchsorted(offsets, first + low, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids[row]), pa.array(h.view(np.int64)), pa.array(ck.view(np.int64)), pa.array(anchor + low - offsets[row]), pa.array((anchor - first).astype(np.int32)), pa.array((anchor - last).astype(np.int32))],
                    names=["uid", "h", "ck", "pos", "a", "b"],
                )

    return run


def _extract(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in text_chunks(batches, "text", STEP_BYTES):
            # of repeated rows, which lie side by side, one is enough
            uids = batch.column("uid").to_numpy()
            fresh = np.concatenate([[uids[0] != last], uids[1:] != uids[:-1]])
            last = uids[-1]
            batch = batch.filter(pa.array(fresh))
            if not batch.num_rows:
                continue
            data, offsets = joined_bytes(batch.column("text"))
            wanted = batch.column("wanted")
            flat = wanted.flatten()
            lengths = np.diff(wanted.offsets.to_numpy()).tolist()
            h, ck, pos, a, b = (flat.field(k).to_numpy() for k in ("h", "ck", "pos", "a", "b"))
            row = np.repeat(np.arange(len(lengths)), lengths)
            begin, end = offsets[row] + pos - a, offsets[row] + pos - b + depth
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(ck), pa.array(a), pa.array(b), pa.array([raw[s:e] for s, e in zip(begin.tolist(), end.tolist())], pa.binary())],
                names=["h", "ck", "a", "b", "context"],
            )

    return run


def _sort_buckets(limit: int, depth: int):
    """Buckets, whole and about ``limit`` bytes at a time, through the suffix sorter."""

    def sort(rows: list[tuple]) -> pa.RecordBatch:
        h = np.array([r[0] for r in rows], np.int64)
        a, b = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
        bucket = np.unique(h, return_inverse=True)[1]
        found = list(repeated_starts(bucket, a, [np.frombuffer(r[4], np.uint8) for r in rows], a - b + 1, depth))
        k = np.array([x[0] for x in found], np.int64)
        first, last = np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found], np.int64)
        ck = np.array([r[1] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h[k]), pa.array(ck[k]), pa.array((a[k] - first).astype(np.int32)), pa.array((a[k] - last).astype(np.int32))], names=["h", "ck", "a2", "b2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("h", "ck", "a", "b", "context"))):
                if held and row[:2] == held[-1][:2]:
                    continue
                if size > limit and row[0] != held[-1][0]:
                    yield sort(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield sort(held)

    return run


def repeated_spans(docs: DataFrame, depth: int = DEPTH, read: Callable = iter, unit: int = 1) -> DataFrame:
    """(uid, spans array<struct<s, e>>): for the rows of ``docs`` (uid, text) that have any, the byte
    ranges of ``depth``-byte strings that start elsewhere too; ranges may overlap. ``read`` may
    turn batches of texts into others, in the worker that scans them, whose strings start at
    multiples of ``unit`` bytes."""
    found = materialise(docs.select("uid", "text").mapInArrow(lambda batches: _scan(depth, unit)(read(batches)), _ANCHOR), "anchors")
    again = materialise(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeats")
    known = materialise(found.join(again, "h"), "known")
    discard(found, again)
    alike = known.groupBy("h", "ck").agg(F.count("*").alias("n"), F.min("uid").alias("uid"))
    alike = materialise(alike, "alike")
    mixed = alike.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h")
    faces = alike.join(mixed, "h").select("h", "ck", "uid")
    # repeated rows have one uid and equal anchors: one of them stands for all
    wanted = known.join(faces, ["h", "ck", "uid"]).groupBy("uid").agg(F.collect_set(F.struct("h", "ck", "pos", "a", "b")).alias("wanted"))
    contexts = docs.select("uid", "text").join(wanted, "uid").select("uid", "text", "wanted").mapInArrow(lambda batches: _extract(depth)(read(batches)), "h long, ck long, a int, b int, context binary")
    runs = contexts.repartition("h").sortWithinPartitions("h", "ck").mapInArrow(_sort_buckets(3 << 19, depth), "h long, ck long, a2 int, b2 int")
    whole = alike.where("n > 1").select("h", "ck", F.lit(None).cast("int").alias("a2"), F.lit(None).cast("int").alias("b2"))
    runs = materialise(whole.unionByName(runs.join(whole.select("h", "ck"), ["h", "ck"], "left_anti")), "runs")
    discard(alike)
    spans = known.join(runs, ["h", "ck"]).select("uid", (F.col("pos") - F.coalesce("a2", "a")).alias("s"), (F.col("pos") - F.coalesce("b2", "b") + depth).alias("e"))
    return spans.groupBy("uid").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _as_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, "text", STEP_BYTES // 2):
        words, bounds = word_hashes(*joined_bytes(batch.column("text")), fold=False)
        texts = [words[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()) if k == "text" else batch.column(k) for k in batch.schema.names], names=batch.schema.names)


def _word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of one text begins and ends, words as in ``word_hashes``."""
    solid = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]]).astype(np.int8)
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _in_bytes(words: int):
    """Ranges over word hashes as ranges of the texts' bytes; starts inside a hash are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", STEP_BYTES):
            data, offsets = joined_bytes(batch.column("text"))
            out = []
            for k, spans in enumerate(batch.column("spans").to_pylist()):
                begin, end = _word_bounds(data[offsets[k] : offsets[k + 1]])
                runs = ((-(-x["s"] // WORD), x["e"] // WORD - words) for x in spans)
                out.append([{"s": int(begin[a]), "e": int(end[b + words - 1])} for a, b in runs if a <= b])
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(out, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], names=["uid", "spans"])

    return run


def repeated_passages(docs: DataFrame, words: int) -> DataFrame:
    """(uid, spans) as of ``repeated_spans``, for passages of ``words`` words and more that start
    elsewhere too, however the space between their words is written. Words are told apart by 64 bits."""
    docs = docs.select("uid", "text")
    found = repeated_spans(docs, words * WORD, _as_words, WORD)
    spans = docs.join(found, "uid").mapInArrow(_in_bytes(words), "uid long, spans array<struct<s: long, e: long>>")
    return spans.dropDuplicates(["uid"])


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges; ranges that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[new], ends[np.concatenate([new[1:] - 1, [len(ends) - 1]])]


def _ranges(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[list[int], list[int]]]:
    """The merged ranges of each row of ``batch`` in the columns ``names`` together."""
    lists = [batch.column(n) for n in names]
    flat = [(x.flatten().field("s").to_numpy(), x.flatten().field("e").to_numpy()) for x in lists]
    ends = [np.cumsum(pc.list_value_length(x).fill_null(0).to_numpy()).tolist() for x in lists]
    begins = [0] * len(lists)
    for row in range(batch.num_rows):
        now = [x[row] for x in ends]
        if now == begins:
            yield [], []
            continue
        s, e = (np.concatenate([f[k][b:n] for f, b, n in zip(flat, begins, now)]) for k in (0, 1))
        begins = now
        a, b = merged(s, e)
        yield a.tolist(), b.tolist()


def _texts(batch: pa.RecordBatch) -> Iterator[memoryview]:
    data, offsets = joined_bytes(batch.column("text"))
    view = memoryview(np.ascontiguousarray(data))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield view[a:b]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, "text", 2 * STEP_BYTES):
        out: list[tuple] = []
        for text, (starts, ends), (first, last) in zip(_texts(batch), _ranges(batch, [SPANS]), _ranges(batch, [PASSAGES])):
            kept, at = hashlib.sha256(), 0
            for a, b in zip(starts, ends):
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            out.append((len(text), sum(ends) - sum(starts), len(starts), kept.hexdigest(), len(first), sum(last) - sum(first)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in zip(*out))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes"])


def _strip(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", 2 * STEP_BYTES):
            texts: list[str] = []
            for text, (starts, ends) in zip(_texts(batch), _ranges(batch, [SPANS, PASSAGES])):
                keep, last = [], 0
                for a, b in zip(starts, ends):
                    while a < b and text[a] & 0xC0 == 0x80:  # a character that begins before the range stays whole
                        a += 1
                    while b < len(text) and b > a and text[b] & 0xC0 == 0x80:
                        b -= 1
                    keep.append(bytes(text[last:a]))
                    last = b
                keep.append(bytes(text[last:]))
                texts.append(b"".join(keep).decode())
            new = pa.array(texts, pa.string())
            new = pc.if_else(batch.column("text").is_valid(), new, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([new if k == "text" else batch.column(k) for k in names], names=names)

    return run


def _with_spans(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with the ranges of their repeated strings and of their repeated passages."""
    keyed = docs.withColumn(KEY, row_key())
    texts = keyed.select(F.col(KEY).alias("uid"), "text")
    spans, passages = repeated_spans(texts), repeated_passages(texts, words)
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    both = spans.select("uid", "spans", none.alias("passages")).unionByName(passages.select("uid", none.alias("spans"), F.col("spans").alias("passages")))
    both = both.groupBy("uid").agg(F.first("spans", True).alias(SPANS), F.first("passages", True).alias(PASSAGES)).where(f"size({SPANS}) > 0 or size({PASSAGES}) > 0")
    return keyed.join(both.withColumnRenamed("uid", KEY), KEY, "left")


def dedup_digest(docs: DataFrame, words: int = PASSAGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_bytes) for each row of ``docs``.

    Removed are the repeated strings of ``DEPTH`` bytes; n_passages counts the maximal runs of text that lie in
    passages of ``words`` words and more that start elsewhere too, n_passage_bytes their bytes.
    A null text is empty; texts under ``DEPTH`` bytes lose nothing; of repeated rows
    all copies lose what repeats, as every copy has its strings elsewhere too. Null ids stay.
    Texts are read whole, long ones in segments.
    """
    both = _with_spans(docs.select("doc_id", "text"), words)
    return both.select("doc_id", "text", SPANS, PASSAGES).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long")


def strip_repeats(docs: DataFrame, words: int = PASSAGE) -> DataFrame:
    """``docs`` with its columns, repeated strings of ``DEPTH`` bytes cut from the texts, and
    repeated passages of ``words`` words and more, which may be shorter. A cut never splits a
    character: one that lies partly outside a range stays. A null text stays null."""
    names = docs.columns
    both = _with_spans(docs, words)
    return both.select(*names, SPANS, PASSAGES).mapInArrow(_strip(names), docs.schema)
