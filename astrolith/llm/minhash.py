"""MinHash near-duplicates: one-permutation hashing with optimal densification,
banded buckets, star-shaped candidate edges, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.llm.common import KEY, joined_bytes, materialise, mix, row_key, text_chunks
from astrolith.llm.components import components
from astrolith.llm.shingles import shingle_sets

BANDS, ROWS = 36, 7
BINS = 256
#: A candidate whose signatures agree this many standard deviations below the threshold is no link.
SIGMAS = 5.5
#: Members of a bucket that one task compares with as many others.
BLOCK = 1024
#: Bytes of text that one step of a Python worker holds.
STEP_BYTES = 2 << 20


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """BINS minima for each non-empty set. The top byte of a hash is its bin; an empty bin
    takes the value of the first non-empty one on a probe sequence that depends on the bin
    alone (optimal densification)."""
    out = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    for k, s in enumerate(sets):
        bins = (s >> np.uint64(56)).astype(np.int64)
        head = np.flatnonzero(np.diff(bins, prepend=-1))
        out[k, bins[head]] = s[head]
        full[k, bins[head]] = True
    row, col = np.nonzero(~full)
    step = np.uint64(0)
    while len(row):
        step += np.uint64(1)
        probe = (mix((col.astype(np.uint64) << step) + step) >> np.uint64(56)).astype(np.int64) if step < 50 else (col + int(step)) % BINS
        hit = full[row, probe]
        out[row[hit], col[hit]] = out[row[hit], probe[hit]]
        row, col = row[~hit], col[~hit]
    return out


def band_keys(signs: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signs), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(signs), band + 1, np.uint64)
        for k in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signs[:, band * ROWS + k])
        keys[:, band] = h
    return keys.view(np.int64)


_SIGNED = "uid long, doc_id long, n_shingles int, cls long, bands array<long>, sketch binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, "text", STEP_BYTES):
        sets = shingle_sets(*joined_bytes(batch.column("text")))
        some = [k for k, s in enumerate(sets) if len(s)]
        signs = signatures([sets[k] for k in some])
        bands: list = [None] * len(sets)
        sketch: list = [None] * len(sets)
        cls = np.zeros(len(sets), np.int64)
        for k, keys, sign in zip(some, band_keys(signs), signs.astype(np.uint8)):
            bands[k], sketch[k] = keys, sign.tobytes()
            cls[k] = np.uint64(xxhash.xxh3_64_intdigest(sets[k].tobytes())).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(cls), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
            names=["uid", "doc_id", "n_shingles", "cls", "bands", "sketch"],
        )


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, base = None, None
        for batch in text_chunks(batches, "text", STEP_BYTES):
            sets = shingle_sets(*joined_bytes(batch.column("text")))
            us, vs = [], []
            for h, m, s in zip(batch.column("hub").to_pylist(), batch.column("member").to_pylist(), sets):
                if m is None:
                    hub, base = h, s
                elif h != hub:
                    raise RuntimeError(f"the text of class {h} is missing")
                elif _linked(base, s, percent):
                    us.append(h)
                    vs.append(m)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def confirmed(edges: DataFrame, texts: DataFrame, percent: int, per_task: int = 512) -> DataFrame:
    """The (u, v) of ``edges`` (hub, member) whose full sets are similar enough. A hub's text
    goes once to each group of about ``per_task`` of its members, so no task gets all
    members of a large star and no text is copied for each edge."""
    wide = edges.groupBy("hub").agg(F.ceil(F.count("*") / per_task).cast("int").alias("salts"))
    member = edges.join(wide, "hub").select("hub", F.expr("cast(pmod(xxhash64(member), salts) as int)").alias("salt"), "member")
    member = member.join(texts.withColumnRenamed("cls", "member"), "member").select("hub", "salt", "member", "text")
    hubs = wide.join(texts.withColumnRenamed("cls", "hub"), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("member"), "text")
    return hubs.unionByName(member).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first()).select("hub", "member", "text").mapInArrow(_confirm(percent), "u long, v long")


def _candidates(rows: list[dict], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, others): for member k of a block the members, by position, of unlike components whose
    sizes and sketches allow a link and that meet it in no earlier band."""
    side = np.array([r["side"] for r in rows])
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    sketch = np.stack([np.frombuffer(r["sketch"], np.uint8) for r in rows])
    bands = np.stack([np.array(r["bands"], np.int64) for r in rows])
    size = np.array([r["n_shingles"] for r in rows], float)
    label = np.array([r["label"] for r in rows], np.int64)
    j = percent / 100
    for k in left.tolist():
        to = right[right > k] if right is left else right
        least, most = np.minimum(size[to], size[k]), np.maximum(size[to], size[k])
        ok = (label[to] != label[k]) & (100 * least >= percent * most)
        to, least = to[ok], least[ok]
        if not len(to):
            continue
        agree = (sketch[to] == sketch[k]).mean(axis=1)
        to = to[agree >= j - SIGMAS * np.sqrt(j * (1 - j) / np.minimum(BINS, least))]
        to = to[(bands[to] == bands[k]).argmax(axis=1) == rows[0]["band"]]
        if len(to):
            yield k, to


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[c] != held[-1][c] for c in ("key", "i", "j")):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _worth_reading(percent: int):
    """The members of each block that have a candidate in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            found: set[int] = set()
            for k, to in _candidates(rows, percent):
                found.add(k)
                found.update(to.tolist())
            if found:
                keep = [rows[k] for k in sorted(found)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in keep], t) for c, t in zip(_BLOCK_NAMES, _BLOCK_TYPES)], names=list(_BLOCK_NAMES))

    return run


_BLOCK_NAMES = ("key", "i", "j", "side", "band", "cls")
_BLOCK_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())


def _link_blocks(percent: int):
    """Confirmed links between components within each block, those left out that only repeat
    what others of the block join already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            texts = pa.array([r["text"] for r in rows], pa.large_string())
            sets = shingle_sets(*joined_bytes(texts))
            parent = {r["label"]: r["label"] for r in rows}

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            us, vs = [], []
            for k, to in _candidates(rows, percent):
                for m in to.tolist():
                    a, b = root(rows[k]["label"]), root(rows[m]["label"])
                    if a != b and _linked(sets[k], sets[m], percent):
                        parent[b] = a
                        us.append(rows[k]["cls"])
                        vs.append(rows[m]["cls"])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(uid, doc_id, n_shingles, component_id, label) per row of ``docs`` (doc_id long, text string).

    Documents of one shingle set form a class. Classes that share a band meet in a bucket,
    whose most central member (largest sum of bucket sizes) is compared with the others. What
    stays in other components of that bucket is compared on sketches, in blocks; members
    that may still have a link there meet once more with their texts, and links are confirmed on full
    sets. A null text has no shingles; a
    document without shingles is a component of its own; null ids never become the
    component's id unless all of its ids are null; repeated rows get equal results. Ids may be null or
    stand in several components; ``label`` (null without shingles) is the component's own. A pair
    at the threshold shares no band with probability (1 - 0.85^7)^36, below 1e-6. Classes are told
    apart by 64 bits.
    """
    docs = docs.select("doc_id", "text", row_key().alias("uid"))
    signed = materialise(docs.select("uid", "doc_id", "text").mapInArrow(_sign, _SIGNED), "signed")
    classes = signed.where("n_shingles > 0").groupBy("cls").agg(F.min("uid").alias("uid"))
    # the smallest uid of a class stands for it; equal rows share it
    faces = materialise(signed.join(classes, ["cls", "uid"]).dropDuplicates(["cls"]).select("cls", "uid", "n_shingles", "bands", "sketch"), "classes")
    banded = faces.select("cls", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    member = materialise(banded.join(shared, "key").select("key", "band", "cls", "size"), "buckets")
    central = member.groupBy("cls").agg(F.sum("size").alias("weight"))
    ranked = member.join(central, "cls")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("weight", "cls")).alias("best")).select("key", F.col("best.cls").alias("hub"))
    sizes = faces.select("cls", "n_shingles")
    edges = member.join(hubs, "key").where("cls <> hub").select("hub", F.col("cls").alias("member")).distinct()
    edges = edges.join(sizes.toDF("hub", "n1"), "hub").join(sizes.toDF("member", "n2"), "member")
    edges = materialise(edges.where(f"100 * least(n1, n2) >= {percent} * greatest(n1, n2)").select("hub", "member"), "stars")

    wanted = faces.join(member.select("cls").distinct(), "cls", "left_semi").select("cls", "uid")
    texts = materialise(docs.select("uid", "text").join(wanted, "uid").dropDuplicates(["cls"]).select("cls", "text"), "texts")
    links = materialise(confirmed(edges, texts, percent), "links")
    first = components(links)

    labelled = member.join(first.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    rest = labelled.join(mixed, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rest = rest.withColumn("own", F.expr("cast(pmod(xxhash64(cls), blocks) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", "band", "cls", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
    traits = faces.select("cls", "n_shingles", "bands", "sketch")
    dealt = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    worth = materialise(dealt(rest.join(traits, "cls")).mapInArrow(_worth_reading(percent), "key long, i int, j int, side int, band int, cls long"), "blocks")
    read = worth.join(traits, "cls").join(texts, "cls").join(first.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    more = materialise(dealt(read).mapInArrow(_link_blocks(percent), "u long, v long"), "links")
    last = components(first.toDF("u", "v").unionAll(more)) if not more.isEmpty() else first

    ids = signed.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    labels = ids.join(last.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    labels = labels.join(labels.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("cls", "component_id", "label")
    # rows without shingles need no join, in which they would all have the same key
    own = signed.where("n_shingles > 0").join(labels, "cls").select("uid", "doc_id", "n_shingles", "component_id", "label")
    return own.unionByName(signed.where("n_shingles = 0").select("uid", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label")))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each group of near-duplicates: the one whose id is the component's, and of
    several such rows one. Documents without words are groups of their own."""
    names = docs.columns
    found = near_duplicates(docs, percent).where("doc_id <=> component_id")
    alone = F.when(F.col("n_shingles") == 0, F.col("uid"))
    keep = found.groupBy("label", alone.alias("alone")).agg(F.min("uid").alias(KEY)).select(KEY)
    kept = docs.withColumn(KEY, row_key()).join(keep, KEY, "left_semi")
    return kept.dropDuplicates([KEY]).select(*names)
