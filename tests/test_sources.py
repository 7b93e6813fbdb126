"""Sources, sinks, streams and the plans of requests."""

import datetime
import itertools
import json
import random
import socket
import struct
import threading
import zlib

import pytest
from pyspark.sql import functions as F

from astrolith.functions import maths
from astrolith.operators import boards, engineering, merge, trade
from astrolith.sources import dumps, exchange, journals
from astrolith.sources.live import FrameReader, FrameSource
from astrolith.streaming import feed


def test_journals_go_on_where_they_stopped(spark, tmp_path):
    log = tmp_path / "Journal.2024-01-01T000000.01.log"
    lines = [f'{{"event":"E{k}","x":"{"é" * k}"}}' for k in range(40)]
    log.write_bytes(("\n".join(lines[:25]) + "\n").encode())
    none = spark.createDataFrame([], "file string, next long")
    first, marks = journals.tail(journals.journal_lines(spark, str(tmp_path)), none)
    assert [r.raw for r in first.orderBy("offset").collect()] == lines[:25]
    marks = spark.createDataFrame(marks.collect(), marks.schema)
    log.write_bytes(("\n".join(lines) + "\n").encode())
    rest, marks = journals.tail(journals.journal_lines(spark, str(tmp_path)), marks)
    rows = rest.orderBy("offset").collect()
    assert [r.raw for r in rows] == lines[25:]
    assert all(log.read_bytes()[r.offset :].startswith(r.raw.encode() + b"\n") for r in rows)
    marks = spark.createDataFrame(marks.collect(), marks.schema)
    assert journals.tail(journals.journal_lines(spark, str(tmp_path)), marks)[0].count() == 0
    log.write_bytes(("\n".join(lines[:3]) + "\n").encode())  # written anew
    assert journals.tail(journals.journal_lines(spark, str(tmp_path)), marks)[0].count() == 3


def test_documents_catalogs_and_fixtures(spark, tmp_path):
    docs = spark.createDataFrame([("Cargo", 1, "a"), ("Cargo", 3, "c"), ("Cargo", 2, "b"), ("Market", 1, "m")], "name string, ts long, raw string")
    assert {(r.name, r.raw) for r in journals.latest_documents(docs).collect()} == {("Cargo", "c"), ("Market", "m")}
    (tmp_path / "goods.csv").write_text('ID,Symbol ,name\n1,gold,"Gold, pure"\n')
    assert [tuple(r) for r in journals.catalog(spark, str(tmp_path / "goods.csv")).select("symbol", "name").collect()] == [("gold", "Gold, pure")]
    (tmp_path / "systems.json").write_text(json.dumps({"systems": [{"address": 1, "name": "Sol"}, {"address": 2, "name": "Alpha"}]}, indent=1))
    assert sorted(r.name for r in journals.fixture(spark, str(tmp_path / "systems.json"), "systems").collect()) == ["Alpha", "Sol"]


def test_nightly_stars_and_imported_routes(spark, tmp_path):
    rows = [{"systemId64": 7, "type": "Star", "subType": "Neutron Star", "isMainStar": True, "updateTime": "2024-01-01 00:00:00"}, {"systemId64": 8, "type": "Star", "subType": "M Star", "isMainStar": False}, {"systemId64": 9, "type": "Planet"}]
    (tmp_path / "bodies.json").write_text("[\n" + ",\n".join(json.dumps(r) for r in rows) + "\n]\n")
    assert [(r.address, r.cls) for r in dumps.nightly_stars(spark, str(tmp_path / "bodies.json")).collect()] == [(7, "Neutron")]
    hops = [{"system": "A", "id64": 1, "x": 0, "y": 0, "z": 0, "neutron_star": False}, {"system": "B", "id64": 2, "x": 9, "y": 0, "z": 0, "neutron_star": True, "jumps": 3}]
    (tmp_path / "route.json").write_text(json.dumps({"status": "ok", "result": {"system_jumps": hops}}))
    assert [(r.hop, r.address, r["class"], r.jumps) for r in dumps.imported_hops(spark, str(tmp_path / "route.json")).orderBy("hop").collect()] == [(0, 1, None, 1), (1, 2, "Neutron", 3)]


def test_snapshots_for_exchange(spark, tmp_path):
    path = str(tmp_path / "snap")
    market = spark.createDataFrame([(1, "gold", 5, 20), (1, "tea", 6, 20), (2, "gold", 7, 10)], "station_id long, symbol string, price long, observed_at long")
    marks = market.select("station_id", "observed_at").distinct().unionByName(spark.createDataFrame([(3, 99)], "station_id long, observed_at long"))
    exchange.write_snapshot(spark, path, {"market": market.drop("observed_at"), "watermarks": marks})
    sections = exchange.read_snapshot(spark, path)
    assert sections["market"].count() == 3 and set(sections) == {"market", "watermarks"}
    stored = spark.createDataFrame([(1, "old", 1, 10), (2, "old", 1, 30), (3, "old", 1, 50)], "station_id long, symbol string, price long, observed_at long")
    rows, after = exchange.merge_boards(stored, stored.select("station_id", "observed_at"), sections)
    assert sorted((r.station_id, r.symbol) for r in rows.collect()) == [(1, "gold"), (1, "tea"), (2, "old")]  # 3 is cleared by an empty board
    assert {r.station_id: r.observed_at for r in after.collect()} == {1: 20, 2: 30, 3: 99}
    market.limit(1).drop("observed_at").write.mode("append").parquet(f"{path}/market")
    with pytest.raises(ValueError, match="damaged"):
        exchange.read_snapshot(spark, path)
    encoded, dictionary = exchange.dictionary_encoded(market.withColumn("symbol", F.when(F.col("station_id") == 2, None).otherwise(F.col("symbol"))), "symbol")
    names = {r.id: r.value for r in dictionary.collect()}
    assert names == {0: "gold", 1: "tea"} and sorted((r.symbol is None, r.symbol or 0) for r in encoded.collect()) == [(False, 0), (False, 1), (True, 0)]


def _server(frames, hang=0):
    """Sends frames over two connections, one after the other."""
    listener = socket.create_server(("127.0.0.1", 0))

    def serve():
        for part in (frames[: len(frames) // 2], frames[len(frames) // 2 :]):
            link, _ = listener.accept()
            for f in part:
                link.sendall(struct.pack(">I", len(f)) + f)
            link.close()
        listener.close()

    threading.Thread(target=serve, daemon=True).start()
    return listener.getsockname()[1]


def test_live_frames_survive_a_lost_connection():
    frames = [zlib.compress(json.dumps({"n": k, "pad": "x" * (k * 37 % 900)}).encode()) for k in range(60)]
    reader = FrameReader({"port": str(_server(frames)), "wait": "0.2", "most": "25"})
    at, got = reader.initialOffset(), []
    for _ in range(30):
        rows, at = reader.read(at)
        rows = list(rows)
        assert len(rows) <= 25
        got += rows
        if len(got) == 60:
            break
    assert [n for n, _ in got] == list(range(60)) and [bytes(f) for _, f in got] == frames and at == {"frames": 60}


def test_live_frames_as_a_stream(spark, tmp_path):
    frames = [zlib.compress(json.dumps({"$schemaRef": "https://x/schemas/commodity/3", "header": {}, "message": {"timestamp": "2024-01-01T00:00:00Z", "marketId": k}}).encode()) for k in range(20)]
    spark.dataSource.register(FrameSource)
    stream = spark.readStream.format("frames").option("port", str(_server(frames))).option("wait", "0.3").load()
    seen = feed.Recorder()
    run = stream.writeStream.foreachBatch(seen).option("checkpointLocation", str(tmp_path / "cp")).start()
    import time

    until = time.time() + 60
    while sum(len(rows) for _, rows in seen.batches) < 20 and time.time() < until:
        time.sleep(0.3)
    run.stop()
    rows = sorted((r.seq, bytes(r.frame)) for _, rows in seen.batches for r in rows)
    assert [f for _, f in rows] == frames


def test_failed_batches_are_kept(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))

    def apply(rows, batch):
        raise OSError("down")

    feed.batched_sink(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), apply, str(tmp_path / "cp"), attempts=2, pause=0.01, once=True, dead=str(tmp_path / "dead")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 3


def test_any_split_of_a_feed_gives_one_state(spark):
    """Boards from a feed in batches, whatever their cuts, and from one dump are the same."""
    rng = random.Random(3)
    snaps = [(s, t, [(g, rng.randrange(9)) for g in rng.sample("abcdef", rng.randrange(4))]) for s in range(4) for t in rng.sample(range(100), 6)]
    rng.shuffle(snaps)
    schema, marks_schema = "station_id long, symbol string, price long, observed_at long", "station_id long, observed_at long"

    def fold(cuts):
        rows, marks = [], []
        for a, b in zip([0, *cuts], [*cuts, len(snaps)]):
            part = snaps[a:b]
            incoming = [(s, g, p, t, k) for s, t, goods in part for k, (g, p) in enumerate(goods)]
            out, after = merge.replace_boards(spark.createDataFrame(rows, schema), spark.createDataFrame(marks, marks_schema), spark.createDataFrame(incoming, schema + ", pos int"), spark.createDataFrame([(s, t) for s, t, _ in part], marks_schema))
            rows, marks = [tuple(r) for r in out.select("station_id", "symbol", "price", "observed_at").collect()], [tuple(r) for r in after.collect()]
        return sorted(rows), sorted(marks)

    assert fold([]) == fold([7, 12]) == fold([1, 20])


def test_requests_are_resolved():
    ship = {"cargo": 100, "hull": "asp", "pad": "medium", "range": 30.0, "laden_range": 22.0}
    found, search, limits = trade.plan({"radius": 0, "buy_power": "mine", "stations": 5, "stops": 40}, ship, "Power 1")
    assert (found.cargo, found.empty_range, found.full_range) == (100, 30.0, 22.0) and search.min_pad == "medium" and search.radius == 1.0
    assert limits["buy_power"] == "Power 1" and limits["sell_power"] is None and limits["stations"] == 100 and limits["stops"] == 12
    assert trade.plan({"min_pad": "any", "cargo": 4}, {})[1].min_pad is None
    for request, wrong in (({"buy_power": "mine"}, ship), ({}, {**ship, "cargo": None}), ({}, {**ship, "cargo": 0}), ({}, {"cargo": 1}), ({}, {"cargo": 1, "hull": "new"}), ({"min_pad": "huge"}, ship)):
        with pytest.raises(ValueError):
            trade.plan(request, wrong)
    assert boards.one_of(system="Sol", near=None, name="") == "system"
    with pytest.raises(ValueError):
        boards.one_of(system="Sol", near="x")
    with pytest.raises(ValueError):
        boards.requested(None, [])


def test_results_are_kept_for_a_while():
    now, made = [0.0], []
    cache = trade.ResultCache(60, 2, lambda: now[0])
    get = lambda k: cache.get(k, lambda: made.append(k) or k)
    assert [get("a"), get("b"), get("a")] == ["a", "b", "a"] and made == ["a", "b"]
    now[0] = 59
    get("c")  # the oldest goes
    assert set(cache.held) == {"b", "c"}
    now[0] = 61
    get("b")
    assert made == ["a", "b", "c", "b"]


def test_loops_are_followed(spark):
    at = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k)
    loops = spark.createDataFrame([(1, 0, 10), (1, 1, 20), (1, 2, 30), (2, 0, 5), (2, 1, 6)], "loop long, place int, station_id long")
    visits = spark.createDataFrame([(1, at(k), s) for k, s in enumerate((99, 10, 30, 20, 30, 10, 20))] + [(7, at(1), 10)], "loop long, ts timestamp, station_id long")
    assert {tuple(r) for r in trade.followed_loops(loops, visits).collect()} == {(1, 2, 1, 30), (2, 0, 0, 5)}


def test_names_that_sound_alike(spark):
    heard = spark.createDataFrame([("jameson",), ("Jamesen",), ("xyzzy",)], "heard string")
    names = spark.createDataFrame([("Jameson",), ("Jamison",), ("Daedalus",)], "name string")
    assert {tuple(r) for r in engineering.sounds_like(heard, names).collect()} == {("jameson", "Jameson", 0), ("Jamesen", "Jameson", 1)}


def test_leg_seconds_grow_with_the_way(spark):
    rows = spark.range(1, 50).select(maths.leg_seconds(F.col("id") * 10.0, F.lit(100.0), 20.0).alias("s")).orderBy("s").collect()
    assert all(a.s <= b.s for a, b in itertools.pairwise(rows))
