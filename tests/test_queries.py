"""Every registered query against its SQL in DuckDB, and the operators that SQL cannot say against
plain versions."""

import collections
import datetime
import itertools
import json
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolith import registry
from astrolith.operators import combat, graph, journal, merge, spatial, trade
from astrolith.sources import dumps, journals, published
from astrolith.streaming import feed

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(medium):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{medium}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return (int(v) if v == int(v) else float(v)) if type(v).__name__ == "Decimal" else v


def _sorted(names, rows):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(_plain(r[k]) for k in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, medium, duck, name):
    got = registry.queries()[name](spark, medium)
    want = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = got.collect()
    assert rows and _sorted(got.columns, rows) == _sorted(names, want.fetchall())


@pytest.mark.parametrize("name", ["trade_legs", "market_sell", "market_buy_near", "graph_hops", "systems_within", "stations_with_service", "outfitting_search"])
def test_headline_queries_find_something(spark, small, medium, name):
    assert registry.queries()[name](spark, medium).count() >= (10 if name == "stations_with_service" else 20)
    assert name in ("graph_hops", "systems_within") or registry.queries()[name](spark, small).count() > 0


def _cloud(n, seed=1, size=60.0):
    rng = random.Random(seed)
    return [(k, rng.uniform(0, size), rng.uniform(0, size), rng.uniform(0, size)) for k in range(n)]


def _gap(a, b):
    return math.dist(a[1:4], b[1:4])


def test_shortest_paths_and_landmarks(spark):
    points = _cloud(120)
    links = graph.edges(spark.createDataFrame(points, "address long, x double, y double, z double"), 16.0)
    near = {(a[0], b[0]): _gap(a, b) for a, b in itertools.permutations(points, 2) if _gap(a, b) <= 16.0}
    assert {(r.src, r.dst) for r in links.collect()} == set(near)
    cost = {k: {k: 0.0} for k in range(120)}
    for s in (0, 5):
        dist = dict.fromkeys(range(120), math.inf) | {s: 0.0}
        for _ in range(120):
            for (a, b), w in near.items():
                dist[b] = min(dist[b], dist[a] + w)
        cost[s] = dist
    got = {r.node: r.cost for r in graph.shortest(links, spark.createDataFrame([(0,)], "node long"), "distance_ly").collect()}
    assert all(math.isclose(got.get(k, math.inf), v, abs_tol=1e-9) or (k not in got and v == math.inf) for k, v in cost[0].items())
    bounds = {r.node: r.bound for r in graph.landmark_bound(graph.landmarks(links, 0, 2), 5).collect()}
    assert all(b <= cost[5][n] + 1e-9 for n, b in bounds.items())


def test_routes_take_the_fewest_jumps():
    import pandas as pd

    points = _cloud(60, 2)
    frame = pd.DataFrame(points, columns=["address", "x", "y", "z"])
    near = {a[0]: [b[0] for b in points if b is not a and _gap(a, b) <= 22.0] for a in points}
    for goal in range(1, 60, 7):
        seen, front, hops = {0}, [0], 0
        while front and goal not in seen:
            front = [n for k in front for n in near[k] if n not in seen and not seen.add(n)]
            hops += 1
        path = graph.solve_route(frame, 0, goal, graph.Hop(22.0, fanout=60))
        assert (path is None) == (goal not in seen)
        if path:
            assert len(path) - 1 == hops and all(b in near[a] for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("count,seed,reach", [(60, 2, 22.0), (90, 5, 14.0), (400, 7, 14.0)])
def test_fewest_jumps_take_the_shortest_way_of_all_neighbours(count, seed, reach):
    xyz = np.array([p[1:] for p in _cloud(count, seed)], float)
    gaps = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    for goal in range(1, count, 7):
        cost, jumps = np.where(np.arange(count) == 0, 0.0, np.inf), 0
        while cost[goal] == np.inf and jumps < count:
            cost, jumps = np.where(gaps <= reach, cost[:, None] + gaps, np.inf).min(axis=0), jumps + 1
        path = graph.fewest_jumps(xyz, 0, goal, reach)
        assert (path is None) == (cost[goal] == np.inf)
        if path:
            assert len(path) == jumps + 1 and (path[0], path[-1]) == (0, goal) and math.isclose(sum(gaps[a, b] for a, b in zip(path, path[1:])), cost[goal])


def test_requests_of_near_ends_share_their_stars(spark):
    points = spark.createDataFrame(_cloud(300, 3), "address long, x double, y double, z double")
    ends = points.where("address < 40").select(F.col("address").alias("request"), F.col("address").alias("start"), (F.col("address") + 40).alias("goal"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    requests = ends.join(points.toDF("goal", "bx", "by", "bz"), "goal")
    found = graph.routes(points, requests, graph.Hop(20.0), 30.0)
    assert found.count() == 40 and "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().toString()


def test_fuel_plans():
    assert graph.refuel_stops([4, 4, 4], [True, False, True, True], 9.0, 1.0) == ([2], True)
    assert graph.refuel_stops([4, 4, 4], [False] * 4, 9.0, 1.0) == ([], False)
    used, added, enough = graph.carrier_ledger([500.0] * 3, 200.0, 100.0)
    assert used == [68, 68, 68] and added == 200.0 and enough


def test_tours_of_few_stops_are_best():
    for n in range(1, 8):
        points = [p[1:] for p in _cloud(n, n)]
        length = lambda path: sum(math.dist(points[a], points[b]) for a, b in zip(path, path[1:]))  # noqa: B023,E731
        best = min(length((0, *p)) for p in itertools.permutations(range(1, n)))
        assert math.isclose(length(graph.tour(points)), best)
    assert sorted(graph.tour([p[1:] for p in _cloud(25, 9)])) == list(range(25))


def test_cover_is_greedy(spark):
    jobs = [(1, "b", 1), (1, "b", 2), (1, "a", 2), (1, "a", 3), (1, "c", 3), (1, None, 9)]
    rows = graph.cover(spark.createDataFrame(jobs, "plan long, engineer string, job long")).orderBy("step").collect()
    assert [(r.engineer, r.jobs) for r in rows] == [("a", [2, 3]), ("b", [1]), (None, [9])]


def test_rings_close_and_count_once(spark):
    legs = [(a, b, "g", 10, 100 + a + b, 10.0, 600.0, 600.0 * (a + b), 1.0) for a, b in itertools.permutations(range(1, 5), 2)]
    frame = spark.createDataFrame(legs, "from_id long, to_id long, symbol string, tons long, profit long, distance_ly double, seconds double, per_hour double, per_hour_repeat double")
    rings = trade.rings(frame, 3, fanout=3).collect()
    assert len({tuple(sorted(r.path)) for r in rings}) == len(rings) == 10
    assert all(r.path[0] == min(r.path) for r in rings)


def _boards(spark, stations, goods):
    """Places (id, x, y, z, arrival_ls) and boards (station_id, symbol, buy_price, sell_price, supply, demand)."""
    return spark.createDataFrame(stations, "id long, x double, y double, z double, arrival_ls double"), spark.createDataFrame(goods, "station_id long, symbol string, buy_price long, sell_price long, supply long, demand long")


def test_report_has_all_round_trips_of_its_source(spark):
    stations = [(k, float(k), 0.0, 0.0, None) for k in range(62)]
    goods = [(k, good, buy, sell, 10, 10) for k in range(62) for good, buy, sell in (("out", 100, 150 if k else 0), ("back", 100 if k else 0, 150 if not k else 0))]
    trips = trade.report(*_boards(spark, stations, goods), trade.maths.Ship(), 100.0, (0.0, 0.0, 0.0), 0).round_trips.collect()
    assert sorted((r.from_id, r.to_id) for r in trips) == [(0, k) for k in range(1, 62)]


def _plain_legs(stations, goods, reach, hold):
    legs = {}
    for f, t in itertools.permutations(stations, 2):
        if math.dist(f[1:4], t[1:4]) <= reach:
            offers = [(s[3] - b[2], b[1], min(b[4], s[5])) for b in goods for s in goods if (b[0], s[0]) == (f[0], t[0]) and b[1] == s[1] and min(b[2], b[4], s[5]) > 0 and s[3] > b[2]]
            left, tons, profit = hold, 0, 0
            for gain, _, amount in (best := sorted(offers, key=lambda o: (-o[0], o[1]))[:4]):
                own = max(0, min(amount, left))
                left, tons, profit = left - amount, tons + own, profit + own * gain
            if best:
                legs[f[0], t[0]] = (best[0][1], tons, profit)
    return legs


def _random_boards(seed, far=40.0):
    rng = random.Random(seed)
    stations = [(k, *(rng.uniform(-far, far) for _ in "xyz"), rng.choice([None, 100.0])) for k in range(40)]
    goods = [(k, f"g{n}", rng.choice([0, 90, 100, 110]), rng.choice([0, 95, 105, 120]), rng.choice([0, 20, 90]), rng.choice([0, 30, 200])) for k in range(40) for n in rng.choices(range(12), k=8)]
    return stations, goods


def test_legs_are_those_of_all_pairs_and_no_rows_of_goods_are_shuffled(spark):
    stations, goods = _random_boards(1)
    legs = trade.best_legs(*_boards(spark, stations, goods), trade.maths.Ship(), 30.0)
    assert "Window" not in legs._jdf.queryExecution().toString()
    want = _plain_legs(stations, goods, 30.0, 200)
    got = {(r.from_id, r.to_id): (r.symbol, r.tons, r.profit) for r in legs.collect()}
    assert set(got) == set(want) and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    one = {(good[0], good[1]) for good in goods if sum(o[:2] == good[:2] for o in goods) > 1}  # offers of one good at one price stand in any order
    assert all(got[k] == want[k] for k in want if not any(s in k for s, _ in one)) and len(want) > 100


LEGS = "from_id long, to_id long, symbol string, tons long, profit long, distance_ly double, seconds double, per_hour double, per_hour_repeat double"


def test_rings_without_a_beam_are_whole(spark):
    pairs = [(a, b) for k in range(0, 1000, 2) for a, b in ((k, k + 1), (k + 1, k))]
    frame = spark.createDataFrame([(a, b, "g", 10, 100 + a, 10.0, 600.0, 600.0 * (100 + a), 1.0) for a, b in pairs], LEGS)
    assert trade.rings(frame, 4, beam=None).count() == 500


def test_rings_of_equal_rates_go_by_profit_and_then_backwards(spark):
    legs = [(1, 2, 100, 100.0), (2, 3, 100, 100.0), (3, 1, 100, 100.0), (1, 3, 100, 100.0), (3, 2, 100, 100.0), (2, 1, 100, 100.0)]
    more = [(4, 5, 100, 100.0), (5, 6, 100, 100.0), (6, 4, 100, 100.0), (4, 6, 200, 200.00001), (6, 5, 200, 200.0), (5, 4, 200, 200.0)]
    frame = spark.createDataFrame([(a, b, "g", 10, p, 10.0, s, p / (s / 3600.0), 1.0) for a, b, p, s in legs + more], LEGS)
    best = {tuple(r.stations): tuple(r.path) for r in trade.rings(frame, 3, beam=None).collect() if len(r.stations) == 3}
    # 1 3 2 turned to 2 1 3 reads 3 1 2 backwards, 1 2 3 reads 3 2 1; of 4 5 6 the way of more profit wins at a rate equal to a thousandth
    assert best == {(1, 2, 3): (1, 2, 3), (4, 5, 6): (4, 6, 5)}


def test_rings_turned_come_from_all_rings(spark):
    pairs = [(a, b) for k in range(0, 600, 2) for a, b in ((k, k + 1), (k + 1, k))]
    rings = trade.rings(spark.createDataFrame([(a, b, "g", 10, 100 + a, 10.0, 600.0, 600.0 * (100 + a), 1.0) for a, b in pairs], LEGS), 4, beam=None)
    places = spark.createDataFrame([(k, float(-k), 0.0, 0.0) for k in range(600)], "id long, x double, y double, z double")
    got = sorted(tuple(r.path) for r in trade.rotated(rings, places, (-600.0, 0.0, 0.0)).collect())
    assert got == [(k + 1, k) for k in range(0, 600, 2)]


def test_legs_of_few_sources_are_diversified_by_source_and_good(spark):
    stations, goods = _random_boards(2)
    legs = trade.best_legs(*_boards(spark, stations, goods), trade.maths.Ship(), 30.0)
    every, few = legs.collect(), trade.diversify(legs).collect()
    count = lambda rows: collections.Counter((r.from_id, r.symbol) for r in rows)
    assert count(few) == {k: min(3, n) for k, n in count(every).items()}
    assert "cartesian" not in (plan := trade.diversify(legs)._jdf.queryExecution().toString()).lower() and "FlatMapCoGroupsInArrow" in plan


def test_reports_of_one_source_hold_its_legs(spark):
    ship, boards = trade.maths.Ship(), _boards(spark, *_random_boards(5))
    every = trade.best_legs(*boards, ship, 30.0)
    legs = trade.best_legs(*boards, ship, 30.0, source=7).collect()
    assert legs and {tuple(r) for r in legs} == {tuple(r) for r in every.where("from_id = 7").collect()}
    assert {(r.from_id, r.to_id) for r in trade.best_legs(*boards, ship, 30.0, per_pair=1).collect()} == {(r.from_id, r.to_id) for r in every.collect()}


def test_trips_found_in_one_place_are_the_opposite_legs(spark):
    ship, boards = trade.maths.Ship(), _boards(spark, *_random_boards(4))
    want = {tuple(r) for r in trade.round_trips(trade.best_legs(*boards, ship, 30.0)).collect()}
    assert want and {tuple(r) for r in trade.best_trips(*boards, ship, 30.0).collect()} == want
    assert {tuple(r) for r in trade.best_trips(*boards, ship, 30.0, source=20).collect()} == {t for t in want if 20 in t[:2]}


def test_top_pairs_come_out_of_boards_that_meet_whole(spark):
    stations, goods = _random_boards(3)
    legs = trade.best_legs(*_boards(spark, stations, goods), trade.maths.Ship(), 30.0)
    top = trade.top_pairs(legs, "per_hour", 25)
    want = sorted(((-r.per_hour, r.from_id, r.to_id) for r in legs.collect()))[:25]
    assert [(-r.per_hour, r.from_id, r.to_id) for r in top.collect()] == want
    assert "FlatMapCoGroupsInArrow" in top._jdf.queryExecution().toString()


@pytest.mark.parametrize("parts", [8192, 2])
def test_best_legs_of_sources_are_kept_where_they_are_found(spark, monkeypatch, parts):
    monkeypatch.setattr(trade.legs, "TARGETS", parts)  # with few: a source's legs are found in several places
    ship, boards = trade.maths.Ship(), _boards(spark, *_random_boards(6))
    every = trade.best_legs(*boards, ship, 30.0)
    want, few = {tuple(r) for r in trade.diversify(every, 2).collect()}, trade.best_diversified(*boards, ship, 30.0, 2)
    assert want and {tuple(r) for r in few.drop("__rank").collect()} == want and len(want) < every.count()
    plan = few._jdf.queryExecution().toString()
    assert parts == 2 or "Window" not in plan and "SortMergeJoin" not in plan


def test_rings_of_whole_holds(spark):
    """Holds of 200 t take ten goods of 20 t each; the best legs of each station are kept where they are found."""
    stations = [(k, float(k), 0.0, 0.0, None) for k in range(3)]
    goods = [(k, f"{k}-{n:02}", 100, 0, 20, 0) for k in range(3) for n in range(15)] + [(k, f"{m}-{n:02}", 0, 200 - n, 0, 20) for k in range(3) for m in range(3) if m != k for n in range(15)]
    boards, ship = _boards(spark, stations, goods), trade.maths.Ship()
    leg = sum(20 * (100 - n) for n in range(10))
    legs = trade.best_legs(*boards, ship, 30.0, per_pair=None).collect()
    assert len(legs) == 6 and {(r.tons, r.profit) for r in legs} == {(200, leg)}
    rings = {tuple(r.stations): r.profit for r in trade.best_rings(*boards, ship, 30.0, 3).collect()}
    assert rings == {(0, 1): 2 * leg, (0, 2): 2 * leg, (1, 2): 2 * leg, (0, 1, 2): 3 * leg}


@pytest.mark.parametrize("parts,fanout", [(8192, 6), (2, 3)])
def test_rings_out_of_legs_that_are_kept_where_they_are_found(spark, monkeypatch, parts, fanout):
    monkeypatch.setattr(trade.legs, "TARGETS", parts)
    ship, boards = trade.maths.Ship(cargo=600), _boards(spark, *_random_boards(9))
    every = trade.best_legs(*boards, ship, 30.0, per_pair=None)
    whole, most, few = ({tuple(r) for r in df.collect()} for df in (every, *(trade.best_legs(*boards, ship, 30.0, per_pair=n) for n in (100, 4))))
    assert whole == most != few and len(whole) == len(few)
    want = {tuple(map(str, r)) for r in trade.rings(every, 4, fanout, beam=None).collect()}
    assert want and {tuple(map(str, r)) for r in trade.best_rings(*boards, ship, 30.0, 4, fanout).collect()} == want


def test_top_pairs_are_kept_where_they_are_found(spark):
    ship, boards = trade.maths.Ship(), _boards(spark, *_random_boards(7))
    every = trade.best_legs(*boards, ship, 30.0).withColumn("per_hour", F.round("per_hour", 3))
    want = trade.top_pairs(every, "per_hour", 25).collect()
    assert len(want) == 25 and trade.best_pairs(*boards, ship, 30.0, 25).collect() == want


def test_boards_are_dealt_one_side_each(spark):
    packed = trade.legs.boards(*_boards(spark, *_random_boards(8)), 30.0)
    left, right, _ = trade.legs.dealt(packed, packed, ["id", "x", "y", "z", "asks", "pays"], sides=("asks", "pays"))
    assert "pays" not in left.columns and "asks" not in right.columns
    plain = b"".join(n.tobytes() for n in (np.arange(300) + 900, np.arange(300) % 50 + 1))
    names = [f"c{k}".encode() for k in range(300)]
    blob = trade.legs._packed(names, [np.arange(300) + 900, np.arange(300) % 50 + 1])
    lengths, text, price, amount = trade.legs._unpacked(blob)
    assert len(blob) < len(plain) / 4 and sorted(price.tolist()) == list(range(900, 1200)) and lengths.sum() == len(text) and amount.max() == 50


def _cells_by_hand(points, size, reach):
    best = {}
    for a, b in itertools.combinations(points, 2):
        one, two = ("/".join(str(math.floor(v / size)) for v in p[1:]) for p in (a, b))
        if one != two and (gap := _gap(a, b)) <= reach:
            best[one, two] = best[two, one] = min(gap, best.get((one, two), math.inf))
    return best


@pytest.mark.parametrize("count,size,reach", [(700, 20.0, 20.0), (60, 8.0, 20.0)])
def test_cells_are_linked_by_their_nearest_points_without_rows_of_pairs(spark, count, size, reach):
    points = [(k, x - 30.0, y - 30.0, z) for k, x, y, z in _cloud(count, count)]
    cells, links = graph.cell_graph(spark.createDataFrame(points, "address long, x double, y double, z double"), size, reach)
    assert "FlatMapCoGroupsInArrow" in links._jdf.queryExecution().toString()
    want, got = _cells_by_hand(points, size, reach), {(r.src, r.dst): r.distance_ly for r in links.collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert sum(r.points for r in cells.collect()) == count


def test_goal_fields_of_nearest_points(spark):
    points = _cloud(200, 12)
    links = graph.cell_graph(spark.createDataFrame(points, "address long, x double, y double, z double"), 15.0, 15.0)[1]
    assert "FlatMapCoGroupsInArrow" in links._jdf.queryExecution().toString()
    ways, goal = _cells_by_hand(points, 15.0, 15.0), "0/0/0"
    cost = {goal: 0.0}
    for _ in range(80):
        for (a, b), ly in ways.items():
            cost[a] = min(cost.get(a, math.inf), cost.get(b, math.inf) + ly)
    want = {k: v for k, v in cost.items() if v < math.inf}
    got = {r.node: r.cost for r in graph.goal_field(links, goal).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items())


def test_goal_fields_take_rounds_by_blocks_not_by_links(spark, monkeypatch):
    rng, rounds = random.Random(5), []
    cells = [(x, y, rng.choice((0, 1))) for x in range(-30, 31) for y in range(-2, 3)]
    ways = {(a, b): rng.uniform(1.0, 9.0) for a in cells for b in cells if a != b and max(abs(p - q) for p, q in zip(a, b)) <= 1 and rng.random() < 0.6}
    name = lambda c: "/".join(map(str, c))
    links = spark.createDataFrame([(name(a), name(b), ly) for (a, b), ly in ways.items()] + [("far", name(cells[0]), 2.0), ("lone", "other", 1.0)], "src string, dst string, distance_ly double")
    goal, near = name(cells[-1]), collections.defaultdict(list)
    for r in links.collect():
        near[r.dst].append((r.src, r.distance_ly))
    want, front = {goal: 0.0}, [goal]
    while front:
        at = front.pop()
        for other, ly in near[at]:
            if want[at] + ly < want.get(other, math.inf):
                want[other] = want[at] + ly
                front.append(other)
    monkeypatch.setattr(graph, "settled", lambda df, f=graph.settled: rounds.append(1) or f(df))
    got = {r.node: r.cost for r in graph.goal_field(links, goal).collect()}
    assert got == want and len(got) > 200 and "far" in got
    assert len(rounds) < 20  # 60 cells from end to end: once a round for each link of a way


@pytest.mark.parametrize("count,reach,size", [(300, 9.0, 100.0), (300, 14.0, 100.0), (400, 3.0, 20.0), (40, 30.0, 400.0)])
def test_components_of_points_need_no_links(spark, count, reach, size):
    points = [(k, x - size / 2, y - size / 2, z) for k, x, y, z in _cloud(count, count, size)] + [(0, 5 * size, 0.0, 0.0), (count, 5 * size, 0.0, reach), (count + 1, None, None, None)]
    near = {k: {k} for k in range(count + 2)}
    for a, b in itertools.combinations(points[:-1], 2):
        if a[0] != b[0] and _gap(a, b) <= reach:
            near[a[0]].add(b[0]), near[b[0]].add(a[0])
    label = {k: k for k in near}
    for _ in near:
        label = {k: min(label[n] for n in near[k]) for k in near}
    got = graph.point_components(spark.createDataFrame(points, "address long, x double, y double, z double"), reach).collect()
    assert len(got) == count + 2 and {r.node: r.label for r in got} == label


@pytest.mark.parametrize("seed,reach", [(21, 8.0), (22, 10.0), (23, 12.0)])
def test_injections_between_points_need_no_links(spark, seed, reach):
    points = _cloud(150, seed, 100.0) + [(-5, 900.0, 0.0, 0.0)]
    frame = spark.createDataFrame(points, "address long, x double, y double, z double")
    links = {(a[0], b[0]): _gap(a, b) for a, b in itertools.permutations(points, 2) if _gap(a, b) <= 2 * reach}
    start = min(a for a, _ in links)
    assert graph.first_linked(frame, 2 * reach) == start
    least = {start: 0}
    for _ in points:
        for (a, b), ly in links.items():
            if a in least and least[a] + (ly > reach) <= 3:
                least[b] = min(least.get(b, 9), least[a] + (ly > reach))
    got = graph.point_injections(frame, start, reach, 3).collect()
    assert {r.node: r.injections for r in got} == least and len(got) == len(least)


def test_missions_fold(spark):
    t = lambda k: datetime.datetime(2024, 1, k)
    rows = [
        (1, t(1), "f", 1, 10, "accepted", t(20), None), (1, t(2), "f", 2, 11, "accepted", t(3), None), (1, t(3), "f", 3, 12, "accepted", t(20), None), (1, t(4), "f", 4, 13, "accepted", t(20), None),
        (1, t(5), "f", 5, 10, "completed", None, None), (1, t(6), "f", 6, None, "listed", None, [11, 13]),
    ]
    frame = spark.createDataFrame(rows, "commander long, ts timestamp, file string, offset long, mission long, status string, expiry timestamp, open_missions array<long>")
    assert {r.mission: r.status for r in combat.missions(frame).collect()} == {10: "completed", 11: "expired", 12: "completed", 13: "accepted"}


def test_inventory_equals_a_loop(spark):
    rng = random.Random(3)
    rows = [(k % 3, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k), "f", k, rng.choice(["add", "add", "use", "use", "reset"]), rng.randrange(9)) for k in range(300)]
    stock = {}
    for c, _, _, _, e, n in rows:
        stock[c] = n if e == "reset" else max(0, stock.get(c, 0) + (n if e == "add" else -n))
    frame = spark.createDataFrame(rows, "commander long, ts timestamp, file string, offset long, event string, n long")
    delta = F.when(F.col("event") == "use", -F.col("n")).otherwise(F.col("n"))
    got = journal.clamped_inventory(frame, delta, F.col("event") == "reset", ("commander",))
    assert {r.commander: r.stock for r in got.collect()} == stock


def test_repeat_gate(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, "danger", "x", at(s), "f", s) for s in (0, 10, 29, 30, 50, 70)]
    out = journal.suppressed_repeats(spark.createDataFrame(rows, "commander long, kind string, text string, ts timestamp, file string, offset long"), F.lit(30.0))
    assert [(r.ts, r.suppressed) for r in out.orderBy("ts").collect()] == [(at(0), 0), (at(30), 2), (at(70), 1)]


def test_boards_replace_as_wholes(spark):
    stored = spark.createDataFrame([(1, "a", 5, 10), (1, "b", 5, 10), (2, "a", 5, 10)], "station_id long, symbol string, price long, observed_at long")
    marks = spark.createDataFrame([(1, 10), (2, 10), (3, 4)], "station_id long, observed_at long")
    incoming = spark.createDataFrame([(1, "a", 6, 11, 0), (1, "a", 7, 11, 1), (2, "z", 9, 10, 0)], "station_id long, symbol string, price long, observed_at long, pos long")
    arrivals = spark.createDataFrame([(1, 11), (2, 10), (3, 5)], "station_id long, observed_at long")
    rows, after = merge.replace_boards(stored, marks, incoming, arrivals)
    assert sorted((r.station_id, r.symbol, r.price) for r in rows.collect()) == [(1, "a", 7), (2, "a", 5)]
    assert {r.station_id: r.observed_at for r in after.collect()} == {1: 11, 2: 10, 3: 5}


def test_dump_reading(spark, tmp_path):
    import gzip

    one = {"id64": 1, "name": "Sol", "coords": {"x": 0, "y": 0, "z": 0}, "date": "2024-01-01 00:00:00+00", "stations": [{"id": 7, "name": "Hub", "type": "Coriolis", "updateTime": "2024-01-02 00:00:00+00", "market": {"commodities": [{"symbol": "Gold", "buyPrice": 1}], "updateTime": "2024-01-03 00:00:00+00"}}],
           "bodies": [{"id64": 11, "name": "Sol A", "type": "Star", "subType": "G (White-Yellow) Star", "mainStar": True, "updateTime": "2024-01-01 00:00:00+00", "stations": [{"id": 8, "name": "Port"}]}, {"id64": 12, "name": "Sol 1", "type": "Planet", "rings": [{"name": "Sol 1 A Ring", "type": "Icy", "signals": {"signals": {"Tritium": 2}}}]}]}
    path = tmp_path / "galaxy_1day.json.gz"
    path.write_bytes(gzip.compress(("[\n" + json.dumps(one) + ",\n" + '{"id64": 2, "name": "No place"},\n{broken\n]\n').encode()))
    dump = dumps.read_lines(spark, str(path), dumps.SYSTEM)
    assert dump.where("corrupt is not null").count() == 1
    assert [r.name for r in dumps.systems_of(dump).collect()] == ["Sol"]
    assert sorted(r.s.id for r in dumps.stations_of(dump).collect()) == [7, 8]
    assert sorted(r.s.id for r in dumps.stations_of(dump, F.lit("stations")).collect()) == [7]
    kinds = {(r.station_id, r.kind) for r in dumps.board_operations(dumps.stations_of(dump)).collect()}
    assert kinds == {(7, "market"), (7, "identity"), (8, "identity")}
    bodies = dumps.bodies_of(dump)
    assert [r.body for r in bodies.collect()] == ["Sol 1"]
    assert [(r.material, r["count"]) for r in dumps.hotspots_of(bodies).collect()] == [("Tritium", 2)]
    assert [r.cls for r in dumps.main_stars_of(dump).collect()] == ["G"]
    assert dump.select(dumps.dump_kind(F.col("file")).alias("k")).first().k == "galaxy_1day"


def test_journal_reading(spark, tmp_path):
    log = tmp_path / "Journal.2024-01-01T000000.01.log"
    lines = ['{"timestamp":"2024-01-01T00:00:00Z","event":"LoadGame","FID":"F1"}', '{"timestamp":"2024-01-01T00:00:01Z","event":"Music é"}', '{"partial"']
    log.write_bytes("\r\n".join(lines).encode())
    rows = journals.journal_lines(spark, str(tmp_path))
    assert [(r.offset, r.raw) for r in rows.orderBy("offset").collect()] == [(0, lines[0]), (len(lines[0]) + 2, lines[1])]
    events = journals.journal_events(rows)
    assert {r.fid for r in journals.by_commander(events).collect()} == {"F1"}
    assert journals.append_new(events.limit(1), events).count() == 1
    names = spark.createDataFrame([("x/Journal.2024-01-01T000000.01.log",), ("x/Journal.230102030405.02.log",)], "p string")
    assert [r.k for r in names.select(journals.file_order(F.col("p")).alias("k")).collect()] == ["20240101000000.001", "20230102030405.002"]


def test_companion_attribution(spark):
    rows = [("a", 1, "mismatch", None, 0), ("b", 1, "exact", None, 5), ("b", 2, "exact", None, 5), ("c", 1, "exact", None, 0), ("c", 2, "exact", None, 0), ("d", 1, "distance", 10, 0), ("d", 2, "distance", 25, 0), ("e", 1, "distance", 10, 0), ("e", 2, "distance", 15, 0)]
    found = journals.attribute_document(spark.createDataFrame(rows, "document string, commander long, kind string, distance long, total long")).collect()
    assert sorted((r.document, r.commander) for r in found) == [("a", 1), ("c", 1), ("c", 2), ("d", 1)]


def test_feed_frames(spark):
    frame = json.dumps({"$schemaRef": "https://x/schemas/commodity/3", "header": {"softwareName": "s", "gatewayTimestamp": "2024-01-01T00:00:00Z"}, "message": {"timestamp": "2024-01-01T00:00:00Z", "marketId": 5}}).encode()
    frames = spark.createDataFrame([(zlib.compress(frame),), (b"junk",)], "frame binary")
    got = journals.payloads(journals.inflate(frames).where("text is not null"))
    assert [(r.kind, r.software) for r in got.collect()] == [("commodity", "s")]
    assert [(r.op, r.key) for r in feed.operations(got).collect()] == [("market", 5)]


def test_gate_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(4), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(500)), k) for k in range(120)]
    schema = "key long, at timestamp, seq long"
    whole = spark.createDataFrame(rows, schema)
    for n in range(3):
        spark.createDataFrame(rows[40 * n : 40 * (n + 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = feed.gate_stream(stream).writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.seq for r in spark.table("gated").collect()} == {r.seq for r in feed.gate_batch(whole).collect()}


def test_sink_tries_again(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    seen, failures = [], iter([True, False])

    def apply(rows, batch):
        if next(failures, False):
            raise OSError("busy")
        seen.append(rows.count())

    feed.batched_sink(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), apply, str(tmp_path / "cp"), pause=0.01, once=True).awaitTermination(60)
    assert sum(seen) == 3


def test_published_versions(spark, tmp_path):
    root = str(tmp_path)
    for v in (1, 2, 3):
        published.publish(spark, root, "stars", v, spark.range(v))
    assert published.current(spark, root, "stars").count() == 3
    assert not (tmp_path / "stars" / "version=1").exists() and (tmp_path / "stars" / "version=2").exists()
    points = spark.createDataFrame(_cloud(50), "address long, x double, y double, z double")
    published.write_index(points, f"{root}/index")
    index = published.read_index(spark, f"{root}/index")
    assert index.where(spatial.in_sphere((30.0, 30.0, 30.0), 20.0, "cell")).count() == sum(math.dist(p[1:], (30, 30, 30)) <= 20 for p in _cloud(50))
    with pytest.raises(ValueError):
        published.read_index(spark, f"{root}/stars/version=3")


def test_routes_start_at_every_station(spark, small, tmp_path):
    """75 stations, the first 60 and more; jumps against a breadth-first search of the same corridor."""
    for name, key, n in (("customer", "c_custkey", 400), ("supplier", "s_suppkey", 75)):
        one = spark.read.parquet(f"{small}/{name}.parquet").limit(1).drop(key)
        spark.range(n).select(F.col("id").alias(key)).crossJoin(one).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.request: r.jumps for r in registry.queries()["graph_routes"](spark, str(tmp_path)).collect()}
    stars = {k: ((k * 37) % 401 - 200.0, (k * 53) % 211 - 105.0, (k * 71) % 307 - 153.0) for k in range(400)}

    def jumps(start, goal):
        a, b = stars[start], stars[goal]
        line = [q - p for p, q in zip(a, b)]
        part = lambda s: max(0.0, min(1.0, sum((x - p) * v for x, p, v in zip(s, a, line)) / sum(v * v for v in line)))
        there = [k for k, s in stars.items() if math.dist(s, [p + part(s) * v for p, v in zip(a, line)]) <= 80.0]
        now, seen, n = {start}, {start}, 0
        while now and goal not in now:
            now = {k for k in there if k not in seen and any(math.dist(stars[k], stars[m]) <= 60.0 for m in now)}
            seen |= now
            n += 1
        return n if now else None

    assert got == {k: jumps(k, k + 11) for k in range(75)}


def test_net_operations_of_the_whole_journal(spark, small):
    """Every event of every id, long chains among them, against a plain fold."""
    from astrolith.plans import galaxy

    op = F.when(F.col("event") == "signup", "add").when(F.col("event") == "error", "retract").otherwise("update")
    steps = galaxy.events(spark, small).select(F.col("k").alias("id"), F.col("offset").alias("step"), op.alias("op"), "value")
    # of every other id only the steps that follow from the one before, so that not all are errors
    chains, told = {}, []
    for r in sorted(steps.collect(), key=lambda r: (r.id, r.step)):
        chain = chains.setdefault(r.id, [])
        if r.id % 2 and chain and (r.op == "add") != (chain[-1].op == "retract"):
            continue
        chain.append(r)
        told.append(r)
    want = {}
    for k, chain in chains.items():
        first, last = chain[0].op, chain[-1].op
        if any((b.op == "add") != (a.op == "retract") for a, b in zip(chain, chain[1:])):
            want[k] = ("error", chain[-1].value)
        elif not (first == "add" and last == "retract"):
            want[k] = ("add" if first == "add" else "update" if last == "add" else last, chain[-1].value)
    got = {r.id: (r.op, r.value) for r in merge.net_operations(spark.createDataFrame(told, steps.schema), ["id"], ["value"]).collect()}
    assert got == want and {"error", "update"} <= {x for x, _ in want.values()} and max(map(len, chains.values())) > 5


def _plain_ships(snapshots, ships, transfers, docks):
    """The same by a fold over each commander's journal."""
    when = lambda r: (r["ts"], r["file"], r["offset"])
    listed = {}
    for r in ships:
        listed.setdefault((r["commander"], when(r)), []).append(r)
    steps = sorted([(r["commander"], when(r), 0, r) for r in snapshots] + [(r["commander"], when(r), 1, r) for r in transfers], key=lambda x: x[:3])
    places = {r["market_id"]: (r["station"], r["system"]) for r in docks}
    state = {}
    for commander, at, kind, r in steps:
        mine = state.setdefault(commander, {})
        if kind == 0:
            seen = set()
            for x in listed.get((commander, at), []):
                seen.add(x["ship_id"])
                s = mine.setdefault(x["ship_id"], dict.fromkeys(("ship_type", "name", "system", "station", "market_id", "in_transit", "arrival", "as_of")))
                s["ship_type"] = x["ship_type"] or s["ship_type"]
                s["name"] = (x["name"] or "").strip() or s["name"]
                s["as_of"] = r["ts"]
                if x["here"]:
                    s.update(system=r["system"], station=r["station"], market_id=r["market_id"], in_transit=False, arrival=None)
                elif x["in_transit"]:
                    s["in_transit"] = True
                else:
                    market = x["market_id"] if x["market_id"] is not None else s["market_id"]
                    s.update(system=x["system"] or s["system"], market_id=market, station=places.get(market, (None,))[0] or s["station"], in_transit=False, arrival=None)
            for k in set(mine) - seen:
                del mine[k]
        else:
            s = mine.setdefault(r["ship_id"], dict.fromkeys(("ship_type", "name", "system", "station", "market_id", "in_transit", "arrival", "as_of")))
            s.update(ship_type=r["ship_type"] or s["ship_type"], in_transit=True, market_id=r["market_id"], as_of=r["ts"])
            if r["market_id"] is not None:
                s["station"], s["system"] = places.get(r["market_id"], (None, None))
            s["arrival"] = r["ts"] + datetime.timedelta(seconds=r["seconds"]) if r["seconds"] is not None else None
    return {(c, k): tuple(s.values()) for c, mine in state.items() for k, s in mine.items()}


def test_ships_against_a_fold(spark, small):
    from astrolith.plans import fights

    *parts, carriers = fights.ship_parts(spark, small)
    got = {(r.commander, r.ship_id): (r.ship_type, r.name, r.system, r.station, r.market_id, r.in_transit, r.arrival, r.as_of) for r in combat.ship_locations(*parts).collect()}
    want = _plain_ships(*([r.asDict() for r in p.collect()] for p in parts))
    assert got == want and len(got) > 20
    shown = registry.queries()["ships_located"](spark, small).collect()
    assert len(shown) == len(want) and {"stored", "in_transit", "arrived"} <= {r.status for r in shown}
    known = {r.carrier_id: r for r in carriers.collect()}
    for r in shown:
        s = want[r.commander, r.ship_id]
        minutes = None if s[6] is None else (s[6] - datetime.datetime(2024, 1, 31)) // datetime.timedelta(minutes=1)
        status = "aboard_carrier" if r.market_id in known else ("arrived" if minutes is not None and minutes <= 0 else "in_transit") if s[5] else "stored"
        assert (r.status, r.minutes) == (status, minutes)
        assert r.station == (known[r.market_id].callsign if r.market_id in known else s[3])


def test_limits_against_a_loop(spark):
    rng = random.Random(8)
    start = datetime.datetime(2024, 1, 1)
    rows = sorted((rng.randrange(3), start + datetime.timedelta(seconds=rng.randrange(9000) / 10), k) for k in range(600))
    state, want = {}, {}
    for source, ts, k in sorted(rows, key=lambda r: (r[1], r[2])):
        passed = True
        for name, seconds, most in (("burst", 10, 4), ("window", 100, 20)):
            count, since = state.get((source, name), (0, None))
            if since is None or (ts - since).total_seconds() >= seconds:
                count, since = 0, ts
            state[source, name] = (count + 1, since)
            if count + 1 > most:
                passed = False
                break
        want[k] = passed
    got = {r.id: r.passed for r in combat.rate_limited(spark.createDataFrame(rows, "source long, ts timestamp, id long"), 100, 20, 10, 4).collect()}
    assert got == want and 0 < sum(want.values()) < 600


def test_fuel_routes_against_all_states():
    """Every state of small clouds relaxed to a standstill, without bounds or dominance."""
    import pandas as pd

    engine = graph.Engine(mass=100.0, optimal_mass=900.0, per_jump=2.0, capacity=6.0)
    step = engine.capacity / graph.FUEL_STEPS
    solved = 0
    for seed in range(12):
        rng = random.Random(seed)
        rows = [(k, *(rng.uniform(0, 170) for _ in range(3)), rng.choice((1.0, 1.0, 1.5, 4.0)), rng.random() < 0.4) for k in range(14)]
        for allowed in (0, 2):
            best = {(0, graph.FUEL_STEPS, 0): 0.0}
            moved = True
            while moved:
                moved = False
                for (at, fuel, used), took in list(best.items()):
                    for full, since in [(fuel, took)] + [(graph.FUEL_STEPS, took + engine.stop + (graph.FUEL_STEPS - fuel) * step / engine.rate)] * rows[at][5]:
                        reach = engine.range(full * step)
                        for k, *p, _, _ in rows:
                            ly = math.dist(p, rows[at][1:4])
                            way = (1.0, engine.plain, 0) if ly <= reach else (rows[at][4], engine.boosted, 0) if ly <= reach * rows[at][4] else (2.0, engine.plain + engine.injection, 1) if ly <= 2 * reach and used < allowed else None
                            if k == at or way is None:
                                continue
                            left = math.floor((full * step - engine.burn(ly, full * step, way[0])) / step + 1e-9)
                            state = (k, left, used + way[2])
                            if left >= 0 and since + way[1] < best.get(state, math.inf) - 1e-9:
                                best[state] = since + way[1]
                                moved = True
            frame = pd.DataFrame(rows, columns=["address", "x", "y", "z", "boost", "scoop"])
            for goal in (5, 13):
                plain = min((t for (k, _, used), t in best.items() if k == goal and used == 0), default=None)
                want = plain if plain is not None else min((t for (k, _, _), t in best.items() if k == goal), default=None)
                got = graph.solve_fuel(frame, 0, goal, engine, injections=allowed)
                assert (got is None) == (want is None)
                if got:
                    solved += 1
                    assert math.isclose(got[1], want, abs_tol=1e-6) and got[0][0] == 0 and got[0][-1] == goal
    assert solved > 10


def _plain_trades(stock, policy):
    cap = {1: 300, 2: 250, 3: 200, 4: 150, 5: 100}

    def ratio(a, b):
        n = a["grade"] - b["grade"]
        if a["group"] == b["group"]:
            return None if n == 0 else (1, 3**n) if n > 0 else (6**-n, 1)
        return (6, 1) if n == 0 else (2, 3 ** (n - 1)) if n > 0 else (6 ** (1 - n), 1)

    have = {r["material"]: r["count"] for r in stock}
    items = sorted(stock, key=lambda r: (r["group"], r["grade"], r["material"]))
    sources = sorted((r for r in items if r["grade"] >= policy.least_grade and r["count"] >= math.ceil(cap[r["grade"]] * policy.source)), key=lambda r: (-r["grade"], r["group"], r["material"]))
    full = {r["material"] for r in sources}
    out = []

    def trade(s, d, stop, until, way):
        if s["material"] == d["material"] or s["kind"] != d["kind"] or (way != "room" and d["material"] in full) or not ratio(s, d):
            return
        pay, get = ratio(s, d)
        n = min((have[s["material"]] - stop) // pay, (until - have[d["material"]]) // get)
        if n > 0:
            have[s["material"]] -= n * pay
            have[d["material"]] += n * get
            out.append((s["material"], n * pay, d["material"], n * get, way))

    low = lambda g: range(1, g) if policy.bottom else range(g - 1, 0, -1)
    keep = lambda s: math.floor(cap[s["grade"]] * policy.floor)
    for s in sources:
        for g in low(s["grade"]):
            for d in items:
                if d["group"] == s["group"] and d["grade"] == g:
                    trade(s, d, keep(s), cap[g], "down")
    for s in sources if policy.across else ():
        for g in (s["grade"], *low(s["grade"])):
            for d in items:
                if d["group"] != s["group"] and d["grade"] == g:
                    trade(s, d, keep(s), cap[g], "across")
    for s in sources if policy.up else ():
        for g in range(s["grade"] + 1, 6):
            for d in items:
                if d["group"] == s["group"] and d["grade"] == g:
                    trade(s, d, keep(s), cap[g], "up")
    if policy.room is not None:
        top = lambda r: math.floor(cap[r["grade"]] * policy.room)
        for s in sources:
            if s["grade"] >= 4:
                others = [d for d in items if d["grade"] >= 4]
                for d in [d for d in others if d["group"] == s["group"]] + [d for d in others if d["group"] != s["group"] and d["grade"] == s["grade"]] + [d for d in others if d["group"] != s["group"] and d["grade"] + 1 == s["grade"]]:
                    trade(s, d, max(top(s), keep(s)), top(d), "room")
    return out


@pytest.mark.parametrize("policy", [{}, {"source": 0.6, "floor": 0.3, "up": True, "room": 0.5}, {"source": 0.5, "bottom": False, "across": False, "least_grade": 2, "room": 0.4}])
def test_trades_against_loops(spark, medium, policy):
    from astrolith.operators import engineering
    from astrolith.plans import workshop

    policy = engineering.Policy(**policy)
    stock = workshop.stock(spark, medium).where("commander < 40")
    got, by = {}, {}
    for r in engineering.trades(stock, policy).orderBy("commander", "step").collect():
        got.setdefault(r.commander, []).append((r.give, r.give_qty, r.receive, r.receive_qty, r.way))
    for r in stock.collect():
        by.setdefault(r.commander, []).append(r.asDict())
    want = {c: t for c, rows in by.items() if (t := _plain_trades(rows, policy))}
    assert got == want and {w for t in want.values() for *_, w in t} >= {"down"}


def test_repeat_gates_against_a_loop(spark, medium):
    """Every callout of the journal, in batches that cut groups."""
    from astrolith.plans import galaxy

    rows = galaxy.events(spark, medium).select("commander", "ts", "file", "offset", F.col("event").alias("kind"), (F.col("k") % 3).cast("string").alias("text"))
    want, state = [], {}
    for r in sorted(rows.collect(), key=lambda r: (r.ts, r.file, r.offset)):
        key = (r.commander, r.kind, r.text)
        last, held = state.get(key, (None, 0))
        if last is not None and (r.ts - last).total_seconds() < (86400 if r.kind == "error" else 43200):
            state[key] = (last, held + 1)
        else:
            want.append((*key, r.ts, held))
            state[key] = (r.ts, 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = [tuple(r) for r in registry.queries()["events_callouts"](spark, medium).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want)


def test_fuel_routes_of_a_lighter_tank_go_farther():
    """Both ways to the star 3 take as long; only the one that burns more fuel leaves the ship light enough for the last jump."""
    import pandas as pd

    from astrolith.plans.graphs import ENGINE

    rows = [(0, 0.0, 0.0, 0.0), (1, 25.6, 0.0, 0.0), (2, 25.6, 41.0, 0.0), (3, 51.2, 0.0, 0.0), (4, 102.7, 0.0, 0.0)]
    frame = pd.DataFrame(rows, columns=["address", "x", "y", "z"]).assign(boost=1.0, scoop=False)
    assert graph.solve_fuel(frame, 0, 4, ENGINE) == ([0, 2, 3, 4], 159.0, 0)
    assert graph.solve_fuel(frame, 0, 4, ENGINE, bound=(159.0, 3)) is None and graph.solve_fuel(frame, 0, 4, ENGINE, bound=(159.0, 4))
    apart = pd.concat([frame, frame.assign(address=frame.address + 10, x=frame.x + 500.0)])
    assert graph.solve_fuel(apart, 0, 14, ENGINE, injections=2) is None
    assert graph.solve_fuel(frame, 0, 4, graph.Engine(400.0, 1800.0, 0.0, 16.0)) is None and graph.solve_fuel(frame, 4, 4, ENGINE) == ([4], 0.0, 0)


def test_fuel_routes_of_a_dense_cloud_hold_little():
    import tracemalloc

    import pandas as pd

    from astrolith.plans.graphs import ENGINE

    rng = random.Random(5)
    rows = [(k, rng.uniform(0, 450), rng.uniform(0, 120), rng.uniform(0, 120)) for k in range(3000)]
    rows[0], rows[1] = (0, 0.0, 60.0, 60.0), (1, 450.0, 60.0, 60.0)
    frame = pd.DataFrame(rows, columns=["address", "x", "y", "z"])
    frame = frame.assign(boost=frame.address.map(lambda k: {2: 4.0, 3: 1.5}.get(k % 8, 1.0)), scoop=frame.address % 8 > 4)
    tracemalloc.start()
    path, seconds, used = graph.solve_fuel(frame, 0, 1, ENGINE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (len(path), seconds, used) == (5, 252.0, 0) and peak < 100e6
