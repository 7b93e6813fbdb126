"""Searches over market, outfitting and shipyard boards."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolith.functions import classes, maths, strings
from astrolith.operators.spatial import in_sphere


@dataclass(frozen=True)
class Search:
    """Filters that all board searches share; out-of-range values are clamped."""

    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    radius: float = 100.0
    max_age_hours: float = 48.0
    min_pad: str | None = None
    carriers: bool = False
    powers: tuple[str, ...] = ()
    limit: int = 50
    now: str = "now"
    opted_in: bool = False
    excluded_names: tuple[str, ...] = field(default=())

    def clamped(self) -> Search:
        from dataclasses import replace

        return replace(self, radius=min(max(self.radius, 1.0), 500.0), limit=min(max(self.limit, 1), 200), max_age_hours=min(max(self.max_age_hours, 0.25), 720.0))


def fresh(observed: Column, now: str, hours: float) -> Column:
    """Strictly younger than the given age; what has no time is not."""
    return observed > F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(hours * 3600.0))


def box(systems: DataFrame, stations: DataFrame, search: Search) -> DataFrame:
    """Stations of a sphere that pass the place filters, with their systems' facts."""
    s = search.clamped()
    near = systems.where(in_sphere(s.origin, s.radius, "cell")).withColumn("distance_ly", maths.distance(F.col("x"), F.col("y"), F.col("z"), *s.origin))
    if s.powers:
        near = near.where(F.col("controlling_power").isin(*s.powers))
    there = stations.where(classes.pad_fits(F.col("pad_large"), F.col("pad_medium"), F.col("pad_small"), s.min_pad))
    if not s.carriers:
        there = there.where(~F.coalesce("is_carrier", F.lit(False)))
    for name in s.excluded_names:
        there = there.where(~F.col("station").eqNullSafe(F.lit(name)))
    return there.join(near.withColumnRenamed("name", "system"), there.system_address == near.address)


def allowed_sales(rows: DataFrame, prohibited: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Rows whose goods their station does not forbid; with ``services``, forbidden goods
    stay where there is a black market."""
    banned = prohibited.select(F.col("station_id").alias("id"), F.lower("symbol").alias("symbol")).distinct()
    kept = rows.join(banned, ["id", "symbol"], "left_anti")
    if services is None:
        return kept
    dark = services.where("service = 'blackmarket'").select(F.col("station_id").alias("id")).distinct()
    return kept.unionByName(rows.join(banned, ["id", "symbol"], "left_semi").join(dark, "id", "left_semi"))


def market_search(systems: DataFrame, stations: DataFrame, market: DataFrame, symbol: str, side: str, search: Search, prohibited: DataFrame | None = None, services: DataFrame | None = None, least: int = 1, sort: str = "price") -> DataFrame:
    """Who buys or sells ``symbol`` nearby: price (best first), then arrival, unknown last; or by distance."""
    s = search.clamped()
    price, amount = ("sell_price", "demand") if side == "sell" else ("buy_price", "supply")
    rows = market.where((F.col("symbol") == symbol) & (F.col(price) > 0) & (F.col(amount) >= least) & fresh(F.col("observed_at"), s.now, s.max_age_hours))
    found = box(systems, stations, s).join(rows.withColumnRenamed("station_id", "id"), "id")
    if side == "sell" and prohibited is not None:
        found = allowed_sales(found, prohibited, services if s.opted_in else None)
    best = F.col(price).desc() if side == "sell" else F.col(price).asc()
    arrival = F.col("arrival_ls").asc_nulls_last()
    order = [best, arrival, "id"] if sort == "price" else ["distance_ly", best, "id"]
    return found.orderBy(*order).limit(s.limit).select("id", "station", "system", "symbol", F.col(price).alias("price"), F.col(amount).alias("amount"), "distance_ly", "arrival_ls", "observed_at")


def resolve_commodity(commodities: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Commodities whose symbol or name holds the text; exact ones first."""
    needle = text.strip().lower()
    hit = F.lower("name").contains(needle) | F.col("symbol").contains(needle)
    exact = (F.col("symbol") == needle) | (F.lower("name") == needle)
    return commodities.where(hit).withColumn("exact", exact).orderBy(F.desc("exact"), "name", "symbol").limit(limit)


def station_board(market: DataFrame, commodities: DataFrame, station: int) -> DataFrame:
    rows = market.where(F.col("station_id") == station)
    return rows.join(commodities, "symbol", "left").select("symbol", F.coalesce("name", "symbol").alias("commodity"), "category", "buy_price", "sell_price", "supply", "demand").orderBy("commodity", "symbol")


def price_stats(market: DataFrame) -> DataFrame:
    """Mean price and boards of each commodity that someone buys."""
    return market.where("sell_price > 0").groupBy("symbol").agg(F.avg("sell_price").alias("mean_sell"), F.count("*").alias("boards"))


def price_envelope(market: DataFrame, stations: DataFrame) -> DataFrame:
    """Least, greatest and spread of the prices at stations that are no carriers."""
    own = market.join(stations.where(~F.coalesce("is_carrier", F.lit(False))).select(F.col("id").alias("station_id")), "station_id")
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    return own.groupBy("symbol").agg(
        *(f(some(c)).alias(f"{n}_{c}") for c in ("buy_price", "sell_price") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("std", F.stddev_pop))), F.count("*").alias("boards")
    )


def plausible(market: DataFrame, stations: DataFrame, envelope: DataFrame, k: float = 1.0, least: int = 100) -> DataFrame:
    """Drops carriers' rows whose prices lie outside what stations ask, once enough boards tell."""
    carrier = stations.select(F.col("id").alias("station_id"), F.coalesce("is_carrier", F.lit(False)).alias("__carrier"))
    rows = market.join(carrier, "station_id").join(envelope, "symbol", "left")
    inside = F.lit(True)
    for c in ("buy_price", "sell_price"):
        low, high = F.col(f"min_{c}") - k * F.col(f"std_{c}"), F.col(f"max_{c}") + k * F.col(f"std_{c}")
        inside &= (F.col(c) <= 0) | low.isNull() | F.col(c).between(low, high)
    return rows.where(~F.col("__carrier") | (F.coalesce("boards", F.lit(0)) < least) | inside).select(*market.columns)


def stations_near(systems: DataFrame, stations: DataFrame, services: DataFrame, origin: tuple[float, float, float], radius: float, service: str, limit: int = 20, over: int = 4, min_pad: str | None = None) -> DataFrame:
    """Nearest stations with a service. ``over`` times as many are taken before pads are
    looked at, so fewer than ``limit`` may remain."""
    key = strings.service_key(F.lit(service))
    has = services.where(strings.service_key(F.col("service")) == key).select(F.col("station_id").alias("id")).distinct()
    found = box(systems, stations, Search(origin, radius, carriers=True)).join(has, "id", "left_semi")
    head = found.orderBy("distance_ly", "id").limit(over * limit)
    return head.where(classes.pad_fits(F.col("pad_large"), F.col("pad_medium"), F.col("pad_small"), min_pad)).orderBy("distance_ly", "id").limit(limit)


def sell_hold(market: DataFrame, hold: DataFrame, limit: int = 30) -> DataFrame:
    """Where a hold (symbol, held) brings most: price times what is both held and in demand."""
    rows = market.join(hold, "symbol").where("sell_price > 0 and demand > 0")
    take = F.least("held", "demand")
    return rows.groupBy("station_id").agg(F.sum(F.col("sell_price") * take).alias("credits"), F.count("*").alias("lines")).orderBy(F.desc("credits"), "station_id").limit(limit)


def availability(systems: DataFrame, stations: DataFrame, board: DataFrame, search: Search, text: str | None = None, symbols: tuple[str, ...] = (), credits_only: bool = False) -> DataFrame:
    """Which stations nearby offer modules or ships: those whose symbol holds ``text``, or one of ``symbols`` if
    there are any; nearest first. ``credits_only`` leaves out what only other coins buy; an unknown
    price stays."""
    wanted = tuple(s for s in (x.strip().lower() for x in symbols) if s)
    s = search.clamped()
    rows = board.where(F.col("symbol").isin(*wanted) if wanted else F.lower("symbol").contains((text or "").strip().lower()))
    if credits_only:
        rows = rows.where("credits_price is null or credits_price > 0")
    found = box(systems, stations, s).join(rows.withColumnRenamed("station_id", "id"), "id")
    return found.orderBy("distance_ly", "id", "symbol").limit(s.limit)


def seen_prices(sightings: DataFrame) -> DataFrame:
    """The newest board of each market: for each symbol the least price over 0 in credits and in other coins (0
    without one), and the variants that other coins buy."""
    newest = sightings.groupBy("market_id").agg(F.max("ts").alias("ts"))
    rows = sightings.join(newest, ["market_id", "ts"])
    least = lambda c: F.coalesce(F.min(F.when(F.col(c) > 0, F.col(c))), F.lit(0))
    variants = F.array_sort(F.collect_list(F.when(F.col("merc") > 0, F.col("variant"))))
    return rows.groupBy("market_id", F.lower(F.trim("symbol")).alias("symbol"), "ts").agg(least("credits").alias("credits"), least("merc").alias("merc"), variants.alias("variants"))


def power_ok(power: str | None, mode: str = "controls", state: str | None = None) -> Column:
    """Whether a place (controlling_power, powers, power_state) suits: its power controls it, is
    'present' (controlling or listed) or 'undermining' (present, not controlling); state 'none' means
    that nobody holds it. Null asks for nothing."""
    ok = F.lit(True)
    if power is not None:
        controls = F.coalesce(F.lower("controlling_power") == power.lower(), F.lit(False))
        present = controls | F.coalesce(F.exists("powers", lambda x: F.lower(x) == power.lower()), F.lit(False))
        ok = {"present": present, "undermining": present & ~controls}.get(mode, controls)
    if state is None:
        return ok
    if state.lower() == "none":
        return ok & F.col("power_state").isNull() & F.col("controlling_power").isNull()
    return ok & F.coalesce(F.lower("power_state") == state.lower(), F.lit(False))


def faction_ok(faction: str | None) -> Column:
    return F.lit(True) if faction is None else F.coalesce(F.lower(F.trim("controlling_faction")) == faction.lower(), F.lit(False))


def requested(stations: DataFrame, names: list[str], most_names: int = 200, most_rows: int = 1000) -> DataFrame:
    """Stations of the named systems, in the order of the request, carriers last."""
    keys = list(dict.fromkeys(n.strip().lower() for n in names if n.strip()))
    if not 0 < len(keys) <= most_names:
        raise ValueError(f"between 1 and {most_names} systems")
    place = F.array_position(F.array(*(F.lit(k) for k in keys)), F.lower("system"))
    rows = stations.withColumn("place", place).where("place > 0")
    return rows.orderBy("place", "is_carrier", "station", "id").limit(most_rows)


def one_of(**given: object) -> str:
    """The name of the only argument that is set; an error unless it is exactly one."""
    named = [k for k, v in given.items() if v not in (None, "", (), [])]
    if len(named) != 1:
        raise ValueError(f"exactly one of {', '.join(given)}")
    return named[0]


def exact_commodity(commodities: DataFrame, text: str) -> DataFrame:
    """The commodity of that symbol or name, one with a name before one without."""
    key = text.strip().lower()
    rows = commodities.where((F.lower("symbol") == key) | (F.lower("name") == key))
    return rows.orderBy(F.col("name").isNull() | (F.col("name") == ""), "symbol").limit(1)


def banned_goods(prohibited: DataFrame, commodities: DataFrame) -> DataFrame:
    """(station_id, symbol) of forbidden goods, listed by symbol or by name: two equi joins instead of
    one join on either."""
    listed = prohibited.select("station_id", F.lower("symbol").alias("listed")).distinct()
    goods = commodities.select("symbol", F.lower("name").alias("named"))
    by_symbol = listed.join(goods, F.col("listed") == F.lower("symbol"))
    by_name = listed.join(goods, F.col("listed") == F.col("named"))
    return by_symbol.select("station_id", "symbol").unionByName(by_name.select("station_id", "symbol")).distinct()


def fresh_since(market: DataFrame, cutoff: str) -> DataFrame:
    """Board rows observed at or after the cutoff."""
    return market.where(F.col("observed_at") >= F.lit(cutoff).cast("timestamp"))


def post_filter(rows: DataFrame, discounted: bool = False, pledged: str | None = None, carriers: bool = True) -> DataFrame:
    """Rows that a search gave, narrowed: those with a discount, in a power's space, at stations that are no carriers."""
    if discounted:
        rows = rows.where("size(discounts) > 0")
    if pledged is not None:
        rows = rows.where(F.lower("controlling_power") == pledged.lower())
    return rows if carriers else rows.where(~F.coalesce("is_carrier", F.lit(False)))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefixed(c: Column, text: str) -> Column:
    """Names that begin so, whatever the case; signs of patterns stand for themselves."""
    return F.lower(c).startswith(text.strip().lower())
