"""Distances, travel times, fuel and prices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edge of a grid cell in light years, and how cells are numbered.
CELL, HALF, SPAN = 100.0, 1024, 2048


@dataclass(frozen=True)
class Timing:
    """Seconds of the parts of a leg. The defaults."""

    jump: float = 18.0
    undock: float = 60.0
    docking: float = 60.0
    market: float = 35.0
    cruise: float = 150.0
    per_kls: float = 0.5
    scale: float = 1.0

    def clamped(self) -> Timing:
        low = {"jump": 5, "undock": 5, "docking": 5, "market": 0, "cruise": 5, "per_kls": 0, "scale": 0.25}
        high = {"jump": 120, "undock": 600, "docking": 600, "market": 600, "cruise": 600, "per_kls": 60, "scale": 4}
        return Timing(**{k: min(max(getattr(self, k), low[k]), high[k]) for k in low})


@dataclass(frozen=True)
class Ship:
    cargo: int = 200
    empty_range: float = 40.0
    full_range: float = 25.0


def _num(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def d2(ax, ay, az, bx, by, bz) -> Column:
    x, y, z = _num(ax) - _num(bx), _num(ay) - _num(by), _num(az) - _num(bz)
    return x * x + y * y + z * z


def distance(*points) -> Column:
    return F.sqrt(d2(*points))


def cell(x: Column, y: Column, z: Column) -> Column:
    """One number per grid cell; null if a coordinate is."""
    at = lambda v: F.floor(v / CELL).cast("long") + HALF
    return (at(x) * SPAN + at(y)) * SPAN + at(z)


def jump_count(dist: Column, reach) -> Column:
    return F.when(dist <= 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1), F.ceil(dist / F.greatest(_num(reach), F.lit(1.0)))).cast("long"))


def leg_seconds(dist: Column, arrival_ls: Column, reach, timing: Timing = Timing()) -> Column:
    # terms are added one by one, in the order of the SQL: another grouping differs in the last bit, which decides ties of rates
    far = timing.per_kls * F.greatest(F.coalesce(arrival_ls, F.lit(0.0)), F.lit(0.0)) / 1000.0 * timing.scale
    return timing.undock + jump_count(dist, reach) * timing.jump + timing.cruise * timing.scale + far + timing.docking + timing.market


def range_at_tons(tons: Column, ship: Ship) -> Column:
    empty, full, cap = ship.empty_range, ship.full_range, float(ship.cargo)
    if cap <= 0 or not full > 0 or full >= empty:
        return F.when((tons > 0) & F.lit(0 < full < empty), full).otherwise(empty)
    mass = cap * full / (empty - full)
    return F.when(tons <= 0, empty).otherwise(empty * mass / (mass + F.least(tons.cast("double"), F.lit(cap))))


def leg_rates(tons: Column, per_ton: Column, dist: Column, from_ls: Column, to_ls: Column, ship: Ship, timing: Timing = Timing()) -> tuple[Column, Column, Column]:
    """Profit, credits an hour one way, and credits an hour with the empty way back."""
    there = leg_seconds(dist, to_ls, range_at_tons(tons, ship), timing)
    back = leg_seconds(dist, from_ls, ship.empty_range, timing)
    profit = per_ton * tons
    hourly = lambda s: profit / F.greatest(s / 3600.0, F.lit(1e-6))
    return profit, hourly(there), hourly(there + back)


def carrier_fuel(dist: Column, used, tank) -> Column:
    return F.greatest(F.round(5.0 + dist * (_num(used) + _num(tank) + 25_000.0) / 200_000.0), F.lit(5.0)).cast("long")


@dataclass(frozen=True)
class Drive:
    """Fuel use of a ship's drive."""

    mass: float
    capacity: float
    per_jump: float
    optimal_mass: float
    power: float = 2.45
    multiplier: float = 0.012
    booster: float = 0.0
    cargo: float = 0.0
    reserve: float = 0.0

    def base_range(self, fuel) -> Column:
        """Range without the booster at a tank of ``fuel`` tonnes."""
        heavy = self.mass + self.cargo + F.greatest(_num(fuel), F.lit(0.0))
        return self.optimal_mass / heavy * (self.per_jump / self.multiplier) ** (1.0 / self.power)

    def burn(self, dist, fuel, boost=1.0) -> Column:
        base = self.base_range(fuel)
        path = _num(dist) / F.greatest(_num(boost), F.lit(1.0)) * base / (base + self.booster)
        heavy = self.mass + self.cargo + F.greatest(_num(fuel), F.lit(0.0))
        return self.multiplier * F.pow(path * heavy / self.optimal_mass, F.lit(self.power))

    def after(self, dist, fuel, boost=1.0) -> Column:
        """Fuel left after a jump; null if it cannot be made."""
        reach = (self.base_range(fuel) + self.booster) * F.greatest(_num(boost), F.lit(1.0))
        used = self.burn(dist, fuel, boost)
        left = _num(fuel) - used
        can = (_num(dist) <= reach + 1e-3) & (used <= self.per_jump + 1e-3) & (left >= self.reserve - 1e-3)
        return F.when(can, F.greatest(left, F.lit(0.0)))


def morton(x: Column, y: Column, z: Column, bits: int = 21) -> Column:
    """Bits of three non-negative numbers interleaved, x lowest."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        for axis, v in enumerate((x, y, z)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(v.cast("long"), k).bitwiseAND(1), 3 * k + axis))
    return out


def morton_axis(key: Column, axis: int, bits: int = 21) -> Column:
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(key, 3 * k + axis).bitwiseAND(1), k))
    return out


def body_id64(system: Column, body: Column) -> Column:
    return system + F.shiftleft(body.cast("long"), 55)


def decayed(value: Column, seconds: Column, half_life: float) -> Column:
    return value * F.pow(F.lit(0.5), seconds / half_life)


def discount(elite: Column, other: Column) -> Column:
    """Both discounts in per cent together, to a tenth."""
    kept = (1.0 - elite / 100.0) * (1.0 - other / 100.0)
    return F.round((1.0 - kept) * 1000.0) / 10.0


def material_cap(grade: Column) -> Column:
    return F.when(grade == 1, 300).when(grade == 2, 250).when(grade == 3, 200).when(grade == 4, 150).otherwise(100)


def trader_ratio(grade_from: Column, grade_to: Column, same_group: Column) -> Column:
    """(pay, get) of a material trader: three down for one, six up for one, and one step worse
    across groups; null for the same grade of one group."""
    step = grade_from - grade_to
    pair = lambda a, b: F.struct(a.cast("long").alias("pay"), b.cast("long").alias("get"))
    one = F.lit(1)
    same = F.when(step > 0, pair(one, F.pow(3.0, step))).when(step < 0, pair(F.pow(6.0, -step), one))
    across = F.when(step == 0, pair(F.lit(6), one)).when(step > 0, pair(F.lit(2), F.pow(3.0, step - 1))).otherwise(pair(F.pow(6.0, 1 - step), one))
    return F.when(same_group, same).otherwise(across)


def route_score(plain: Column, boosted: Column, injections: Column, stops: Column, passing: Column, scooped: Column, rate: float = 1.245, stop_weight: float = 1.0) -> Column:
    """Deciseconds of a route; less is better."""
    seconds = plain * 53.0 + boosted * 73.0 + injections * 1800.0 + stop_weight * (stops * 120.0 + passing * 6.0 + scooped / rate)
    return F.floor(seconds * 10.0).cast("long")
