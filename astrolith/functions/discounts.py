"""Discounts on ships and modules: which rules cover an item at a place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hull groups, utility mounts, states of a power's hold, and the rules in force in their order.
IMPERIAL = ("empire_eagle", "empire_courier", "empire_trader", "cutter")
LAKON = ("type6", "type7", "type8", "type9", "type9_military", "independant_trader", "lakonminer", "typex", "typex_2", "typex_3")
UTILITY = (
    "chafflauncher", "heatsinklauncher", "plasmapointdefence", "pointdefence", "electroniccountermeasure", "shieldbooster", "cloudscanner",
    "crimescanner", "cargoscanner", "mrascanner", "xenoscanner", "antiunknownshutdown", "causticsinklauncher", "shutdownfieldneutraliser",
)
CONTROLLED, EXPLOITED = ("Stronghold", "Fortified"), ("Exploited",)
HELD = (*CONTROLLED, *EXPLOITED)
CD = "CD-43 11917"


@dataclass(frozen=True)
class Rule:
    """``scope``: 'all', 'weapons', or hulls or module stems with ``kind``; the place fields that are
    given must all agree."""

    percent: float
    kind: str = "all"
    symbols: tuple[str, ...] = ()
    station: str | None = None
    system: str | None = None
    power: str | None = None
    states: tuple[str, ...] = ()
    excluding: tuple[str, ...] = ()
    elite: bool = False


RULES = (
    Rule(2.5, elite=True),
    Rule(5.0, "ships", LAKON, system="Alioth"),
    Rule(10.0, station="Jameson Memorial", system="Shinrarta Dezhra", elite=True),
    Rule(10.0, "ships", IMPERIAL, power="Denton Patreus", states=CONTROLLED),
    Rule(10.0, "ships", IMPERIAL, station="Henry O'Hare's Hangar", system="Summerland"),
    Rule(10.0, "ships", ("federation_dropship", "vulture"), station="Daedalus", system="Sol"),
    Rule(20.0, "ships", ("eagle",), station="Daedalus", system="Sol"),
    Rule(10.0, "ships", ("eagle",), station="Edmondson High", system="Beta Hydri"),
    Rule(10.0, "weapons", power="Jerome Archer", states=EXPLOITED),
    Rule(15.0, power="Li Yong-Rui", states=HELD),
    Rule(20.0, "weapons", power="Jerome Archer", states=CONTROLLED),
    Rule(20.0, "ships", ("asp", "orca"), station="Irkutsk", system="Alioth"),
    Rule(20.0, "ships", ("diamondbackxl",), station="Hamilton Gateway", system="Wolf 406"),
    Rule(20.0, "modules", ("cargorack", "hullreinforcement"), power="Edmund Mahon", states=CONTROLLED),
    Rule(20.0, "ships", ("sidewinder", "eagle", "viper", "cobramkiii", "diamondback", "diamondbackxl", "vulture", "ferdelance"), station="Attilius Orbital", system=CD),
    Rule(30.0, "modules", ("pulselaser", "burstlaser", "beamlaser", "cannon", "multicannon", "railgun", "chafflauncher", "heatsinklauncher"), station="Attilius Orbital", system=CD, excluding=("_large", "_huge", "_turret")),
)


def _has_any(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out |= c.contains(p)
    return out


def is_weapon(symbol: Column) -> Column:
    """On a hardpoint, and none of the utility mounts."""
    s = F.lower(symbol)
    return s.startswith("hpt_") & ~_has_any(s, UTILITY)


def _same(c: Column, value: str | None) -> Column:
    return F.lit(True) if value is None else F.coalesce(F.lower(c) == value.lower(), F.lit(False))


def covers(rule: Rule, ship: Column, symbol: Column, station: Column, system: Column, power: Column, state: Column, elite: Column) -> Column:
    s = F.lower(symbol)
    scope = {"all": lambda: F.lit(True), "ships": lambda: ship & s.isin(*rule.symbols), "weapons": lambda: ~ship & is_weapon(s), "modules": lambda: ~ship & _has_any(s, rule.symbols)}[rule.kind]()
    held = F.coalesce(F.lower(state).isin(*(x.lower() for x in rule.states)), F.lit(False)) if rule.states else F.lit(True)
    allowed = elite if rule.elite else F.lit(True)
    return allowed & scope & ~_has_any(s, rule.excluding) & _same(station, rule.station) & _same(system, rule.system) & _same(power, rule.power) & held


def discounts(ship: Column, symbol: Column, station: Column, system: Column, power: Column, state: Column, elite: Column) -> Column:
    """Indexes and percents of the rules that apply, best first; ``ship``: whether the item is a hull."""
    found = F.array(*(F.when(covers(r, ship, symbol, station, system, power, state, elite), F.struct(F.lit(-r.percent).alias("less"), F.lit(k).alias("rule"))) for k, r in enumerate(RULES)))
    return F.transform(F.array_sort(F.array_compact(found)), lambda x: F.struct((-x["less"]).alias("percent"), x["rule"].alias("rule")))
