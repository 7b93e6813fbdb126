"""Classes of stations, landing pads, stars and ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Station classes in order of rank.
STATION_RANK = {"starport": 0, "planetary_port": 1, "outpost": 2, "carrier": 3, "construction_depot": 4, "settlement": 5, "other": 6}
DOCKABLE = ("starport", "planetary_port", "outpost", "carrier")
PADS = ("small", "medium", "large")
SCOOPABLE = ("O", "B", "A", "F", "G", "K", "M")
# What a star does to a drive that charges from it.
BOOST = {"Neutron": 4.0, "WhiteDwarf": 1.5}
HAZARD = ("WhiteDwarf", "Neutron", "BlackHole")
SUBTYPE = {"Neutron": "Neutron Star", "BlackHole": "Black Hole", "WhiteDwarf": "White Dwarf (D) Star", "Proto": "T Tauri Star", "Exotic": "Wolf-Rayet Star"}
# Economies that host a kind of material trader.
TRADERS = {"extraction": "raw", "refinery": "raw", "industrial": "manufactured", "high tech": "encoded", "military": "encoded"}
# Materials by the rings that they are mined from.
RING_GOODS = {
    "Metallic": ("gold", "silver", "palladium", "osmium", "bertrandite", "indite", "gallite", "praseodymium", "samarium", "thorium"),
    "Rocky": ("bauxite", "cobalt", "rutile", "coltan", "lepidolite", "uraninite"),
    "Icy": ("hydrogenperoxide", "liquidoxygen", "methanolmonohydratecrystal", "methanolmonohydratecrystals", "methaneclathrate", "lithiumhydroxide", "water"),
}


def _any(c: Column, test, values) -> Column:
    return reduce(lambda a, b: a | b, (test(c, v) for v in values))


def station_class(kind: Column) -> Column:
    """Class of a station type, in the dump's or the journal's spelling; carriers are tested first."""
    k = F.lower(kind)
    has = lambda c, v: c.contains(v)
    return (
        F.when(k.contains("carrier"), "carrier")
        .when(_any(k, has, ("construction depot", "constructiondepot")), "construction_depot")
        .when(k.contains("settlement"), "settlement")
        .when(_any(k, has, ("starport", "asteroid base", "mega ship")) | k.isin("coriolis", "orbis", "ocellus", "bernal", "asteroidbase", "megaship"), "starport")
        .when(k.isin("planetary port", "craterport", "surfacestation"), "planetary_port")
        .when(k.contains("outpost"), "outpost")
        .otherwise("other")
    )


def class_rank(cls: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in STATION_RANK.items() for x in kv))[cls]


def is_dockable(cls: Column) -> Column:
    return cls.isin(*DOCKABLE)


def largest_pad(large: Column, medium: Column, small: Column) -> Column:
    """Null where no pad is known."""
    return F.when(large > 0, "large").when(medium > 0, "medium").when(small > 0, "small")


def pad_fits(large: Column, medium: Column, small: Column, floor: str | None) -> Column:
    """Whether some recorded pad is as large as ``floor``; unknown pads never satisfy one."""
    if floor is None:
        return F.lit(True)
    sizes = [large, medium, small][: 3 - PADS.index(floor)]
    return _any(F.lit(None), lambda _, s: F.coalesce(s, F.lit(0)) > 0, sizes)


def star_from_subtype(c: Column) -> Column:
    s = F.trim(c)
    head = lambda c, v: c.startswith(v)
    letter = s.substr(1, 1)
    return (
        F.when(s.startswith("Neutron"), "Neutron")
        .when(s.startswith("White Dwarf"), "WhiteDwarf")
        .when(s.contains("Black Hole"), "BlackHole")
        .when(_any(s, head, ("T Tauri", "Herbig")), "Proto")
        .when(_any(s, head, ("Wolf-Rayet", "C ", "CN", "CJ", "MS", "S ")), "Exotic")
        .when(letter.isin(*"OBAFGKMLTY"), letter)
        .otherwise("Unknown")
    )


def star_from_journal(c: Column) -> Column:
    s = F.trim(c)
    return (
        F.when(s == "N", "Neutron")
        .when(s.isin("H", "SupermassiveBlackHole"), "BlackHole")
        .when(s.isin("TTS", "AeBe"), "Proto")
        .when(s.startswith("D"), "WhiteDwarf")
        .when(s.startswith("W") | s.startswith("C") | s.isin("MS", "S"), "Exotic")
        .when(s.isin(*"OBAFGKMLTY"), s)
        .otherwise("Unknown")
    )


def subtype_of(cls: Column) -> Column:
    """A subtype that reads back as the class."""
    known = F.create_map(*(F.lit(x) for kv in SUBTYPE.items() for x in kv))
    return F.coalesce(known[cls], F.when(cls.isin(*"OBAFGKMLTY"), F.concat(cls, F.lit(" Star"))), F.lit("Unknown"))


def scoopable(cls: Column) -> Column:
    return cls.isin(*SCOOPABLE)


def boost(cls: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in BOOST.items() for x in kv))[cls], F.lit(1.0))


def hazardous(cls: Column) -> Column:
    return cls.isin(*HAZARD)


def trader_kind(economy: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in TRADERS.items() for x in kv))[F.lower(economy)]


def ring_hint(material: Column) -> Column:
    """The rings to look for a material in; ``material`` as ``strings.material_key`` gives it."""
    return F.coalesce(*(F.when(material.isin(*goods), ring) for ring, goods in RING_GOODS.items()))


def ground(sub_type: Column, volcanism: Column) -> Column:
    """The survey's column for a surface."""
    kind, volc = F.lower(F.coalesce(sub_type, F.lit(""))), F.lower(F.coalesce(volcanism, F.lit("")))
    rock = F.coalesce(*(F.when(volc.contains(v), f"rock 80%+ [{v}]") for v in ("metallic magma", "rocky magma", "silicate vapour geysers")), F.when((volc == "") | volc.contains("no volcanism"), "rock 80%+ [none]"))
    return (
        F.when(kind.contains("rocky ice"), "rocky-ice")
        .when(kind.contains("high metal content"), "high-metal-content")
        .when(kind.contains("metal rich") | kind.contains("metal-rich"), "metal-rich")
        .when(kind.contains("icy"), "icy")
        .when(kind.contains("rocky"), rock)
    )


def rank_name(level: Column, ladder: list[str]) -> Column:
    names = F.array(*(F.lit(x) for x in ladder))
    elite = F.array(*(F.lit(x) for x in ("I", "II", "III", "IV", "V")))
    out = F.when(level.between(0, len(ladder) - 1), F.get(names, level.cast("int")))
    if len(ladder) == 9:
        out = out.when(level.between(9, 13), F.concat(F.lit("Elite "), F.get(elite, (level - 9).cast("int"))))
    return out.otherwise(F.concat(F.lit("rank "), level.cast("string")))
