"""Names, symbols and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Economies whose symbol does not simply split at its capitals.
ECONOMIES = {"agri": "Agriculture", "agriculture": "Agriculture", "hightech": "High Tech", "high tech": "High Tech", "privateenterprise": "Private Enterprise", "private enterprise": "Private Enterprise", "none": "None"}
# Ring classes that are renamed.
RINGS = {"Metalic": "Metallic", "Metallic": "Metallic", "MetalRich": "Metal Rich", "Rocky": "Rocky", "Icy": "Icy"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def canonical_symbol(c: Column) -> Column:
    """Trimmed, lower-cased, freed of ``$..._name;``."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^\$(.+?)_name;?$", "$1")


def is_display_name(c: Column) -> Column:
    return c.rlike("[ .-]")


def material_key(c: Column) -> Column:
    """Letters and digits in lower case, without one plural s."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), "s$", "")


def _unwrapped(c: Column, kind: str) -> Column:
    s = F.trim(c)
    return F.when(s.startswith(f"${kind}_"), F.regexp_replace(F.regexp_replace(s, rf"^\${kind}_", ""), ";$", "")).otherwise(s)


def split_capitals(c: Column) -> Column:
    return F.when(c.contains(" "), c).otherwise(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"))


def economy_name(c: Column) -> Column:
    """``$economy_HighTech;`` as ``High Tech``."""
    inner = _unwrapped(c, "economy")
    return F.coalesce(_lookup(ECONOMIES, F.lower(inner)), split_capitals(inner))


def government_name(c: Column) -> Column:
    return split_capitals(_unwrapped(c, "government"))


def security_name(c: Column) -> Column:
    """``$SYSTEM_SECURITY_low;`` as ``Low``; plain names stay."""
    s = F.trim(c)
    key = F.lower(F.regexp_extract(s, "([^_$;]*);?$", 1))
    return F.when(~s.startswith("$"), s).otherwise(title_first(key))


def ring_kind(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), "^(eRingClass_)+", "")
    return F.when(bare != "", F.coalesce(_lookup(RINGS, bare), bare))


def ring_parent(c: Column) -> Column:
    """The body that a ring's name belongs to; null if it names no ring."""
    found = F.regexp_extract(F.trim(c), "^(.*) [A-Z] Ring$", 1)
    return F.when(found != "", found)


def title_first(c: Column) -> Column:
    return F.concat(F.upper(c.substr(F.lit(1), F.lit(1))), c.substr(F.lit(2), F.length(c)))


def service_key(c: Column) -> Column:
    """Friendly, spaced and raw keys as one raw key."""
    return F.regexp_replace(F.lower(F.trim(c)), "[ _]", "")


def mission_kind(c: Column) -> Column:
    """The word after ``Mission_``."""
    return F.element_at(F.split(F.regexp_replace(F.lower(c), "^mission_", ""), "_"), 1)


def is_callsign(c: Column) -> Column:
    return c.rlike("^[A-Z0-9]{3}-[A-Z0-9]{3}$")


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[_-]", "")


def split_list(c: Column) -> Column:
    """A comma-separated list, trimmed, without empty entries."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def symbol_set(c: Column) -> Column:
    """Lower-cased distinct symbols in order; not trimmed."""
    return F.array_sort(F.array_distinct(F.transform(c, lambda x: F.lower(x))))


def short_number(c: Column) -> Column:
    """1,234 as 1.2k, 5,600,000 as 5.6m."""
    size = F.abs(c)
    shorter = lambda by, mark: F.concat(F.format_string("%.1f", c / F.lit(float(by))), F.lit(mark))
    return F.when(size >= 10**9, shorter(10**9, "b")).when(size >= 10**6, shorter(10**6, "m")).when(size >= 1000, shorter(1000, "k")).otherwise(c.cast("string"))


def localised(named: Column, raw: Column) -> Column:
    return F.coalesce(named, raw)
