"""Place texts: normal form, cache key, cached answers, precision tiers and confidence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from heirloom.config import DEFAULTS, TIERS
from heirloom.functions.text import SPACE, group, squeezed, trimmed

# Postal codes of the states and the federal district.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
    "DC": "District of Columbia",
}
COUNTY_SUFFIXES = ("Co", "Co.", "Cnty", "Cnty.")

#: What parts end with, and what that stands for.
ENDINGS = dict.fromkeys(COUNTY_SUFFIXES, "County")

#: Fields of a cached answer, in the order in which they are written.
RESOLUTION = "normalized string, lat double, lon double, precisionTier string, admin1 string, admin2 string, country string, confidence double, source string"
QUALIFIER = rf"\A((?i:of|near|probably|prob\.)){SPACE}+"


def qualifier_of(raw: Column) -> Column:
    """The word that the part before the first comma starts with and that the normal form drops, or null."""
    return group(squeezed(F.element_at(F.split(raw, ","), 1)), QUALIFIER, 1)


def _expanded(part: Column, states: Mapping[str, str], endings: Mapping[str, str]) -> Column:
    """A part that is an alias becomes what it stands for; else the longest alias at its end, after a blank or alone, is written out.  Case doesn't matter."""
    table = F.create_map(*[F.lit(x) for k, v in states.items() for x in (k.upper(), v)]) if states else F.create_map().cast("map<string,string>")
    out = part
    for k in sorted(endings, key=lambda k: (len(k), k)):
        ends = rf"(?iu)(\A| )\Q{k}\E\z"
        out = F.when(part.rlike(ends), F.concat(F.regexp_replace(part, ends, "$1"), F.lit(endings[k]))).otherwise(out)
    return F.coalesce(F.try_element_at(table, F.upper(part)), out)


def normalize_place(raw: Column, states: Mapping[str, str] = STATES, endings: Mapping[str, str] = ENDINGS) -> Column:
    """Parts between commas, squeezed and expanded, without a leading qualifier and without empty parts."""
    parts = F.transform(F.split(raw, ","), squeezed)
    first = trimmed(F.regexp_replace(F.element_at(parts, 1), QUALIFIER, ""))
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    kept = F.filter(F.concat(F.array(first), rest), lambda p: p != "")
    return F.array_join(F.transform(kept, lambda p: _expanded(p, states, endings)), ", ")


def cache_key(normalized: Column) -> Column:
    return F.sha2(F.lower(normalized), 256)


def parse_resolution(json: Column) -> Column:
    """A cached answer as a struct; null if it is malformed, a field has the wrong type, or the tier is none.

    Numbers where texts are due, and the reverse, count as malformed: null for fields that may be null, and a
    missing answer for the others.
    """
    raw = F.from_json(json, "map<string,string>")
    quoted = lambda k: json.rlike(rf'"{k}"\s*:\s*"')
    number = lambda k: json.rlike(rf'"{k}"\s*:\s*-?[0-9]')
    text = lambda k: F.when(quoted(k), raw[k]).alias(k)
    num = lambda k: F.when(number(k), raw[k].try_cast("double")).alias(k)
    fine = raw.isNotNull() & quoted("normalized") & quoted("source") & quoted("precisionTier") & raw["precisionTier"].isin(*TIERS) & number("confidence") & raw["confidence"].try_cast("double").isNotNull()
    fields = F.struct(text("normalized"), num("lat"), num("lon"), text("precisionTier"), text("admin1"), text("admin2"), text("country"), num("confidence"), text("source"))
    return F.when(fine, fields)


def resolution_json(value: Column) -> Column:
    """A resolution struct as JSON, nulls written out."""
    return F.to_json(value, {"ignoreNullFields": "false"})


# Place classes of each tier.
KINDS = {
    "address": ("house", "building", "residential", "road", "street"),
    "locality": ("city", "town", "village", "hamlet", "municipality", "borough", "suburb"),
    "district": ("county", "district", "parish", "state_district"),
    "region": ("state", "province", "region"),
    "country": ("country",),
}


def tier_rank(tier: Column) -> Column:
    """0 for the finest tier; unknown is the coarsest."""
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier) - 1


def tier_radius(tier: Column, radii: Mapping[str, float] | None = None) -> Column:
    """Kilometres; null for unknown."""
    found = radii or DEFAULTS["place"]["radius_km_by_tier"]
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, km in found.items():
        out = out.when(tier == name, F.lit(float(km)))
    return out


def tier_of_kind(kind: Column) -> Column:
    """Tier of a geocoder's place class."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    out = F.when(F.lit(False), F.lit("unknown"))
    for tier, kinds in KINDS.items():
        out = out.when(k.isin(*kinds), tier)
    return out.otherwise("unknown")


def unit_interval(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))


def qualified_confidence(confidence: Column, least: float) -> Column:
    """Confidence of an answer to a place text whose qualifier was dropped."""
    return unit_interval(confidence) * (F.lit(1.0) - unit_interval(F.lit(float(least))))


def review_reason(lat: Column, lon: Column, tier: Column, confidence: Column, least: float, min_tier: str) -> Column:
    """Why a person should look: unresolved, low_conf or coarse_place, in that order; null if nothing is wrong."""
    return (
        F.when(lat.isNull() | lon.isNull() | (tier == "unknown"), "unresolved")
        .when(confidence < float(least), "low_conf")
        .when(tier_rank(tier) > TIERS.index(min_tier), "coarse_place")
    )
