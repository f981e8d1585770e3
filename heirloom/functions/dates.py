"""Free-form genealogical dates to inclusive intervals, as Spark columns.

Interval ends are ISO texts: years reach from 0 to beyond 9999 after widening, which date columns hold but clients
often cannot, and comparisons follow the texts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from heirloom.config import DEFAULTS
from heirloom.functions.text import filled, group, let, squeezed, trimmed

MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

#: What a date column becomes.
DATE_TYPE = "struct<date_start:string,date_end:string,precision:string,qualifier:string,parse_status:string,reason:string>"


def iso(year: Column, month: Column | int, day: Column | int) -> Column:
    part = lambda c: F.lit(c) if isinstance(c, int) else c
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), part(month).cast("int"), part(day).cast("int"))
    return F.when(year.isNotNull() & part(month).isNotNull() & part(day).isNotNull(), text)


def iso_of(day: Column) -> Column:
    """The text of a date, of years outside 1 to 9999 too."""
    return F.when(day.isNotNull(), iso(F.year(day), F.month(day), F.dayofmonth(day)))


def month_number(name: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)
    return F.when(at > 0, at.cast("int"))


def days_in_month(year: Column, month: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def year_number(digits: Column) -> Column:
    """Of one to four digits a year from 1; else null."""
    return F.when(F.length(digits) <= 4, F.nullif(digits.try_cast("int"), F.lit(0)))


#: The forms of a date with one value: ``9 JUN 1850``, ``JUN 1850``; ``1850/51``, ``1850``.
BASIC = r"\A(?:(?:([0-9]{1,2}) +)?([A-Z]{3}) +([0-9]{1,4})|([0-9]{1,4})(?:/([0-9]{2,4}))?)\z"


def basic_date(raw: Column) -> Column:
    """Struct y1, m1, d1, y2, m2, d2, precision of a date of one of the forms of BASIC; null if it is none or no real date."""
    part = lambda t, n: filled(F.regexp_extract(t, BASIC, n))
    parts = lambda t: F.struct(part(t, 1).cast("int").alias("day"), part(t, 2).alias("name"), F.coalesce(part(t, 3), part(t, 4)).alias("year"), part(t, 5).alias("next"))
    numbers = lambda p: F.struct(p["day"].alias("day"), p["name"].alias("name"), month_number(p["name"]).alias("month"), year_number(p["year"]).alias("year"), p["next"].alias("next"))
    return let(let(let(F.upper(trimmed(raw)), parts), numbers), _basic)


def _basic(p: Column) -> Column:
    day, month, year, more = p["day"], p["month"], p["year"], p["next"]
    second = F.when(F.length(more) == 2, F.floor(year / 100).cast("int") * 100 + more.cast("int")).otherwise(year_number(more))
    last = F.when(month.isNull(), 31).otherwise(days_in_month(year, month))
    real = year.isNotNull() & (p["name"].isNull() | month.isNotNull()) & (day.isNull() | day.between(1, last)) & (more.isNull() | (second == year + 1))
    fields = {"y1": year, "m1": F.coalesce(month, F.lit(1)), "d1": F.coalesce(day, F.lit(1)), "y2": F.coalesce(second, year), "m2": F.coalesce(month, F.lit(12)), "d2": F.coalesce(day, last)}
    precision = F.when(day.isNotNull(), "day").when(month.isNotNull(), "month").otherwise("year")
    return F.when(real, F.struct(*[v.cast("int").alias(k) for k, v in fields.items()], precision.alias("precision")))


#: The forms of a date with a qualifier.
FORM = r"(?s)\A(?:BET +(.+) +AND +(.+)|FROM +(.+) +TO +(.+)|(ABT|CAL|EST|BEF|AFT) +(.+))\z"


def lexical_form(raw: Column) -> Column:
    """Upper case, single blanks, no dot after a qualifier, ``BET x AND y`` for dashes."""
    text = F.regexp_replace(F.upper(squeezed(raw)), r"\A(ABT|CAL|EST|BEF|AFT|BET)\. ?", "$1 ")
    return F.regexp_replace(text, r"(?s)\ABET +(.+?) *[–—-] *(.+)\z", "BET $1 AND $2")


def _start(b: Column) -> Column:
    return iso(b["y1"], b["m1"], b["d1"])


def _end(b: Column) -> Column:
    return iso(b["y2"], b["m2"], b["d2"])


def _moved(y: Column, m: Column, d: Column, days: int) -> Column:
    return iso_of(F.date_add(F.make_date(y, m, d), days))


def normalize_date(raw: Column, life_start: Column | None = None, life_end: Column | None = None, settings: Mapping | None = None) -> Column:
    """Struct of DATE_TYPE: an interval with precision, qualifier and status, or nulls and a reason.

    ``life_start`` and ``life_end`` (ISO texts) clamp BEF and AFT.
    """
    s = settings or DEFAULTS["date"]
    none = F.lit(None).cast("string")
    life_start, life_end = none if life_start is None else life_start, none if life_end is None else life_end
    calendar_form = r"(?s)\A(@#D[^@]+@) *(.*)\z"

    def parted(whole):
        calendar = group(whole, calendar_form, 1)
        return F.struct(calendar.alias("calendar"), F.when(calendar.isNotNull(), group(whole, calendar_form, 2)).otherwise(whole).alias("text"))

    body = let(let(lexical_form(raw), parted), lambda p: _interval(p["calendar"], p["text"], life_start, life_end, s))
    return F.when(raw.isNull() | (trimmed(raw) == ""), _missing("empty")).otherwise(body)


def _missing(reason) -> Column:
    none = F.lit(None).cast("string")
    r = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(*[none.alias(n) for n in ("date_start", "date_end", "precision", "qualifier", "parse_status")], r.alias("reason"))


def _interval(calendar: Column, text: Column, life_start: Column, life_end: Column, s: Mapping) -> Column:
    none = F.lit(None).cast("string")
    missing = _missing
    mark = F.when(calendar.isNull(), "").otherwise(F.concat(calendar, F.lit(" ")))
    status = F.when(calendar == "@#DJULIAN@", "partial").otherwise("ok")

    def found(start, end, precision, qualifier):
        p = F.lit(precision) if isinstance(precision, str) else precision
        return F.struct(start.alias("date_start"), end.alias("date_end"), p.alias("precision"), qualifier.alias("qualifier"), status.alias("parse_status"), none.alias("reason"))

    part = lambda n: filled(F.regexp_extract(text, FORM, n))
    kind = F.when(part(1).isNotNull(), "BET").when(part(3).isNotNull(), "FROM TO").otherwise(part(5))
    operands = F.array(F.coalesce(part(1), part(3), part(6), text), F.coalesce(part(2), part(4)))
    reach, days = int(s["open_interval_fallback_years"]), int(s["pre_1752_widen_days"])

    def of(form):
        word, p, right = form["kind"], F.get(form["dates"], F.lit(0)), F.get(form["dates"], F.lit(1))
        ranged = F.when(p.isNull() | right.isNull() | (_start(p) > _end(right)), missing("invalid range")).otherwise(found(_start(p), _end(right), "range", F.concat(mark, word)))
        years = F.when(word == "ABT", int(s["abt_years"])).when(word == "CAL", int(s["cal_years"])).otherwise(int(s["est_years"]))
        rough = F.when(p.isNull(), missing("invalid qualified date")).otherwise(found(iso(F.greatest(F.lit(1), p["y1"] - years), 1, 1), iso(p["y2"] + years, 12, 31), "year", F.concat(mark, word)))
        before = word == "BEF"
        start = F.when(before, F.coalesce(life_start, iso(F.greatest(F.lit(1), p["y1"] - reach), 1, 1))).otherwise(_moved(p["y2"], p["m2"], p["d2"], 1))
        end = F.when(before, _moved(p["y1"], p["m1"], p["d1"], -1)).otherwise(F.coalesce(life_end, iso(p["y2"] + reach, 12, 31)))
        known = F.when(before, life_start).otherwise(life_end)
        clamped = lambda e: F.when(e["a"] > e["z"], missing("outside lifespan")).otherwise(found(e["a"], e["z"], F.when(known.isNull(), "inferred").otherwise("range"), F.concat(mark, word)))
        opened = F.when(p.isNull(), missing("invalid open date")).otherwise(let(F.struct(start.alias("a"), end.alias("z")), clamped))
        early = calendar.isNull() & (p["y1"] < 1752)
        at = lambda moved, plain: F.when(early, moved).otherwise(plain)
        exact = found(at(_moved(p["y1"], p["m1"], p["d1"], -days), _start(p)), at(_moved(p["y2"], p["m2"], p["d2"], days), _end(p)), p["precision"], calendar)
        return (
            F.when(word.isin("BET", "FROM TO"), ranged)
            .when(word.isin("BEF", "AFT"), opened)
            .when(word.isNotNull(), rough)
            .otherwise(F.when(p.isNull(), missing("unrecognized date")).otherwise(exact))
        )

    parsed = let(F.struct(kind.alias("kind"), operands.alias("texts")), lambda f: F.struct(f["kind"].alias("kind"), F.transform(f["texts"], basic_date).alias("dates")))
    strange = calendar.isNotNull() & ~calendar.isin("@#DGREGORIAN@", "@#DJULIAN@")
    return F.when(strange, missing(F.concat(F.lit("unsupported calendar "), calendar))).otherwise(let(parsed, of))
