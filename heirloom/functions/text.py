"""Text helpers with one notion of white space, wider than Java's: no-break and Unicode spaces and the byte order mark count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NO_SPACE = SPACE.replace("[", "[^", 1)

#: Any character but a line end.
ANY = r"[^\n\r\x{2028}\x{2029}]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def squeezed(c: Column) -> Column:
    """Trimmed, with runs of white space as one blank."""
    return F.regexp_replace(trimmed(c), rf"{SPACE}+", " ")


def filled(c: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(c, F.lit(""))


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """Group ``n`` of the pattern, or null where the pattern doesn't match or the group takes no part."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, n))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
