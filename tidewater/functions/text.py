"""Text expressions: destinations, coordinates, tolerant numbers, search patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.geo import c

#: Destinations that say nothing, after upper-casing. Fixed values.
JUNK = ("^[?@]{2,}$", "^-{3,}$", "^0+$", "^[Xx]{2,}$", "^\\+?$")


def clean_destination(raw) -> Column:
    """Trimmed, upper case, printable ASCII with single spaces; null where nothing useful of two characters is left."""
    s = F.regexp_replace(F.upper(F.regexp_replace(c(raw), r"^\s+|\s+$", "")), r"[^\x20-\x7E]", "")
    junk = F.lit(False)
    for p in JUNK:
        junk = junk | s.rlike(p)
    tidy = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(~junk & (F.length(tidy) >= 2), tidy)


def coordinate(raw) -> tuple[Column, Column]:
    """Latitude and longitude of '4230N 00131E'; both null where it is malformed."""
    shape = r"^\s*(\d{2})(\d{2})([NS])\S*\s+(\d{3})(\d{2})([EW])\S*\s*$"
    part = lambda k: F.nullif(F.regexp_extract(c(raw), shape, k), F.lit(""))
    lat = part(1).cast("double") + part(2).cast("double") / 60.0
    lon = part(4).cast("double") + part(5).cast("double") / 60.0
    return F.when(part(3) == "S", -lat).otherwise(lat), F.when(part(6) == "W", -lon).otherwise(lon)


def tolerant_int(text, kind: str = "int") -> Column:
    """A whole number from text such as '12.7' or '1e3', rounded half to even; null where unreadable or too large."""
    d = F.rint(c(text).try_cast("double"))
    top = {"tinyint": 127, "smallint": 32767, "int": 2147483647, "bigint": 9.2e18}[kind]
    return F.when(d.between(-top - 1, top), d.cast(kind))


def without_tokens(text, tokens: tuple[str, ...] = ("", "NA", "N/A", "nan", "none", "None", "NULL")) -> Column:
    return F.when(~c(text).isin(*tokens), c(text))


def imo(text) -> Column:
    return F.regexp_replace(c(text), "^IMO", "").try_cast("int")


def is_locode(text) -> Column:
    return c(text).rlike("^[A-Z]{2}[A-Z0-9]{3}$")


def contains(column, text: str) -> Column:
    """Case-insensitive containment; wildcards in the text stand for themselves."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return c(column).ilike(f"%{escaped}%")


def row_key(*columns) -> Column:
    """A digest of some columns, nulls passed over."""
    return F.md5(F.concat_ws("|", *[c(x).cast("string") for x in columns]))
