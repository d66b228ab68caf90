"""Addresses, street names, seeds and links as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of street suffixes, and the ordered replacements of street-name matching.
SUFFIXES = {
    "ST": "St", "AVE": "Ave", "AV": "Ave", "AVENUE": "Ave", "BLVD": "Blvd", "CT": "Ct", "DR": "Dr", "LN": "Ln", "RD": "Rd",
    "PL": "Pl", "TER": "Ter", "WAY": "Way", "HWY": "Hwy", "PKWY": "Pkwy", "CIR": "Cir",
}
ABBREVIATIONS = [
    ("STREET", "ST"), ("AVENUE", "AVE"), ("BOULEVARD", "BLVD"), ("ROAD", "RD"), ("DRIVE", "DR"), ("LANE", "LN"),
    ("PLACE", "PL"), ("COURT", "CT"), ("CIRCLE", "CIR"), (".", ""), (",", ""),
]


def clean(value: Column) -> Column:
    """Trimmed text; null becomes the empty text."""
    return F.coalesce(F.trim(value.cast("string")), F.lit(""))


def title(value: Column) -> Column:
    """Every run of letters with a capital first letter, also after digits, hyphens and apostrophes.

    The text is cut before each letter run, each piece gets its first letter raised and the pieces are joined again.
    """
    parts = F.split(F.regexp_replace(F.lower(value), r"(\p{L}+)", "\u0001$1"), "\u0001")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def house_number(number: Column) -> Column:
    """The trimmed house number; "0" and "0000" stand for none."""
    text = clean(number)
    return F.when(text.isin("0", "0000"), "").otherwise(text)


def squeeze(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def address(number: Column, fraction: Column, before: Column, name: Column, suffix: Column, after: Column, zip_code: Column) -> Column:
    """One line: number, fraction, direction, name, suffix, direction, and ", " with the first five digits of the ZIP code.

    Null parts are empty; runs of white space become one blank; a line that is only "0" is empty; a comma at the end goes.
    """
    known = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
    nice = F.coalesce(F.try_element_at(known, F.upper(clean(suffix))), title(clean(suffix)))
    line = squeeze(F.concat_ws(" ", house_number(number), clean(fraction), clean(before), title(clean(name)), nice, clean(after)))
    line = F.when(line == "0", "").otherwise(line)
    zip5 = F.regexp_extract(clean(zip_code), r"(\d{5})", 1)
    return F.regexp_replace(F.when(zip5 == "", line).otherwise(F.concat(line, F.lit(", "), zip5)), r",\s*$", "")


def unit_blank(unit: Column) -> Column:
    """Whether the address has no unit, as single homes have."""
    return clean(unit) == ""


def street_key(name: Column) -> Column:
    """Upper-case street name with usual words abbreviated in a fixed order, dots and commas removed; null is empty."""
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), ABBREVIATIONS, F.upper(clean(name)))


def names_match(a: Column, b: Column) -> Column:
    """Whether one street key contains the other; empty names match nothing."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def seed(*parts: Column | str) -> Column:
    """A repeatable number below 2^32 - 1: the first 16 hex digits of the SHA-256 of the parts joined by a bar."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(4294967295).cast("decimal(20,0)")).cast("bigint")


def partial_seed(date: Column, worker: Column, bundle: Column) -> Column:
    return seed(date, worker, bundle, "DH", "partial")


def treatment_seed(date: Column, worker: Column, bundle: Column) -> Column:
    return seed(date, worker, bundle, "DH", "treatment")


def segment_seed(date: Column, worker: Column, segment: Column) -> Column:
    return seed(date, worker, segment, "DH", "partial")


def map_link(place: Column, prefix: str = "https://maps.example.org/?q=") -> Column:
    """A link that searches a map for the place."""
    return F.concat(F.lit(prefix), F.url_encode(place))


def sheet_id(link: Column) -> Column:
    """The document id in a spreadsheet's link; empty without one."""
    return F.regexp_extract(link, r"/d/([A-Za-z0-9_-]+)", 1)


def person_key(name: Column) -> Column:
    return F.lower(squeeze(clean(name)))


def date_in_name(path: Column) -> Column:
    """The last YYYY-MM-DD in a file name as a date; null without a valid one."""
    return F.to_date(F.try_to_timestamp(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})[^/\d]*$", 1), F.lit("yyyy-MM-dd")))


def weather_summary(payload: Column) -> Column:
    """A short sentence from a weather document: sky by code, highest temperature and chance of rain; null fields are left out."""
    w = F.from_json(payload, "code int, high double, rain int")
    sky = F.when(w["code"] == 0, "Clear").when(w["code"] <= 3, "Partly cloudy").when(w["code"] <= 48, "Fog").when(w["code"] <= 67, "Rain").when(w["code"] <= 77, "Snow").when(w["code"] <= 82, "Showers").when(w["code"] <= 99, "Thunderstorm")
    return F.concat_ws(", ", sky, F.concat(F.lit("high "), F.rint(w["high"]).cast("int").cast("string")), F.concat(F.lit("rain "), w["rain"].cast("string"), F.lit("%")))
