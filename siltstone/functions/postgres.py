"""PostgreSQL's formatting functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

# PostgreSQL's template patterns and Spark's.
PATTERNS = {
    "YYYY": "yyyy", "YY": "yy", "MM": "MM", "MON": "MMM", "Mon": "MMM", "MONTH": "MMMM", "Month": "MMMM", "DDD": "DDD", "DD": "dd", "DAY": "EEEE", "Day": "EEEE", "DY": "EEE", "Dy": "EEE",
    "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a", "am": "a", "pm": "a", "TZ": "VV", "OF": "xx",
}
#: Those that Spark's patterns don't have: ISO years and weeks, weeks counted from January 1st, the day of the week (Sunday is 1).
COMPUTED = {
    "IYYY": lambda d: F.lpad(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), 4, "0"),
    "IY": lambda d: F.right(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit(2)),
    "IW": lambda d: F.lpad(F.weekofyear(d).cast("string"), 2, "0"),
    "WW": lambda d: F.lpad((F.floor((F.dayofyear(d) - 1) / 7) + 1).cast("string"), 2, "0"),
    "D": lambda d: F.dayofweek(d).cast("string"),
    "Q": lambda d: F.quarter(d).cast("string"),
}
_ONE = re.compile("|".join(sorted([*PATTERNS, *COMPUTED], key=len, reverse=True)) + r"|\"[^\"]*\"|[A-Za-z]|[^A-Za-z\"]+")


def _parts(template: str) -> Iterator[tuple[str, str]]:
    """The template's codes and the texts between them, read once from left to right."""
    for part in _ONE.findall(template):
        if part in PATTERNS or part in COMPUTED:
            yield "code", part
        elif part[0] == '"':
            yield "text", part.strip('"')
        elif part in ("T", "Z"):
            yield "text", part
        elif part[0].isalpha():
            raise ValueError(f"{part!r} in the template {template!r} is no pattern; texts go between double quotes")
        else:
            yield "text", part


def pattern(template: str) -> str:
    """Spark's datetime pattern for a PostgreSQL template."""
    out = []
    for kind, part in _parts(template):
        if part in COMPUTED and kind == "code":
            raise ValueError(f"{part} can be written, not read")
        out.append(PATTERNS[part] if kind == "code" else _quoted(part))
    return "".join(out)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if re.search(r"[A-Za-z'\[\]#{}]", text) else text


def to_char(value: Column, template: str) -> Column:
    """A date or timestamp as text."""
    pieces, held = [], ""

    def flush() -> None:
        nonlocal held
        if held:
            pieces.append(F.date_format(value, held))
            held = ""

    for kind, part in _parts(template):
        if kind == "code" and part in COMPUTED:
            flush()
            pieces.append(COMPUTED[part](value))
        else:
            held += PATTERNS[part] if kind == "code" else _quoted(part)
    flush()
    return F.concat(*pieces) if pieces else F.when(value.isNotNull(), F.lit(""))


def to_date(text: Column, template: str) -> Column:
    return F.to_date(text, pattern(template))


def to_timestamp(text: Column, template: str) -> Column:
    return F.to_timestamp_ntz(text, F.lit(pattern(template)))


def try_to_timestamp(text: Column, template: str) -> Column:
    """Null for a text that isn't of the template's form."""
    return F.try_to_timestamp(text, F.lit(pattern(template)))


def to_number(text: Column, template: str | None = None) -> Column:
    """A number of a template of 9, 0, D, G, ``.``, ``,``, S, MI, PR, L and FM, as a double; without one, grouping commas are dropped.

    The template says which signs there may be and where the fraction begins; digits beyond it are an error in PostgreSQL and are
    null here, as is a text that is no such number.
    """
    if template is None:
        return F.replace(text, F.lit(","), F.lit("")).cast("double")
    if left := re.sub(r"FM|MI|PR|[90DGSL.,$ ]", "", template):
        raise ValueError(f"{left!r} in the template {template!r} is no pattern")
    before, _, after = re.sub(r"[^90.D]", "", template).replace("D", ".").partition(".")
    plain = F.regexp_replace(F.regexp_replace(text, r"[,\s$€£]", ""), r"^\+", "")
    plain = F.regexp_replace(plain, r"^<(.*)>$" if "PR" in template else r"^([^-]*)-$", "-$1")
    whole = F.when(plain.rlike(rf"^-?[0-9]{{0,{len(before)}}}(?:\.[0-9]{{0,{len(after)}}})?$") & plain.rlike("[0-9]"), plain)
    return whole.cast("double")


def age(value: Column) -> Column:
    """Days from a date or timestamp to today."""
    return F.datediff(F.current_date(), value.cast("date"))


def regexp_matches(text: Column, regexp: str) -> Column:
    """All matches, whole."""
    return F.regexp_extract_all(text, F.lit(regexp), F.lit(0))
