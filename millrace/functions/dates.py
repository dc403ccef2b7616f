"""strptime formats on Spark's parsers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strptime directives and Spark's pattern letters; single letters accept one or two digits.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s", "f": "SSSSSS", "z": "xx", "b": "MMM", "B": "MMMM", "j": "D", "p": "a", "%": "%"}
TIME_DIRECTIVES = frozenset("HIMSfp")
ZONE_DIRECTIVES = frozenset("zZ")
WEEKDAYS = frozenset("aA")


class FormatError(ValueError):
    """A format that cannot be parsed with."""


def directives(fmt: str) -> list[str]:
    """The letters after each % of a format."""
    found = re.findall(r"%(.?)", fmt.replace("%%", "%\0"))
    return ["%" if d == "\0" else d for d in found]


def has_time(fmt: str) -> bool:
    return any(d in TIME_DIRECTIVES for d in directives(fmt))


def has_zone(fmt: str) -> bool:
    return any(d in ZONE_DIRECTIVES for d in directives(fmt))


def spark_pattern(fmt: str) -> str:
    """The Spark pattern of a strptime format; week days are left out, as Spark cannot parse them."""
    out, at = [], 0
    while at < len(fmt):
        c = fmt[at]
        if c == "%":
            if at + 1 == len(fmt):
                raise FormatError(f"format ends in %: {fmt}")
            d = fmt[at + 1]
            if d not in WEEKDAYS:
                if d not in DIRECTIVES:
                    raise FormatError(f"unsupported directive %{d} in {fmt}")
                out.append(DIRECTIVES[d])
            at += 2
        else:
            out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
            at += 1
    return "".join(out)


def _without_weekday(x: Column, fmt: str) -> tuple[Column, str]:
    """Text and format without a leading or trailing week day."""
    if not any(d in WEEKDAYS for d in directives(fmt)):
        return x, fmt
    for pattern, cut in ((r"^%[aA][,\s]*", r"^\p{L}+[,\s]*"), (r"[,\s]*%[aA]$", r"[,\s]*\p{L}+$")):
        if re.search(pattern, fmt):
            return F.regexp_replace(x, cut, ""), re.sub(pattern, "", fmt)
    raise FormatError(f"a week day must come first or last: {fmt}")


def parse_date(x: Column, fmt: str) -> Column:
    """The date, or null where the text does not fit the format."""
    x, fmt = _without_weekday(x, fmt)
    return F.try_to_timestamp(x, F.lit(spark_pattern(fmt))).cast("date")


def parse_timestamp(x: Column, fmt: str, timezone_if_missing: str | None = None, time_if_missing: str | None = None, local_zone: str = "UTC") -> Column:
    """The instant, or null where the text does not fit. The session's zone is UTC.

    timezone_if_missing: Z, UTC or local, needed where the format has no zone. time_if_missing: start_of_day or
    end_of_day, where it has no time.
    """
    x, fmt = _without_weekday(x, fmt)
    if "z" in directives(fmt):
        x = F.regexp_replace(F.regexp_replace(x, r"[Zz]$", "+0000"), r"([+-]\d\d):(\d\d)$", "$1$2")
    out = F.try_to_timestamp(x, F.lit(spark_pattern(fmt)))
    if time_if_missing and not has_time(fmt):  # the day is that of the zone which the text is in
        start = F.date_trunc("day", out)
        out = start if time_if_missing == "start_of_day" else start + F.expr("interval 1 day") - F.expr("interval 1 microsecond")
    if not has_zone(fmt):
        if timezone_if_missing == "local":
            out = F.to_utc_timestamp(out, local_zone)
        elif timezone_if_missing not in ("Z", "UTC"):
            raise FormatError(f"timezone_if_missing is required for {fmt}")
    return out
