"""Field transforms, applied in order to a string column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import dates


def trim(x: Column, side: str = "both") -> Column:
    """Blanks only; tabs and line ends stay."""
    return {"both": F.trim, "left": F.ltrim, "right": F.rtrim}[side](x)


def _with(x: Column, made: Callable[[Column], Column]) -> Column:
    """made(x), where x is worked out once however often it is named."""
    return F.get(F.transform(F.array(x), made), F.lit(0))


def _short(x: Column) -> Column:
    """Whether x is a plain number all of whose digits fit a decimal(38,18)."""
    return (F.length(x) <= 18) & x.rlike(r"\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\z")


def _round_short(x: Column, scale: int, mode: str) -> Column:
    """round_number of a short number at up to 6 decimals (more would be shown with an exponent): compiled, unlike the parts
    of round_number that name a value several times, and so several times as fast."""
    d = x.try_cast("decimal(38,18)")
    if mode in ("half_up", "half_even"):
        out = (F.round if mode == "half_up" else F.bround)(d, scale)
    else:
        out = (F.ceil if mode == "up" else F.floor)(F.abs(d), F.lit(scale))
        out = F.when(d < 0, -out).otherwise(out)
    return out.cast("string")


def round_number(x: Column, scale: int = 0, mode: str = "half_up") -> Column:
    """The text of the number at `scale` decimals, null where the text is no number or has more than 38 digits then. Modes:
    half_up, half_even, down, up. The digits themselves decide, so that nothing is rounded twice, however many there are."""
    number = r"^\s*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*$"
    # what \s takes, and the line ends that $ passes over
    blank = F.lit(" \t\n\x0b\f\r\x85\u2028\u2029")

    def parts(text: Column) -> Column:
        """The kept digits, those cut off, and whether there is a minus."""
        bare = F.btrim(text, blank)
        plain = F.ltrim(bare, F.lit("+-"))
        whole = F.ltrim(F.substring_index(plain, ".", 1), F.lit("0"))
        rest = F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise("")
        return F.struct(whole.alias("whole"), rest.alias("rest"), bare.startswith("-").alias("minus"))

    def rounded(p: Column) -> Column:
        whole, rest = p["whole"], p["rest"]
        kept = F.concat(whole, F.rpad(F.substring(rest, 1, scale), scale, "0")) if scale else whole
        cut = F.substring(rest, scale + 1, 1 << 30)
        digits = F.when(kept == "", "0").otherwise(kept).try_cast("decimal(38,0)")
        return _with(F.struct(digits.alias("digits"), cut.alias("cut"), p["minus"].alias("minus")), bumped)

    def bumped(p: Column) -> Column:
        digits, cut = p["digits"], p["cut"]
        if mode == "half_up":
            bump = cut >= "5"
        elif mode == "half_even":
            bump = (cut >= "5") & ((F.rtrim(cut, F.lit("0")) != "5") | (digits % 2 == 1))
        else:
            bump = F.rtrim(cut, F.lit("0")) != "" if mode == "up" else F.lit(False)
        digits = F.try_add(digits, F.when(bump, 1).otherwise(0).cast("decimal(1,0)"))
        return _with(F.struct(digits.cast("string").alias("text"), ((digits != 0) & p["minus"]).alias("minus")), shown)

    def shown(p: Column) -> Column:
        text = p["text"]
        if scale:
            text = F.lpad(text, F.greatest(F.length(text), F.lit(scale + 1)), F.lit("0"))
            text = F.concat(F.substring(text, F.lit(1), F.length(text) - scale), F.lit("."), F.right(text, F.lit(scale)))
        return F.concat(F.when(p["minus"], "-").otherwise(""), text)

    # numbers with an exponent are written out first
    text = F.when(x.contains("e") | x.contains("E"), x.try_cast("decimal(38,18)").cast("string")).otherwise(x)
    whole = _with(text, lambda t: F.when(t.rlike(number), _with(parts(t), rounded)))
    return F.when(_short(x), _round_short(x, scale, mode)).otherwise(whole) if scale <= 6 else whole


def apply(x: Column, transforms: list[dict], macros: dict[str, Callable] | None = None, local_zone: str = "UTC") -> tuple[Column, list[Column]]:
    """(the transformed column, a message column for each parsing step that can fail)."""
    failures: list[Column] = []
    for t in transforms:
        kind = t["type"]
        if kind == "trim":
            x = trim(x, t.get("side", "both"))
        elif kind == "round":
            x = round_number(x, int(t.get("scale", 0)), t.get("mode", "half_up"))
        elif kind in ("parse_date", "parse_timestamp"):
            if kind == "parse_date":
                parsed = dates.parse_date(x, t["format"])
            else:
                parsed = dates.parse_timestamp(x, t["format"], t.get("timezone_if_missing"), t.get("time_if_missing"), local_zone)
            failures.append(F.when(x.isNotNull() & parsed.isNull(), F.lit(f"does not match {kind} format `{t['format']}`")))
            x = parsed
        elif kind == "custom":
            x = (macros or {})[t["macro"]](x, **t.get("args", {}))
        else:
            raise ValueError(f"unknown transform {kind}")
    return x, failures
