"""Validation rules: each gives a message where a row breaks it, else null."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.spec.types import SqlType, parse_type


def _said(name: str, what: str) -> Column:
    return F.lit(f"field `{name}` {what}")


def full_match(x: Column, pattern: str) -> Column:
    """Whether the whole string fits the regular expression."""
    return x.rlike(rf"\A(?:{pattern})\z")


def typed_failure(name: str, x: Column, kind: SqlType) -> Column | None:
    """Length and castability of a declared type."""
    text = x.cast("string")
    if kind.base == "string":
        return F.when(F.length(text) > kind.length, _said(name, f"exceeds data_type `{kind.text}`")) if kind.length else None
    return F.when(x.isNotNull() & text.try_cast(kind.spark).isNull(), _said(name, f"does not match data_type `{kind.text}`"))


def rule_failure(name: str, x: Column, rule: dict, macros: dict[str, Callable] | None = None) -> Column:
    """One declared rule; a null value breaks none."""
    text, kind, value = x.cast("string"), rule["type"], rule.get("value")
    if kind == "min_length":
        return F.when(F.length(text) < int(value), _said(name, f"length is less than {value}"))
    if kind == "max_length":
        return F.when(F.length(text) > int(value), _said(name, f"length is greater than {value}"))
    if kind == "regex":
        return F.when(~full_match(text, rule.get("pattern", value)), _said(name, "does not match regex"))
    if kind == "allowed_values":
        allowed = [str(v) for v in rule.get("values", value)]
        return F.when(~text.isin(allowed), _said(name, "is not one of the allowed values"))
    if kind in ("min_value", "max_value"):
        bound = Decimal(str(value))
        number = text.try_cast(f"decimal(38,{max(6, -bound.as_tuple().exponent)})")
        limit = F.lit(str(bound)).cast(f"decimal(38,{max(6, -bound.as_tuple().exponent)})")
        return F.when(number < limit, _said(name, f"is less than {value}")) if kind == "min_value" else F.when(number > limit, _said(name, f"is greater than {value}"))
    if kind == "precision":
        fits = text.try_cast(f"decimal({rule['precision']},{rule.get('scale', 0)})")
        return F.when(x.isNotNull() & fits.isNull(), _said(name, "does not fit validation precision/scale"))
    if kind == "custom":
        told = {"field": name, "rule": rule} if getattr(macros, "context", False) else {}
        return (macros or {})[rule["macro"]](x, **{**told, **rule.get("args", {})})
    raise ValueError(f"unknown rule {kind}")


def field_failures(name: str, x: Column, data_type: str, nullable: bool = True, rules: list[dict] = (), parse_failures: list[Column] = (), macros: dict[str, Callable] | None = None) -> list[Column]:
    """All messages of a field in their order: parsing, null, type, rules."""
    out = [F.when(f.isNotNull(), F.concat(F.lit(f"field `{name}` "), f)) for f in parse_failures]
    if not nullable:
        out.append(F.when(x.isNull(), _said(name, "is null but not nullable")))
    typed = typed_failure(name, x, parse_type(data_type))
    return [*out, *([typed] if typed is not None else []), *(rule_failure(name, x, r, macros) for r in rules)]


def unique_failure(name: str, repeated: Column) -> Column:
    """All rows that share a value of a unique field, as `operators.verdict.mark_repeated` has marked them."""
    return F.when(repeated, _said(name, "duplicates a value for a unique field"))
