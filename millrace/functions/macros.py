"""Custom transforms, validations and sources by dotted name.

A macro is a Python function or an object of a module `<folder>/<module>.py`:

* a transform or validation has `column(x, **args)` or is itself such a function of a Column; a validation gives null or true
  for a valid value, false or a message for others;
* one that only has `execute(value, **args)` runs over Arrow batches; of row, field and rule it gets what it names;
* a source takes (df, field, args) and returns df with a column named by the field.
"""

from __future__ import annotations

import importlib
import importlib.util
import inspect
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class MacroError(ValueError):
    """A macro that is not there or breaks the contract."""


def _accepted(f: Callable, args: dict) -> dict:
    """The arguments that the signature takes."""
    parameters = inspect.signature(f).parameters
    if any(p.kind is p.VAR_KEYWORD for p in parameters.values()):
        return args
    return {k: v for k, v in args.items() if k in parameters}


def normalise_account_name(x: Column) -> Column:
    """Trimmed capitals; null where nothing is left."""
    return F.nullif(F.upper(F.trim(x)), F.lit(""))


# Fixed value: the message of the sample rule.
_NOT_AN_ACCOUNT = "account number must use ACCT followed by 12 non-zero-sequence digits"


def validate_account_number(x: Column) -> Column:
    """ACCT and twelve digits that are not all zero."""
    good = x.rlike(r"\AACCT[0-9]{12}\z") & (x != "ACCT000000000000")
    return F.when(~good, _NOT_AN_ACCOUNT)


#: Macros that need no file.
BUILT_IN = {"account_macros.normalise_account_name": normalise_account_name, "account_macros.validate_account_number": validate_account_number}


class Macros:
    """Finds macros in folders, in their order, then among the built-in ones; modules are loaded once."""

    def __init__(self, folders: list[str | Path] = (), registered: dict[str, Callable] | None = None):
        self.folders = [Path(f) for f in folders]
        self.registered = {**BUILT_IN, **(registered or {})}
        self._modules: dict[Path, object] = {}

    def find(self, name: str):
        module, _, attribute = name.rpartition(".")
        for folder in self.folders:
            path = folder / (module.replace(".", "/") + ".py")
            if path.is_file():
                if path not in self._modules:
                    loader = importlib.util.spec_from_file_location(f"macro_{module.replace('.', '_')}", path)
                    self._modules[path] = importlib.util.module_from_spec(loader)
                    loader.loader.exec_module(self._modules[path])
                found = getattr(self._modules[path], attribute, None)
                if found is None:
                    raise MacroError(f"`{attribute}` is not in {path}")
                return found
        if name in self.registered:
            return self.registered[name]
        raise MacroError(f"macro `{name}` was not found")

    def __getitem__(self, name: str) -> Callable[..., Column]:
        """The macro as a function of a Column."""
        found = self.find(name)
        f = getattr(found, "column", None) or (found if callable(found) and not hasattr(found, "execute") else None)
        if f is not None:

            def call(x: Column, **args) -> Column:
                out = f(x, **_accepted(f, args))
                if not isinstance(out, Column):
                    raise MacroError(f"macro `{name}` must return a Column")
                return out

            return call
        if hasattr(found, "execute"):
            return lambda x, **args: _batched(found.execute, args)(x)
        raise MacroError(f"macro `{name}` has neither column nor execute")

    def validation(self, name: str) -> Callable[..., Column]:
        """The macro as a rule: its message, or a general one for false."""

        def call(x: Column, **args) -> Column:
            text = self[name](x, **args).cast("string")
            return F.when(text == "false", F.lit(f"validation `{name}` failed")).when(text != "true", text)

        return call

    def source(self, name: str) -> Callable:
        found = self.find(name)
        f = getattr(found, "source", None) or found
        if not callable(f):
            raise MacroError(f"macro `{name}` cannot be called")
        return f


def _batched(execute: Callable, args: dict):
    """execute over batches: it gets the value, of args those that it takes, and the row as a mapping where it takes `row`."""
    accepted = _accepted(execute, args)
    takes = inspect.signature(execute).parameters
    by_name, with_row = "value" in takes, "row" in takes

    def one(v, row):
        if v is None:
            return None
        more = {**accepted, "row": row} if with_row else accepted
        out = execute(value=v, **more) if by_name else execute(v, **more)
        return None if out is None else str(out).lower() if isinstance(out, bool) else str(out)

    if with_row:

        @F.pandas_udf("string")
        def rows(values: pd.Series, row: pd.DataFrame) -> pd.Series:
            return pd.Series([one(None if pd.isna(v) else v, r) for v, r in zip(values, row.to_dict("records"), strict=True)], dtype="object")

        return lambda x: rows(x.cast("string"), F.struct("*"))

    @F.pandas_udf("string")
    def batch(values: pd.Series) -> pd.Series:
        return values.map(lambda v: one(v, None), na_action="ignore").astype("object")

    return lambda x: batch(x.cast("string"))


class Rules:
    """Macros as validations, for functions.rules; they are told the field and the rule too."""

    context = True

    def __init__(self, macros: Macros):
        self.macros = macros

    def __getitem__(self, name: str):
        return self.macros.validation(name)
