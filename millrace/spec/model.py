"""A resolved specification and the names and policies that follow from it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from millrace.operators.history import END, History

# Columns that loads generate.
CURRENT, DELETED, DATA_HASH = "IS_CURRENT_FLAG", "IS_DELETED_FLAG", "BUSINESS_DATA_HASH"
VALID_FROM, VALID_TO = "VALID_FROM_DATETIME", "VALID_TO_DATETIME"
AUDIT = ("AUDIT_CREATED_DATETIME", "AUDIT_LAST_CHANGED_DATETIME", "AUDIT_DATA_PROCESS_KEY")
SOURCE_AUDIT = ("AUDIT_CREATED_SOURCE", "AUDIT_LAST_CHANGED_SOURCE")
GENERATED = (CURRENT, DELETED, DATA_HASH, VALID_FROM, VALID_TO, *AUDIT)


@dataclass(frozen=True)
class Field:
    """A target field: where its text comes from, its type and rules."""

    id: str
    source: dict
    data_type: str
    nullable: bool = True
    unique: bool = False
    transforms: tuple = ()
    validations: tuple = ()
    tags: tuple = ()
    description: str | None = None
    lookup: dict | None = None

    @property
    def name(self) -> str:
        return self.id.upper()

    @staticmethod
    def of(raw: dict) -> Field:
        return Field(raw["id"], raw.get("source") or {}, raw["data_type"], raw.get("nullable", True), raw.get("unique", False), tuple(raw.get("transforms") or ()), tuple(raw.get("validations") or ()), tuple((raw.get("tags") or {}).items()), raw.get("description"), raw.get("lookup"))


class Spec:
    """Read access to a checked document."""

    def __init__(self, raw: dict):
        self.raw = raw
        self.control: dict = raw.get("control_data") or {}
        self.source: dict = raw.get("source") or {}
        self.target: dict = raw.get("target") or {}
        self.scd: dict = self.control.get("scd") or {}
        self.change_type: str = self.control.get("change_type", "scd1")

    @property
    def id(self) -> str:
        return self.raw["id"]

    @property
    def generated(self) -> bool:
        """Whether this engine builds the history."""
        return self.change_type in ("scd2_auto", "scd2_derived")

    @property
    def manual(self) -> bool:
        return self.change_type == "scd2_manual"

    @property
    def quarantine(self) -> bool:
        return self.control.get("failure_mode", "fail_load") == "quarantine_row"

    @property
    def validated(self) -> bool:
        return self.control.get("validation_enabled", True)

    @cached_property
    def fields(self) -> list[Field]:
        """Declared fields, then validity fields that only the history settings declare."""
        out = [Field.of(f) for f in self.target.get("fields") or []]
        known = {f.name for f in out}
        for bound, default in (("valid_from", VALID_FROM), ("valid_to", VALID_TO)):
            v = self.validity.get(bound) or {}
            name = v.get("column", default)
            if v.get("source") and name.upper() not in known:
                out.append(Field.of({"id": name, "data_type": self.validity.get("data_type", "timestamp_ntz"), **{k: v[k] for k in ("source", "transforms", "nullable", "validations") if k in v}}))
        return out

    @property
    def validity(self) -> dict:
        return self.scd.get("validity") or {}

    @property
    def start(self) -> str | None:
        """The SQL expression of target fields that gives a derived version's start, in place of a field."""
        return (self.scd.get("valid_from_datetime") or {}).get("expression")

    @property
    def table(self) -> str:
        """schema.table of the target, in capitals."""
        schema = self.target.get("schema", "BUSINESS")
        return f"{schema}.{self.target.get('table_name') or self.target['id']}".upper()

    @property
    def staging_schema(self) -> str:
        return self.control.get("staging_schema", "INTERMEDIATE")

    @property
    def quarantine_table(self) -> str:
        q = self.control.get("quarantine") or {}
        return f"{q.get('schema') or self.staging_schema}.{q.get('table') or self.table.split('.')[1] + '__QUARANTINE'}".upper()

    @property
    def job_table(self) -> str:
        j = self.control.get("job") or {}
        return f"{j.get('schema', 'BUSINESS')}.{j.get('table', 'LOAD_JOBS')}".upper()

    @property
    def base(self) -> str:
        """The last part of the target's id, from which key names are made."""
        return self.target["id"].split("__")[-1].upper()

    @property
    def surrogate(self) -> str | None:
        return None if self.control.get("skip_surrogate_key") else f"{self.base}_KEY"

    @property
    def key_name(self) -> str | None:
        return None if self.control.get("skip_business_key") or not self.keys else f"{self.base}_BUSINESS_KEY"

    @property
    def keys(self) -> list[str]:
        return [k.upper() for k in (self.control.get("business_key") or {}).get("fields") or []]

    @property
    def hashed(self) -> list[str] | None:
        """Fields of the data hash: the configured order where included, else declaration order; None where skipped."""
        h = self.control.get("business_data_hash") or {}
        listed = [f.upper() for f in h.get("fields") or []]
        if h.get("business_data_hash_mode", "exclude") == "include" and listed:
            return listed
        out = {*self.keys, *GENERATED, *SOURCE_AUDIT, self.history.valid_from, self.history.valid_to, *listed}
        return [f.name for f in self.fields if f.name not in out]

    @property
    def skip_hash(self) -> bool:
        return bool((self.control.get("business_data_hash") or {}).get("skip_business_data_hash"))

    @cached_property
    def history(self) -> History:
        v = self.validity
        a, b = v.get("valid_from") or {}, v.get("valid_to") or {}
        old = self.scd.get("valid_to_datetime") or {}
        offset = b.get("offset") or old.get("offset")
        kind = v.get("data_type", "timestamp_ntz")
        dates = kind == "date"
        extra = {}
        if offset:
            unit, n = offset.get("unit", "nanosecond"), abs(int(offset.get("value", -1)))
            # Spark keeps microseconds: shorter steps become one.
            extra["offset"] = f"interval {n} {unit}" if unit in ("day", "second") else f"interval {max(1, n // 1000)} microsecond"
        end = b.get("end_of_time") or old.get("end_of_time")
        if end:
            extra["end"] = str(end).replace("T", " ")[:19]
        order = tuple((str(o["column"]).upper(), o.get("direction", "desc"), o.get("nulls", "last")) for o in (self.scd.get("deduplicate") or {}).get("order_by") or [])
        return History(
            (self.key_name or f"{self.base}_BUSINESS_KEY",), "derived" if self.change_type == "scd2_derived" else "auto",
            a.get("column", VALID_FROM).upper(), b.get("column", VALID_TO).upper(), CURRENT, DELETED, DATA_HASH,
            self.scd.get("scd2_auto_from_sot", True), dates, order=order, **{"end": END, **extra},
        )

    @property
    def update_keys(self) -> list[str]:
        """Business key fields and update key of a manual upsert."""
        more = self.scd.get("update_key") or [self.history.valid_from]
        more = more.get("fields", []) if isinstance(more, dict) else more
        return [*self.keys, *[c.upper() for c in more if c.upper() not in self.keys]]

    @property
    def window_mode(self) -> str | None:
        return self.scd.get("scd2_validation", "continuous") if self.scd.get("scd2_validation_enabled", True) else None

    @property
    def whole_validation(self) -> bool:
        """Whether windows of the whole target are checked after a load."""
        return self.change_type == "scd2_auto" or self.scd.get("validation_scope") == "full_target"
