"""Checks of a resolved document: its structure first, then what it means."""

from __future__ import annotations

import re

from millrace.functions import dates
from millrace.spec.load import SpecError
from millrace.spec.model import GENERATED, VALID_FROM, Spec
from millrace.spec.types import TypeError_, parse_type

Problem = tuple[str, str]
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*")
_ANY, _TEXT, _FLAG, _NUMBER, _LIST, _MAP = object, str, bool, int, list, dict

# The keys of each block. A set lists the allowed words, a string names another block, a one-element list
# holds the block of the list's elements.
BLOCKS: dict[str, dict] = {
    "spec": {"id": _TEXT, "description": _TEXT, "extends": _TEXT, "control_data": "control", "source": "source", "target": "target"},
    "control": {
        "materialisation_type": {"table"}, "failure_mode": {"fail_load", "quarantine_row"}, "validation_enabled": _FLAG,
        "change_type": {"scd1", "scd2_manual", "scd2_auto", "scd2_derived"}, "truncate_before_load": _FLAG, "business_key": "names",
        "skip_business_key": _FLAG, "skip_surrogate_key": _FLAG, "business_data_hash": "hash", "staging_schema": _TEXT, "scd": "scd",
        "quarantine": "relation", "job": "relation", "incremental_bookmark": "bookmark",
    },
    "names": {"fields": _LIST},
    "hash": {"skip_business_data_hash": _FLAG, "business_data_hash_mode": {"exclude", "include"}, "fields": _LIST},
    "relation": {"database": _TEXT, "schema": _TEXT, "table": _TEXT},
    "bookmark": {"bookmark_relation": _TEXT, "source_relation": _TEXT, "source_timestamp_column": _TEXT, "pipeline_name": _TEXT},
    "scd": {
        "delete_detection": "deletes", "insert_time": _ANY, "timestamp_data_type": _TEXT, "validity": "validity", "scd2_auto_from_sot": _FLAG,
        "scd2_validation": {"continuous", "sparse"}, "scd2_validation_enabled": _FLAG, "derivation_scope": {"affected_keys"},
        "validation_scope": {"affected_window", "full_target"}, "window_strategy": {"previous_and_next"}, "current_flag": _MAP, "deleted_flag": "deleted",
        "deduplicate": "deduplicate", "update_mode": {"append_only", "upsert"}, "update_key": "names", "valid_to_datetime": _MAP, "valid_from_datetime": "start",
    },
    "start": {"expression": _TEXT},
    "deletes": {"mode": {"field"}, "field": _TEXT, "value": _ANY},
    "deleted": {"mode": _TEXT, "value": _ANY, "field": _TEXT},
    "validity": {"data_type": {"date", "timestamp_ntz", "timestamp_tz", "timestamp_ltz"}, "valid_from": "bound", "valid_to": "bound"},
    "bound": {"column": _TEXT, "source": "field_source", "transforms": _LIST, "nullable": _FLAG, "validations": _LIST, "offset": "offset", "end_of_time": _ANY},
    "offset": {"unit": {"day", "nanosecond", "second"}, "value": _NUMBER},
    "deduplicate": {"partition_by": _LIST, "order_by": ["ordering"]},
    "ordering": {"column": _TEXT, "direction": {"asc", "desc"}, "nulls": {"first", "last"}},
    "source": {
        "format": {"csv", "table"}, "header": _FLAG, "delimiter": _TEXT, "quotechar": _TEXT, "lineterminator": _TEXT, "quoting": {"minimal", "all"},
        "load_method": {"stage", "dbt_seed"}, "location": _MAP, "seed": _MAP, "upload": "upload", "database": _TEXT, "schema": _TEXT, "table": _TEXT,
        "query": _TEXT, "flatten": _ANY,
    },
    "upload": {"enabled": _FLAG, "file": _TEXT, "overwrite": _FLAG},
    "target": {
        "id": _TEXT, "database": _TEXT, "schema": _TEXT, "table_name": _TEXT, "tags": _MAP, "tag_application": {"alter_table", "apply_governance"},
        "apply_governance_procedure": _TEXT, "governance_contract": _MAP, "fields": ["field"],
    },
    "field": {"id": _TEXT, "source": "field_source", "data_type": _TEXT, "nullable": _FLAG, "unique": _FLAG, "tags": _MAP, "description": _TEXT, "transforms": _LIST, "validations": _LIST, "lookup": "lookup"},
    "field_source": {"pos": _NUMBER, "column": _TEXT, "snowflake_path": _TEXT, "default_value": _ANY, "default_from_field": _TEXT, "macro": _TEXT, "args": _MAP, "fixed_value": _ANY},
    "lookup": {"reference_entity": _TEXT, "reference_attribute": _TEXT, "source_expression": _TEXT, "return_attribute": _TEXT, "required": _FLAG},
}
# The keys of each transform and rule, and the words that some of them take.
_STEP_KEYS = {
    "trim": {"side": {"both", "left", "right"}}, "round": {"scale": None, "mode": {"half_up", "half_even", "down", "up"}}, "parse_date": {"format": None},
    "parse_timestamp": {"format": None, "timezone_if_missing": {"Z", "UTC", "local"}, "time_if_missing": {"start_of_day", "end_of_day"}}, "custom": {"macro": None, "args": None},
}
# Fields that a history with source-managed windows must have; their kinds.
_MANUAL_FIELDS = {"IS_CURRENT_FLAG": "flag", "IS_DELETED_FLAG": "flag", "VALID_FROM_DATETIME": "time", "VALID_TO_DATETIME": "time"}
_RULES = {"min_length", "max_length", "regex", "allowed_values", "min_value", "max_value", "precision", "custom"}
_TRANSFORMS = {"trim", "round", "parse_date", "parse_timestamp", "custom"}


def structure(node, block: str = "spec", place: str = "$") -> list[Problem]:
    """Unknown keys, wrong types and words that are not allowed."""
    if not isinstance(node, dict):
        return [(place, "must be a mapping")]
    out: list[Problem] = []
    for key, value in node.items():
        kind, at = BLOCKS[block].get(key), f"{place}.{key}"
        if kind is None:
            out.append((at, f"unknown key `{key}`"))
        elif isinstance(kind, str):
            out += structure(value, kind, at)
        elif isinstance(kind, set):
            out += [] if value in kind else [(at, f"must be one of {', '.join(sorted(kind))}")]
        elif isinstance(kind, list):
            out += [p for i, v in enumerate(value) for p in structure(v, kind[0], f"{at}[{i}]")] if isinstance(value, list) else [(at, "must be a list")]
        elif not isinstance(value, kind) or (kind is _NUMBER and isinstance(value, bool)):
            out.append((at, f"must be of type {kind.__name__}"))
    return out


def check(raw: dict, abstract: bool = False) -> list[Problem]:
    """All problems of a document; an abstract one may lack parts, but what it has must be right."""
    out = structure(raw)
    if not abstract:
        for path in ("id", "control_data", "source", "target", "control_data.change_type", "source.format", "target.id", "target.fields"):
            node = raw
            for part in path.split("."):
                node = node.get(part) if isinstance(node, dict) else None
            if node in (None, [], {}):
                out.append((f"$.{path}", "is required"))
    if out:
        return out
    spec = Spec(raw)
    return [*_fields(spec, abstract), *_sources(spec, abstract), *([] if abstract else _keys(spec)), *([] if abstract else _history(spec))]


def require(raw: dict, abstract: bool = False) -> Spec:
    problems = check(raw, abstract)
    if problems:
        raise SpecError(problems)
    return Spec(raw)


def _fields(spec: Spec, abstract: bool) -> list[Problem]:
    out: list[Problem] = []
    seen: set[str] = set()
    reserved = set() if spec.manual else set(GENERATED) - ({spec.history.valid_from} if spec.change_type == "scd2_derived" else set())
    for i, f in enumerate(spec.target.get("fields") or []):
        at, name = f"$.target.fields[{i}]", str(f.get("id", "")).upper()
        if not _IDENTIFIER.fullmatch(name):
            out.append((f"{at}.id", "is no identifier"))
        if name in seen:
            out.append((f"{at}.id", f"field `{f['id']}` is declared twice"))
        seen.add(name)
        if name in reserved:
            out.append((f"{at}.id", f"`{f['id']}` is a generated column"))
        if "data_type" in f:
            try:
                parse_type(f["data_type"])
            except TypeError_ as e:
                out.append((f"{at}.data_type", str(e)))
        elif not abstract:
            out.append((f"{at}.data_type", "is required"))
        out += _steps(f, at)
    return out


def _compiles(pattern) -> bool:
    """Whether a pattern is a regular expression here and, where a JVM runs, in Java, which is what applies it."""
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException

    try:
        re.compile(pattern)
        if SparkContext._active_spark_context is not None:
            SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except (re.error, TypeError, IllegalArgumentException):
        return False
    return True


def _steps(f: dict, at: str) -> list[Problem]:
    out: list[Problem] = []
    for j, t in enumerate(f.get("transforms") or []):
        place = f"{at}.transforms[{j}]"
        if not isinstance(t, dict) or t.get("type") not in _TRANSFORMS:
            out.append((place, f"unknown transform `{t.get('type') if isinstance(t, dict) else t}`"))
            continue
        for key in set(t) - {"type"}:
            words = _STEP_KEYS[t["type"]].get(key, ())
            if words == ():
                out.append((f"{place}.{key}", f"{t['type']} takes no `{key}`"))
            elif words and t[key] not in words:
                out.append((f"{place}.{key}", f"must be one of {', '.join(sorted(words))}"))
        if t["type"] == "round" and (not isinstance(t.get("scale", 0), int) or isinstance(t.get("scale", 0), bool) or not 0 <= t.get("scale", 0) <= 37):
            out.append((f"{place}.scale", "must be a number of decimals from 0 to 37"))
        if t["type"] in ("parse_date", "parse_timestamp"):
            try:
                dates.spark_pattern(t["format"])
                if t["type"] == "parse_timestamp" and not dates.has_zone(t["format"]) and t.get("timezone_if_missing") not in ("Z", "UTC", "local"):
                    out.append((place, "timezone_if_missing is required where the format has no zone"))
            except KeyError:
                out.append((place, "format is required"))
            except dates.FormatError as e:
                out.append((place, str(e)))
        if t["type"] == "custom" and not t.get("macro"):
            out.append((place, "macro is required"))
    for j, r in enumerate(f.get("validations") or []):
        place = f"{at}.validations[{j}]"
        if r.get("type") not in _RULES:
            out.append((place, f"unknown validation `{r.get('type')}`"))
        elif r["type"] == "regex":
            if not _compiles(r.get("pattern", r.get("value"))):
                out.append((place, "pattern is no regular expression"))
        elif r["type"] == "custom" and not r.get("macro"):
            out.append((place, "macro is required"))
        elif r["type"] == "allowed_values" and not r.get("values", r.get("value")):
            out.append((place, "values are required"))
        elif r["type"] in ("min_length", "max_length", "min_value", "max_value") and r.get("value") is None:
            out.append((place, "value is required"))
        elif r["type"] == "precision" and r.get("precision") is None:
            out.append((place, "precision is required"))
    return out


def _sources(spec: Spec, abstract: bool) -> list[Problem]:
    out: list[Problem] = []
    s, csv = spec.source, spec.source.get("format") == "csv"
    names = {f.name for f in spec.fields} if not abstract else {str(f.get("id", "")).upper() for f in spec.target.get("fields") or []}
    if csv and not abstract:
        method = s.get("load_method")
        if method == "dbt_seed" and not (s.get("seed") or {}).get("file"):
            out.append(("$.source.seed.file", "is required"))
        if method == "stage" and not (s.get("location") or {}).get("filename"):
            out.append(("$.source.location.filename", "is required"))
    if csv and any(k in s for k in ("query", "flatten", "table")):
        out.append(("$.source", "query, table and flatten need format table"))
    if not csv and not abstract and not s.get("table") and not s.get("query"):
        out.append(("$.source", "a table or a query is required"))
    query = s.get("query")
    if query and (not re.match(r"\s*(select|with)\b", query, re.I) or ";" in query):
        out.append(("$.source.query", "must be one SELECT or WITH statement without a semicolon"))
    if (s.get("upload") or {}).get("enabled") and not (csv and s.get("load_method") == "stage" and s["upload"].get("file")):
        out.append(("$.source.upload", "needs a CSV source with load_method stage, and a file"))
    if csv and "seed" in s and s.get("load_method") != "dbt_seed":
        out.append(("$.source.seed", "needs load_method dbt_seed"))
    flat = s.get("flatten") or []
    flat = flat if isinstance(flat, list) else [flat]
    aliases = [str(e["alias"]).upper() for e in flat if isinstance(e, dict) and e.get("alias")]
    out += [("$.source.flatten", f"alias `{a}` is given twice") for a in sorted({a for a in aliases if aliases.count(a) > 1})]
    taken: set[str] = set()
    for i, entry in enumerate(flat):
        if not isinstance(entry, dict) or not entry.get("column") or not entry.get("alias"):
            out.append((f"$.source.flatten[{i}]", "column and alias are required"))
        elif entry.get("mode", "both") not in ("object", "array", "both"):
            out.append((f"$.source.flatten[{i}].mode", "must be object, array or both"))
    for i, f in enumerate(spec.target.get("fields") or []):
        x, at = f.get("source") or {}, f"$.target.fields[{i}].source"
        if "column" in x and "snowflake_path" not in x and "macro" not in x:
            column = str(x["column"]).upper()
            if column in taken:
                out.append((f"{at}.column", f"another field has the source column `{x['column']}`"))
            if column in aliases:
                out.append((f"{at}.snowflake_path", f"is required, since `{x['column']}` is an alias of flatten"))
            taken.add(column)
        if csv and not abstract and s.get("load_method") == "dbt_seed" and "fixed_value" not in x and "macro" not in x and "lookup" not in f and any(k in x for k in ("pos", "column")):
            if s.get("header") is True and "column" not in x:
                out.append((f"{at}.column", "is required where the file has a header"))
            if s.get("header") is False and "pos" not in x:
                out.append((f"{at}.pos", "is required where the file has no header"))
        if "fixed_value" in x and len(x) > 1:
            out.append((at, "fixed_value excludes all other keys"))
        if "macro" in x and any(k in x for k in ("column", "pos", "snowflake_path")):
            out.append((at, "macro excludes column, pos and snowflake_path"))
        if "args" in x and "macro" not in x:
            out.append((at, "args need a macro"))
        if "snowflake_path" in x and (csv or "column" not in x):
            out.append((at, "a path needs a column of a table"))
        if "default_from_field" in x:
            if csv:
                out.append((at, "default_from_field needs format table"))
            if x["default_from_field"].upper() not in names or x["default_from_field"].upper() == str(f.get("id")).upper():
                out.append((at, f"default_from_field names no other field: `{x['default_from_field']}`"))
        if "pos" in x and (not csv or x["pos"] < 0):
            out.append((at, "pos is a position in a CSV file"))
        if csv and not abstract and not any(k in x for k in ("pos", "column", "fixed_value", "macro")) and "lookup" not in f:
            out.append((at, "pos, column, fixed_value or macro is required"))
    return out


def _keys(spec: Spec) -> list[Problem]:
    out: list[Problem] = []
    names = {f.name for f in spec.fields}
    key = spec.control.get("business_key")
    if key is not None and not spec.keys:
        out.append(("$.control_data.business_key.fields", "at least one field is required"))
    if key is None and (spec.change_type != "scd1" or not spec.control.get("skip_business_key")):
        out.append(("$.control_data.business_key", "is required"))
    out += [("$.control_data.business_key.fields", f"`{k}` is no target field") for k in spec.keys if k not in names]
    for made in (spec.surrogate, spec.key_name):
        if made in names:
            out.append(("$.target.fields", f"`{made}` is a generated column"))
    h = spec.control.get("business_data_hash") or {}
    listed = [x.upper() for x in h.get("fields") or []]
    out += [("$.control_data.business_data_hash.fields", f"`{x}` is no target field") for x in listed if x not in names]
    if h.get("business_data_hash_mode") == "include" and not h.get("skip_business_data_hash"):
        made = {spec.surrogate, spec.key_name, *GENERATED, *((spec.history.valid_from, spec.history.valid_to) if spec.change_type != "scd1" else ())}
        if spec.manual:
            made |= {*_MANUAL_FIELDS, *([k for k in spec.update_keys if k not in spec.keys] if spec.scd.get("update_mode") == "upsert" else [])}
        out += [("$.control_data.business_data_hash.fields", f"`{x}` is a key or belongs to the history") for x in listed if x in made]
    out += [("$.control_data.business_key.fields", f"`{k}` is the generated surrogate key") for k in spec.keys if k == spec.surrogate]
    if h.get("business_data_hash_mode") == "include" and not listed:
        out.append(("$.control_data.business_data_hash.fields", "are required where the mode is include"))
    return out


def _history(spec: Spec) -> list[Problem]:
    out: list[Problem] = []
    scd, kind, at = spec.scd, spec.change_type, "$.control_data.scd"
    names = {f.name: f for f in spec.fields}
    deletes = scd.get("delete_detection")
    if deletes is not None:
        if kind != "scd1":
            out.append((f"{at}.delete_detection", "is valid for scd1 only"))
        elif str(deletes.get("field", "")).upper() not in names or "value" not in deletes:
            out.append((f"{at}.delete_detection", "needs a target field and a value"))
    if kind == "scd2_auto":
        if "insert_time" not in scd:
            out.append((f"{at}.insert_time", "is required"))
        if any((spec.validity.get(b) or {}).get("source") for b in ("valid_from", "valid_to")):
            out.append((f"{at}.validity", "scd2_auto takes no source for its validity"))
    elif "insert_time" in scd:
        out.append((f"{at}.insert_time", "is valid for scd2_auto only"))
    if kind == "scd2_derived":
        f = names.get(spec.history.valid_from)
        if spec.start:
            pass
        elif f is None:
            out.append((f"{at}.validity.valid_from", f"a source or a target field `{spec.history.valid_from}` is required"))
        elif parse_type(f.data_type).base not in ("date", "timestamp"):
            out.append(("$.target.fields", f"`{f.id}` must be a date or a timestamp"))
        until = names.get(spec.history.valid_to)
        if until is not None and not spec.validity and parse_type(until.data_type).base != "timestamp":
            out.append(("$.target.fields", f"`{until.id}` must be a timestamp"))
        if (scd.get("valid_to_datetime") or {}).get("mode", "next_valid_from") != "next_valid_from":
            out.append((f"{at}.valid_to_datetime.mode", "must be next_valid_from"))
        flag = scd.get("deleted_flag") or {}
        if flag.get("mode", "fixed") != "fixed" and not flag.get("field"):
            out.append((f"{at}.deleted_flag.mode", "must be fixed, or a field must be named"))
    if not spec.generated:
        out += [(f"{at}.{k}", "is valid for scd2_auto and scd2_derived only") for k in ("scd2_validation", "scd2_validation_enabled", "validation_scope") if k in scd]
    if kind != "scd2_auto" and "scd2_auto_from_sot" in scd:
        out.append((f"{at}.scd2_auto_from_sot", "is valid for scd2_auto only"))
    if kind == "scd2_manual":
        out += [(f"{at}.{k}", "scd2_manual takes update_mode, update_key and validity only") for k in sorted(set(scd) - {"update_mode", "update_key", "validity", "scd2_validation", "scd2_validation_enabled", "validation_scope", "scd2_auto_from_sot", "deduplicate", "delete_detection", "insert_time", "valid_from_datetime"})]
        if spec.validity:
            out += [(f"{at}.validity.{b}.source", "is required") for b in ("valid_from", "valid_to") if not (spec.validity.get(b) or {}).get("source")]
        else:
            for column, what in _MANUAL_FIELDS.items():
                f = names.get(column)
                if f is None:
                    out.append(("$.target.fields", f"scd2_manual requires `{column}`"))
                    continue
                if str(f.source.get("column", "")).upper() != column:
                    out.append(("$.target.fields", f"`{f.id}` must come from the source column `{column}`"))
                t = parse_type(f.data_type)
                if what == "time" and t.base != "timestamp":
                    out.append(("$.target.fields", f"`{f.id}` must be a timestamp"))
                if what == "flag" and not (t.base == "string" and t.length == 1):
                    out.append(("$.target.fields", f"`{f.id}` must be a varchar(1)"))
        if scd.get("update_key") is not None and scd.get("update_mode") != "upsert":
            out.append((f"{at}.update_key", "needs update_mode upsert"))
        out += [(f"{at}.update_key", f"`{k}` is no target field") for k in spec.update_keys if k not in names]
    elif "update_mode" in scd or "update_key" in scd:
        out.append((at, "update_mode and update_key are valid for scd2_manual only"))
    if kind != "scd2_derived" and "valid_from_datetime" in scd:
        out.append((f"{at}.valid_from_datetime", "is valid for scd2_derived only"))
    if scd.get("deduplicate") and kind != "scd2_derived":
        out.append((f"{at}.deduplicate", "is valid for scd2_derived only"))
    if spec.control.get("incremental_bookmark") is not None:
        b = spec.control["incremental_bookmark"]
        out += [(f"$.control_data.incremental_bookmark.{k}", "is required") for k in ("bookmark_relation", "source_relation") if not b.get(k)]
    if kind == "scd1" and spec.validity and spec.history.valid_from != VALID_FROM:
        out.append((f"{at}.validity", "is valid for histories only"))
    return out
