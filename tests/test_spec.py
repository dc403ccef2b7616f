import copy

import pytest

from millrace.__main__ import main
from millrace.spec import load
from millrace.spec.check import check, require
from millrace.spec.load import SpecError

GOOD = {
    "id": "account",
    "control_data": {"materialisation_type": "table", "change_type": "scd1", "business_key": {"fields": ["account_id"]}},
    "source": {"format": "csv", "header": True, "load_method": "dbt_seed", "seed": {"file": "a.csv"}},
    "target": {"id": "core__account", "schema": "tmp", "fields": [
        {"id": "account_id", "source": {"pos": 0, "column": "account_id"}, "data_type": "varchar(20)", "nullable": False},
        {"id": "opened", "source": {"column": "opened"}, "data_type": "date", "transforms": [{"type": "parse_date", "format": "%d/%m/%Y"}]},
    ]},
}


def changed(path, value):
    out = copy.deepcopy(GOOD)
    node = out
    *parts, last = path.split(".")
    for p in parts:
        node = node[int(p)] if p.isdigit() else node.setdefault(p, {})
    if last.isdigit():
        node[int(last)] = value
    else:
        node[last] = value
    return out


def test_good_spec_and_its_names():
    spec = require(GOOD)
    assert spec.table == "TMP.CORE__ACCOUNT" and spec.surrogate == "ACCOUNT_KEY" and spec.key_name == "ACCOUNT_BUSINESS_KEY"
    assert spec.quarantine_table == "INTERMEDIATE.CORE__ACCOUNT__QUARANTINE" and spec.hashed == ["OPENED"]


@pytest.mark.parametrize("path, value, said", [
    ("colour", 1, "unknown key"),
    ("control_data.change_type", "scd9", "must be one of"),
    ("control_data.validation_enabled", "yes", "of type bool"),
    ("control_data.business_key", {"fields": []}, "at least one"),
    ("control_data.business_key.fields", ["nope"], "no target field"),
    ("control_data.business_data_hash", {"business_data_hash_mode": "include"}, "required where"),
    ("control_data.scd", {"delete_detection": {"mode": "field", "field": "nope", "value": 1}}, "needs a target field"),
    ("control_data.scd", {"insert_time": "2026-01-01"}, "scd2_auto only"),
    ("control_data.change_type", "scd2_auto", "is required"),
    ("control_data.change_type", "scd2_derived", "is required"),
    ("control_data.change_type", "scd2_manual", "scd2_manual requires"),
    ("control_data.incremental_bookmark", {}, "is required"),
    ("source.query", "select 1", "format table"),
    ("source.seed", {}, "is required"),
    ("target.fields.1.id", "ACCOUNT_ID", "declared twice"),
    ("target.fields.1.id", "is_current_flag", "generated column"),
    ("target.fields.1.id", "account_key", "generated column"),
    ("target.fields.1.data_type", "interval", "unsupported"),
    ("target.fields.1.transforms", [{"type": "fold"}], "unknown transform"),
    ("target.fields.1.transforms", [{"type": "parse_timestamp", "format": "%Y"}], "timezone_if_missing"),
    ("target.fields.1.transforms", [{"type": "parse_date", "format": "%Q"}], "directive"),
    ("target.fields.1.validations", [{"type": "regex", "pattern": "("}], "regular expression"),
    ("target.fields.1.validations", [{"type": "custom"}], "macro is required"),
    ("target.fields.1.source", {"fixed_value": "x", "column": "y"}, "excludes"),
    ("target.fields.1.source", {"macro": "a.b", "column": "y"}, "excludes"),
    ("target.fields.1.source", {"column": "y", "snowflake_path": "a.b"}, "needs a column of a table"),
    ("target.fields.1.source", {"column": "y", "default_from_field": "zzz"}, "no other field"),
    ("target.fields.1.source", {}, "is required"),
    ("target.fields.1.source", {"column": "ACCOUNT_ID"}, "another field has"),
    ("target.fields.1.source", {"pos": 1}, "where the file has a header"),
    ("source.header", False, "where the file has no header"),
    ("source.load_method", "stage", "needs load_method"),
    ("target.fields.1.transforms", [{"type": "parse_date", "format": "%Y", "timezone_if_missing": "UTC"}], "takes no"),
    ("target.fields.1.transforms", [{"type": "round", "mode": "nearest"}], "must be one of"),
    ("target.fields.1.transforms", [{"type": "round", "scale": -1}], "number of decimals"),
    ("target.fields.1.transforms", [{"type": "trim", "side": "top"}], "must be one of"),
    ("target.fields.1.transforms", ["trim"], "unknown transform"),
    ("control_data.business_data_hash", {"business_data_hash_mode": "include", "fields": ["account_business_key"]}, "key or belongs"),
    ("control_data.business_key.fields", ["account_key"], "surrogate key"),
    ("control_data.scd", {"scd2_validation": "sparse"}, "scd2_auto and scd2_derived only"),
    ("control_data.scd", {"scd2_auto_from_sot": True}, "scd2_auto only"),
])
def test_rejected(path, value, said):
    assert any(said in message for _, message in check(changed(path, value))), check(changed(path, value))


def test_table_source_rules():
    spec = changed("source", {"format": "table", "schema": "tmp", "table": "t"})
    assert any("position" in m for _, m in check(spec))
    for f in spec["target"]["fields"]:
        f["source"].pop("pos", None)
    assert check(spec) == []
    for query in ("delete from t", "select 1; select 2"):
        spec["source"]["query"] = query
        assert any("SELECT" in m for _, m in check(spec))
    spec["source"] = {"format": "table", "table": "t", "flatten": [{"column": "a"}]}
    assert any("alias" in m for _, m in check(spec))


def history(kind, scd, *fields):
    return {"id": "t", "control_data": {"change_type": kind, "business_key": {"fields": ["a"]}, "scd": scd}, "source": {"format": "table", "table": "s"}, "target": {"id": "t", "fields": [{"id": "a", "source": {"column": "a"}, "data_type": "text"}, *fields]}}


def own(name, kind, column=None):
    return {"id": name, "source": {"column": column or name}, "data_type": kind}


WINDOWS = [own("is_current_flag", "varchar(1)"), own("is_deleted_flag", "varchar(1)"), own("valid_from_datetime", "timestamp_ntz"), own("valid_to_datetime", "timestamp_ntz")]


@pytest.mark.parametrize("spec, said", [
    (history("scd2_manual", {}, *WINDOWS[1:]), "requires `IS_CURRENT_FLAG`"),
    (history("scd2_manual", {}, own("is_current_flag", "text"), *WINDOWS[1:]), "varchar(1)"),
    (history("scd2_manual", {}, *WINDOWS[:3], own("valid_to_datetime", "date")), "must be a timestamp"),
    (history("scd2_manual", {}, *WINDOWS[:3], own("valid_to_datetime", "timestamp_ntz", "t")), "must come from the source column"),
    (history("scd2_manual", {"update_key": {"fields": ["a"]}}, *WINDOWS), "needs update_mode"),
    (history("scd2_manual", {"window_strategy": "previous_and_next"}, *WINDOWS), "update_mode, update_key and validity only"),
    (history("scd2_manual", {"validity": {"valid_from": {"source": {"column": "f"}}}}), "is required"),
    (history("scd2_derived", {"valid_to_datetime": {"mode": "fixed"}}, WINDOWS[2]), "next_valid_from"),
    (history("scd2_derived", {}, WINDOWS[2], own("valid_to_datetime", "date")), "must be a timestamp"),
    (history("scd2_auto", {"insert_time": "2026-01-01", "update_mode": "upsert"}), "scd2_manual only"),
    (history("scd2_auto", {"insert_time": "2026-01-01", "delete_detection": {"mode": "field", "field": "a", "value": 1}}), "scd1 only"),
])
def test_history_rules(spec, said):
    assert any(said in message for _, message in check(spec)), check(spec)


def test_good_histories_pass():
    assert check(history("scd2_manual", {"update_mode": "upsert", "update_key": {"fields": ["valid_from_datetime"]}}, *WINDOWS)) == []
    assert check(history("scd2_derived", {"scd2_validation": "sparse"}, WINDOWS[2])) == []
    assert check(history("scd2_auto", {"insert_time": "2026-01-01", "scd2_auto_from_sot": False})) == []


def test_flatten_rules():
    spec = history("scd1", {}, {"id": "b", "source": {"column": "x"}, "data_type": "text"})
    spec["source"]["flatten"] = [{"column": "p", "alias": "x"}, {"column": "q", "alias": "X"}]
    said = [m for _, m in check(spec)]
    assert any("given twice" in m for m in said) and any("alias of flatten" in m for m in said)
    spec["source"]["flatten"] = {"column": "p", "alias": "x"}
    spec["target"]["fields"][1]["source"]["snowflake_path"] = "n"
    assert check(spec) == []


def test_patterns_must_compile_where_they_run(spark):
    spec = changed("target.fields.1.validations", [{"type": "regex", "pattern": "(?P<year>[0-9]+)"}])  # Python's own syntax
    assert any("regular expression" in m for _, m in check(spec))


def test_inheritance(tmp_path):
    (tmp_path / "parents").mkdir()
    (tmp_path / "parents" / "Base.yaml").write_text("id: base\ncontrol_data: {change_type: scd1, business_key: {fields: [a, b]}}\ntarget: {id: base, fields: [{id: a, data_type: text, nullable: false}, {id: b, data_type: int}]}\n")
    child = tmp_path / "child.yaml"
    child.write_text("id: child\nextends: base\ncontrol_data: {business_key: {fields: [a]}}\ntarget: {id: child, fields: [{id: A, data_type: varchar(5)}, {id: c, data_type: date}]}\n")
    out = load.inherit(child, [tmp_path / "parents"])
    assert out["id"] == "child" and out["control_data"] == {"change_type": "scd1", "business_key": {"fields": ["a"]}}
    assert [(f["id"], f["data_type"], f.get("nullable")) for f in out["target"]["fields"]] == [("A", "varchar(5)", False), ("b", "int", None), ("c", "date", None)]
    with pytest.raises(SpecError, match="not found"):
        load.inherit(child)
    (tmp_path / "parents" / "base.yml").write_text("id: base\n")
    with pytest.raises(SpecError, match="ambiguous"):
        load.inherit(child, [tmp_path / "parents"])


def test_inheritance_cycle_and_wrong_id(tmp_path):
    (tmp_path / "x.yaml").write_text("id: x\nextends: y\n")
    (tmp_path / "y.yaml").write_text("id: y\nextends: x\n")
    with pytest.raises(SpecError, match="comes back"):
        load.inherit(tmp_path / "x.yaml")
    (tmp_path / "y.yaml").write_text("id: z\n")
    with pytest.raises(SpecError, match="has id"):
        load.inherit(tmp_path / "x.yaml")
    (tmp_path / "empty.yaml").write_text("")
    assert load.read(tmp_path / "empty.yaml") == {}


def test_variables(monkeypatch):
    monkeypatch.setenv("ZONE", "east")
    doc = {"a": "{{ var('x') }}-{{ my_var(\"y\", 'd') }}", "b": ["{{ env_var('ZONE') }}"], "q": "{{ my_incremental_bookmark_predicate('ts', watermark_filter='a > 1') }}"}
    out = load.substitute(doc, {"x": 3})
    assert out["a"] == "3-d" and out["b"] == ["east"] and out["q"] == doc["q"]
    assert load.bookmark_calls(doc["q"]) == [(doc["q"], "ts", "a > 1")]
    with pytest.raises(SpecError, match="no value"):
        load.substitute(doc, {})
    assert load.substitute("{{ var('x') }}", {}, strict=False) == "{{ var('x') }}"
    with pytest.raises(SpecError, match="not allowed"):
        load.substitute("{{ ref('x') }}", {})
    assert load.parse_variables("{a: 1}") == {"a": 1} and load.parse_variables(None) == {}


def test_command_line(tmp_path, capsys):
    import yaml

    (tmp_path / "good.yaml").write_text(yaml.safe_dump(GOOD))
    (tmp_path / "bad.yaml").write_text(yaml.safe_dump(changed("colour", 1)))
    assert main(["parse", "--spec", str(tmp_path / "good.yaml")]) == 0
    assert main(["parse", "--spec", str(tmp_path / "bad.yaml")]) == 1 and "unknown key" in capsys.readouterr().err
    assert main(["parse", "--spec", str(tmp_path / "none.yaml")]) == 2
    assert main(["fly"]) == 2
