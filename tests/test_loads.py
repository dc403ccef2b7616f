"""Whole loads: each test is a story of one or more loads with the table that must be there afterwards."""

import datetime as dt
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.functions.macros import MacroError, Macros
from millrace.operators import history as H
from millrace.operators.history import HistoryError
from millrace.operators.verdict import ValidationFailed
from millrace.plans.load import Loader
from millrace.sources.snapshots import Conflict, SchemaChanged, Snapshots
from millrace.spec.check import require
from millrace.streaming import loads

RUN = dt.datetime(2026, 3, 1)
END = "9999-12-31 23:59:59"


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "tables"), buckets=4)


def field(name, kind="varchar(20)", **more):
    return {"id": name, "source": {"column": name}, "data_type": kind, **more}


def document(change, fields, keys=("account_id",), scd=None, source=None, **control):
    control_data = {"change_type": change, "business_key": {"fields": list(keys)}, **control}
    if scd is not None:
        control_data["scd"] = scd
    return {"id": "t", "control_data": control_data, "source": source or {"format": "table", "schema": "tmp", "table": "s"}, "target": {"id": "account", "schema": "business", "fields": fields}}


def csv(tmp_path, text, fields, **control):
    (tmp_path / "in.csv").write_text(text)
    return document("scd1", fields, source={"format": "csv", "header": True, "load_method": "dbt_seed", "seed": {"file": "in.csv"}}, **control)


def table(spark, names, *rows):
    return {"TMP.S": spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} string" for n in names.split()))}


def rows(store, name, *columns):
    return sorted(tuple(str(v) for v in r) for r in store.read(name).select(*[F.col(c).cast("string") for c in columns]).collect())


def events(store):
    return [(r.EVENT_TYPE, r.RESULT, r.DETAILS) for r in store.read("BUSINESS.LOAD_JOBS").orderBy("EVENT_TIMESTAMP").collect()]


def test_scd1_csv_with_transforms(spark, store, tmp_path):
    fields = [field("account_id", transforms=[{"type": "trim"}]), field("amount", "number(10,2)", transforms=[{"type": "round", "scale": 2}]),
              field("opened", "date", transforms=[{"type": "parse_date", "format": "%d/%m/%Y"}]), {"id": "origin", "source": {"fixed_value": "file"}, "data_type": "text"}]
    spec = csv(tmp_path, "account_id,amount,opened\n A1 ,12.345,1/08/2026\nA2,98.765,01/12/2026\n", fields)
    report = Loader(spark, spec, store, tmp_path, run_at=RUN).run()
    assert (report.result, report.loaded) == ("COMPLETED", 2)
    assert rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID", "AMOUNT", "OPENED", "ORIGIN", "AUDIT_CREATED_DATETIME") == [("A1", "12.35", "2026-08-01", "file", "2026-03-01 00:00:00"), ("A2", "98.77", "2026-12-01", "file", "2026-03-01 00:00:00")]
    first = store.read("BUSINESS.ACCOUNT").filter("ACCOUNT_ID = 'A1'").first()
    assert first.ACCOUNT_BUSINESS_KEY == "16a36e86f6fed5d465ff332511a0ce1a863b55d364b25a7cdaa25db19abf9648"
    assert events(store) == [("JOB_START", None, None), ("JOB_END", "COMPLETED", None)]


def test_quarantine_and_widening(spark, store, tmp_path):
    fields = [field("account_id", nullable=False, validations=[{"type": "regex", "pattern": "A[0-9]{3}"}]), field("name")]
    spec = csv(tmp_path, "account_id,name\nA001,x\nBAD3,y\n", fields, failure_mode="quarantine_row")
    report = Loader(spark, spec, store, tmp_path).run()
    assert (report.result, report.loaded, report.quarantined) == ("COMPLETED_WITH_QUARANTINE", 1, 1)
    (tmp_path / "in.csv").write_text("account_id,name,more\n,z,m\nA002,x,n\n")
    assert Loader(spark, spec, store, tmp_path).run().quarantined == 1
    assert rows(store, "INTERMEDIATE.ACCOUNT__QUARANTINE", "ACCOUNT_ID", "MORE", "FAILURE_DETAILS") == [("BAD3", "None", "field `account_id` does not match regex"), ("None", "m", "field `account_id` is null but not nullable")]
    assert rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID") == [("A002",)]


def test_failed_load_leaves_table(spark, store, tmp_path):
    spec = csv(tmp_path, "account_id,n\nA1,1\n", [field("account_id", unique=True), field("n", "int")])
    Loader(spark, spec, store, tmp_path).run()
    (tmp_path / "in.csv").write_text("account_id,n\nA2,x\nA3,3\nA3,3\n")
    with pytest.raises(ValidationFailed, match="3 validation row"):
        Loader(spark, spec, store, tmp_path).run()

    def sabotage():
        raise RuntimeError("no")

    (tmp_path / "in.csv").write_text("account_id,n\nA2,2\n")
    with pytest.raises(RuntimeError):
        Loader(spark, spec, store, tmp_path, fault=sabotage).run()
    assert rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID") == [("A1",)]
    assert [(e[1], e[2]) for e in events(store) if e[0] == "JOB_END"][1:] == [("FAILED", "validation errors failed the load"), ("FAILED", "the load failed; see the error that was raised")]
    loader = Loader(spark, spec, store, tmp_path, source_path=str(tmp_path / "in.csv"))
    assert loader.messages().count() == 0


def test_deletes_truncate_and_header(spark, store, tmp_path):
    spec = csv(tmp_path, "account_id,state\nA1,DELETED\nA2,\n", [field("account_id"), field("state")], truncate_before_load=True, scd={"delete_detection": {"mode": "field", "field": "state", "value": "DELETED"}})
    with pytest.raises(ValueError, match="allow_truncate"):
        Loader(spark, spec, store, tmp_path).run()
    Loader(spark, spec, store, tmp_path, variables={"allow_truncate": True}).run()
    assert rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID", "STATE") == [("A2", "None")]
    spec["target"]["fields"][0]["source"]["pos"] = 1
    with pytest.raises(Exception, match="position 1 holds"):
        Loader(spark, spec, store, tmp_path, variables={"allow_truncate": True}).run()


def auto(**scd):
    return document("scd2_auto", [field("account_id"), field("account_value", "number(10,0)")], scd={"insert_time": "2026-09-01T00:00:00Z", **scd})


def load(spark, store, spec, names, *data, **more):
    return Loader(spark, spec, store, references=table(spark, names, *data), **more).run()


def test_auto_history_story(spark, store):
    seen = []
    for value, at in (("1", "2026-09-01T00:00:00Z"), ("2", "2026-09-02T00:00:00Z"), ("1", "2026-09-03T00:00:00Z"), ("1", "2026-09-04T00:00:00Z"), ("1", "2026-09-02T12:00:00Z")):
        load(spark, store, auto(insert_time=at), "account_id account_value", ("A1", value))
        seen.append([(r[0], r[1]) for r in sorted(rows(store, "BUSINESS.ACCOUNT", "VALID_FROM_DATETIME", "ACCOUNT_VALUE"))])
    origin = ("0001-01-01 00:00:00", "1")
    assert seen[0] == [origin] and seen[1] == [origin, ("2026-09-02 00:00:00", "2")] and seen[2] == seen[3] == [*seen[1], ("2026-09-03 00:00:00", "1")]
    assert seen[4] == [*seen[1], ("2026-09-02 12:00:00", "1")]
    assert rows(store, "BUSINESS.ACCOUNT", "VALID_TO_DATETIME", "IS_CURRENT_FLAG", "IS_DELETED_FLAG")[-1] == (END, "Y", "N")
    columns = store.read("BUSINESS.ACCOUNT").columns
    assert columns[:4] == ["ACCOUNT_KEY", "ACCOUNT_BUSINESS_KEY", "ACCOUNT_ID", "ACCOUNT_VALUE"] and columns[-1] == "AUDIT_DATA_PROCESS_KEY"


def test_auto_missing_rows_stay_and_rerun_is_no_commit(spark, store):
    load(spark, store, auto(), "account_id account_value", ("A1", "1"), ("A2", "2"))
    version = store.manifest("BUSINESS.ACCOUNT")["version"]
    load(spark, store, auto(insert_time="2026-10-01T00:00:00Z"), "account_id account_value", ("A2", "2"))
    assert store.manifest("BUSINESS.ACCOUNT")["version"] == version
    assert [r[1] for r in rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID", "IS_CURRENT_FLAG")] == ["Y", "Y"]


def test_auto_bad_window_rolls_back(spark, store):
    load(spark, store, auto(), "account_id account_value", ("A1", "1"))
    before = rows(store, "BUSINESS.ACCOUNT", "*".replace("*", "VALID_FROM_DATETIME"), "AUDIT_LAST_CHANGED_DATETIME")
    with pytest.raises(HistoryError):
        load(spark, store, auto(insert_time="9999-12-31T23:59:59Z"), "account_id account_value", ("A1", "2"))
    assert rows(store, "BUSINESS.ACCOUNT", "VALID_FROM_DATETIME", "AUDIT_LAST_CHANGED_DATETIME") == before


def test_auto_skipped_generated_columns(spark, store):
    spec = auto()
    spec["control_data"].update(skip_business_key=True, skip_surrogate_key=True, business_data_hash={"skip_business_data_hash": True})
    load(spark, store, spec, "account_id account_value", ("A1", "1"), ("A2", "5"))
    spec["control_data"]["scd"]["insert_time"] = "2026-11-01T00:00:00Z"
    load(spark, store, spec, "account_id account_value", ("A1", "2"))
    assert "BUSINESS_DATA_HASH" not in store.read("BUSINESS.ACCOUNT").columns
    assert rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID", "ACCOUNT_VALUE", "IS_CURRENT_FLAG") == [("A1", "1", "N"), ("A1", "2", "Y"), ("A2", "5", "Y")]


def derived(kind="timestamp_ntz", **scd):
    validity = {"data_type": kind, "valid_from": {"source": {"column": "changed"}, **({"column": "VALID_FROM_DATE"} if kind == "date" else {})}, "valid_to": {"column": "VALID_TO_DATE"} if kind == "date" else {}}
    return document("scd2_derived", [field("account_id"), field("state")], scd={"validity": validity, **scd})


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def test_derived_any_order_of_arrival(spark, store, order):
    data = [("A1", "BRONZE", "2026-01-01 00:00:00"), ("A1", "SILVER", "2026-02-01 00:00:00"), ("A1", "GOLD", "2026-03-01 00:00:00")]
    for i in order:
        load(spark, store, derived(), "account_id state changed", data[i])
    assert [r[1:] for r in rows(store, "BUSINESS.ACCOUNT", "VALID_FROM_DATETIME", "STATE", "VALID_TO_DATETIME", "IS_CURRENT_FLAG")] == [
        ("BRONZE", "2026-01-31 23:59:59.999999", "N"), ("SILVER", "2026-02-28 23:59:59.999999", "N"), ("GOLD", END, "Y")]


def test_derived_hidden_order_and_dates(spark, store):
    spec = derived("date", deduplicate={"order_by": [{"column": "seq"}]})
    load(spark, store, spec, "account_id state changed seq", ("A1", "a", "2026-01-01", "1"), ("A1", "b", "2026-01-01", "2"), ("A1", "c", "2026-01-02", None))
    assert rows(store, "BUSINESS.ACCOUNT", "VALID_FROM_DATE", "VALID_TO_DATE", "STATE") == [("2026-01-01", "2026-01-01", "b"), ("2026-01-02", "9999-12-31", "c")]
    assert "SEQ" not in store.read("BUSINESS.ACCOUNT").columns


def test_derived_null_start_fails(spark, store):
    with pytest.raises(HistoryError):
        load(spark, store, derived(), "account_id state changed", ("A1", "a", None), ("A2", "b", "2026-01-01"))
    spec = derived()
    spec["control_data"]["failure_mode"] = "quarantine_row"
    report = load(spark, store, spec, "account_id state changed", ("A1", "a", None), ("A2", "b", "2026-01-01"))
    assert report.invalid_keys == 1 and rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID") == [("A2",)]


def test_derived_start_by_expression(spark, store):
    fields = [field("account_id"), field("state"), field("created", "date"), field("updated", "date"), field("source_flag", "varchar(1)")]
    spec = document("scd2_derived", fields, scd={"valid_from_datetime": {"expression": "coalesce(updated, created)"}}, business_data_hash={"business_data_hash_mode": "exclude", "fields": ["created", "updated"]})
    names = "account_id state created updated source_flag"
    load(spark, store, spec, names, ("A1", "V10", "2026-01-01", "2026-03-01", "Y"))
    load(spark, store, spec, names, ("A1", "V2", "2026-01-01", None, "Y"))
    assert rows(store, "BUSINESS.ACCOUNT", "VALID_FROM_DATETIME", "STATE", "IS_CURRENT_FLAG", "SOURCE_FLAG") == [("2026-01-01 00:00:00", "V2", "N", "Y"), ("2026-03-01 00:00:00", "V10", "Y", "Y")]


def manual(**scd):
    fields = [field("account_id"), field("account_value"), field("is_current_flag", "varchar(1)"), field("is_deleted_flag", "varchar(1)")]
    for name, when in (("valid_from_datetime", "start_of_day"), ("valid_to_datetime", "end_of_day")):
        fields.append(field(name, "timestamp_tz", transforms=[{"type": "parse_timestamp", "format": "%d/%m/%Y", "timezone_if_missing": "UTC", "time_if_missing": when}]))
    return document("scd2_manual", fields, scd=scd)


MANUAL = "account_id account_value is_current_flag is_deleted_flag valid_from_datetime valid_to_datetime"


def test_manual_upsert_and_state(spark, store):
    spec = manual(update_mode="upsert", update_key={"fields": ["valid_from_datetime"]})
    load(spark, store, spec, MANUAL, ("A1", "1", "Y", "N", "1/01/2026", "31/12/9999"), ("B1", "1", "Y", "N", "1/01/2026", "31/12/9999"))
    load(spark, store, spec, MANUAL, ("A1", "1", "N", "N", "1/01/2026", "31/01/2026"), ("A1", "2", "Y", "N", "1/02/2026", "31/12/9999"))
    good = rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID", "ACCOUNT_VALUE", "IS_CURRENT_FLAG", "VALID_TO_DATETIME")
    assert good == [("A1", "1", "N", "2026-01-31 23:59:59.999999"), ("A1", "2", "Y", "9999-12-31 23:59:59.999999"), ("B1", "1", "Y", "9999-12-31 23:59:59.999999")]
    for bad, said in ((("A1", "3", "Y", "N", "1/03/2027", "31/12/9999"), "multiple current"), (("B1", "3", "N", "N", "1/03/2027", "31/12/9999"), "overlap"), (("C1", "3", "N", "N", "1/03/2027", "31/12/2026"), "after valid_from")):
        with pytest.raises(ValidationFailed, match=said):
            load(spark, store, spec, MANUAL, bad)
    assert rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID", "ACCOUNT_VALUE", "IS_CURRENT_FLAG", "VALID_TO_DATETIME") == good


def test_manual_append_and_quarantine(spark, store):
    spec = manual()
    spec["control_data"]["failure_mode"] = "quarantine_row"
    load(spark, store, spec, MANUAL, ("A1", "1", "N", "N", "1/01/2026", "31/01/2026"))
    report = load(spark, store, spec, MANUAL, ("A1", "2", "Y", "N", "1/02/2026", "31/12/9999"), ("B1", "1", "Y", "N", "1/01/2026", "5/01/2026"), ("B1", "2", "Y", "N", "6/01/2026", "31/12/9999"))
    assert report.quarantined == 2 and [r[1] for r in rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID", "ACCOUNT_VALUE")] == ["1", "2"]


def test_flatten_lookup_default_query_and_macros(spark, store, tmp_path):
    (tmp_path / "macros").mkdir()
    (tmp_path / "macros" / "own.py").write_text(
        "from pyspark.sql import functions as F\n"
        "def shout(x, mark='!'):\n    return F.concat(F.upper(x), F.lit(mark))\n"
        "class Even:\n    def execute(self, value):\n        return int(value) % 2 == 0\n"
        "even = Even()\n"
        "def size(df, field, args):\n    return df.withColumn(field, F.lit(args['n']))\n"
        "def broken(x):\n    return 1\n")
    fields = [
        {"id": "account_id", "source": {"column": "payload", "snowflake_path": "id"}, "data_type": "varchar(20)"},
        {"id": "order_id", "source": {"column": "o", "snowflake_path": "n"}, "data_type": "int", "validations": [{"type": "custom", "macro": "own.even"}]},
        {"id": "nick", "source": {"column": "payload", "snowflake_path": "nick", "default_from_field": "account_id", "default_value": "z"}, "data_type": "text", "transforms": [{"type": "custom", "macro": "own.shout", "args": {"mark": "?", "other": 1}}]},
        {"id": "size", "source": {"macro": "own.size", "args": {"n": 7}}, "data_type": "int"},
        {"id": "country", "lookup": {"reference_entity": "REF.COUNTRY", "reference_attribute": "code", "source_expression": "payload:c::string", "return_attribute": "name"}, "data_type": "text"},
    ]
    source = {"format": "table", "query": "select parse_json(payload) payload from tmp.s where payload is not null", "flatten": {"column": "payload", "path": "orders", "alias": "o", "mode": "array"}}
    spec = document("scd1", fields, keys=("account_id", "order_id"), source=source, failure_mode="quarantine_row")
    refs = table(spark, "payload", ('{"id":"A","c":"au","orders":[{"n":2},{"n":3}]}',), ('{"id":"B","nick":"bee","c":"xx","orders":[{"n":4}]}',), (None,))
    refs["REF.COUNTRY"] = spark.createDataFrame([("au", "Australia", "Y"), ("xx", "gone", "N")], "code string, name string, IS_CURRENT_FLAG string")
    report = Loader(spark, spec, store, tmp_path, references=refs).run()
    assert rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID", "ORDER_ID", "NICK", "SIZE", "COUNTRY") == [("A", "2", "A?", "7", "Australia"), ("B", "4", "BEE?", "7", "None")]
    assert report.quarantined == 1 and "own.even" in rows(store, "INTERMEDIATE.ACCOUNT__QUARANTINE", "FAILURE_DETAILS")[0][0]
    macros = Macros([tmp_path / "macros"])
    with pytest.raises(MacroError):
        macros["own.broken"](F.lit("x"))
    with pytest.raises(MacroError):
        macros["own.none"]
    row = spark.range(1).select(macros["account_macros.normalise_account_name"](F.lit(" a ")).alias("a"), macros.validation("account_macros.validate_account_number")(F.lit("ACCT000000000000")).alias("b"), macros.validation("account_macros.validate_account_number")(F.lit("ACCT000000000001")).alias("c")).first()
    assert row.a == "A" and "12 non-zero" in row.b and row.c is None


def test_bookmark_advances_to_the_bound(spark, store):
    query = "select account_id, ts from tmp.s where {{ x_incremental_bookmark_predicate('ts') }}"
    fields = [field("account_id"), field("ts", "timestamp_ntz")]
    spec = document("scd1", fields, source={"format": "table", "query": query}, incremental_bookmark={"bookmark_relation": "OPS.MARKS", "source_relation": "TMP.S", "source_timestamp_column": "ts"})

    def go(*data):
        df = spark.createDataFrame([(a, dt.datetime.fromisoformat(t)) for a, t in data], "account_id string, ts timestamp_ntz")
        Loader(spark, spec, store, references={"TMP.S": df}).run()
        return rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID")

    first = [("a", "2026-01-01"), ("b", "2026-01-02")]
    assert go(*first) == [("a",), ("b",)]
    assert go(*first, ("c", "2026-01-03")) == [("c",)]
    assert rows(store, "OPS.MARKS", "PIPELINE_NAME", "LAST_SOURCE_TIMESTAMP") == [("t", "2026-01-03 00:00:00")]


def test_governance(spark, store, tmp_path):
    spec = csv(tmp_path, "account_id,n\nA1,1\n", [field("account_id", tags={"gov.tags.PII_CATEGORY": "ID"}), field("n", description="a number")])
    spec["target"].update(tag_application="apply_governance", governance_contract={"table": "gov.contract", "source": "git", "version": 2}, tags={"owner": "x"})
    called = []
    for _ in range(2):
        Loader(spark, spec, store, tmp_path, governance=called.append).run()
    assert called == ["BUSINESS.ACCOUNT"] * 2
    assert rows(store, "GOV.CONTRACT", "COLUMN_NAME", "PII_CATEGORY", "DESCRIPTION", "CONTRACT_VERSION") == [("ACCOUNT_ID", "ID", "None", "2"), ("N", "None", "a number", "2")]
    assert store.manifest("BUSINESS.ACCOUNT")["column_tags"] == {"ACCOUNT_ID": {"gov.tags.PII_CATEGORY": "ID"}}


def test_store_buckets_conflicts_and_vacuum(spark, store):
    df = spark.range(100).selectExpr("id k", "id v")
    store.overwrite("A.T", df, ["k"])
    before = store.manifest("A.T")["parts"]
    assert store.replace_keys("A.T", spark.createDataFrame([(5, 500), (None, 1)], "k bigint, v bigint"), ["k"]) <= 2
    after = store.manifest("A.T")["parts"]
    assert sum(before[k] != after[k] for k in before) <= 2 and store.read("A.T").filter("v = 500").count() == 1 and store.read("A.T").count() == 101
    store.append("A.T", spark.createDataFrame([(200, 1)], "k bigint, v bigint"))
    store.replace_keys("A.T", spark.createDataFrame([(200, 2)], "k bigint, v bigint"), ["k"])
    assert [r.v for r in store.read("A.T").filter("k = 200").collect()] == [2] and store.read("A.T").count() == 102
    with pytest.raises(SchemaChanged):
        store.append("A.T", spark.range(1))
    with pytest.raises(Conflict):
        store._commit("A.T", 1, df.schema, {})
    assert store.vacuum("A.T", keep=1) > 0 and store.read("A.T").count() == 102


def test_stream_of_loads(spark, store, tmp_path):
    source = tmp_path / "stream"
    for i, (state, at) in enumerate((("GOLD", "2026-03-01 00:00:00"), ("BRONZE", "2026-01-01 00:00:00"))):
        spark.createDataFrame([("A1", state, at)], "account_id string, state string, changed string").coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema("account_id string, state string, changed string").json(str(source))
        loads.start(stream, require(derived()), store, str(tmp_path / "cp"), "q").awaitTermination()
    assert rows(store, "BUSINESS.ACCOUNT", "VALID_FROM_DATETIME", "STATE") == [("2026-01-01 00:00:00", "BRONZE"), ("2026-03-01 00:00:00", "GOLD")]
    assert rows(store, loads.BATCHES, "QUERY", "BATCH") == [("q", "1")]


@pytest.mark.parametrize("arrival", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_stream_orders_versions_of_one_start_whatever_the_batch(spark, store, tmp_path, arrival):
    """A1: three contents; A2: one content, whose order is no part of the hash; A3: nulls last; A4: equal order, by hash."""
    names, source, start = "account_id string, state string, changed string, seq bigint", tmp_path / "stream", "2026-01-01 00:00:00"
    batches = [[("A1", "a", 3), ("A2", "a", 1), ("A3", "a", None), ("A4", "a", 1)], [("A1", "b", 2), ("A2", "a", 3), ("A3", "b", 1), ("A4", "b", 1)], [("A1", "c", 1), ("A2", "b", 2), ("A4", "c", 1)]]
    spec = document("scd2_derived", [field("account_id"), field("state"), field("seq", "bigint")], scd={"validity": {"valid_from": {"source": {"column": "changed"}}}, "deduplicate": {"order_by": [{"column": "seq"}]}}, business_data_hash={"fields": ["seq"]})
    data = [[(k, v, start, n) for k, v, n in batch] for batch in batches]
    for i in arrival:
        spark.createDataFrame(data[i], names).coalesce(1).write.mode("append").json(str(source))
        loads.start(spark.readStream.schema(names).json(str(source)), require(spec), store, str(tmp_path / "cp"), "q").awaitTermination()
    once = Snapshots(spark, str(tmp_path / "once"), buckets=4)
    Loader(spark, spec, once, source=spark.createDataFrame(sum(data, []), names)).run()
    columns = ("ACCOUNT_ID", "STATE", "SEQ", "IS_CURRENT_FLAG", "VALID_TO_DATETIME")
    got = rows(store, "BUSINESS.ACCOUNT", *columns)
    assert got == rows(once, "BUSINESS.ACCOUNT", *columns)
    assert [r[1:3] for r in got][:3] == [("a", "3"), ("a", "3"), ("b", "1")]


def test_stream_needs_its_order_in_the_target(spark, store, tmp_path):
    stream = spark.readStream.schema("account_id string, state string, changed string, seq bigint").json(str(tmp_path))
    with pytest.raises(ValueError, match="SEQ"):
        loads.start(stream, require(derived(deduplicate={"order_by": [{"column": "seq"}]})), store, str(tmp_path / "cp"), "q")


def test_empty_source_and_plan(spark, store):
    load(spark, store, auto(), "account_id account_value", ("A1", "1"))
    refs = table(spark, "account_id account_value", ("A1", "1"))
    empty = {"TMP.S": refs["TMP.S"].limit(0)}
    assert Loader(spark, auto(), store, references=empty).run().loaded == 1
    assert Loader(spark, auto(insert_time="2027-01-01"), store, references=table(spark, "account_id account_value", ("A1", "9"))).plan().count() == 2


def test_events_of_loads_at_once(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    loaders = [Loader(spark, auto(), store, job_id=str(i)) for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda x: x._event("JOB_START", None), loaders))
    assert rows(store, "BUSINESS.LOAD_JOBS", "JOB_ID") == [(str(i),) for i in range(6)]


def test_a_load_between_merge_and_commit_is_not_lost(spark, store):
    names, once = "account_id account_value", []
    load(spark, store, auto(), names, ("A1", "1"))

    def other():
        if not once:
            once.append(1)
            load(spark, store, auto(insert_time="2026-09-02T00:00:00Z"), names, ("A1", "2"))

    report = load(spark, store, auto(insert_time="2026-09-03T00:00:00Z"), names, ("A1", "3"), fault=other)
    assert report.result == "COMPLETED"
    assert [r[1:] for r in rows(store, "BUSINESS.ACCOUNT", "VALID_FROM_DATETIME", "ACCOUNT_VALUE", "IS_CURRENT_FLAG")] == [("1", "N"), ("2", "N"), ("3", "Y")]


def test_commits_name_the_version_they_read(spark, store):
    df = spark.range(3).selectExpr("id k", "id v")
    store.overwrite("A.T", df, ["k"])
    store.append("A.T", df)
    for write in (lambda: store.overwrite("A.T", df, ["k"], base=1), lambda: store.append("A.T", df, base=1), lambda: store.replace_keys("A.T", df, ["k"], base=1)):
        with pytest.raises(Conflict):
            write()
    assert store.replace_keys("A.T", df, ["k"], base=2) > 0 and store.read("A.T").count() == 3


def test_a_manifest_that_was_never_put_in_place_is_not_seen(spark, store, tmp_path):
    df = spark.range(3).selectExpr("id k")
    store.overwrite("A.T", df)
    held = tmp_path / "tables" / "A" / "T" / "_tmp-0"
    held.write_text("{")  # a driver that died while it wrote
    assert store.read("A.T").count() == 3
    store.append("A.T", df)
    assert store.read("A.T").count() == 6 and store.manifest("A.T")["version"] == 2
    assert not [f for f in held.parent.iterdir() if f.name.startswith("_tmp-") and f != held]


def test_a_load_reads_the_buckets_of_its_keys(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "t"), buckets=32)
    data = [(f"A{k}", str(k)) for k in range(200)]
    load(spark, store, auto(), "account_id account_value", *data)
    loader = Loader(spark, auto(insert_time="2026-10-01T00:00:00Z"), store, references=table(spark, "account_id account_value", ("A7", "8")))
    incoming = loader.incoming(loader.judged())
    m = store.manifest("BUSINESS.ACCOUNT")
    some, whole = loader.existing(incoming, m, whole=False), loader.existing(incoming, m)
    assert len(some.inputFiles()) == 1 < len(whole.inputFiles()) and whole.count() == 200
    assert loader.run().rewritten == 2 and store.read("BUSINESS.ACCOUNT").count() == 201


def test_side_tables_are_tried_again(spark, store, monkeypatch):
    fields = [field("account_id"), field("n", "int", validations=[{"type": "min_value", "value": 2}])]
    spec = document("scd1", fields, failure_mode="quarantine_row")
    real, failed = Snapshots.append, []

    def append(self, name, *args, **more):
        if "QUARANTINE" in name and not failed:
            failed.append(name)
            raise Conflict("somebody was first")
        return real(self, name, *args, **more)

    monkeypatch.setattr(Snapshots, "append", append)
    assert load(spark, store, spec, "account_id n", ("A1", "1"), ("A2", "2")).result == "COMPLETED_WITH_QUARANTINE"
    assert failed and rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID") == [("A2",)] and store.read("INTERMEDIATE.ACCOUNT__QUARANTINE").count() == 1


def test_lookups_of_several_rows(spark, store):
    fields = [field("account_id"), {"id": "country", "lookup": {"reference_entity": "REF.C", "reference_attribute": "code", "source_expression": "c", "return_attribute": "name"}, "data_type": "text"}]
    refs = table(spark, "account_id c", ("A1", "au"), ("A2", "nz"))
    pairs = [("au", "Australia"), ("au", "Australia"), ("xx", "a"), ("xx", "b")]
    refs["REF.C"] = spark.createDataFrame(pairs, "code string, name string")
    Loader(spark, document("scd1", fields), store, references=refs).run()
    assert rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID", "COUNTRY") == [("A1", "Australia"), ("A2", "None")]
    refs["REF.C"] = spark.createDataFrame([*pairs, ("nz", "x"), ("nz", "y")], "code string, name string")
    with pytest.raises(Exception, match="several live rows"):
        Loader(spark, document("scd1", fields), store, references=refs).run()


def test_paths_need_semi_structured_values(spark, store):
    fields = [{"id": "account_id", "source": {"column": "n", "snowflake_path": "id"}, "data_type": "text"}]
    with pytest.raises(Exception, match="semi-structured"):
        Loader(spark, document("scd1", fields), store, references={"TMP.S": spark.range(2).selectExpr("id n")}).run()
    with pytest.raises(Exception, match="quoting"):
        from millrace.sources import scan

        scan.read_csv(spark, "x", True, quoting="none")


def test_executed_rules_get_row_field_and_rule(spark, store):
    class Before:
        def execute(self, *, value, row, field, rule, strict=False):
            return None if value <= row["until"] else f"{field} is after until ({rule['macro']}, {strict})"

    fields = [field("account_id"), field("start", validations=[{"type": "custom", "macro": "own.before", "args": {"strict": True}}])]
    spec = document("scd1", fields, failure_mode="quarantine_row")
    refs = table(spark, "account_id start until", ("A1", "2026-01-01", "2026-02-01"), ("A2", "2026-03-01", "2026-02-01"), ("A3", None, "2026-02-01"))
    Loader(spark, spec, store, references=refs, macros=Macros(registered={"own.before": Before()})).run()
    assert rows(store, "INTERMEDIATE.ACCOUNT__QUARANTINE", "ACCOUNT_ID", "FAILURE_DETAILS") == [("A2", "start is after until (own.before, True)")]


def test_files_are_uploaded_to_their_stage(spark, store, tmp_path):
    (tmp_path / "local.csv").write_text("account_id\nA1\n")
    stage = tmp_path / "stage"
    source = {"format": "csv", "header": True, "load_method": "stage", "location": {"stage": f"file://{stage}", "filename": "in.csv"}, "upload": {"enabled": True, "file": "local.csv"}}
    spec = document("scd1", [field("account_id")], source=source)
    Loader(spark, spec, store, tmp_path).run()
    assert rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID") == [("A1",)] and (stage / "in.csv").exists()
    (tmp_path / "local.csv").write_text("account_id\nA2\n")
    Loader(spark, spec, store, tmp_path).run()
    assert rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID") == [("A1",)]  # it was there
    source["upload"]["overwrite"] = True
    Loader(spark, spec, store, tmp_path).run()
    assert rows(store, "BUSINESS.ACCOUNT", "ACCOUNT_ID") == [("A2",)]
    source["load_method"] = "dbt_seed"
    with pytest.raises(Exception, match="load_method stage"):
        Loader(spark, spec, store, tmp_path)


def test_many_appends_become_one_part_and_buckets_change(spark, store, monkeypatch):
    from millrace.sources import snapshots

    monkeypatch.setattr(snapshots, "MOST_PARTS", 3)
    for k in range(6):
        store.append("A.LOG", spark.createDataFrame([(k, "x")], "k int, s string") if k < 5 else spark.createDataFrame([(k, "x", 1)], "k int, s string, more int"), widen=True)
    assert len(store.manifest("A.LOG")["parts"]) <= 3 and sorted((r.k, r.more) for r in store.read("A.LOG").collect()) == [*((k, None) for k in range(5)), (5, 1)]
    df = spark.range(50).selectExpr("id k", "id v")
    store.overwrite("A.T", df, ["k"], extra={"tags": {"a": "b"}})
    store.append("A.T", spark.createDataFrame([(7, 70)], "k bigint, v bigint"))
    store.rebucket("A.T", 9)
    m = store.manifest("A.T")
    assert m["buckets"] == 9 and m["tags"] == {"a": "b"} and len(m["parts"]) <= 9 and store.read("A.T").count() == 51
    store.replace_keys("A.T", spark.createDataFrame([(7, 700)], "k bigint, v bigint"), ["k"])
    assert [r.v for r in store.read("A.T").filter("k = 7").collect()] == [700] and store.read("A.T").count() == 50
    with pytest.raises(LookupError):
        store.rebucket("A.LOG", 2)


def test_first_load_of_a_history_moves_narrow_rows_once(spark, tmp_path):
    """No hash in hexadecimal digits is moved, a first load joins with nothing and deals its rows by key once, and valid rows leave
    their source columns behind."""
    from millrace.plans import load_queries as Q
    from millrace.plans.queries import _spec as document

    store = Snapshots(spark, str(tmp_path))
    source = spark.createDataFrame([(k % 3, k, dt.date(2020, 1, 1 + k)) for k in range(9)], "o_custkey bigint, o_orderkey bigint, o_orderdate date")
    loader = Loader(spark, document("scd2_derived", "customer", Q._ORDER_FIELDS, scd=Q._ORDER_SCD), store, source=source)
    incoming = loader.incoming(loader.judged())
    assert {len(r.T_BUSINESS_KEY) for r in incoming.collect()} == {1}
    plan = H.merge(loader.existing(incoming, None), incoming, loader.history)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    staged, stage = {}, loader.store.stage
    loader.store.stage = lambda label, df: staged.setdefault(label, df) and stage(label, df)
    loader.run()
    assert staged["verdict"].filter("_src IS NOT NULL").count() == 0
    rows = store.read("OUT.T").collect()
    assert len(rows) == 9 and {len(r.T_BUSINESS_KEY) for r in rows} == {64} == {len(r.BUSINESS_DATA_HASH) for r in rows}
    name = hashlib.sha256(str(rows[0].CUSTOMER).encode()).hexdigest()
    space = uuid.UUID("5aa788a5-783e-5ce6-b4aa-438de8fc6971")
    assert rows[0].T_BUSINESS_KEY == name and rows[0].T_KEY == str(uuid.uuid5(space, f"{name}|{rows[0].VALID_FROM_DATE}"))


def test_versions_keep_keys_and_hashes_that_others_would_compute_otherwise(spark, tmp_path):
    """Long values, and stored hashes and surrogate keys of another making, are the same after their bucket is written again."""
    from millrace.plans import load_queries as Q
    from millrace.plans.queries import _field, _spec as document

    store = Snapshots(spark, str(tmp_path), buckets=1)
    fields = [_field("customer", "o_custkey", "text"), Q._ORDER_FIELDS[1]]
    spec = document("scd2_derived", "customer", fields, scd=Q._ORDER_SCD)
    kind = "o_custkey string, o_orderkey bigint, o_orderdate date"
    long = "x" * 31, "x" * 32, "é" * 16, "y" * 200, "a", ""
    load = lambda rows: Loader(spark, spec, store, source=spark.createDataFrame(rows, kind)).run()
    load([(k, 1, dt.date(2020, 1, 1)) for k in long])
    m = store.manifest("OUT.T")
    odd = store.read("OUT.T").withColumns({"BUSINESS_DATA_HASH": F.sha2(F.lit("other"), 256), "T_KEY": F.lit("own")})
    store.overwrite("OUT.T", odd, m["keys"])
    load([("a", 2, dt.date(2020, 2, 1)), ("new", 1, dt.date(2020, 2, 1))])
    rows = {(r.CUSTOMER, r.ORDER_ID): r for r in store.read("OUT.T").collect()}
    other = hashlib.sha256(b"other").hexdigest()
    for k in long:
        if k and k != "a":
            r = rows[k, 1]
            assert (r.T_BUSINESS_KEY, r.BUSINESS_DATA_HASH, r.T_KEY) == (hashlib.sha256(k.encode()).hexdigest(), other, "own")
    assert rows["a", 1].BUSINESS_DATA_HASH == other and rows["a", 2].BUSINESS_DATA_HASH == hashlib.sha256(b"2").hexdigest()
    assert rows["new", 1].T_BUSINESS_KEY == hashlib.sha256(b"new").hexdigest()
