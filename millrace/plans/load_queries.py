"""Queries that run whole loads from specifications, each on a store of its own, with SQL for the rows that they leave."""

from __future__ import annotations

import json
from contextlib import suppress
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import dates, rules, transforms
from millrace.functions.macros import Macros
from millrace.operators import history as H
from millrace.operators import verdict as V
from millrace.operators.verdict import ValidationFailed
from millrace.plans.load import Loader
from millrace.plans.queries import _field, _spec, _t, query
from millrace.sources import scan
from millrace.sources.snapshots import Snapshots, scratch
from millrace.spec import check
from millrace.streaming import loads

_FIRST, _SECOND = datetime(2026, 1, 1), datetime(2026, 2, 1)


def _run(spark, store: Snapshots, spec: dict, at: datetime = _FIRST, **more):
    return Loader(spark, spec, store, run_at=at, **more).run()


def _csv_spec(path: str, fields: list[dict], **source) -> dict:
    spec = _spec("scd1", fields[0]["id"], fields)
    spec["source"] = {"format": "csv", "load_method": "dbt_seed", "seed": {"file": path}, **source}
    return spec


def _query_spec(text: str, change: str, key: str, fields: list[dict], **control) -> dict:
    spec = _spec(change, key, fields, **control)
    spec["source"] = {"format": "table", "query": text}
    return spec


def _write_csv(df: DataFrame, store: Snapshots, **options) -> str:
    path = f"{store.root}/_input/rows.csv"
    df.write.options(**options).csv(path)
    return path


# ---- sources


@query("SELECT CAST(c_custkey AS BIGINT) ID, c_name || ', \"' || c_mktsegment || '\"' AS LABEL, CAST(c_acctbal AS DECIMAL(12,2)) BALANCE, 'file' ORIGIN FROM customer")
def load_csv(spark, d):
    """A header, fields by column and by position, a delimiter of its own, quotes within quoted values."""
    store = scratch(spark, "load-csv")
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("label"), F.col("c_acctbal").cast("decimal(12,2)").alias("balance"))
    path = _write_csv(c, store, sep=";", quote='"', escape='"', header=True, quoteAll=True)
    fields = [_field("id", "id", "bigint"), {"id": "label", "source": {"pos": 1, "column": "label"}, "data_type": "text"}, {"id": "balance", "source": {"pos": 2}, "data_type": "number(12,2)"}, {"id": "origin", "source": {"fixed_value": "file"}, "data_type": "text"}]
    stage, _, file = path.rpartition("/")
    spec = _csv_spec(path, fields, header=True, delimiter=";", quoting="all", load_method="stage", location={"stage": stage, "filename": file})
    del spec["source"]["seed"]
    _run(spark, store, spec)
    return store.read("OUT.T").select("ID", "LABEL", "BALANCE", "ORIGIN")


@query("SELECT CAST(o_orderkey AS BIGINT) ID, 'line one' || chr(10) || o_orderpriority NOTE, nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END, '') STATUS FROM orders")
def load_csv_headerless(spark, d):
    """Positions only; quoted values that hold line ends; empty fields become null."""
    store = scratch(spark, "load-headerless")
    o = _t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("line one\n"), "o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderstatus")))
    fields = [{"id": n, "source": {"pos": k}, "data_type": t} for k, (n, t) in enumerate((("id", "bigint"), ("note", "text"), ("status", "varchar(1)")))]
    _run(spark, store, _csv_spec(_write_csv(o, store, quoteAll=True, emptyValue=""), fields, header=False))
    return store.read("OUT.T").select("ID", "NOTE", "STATUS")


@query("SELECT c_custkey ID, n_name NATION, count(*) ORDERS, CAST(sum(o_totalprice) AS DECIMAL(18,2)) TOTAL FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL HAVING count(*) > 1")
def load_query_source(spark, d):
    """A query with joins, aggregates, a WITH clause, and strings and comments that look like relations."""
    store = scratch(spark, "load-query")
    text = """with per as ( -- from src.nowhere
select o_custkey, count(*) n, sum(o_totalprice) total from src.orders group by o_custkey having count(*) > 1)
select c_custkey id, n_name nation, n orders, total, 'from src.orders' note from per join src.customer on o_custkey = c_custkey /* join src.orders */ join src.nation on c_nationkey = n_nationkey"""
    fields = [_field("id", "id", "bigint"), _field("nation", "nation", "text"), _field("orders", "orders", "bigint"), _field("total", "total", "number(18,2)")]
    tables = {f"SRC.{n.upper()}": _t(spark, d, n) for n in ("orders", "customer", "nation")}
    _run(spark, store, _query_spec(text, "scd1", "id", fields), references=tables)
    return store.read("OUT.T").select("ID", "NATION", "ORDERS", "TOTAL")


_CURRENT_NATIONS = "(SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 4 <> 0)"


@query(f"""SELECT c_custkey ID, n_name NATION, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), upper(trim(c_name))) SEGMENT, upper(trim(c_name)) NAME,
    CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE c_mktsegment END GRP, 'fixed' KIND, 'always' EVER FROM customer LEFT JOIN {_CURRENT_NATIONS} ON c_nationkey = n_nationkey""")
def load_lookup_defaults_macro(spark, d):
    """A lookup of current rows, defaults by value and by field, fixed values and a macro, all through the loader."""
    store = scratch(spark, "load-lookup")
    c = _t(spark, d, "customer").withColumn("seg", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise("")).withColumn("grp", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    c = c.withColumn("shouted", F.upper(F.trim("c_name")))
    n = _t(spark, d, "nation").withColumn("IS_CURRENT_FLAG", F.when(F.col("n_nationkey") % 4 != 0, "Y").otherwise("N"))
    fields = [
        _field("id", "c_custkey", "bigint"),
        {"id": "nation", "lookup": {"reference_entity": "REF.NATION", "reference_attribute": "n_nationkey", "source_expression": "c_nationkey", "return_attribute": "n_name"}, "data_type": "text"},
        {"id": "segment", "source": {"column": "seg", "default_from_field": "shouted"}, "data_type": "text"},
        _field("shouted", "shouted", "text"),
        _field("name", "c_name", "text", transforms=[{"type": "custom", "macro": "account_macros.normalise_account_name"}]),
        {"id": "grp", "source": {"column": "grp", "default_value": "none"}, "data_type": "text"},
        {"id": "kind", "source": {"fixed_value": "fixed"}, "data_type": "text"},
        {"id": "ever", "source": {"default_value": "always"}, "data_type": "text"},
    ]
    _run(spark, store, _spec("scd1", "id", fields), source=c, references={"REF.NATION": n})
    return store.read("OUT.T").select("ID", "NATION", "SEGMENT", "NAME", "GRP", "KIND", "EVER")


@query("SELECT c_custkey ID, c_name || '/' || c_mktsegment TAGGED FROM customer")
def load_source_macro(spark, d):
    """A field whose column a source macro adds."""
    store = scratch(spark, "load-macro")

    def tagged(df, field, args):
        return df.withColumn(field, F.concat_ws(args["sep"], "c_name", "c_mktsegment"))

    fields = [_field("id", "c_custkey", "bigint"), {"id": "tagged", "source": {"macro": "own.tagged", "args": {"sep": "/"}}, "data_type": "text"}]
    _run(spark, store, _spec("scd1", "id", fields), source=_t(spark, d, "customer"), macros=Macros(registered={"own.tagged": tagged}))
    return store.read("OUT.T").select("ID", "TAGGED")


@query("SELECT l_orderkey ID, l_linenumber N, CAST(l_quantity AS BIGINT) QTY FROM lineitem")
def load_paths_and_flatten(spark, d):
    """JSON documents: an array is flattened and fields are taken by path, through the loader."""
    store = scratch(spark, "load-paths")
    lines = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("bigint").alias("qty"))))
    docs = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines")).select(F.to_json(F.struct(F.col("l_orderkey").alias("id"), "lines")).alias("payload"))
    spec = _spec("scd1", "id", [{"id": n, "source": {"column": c, "snowflake_path": p}, "data_type": "bigint"} for n, c, p in (("id", "payload", "id"), ("n", "line", "n"), ("qty", "line", "qty"))])
    spec["control_data"]["business_key"]["fields"] = ["id", "n"]
    spec["source"] |= {"flatten": {"column": "payload", "path": "lines", "alias": "line", "mode": "array"}}
    _run(spark, store, spec, source=docs)
    return store.read("OUT.T").select("ID", "N", "QTY")


# ---- verdicts


@query("""SELECT CAST(o_orderkey AS VARCHAR) O_ORDERKEY, CASE WHEN o_orderkey % 7 = 0 THEN 'field `opened` does not match parse_date format `%Y-%m-%d`'
    WHEN o_orderkey % 5 = 0 THEN 'account number must use ACCT followed by 12 non-zero-sequence digits' END FAILURE_DETAILS FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0""")
def load_parse_and_custom_failures(spark, d):
    store = scratch(spark, "load-failures")
    o = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("opened"), F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise("ACCT000000000001").alias("number"))
    fields = [_field("id", "o_orderkey", "bigint"), _field("opened", "opened", "date", transforms=[{"type": "parse_date", "format": "%Y-%m-%d"}]), _field("number", "number", "text", validations=[{"type": "custom", "macro": "account_macros.validate_account_number"}])]
    _run(spark, store, _spec("scd1", "id", fields, failure_mode="quarantine_row"), source=o)
    return store.read("INTERMEDIATE.T__QUARANTINE").select("O_ORDERKEY", "FAILURE_DETAILS")


@query("""SELECT CAST(c_custkey AS VARCHAR) C_CUSTKEY, 'field `nation` duplicates a value for a unique field' FAILURE_DETAILS FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY ALL HAVING count(*) > 1)""")
def load_unique_field(spark, d):
    store = scratch(spark, "load-unique")
    _run(spark, store, _spec("scd1", "id", [_field("id", "c_custkey", "bigint"), _field("nation", "c_nationkey", "bigint", unique=True)], failure_mode="quarantine_row"), source=_t(spark, d, "customer"))
    return store.read("INTERMEDIATE.T__QUARANTINE").select("C_CUSTKEY", "FAILURE_DETAILS")


@query("SELECT c_custkey ID, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 END AS BIGINT) CODE FROM customer")
def load_without_validation(spark, d):
    """Validation off: rules are not applied; values are cast."""
    store = scratch(spark, "load-unvalidated")
    c = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "1").alias("code"))
    spec = _spec("scd1", "id", [_field("id", "c_custkey", "bigint"), _field("code", "code", "bigint", nullable=False, validations=[{"type": "min_value", "value": 5}])], validation_enabled=False)
    _run(spark, store, spec, source=c)
    return store.read("OUT.T").select("ID", "CODE")


@query("""SELECT 1 AS RUN, 'JOB_START' EVENT_TYPE, NULL::VARCHAR "RESULT", NULL::VARCHAR DETAILS, 0::BIGINT TABLES
UNION ALL SELECT 1, 'JOB_END', 'FAILED', 'validation errors failed the load', 0 UNION ALL SELECT 2, 'JOB_START', NULL, NULL, 0
UNION ALL SELECT 2, 'JOB_END', 'FAILED', 'the load failed; see the error that was raised', 0""")
def load_failed_jobs(spark, d):
    """A load that fails by its rows, and one that breaks off before its commit: events with both details, and no table."""
    store = scratch(spark, "load-failed")

    def broken():
        raise RuntimeError("broken off")

    fields = [_field("id", "c_custkey", "bigint"), _field("balance", "c_acctbal", "number(12,2)")]
    c = _t(spark, d, "customer")
    with suppress(ValidationFailed):
        _run(spark, store, _spec("scd1", "id", [fields[0], {**fields[1], "validations": [{"type": "min_value", "value": 0}]}]), source=c, job_id="1")
    with suppress(RuntimeError):
        _run(spark, store, _spec("scd1", "id", fields), source=c, job_id="2", fault=broken)
    made = int(store.exists("OUT.T"))
    return store.read("BUSINESS.LOAD_JOBS").select(F.col("JOB_ID").cast("int").alias("RUN"), "EVENT_TYPE", "RESULT", "DETAILS", F.lit(made).cast("bigint").alias("TABLES"))


@query("SELECT 2::BIGINT RUNS, count(*) QUARANTINED, count(*) FILTER (c_custkey % 2 = 0) WITH_MORE, 1::BIGINT COLUMNS_MORE FROM customer WHERE c_acctbal < 0")
def load_quarantine_widened(spark, d):
    """A second load whose source has one more column adds it to the quarantine; job ids tell the runs apart."""
    store = scratch(spark, "load-widened")
    spec = _spec("scd1", "id", [_field("id", "c_custkey", "bigint"), _field("balance", "c_acctbal", "number(12,2)", validations=[{"type": "min_value", "value": 0}])], failure_mode="quarantine_row")
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    _run(spark, store, spec, source=c.filter("c_custkey % 2 <> 0"))
    before = set(store.read("INTERMEDIATE.T__QUARANTINE").columns)
    _run(spark, store, spec, source=c.filter("c_custkey % 2 = 0").withColumn("more", F.lit("m")))
    q = store.read("INTERMEDIATE.T__QUARANTINE")
    return q.agg(F.count_distinct("JOB_ID").alias("RUNS"), F.count(F.lit(1)).alias("QUARANTINED"), F.count("MORE").alias("WITH_MORE"), F.lit(len(set(q.columns) - before)).cast("bigint").alias("COLUMNS_MORE"))


# ---- keys, audit, governance


@query("SELECT count(*) ROWS_LOADED, count(*) KEYS, 36 AS KEY_LENGTH FROM customer")
def load_random_surrogate(spark, d):
    """A current-state table gets a random key for each row."""
    store = scratch(spark, "load-random")
    _run(spark, store, _spec("scd1", "id", [_field("id", "c_custkey", "bigint")]), source=_t(spark, d, "customer"))
    return store.read("OUT.T").agg(F.count(F.lit(1)).alias("ROWS_LOADED"), F.count_distinct("T_KEY").alias("KEYS"), F.min(F.length("T_KEY")).alias("KEY_LENGTH"))


@query("""SELECT c_custkey ID, c_mktsegment SEGMENT, CASE WHEN c_custkey % 10 = 0 THEN 'N' ELSE 'Y' END IS_CURRENT_FLAG, TIMESTAMP '2026-01-01' AUDIT_CREATED_DATETIME, 'p1' AUDIT_DATA_PROCESS_KEY FROM customer
UNION ALL SELECT c_custkey, 'MOVED', 'Y', TIMESTAMP '2026-02-01', 'p2' FROM customer WHERE c_custkey % 10 = 0""")
def load_audit_columns(spark, d):
    """Versions that a later load writes again keep the audit columns of the load that made them."""
    store = scratch(spark, "load-audit")
    fields, c = [_field("id", "c_custkey", "bigint"), _field("segment", "c_mktsegment", "text")], _t(spark, d, "customer")
    _run(spark, store, _spec("scd2_auto", "id", fields, scd={"insert_time": "2026-01-01T00:00:00Z"}), source=c, variables={"audit_data_process_key": "p1"})
    moved = c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    _run(spark, store, _spec("scd2_auto", "id", fields, scd={"insert_time": "2026-02-01T00:00:00Z"}), _SECOND, source=moved, variables={"audit_data_process_key": "p2"})
    return store.read("OUT.T").select("ID", "SEGMENT", "IS_CURRENT_FLAG", "AUDIT_CREATED_DATETIME", "AUDIT_DATA_PROCESS_KEY")


@query("""SELECT * FROM (VALUES (0, 'T_KEY'), (1, 'T_BUSINESS_KEY'), (2, 'ID'), (3, 'SEGMENT'), (4, 'IS_CURRENT_FLAG'), (5, 'IS_DELETED_FLAG'), (6, 'VALID_FROM_DATETIME'), (7, 'VALID_TO_DATETIME'),
    (8, 'BUSINESS_DATA_HASH'), (9, 'AUDIT_CREATED_DATETIME'), (10, 'AUDIT_LAST_CHANGED_DATETIME'), (11, 'AUDIT_DATA_PROCESS_KEY')) v(POS, NAME)""")
def load_column_order(spark, d):
    store = scratch(spark, "load-order")
    spec = _spec("scd2_auto", "id", [_field("id", "c_custkey", "bigint"), _field("segment", "c_mktsegment", "text")], scd={"insert_time": "2026-01-01T00:00:00Z"})
    _run(spark, store, spec, source=_t(spark, d, "customer"))
    return spark.createDataFrame(list(enumerate(store.read("OUT.T").columns)), "POS int, NAME string")


@query("""SELECT 'ID' COLUMN_NAME, 'KEY' PII_CATEGORY, NULL::VARCHAR DESCRIPTION, '2' CONTRACT_VERSION, 1::BIGINT CALLS UNION ALL SELECT 'SEGMENT', NULL, 'market', '2', 1""")
def load_contract(spark, d):
    """Contract rows of tagged and described columns, written once however often the load runs; then the procedure."""
    store, called = scratch(spark, "load-contract"), []
    spec = _spec("scd1", "id", [_field("id", "c_custkey", "bigint", tags={"gov.tags.PII_CATEGORY": "KEY"}), _field("segment", "c_mktsegment", "text", description="market"), _field("name", "c_name", "text")])
    spec["target"] |= {"tag_application": "apply_governance", "governance_contract": {"table": "gov.contract", "source": "git", "version": 2}}
    for _ in range(2):
        _run(spark, store, spec, source=_t(spark, d, "customer"), governance=called.append)
    return store.read("GOV.CONTRACT").select("COLUMN_NAME", "PII_CATEGORY", "DESCRIPTION", "CONTRACT_VERSION", F.lit(len(set(called))).cast("bigint").alias("CALLS"))


@query("""SELECT '' COLUMN_NAME, '{"owner": "sales"}' TAGS UNION ALL SELECT 'ID', '{"gov.pii": "KEY"}'""")
def load_tags(spark, d):
    """Tags of the table and of columns: readers get column tags as metadata of the schema, table tags from the manifest."""
    store = scratch(spark, "load-tags")
    spec = _spec("scd1", "id", [_field("id", "c_custkey", "bigint", tags={"gov.pii": "KEY"}), _field("segment", "c_mktsegment", "text")])
    spec["target"] |= {"tags": {"owner": "sales"}}
    _run(spark, store, spec, source=_t(spark, d, "customer"))
    rows = [("", json.dumps(store.manifest("OUT.T")["tags"]))]
    rows += [(f.name, json.dumps(f.metadata["tags"])) for f in store.read("OUT.T").schema if f.metadata.get("tags")]
    return spark.createDataFrame(rows, "COLUMN_NAME string, TAGS string")


# ---- bookmarks


@query("""WITH b AS (SELECT make_timestamp(epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2) AS m, max(ts) AS h FROM events)
SELECT event_id ID, (SELECT h FROM b) AS MARK FROM events WHERE ts > (SELECT m FROM b)""")
def load_bookmark(spark, d):
    """The second load reads what came after the bookmark of the first, and moves it to the end."""
    store = scratch(spark, "load-bookmark")
    e = _t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    middle = e.agg(F.timestamp_micros(F.unix_micros(F.min("ts").cast("timestamp")) + F.expr("(unix_micros(cast(max(ts) as timestamp)) - unix_micros(cast(min(ts) as timestamp))) div 2")).cast("timestamp_ntz")).first()[0]
    spec = _query_spec("select event_id, ts from src.events where {{ x_incremental_bookmark_predicate('ts') }}", "scd1", "id", [_field("id", "event_id", "bigint"), _field("ts", "ts", "timestamp_ntz")], incremental_bookmark={"bookmark_relation": "OPS.MARKS", "source_relation": "SRC.EVENTS", "source_timestamp_column": "ts"})
    for seen in (e.filter(F.col("ts") <= F.lit(middle)), e):
        first = seen.agg(F.max("ts")).first()[0]
        if first is not None:
            _run(spark, store, spec, references={"SRC.EVENTS": seen if seen is e else seen.unionByName(spark.createDataFrame([(None, middle)], "event_id bigint, ts timestamp_ntz"))})
    mark = store.read("OPS.MARKS").agg(F.max("LAST_SOURCE_TIMESTAMP")).first()[0]
    return store.read("OUT.T").select("ID", F.lit(mark).cast("timestamp_ntz").alias("MARK"))


# ---- histories


_ORDER_FIELDS = [_field("customer", "o_custkey", "bigint"), _field("order_id", "o_orderkey", "bigint")]
_ORDER_SCD = {"validity": {"data_type": "date", "valid_from": {"column": "VALID_FROM_DATE", "source": {"column": "o_orderdate"}}, "valid_to": {"column": "VALID_TO_DATE"}}, "deduplicate": {"order_by": [{"column": "order_id"}]}}
_ORDER_SQL = """WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) f, max(o_orderkey) k FROM orders GROUP BY ALL)
SELECT CAST(o_custkey AS BIGINT) CUSTOMER, CAST(k AS BIGINT) ORDER_ID, f VALID_FROM_DATE, coalesce(CAST(lead(f) OVER w - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') VALID_TO_DATE, CASE WHEN lead(f) OVER w IS NULL THEN 'Y' ELSE 'N' END IS_CURRENT_FLAG{more}
FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY f)"""


def _dated(spark, d) -> DataFrame:
    return _t(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


@query(_ORDER_SQL.replace("{more}", ", 0::BIGINT REWRITTEN"))
def load_scd2_derived_rerun(spark, d):
    """The same source again: only current versions, and earlier ones, are there already; nothing is written."""
    store, spec = scratch(spark, "load-rerun"), _spec("scd2_derived", "customer", _ORDER_FIELDS, scd=_ORDER_SCD)
    o = _dated(spark, d).groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    _run(spark, store, spec, source=o)
    again = _run(spark, store, spec, _SECOND, source=o)
    return store.read("OUT.T").select("CUSTOMER", "ORDER_ID", "VALID_FROM_DATE", "VALID_TO_DATE", "IS_CURRENT_FLAG", F.lit(again.rewritten).cast("bigint").alias("REWRITTEN"))


@query(_ORDER_SQL.replace("{more}", ""))
def load_scd2_rebuild(spark, d):
    """truncate_before_load: the history is built from this source alone, whatever was there."""
    store = scratch(spark, "load-rebuild")
    spec = _spec("scd2_derived", "customer", _ORDER_FIELDS, scd=_ORDER_SCD, truncate_before_load=True)
    o = _dated(spark, d)
    for rows in (o.withColumn("o_orderkey", F.col("o_orderkey") + 7), o):
        _run(spark, store, spec, source=rows, variables={"allow_truncate": True})
    return store.read("OUT.T").select("CUSTOMER", "ORDER_ID", "VALID_FROM_DATE", "VALID_TO_DATE", "IS_CURRENT_FLAG")


@query("""WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate f, sha256(o_orderstatus) s FROM orders),
    e1 AS (SELECT * FROM v WHERE o_orderkey % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey, f ORDER BY o_orderkey DESC) = 1),
    e2 AS (SELECT * FROM e1 QUALIFY coalesce(lag(s) OVER (PARTITION BY o_custkey ORDER BY f) <> s, TRUE)),
    e AS (SELECT *, lead(f) OVER (PARTITION BY o_custkey ORDER BY f) IS NULL AS cur FROM e2),
    n AS (SELECT * FROM v WHERE o_orderkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM e WHERE e.o_custkey = v.o_custkey AND e.s = v.s AND (e.f = v.f OR e.cur AND v.f >= e.f))),
    u AS (SELECT o_custkey, o_orderkey, f, s, 1 x FROM e UNION ALL SELECT o_custkey, o_orderkey, f, s, 0 FROM n),
    o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey, f ORDER BY x, o_orderkey DESC, s DESC) = 1),
    c AS (SELECT *, lag(s) OVER w s1, lag(s, 2) OVER w s2, coalesce(lag(x) OVER w, 1) x1 FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY f)),
    k AS (SELECT * FROM c WHERE CASE WHEN x = 0 THEN NOT coalesce(s1 = s, FALSE) ELSE NOT (coalesce(s1 = s, FALSE) AND x1 = 0 AND NOT coalesce(s2 = s, FALSE)) END)
SELECT o_custkey, o_orderkey, 'N' IS_DELETED_FLAG, f AS VALID_FROM_DATETIME, s BUSINESS_DATA_HASH,
    coalesce(lead(f) OVER (PARTITION BY o_custkey ORDER BY f) - INTERVAL 1 MICROSECOND, TIMESTAMP '9999-12-31 23:59:59') AS VALID_TO_DATETIME,
    CASE WHEN lead(f) OVER (PARTITION BY o_custkey ORDER BY f) IS NULL THEN 'Y' ELSE 'N' END IS_CURRENT_FLAG FROM k""")
def scd2_derived_backfill(spark, d):
    """The whole target after late rows came into existing windows; the SQL follows both steps."""
    from millrace.plans.queries import _ORDERS, _empty, _order_versions

    early = _order_versions(spark, d, "o_orderkey % 3 <> 0")
    target = H.merge(_empty(early, _ORDERS), early, _ORDERS)
    late = _order_versions(spark, d, "o_orderkey % 3 = 0")
    return H.after_load(H.merge(target, late, _ORDERS), target, _ORDERS)


@query("""SELECT o_custkey CUSTOMER, count(*) VERSIONS, 0::BIGINT INVALID_KEYS FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) f FROM orders) WHERE o_custkey % 4 <> 0 GROUP BY ALL
UNION ALL SELECT NULL, 0, count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 4 = 0""")
def load_invalid_keys(spark, d):
    """Entities with a row without a start are left out and counted; the others are loaded."""
    store = scratch(spark, "load-invalid")
    o = _dated(spark, d)
    late = o.filter("o_custkey % 4 = 0").select("o_custkey", "o_orderkey").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")).withColumn("o_orderdate", F.lit(None).cast("date"))
    report = _run(spark, store, _spec("scd2_derived", "customer", _ORDER_FIELDS, scd=_ORDER_SCD, failure_mode="quarantine_row"), source=o.select("o_custkey", "o_orderkey", "o_orderdate").unionByName(late))
    counts = store.read("OUT.T").groupBy("CUSTOMER").agg(F.count(F.lit(1)).alias("VERSIONS"), F.lit(0).cast("bigint").alias("INVALID_KEYS"))
    return counts.unionByName(spark.createDataFrame([(None, 0, report.invalid_keys)], "CUSTOMER bigint, VERSIONS bigint, INVALID_KEYS bigint"))


@query("SELECT count(*) VERSIONS, 0::BIGINT EQUAL_PREVIOUS, 0::BIGINT EQUAL_NEXT, 0::BIGINT EQUAL_SECOND, (SELECT count(*) FROM customer) EQUAL_CURRENT FROM (SELECT 1 FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 1 FROM customer WHERE c_custkey % 10 = 0)")
def load_duplicate_metrics(spark, d):
    """The metrics of a second load in which every tenth customer is new and all are sent again: rewritten versions, and
    incoming rows equal to a current one."""
    store = scratch(spark, "load-metrics")
    fields, c = [_field("id", "c_custkey", "bigint"), _field("segment", "c_mktsegment", "text")], _t(spark, d, "customer")
    _run(spark, store, _spec("scd2_auto", "id", fields, scd={"insert_time": "2026-01-01T00:00:00Z"}), source=c)
    moved = c.unionByName(c.filter("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("MOVED")))
    report = _run(spark, store, _spec("scd2_auto", "id", fields, scd={"insert_time": "2026-02-01T00:00:00Z"}), source=moved, variables={"log_scd2_duplicate_hash_metrics": "true"})
    names = {"versions": "VERSIONS", "equal_previous": "EQUAL_PREVIOUS", "equal_next": "EQUAL_NEXT", "equal_second_previous": "EQUAL_SECOND", "equal_current": "EQUAL_CURRENT"}
    return spark.createDataFrame([tuple(report.metrics[n] for n in names)], ", ".join(f"{n} bigint" for n in names.values()))


_MANUAL = [_field("id", "id", "bigint"), _field("segment", "segment", "text"), *[_field(n, n, t) for n, t in (("is_current_flag", "varchar(1)"), ("is_deleted_flag", "varchar(1)"), ("valid_from_datetime", "timestamp_ntz"), ("valid_to_datetime", "timestamp_ntz"))]]


def _windows(df: DataFrame, segment, current: str, start: str, end: str) -> DataFrame:
    ntz = lambda x: F.lit(x).cast("timestamp_ntz")
    return df.select(F.col("c_custkey").alias("id"), segment.alias("segment"), F.lit(current).alias("is_current_flag"), F.lit("N").alias("is_deleted_flag"), ntz(start).alias("valid_from_datetime"), ntz(end).alias("valid_to_datetime"))


_MANUAL_COLUMNS = ["ID", "SEGMENT", "IS_CURRENT_FLAG", "VALID_FROM_DATETIME", "VALID_TO_DATETIME"]


@query("""SELECT c_custkey ID, c_mktsegment SEGMENT, CASE WHEN c_custkey % 10 = 0 THEN 'N' ELSE 'Y' END IS_CURRENT_FLAG, TIMESTAMP '2020-01-01' VALID_FROM_DATETIME, CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '2020-12-31' ELSE TIMESTAMP '9999-12-31' END VALID_TO_DATETIME FROM customer
UNION ALL SELECT c_custkey, 'MOVED', 'Y', TIMESTAMP '2021-01-01', TIMESTAMP '9999-12-31' FROM customer WHERE c_custkey % 10 = 0""")
def load_scd2_manual_upsert(spark, d):
    """Windows that the source manages: a second load closes some by the update key and adds their successors."""
    store, c = scratch(spark, "load-upsert"), _t(spark, d, "customer")
    spec = _spec("scd2_manual", "id", _MANUAL, scd={"update_mode": "upsert", "update_key": {"fields": ["valid_from_datetime"]}})
    _run(spark, store, spec, source=_windows(c, F.col("c_mktsegment"), "Y", "2020-01-01", "9999-12-31"))
    some = c.filter("c_custkey % 10 = 0")
    _run(spark, store, spec, _SECOND, source=_windows(some, F.col("c_mktsegment"), "N", "2020-01-01", "2020-12-31").unionByName(_windows(some, F.lit("MOVED"), "Y", "2021-01-01", "9999-12-31")))
    return store.read("OUT.T").select(*_MANUAL_COLUMNS)


@query("""SELECT c_custkey ID, c_mktsegment SEGMENT, 'N' IS_CURRENT_FLAG, TIMESTAMP '2020-01-01' VALID_FROM_DATETIME, TIMESTAMP '2020-12-31' VALID_TO_DATETIME FROM customer
UNION ALL SELECT c_custkey, 'NEXT', 'Y', TIMESTAMP '2021-01-01', TIMESTAMP '9999-12-31' FROM customer""")
def load_scd2_manual_append(spark, d):
    store, c = scratch(spark, "load-append"), _t(spark, d, "customer")
    spec = _spec("scd2_manual", "id", _MANUAL, scd={"update_mode": "append_only"})
    _run(spark, store, spec, source=_windows(c, F.col("c_mktsegment"), "N", "2020-01-01", "2020-12-31"))
    _run(spark, store, spec, _SECOND, source=_windows(c, F.lit("NEXT"), "Y", "2021-01-01", "9999-12-31"))
    return store.read("OUT.T").select(*_MANUAL_COLUMNS)


@query("SELECT CAST(c_custkey AS VARCHAR) ID, 'scd2_manual validity windows overlap for the same business key' FAILURE_DETAILS, (SELECT count(*) FROM customer) LOADED FROM customer WHERE c_custkey % 10 = 0")
def load_scd2_manual_state(spark, d):
    """Rows whose entity would get overlapping windows are quarantined with the failure of the state."""
    store, c = scratch(spark, "load-state"), _t(spark, d, "customer")
    spec = _spec("scd2_manual", "id", _MANUAL, scd={"update_mode": "append_only"}, failure_mode="quarantine_row")
    _run(spark, store, spec, source=_windows(c, F.col("c_mktsegment"), "N", "2020-01-01", "2020-12-31"))
    _run(spark, store, spec, _SECOND, source=_windows(c.filter("c_custkey % 10 = 0"), F.lit("NEXT"), "Y", "2020-06-01", "9999-12-31"))
    loaded = store.read("OUT.T").count()
    return store.read("INTERMEDIATE.T__QUARANTINE").select("ID", "FAILURE_DETAILS", F.lit(loaded).cast("bigint").alias("LOADED"))


@query(_ORDER_SQL.replace("{more}", ""))
def load_stream(spark, d):
    """A stream of files, a micro-batch each: the history is that of one load."""
    store = scratch(spark, "load-stream")
    o = _dated(spark, d).select(F.col("o_custkey").cast("long").alias("o_custkey"), F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderdate")
    o.repartition(2, "o_orderkey").write.parquet(f"{store.root}/_input/orders")
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(f"{store.root}/_input/orders")
    spec = check.require(_spec("scd2_derived", "customer", _ORDER_FIELDS, scd=_ORDER_SCD))
    loads.start(stream, spec, store, f"{store.root}/_checkpoint", "orders").awaitTermination()
    return store.read("OUT.T").select("CUSTOMER", "ORDER_ID", "VALID_FROM_DATE", "VALID_TO_DATE", "IS_CURRENT_FLAG")


# ---- transforms beyond whole numbers of two decimals


@query("""SELECT o_orderkey, CAST(round(x, 3) AS VARCHAR) half_up, CAST(CAST(trunc(x * 1000) / 1000 AS DECIMAL(38,3)) AS VARCHAR) down, CAST(round(-x, 3) AS VARCHAR) minus
FROM (SELECT o_orderkey, CAST(o_orderkey AS DECIMAL(26,11)) + CAST(o_custkey AS DECIMAL(26,11)) * 0.00012345678 x FROM orders)""")
def round_long_numbers(spark, d):
    x = (F.col("o_orderkey").cast("decimal(20,0)") + F.col("o_custkey").cast("decimal(12,0)") * F.lit("0.00012345678").cast("decimal(12,11)")).cast("decimal(38,11)")
    text, minus = x.cast("string"), (-x).cast("string")
    return _t(spark, d, "orders").select("o_orderkey", transforms.round_number(text, 3).alias("half_up"), transforms.round_number(text, 3, "down").alias("down"), transforms.round_number(minus, 3).alias("minus"))


@query("""SELECT o_orderkey, date_trunc('day', o_orderdate) - INTERVAL 10 HOUR AS local_start, date_trunc('day', o_orderdate) + INTERVAL 14 HOUR - INTERVAL 1 MICROSECOND AS local_end, date_trunc('day', o_orderdate) AS utc_start FROM orders""")
def parse_ts_local_zone(spark, d):
    """Times without zone, in a zone without daylight saving and in UTC."""
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    made = {"local_start": dates.parse_timestamp(day, "%d/%m/%Y", "local", "start_of_day", "Australia/Brisbane"), "local_end": dates.parse_timestamp(day, "%d/%m/%Y", "local", "end_of_day", "Australia/Brisbane"), "utc_start": dates.parse_timestamp(day, "%d/%m/%Y", "UTC", "start_of_day", "Australia/Brisbane")}
    return _t(spark, d, "orders").select("o_orderkey", *[c.cast("timestamp_ntz").alias(n) for n, c in made.items()])


@query("""SELECT c_custkey, n_name nation FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_nationkey END""")
def lookup_repeated_rows(spark, d):
    """Repeated reference rows of one value count once: no row of the left side is repeated."""
    n = _t(spark, d, "nation").withColumn("IS_CURRENT_FLAG", F.lit("Y")).withColumn("IS_DELETED_FLAG", F.lit("N"))
    c = _t(spark, d, "customer").withColumn("k", F.when(F.col("c_custkey") % 6 != 0, F.col("c_nationkey")))
    return scan.lookup(c, n.unionByName(n), F.col("k"), "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


@query("""SELECT o_orderkey, CASE WHEN (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END) IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL HAVING count(*) > 1) THEN 'field `cust` duplicates a value for a unique field' END FAILURE_DETAILS FROM orders""")
def unique_with_many_nulls(spark, d):
    o = _t(spark, d, "orders")
    o = V.mark_repeated(o, F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")), "again")
    return V.verdict(o, [rules.unique_failure("cust", F.col("again"))]).select("o_orderkey", V.DETAILS)
