"""A query for each operator of the engine, on the TPC-H-like tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates, keys, rules, transforms
from millrace.operators import history as H
from millrace.operators import verdict as V
from millrace.plans.load import Loader
from millrace.sources import scan
from millrace.sources.snapshots import Snapshots, scratch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- projections and keys


@query("SELECT CAST(c_custkey AS VARCHAR) CUSTOMER_ID, c_name CUSTOMER_NAME, CAST(c_nationkey AS BIGINT) NATION, c_mktsegment SEGMENT FROM customer")
def scan_project_cast(spark, d):
    c = _t(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("CUSTOMER_ID"), F.col("c_name").alias("CUSTOMER_NAME"), F.col("c_nationkey").cast("bigint").alias("NATION"), F.col("c_mktsegment").alias("SEGMENT"))


@query("""SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END, ''), nullif(p_brand, ''), 'none') a,
    coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_name END, ''), 'unnamed') b, 'fixed' c, 'd' e FROM part""")
def defaults_coalesce(spark, d):
    p = _t(spark, d, "part")
    a, b = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")), F.when(F.col("p_size") % 2 != 0, F.col("p_name"))
    return p.select("p_partkey", scan.sourced(a, default_value="none", default_from=F.col("p_brand")).alias("a"), scan.sourced(b, default_value="unnamed").alias("b"), scan.sourced(None, fixed_value="fixed").alias("c"), scan.sourced(None, default_value="d").alias("e"))


@query("SELECT c_custkey, sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), coalesce(c_mktsegment, ''))) business_key FROM customer")
def business_key_hash(spark, d):
    return _t(spark, d, "customer").select("c_custkey", keys.hash_key([F.col("c_custkey"), F.col("c_mktsegment")]).alias("business_key"))


@query("SELECT c_custkey, sha256(concat_ws('|', coalesce(c_mktsegment, ''), coalesce(c_name, ''))) h FROM customer")
def data_hash_include(spark, d):
    return _t(spark, d, "customer").select("c_custkey", keys.hash_key([F.col("c_mktsegment"), F.col("c_name")]).alias("h"))


@query("SELECT c_custkey, sha256(concat_ws('|', coalesce(c_name, ''), CAST(c_nationkey AS VARCHAR), coalesce(c_mktsegment, ''))) h FROM customer")
def data_hash_exclude(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_custkey", keys.hash_key([F.col(n) for n in c.columns if n not in ("c_custkey", "c_acctbal")]).alias("h"))


@query("""SELECT o_orderkey, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3),
    substr('89ab', 1 + CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4, 1) || substr(h, 18, 3), substr(h, 21, 12)) surrogate
FROM (SELECT o_orderkey, sha1(unhex('5aa788a5783e5ce6b4aa438de8fc6971') || encode(CAST(o_custkey AS VARCHAR) || '|' || strftime(o_orderdate, '%Y-%m-%d'))) h FROM orders)""")
def surrogate_uuid5(spark, d):
    name = F.concat_ws("|", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _t(spark, d, "orders").select("o_orderkey", keys.uuid5(name).alias("surrogate"))


# ---- transforms


@query("""SELECT s_suppkey, trim(x, ' ') a, ltrim(x, ' ') b, rtrim(x, ' ') c FROM (SELECT s_suppkey, '  ' || s_name || chr(9) || ' ' x FROM supplier)""")
def trim_variants(spark, d):
    x = F.concat(F.lit("  "), F.col("s_name"), F.lit("\t "))
    return _t(spark, d, "supplier").select("s_suppkey", *[transforms.trim(x, s).alias(n) for n, s in (("a", "both"), ("b", "left"), ("c", "right"))])


@query("""SELECT l_orderkey, l_linenumber, CAST(round(x, 1) AS VARCHAR) half_up, CAST(CAST(round_even(x, 1) AS DECIMAL(38,1)) AS VARCHAR) half_even,
    CAST(CAST(sign(x) * floor(abs(x) * 10) / 10 AS DECIMAL(38,1)) AS VARCHAR) down, CAST(CAST(sign(x) * ceil(abs(x) * 10) / 10 AS DECIMAL(38,1)) AS VARCHAR) up
FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice - 20000 AS DECIMAL(18,2)) x FROM lineitem)""")
def round_modes(spark, d):
    x = (F.col("l_extendedprice") - 20000).cast("decimal(18,2)").cast("string")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[transforms.round_number(x, 1, m).alias(m) for m in ("half_up", "half_even", "down", "up")])


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) iso, CAST(o_orderdate AS DATE) slashes, CAST(o_orderdate AS DATE) words, CAST(NULL AS DATE) bad FROM orders""")
def parse_date_formats(spark, d):
    o = _t(spark, d, "orders")
    forms = {"iso": ("yyyy-MM-dd", "%Y-%m-%d"), "slashes": ("d/M/yyyy", "%d/%m/%Y"), "words": ("dd-MMM-yyyy", "%d-%b-%Y"), "bad": ("yyyy/MM", "%Y-%m-%d")}
    return o.select("o_orderkey", *[dates.parse_date(F.date_format("o_orderdate", a), b).alias(n) for n, (a, b) in forms.items()])


@query("""SELECT o_orderkey, date_trunc('day', o_orderdate) AS start_of_day, date_trunc('day', o_orderdate) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS end_of_day,
    date_trunc('second', o_orderdate) - INTERVAL 2 HOUR AS zoned FROM orders""")
def parse_ts_eod(spark, d):
    o = _t(spark, d, "orders")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    zoned = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    cols = {"start_of_day": dates.parse_timestamp(day, "%d/%m/%Y", "UTC", "start_of_day"), "end_of_day": dates.parse_timestamp(day, "%d/%m/%Y", "UTC", "end_of_day"), "zoned": dates.parse_timestamp(zoned, "%Y-%m-%dT%H:%M:%S%z")}
    return o.select("o_orderkey", *[c.cast("timestamp_ntz").alias(n) for n, c in cols.items()])


# ---- verdicts

_RULED = """(SELECT l_orderkey, l_linenumber, l_returnflag, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) qty, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus END status FROM lineitem)"""
_VERDICT = """CASE WHEN NOT regexp_full_match(l_returnflag, '[ANR]') THEN 'field `flag` does not match regex'
    WHEN TRY_CAST(qty AS DECIMAL(38,6)) < 3 THEN 'field `qty` is less than 3' WHEN TRY_CAST(qty AS DECIMAL(38,6)) > 48 THEN 'field `qty` is greater than 48'
    WHEN status IS NULL THEN 'field `status` is null but not nullable' WHEN status NOT IN ('O', 'F') THEN 'field `status` is not one of the allowed values' END"""


def _judged(spark, d) -> DataFrame:
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("bigint").cast("string").alias("qty"), F.when(F.col("l_linenumber") != 7, F.col("l_linestatus")).alias("status"))
    failures = [
        *rules.field_failures("flag", F.col("l_returnflag"), "varchar(1)", rules=[{"type": "regex", "pattern": "[ANR]"}]),
        *rules.field_failures("qty", F.col("qty"), "number(10,0)", rules=[{"type": "min_value", "value": 3}, {"type": "max_value", "value": 48}]),
        *rules.field_failures("status", F.col("status"), "varchar(1)", nullable=False, rules=[{"type": "allowed_values", "values": ["O", "F"]}]),
    ]
    return V.verdict(x, failures)


@query(f"SELECT l_orderkey, l_linenumber, {_VERDICT} FAILURE_DETAILS FROM {_RULED}")
def verdict_first_failure(spark, d):
    return _judged(spark, d).select("l_orderkey", "l_linenumber", V.DETAILS)


@query(f"SELECT l_orderkey, l_linenumber, l_returnflag, qty, status FROM {_RULED} WHERE ({_VERDICT}) IS NULL")
def valid_rows(spark, d):
    return V.valid(_judged(spark, d))


@query(f"SELECT l_orderkey, l_linenumber, l_returnflag, qty, status, {_VERDICT} FAILURE_DETAILS FROM {_RULED} WHERE ({_VERDICT}) IS NOT NULL")
def quarantine_rows(spark, d):
    return V.quarantined(_judged(spark, d))


@query(f"SELECT CASE WHEN count(f) > 0 THEN 1 ELSE 0 END VALIDATION_FAILURE_GUARD, count(f) VALIDATION_FAILURE_COUNT, min(f) VALIDATION_FAILURE_DETAILS FROM (SELECT {_VERDICT} f FROM {_RULED})")
def guard_summary(spark, d):
    return V.guard(_judged(spark, d))


@query("""SELECT p_partkey, list_filter([CASE WHEN length(p_name) > 12 THEN 'field `name` exceeds data_type `varchar(12)`' END, CASE WHEN length(p_name) < 10 THEN 'field `name` length is less than 10' END,
    CASE WHEN length(p_type) > 6 THEN 'field `type` length is greater than 6' END, CASE WHEN TRY_CAST(p_type AS BIGINT) IS NULL AND p_type IS NOT NULL THEN 'field `type` does not match data_type `integer`' END], lambda x: x IS NOT NULL)::VARCHAR AS failures FROM part""")
def all_messages(spark, d):
    f = rules.field_failures("name", F.col("p_name"), "varchar(12)", rules=[{"type": "min_length", "value": 10}])
    g = rules.field_failures("type", F.col("p_type"), "integer", rules=[{"type": "max_length", "value": 6}])
    p = V.all_failures(_t(spark, d, "part"), [*f, g[1], g[0]])
    return p.select("p_partkey", F.concat(F.lit("["), F.array_join("failures", ", "), F.lit("]")).alias("failures"))


@query("SELECT o_orderkey, CASE WHEN o_custkey IS NOT NULL AND count(*) OVER (PARTITION BY o_custkey) > 1 THEN 'field `cust` duplicates a value for a unique field' END FAILURE_DETAILS FROM orders")
def unique_violation(spark, d):
    o = V.mark_repeated(_t(spark, d, "orders"), F.col("o_custkey"), "again")
    return V.verdict(o, [rules.unique_failure("cust", F.col("again"))]).select("o_orderkey", V.DETAILS)


@query("SELECT p_partkey, regexp_full_match(p_brand, 'Brand#[0-9]+') a, regexp_full_match(p_brand, 'Brand|x') b, length(p_brand) > 3 AND regexp_full_match(p_name, '.*[aeiou]') c FROM part")
def regex_full_match(spark, d):
    return _t(spark, d, "part").select("p_partkey", rules.full_match(F.col("p_brand"), "Brand#[0-9]+").alias("a"), rules.full_match(F.col("p_brand"), "Brand|x").alias("b"), ((F.length("p_brand") > 3) & rules.full_match(F.col("p_name"), ".*[aeiou]")).alias("c"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'field `p` does not fit validation precision/scale' END FAILURE_DETAILS FROM orders")
def precision_rule(spark, d):
    x = F.when(F.col("o_orderkey") % 5 == 0, "123456.7").otherwise("99.4")
    return V.verdict(_t(spark, d, "orders"), [rules.rule_failure("p", x, {"type": "precision", "precision": 5, "scale": 1})]).select("o_orderkey", V.DETAILS)


# ---- current-state loads


@query("""SELECT o_orderkey, o_orderstatus STATUS, CAST(o_totalprice AS DECIMAL(12,2)) PRICE, sha256(CAST(o_orderkey AS VARCHAR)) ORDER_BUSINESS_KEY,
    sha256(concat_ws('|', o_orderstatus, o_orderpriority)) BUSINESS_DATA_HASH, TIMESTAMP '2026-01-01' AUDIT_CREATED_DATETIME, 'manual' AUDIT_DATA_PROCESS_KEY FROM orders""")
def scd1_load(spark, d):
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", F.col("o_orderstatus").alias("STATUS"), F.col("o_totalprice").cast("decimal(12,2)").alias("PRICE"), keys.hash_key([F.col("o_orderkey")]).alias("ORDER_BUSINESS_KEY"), keys.hash_key([F.col("o_orderstatus"), F.col("o_orderpriority")]).alias("BUSINESS_DATA_HASH"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("AUDIT_CREATED_DATETIME"), F.lit("manual").alias("AUDIT_DATA_PROCESS_KEY"))


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderstatus = 'F', FALSE)")
def scd1_delete_filter(spark, d):
    return _t(spark, d, "orders").filter(~F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))).select("o_orderkey")


# ---- joins with the target


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_existing_keys(spark, d):
    incoming = _t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return _t(spark, d, "customer").join(incoming, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_unchanged(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = a.o_orderstatus AND b.o_orderkey < a.o_orderkey AND a.o_orderdate >= b.o_orderdate)")
def anti_theta_unchanged(spark, d):
    o = _t(spark, d, "orders")
    a, b = o.alias("a"), o.alias("b")
    cond = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderstatus") == F.col("b.o_orderstatus")) & (F.col("b.o_orderkey") < F.col("a.o_orderkey")) & (F.col("a.o_orderdate") >= F.col("b.o_orderdate"))
    return a.join(b, cond, "left_anti").select("o_orderkey")


@query("""SELECT c_custkey, c_name, 'old' src FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, upper(c_name), 'new' FROM customer WHERE c_custkey % 7 = 0""")
def keyed_replace(spark, d):
    c = _t(spark, d, "customer")
    return H.keyed_replace(c.select("c_custkey", "c_name", F.lit("old").alias("src")), c.filter("c_custkey % 7 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit("new").alias("src")), ["c_custkey"])


@query("""SELECT c.c_custkey, n.n_name nation, r.r_name region FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def lookup_join(spark, d):
    live = lambda df, when: df.withColumn("IS_CURRENT_FLAG", F.when(when, "Y").otherwise("N")).withColumn("IS_DELETED_FLAG", F.lit("N"))
    c, n, r = _t(spark, d, "customer"), _t(spark, d, "nation"), _t(spark, d, "region")
    n = live(n, F.col("n_nationkey") % 4 != 0)
    c = scan.lookup(scan.lookup(c, n, F.col("c_nationkey"), "n_nationkey", "n_name", "nation"), n, F.col("c_nationkey"), "n_nationkey", "n_regionkey", "regionkey")
    return scan.lookup(c, live(r, F.lit(True)), F.col("regionkey"), "r_regionkey", "r_name", "region").select("c_custkey", "nation", "region")


# ---- history

_EVENTS = H.History(keys=("user_id",), kind="derived", order=(("event_id", "desc", "last"),))


def _event_versions(spark, d) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select("user_id", "event_id", F.col("ts").alias("VALID_FROM_DATETIME"), F.col("event_type").alias("BUSINESS_DATA_HASH"), F.lit("N").alias("IS_DELETED_FLAG"), F.lit(0).alias("_existing"))


_ONE = "SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC NULLS LAST, event_type DESC) = 1"


@query(f"SELECT user_id, event_id, ts AS VALID_FROM_DATETIME FROM ({_ONE})")
def version_dedupe(spark, d):
    return H.one_version(_event_versions(spark, d), _EVENTS).select("user_id", "event_id", "VALID_FROM_DATETIME")


_COLLAPSED = f"SELECT * FROM ({_ONE}) QUALIFY coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) <> event_type, TRUE)"


@query(f"SELECT user_id, event_id, ts AS VALID_FROM_DATETIME, event_type AS BUSINESS_DATA_HASH FROM ({_COLLAPSED})")
def boundary_collapse(spark, d):
    rows = H.collapse_boundaries(H.one_version(_event_versions(spark, d), _EVENTS), _EVENTS)
    return rows.select("user_id", "event_id", "VALID_FROM_DATETIME", "BUSINESS_DATA_HASH")


@query(f"""SELECT user_id, event_id, ts AS VALID_FROM_DATETIME, coalesce(nxt - INTERVAL 1 MICROSECOND, TIMESTAMP '9999-12-31 23:59:59') AS VALID_TO_DATETIME, CASE WHEN nxt IS NULL THEN 'Y' ELSE 'N' END IS_CURRENT_FLAG
FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) nxt FROM ({_COLLAPSED}))""")
def scd2_windows(spark, d):
    rows = H.windows(H.collapse_boundaries(H.one_version(_event_versions(spark, d), _EVENTS), _EVENTS), _EVENTS)
    return rows.select("user_id", "event_id", "VALID_FROM_DATETIME", "VALID_TO_DATETIME", "IS_CURRENT_FLAG")


_CUSTOMER = H.History(keys=("c_custkey",), kind="auto")
_COLUMNS = ["c_custkey", "segment", "IS_CURRENT_FLAG", "IS_DELETED_FLAG", "VALID_FROM_DATETIME", "VALID_TO_DATETIME", "BUSINESS_DATA_HASH"]


def _incoming(c: DataFrame, segment, at: str, where: str = "true") -> DataFrame:
    rows = c.filter(where).select("c_custkey", segment.alias("segment"), F.lit("N").alias("IS_DELETED_FLAG"), F.lit(at).cast("timestamp_ntz").alias("VALID_FROM_DATETIME"))
    return rows.withColumn("BUSINESS_DATA_HASH", keys.hash_key([F.col("segment")]))


def _empty(rows: DataFrame, h: H.History) -> DataFrame:
    full = rows.withColumn(h.valid_to, F.lit(None).cast(h.type)).withColumn(h.current, F.lit(None).cast("string"))
    return full.filter("false")


def _first_load(spark, d) -> DataFrame:
    c = _t(spark, d, "customer")
    rows = _incoming(c, F.col("c_mktsegment"), "2026-01-01")
    return H.merge(_empty(rows, _CUSTOMER).select(*_COLUMNS), rows, _CUSTOMER)


_HASHED = "sha256(coalesce(segment, '')) BUSINESS_DATA_HASH"
_FIRST = f"SELECT c_custkey, segment, 'Y' IS_CURRENT_FLAG, 'N' IS_DELETED_FLAG, TIMESTAMP '0001-01-01' AS VALID_FROM_DATETIME, TIMESTAMP '9999-12-31 23:59:59' AS VALID_TO_DATETIME, {_HASHED} FROM (SELECT c_custkey, c_mktsegment segment FROM customer)"
_CHANGED = f"""SELECT c_custkey, segment, 'N' IS_CURRENT_FLAG, 'N' IS_DELETED_FLAG, TIMESTAMP '0001-01-01' AS VALID_FROM_DATETIME, TIMESTAMP '2026-02-01' - INTERVAL 1 MICROSECOND AS VALID_TO_DATETIME, {_HASHED} FROM (SELECT c_custkey, c_mktsegment segment FROM customer WHERE c_custkey % 7 = 0)
UNION ALL SELECT c_custkey, segment, 'Y', 'N', TIMESTAMP '2026-02-01', TIMESTAMP '9999-12-31 23:59:59', {_HASHED} FROM (SELECT c_custkey, 'MOVED' segment FROM customer WHERE c_custkey % 7 = 0)"""


@query(_FIRST)
def scd2_auto_initial(spark, d):
    return _first_load(spark, d)


def _second_load(spark, d) -> DataFrame:
    c = _t(spark, d, "customer")
    return H.merge(_first_load(spark, d), _incoming(c, F.when(F.col("c_custkey") % 7 == 0, "MOVED").otherwise(F.col("c_mktsegment")), "2026-02-01"), _CUSTOMER)


@query(_CHANGED)
def scd2_auto_change(spark, d):
    return _second_load(spark, d)


@query(f"SELECT * FROM ({_FIRST}) WHERE FALSE")
def scd2_auto_unchanged(spark, d):
    return H.merge(_first_load(spark, d), _incoming(_t(spark, d, "customer"), F.col("c_mktsegment"), "2026-03-01"), _CUSTOMER)


@query(f"""SELECT c_custkey, segment, 'N' IS_CURRENT_FLAG, 'N' IS_DELETED_FLAG, TIMESTAMP '0001-01-01' AS VALID_FROM_DATETIME, TIMESTAMP '2026-01-15' - INTERVAL 1 MICROSECOND AS VALID_TO_DATETIME, {_HASHED} FROM (SELECT c_custkey, c_mktsegment segment FROM customer WHERE c_custkey % 7 = 0)
UNION ALL SELECT c_custkey, segment, 'Y', 'N', TIMESTAMP '2026-01-15', TIMESTAMP '9999-12-31 23:59:59', {_HASHED} FROM (SELECT c_custkey, 'MOVED' segment FROM customer WHERE c_custkey % 7 = 0)""")
def scd2_auto_backfill(spark, d):
    target = H.after_load(_second_load(spark, d), _first_load(spark, d), _CUSTOMER)
    return H.merge(target, _incoming(_t(spark, d, "customer"), F.lit("MOVED"), "2026-01-15", "c_custkey % 7 = 0"), _CUSTOMER)


@query(f"{_CHANGED} UNION ALL SELECT * FROM ({_FIRST}) WHERE c_custkey % 7 <> 0")
def full_validation_union(spark, d):
    return H.after_load(_second_load(spark, d), _first_load(spark, d), _CUSTOMER)


_ORDERS = H.History(keys=("o_custkey",), kind="derived", order=(("o_orderkey", "desc", "last"),))


def _order_versions(spark, d, where: str = "true") -> DataFrame:
    o = _t(spark, d, "orders").filter(where)
    return o.select("o_custkey", "o_orderkey", F.lit("N").alias("IS_DELETED_FLAG"), F.col("o_orderdate").alias("VALID_FROM_DATETIME"), keys.hash_key([F.col("o_orderstatus")]).alias("BUSINESS_DATA_HASH"))


def _derived_sql(where: str = "TRUE") -> str:
    return f"""SELECT o_custkey, o_orderkey, 'N' IS_DELETED_FLAG, o_orderdate AS VALID_FROM_DATETIME, sha256(o_orderstatus) BUSINESS_DATA_HASH,
    coalesce(nxt - INTERVAL 1 MICROSECOND, TIMESTAMP '9999-12-31 23:59:59') AS VALID_TO_DATETIME, CASE WHEN nxt IS NULL THEN 'Y' ELSE 'N' END IS_CURRENT_FLAG
FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) nxt FROM (SELECT * FROM (
    SELECT * FROM orders WHERE {where} QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1)
    QUALIFY coalesce(lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) <> o_orderstatus, TRUE)))"""


@query(_derived_sql())
def scd2_derived_initial(spark, d):
    rows = _order_versions(spark, d)
    return H.merge(_empty(rows, _ORDERS), rows, _ORDERS)


_GAPS = "SELECT o_custkey, o_orderkey, o_orderdate AS VALID_FROM_DATETIME, o_orderdate + INTERVAL 30 DAY AS VALID_TO_DATETIME FROM orders"
_NEXT = f"SELECT *, lead(VALID_FROM_DATETIME) OVER (PARTITION BY o_custkey ORDER BY VALID_FROM_DATETIME, o_orderkey) n FROM ({_GAPS})"


def _gapped(spark, d) -> DataFrame:
    return _t(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey")).select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("VALID_FROM_DATETIME"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("VALID_TO_DATETIME"))


_GAPS_ONE = "SELECT o_custkey, max(o_orderkey) o_orderkey, o_orderdate AS VALID_FROM_DATETIME, o_orderdate + INTERVAL 30 DAY AS VALID_TO_DATETIME, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) n FROM orders GROUP BY o_custkey, o_orderdate"


@query(f"SELECT o_custkey, o_orderkey, VALID_FROM_DATETIME, VALID_TO_DATETIME FROM ({_GAPS_ONE}) WHERE n <= VALID_TO_DATETIME")
def scd2_validate_sparse(spark, d):
    return H.window_failures(_gapped(spark, d), _ORDERS, "sparse")


@query(f"SELECT o_custkey, o_orderkey, VALID_FROM_DATETIME, VALID_TO_DATETIME FROM ({_GAPS_ONE}) WHERE n <> VALID_TO_DATETIME + INTERVAL 1 MICROSECOND OR n <= VALID_TO_DATETIME OR n IS NULL")
def scd2_validate_continuous(spark, d):
    return H.window_failures(_gapped(spark, d), _ORDERS)


@query(f"SELECT o_custkey, o_orderkey, VALID_FROM_DATETIME, VALID_TO_DATETIME FROM ({_GAPS_ONE}) WHERE o_custkey NOT IN (SELECT o_custkey FROM ({_GAPS_ONE}) WHERE n <= VALID_TO_DATETIME)")
def exclude_invalid_keys(spark, d):
    return H.without_invalid_keys(_gapped(spark, d), _ORDERS, "sparse")


_MANUAL_SQL = f"""SELECT o_custkey, max(CASE WHEN cur > 1 THEN 'scd2_manual has multiple current rows for the same current-row key'
    WHEN VALID_TO_DATETIME <= VALID_FROM_DATETIME THEN 'scd2_manual valid_to must be after valid_from' WHEN n <= VALID_TO_DATETIME THEN 'scd2_manual validity windows overlap for the same business key' END) STATE_DETAILS
FROM (SELECT g.*, count(*) FILTER (o_orderkey % 3 = 0) OVER (PARTITION BY o_custkey) cur FROM ({_GAPS_ONE}) g) GROUP BY o_custkey HAVING STATE_DETAILS IS NOT NULL"""


@query(_MANUAL_SQL)
def scd2_manual_state_check(spark, d):
    rows = _gapped(spark, d).withColumn("IS_CURRENT_FLAG", F.when(F.col("o_orderkey") % 3 == 0, "Y").otherwise("N"))
    return H.manual_state_failures(rows, _ORDERS)


@query(f"""SELECT count(*) versions, coalesce(sum((lag_t = event_type)::INT), 0)::BIGINT equal_previous, coalesce(sum((lead_t = event_type)::INT), 0)::BIGINT equal_next, coalesce(sum((lag2_t = event_type)::INT), 0)::BIGINT equal_second_previous
FROM (SELECT event_type, lag(event_type) OVER w lag_t, lead(event_type) OVER w lead_t, lag(event_type, 2) OVER w lag2_t FROM ({_ONE}) WINDOW w AS (PARTITION BY user_id ORDER BY ts))""")
def dup_hash_metrics(spark, d):
    return H.duplicate_metrics(H.one_version(_event_versions(spark, d), _EVENTS), _EVENTS)


# ---- null-safe joins, windows that the source manages, versions at a time


@query("""WITH n AS (SELECT DISTINCT CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_nationkey END k FROM customer)
SELECT s_suppkey FROM (SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE s_nationkey END k FROM supplier) s WHERE EXISTS (SELECT 1 FROM n WHERE n.k IS NOT DISTINCT FROM s.k)""")
def nullsafe_join(spark, d):
    n = _t(spark, d, "customer").select(F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("k"))
    s = _t(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") % 5 != 0, F.col("s_nationkey")).alias("k"))
    return s.join(n, s["k"].eqNullSafe(n["k"]), "left_semi").select("s_suppkey")


_STATES = """WITH old AS (SELECT o_custkey, o_orderdate AS VALID_FROM_DATETIME, max(o_orderkey) o_orderkey FROM orders GROUP BY ALL), inc AS (SELECT o_custkey, o_orderdate AS VALID_FROM_DATETIME, min(o_orderkey) o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT * FROM inc UNION ALL SELECT * FROM old WHERE {}NOT EXISTS (SELECT 1 FROM inc WHERE inc.o_custkey = old.o_custkey AND inc.VALID_FROM_DATETIME = old.VALID_FROM_DATETIME)"""


def _states(spark, d) -> tuple[DataFrame, DataFrame]:
    """Existing: all orders; incoming: those of status F."""
    key = ("o_custkey", F.col("o_orderdate").alias("VALID_FROM_DATETIME"))
    o = _t(spark, d, "orders")
    return o.groupBy(*key).agg(F.max("o_orderkey").alias("o_orderkey")), o.filter("o_orderstatus = 'F'").groupBy(*key).agg(F.min("o_orderkey").alias("o_orderkey"))


@query(_STATES.format(""))
def manual_upsert(spark, d):
    return H.keyed_replace(*_states(spark, d), ["o_custkey", "VALID_FROM_DATETIME"])


@query(_STATES.format("o_custkey IN (SELECT o_custkey FROM inc) AND "))
def manual_candidates(spark, d):
    return H.manual_candidate(*_states(spark, d), _ORDERS, ["o_custkey", "VALID_FROM_DATETIME"])


@query(f"""WITH h AS ({_derived_sql()}) SELECT o.o_orderkey fact, h.o_orderkey version_order FROM orders o LEFT JOIN h ON o.o_custkey = h.o_custkey AND o.o_orderdate BETWEEN h.VALID_FROM_DATETIME AND h.VALID_TO_DATETIME""")
def point_in_time(spark, d):
    rows = _order_versions(spark, d)
    versions = H.merge(_empty(rows, _ORDERS), rows, _ORDERS).withColumnRenamed("o_orderkey", "version_order")
    facts = _t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("fact"), "o_orderdate")
    return H.as_of(facts, versions, _ORDERS, "o_orderdate").select("fact", "version_order")


# ---- semi-structured sources, bookmarks


@query("""SELECT event_id, json_extract_string(props, '$.k') k, json_extract_string(props, '$.missing') missing FROM events""")
def variant_path(spark, d):
    v = F.try_parse_json(F.col("props"))
    return _t(spark, d, "events").select("event_id", scan.path_value(v, "k").alias("k"), scan.path_value(v, "missing").alias("missing"))


@query("""SELECT l_orderkey, unnest(range(count(*)))::INT AS ITEM_POS, unnest(list(CAST(l_linenumber AS VARCHAR) ORDER BY l_linenumber)) AS item FROM lineitem GROUP BY l_orderkey""")
def variant_flatten_array(spark, d):
    rows = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list("l_linenumber"))).alias("items"))
    return scan.flatten(rows, "items", "ITEM", mode="array").select("l_orderkey", F.col("ITEM_POS").cast("int").alias("ITEM_POS"), F.try_variant_get("ITEM", "$", "string").alias("item"))


@query("""SELECT r_regionkey, key AS ITEM_KEY, CASE key WHEN 'a' THEN CAST(r_regionkey AS VARCHAR) WHEN 'b' THEN r_name END item FROM region CROSS JOIN (VALUES ('a'), ('b')) k(key) WHERE r_regionkey % 2 = 0
UNION ALL SELECT r_regionkey, NULL, NULL FROM region WHERE r_regionkey % 2 = 1""")
def flatten_outer(spark, d):
    r = _t(spark, d, "region").select("r_regionkey", F.when(F.col("r_regionkey") % 2 == 0, F.to_json(F.struct(F.col("r_regionkey").alias("a"), F.col("r_name").alias("b")))).otherwise("{}").alias("doc"))
    return scan.flatten(r, "doc", "ITEM", outer=True, mode="object").select("r_regionkey", "ITEM_KEY", F.try_variant_get("ITEM", "$", "string").alias("item"))


@query("""SELECT event_id FROM events WHERE ts > (SELECT make_timestamp(epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 4) FROM events) AND ts <= (SELECT max(ts) FROM events)""")
def bookmark_filter(spark, d):
    e = _t(spark, d, "events")
    low, high = e.agg(F.min("ts") + (F.max("ts") - F.min("ts")) / 4, F.max("ts")).first()
    return scan.between_bookmarks(e, "ts", low, high).select("event_id")


@query("""SELECT o_orderstatus, count(*) LOADED_COUNT, count(*) FILTER (o_totalprice > 200000) QUARANTINE_COUNT, CASE WHEN count(*) FILTER (o_totalprice > 200000) > 0 THEN 'COMPLETED_WITH_QUARANTINE' ELSE 'COMPLETED' END AS RESULT FROM orders GROUP BY o_orderstatus""")
def job_summary(spark, d):
    bad = F.count_if(F.col("o_totalprice") > 200000)
    return _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("LOADED_COUNT"), bad.alias("QUARANTINE_COUNT"), F.when(bad > 0, "COMPLETED_WITH_QUARANTINE").otherwise("COMPLETED").alias("RESULT"))


# ---- whole loads from specifications


def _spec(change: str, key: str, fields: list[dict], **control) -> dict:
    return {"id": "t", "control_data": {"change_type": change, "business_key": {"fields": [key]}, **control}, "source": {"format": "table", "schema": "src", "table": "s"}, "target": {"id": "t", "schema": "out", "fields": fields}}


def _field(name: str, column: str, kind: str, **more) -> dict:
    return {"id": name, "source": {"column": column}, "data_type": kind, **more}


def _load(spark, store: Snapshots, spec: dict, source: DataFrame) -> DataFrame:
    Loader(spark, spec, store, source=source, run_at=datetime(2026, 1, 1)).run()
    return store.read("OUT.T")


_CUSTOMER_FIELDS = [_field("customer_id", "c_custkey", "varchar(20)", nullable=False), _field("segment", "c_mktsegment", "varchar(20)", transforms=[{"type": "trim"}]), _field("balance", "c_acctbal", "number(12,1)")]


@query("""SELECT CAST(c_custkey AS VARCHAR) CUSTOMER_ID, trim(c_mktsegment) SEGMENT, sha256(CAST(c_custkey AS VARCHAR)) T_BUSINESS_KEY, TIMESTAMP '2026-01-01' AUDIT_CREATED_DATETIME, 'manual' AUDIT_DATA_PROCESS_KEY
FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def load_scd1(spark, d):
    spec = _spec("scd1", "customer_id", _CUSTOMER_FIELDS, scd={"delete_detection": {"mode": "field", "field": "segment", "value": "BUILDING"}})
    out = _load(spark, scratch(spark, "load-scd1"), spec, _t(spark, d, "customer"))
    return out.select("CUSTOMER_ID", "SEGMENT", "T_BUSINESS_KEY", "AUDIT_CREATED_DATETIME", "AUDIT_DATA_PROCESS_KEY")


@query("""SELECT CAST(c_custkey AS VARCHAR) C_CUSTKEY, CASE WHEN c_acctbal < 0 THEN 'field `balance` is less than 0' ELSE 'field `segment` is not one of the allowed values' END FAILURE_DETAILS
FROM customer WHERE c_acctbal < 0 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""")
def load_quarantine(spark, d):
    fields = [_CUSTOMER_FIELDS[0], {**_CUSTOMER_FIELDS[2], "validations": [{"type": "min_value", "value": 0}]}, {**_CUSTOMER_FIELDS[1], "validations": [{"type": "allowed_values", "values": ["BUILDING", "MACHINERY"]}]}]
    store = scratch(spark, "load-quarantine")
    _load(spark, store, _spec("scd1", "customer_id", fields, failure_mode="quarantine_row"), _t(spark, d, "customer"))
    return store.read("INTERMEDIATE.T__QUARANTINE").select("C_CUSTKEY", "FAILURE_DETAILS")


@query("""SELECT CAST(c_custkey AS VARCHAR) CUSTOMER_ID, n AS VERSION, CASE n WHEN 1 THEN c_mktsegment ELSE 'MOVED' END SEGMENT,
    CASE n WHEN 1 THEN TIMESTAMP '0001-01-01' ELSE TIMESTAMP '2026-02-01' END VALID_FROM_DATETIME,
    CASE WHEN n = 1 AND c_custkey % 100 = 0 THEN TIMESTAMP '2026-01-31 23:59:59.999999' ELSE TIMESTAMP '9999-12-31 23:59:59' END VALID_TO_DATETIME,
    CASE WHEN n = 1 AND c_custkey % 100 = 0 THEN 'N' ELSE 'Y' END IS_CURRENT_FLAG FROM customer, (VALUES (1), (2)) v(n) WHERE n = 1 OR c_custkey % 100 = 0""")
def load_scd2_auto(spark, d):
    c, store = _t(spark, d, "customer"), scratch(spark, "load-auto")

    def spec(at):
        return _spec("scd2_auto", "customer_id", _CUSTOMER_FIELDS, scd={"insert_time": at})

    _load(spark, store, spec("2026-01-01T00:00:00Z"), c)
    out = _load(spark, store, spec("2026-02-01T00:00:00Z"), c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 100 == 0, "MOVED").otherwise(F.col("c_mktsegment"))))
    n = F.when(F.col("VALID_FROM_DATETIME") < F.lit("2000-01-01").cast("timestamp_ntz"), 1).otherwise(2)
    return out.select("CUSTOMER_ID", n.alias("VERSION"), "SEGMENT", "VALID_FROM_DATETIME", "VALID_TO_DATETIME", "IS_CURRENT_FLAG")


@query("""WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) f, max(o_orderkey) k FROM orders GROUP BY ALL)
SELECT CAST(o_custkey AS BIGINT) CUSTOMER, CAST(k AS BIGINT) ORDER_ID, f VALID_FROM_DATE, coalesce(CAST(lead(f) OVER w - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') VALID_TO_DATE, CASE WHEN lead(f) OVER w IS NULL THEN 'Y' ELSE 'N' END IS_CURRENT_FLAG
FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY f)""")
def load_scd2_derived(spark, d):
    """Two loads, the later orders first: the same history as in one load."""
    fields = [_field("customer", "o_custkey", "bigint"), _field("order_id", "o_orderkey", "bigint")]
    validity = {"data_type": "date", "valid_from": {"column": "VALID_FROM_DATE", "source": {"column": "o_orderdate"}}, "valid_to": {"column": "VALID_TO_DATE"}}
    spec = _spec("scd2_derived", "customer", fields, scd={"validity": validity, "deduplicate": {"order_by": [{"column": "order_id"}]}})
    o, store = _t(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date")), scratch(spark, "load-derived")
    late = F.year("o_orderdate") >= 1996
    _load(spark, store, spec, o.filter(late))
    return _load(spark, store, spec, o.filter(~late)).select("CUSTOMER", "ORDER_ID", "VALID_FROM_DATE", "VALID_TO_DATE", "IS_CURRENT_FLAG")


@query("""SELECT 'JOB_START' EVENT_TYPE, NULL::VARCHAR "RESULT", NULL::VARCHAR DETAILS, NULL::BIGINT LOADED_COUNT, NULL::BIGINT QUARANTINE_COUNT
UNION ALL SELECT 'JOB_END', 'COMPLETED_WITH_QUARANTINE', 'validation errors written to quarantine output', count(*) FILTER (c_acctbal >= 0), count(*) FILTER (c_acctbal < 0) FROM customer""")
def load_job_events(spark, d):
    fields = [_CUSTOMER_FIELDS[0], {**_CUSTOMER_FIELDS[2], "validations": [{"type": "min_value", "value": 0}]}]
    store = scratch(spark, "load-jobs")
    _load(spark, store, _spec("scd1", "customer_id", fields, failure_mode="quarantine_row"), _t(spark, d, "customer"))
    return store.read("BUSINESS.LOAD_JOBS").select("EVENT_TYPE", "RESULT", "DETAILS", F.col("LOADED_COUNT").cast("bigint").alias("LOADED_COUNT"), F.col("QUARANTINE_COUNT").cast("bigint").alias("QUARANTINE_COUNT"))


@query("""SELECT CAST(c_custkey AS VARCHAR) C_CUSTKEY, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'field `balance` is less than 0; field `segment` does not match regex' ELSE 'field `balance` is less than 0' END MESSAGES
FROM customer WHERE c_acctbal < 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'field `segment` does not match regex' FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'BUILDING'""")
def validate_messages(spark, d):
    fields = [_CUSTOMER_FIELDS[0], {**_CUSTOMER_FIELDS[2], "validations": [{"type": "min_value", "value": 0}]}, {**_CUSTOMER_FIELDS[1], "validations": [{"type": "regex", "pattern": "BUILD[A-Z]+"}]}]
    loader = Loader(spark, _spec("scd1", "customer_id", fields), scratch(spark, "validate"), source=_t(spark, d, "customer"))
    return loader.messages().select("C_CUSTKEY", F.array_join("failures", "; ").alias("MESSAGES"))


from millrace.plans import load_queries  # noqa: E402, F401  (registers its queries)
