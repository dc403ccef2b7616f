import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, keys, rules, transforms
from millrace.operators import history as H
from millrace.operators import verdict as V
from millrace.sources import scan
from millrace.spec.types import TypeError_, parse_type


@pytest.fixture(scope="module")
def one(spark):
    return lambda *columns: spark.range(1).select(*columns).first()


def test_types():
    assert parse_type("varchar(20)").length == 20 and parse_type("NUMBER(10, 2)").spark == "decimal(10,2)" and parse_type("int").spark == "bigint"
    for bad in ("number", "varchar(0)", "decimal(2,3)", "interval", "map", "date(3)", "", "text(5)"):
        with pytest.raises(TypeError_):
            parse_type(bad)


def test_golden_keys(one):
    r = one(keys.hash_key([F.lit("A1")]), keys.hash_key([F.lit("A1"), F.lit(1)]), keys.hash_key([F.lit("a"), F.lit(None)]), keys.hash_key([F.lit("a"), F.lit("")]), keys.uuid5(F.lit("k|2026-01-01")))
    assert r[0] == "16a36e86f6fed5d465ff332511a0ce1a863b55d364b25a7cdaa25db19abf9648" and r[1] == "ea2a9d4ff55da0d6ce56b5dc42833b430323e317768d657c2d4c62a4a3f6430d"
    assert r[2] == r[3] and r[4] == str(uuid.uuid5(uuid.UUID(keys.SURROGATE_NAMESPACE), "k|2026-01-01"))


def test_rounding(one):
    r = lambda x, s, m="half_up": one(transforms.round_number(F.lit(x), s, m))[0]
    assert (r("12.345", 2), r("98.765", 2), r("2.5", 0, "half_even"), r("-2.59", 1, "down"), r("-2.51", 1, "up"), r("x", 1)) == ("12.35", "98.77", "2", "-2.5", "-2.6", None)


def test_dates(one):
    day = dt.date(2026, 8, 1)
    texts = [("2026-08-01", "%Y-%m-%d"), ("1/08/2026", "%d/%m/%Y"), ("01-Aug-2026", "%d-%b-%Y"), ("Saturday, 1 August 2026", "%A, %d %B %Y")]
    assert list(one(*[dates.parse_date(F.lit(t), f) for t, f in texts])) == [day] * 4
    assert one(dates.parse_date(F.lit("2026-13-01"), "%Y-%m-%d"))[0] is None
    stamps = [dates.parse_timestamp(F.lit("2026-12-01T23:59:58+02:00"), "%Y-%m-%dT%H:%M:%S%z"), dates.parse_timestamp(F.lit("2026-12-01T21:59:58Z"), "%Y-%m-%dT%H:%M:%S%z"), dates.parse_timestamp(F.lit("2026-12-01"), "%Y-%m-%d", "UTC", "end_of_day"), dates.parse_timestamp(F.lit("2026-07-01 12:00:00"), "%Y-%m-%d %H:%M:%S", "local", local_zone="Europe/Berlin")]
    assert list(one(*[s.cast("timestamp_ntz").cast("string") for s in stamps])) == ["2026-12-01 21:59:58", "2026-12-01 21:59:58", "2026-12-01 23:59:59.999999", "2026-07-01 10:00:00"]
    for bad in ("%Q", "%Z", "%"):
        with pytest.raises(dates.FormatError):
            dates.spark_pattern(bad)
    with pytest.raises(dates.FormatError):
        dates.parse_timestamp(F.lit("x"), "%Y-%m-%d")


def test_quarantine_golden(spark):
    df = spark.createDataFrame([("A001", "x"), ("A002", "y"), ("BAD3", "z"), ("A004", None)], "account_id string, name string")
    judged = V.verdict(df, rules.field_failures("account_id", F.col("account_id"), "varchar(20)", nullable=False, rules=[{"type": "regex", "pattern": "^A[0-9]{3}$"}]))
    assert V.valid(judged).count() == 3 and [r.FAILURE_DETAILS for r in V.quarantined(judged).collect()] == ["field `account_id` does not match regex"]
    with pytest.raises(V.ValidationFailed, match="1 validation row"):
        V.require_valid(judged)


def test_csv_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1, x ,"a ""q"" \nb"\n2,,""\n')
    rows = scan.read_csv(spark, str(tmp_path / "a.csv"), header=False).collect()
    assert [tuple(r) for r in rows] == [("1", " x ", 'a "q" \nb'), ("2", None, None)] and rows[0].__fields__ == ["COL_0", "COL_1", "COL_2"]
    assert len(scan.check_header(["a", "b"], [(0, "a"), (1, "a"), (5, None), (None, "z")])) == 3
    with pytest.raises(scan.SourceError):
        scan.read_table(spark, query="select 1; drop table x")


def test_flatten_golden(spark):
    doc = '{"customer":{"account":{"id":"A1"},"flags":{"priority":true},"orders":[{"id":"O1","metrics":{"amount":125.50}},{"id":"O2","metrics":{"amount":40}}]}}'
    df = spark.createDataFrame([(doc,), ('{"customer":{}}',), ("no json",)], "PAYLOAD string")
    rows = scan.flatten(df, "PAYLOAD", "O", path="customer.orders", mode="array").select(scan.path_value(F.try_parse_json("PAYLOAD"), "customer.account.id").alias("a"), scan.path_value(F.col("O"), "id").alias("o"), scan.path_value(F.col("O"), "metrics.amount").alias("m")).collect()
    assert sorted(map(tuple, rows)) == [("A1", "O1", "125.5"), ("A1", "O2", "40")]
    assert scan.flatten(df, "PAYLOAD", "O", path="customer.orders", outer=True).count() == 4


D = H.History(keys=("k",), kind="derived")
A = H.History(keys=("k",), kind="auto")
STATE = "k string, h string, d string, f timestamp_ntz, e int"


def collapse(spark, text):
    """Letters in order: E existing, N incoming, all equal."""
    rows = [("k", "same", "N", dt.datetime(2026, 1, 1 + i), int(c == "E")) for i, c in enumerate(text)]
    df = spark.createDataFrame(rows, STATE).toDF("k", D.hash, D.deleted, D.valid_from, "_existing")
    kept = H.collapse_boundaries(df, D).orderBy(D.valid_from).collect()
    return "".join("E" if r["_existing"] else "N" for r in kept)


@pytest.mark.parametrize("before, after", [("EE", "EE"), ("EN", "E"), ("NE", "N"), ("ENE", "EE"), ("NEE", "NE"), ("NNE", "NE")])
def test_boundaries(spark, before, after):
    assert collapse(spark, before) == after


def incoming(spark, rows, h):
    df = spark.createDataFrame([(k, v, dt.datetime.fromisoformat(f)) for k, v, f in rows], f"k string, v string, {h.valid_from} timestamp_ntz")
    return df.withColumn(h.deleted, F.lit("N")).withColumn(h.hash, keys.hash_key([F.col("v")]))


def load(spark, target, rows, h):
    """The target after a load, as rows in memory."""
    new = incoming(spark, rows, h)
    columns = ["k", "v", h.current, h.deleted, h.valid_from, h.valid_to, h.hash]
    if target is None:
        old = new.withColumn(h.valid_to, F.lit(None).cast(h.type)).withColumn(h.current, F.lit(None).cast("string")).filter("false").select(*columns)
    else:
        old = spark.createDataFrame(target[0], target[1])
    done = H.keyed_replace(old, H.merge(old, new, h), list(h.keys))
    return [tuple(r) for r in done.collect()], done.schema


def test_current_duplicates_are_skipped(spark):
    t, sizes = None, []
    for rows in ([("A", "0", "2026-08-01")], [("A", "1", "2026-09-01")], [("A", "2", "2026-09-02")], [("A", "1", "2026-09-03")], [("A", "1", "2026-09-02T12:00:00")]):
        t = load(spark, t, rows, A)
        sizes.append(len(t[0]))
        H.require_windows(spark.createDataFrame(*t), A)
    assert sizes == [1, 2, 3, 4, 4] and max(r[4] for r in t[0]) == dt.datetime(2026, 9, 2, 12)


def test_missing_keys_stay_current(spark):
    t = load(spark, load(spark, None, [("A1", "x", "2026-01-01"), ("A2", "y", "2026-01-01")], A), [("A2", "y", "2026-02-01")], A)
    assert [r[2] for r in t[0]] == ["Y", "Y"] and {r[4] for r in t[0]} == {dt.datetime(1, 1, 1)} and {r[5] for r in t[0]} == {dt.datetime(9999, 12, 31, 23, 59, 59)}


def test_out_of_order_loads_give_the_same_history(spark):
    rows = [("K", v, f"2026-0{m}-01") for m, v in ((1, "bronze"), (3, "silver"), (5, "gold"), (7, "platinum"))]
    results = set()
    for seed in range(3):
        order = random.Random(seed).sample(rows, len(rows))
        t = None
        for r in order:
            t = load(spark, t, [r], D)
        assert load(spark, t, [order[0]], D)[0] == t[0] or sorted(load(spark, t, [order[0]], D)[0]) == sorted(t[0])
        H.require_windows(spark.createDataFrame(*t), D)
        results.add(tuple(sorted(t[0])))
    assert len(results) == 1 and sum(r[2] == "Y" for r in next(iter(results))) == 1


def test_bad_windows_are_found(spark):
    when = dt.datetime.fromisoformat
    rows = [("A", "1", "N", "N", when("2026-01-01"), when("2026-02-01"), "h"), ("A", "2", "Y", "N", when("2026-03-01"), when("9999-12-31T23:59:59"), "i"), ("B", "1", "Y", "N", when("2026-03-01"), when("2026-03-01"), "i")]
    df = spark.createDataFrame(rows, f"k string, v string, {D.current} string, {D.deleted} string, {D.valid_from} timestamp_ntz, {D.valid_to} timestamp_ntz, {D.hash} string")
    assert {r.k for r in H.window_failures(df, D, "sparse").collect()} == {"B"} and {r.k for r in H.window_failures(df, D).collect()} == {"A", "B"}
    assert {r.k for r in H.without_invalid_keys(df, D, "sparse").collect()} == {"A"}
    with pytest.raises(H.HistoryError):
        H.require_windows(df, D)
    two = H.manual_state_failures(df.withColumn(D.current, F.lit("Y")), D).collect()
    assert {r.k: r.STATE_DETAILS for r in two} == {"A": "scd2_manual has multiple current rows for the same current-row key", "B": "scd2_manual valid_to must be after valid_from"}


def test_rounding_decides_by_the_digits(spark):
    import decimal
    import random

    random.seed(7)
    texts = ["0.10000001", "0.49999999999999", "0.999999999999", "1.00000000001", "1234567890123456789012345", "-0.04", "0", "-0", "+7.5", "2.5", "3.5", "-2.5", ".5", "5.", "0.05", "1e3", "-1.25E-1", " 8.45 ", "00012.5"]
    for _ in range(300):
        whole, part = random.randint(0, 24), random.randint(0, 12)
        text = "".join(random.choices("0123456789", k=whole)) + ("." + "".join(random.choices("0459", k=part)) if part else "")
        texts.append(random.choice(["", "-"]) + text if text else "0")
    modes = {"half_up": decimal.ROUND_HALF_UP, "half_even": decimal.ROUND_HALF_EVEN, "down": decimal.ROUND_DOWN, "up": decimal.ROUND_UP}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts + [None, "", "-", ".", "abc", "1.2.3"])], "k int, t string")
    for scale in (0, 1, 3, 8):
        rows = sorted(df.select("k", *[transforms.round_number(F.col("t"), scale, m).alias(m) for m in modes]).collect())
        for r in rows:
            for m, mode in modes.items():
                if r.k >= len(texts):
                    assert r[m] is None
                    continue
                with decimal.localcontext(prec=60):
                    want = decimal.Decimal(texts[r.k].strip()).quantize(decimal.Decimal(1).scaleb(-scale), mode)
                assert r[m] == f"{want if want else abs(want):f}", (texts[r.k], scale, m)


def test_short_numbers_are_rounded_by_few_patterns(spark):
    """Rounding is compiled and asks few patterns a value; short and long ways agree; a number that grows to 39 digits is null."""
    values = ["1.25", "-1.35", "+.5", "5.", "-0.04", "007.05", " 2.25", "2.25" + "0" * 20, "9.99", "9" * 38 + ".5", "x", "-", "", None]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    modes = ("half_up", "half_even", "down", "up")
    df = df.select("x", *[transforms.round_number(F.col("x"), 1 if m != "half_up" else 0, m).alias(m) for m in modes])
    got = {r.x: tuple(r)[1:] for r in df.collect()}
    assert got["1.25"] == ("1", "1.2", "1.2", "1.3") and got["-1.35"] == ("-1", "-1.4", "-1.3", "-1.4") and got["-0.04"] == ("0", "0.0", "0.0", "-0.1")
    assert got["+.5"] == ("1", "0.5", "0.5", "0.5") and got["5."] == ("5", "5.0", "5.0", "5.0") and got["007.05"] == ("7", "7.0", "7.0", "7.1")
    assert got[" 2.25"] == got["2.25" + "0" * 20] == ("2", "2.2", "2.2", "2.3") and got["9.99"] == ("10", "10.0", "9.9", "10.0")
    assert got["9" * 38 + ".5"][0] is None and {got[v] for v in ("x", "-", "", None)} == {(None,) * 4}
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_extract" not in plan and plan.count("rlike") <= 2 * len(modes)
