import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import queries as engine


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 40


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, sf, tables, name):
    df = engine.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = tables.execute(engine.oracle_sql()[name])
    found = [c[0] for c in want.description]
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_backfilled_target_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus").collect()

    def chain(versions):
        """Of each start the largest order, then of equal neighbours the first. versions: (start, order, status)."""
        best, out = {}, []
        for start, order, status in sorted(versions):
            best[start] = (start, order, status)
        for v in (best[k] for k in sorted(best)):
            if not out or out[-1][2] != v[2]:
                out.append(v)
        return out

    want = []
    for customer in {r.o_custkey for r in rows}:
        own = [(r.o_orderdate, r.o_orderkey, r.o_orderstatus) for r in rows if r.o_custkey == customer]
        early = chain(v for v in own if v[1] % 3)
        late = [v for v in own if v[1] % 3 == 0]
        late = [v for v in late if not any(v[2] == e[2] and (v[0] == e[0] or (e is early[-1] and v[0] > e[0])) for e in early)]
        at = {}  # of each start one version: a late one before an early one, then the largest order
        for is_late, found in ((False, early), (True, late)):
            at |= {v[0]: (*v, is_late) for v in sorted(found)}
        line = [at[k] for k in sorted(at)]
        versions = []
        for k, v in enumerate(line):
            one, two = line[k - 1] if k else None, line[k - 2] if k > 1 else None
            equal = one is not None and one[2] == v[2]
            if not (equal if v[3] else equal and one[3] and not (two is not None and two[2] == v[2])):
                versions.append(v)
        want += [(customer, v[1], str(v[0]), "Y" if k == len(versions) - 1 else "N") for k, v in enumerate(versions)]
    got = engine.queries()["scd2_derived_backfill"](spark, sf).collect()
    assert sorted((r.o_custkey, r.o_orderkey, str(r.VALID_FROM_DATETIME), r.IS_CURRENT_FLAG) for r in got) == sorted(want)
    assert len(got) > len({r.o_custkey for r in rows})
