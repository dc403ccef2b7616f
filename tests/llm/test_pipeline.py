import re

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from millrace.llm import entry, secret_scan  # noqa: E402
from tests.llm.test_near_copies import brute_kept  # noqa: E402
from tests.llm.test_texts import brute_secrets  # noqa: E402


def plain(text):
    return re.sub(r"[\W_]+", "", text.lower())


def test_pipeline_equals_brute_force(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "x", 0), (9002, "1 2 3", None, "x", 5)], docs.schema)
    stages, seen = [f for _, f in corpus_pipeline.STAGES], docs.unionByName(extra)
    first = stages[0](spark, seen, sf)
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect()} and first.columns == docs.columns
    rows = sorted(first.select("doc_id", "text").collect())
    second = stages[1](spark, first, sf).cache()
    assert {r.doc_id for r in second.collect()} == brute_kept(rows) and second.columns == docs.columns
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    third = stages[2](spark, second, sf)
    leaked = {r.doc_id for r in second.collect() if any(i in plain(r.text) for i in items)}
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in second.collect()} - leaked and leaked
    fourth = stages[3](spark, third, sf)
    before, after = ({r.doc_id: r for r in x.collect()} for x in (third, fourth))
    assert before.keys() == after.keys() and fourth.columns == docs.columns
    scanner = secret_scan.Scanner(secret_scan.BASE + secret_scan.MORE)
    for k, r in after.items():
        assert brute_secrets(r.text) == [] and r.n_chars == len(r.text)
        assert r.text == before[k].text or scanner.spans([before[k].text])[0]
    done = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in done.collect()} == after.keys()
    assert done.agg(F.max("length")).first()[0] <= 4096


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n != "pipeline") == list(range(1, 11))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
