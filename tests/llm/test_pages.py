import io
import re
import struct

import pytest

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("zstandard")
from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import entry, license_digest, url_filters, warc  # noqa: E402


def rows_of(sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    return sorted((tuple(str(dict(zip(names, x))[n]) for n in sorted(names)) for x in r.fetchall()))


def spark_rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def odd_pages(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    again = df.filter("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1000)
    rows = [(1, None, None), (2, "nourl", ""), (3, "HTTP://A.NET:80?x=/y", "<a HREF='https://b.example.net/fr/1'>"), (4, "x://net/es/", '<a href="//c.org/">'), (5, "http://www.example.com/en/1", '<a href="http://D.org">'), (6, "http://c.org/zz\n", '<a href="http://b.example.net/es/">'), (6, "http://D.org/", None), (7, "http://example.com", "q"), (8, "a://b.example.net/es/#?", '<a href="http://c.org">'), (9, "http://é.org/x y", "z" * 300_000)]
    extra = spark.createDataFrame([(5000 + a, b, c) for a, b, c in rows], df.schema)
    return df.unionByName(again).unionByName(extra)


def test_archives_give_back_every_page(spark, sf):
    pages = odd_pages(spark, sf)
    got = warc.round_trip(spark, pages.withColumn("digest", F.lit(1)))
    assert spark_rows(got) == rows_of(entry.oracle_sql()["op5_warc_zstd"], pages=pages.toArrow())
    assert got.filter("record_type = 'revisit'").count() > 10
    assert warc.round_trip(spark, pages.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a", "x" * 2000)] * 2 + [(None, "b", "y" * 2000), (4, "b", "y" * 2000)], pages.schema)
    assert sorted(map(str, ((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark, nulls).collect()))) == sorted(map(str, [(None, "response", None)] * 2 + [(None, "revisit", 4), (4, "response", None)]))


def archive(records, dictionary=b""):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, dictionary)
    for r in records:
        writer.add(r)
    return out.getvalue()


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_reader_takes_its_dictionary_from_the_first_frame(block):
    import hashlib

    html = [f"<html><body>page {k} {'lorem ipsum ' * k}</body></html>".encode() for k in range(60)]
    records = [warc.record(k, f"http://x/{k}", h, hashlib.sha1(h).hexdigest()) for k, h in enumerate(html)]
    dictionary = warc.train_dictionary(records * 20, 4096)
    assert dictionary
    data = archive(records, dictionary)
    assert struct.unpack("<I", data[:4])[0] == warc.SKIPPABLE and len(data) < len(archive(records))
    got = [warc.parse(r) for r in warc.read_archive(io.BytesIO(data), block)]
    assert [(g["page_id"], g["payload"]) for g in got] == list(enumerate(html))
    for broken in (data[4:], data[:-3], data + b"junk", data[:8] + data[9:]):
        with pytest.raises((warc.ArchiveError, Exception)):
            list(warc.read_archive(io.BytesIO(broken), block))


def test_records_are_checked():
    import hashlib

    good = warc.record(5, "http://x", b"abc", hashlib.sha1(b"abc").hexdigest())
    assert warc.parse(good)["payload_bytes"] == 3
    for a, b in ((b"abc", b"abd"), (b"WARC/1.1", b"WARC/9"), (b"WARC-Date", b"Other"), (b"Content-Length: 3", b"Content-Length: 4"), (b"response\r\n", b"revisit\r\n"), (b"\r\n\r\n", b"\n")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(good.replace(a, b, 1))
    with pytest.raises(warc.ArchiveError):
        warc.parse(good + b"x")


def test_urls_equal_sql(spark, sf):
    pages = odd_pages(spark, sf)
    got = url_filters.judge(spark, pages.withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1)))
    assert spark_rows(got) == rows_of(url_filters.sql(), pages=pages.toArrow())
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert found[5005] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and found[5001] == ("", "", None, "allow")
    assert found[5003][0] == "a.net:80" and found[5003][3] == "block"  # it links to a blocked host
    assert url_filters.judge(spark, pages.limit(0)).count() == 0
    assert {r.rule for r in url_filters.judge(spark, pages, rules=()).collect()} == {None}


def test_evidence_comes_over_long_chains_and_cycles(spark):
    links = {"h1.org": ["bad.org"], **{f"h{k}.org": [f"h{k - 1}.org"] for k in range(2, 51)}}
    links |= {"c1.org": ["c2.org"], "c2.org": ["c3.org", "h12.org"], "c3.org": ["c1.org"]}
    pages = [(f"http://{h}/", "".join(f'<a href="http://{t}/">' for t in to)) for h, to in links.items()] + [("http://bad.org/", "")] * 1000
    into = {t: [h for h in links for x in links[h] if x == t] for t in {t for to in links.values() for t in to}}
    score = moving = {"bad.org": 1000.0}
    for _ in range(500):  # distrust goes from a host to those that link to it
        sent = {}
        for t, m in moving.items():
            for h in into.get(t, []):
                sent[h] = sent.get(h, 0) + 0.85 * m / len(into[t])
        score, moving = {h: score.get(h, 0) + sent.get(h, 0) for h in {*score, *sent}}, sent
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.host: r.verdict for r in url_filters.judge(spark, df, rules=(("block", "bad.org", "/"),)).collect()}
    assert got == {h: "block" if h == "bad.org" or score.get(h, 0) > 0.5 else "allow" for h in (*links, "bad.org")}
    assert got["h9.org"] == got["c1.org"] == "block" and got["h50.org"] == "allow"


def test_licences_equal_sql(spark, sf):
    mit = license_digest.TEXTS[0][1]
    rows = [(1, mit, "x"), (2, "Copyright (c) 2020 A\n" + mit.lower().replace("copyright owner", "copyright holder").replace("\n", " \n * ").replace("sublicense", "sub-license"), ""), (3, mit + " more", None), (4, None, None), (5, "", ""), (6, "a\n  released under THE mit LICENCE!\nReleased under the MIT License.\nb", ""), (6, "SPDX-License-Identifier: MIT", ""), (None, mit, ""), (7, "w " * 60000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = {r.doc_id: r for r in license_digest.scan(spark, df).collect()}
    assert got[1].license_id == got[2].license_id == got[None].license_id == "MIT" and got[3].license_id is got[4].license_id is None
    assert license_digest.scan(spark, df).filter("doc_id = 6").selectExpr("sum(n_notices)").first()[0] == 3
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(df.filter("doc_id <> 6").select("doc_id", "text"))
    docs = docs.withColumn("doc_id", F.col("doc_id") + F.when(F.length("text") > 100000, 5000).otherwise(0)).dropDuplicates(["doc_id"])
    assert spark_rows(license_digest.scan(spark, docs)) == rows_of(license_digest.sql(), documents=docs.toArrow())
    assert license_digest.scan(spark, df.limit(0)).count() == 0 and license_digest.scan(spark, df, texts=(), notices=()).filter("license_id IS NOT NULL").count() == 0


def test_whole_licences_are_found_through_the_join(spark):
    import glob
    import os
    import textwrap

    rows, want = [], []
    for name, text in license_digest.TEXTS:
        rows += [text, "Copyright 2019-2021 Some Body\n" + "\n".join(textwrap.wrap(text, 60)).upper(), text + " and more"]
        want += [name, name, None]
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    for f in glob.glob("/usr/share/common-licenses/*"):  # where the system has them
        if (name := os.path.basename(f)) in names:
            text = open(f, encoding="utf-8").read()
            rows += [text, re.sub(r"\blicense\b", "licence", text.replace("\n", "\r\n   "))]
            want += [names[name]] * 2
    got = license_digest.scan(spark, spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert [r.license_id for r in sorted(got)] == want


def test_known_texts_may_be_a_large_table(spark):
    known = spark.range(5000).selectExpr("concat('L-', id) license_id", "concat('You may use part ', id, ' as you like') text")
    docs = spark.createDataFrame([(1, "you MAY use part 4321, as you like!"), (2, "you may use part 5000 as you like")], "doc_id long, text string")
    assert [r.license_id for r in sorted(license_digest.scan(spark, docs, texts=known).collect())] == ["L-4321", None]


def test_statements_go_and_sentences_stay(spark):
    texts = ["COPYRIGHT HOLDERS BE LIABLE", "Copyright (c) 2020 A", " * Copyright 1999 B. All rights reserved.", "(c) 2001 C", "All rights reserved.", "© D", "copyright notice"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(license_digest.canonical(F.col("t"))).collect()] == ["copyright holders be liable", "", "", "", "", "", "copyright notice"]


def test_long_lists_of_rules_are_joined(spark, sf):
    pages = odd_pages(spark, sf)
    want = spark_rows(url_filters.judge(spark, pages))
    many = [*url_filters.RULES, *(("block", f"h{k}.invalid", "/") for k in range(3000))]
    assert spark_rows(url_filters.judge(spark, pages, rules=many)) == want
    table = spark.createDataFrame(list(url_filters.RULES) * 2, "verdict string, host string, path string")
    assert spark_rows(url_filters.judge(spark, pages, rules=table)) == want
    assert url_filters.judge(spark, pages.limit(0), rules=table).count() == 0
