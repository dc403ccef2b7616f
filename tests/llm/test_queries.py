"""The corpus queries on the whole table of documents, against plain versions of what they must return."""

import hashlib
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("tokenizers")
import corpus_pipeline  # noqa: E402
from millrace.llm import entry, near_copies, secret_scan, simhash  # noqa: E402
from tests.llm.test_texts import brute_secrets  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, sf):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


@pytest.fixture(scope="module")
def ids(docs):
    """Ids of whole encodings, with the end id."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in docs}


def test_token_files_hold_whole_encodings(spark, sf, docs, ids):
    got = sorted(tuple(r)[:4] for r in entry.op1_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    start, want = 0, []
    for i, _ in docs:
        want.append((i, start, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        start += len(ids[i])
    assert got == want


def test_packing_places_every_piece(spark, sf, ids):
    rows = entry.op3_best_fit_packing(spark, sf).collect()
    want = {(i, k, a): x[a : a + 4096] for i, x in ids.items() for k, a in enumerate(range(0, len(x), 4096))}
    assert {(r.doc_id, r.piece, r.start) for r in rows} == set(want) and len(rows) == len(want)
    assert all(r.length == len(want[r.doc_id, r.piece, r.start]) and r.ids_crc32 == zlib.crc32(want[r.doc_id, r.piece, r.start].tobytes()) for r in rows)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) <= -(-sum(map(len, want.values())) // 4096) + 1


def test_secrets_of_all_documents(spark, sf, docs):
    names = [r.kind for r in secret_scan.BASE]
    got = {r.doc_id: r for r in entry.op8_secret_scan(spark, sf).collect()}
    for i, t in docs:
        spans = brute_secrets(t or "")
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_benchmark_items_in_documents(spark, sf, docs):
    plain = lambda t: re.sub(r"[\W_]+", "", (t or "").lower())
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = entry.op9_decontamination(spark, sf).collect()
    whole = {(r.doc_id, r.item_id) for r in found if r.windows_found == r.windows and r.edits == 0}
    texts = {i: plain(t) for i, t in docs}
    assert {(i, n) for i, t in texts.items() for n, item in items.items() if item in t} <= whole and whole
    for r in found:
        if r.edits == 0:
            assert plain(dict(docs)[r.doc_id][r.start : r.end])[:20] in items[r.item_id] or r.windows_found > 1


CLASHING = ["row", "id", "kept", "nth", "own", "grp", "class", "print", "keys", "leak", "found", "score", "lang_pred", "n_letters", "fp", "a", "b", "label"]


def test_stages_keep_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = docs.selectExpr("*", *[f"doc_id + {k} AS `{c}`" for k, c in enumerate(CLASHING)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = stage(spark, docs, sf)
        got = stage(spark, odd, sf)
        assert got.columns == odd.columns, name
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect()), name
        assert got.filter(f"`label` <> doc_id + {CLASHING.index('label')}").count() == 0


def test_pipeline_of_an_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_crowds_are_compared_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, 200, dtype=np.uint64)
    sets = []
    for _ in range(120):
        own = base.copy()
        own[rng.integers(0, 200, rng.integers(0, 40))] = rng.integers(0, 2**62, 1, dtype=np.uint64)
        sets.append(np.unique(np.r_[own, rng.integers(0, 2**62, rng.integers(0, 20), dtype=np.uint64)]))
    near = np.array([[near_copies.similarity(a, b) >= 0.8 for b in sets] for a in sets])

    def closed(pairs):
        up = list(range(len(sets)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return [find(x) for x in range(len(sets))]

    pairs = near_copies.block_links(sets, np.arange(len(sets)), None, 0.8)
    assert all(near[a, b] for a, b in pairs) and closed(pairs) == closed(np.argwhere(near).tolist()) and len(set(closed(pairs))) > 1
    sides = rng.integers(0, 2, len(sets))
    pairs = near_copies.block_links(sets, np.arange(len(sets)), sides, 0.8)
    assert all(near[a, b] and sides[a] != sides[b] for a, b in pairs)
    assert closed(pairs) == closed([(a, b) for a, b in np.argwhere(near).tolist() if sides[a] != sides[b]])


def test_a_hot_crowd_is_cut_into_blocks(spark, monkeypatch):
    import random

    from tests.llm.test_near_copies import brute_kept

    monkeypatch.setattr(near_copies, "LEAST_BLOCK", 7)
    monkeypatch.setattr(near_copies, "HUBS", 1)
    rng = random.Random(8)
    base, texts = [f"w{k}" for k in range(120)], []
    for _ in range(90):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    kept = near_copies.keep_first(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == brute_kept(rows)


def test_shingle_hashes_serve_both():
    text = "a b c d e f g a b c d e f g"
    h = simhash.shingle_hashes(simhash.normal(text), 5)
    assert len(h) == 10 and len(near_copies.shingles(simhash.normal(text))) == 7 and simhash.fingerprint_of(h) == simhash.fingerprint(text, 5)
