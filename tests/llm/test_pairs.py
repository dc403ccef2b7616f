import random
import re

import numpy as np
import pytest

pytest.importorskip("xxhash")
from millrace.llm import embedding_dedup, simhash  # noqa: E402
from millrace.llm.components import components  # noqa: E402


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    random.seed(1)
    n = 300
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 180)] + [(random.randrange(200, n), random.randrange(200, n)) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    expected = union(n, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: expected[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text, words=4):
    import xxhash

    found = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "A b C", "a b c d", "Été a b \x1c c d e f", "x y z w " * 9000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == fingerprint(text)


def closure(n, pairs):
    return union(n, [(min(a, b), max(a, b)) for a, b in pairs])


@pytest.mark.parametrize("seed", range(12))
def test_index_finds_all_links(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    base = rng.integers(0, 2**63, size=max(1, n // 9), dtype=np.uint64)
    fp = base[rng.integers(0, len(base), n)]
    for _ in range(int(rng.integers(0, 7))):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    index = simhash.GrayIndex(fp)
    a, b = index.own_links(4)
    a, b = index.order[a], index.order[b]
    assert near[a, b].all() and closure(n, zip(a.tolist(), b.tolist())) == union(n, np.argwhere(np.triu(near, 1)).tolist())
    # two parts, each with groups of its own, in several calls
    asks = rng.random(n) < 0.5
    own = [(x, y) for x, y in np.argwhere(np.triu(near, 1)).tolist() if asks[x] == asks[y]]
    groups, mine, other = np.array(closure(n, own)), np.flatnonzero(asks), np.flatnonzero(~asks)
    pairs = list(own)
    if len(other):
        index = simhash.GrayIndex(fp[other], groups[other])
        for part in np.array_split(mine, 3):
            a, b = index.links(fp[part], groups[part], 4)
            a, b = part[a], other[index.order[b]]
            assert near[a, b].all()
            pairs += zip(a.tolist(), b.tolist())
    assert closure(n, pairs) == union(n, np.argwhere(np.triu(near, 1)).tolist())


def test_dense_groups_cost_no_pairs():
    rng = np.random.default_rng(2)
    near = np.uint64(rng.integers(0, 2**63)) ^ (np.uint64(1) << rng.integers(0, 24, 60_000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(24, 64, 60_000).astype(np.uint64))
    near = np.unique(np.r_[near, near ^ np.uint64(7)])
    index = simhash.GrayIndex(near)
    a, b = index.own_links(4)
    assert len(near) > 1900 and len(a) == len(near) - 1 == len(b) and set(index.label.tolist()) == {0}


def near_copies(n=160):
    random.seed(4)
    words = [f"w{k}" for k in range(300)]
    base = [random.choices(words, k=random.randint(60, 200)) for _ in range(12)]
    rows = []
    for k in range(n):
        own = list(random.choice(base))
        for _ in range(random.randint(0, 2)):
            own[random.randrange(len(own))] = random.choice(words)
        rows.append((k + 10, " ".join(own), "f", 0, "c"))
    return rows + [(1, None, None, None, None), (2, "", None, None, None), (2, "", None, None, None), (None, rows[0][1], None, None, None)]


@pytest.mark.parametrize("sizes", [{}, {"least_part": 20}, {"part_size": 7}])
def test_classes_equal_brute_force(spark, sizes):
    rows = near_copies()
    got = simhash.classes(spark, spark.createDataFrame(rows, "doc_id long, text string, fp string, rep int, component string"), **sizes).collect()
    fps = [fingerprint(r[1]) for r in rows]
    groups = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    least = {}
    for r, g in zip(rows, groups):
        least[g] = min(least.get(g, 10**9), r[0] if r[0] is not None else 10**9)
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, groups)), key=str)
    assert len(set(least.values())) < len(rows) - 20  # some are grouped


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame(near_copies(), "doc_id long, text string, fp string, rep int, component string")
    kept = simhash.keep_first(spark, df)
    classes = {r.component_id for r in simhash.classes(spark, df).collect()}
    rows = kept.collect()
    clashing = df.withColumn("nth", df.doc_id).withColumn("kept", df.text).withColumn("fp", df.doc_id).withColumn("row", df.text)
    assert simhash.keep_first(spark, clashing).columns == clashing.columns and simhash.keep_first(spark, clashing).count() == kept.count()
    assert kept.columns == df.columns and sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(classes)
    assert simhash.classes(spark, df.limit(0)).count() == 0 == simhash.keep_first(spark, df.limit(0)).count()


@pytest.mark.parametrize("limits", [{}, {"max_cell": 4, "max_visits": 9, "block": 7}, {"recall": 1.0}])
def test_vector_links_equal_brute_force(spark, limits):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    x = base[rng.integers(0, 60, 400)] + rng.normal(size=(400, 16)) * rng.choice([0, 0.05, 0.2, 0.6], 400)[:, None]
    x[17] = x[18] * 3
    rows = [(int(k), v.tolist(), "g") for k, v in enumerate(x)]
    odd = [(900, None, ""), (901, [], ""), (902, [0.0] * 16, ""), (903, [float("nan")] * 16, ""), (904, [None] + [1.0] * 15, ""), (905, [1.0, 2.0], ""), (906, [float("inf")] * 16, ""), (None, x[0].tolist(), "")]
    got = embedding_dedup.links(spark, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rep string"), **limits).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    least = union(400, np.argwhere(np.triu(near, 1)).tolist())
    found = {r.vec_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert sum(found[k].n_links for k in range(400)) >= 0.97 * (near.sum() - 400) and all(found[k].n_links <= near[k].sum() - 1 for k in range(400))
    assert sum(found[k].component_id == least[k] for k in range(400)) > 380 and all(found[k].kept == (found[k].component_id == k) for k in range(400))
    assert all((found[k[0]].n_links, found[k[0]].component_id, found[k[0]].kept) == (0, k[0], True) for k in odd)
    assert embedding_dedup.links(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vector_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = embedding_dedup.links(spark, df).collect()
    assert sum(r.n_links for r in got) >= 0.9 * ((unit @ unit.T >= 0.9).sum() - len(x)) and len(got) == len(rows)


def test_few_links_among_random_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[-200:] = embedding_dedup.weakest(x[:200], 0.9005)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = {r.vec_id: r for r in embedding_dedup.links(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    near = x @ x.T >= 0.9
    assert near.sum() - len(x) == 400 and sum(r.n_links for r in got.values()) >= 0.95 * 400
    assert all(r.n_links == 0 or near[k].sum() == 2 for k, r in got.items())


def test_place_counts_the_cells_before(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8))
    index = embedding_dedup.MultiIndex(x, 8)
    first, second = index.distances(x[:40])
    total = (first[:, :, None] + second[:, None, :]).reshape(40, -1)
    for n in (1, 5, 20, 64):
        seen = index.visits(x[:40], n)
        assert np.allclose(np.sort(np.take_along_axis(total, seen, 1)), np.sort(total)[:, :n])
    cell = index.cell(x[40:80])
    assert (index.place(x[:40], cell) == (total <= np.take_along_axis(total, cell[:, None], 1) + 1e-12).sum(axis=1)).all()
