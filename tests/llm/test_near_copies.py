import random
from itertools import combinations

import pytest

pytest.importorskip("xxhash")
pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from millrace.llm import near_copies  # noqa: E402
from tests.llm.test_pairs import union  # noqa: E402


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Ids of the first of each group of texts with Jaccard similarity >= 0.8. rows: (id, text), ids ascending."""
    sets = [shingle_set(t) for _, t in rows]
    near = [(i, j) for i, j in combinations(range(len(rows)), 2) if (sets[i] | sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) or not sets[i] | sets[j]]
    return {rows[g][0] for g in union(len(rows), near)}


def changed(rng, words, n, vocabulary):
    own = list(words)
    for _ in range(n):
        own[rng.randrange(len(own))] = rng.choice(vocabulary)
    return own


def test_stage_keeps_one_of_each_group_by_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(12):  # changes of 0 to 14 words in 300: similarities on both sides of 0.8
        base = rng.choices(vocabulary, k=300)
        texts += [" ".join(changed(rng, base, n, vocabulary)) for n in (0, 1, 3, 5, 6, 7, 8, 10, 14)]
    texts += [" ".join(rng.choices(vocabulary, k=200)) for _ in range(20)] + ["a b", "A  b", "a b c", "", None, " "]
    rng.shuffle(texts)
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert kept == sorted(brute_kept(rows)) and len(kept) < len(rows) - 40


def test_stage_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(brute_kept(sorted((r.doc_id, r.text) for r in docs.collect())))


def test_repeated_and_null_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, a, 1), (1, a, 2), (1, b, 3), (2, b, 4), (None, a, 5), (None, a, 6)], "doc_id long, text string, n int")
    got = near_copies.keep_first(spark, df).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1", a), ("1", b), ("None", a), ("None", a)])
    assert near_copies.keep_first(spark, df.limit(0)).count() == 0
