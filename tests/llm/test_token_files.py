import io
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from millrace.llm import packing, token_files  # noqa: E402
from millrace.llm.tokens import TokenEncoder  # noqa: E402

PATH = P.path("word_bpe_49k.json")
ODD = ["", "  ", "it's I'VE a\x1cb <|endoftext|>x", "é É İI Σ", "x" * 3000, "12 ½ a b \x85", "你好 <| no", "The AND the, don't!!"]


def plain(text):
    from tokenizers import Tokenizer

    plain.t = getattr(plain, "t", None) or Tokenizer.from_file(PATH)
    return plain.t.encode(text, add_special_tokens=False).ids


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start string, rank int, length string")


@pytest.mark.parametrize("cache", [1, 1 << 20])
def test_pieces_are_encoded_as_whole_texts_are(cache):
    encoder = TokenEncoder(PATH, cache)
    texts = ODD + [f"a{chr(c)}b {chr(c)}'s{chr(c)}1" for c in range(256)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)] == [plain(t) for t in texts]
    assert encoder.by_piece


@pytest.mark.parametrize("values", [[], [0], [7], [0, 0, 0], [0, 1, 1, 5, 5, 900000], list(range(5000)), [2**40, 2**40 + 1]])
def test_elias_fano(values):
    ef = token_files.EliasFano.frombytes(token_files.EliasFano.build(values).tobytes())
    assert [ef.select(i) for i in range(len(values))] == values == ef.slice(0, len(values)).tolist()
    for a in range(0, len(values), 701):
        assert ef.slice(a, a + 3).tolist() == values[a : a + 3]
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_random_sequences_take_little_space():
    random.seed(5)
    values = sorted(random.randrange(10**7) for _ in range(20000))
    ef = token_files.EliasFano.build(values)
    assert ef.slice(0, 20000).tolist() == values and len(ef.tobytes()) * 8 < 20000 * (2.1 + np.log2(10**7 / 20000))


class Source(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def test_shard_round_trip_and_damage():
    out = Source()
    writer = token_files.ShardWriter(out, 2)
    for doc, ids in ((None, [3]), (-5, [1, 2]), (9, []), (9, [7] * 100)):
        writer.add(doc, np.array(ids, "<u4"))
    writer.close()
    reader = token_files.ShardReader(out, len(out.getvalue()))
    assert [(d, s, x.tolist()) for d, s, x in reader.documents()] == [(None, 0, [3]), (-5, 1, [1, 2]), (9, 3, []), (9, 3, [7] * 100)]
    assert reader.tokens(1).tolist() == [1, 2] and reader.doc_id(3) == 9
    with pytest.raises(ValueError):
        token_files.ShardReader(Source(out.getvalue()[:-3]), len(out.getvalue()) - 3)


def test_files_give_back_every_document(spark):
    rows = [(k, t, "x", 1, "y") for k, t in enumerate(ODD)] + [(3, None, None, None, None), (None, "nobody", None, None, None), (3, "again", None, None, None)]
    got = token_files.encode_and_read(spark, docs(spark, rows), PATH, shards=3).collect()
    ids = {}
    for doc, text, *_ in rows:
        ids.setdefault(doc, []).append(plain(text or "") + [1])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        own = next(x for x in ids[r.doc_id] if len(x) == r.n_tokens and zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        ids[r.doc_id].remove(own)
        assert r.start == at
        at += r.n_tokens
    assert not any(ids.values())
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert token_files.encode_and_read(spark, docs(spark, []), PATH).count() == 0


def test_large_items_pair_at_most_and_all_is_placed():
    random.seed(2)
    for _ in range(200):
        capacity = random.choice([10, 31, 100])
        counts = {random.randint(1, capacity): random.randint(1, 30) for _ in range(random.randint(1, capacity))}
        bins, placed, ranks = packing.plan_bins(counts, capacity), {}, {}
        for b in bins:
            at = 0
            for size, rank, each, offset in b.items:
                assert offset == at
                at += size * each
                placed[size] = placed.get(size, 0) + each * b.count
                ranks.setdefault(size, []).append((rank, rank + each * b.count))
            assert at <= capacity and sum(each for size, _, each, _ in b.items if 3 * size > capacity) <= 2
        assert placed == counts
        assert all(sorted(r)[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(r), sorted(r)[1:])) for r in ranks.values())
        fit: list[int] = []  # item by item
        for size in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
            k = max((k for k in range(len(fit)) if fit[k] + size <= capacity), key=lambda k: fit[k], default=None)
            if k is None:
                fit.append(size)
            else:
                fit[k] += size
        assert sum(b.count for b in bins) <= len(fit) + 1


def test_packing_keeps_every_token(spark):
    rows = [(k, t, "x", 1, "y") for k, t in enumerate(ODD * 3)] + [(3, None, None, None, None), (3, None, None, None, None), (None, "w " * 50, None, None, None)]
    got = packing.pack(spark, docs(spark, rows), PATH, capacity=64, keep_ids=True).collect()
    whole = sorted(plain(t or "") + [1] for _, t, *_ in rows)
    pieces = {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids) <= 64 and r.start == 64 * r.piece
    assert sum(r.length for r in got) == sum(map(len, whole)) and len(got) == sum(-(-len(x) // 64) for x in whole)
    for r in got:
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in pieces.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    made = packing.sequences(packing.pack(spark, docs(spark, rows), PATH, capacity=64, keep_ids=True)).collect()
    assert max(len(r.ids) for r in made) <= 64 and sum(len(r.ids) for r in made) == sum(map(len, whole))
    assert packing.pack(spark, docs(spark, []), PATH).count() == 0
