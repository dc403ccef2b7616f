"""Best-fit packing of token sequences: large items are matched first, small ones fill the gaps.

Lengths are whole numbers from 1 to the capacity C, so the bins depend on nothing but how many pieces have each
length. The driver gets this count (C rows at most, whatever the input), and packs classes of equal pieces:

1. pieces above C/3, longest first, are matched greedily: each takes the longest other one above C/3 that still fits,
   so that a bin holds two of them at most;
2. smaller pieces, longest first, go to the bin with the smallest gap that holds them; a new bin is opened only if
   there is none.

A step places as many equal pieces in as many equal bins as it can, so its cost follows the number of different
lengths and not the number of pieces. The plan is a table of rank ranges of each length; its size depends on C alone
(some tens of thousands of rows for 4096), so that it is broadcast. A piece finds its place from its rank among the
pieces of its length, which is counted per task and summed by a window over tasks: no group of pieces meets in a task.

Defined results: null text counts as empty (the end id alone); rows that share an id are separate documents with equal
doc_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import store
from millrace.llm.slices import slices


class _Bins:
    """Equal bins: how many, and what each holds as (length, first rank, number, offset)."""

    __slots__ = ("count", "items", "gap")

    def __init__(self, count: int, items: tuple, gap: int):
        self.count, self.items, self.gap = count, items, gap

    def split(self, n: int) -> _Bins:
        """Take n bins away and return them."""
        taken = _Bins(n, self.items, self.gap)
        self.items = tuple((size, rank + n * each, each, at) for size, rank, each, at in self.items)
        self.count -= n
        return taken


def plan_bins(counts: dict[int, int], capacity: int) -> list[_Bins]:
    """Pack counts[length] pieces of each length into bins of the capacity."""
    left, rank = dict(counts), dict.fromkeys(counts, 0)

    def take(size: int, n: int) -> int:
        left[size] -= n
        rank[size] += n
        return rank[size] - n

    bins: list[_Bins] = []
    large = sorted(s for s in counts if 3 * s > capacity and counts[s])
    for size in reversed(large):
        while left[size]:
            k = bisect.bisect_right(large, min(capacity - size, size)) - 1
            while k >= 0 and left[large[k]] < (2 if large[k] == size else 1):
                k -= 1
            if k < 0:
                n = left[size]
                bins.append(_Bins(n, ((size, take(size, n), 1, 0),), capacity - size))
            elif large[k] == size:
                n = left[size] // 2
                bins.append(_Bins(n, ((size, take(size, 2 * n), 2, 0),), capacity - 2 * size))
            else:
                n = min(left[size], left[large[k]])
                bins.append(_Bins(n, ((size, take(size, n), 1, 0), (large[k], take(large[k], n), 1, size)), capacity - size - large[k]))
        large.pop()
    by_gap: dict[int, list[_Bins]] = {}
    gaps: list[int] = []

    def put(b: _Bins) -> None:
        if b.gap not in by_gap:
            bisect.insort(gaps, b.gap)
        by_gap.setdefault(b.gap, []).append(b)

    for b in bins:
        put(b)
    for size in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while left[size]:
            k = bisect.bisect_left(gaps, size)
            if k < len(gaps):
                gap = gaps[k]
                b = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap], gaps[k]
            else:
                b = _Bins(left[size], (), capacity)
            each = min(b.gap // size, left[size])
            n = min(b.count, left[size] // each)
            used = b if n == b.count else b.split(n)
            if used is not b and b.items:
                put(b)
            used.items += ((size, take(size, n * each), each, capacity - used.gap),)
            used.gap -= each * size
            put(used)
    return [b for group in by_gap.values() for b in group]


def plan_table(bins: list[_Bins]) -> dict[str, list[int]]:
    """The plan as columns, ordered by length and first rank."""
    rows, sequence = [], 0
    for b in bins:
        rows += [(size, rank, each, at, sequence) for size, rank, each, at in b.items]
        sequence += b.count
    rows.sort()
    names = ("length", "rank", "each", "offset", "sequence")
    return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """Tokenize and cut: doc_id, piece, start, length, ids_crc32, task, nth (its number among the task's pieces of this length)."""

    def cut(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from millrace.llm.tokens import encoder

        enc, seen, task = encoder(tokenizer_path), [0] * (capacity + 1), TaskContext.get().partitionId()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int32())] * keep_ids]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", *["ids"] * keep_ids]
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode_all(texts), strict=True):
                    ids += end_id.to_bytes(4, "little")
                    for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc, piece, a // 4, n, zlib.crc32(own), task, seen[n], *[np.frombuffer(own, "<i4")] * keep_ids))
                        seen[n] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * keep_ids)


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every document."""
    pieces = store.materialize(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids), "packing-pieces")
    counted = store.materialize(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    total = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()  # one row for each length: the capacity at most
    plan = spark.sparkContext.broadcast(plan_table(plan_bins({int(r.length): int(r.n) for r in total}, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def place(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        p = {k: np.asarray(v, dtype=np.int64) for k, v in plan.value.items()}
        key = (p["length"] << 44) + p["rank"]  # fewer than 2**44 pieces of a length
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            nth = rank - p["rank"][at]
            sequence, offset = p["sequence"][at] + nth // p["each"][at], p["offset"][at] + nth % p["each"][at] * length
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    ranked = pieces.join(counted, ["task", "length"]).select(*kept, (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids: the token sequences of pack(keep_ids=True), at most the capacity in each group."""
    groups = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return groups.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
