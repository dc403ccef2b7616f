"""Token-ID files: concatenated ids with Elias-Fano document boundaries.

A shard file holds the ids of a run of documents one after another (2 bytes each if the vocabulary allows, else 4),
then two Elias-Fano sequences, the documents' first positions and their ids, and a footer that says where all of it
lies. `EliasFano.select` answers "where does document i start" from the low bits, the high bits and one 32-bit count
for each 512 high bits; no table of 64-bit offsets is written or built.

Rows are shuffled once, by ranges of the document id, so that shard order is document order. Each task writes one
file under a name of its own; the manifest, a Parquet table, names the files of the attempts that counted, so a task
that is run again leaves an unread file at most. Reading back is one task for each shard in blocks of ids.

Defined results: null text counts as empty and gives the end id alone; null ids come first; rows that share an id stay
separate documents, ordered by a hash of their text; an empty table makes no file and an empty result; other columns
are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import store
from millrace.llm.slices import slices

MAGIC = b"MRTOKEF1"
FOOTER = struct.Struct("<QQQQqQQQQ8s")
_BLOCK = 512


class EliasFano:
    """A non-decreasing sequence of n unsigned integers in about 2 + log2(last / n) bits each."""

    HEAD = struct.Struct("<QQQ")

    def __init__(self, n: int, low_bits: int, lows: bytes, highs: bytes):
        import numpy as np

        self.n, self.low_bits, self.lows = n, low_bits, lows
        self.highs = np.frombuffer(highs, dtype=np.uint8)
        ones = np.bitwise_count(np.pad(self.highs, (0, -len(highs) % (_BLOCK // 8))).reshape(-1, _BLOCK // 8)).sum(axis=1, dtype=np.uint32)
        self.before = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)[:-1]]) if len(ones) else np.zeros(1, np.uint32)

    @classmethod
    def build(cls, values) -> EliasFano:
        import numpy as np

        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        lows = b""
        if low_bits:
            parts = [np.packbits(((values[k : k + 65536, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes() for k in range(0, n, 65536)]
            lows = b"".join(parts)  # 65536 entries fill whole bytes
        if not n:
            return cls(0, 0, b"", b"")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, dtype=np.uint8)
        bits[places] = 1
        return cls(n, low_bits, lows, np.packbits(bits, bitorder="little").tobytes())

    def tobytes(self) -> bytes:
        highs = self.highs.tobytes()
        return self.HEAD.pack(self.n, self.low_bits, len(highs)) + self.lows + highs

    @classmethod
    def frombytes(cls, data: bytes) -> EliasFano:
        n, low_bits, n_highs = cls.HEAD.unpack_from(data)
        cut = cls.HEAD.size + (n * low_bits + 7) // 8
        if len(data) != cut + n_highs:
            raise ValueError(f"an Elias-Fano section has {len(data)} bytes instead of {cut + n_highs}")
        return cls(n, low_bits, data[cls.HEAD.size : cut], data[cut:])

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        bit = i * self.low_bits
        return (int.from_bytes(self.lows[bit // 8 : (bit + self.low_bits + 7) // 8], "little") >> bit % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value."""
        import numpy as np

        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        bits = np.unpackbits(self.highs[block * _BLOCK // 8 : (block + 1) * _BLOCK // 8], bitorder="little")
        place = block * _BLOCK + int(np.flatnonzero(bits)[i - int(self.before[block])])
        return (place - i) << self.low_bits | self._low(i)

    def slice(self, start: int, stop: int):
        """Values start to stop - 1 as unsigned 64-bit integers, made for these alone."""
        import numpy as np

        stop = min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint64)
        a = int(np.searchsorted(self.before, start, side="right")) - 1
        b = int(np.searchsorted(self.before, stop - 1, side="right"))
        places = np.flatnonzero(np.unpackbits(self.highs[a * _BLOCK // 8 : b * _BLOCK // 8], bitorder="little")) + a * _BLOCK
        places = places[start - int(self.before[a]) :][: stop - start]
        values = (places - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            first = start * self.low_bits
            raw = np.frombuffer(self.lows, np.uint8)[first // 8 : (stop * self.low_bits + 7) // 8]
            bits = np.unpackbits(raw, bitorder="little")[first % 8 :][: (stop - start) * self.low_bits].reshape(-1, self.low_bits)
            for k in range(self.low_bits):
                values |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return values


class ShardWriter:
    """Writes one shard as a stream; memory holds a length and an id for each document."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.out.write(MAGIC)
        self.lengths: list[int] = []
        self.ids: list[int | None] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids) -> None:
        """Append a document, its token ids an array of unsigned integers."""
        self.out.write(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.lengths.append(len(ids))
        self.ids.append(doc_id)
        self.n_ids += len(ids)

    def close(self) -> None:
        import numpy as np

        ends = np.cumsum(np.asarray(self.lengths, dtype=np.uint64), dtype=np.uint64)
        bounds = EliasFano.build(np.concatenate([np.zeros(1, np.uint64), ends])).tobytes()
        known = [x for x in self.ids if x is not None]
        least = known[0] if known else 0
        docs = EliasFano.build(np.asarray([x - least for x in known], dtype=np.uint64)).tobytes()
        at = len(MAGIC) + self.n_ids * self.width
        self.out.write(bounds + docs)
        self.out.write(FOOTER.pack(len(self.lengths), self.n_ids, self.width, len(self.lengths) - len(known), least, at, len(bounds), at + len(bounds), len(docs), MAGIC))


class ShardReader:
    """Reads a shard by position: the footer and both sequences first, ids on demand."""

    def __init__(self, source, size: int):
        self.source = source
        head = source.read_at(len(MAGIC), 0)
        n, n_ids, width, nulls, least, at, bounds, docs_at, docs, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if head != MAGIC or magic != MAGIC or at != len(MAGIC) + n_ids * width or docs_at + docs + FOOTER.size != size:
            raise ValueError("not a whole token shard")
        self.n_docs, self.n_ids, self.width, self.nulls, self.least = n, n_ids, width, nulls, least
        self.bounds = EliasFano.frombytes(source.read_at(bounds, at))
        self.doc_ids = EliasFano.frombytes(source.read_at(docs, docs_at))
        if self.bounds.n != n + 1 or self.bounds.select(n) != n_ids or self.doc_ids.n != n - nulls:
            raise ValueError("the boundaries of a token shard do not fit its ids")

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.doc_ids.select(i - self.nulls)

    def tokens(self, i: int):
        """The ids of document i as unsigned 32-bit integers."""
        return self._ids(self.bounds.select(i), self.bounds.select(i + 1))

    def _ids(self, start: int, stop: int):
        import numpy as np

        raw = self.source.read_at((stop - start) * self.width, len(MAGIC) + start * self.width)
        return np.frombuffer(raw, dtype="<u2" if self.width == 2 else "<u4").astype("<u4")

    def documents(self, block: int = 1 << 21):
        """(doc_id, start, ids) of all documents in order, about `block` ids at a time."""
        i = 0
        while i < self.n_docs:
            j = min(self.n_docs, i + 4096)
            starts = self.bounds.slice(i, j + 1).astype("int64")
            while j > i + 1 and starts[j - i] - starts[0] > block:
                j = i + (j - i) // 2
            starts = starts[: j - i + 1]
            a, b = max(i - self.nulls, 0), max(j - self.nulls, 0)
            ids: list = [None] * ((j - i) - (b - a)) + [self.least + int(x) for x in self.doc_ids.slice(a, b)]
            data = self._ids(int(starts[0]), int(starts[-1]))
            for k, doc in enumerate(ids):
                yield doc, int(starts[k]), data[starts[k] - starts[0] : starts[k + 1] - starts[0]]
            i = j


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write the token ids of `docs` under `path` in ascending id order; returns the manifest, one row for each shard.

    shard int (in document order), path, n_docs, n_ids, n_bytes. `shards`: the number of id ranges, by default
    spark.sql.shuffle.partitions.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    docs = docs.repartitionByRange(shards or store.shuffle_partitions(spark), *order).sortWithinPartitions(*order)

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from millrace.llm.tokens import encoder

        fs, root = store.filesystem(path)
        enc = encoder(tokenizer_path)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        name = f"{root}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
        out = writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(name)
                writer = ShardWriter(out, width)
            for part in slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode_all(texts), strict=True):
                    writer.add(doc, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            row = [[TaskContext.get().partitionId()], [name], [len(writer.lengths)], [writer.n_ids], [fs.get_file_info(name).size]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["shard", "path", "n_docs", "n_ids", "n_bytes"])

    manifest = docs.mapInArrow(write, "shard int, path string, n_docs long, n_ids long, n_bytes long")
    manifest.write.parquet(f"{path}/_manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/_manifest")


def read_shards(manifest: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, read from the files of a manifest.

    start counts the ids of all shards before; the manifest has one row for each shard and is summed on the driver.
    """
    spark = manifest.sparkSession
    rows, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        rows.append((r.path, r.n_bytes, base))
        base += r.n_ids
    todo = spark.createDataFrame(rows, "path string, n_bytes long, base long").repartition(max(1, len(rows)))

    def read(batches):
        import pyarrow as pa

        fs, _ = store.filesystem(path)
        names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

        def made(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

        for batch in batches:
            for file, size, base in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                with fs.open_input_file(file) as source:
                    out, held = [], 0
                    for doc, start, ids in ShardReader(source, size).documents():
                        out.append((doc, base + start, len(ids), zlib.crc32(ids.tobytes()), *[ids.tolist()] * with_ids))
                        held += len(ids) if with_ids else 1
                        if held >= 1 << (17 if with_ids else 14):
                            yield made(out)
                            out, held = [], 0
                    if out:
                        yield made(out)

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def encode_and_read(spark: SparkSession, docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the documents' token files to the shared folder and return what the files say of each document."""
    path = store.fresh_dir(spark, "token-files")
    return read_shards(write_shards(docs, path, tokenizer_path, **options), path)
