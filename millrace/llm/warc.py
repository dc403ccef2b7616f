"""WARC archives with Zstandard: a dictionary in the leading skippable frame, then one frame for each record.

Archive layout (the public WARC-Zstandard convention): a skippable frame with magic number 0x184D2A5D whose content is
the dictionary, itself perhaps compressed as a frame; then frames that each hold one whole WARC record. The reader
takes the dictionary from that first frame, decodes a frame at a time and refuses records whose version line, fields,
Content-Length, closing line ends, HTTP length or payload digest are wrong.

Records with equal payloads of at least `revisit_from` bytes are stored once: that with the largest page id is the
response, the others are revisits that refer to it. Payload digests are grouped with a maximum that is taken before the
shuffle, and only digests that occur twice or more are joined back. Each task writes one archive as a stream under a
name of its own; the manifest names the archives that count.

Defined results: null html counts as an empty payload; a null url is written as `about:blank`; ids that occur twice keep
all their records, and every record of the largest id is a response; a null id becomes the record id `none` and is read
back as null, and a group whose ids are all null has responses only; an empty table makes no archive; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import store

# Fixed values of the format.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:millrace:page:"


class ArchiveError(ValueError):
    """An archive or a record that breaks the format."""


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A dictionary for records like these; empty where they are too few or too small to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def record(page_id, url: str, html: bytes, digest: str, refers_to=None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head without the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block += b"" if revisit else html
    clean = "".join(c if c > " " else "%%%02X" % ord(c) for c in url)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{ID}{'none' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID}{refers_to}>")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """A stream of records, each compressed as a frame of its own with the archive's dictionary."""

    def __init__(self, out, dictionary: bytes = b"", level: int = 3):
        import zstandard

        self.out = out
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True, write_checksum=True)
        stored = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
        out.write(struct.pack("<II", SKIPPABLE, len(stored)) + stored)

    def add(self, data: bytes) -> None:
        self.out.write(self.compressor.compress(data))


def read_archive(source, block: int = 1 << 17, max_record: int = 1 << 31) -> Iterator[bytes]:
    """The records of a stream with .read(n), each decoded from its own frame."""
    import zstandard

    def more() -> bytes:
        return source.read(block)

    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise ArchiveError("the archive does not start with a dictionary frame")
    size, stored = struct.unpack("<I", head[4:])[0], b""
    while len(stored) < size:
        part = source.read(size - len(stored))
        if not part:
            raise ArchiveError("the dictionary frame is cut off")
        stored += part
    if stored.startswith(FRAME):
        stored = zstandard.ZstdDecompressor().decompress(stored)
    shared = zstandard.ZstdCompressionDict(stored) if stored else None
    data = more()
    while data:
        if not FRAME.startswith(data[:4]) and not data.startswith(FRAME):
            raise ArchiveError("a record's frame is expected")
        frame, out, made = zstandard.ZstdDecompressor(dict_data=shared).decompressobj(), [], 0
        while True:
            try:
                out.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"a frame cannot be decoded: {e}") from e
            made += len(out[-1])
            if made > max_record:
                raise ArchiveError("a record is longer than allowed")
            if frame.eof:
                data = frame.unused_data or more()
                break
            data = more()
            if not data:
                raise ArchiveError("the last frame is cut off")
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and url, payload) of a record, all checked."""

    def ref(text: str) -> int | None:
        if not (text.startswith(f"<{ID}") and text.endswith(">")):
            raise ArchiveError(f"not a record id: {text[:80]}")
        own = text[len(ID) + 1 : -1]
        return None if own == "none" else int(own)

    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip() or name.lower() in fields:
            raise ArchiveError(f"not a field of its own: {line[:80]}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise ArchiveError(f"a record has no {name}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"a record's block has {len(rest) - 4} bytes; its head says {length}")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    told = [x.split(b":")[1] for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not found or not http.startswith(b"HTTP/") or len(told) != 1:
        raise ArchiveError("a block is not an HTTP response with a length")
    kind, digest, n = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(told[0])
    if kind == "response":
        if len(payload) != n or hashlib.sha1(payload).hexdigest() != digest:
            raise ArchiveError("a payload does not fit its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields or fields.get("warc-profile") != PROFILE:
        raise ArchiveError(f"not a whole response or revisit: {kind[:80]}")
    return {"page_id": ref(fields["warc-record-id"]), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": ref(fields["warc-refers-to"]) if kind == "revisit" else None, "url": fields.get("warc-target-uri"), "payload": payload}


def write_archives(pages: DataFrame, path: str, revisit_from: int = 1000, level: int = 3, sample: int = 400, sample_bytes: int = 16384, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write an archive for each task under `path`; returns the manifest: path, n_records.

    The dictionary is trained on at most `sample` payloads, of which it sees `sample_bytes` each.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("html"))
    some = pages.select(F.substring("html", 1, sample_bytes)).limit(sample).collect()
    dictionary = train_dictionary([bytes(r[0]) for r in some if r[0]])
    pages = pages.withColumn("digest", F.sha1("html"))
    again = pages.filter(F.length("html") >= revisit_from).groupBy("digest").agg(F.max("page_id").alias("stored"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "stored")
    pages = pages.join(again, "digest", "left")
    pages = pages.select("page_id", "url", "html", "digest", "stored", F.coalesce(F.col("stored") != F.coalesce("page_id", F.col("stored") - 1), F.lit(False)).alias("revisit"))

    def write(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = store.filesystem(path)
        name, out, n = f"{root}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(name)
                archive = ArchiveWriter(out, dictionary, level)
            for k in range(batch.num_rows):
                page, url, html, digest, stored, revisit = (batch.column(c)[k].as_py() for c in range(6))
                archive.add(record(page, url or "about:blank", html, digest, stored, revisit))
            n += batch.num_rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["path", "n_records"])

    manifest = pages.mapInArrow(write, "path string, n_records long")
    manifest.write.parquet(f"{path}/_manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/_manifest")


def read_archives(manifest: DataFrame, path: str, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and url, payload) of every record of the archives."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["url", "payload"] * with_payload]
    todo = manifest.select("path", "n_records").repartition(store.shuffle_partitions(manifest.sparkSession), "path")

    def read(batches) -> Iterator:
        import pyarrow as pa

        fs, _ = store.filesystem(path)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=False)], names)

        for batch in batches:
            for file, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen = [], 0
                with fs.open_input_stream(file) as source:
                    for data in read_archive(source):
                        found = parse(data)
                        seen += 1
                        rows.append({k: found[k] for k in names})
                        if len(rows) >= (256 if with_payload else 4096):
                            yield made(rows)
                            rows = []
                if seen != n:
                    raise ArchiveError(f"{file} has {seen} records instead of {n}")
                if rows:
                    yield made(rows)

    return todo.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload)


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write the pages' archives to the shared folder and return what the archives say of each page."""
    path = store.fresh_dir(spark, "warc")
    return read_archives(write_archives(pages, path, **options), path)
