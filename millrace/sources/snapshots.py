"""Tables of immutable Parquet parts under manifests.

A table is a folder. Each commit writes new parts to a folder of their own and then publishes `_manifest-<n>.json`, which
names all live parts. A manifest is written under another name and put in place whole, by a step that fails if the number is
taken: a hard link on a local disk, a rename without overwriting elsewhere (HDFS has it; on an object store without such a
rename only one writer may commit to a table at a time). Readers take the manifest with the largest number, so that nothing is
seen before its manifest is there and a failed load leaves the table as it was. A writer that made its rows from what it read
gives the version it read (`base`); if another one has committed since, it gets Conflict and its rows are not seen.

Keyed tables are cut into buckets by a hash of the key: a commit rewrites the buckets of the keys that change and carries
the others over by name.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.history import without_keys

_BUCKET = "_bucket"
#: Of files: hashes take half the bytes of the default's.
_CODEC = "zstd"
#: Parts of a table without keys that are read by name before an append joins them.
MOST_PARTS = 200


class SchemaChanged(RuntimeError):
    """Rows whose schema is not that of the table."""


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Narrow:
    """How rows are moved with fewer bytes than they are stored with: rows of the table to narrow ones, these to rows of the
    table (other columns stay), and a key column of narrow rows as it is stored. Equal keys are equal when narrow."""

    narrow: Callable[[DataFrame], DataFrame]
    whole: Callable[[DataFrame], DataFrame]
    key: Callable[[str], Column]


class Snapshots:
    """Tables `schema.table` in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.staged: list[str] = []

    def own(self) -> Snapshots:
        """The same tables, with staged files of its own: for a load, which removes its files while others run."""
        return Snapshots(self.spark, self.root, self.buckets)

    # ---- files

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def dir(self, table: str) -> str:
        return f"{self.root}/{table.upper().replace('.', '/')}"

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        fs = self._fs(p)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def manifest(self, table: str) -> dict | None:
        """The newest manifest, null for a table that does not exist."""
        numbers = [int(n[10:-5]) for n in self._names(self.dir(table)) if n.startswith("_manifest-") and n.endswith(".json")]
        if not numbers:
            return None
        p = self._path(f"{self.dir(table)}/_manifest-{max(numbers)}.json")
        stream = self._fs(p).open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, table: str, version: int, schema: StructType, parts: dict[str, str], extra: dict | None = None, keys: list[str] = (), buckets: int | None = None) -> None:
        body = {"version": version, "schema": json.loads(schema.json()), "parts": parts, "keys": list(keys), "buckets": buckets or self.buckets, **(extra or {})}
        folder = self.dir(table)
        p, held = self._path(f"{folder}/_manifest-{version}.json"), self._path(f"{folder}/_tmp-{uuid.uuid4().hex}")
        fs = self._fs(held)
        stream = fs.create(held, False)
        try:
            stream.write(bytearray(json.dumps(body).encode()))
        finally:
            stream.close()
        try:
            self._publish(fs, held, p)
        except Exception as e:
            if not fs.exists(p):
                raise
            raise Conflict(f"version {version} of {table} is there already") from e
        finally:
            fs.delete(held, False)

    def _publish(self, fs, held, p) -> None:
        """Give a file its final name unless that is taken."""
        if fs.getUri().getScheme() == "file":
            os.link(*(unquote(fs.makeQualified(x).toUri().getRawPath()) for x in (held, p)))
            return
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(held, p, self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))

    @staticmethod
    def _more(m: dict, extra: dict | None) -> dict:
        """What a manifest holds beside the table: the new, or else what was there."""
        return extra if extra is not None else {k: v for k, v in m.items() if k not in ("version", "schema", "parts", "keys", "buckets")}

    def _expect(self, table: str, m: dict | None, base: int | None) -> None:
        if base is not None and (m or {"version": 0})["version"] != base:
            raise Conflict(f"{table} has been changed since version {base}")

    # ---- reading

    def exists(self, table: str) -> bool:
        return self.manifest(table) is not None

    def read(self, table: str, schema: StructType | None = None, only: list[str] | None = None, manifest: dict | None = None) -> DataFrame:
        """The table, or some of its parts, as of a manifest; an empty frame of the schema where there is none."""
        m = manifest or self.manifest(table)
        if m is None:
            if schema is None:
                raise LookupError(f"table {table} does not exist")
            return self.spark.createDataFrame([], schema)
        kind = StructType.fromJson(m["schema"])
        parts = sorted({v for k, v in m["parts"].items() if only is None or k in only})
        if not parts:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.dir(table)}/{p}" for p in parts])

    # ---- writing

    def _bucket(self, keys: list[str | Column], n: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")

    def _write(self, table: str, df: DataFrame, keys: list[str], buckets: int, form: Narrow | None = None) -> dict[str, str]:
        """Parts by bucket, or one part named by the folder. A folder is never used twice, so that lost tries do no harm.
        With a form df is narrow; its rows become whole after they have been moved and sorted."""
        folder = f"v={uuid.uuid4().hex}"
        path = f"{self.dir(table)}/{folder}"
        if not keys:
            df.write.parquet(path, compression=_CODEC)
            return {folder: folder}
        # rebalance splits buckets that are too large for a task and joins small ones
        df = df.withColumn(_BUCKET, self._bucket([form.key(k) for k in keys] if form else keys, buckets)).hint("rebalance", _BUCKET)
        if form:
            df = form.whole(df.sortWithinPartitions(_BUCKET, *keys))
        df.write.partitionBy(_BUCKET).parquet(path, compression=_CODEC)
        return {n.split("=")[1]: f"{folder}/{n}" for n in self._names(path) if n.startswith(f"{_BUCKET}=")}

    def _fits(self, table: str, m: dict | None, df: DataFrame) -> None:
        if m is None:
            return
        old = [(f.name.upper(), f.dataType) for f in StructType.fromJson(m["schema"])]
        if old != [(f.name.upper(), f.dataType) for f in df.schema]:
            raise SchemaChanged(f"the columns of {table} have changed")

    def touched(self, m: dict, rows: DataFrame) -> list[str] | None:
        """The parts of a keyed table that may hold keys of rows, whose columns they are; None for a table without keys."""
        if not m["keys"] or not set(m["keys"]) <= set(rows.columns):
            return None
        # at most `buckets` numbers
        found = {str(r[0]) for r in rows.select(self._bucket(m["keys"], m["buckets"])).distinct().collect()}
        return [k for k in m["parts"] if k.split("+")[0] in found]

    def overwrite(self, table: str, df: DataFrame, keys: list[str] = (), extra: dict | None = None, same_schema: bool = False, base: int | None = None, form: Narrow | None = None) -> None:
        """Replace the whole table; df may read the table itself. With a form df is narrow."""
        m = self.manifest(table)
        self._expect(table, m, base)
        if same_schema:
            self._fits(table, m, df)
        schema = (form.whole(df) if form else df).schema
        self._commit(table, (m or {"version": 0})["version"] + 1, schema, self._write(table, df, list(keys), self.buckets, form), extra, keys)

    def append(self, table: str, df: DataFrame, widen: bool = False, extra: dict | None = None, base: int | None = None) -> None:
        """Add rows. With widen, new columns are added to the table, and its own that df lacks are null."""
        m = self.manifest(table)
        self._expect(table, m, base)
        if m is None:
            return self._commit(table, 1, df.schema, self._write(table, df, [], self.buckets), extra)
        extra = self._more(m, extra)
        schema = StructType.fromJson(m["schema"])
        if widen:
            known = {f.name.upper() for f in schema}
            for f in df.schema:
                if f.name.upper() not in known:
                    schema = schema.add(f.name, f.dataType, True)
            have = {c.upper(): c for c in df.columns}
            df = df.select(*[(F.col(f"`{have[f.name.upper()]}`") if f.name.upper() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        else:
            self._fits(table, m, df)
        if m["keys"]:
            # appended rows of a keyed table go beside those of their buckets
            parts = {f"{k}+{uuid.uuid4().hex}": v for k, v in self._write(table, df, m["keys"], m["buckets"]).items()}
        elif len(m["parts"]) >= MOST_PARTS:
            # many small appends become one part, once in so many commits
            parts = self._write(table, self.read(table, manifest={**m, "schema": json.loads(schema.json())}).unionByName(df), [], self.buckets)
            return self._commit(table, m["version"] + 1, schema, parts, extra)
        else:
            parts = self._write(table, df, [], self.buckets)
        self._commit(table, m["version"] + 1, schema, {**m["parts"], **parts}, extra, m["keys"], m["buckets"])

    def rebucket(self, table: str, buckets: int) -> None:
        """Cut a keyed table into another number of buckets, which also joins what was appended to them."""
        m = self.manifest(table)
        if m is None or not m["keys"]:
            raise LookupError(f"{table} is no table with keys")
        rows = self.read(table, manifest=m)
        self._commit(table, m["version"] + 1, rows.schema, self._write(table, rows, m["keys"], buckets), self._more(m, None), m["keys"], buckets)

    def replace_keys(self, table: str, rows: DataFrame, keys: list[str], extra: dict | None = None, match: list[str] | None = None, base: int | None = None, form: Narrow | None = None) -> int:
        """Put rows in place of all rows of their keys (of `match`, a longer key, where given). Only the buckets of the keys
        are read and written. rows should be a written table, as they are read twice; with a form they are narrow, and match, if
        given, is of columns that are stored as they are. Gives the number of buckets."""
        m = self.manifest(table)
        self._expect(table, m, base)
        shown = form.whole(rows) if form else rows
        if m is None:
            self._commit(table, 1, shown.schema, self._write(table, rows, keys, self.buckets, form), extra, keys)
            return self.buckets
        extra = self._more(m, extra)
        self._fits(table, m, shown)
        narrow = form.narrow if form else lambda df: df
        if m["keys"] != list(keys):
            on = match or keys
            kept = without_keys(narrow(self.read(table, manifest=m)), rows, on)
            self._commit(table, m["version"] + 1, shown.schema, self._write(table, kept.unionByName(rows), keys, self.buckets, form), extra, keys)
            return self.buckets
        live = self.touched(m, shown)
        if rows.isEmpty():
            return 0
        kept = without_keys(narrow(self.read(table, only=live, manifest=m)), rows, match or keys)
        parts = self._write(table, kept.unionByName(rows.select(*kept.columns)), keys, m["buckets"], form)
        self._commit(table, m["version"] + 1, shown.schema, {**{k: v for k, v in m["parts"].items() if k not in live}, **parts}, extra, keys, m["buckets"])
        return len({k.split("+")[0] for k in live})

    def stage(self, label: str, df: DataFrame) -> DataFrame:
        """df written beside the tables and read again: it is used several times, and lost executors cost nothing."""
        path = f"{self.root}/_stage/{label.upper()}-{uuid.uuid4().hex}"
        df.write.parquet(path, compression=_CODEC)
        self.staged.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear_stage(self) -> None:
        """Remove what this object staged; other loads keep theirs."""
        while self.staged:
            p = self._path(self.staged.pop())
            self._fs(p).delete(p, True)

    def vacuum(self, table: str, keep: int = 2) -> int:
        """Remove parts that none of the last `keep` manifests names, and older manifests. No load may run meanwhile."""
        folder = self.dir(table)
        names = self._names(folder)
        numbers = sorted(int(n[10:-5]) for n in names if n.startswith("_manifest-") and n.endswith(".json"))
        live: set[str] = set()
        for n in numbers[-keep:]:
            p = self._path(f"{folder}/_manifest-{n}.json")
            stream = self._fs(p).open(p)
            live |= {v.split("/")[0] for v in json.loads(bytes(stream.readAllBytes()).decode())["parts"].values()}
            stream.close()
        gone = [n for n in names if n.startswith("_tmp-") or n.startswith("v=") and n not in live] + [f"_manifest-{n}.json" for n in numbers[:-keep]]
        for n in gone:
            p = self._path(f"{folder}/{n}")
            self._fs(p).delete(p, True)
        return len(gone)


def scratch(spark: SparkSession, label: str) -> Snapshots:
    """A store of its own in the shared folder that spark.checkpoint.dir names; on one machine a temporary folder will do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-tables-")
    return Snapshots(spark, f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}")
