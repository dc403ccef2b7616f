"""A load: from a checked specification to a committed table.

The order is source, verdicts, guard, typed rows, history, window checks, table, quarantine, bookmark, contract, job event.
Verdicts are written once beside the tables and read for all that follows. Nothing of the target is seen before its commit.

The commit names the version that the load read. If another load has committed since, the work on the target is done again
from the new version. Side tables, which many loads share, are tried again until they are written; they come after the target,
so that a load that breaks off between them can be run again: its versions are there and change nothing.
"""

from __future__ import annotations

import os
import random
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, VariantType

from millrace.functions import keys, rules, transforms
from millrace.functions.macros import Macros, Rules
from millrace.operators import history as H
from millrace.operators import verdict as V
from millrace.sources import scan
from millrace.sources.snapshots import Conflict, Narrow, Snapshots
from millrace.spec import load as spec_load
from millrace.spec.check import require
from millrace.spec.model import AUDIT, CURRENT, DATA_HASH, DELETED, SOURCE_AUDIT, Field, Spec
from millrace.spec.types import parse_type

_JOBS = "JOB_ID string, EVENT_TYPE string, EVENT_TIMESTAMP timestamp_ntz, RESULT string, DETAILS string, SPEC_FILE_NAME string, GENERATED_TABLE string, QUARANTINE_TABLE string, LOADED_COUNT decimal(38,0), QUARANTINE_COUNT decimal(38,0), AUDIT_DATA_PROCESS_KEY string"
_BOOKMARKS = "PIPELINE_NAME string, SOURCE_RELATION string, LAST_SOURCE_TIMESTAMP timestamp_ntz, UPDATED_AT timestamp_ntz, UPDATED_BY string"
_CONTRACTS = "DATABASE_NAME string, SCHEMA_NAME string, TABLE_NAME string, COLUMN_NAME string, PII_CATEGORY string, PCI_CATEGORY string, DATA_CLASSIFICATION string, DESCRIPTION string, CONTRACT_SOURCE string, CONTRACT_VERSION string, LOADED_AT timestamp_ntz, LOADED_BY string"
# Tags that contracts know, and the texts of job details.
_KNOWN_TAGS = ("PII_CATEGORY", "PCI_CATEGORY", "DATA_CLASSIFICATION")
_DETAIL_RULES = "validation errors failed the load"
_DETAIL_RUN = "the load failed; see the error that was raised"
_DETAIL_QUARANTINE = "validation errors written to quarantine output"

# Strings and comments of SQL, which are passed over, or a relation's name after FROM, JOIN or a comma of a FROM clause.
_RELATION = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|--[^\n]*|/\*.*?\*/|\b(?:from|join)\s+(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)(?!\s*\()""", re.I | re.S)
_CTE = re.compile(r"(?:\bwith(?:\s+recursive)?|,)\s+([A-Za-z_]\w*)\s*(?:\([^()]*\)\s*)?as\s*\(", re.I)


@dataclass
class Report:
    """What a load did."""

    job_id: str
    result: str = "COMPLETED"
    details: str | None = None
    loaded: int = 0
    rewritten: int = 0
    quarantined: int = 0
    invalid_keys: int = 0
    seconds: float = 0.0
    metrics: dict = field(default_factory=dict)


class Loader:
    """Loads of one specification.

    store: the tables. folder: where relative files of the specification are. source_path: another CSV file. references:
    tables by name that a lookup or a query may read beside those of the store and the catalog. fault: called before the
    commit (tests). by_order: between loads, too, the order of duplicates decides which version of a start stays; without an
    order, and else, that of the later load does.
    """

    def __init__(self, spark: SparkSession, spec: Spec | dict, store: Snapshots, folder: str | Path = ".", variables: dict | None = None, macros: Macros | None = None, source_path: str | None = None, references: dict[str, DataFrame] | None = None, run_at: datetime | None = None, job_id: str | None = None, spec_name: str | None = None, governance: Callable[[str], None] | None = None, fault: Callable[[], None] | None = None, source: DataFrame | None = None, by_order: bool = False):
        self.spark, self.store = spark, store.own()
        self.spec = spec if isinstance(spec, Spec) else require(spec)
        self.folder, self.variables = Path(folder), variables or {}
        self.macros = macros or Macros([self.folder / "macros", Path.cwd() / "macros"])
        self.source_path, self.references, self.given = source_path, {k.upper(): v for k, v in (references or {}).items()}, source
        self.run_at = (run_at or datetime.now(timezone.utc)).replace(tzinfo=None)
        self.job_id = job_id or uuid.uuid4().hex
        self.spec_name, self.governance, self.fault = spec_name, governance, fault
        self.process_key = str(self.variables.get("audit_data_process_key", "manual"))
        self.high, self.base = None, None
        h = self.spec.history
        self.history = replace(h, by_order=by_order and bool(h.order))
        if self.history.by_order:
            lost = {c for c, _, _ in h.order} - {f.name for f in self.spec.fields} - {h.valid_from}
            if lost:
                raise ValueError(f"deduplicate: order between loads needs target fields, which {', '.join(sorted(lost))} is not")

    # ---- sources

    def relation(self, name: str) -> DataFrame:
        """A table of the references, the store or the catalog. A database in front of schema.table is left out for the store."""
        short = ".".join(name.upper().split(".")[-2:])
        if short in self.references:
            return self.references[short]
        return self.store.read(short) if self.store.exists(short) else self.spark.table(name)

    def _query(self, text: str) -> DataFrame:
        for call, column, where in spec_load.bookmark_calls(text):
            low, high = self._bounds(where)
            stamp = "TIMESTAMP_NTZ'{}'".format
            text = text.replace(call, f"({column} > {stamp(low or '1900-01-01 00:00:00')} AND {column} <= {stamp(high)})" if high else "(false)")

        views, own = [], {n.upper() for n in _CTE.findall(text)}

        def view(m: re.Match) -> str:
            short = ".".join((m["name"] or "").upper().split(".")[-2:])
            if not m["name"] or short in own or (short not in self.references and not self.store.exists(short)):
                return m[0]  # a string, a comment, a name of the query's own or of the catalog
            views.append(f"_{self.job_id[:12]}_{short.replace('.', '_')}")
            self.relation(m["name"]).createOrReplaceTempView(views[-1])
            return m[0][: m.start("name") - m.start()] + views[-1]

        try:
            return scan.read_table(self.spark, query=_RELATION.sub(view, text))
        finally:  # the plan has been resolved by now
            for name in views:
                self.spark.catalog.dropTempView(name)

    def source(self) -> DataFrame:
        """The source's rows; CSV columns are strings."""
        s = self.spec.source
        if self.given is not None:
            df = self.given
        elif s["format"] == "csv":
            seed, location = s.get("seed") or {}, s.get("location") or {}
            path = self.source_path or seed.get("file") or "/".join([str(self.variables.get("csv_stage") or location.get("stage", ".")), location["filename"]])
            if "://" not in path and not path.startswith("/"):
                path = str((self.folder / path).resolve())
            if (s.get("upload") or {}).get("enabled") and not self.source_path:
                self._upload(s["upload"], path)
            df = scan.read_csv(self.spark, path, s.get("header", True), delimiter=s.get("delimiter", ","), quotechar=s.get("quotechar", '"'), lineterminator=s.get("lineterminator"), quoting=s.get("quoting", "minimal"))
            if s.get("header", True):
                problems = scan.check_header(df.columns, [(f.source.get("pos"), f.source.get("column")) for f in self.spec.fields if "pos" in f.source or "column" in f.source])
                if problems:
                    raise scan.SourceError("; ".join(problems))
        else:
            df = self._query(s["query"]) if s.get("query") else self.relation(f"{s['schema']}.{s['table']}" if s.get("schema") else s["table"])
        flat = s.get("flatten") or []
        for entry in flat if isinstance(flat, list) else [flat]:
            df = scan.flatten(df, entry["column"], entry["alias"], entry.get("path"), entry.get("outer", False), entry.get("mode", "both"))
        for f in self.spec.fields:
            if "macro" in f.source:
                df = self.macros.source(f.source["macro"])(df, f.name, f.source.get("args") or {})
            elif f.lookup:
                df = self._lookup(df, f)
        return df

    def _upload(self, upload: dict, path: str) -> None:
        """Copy the driver's file to where the source is read; a file that is there stays unless `overwrite`."""
        local = upload["file"] if upload["file"].startswith("/") else str((self.folder / upload["file"]).resolve())
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        to = place(path)
        fs = to.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if upload.get("overwrite") or not fs.exists(to):
            fs.copyFromLocalFile(False, True, place(f"file://{local}"), to)

    def _lookup(self, df: DataFrame, f: Field) -> DataFrame:
        x = f.lookup
        reference = self.relation(x["reference_entity"])
        for name, value in ((DELETED, "N"), (CURRENT, "Y")):
            if name not in reference.columns:
                reference = reference.withColumn(name, F.lit(value))
        key = x["reference_attribute"]
        return scan.lookup(df, reference, F.expr(x["source_expression"]), key, x.get("return_attribute", key), f.name, CURRENT, DELETED)

    def _text(self, df: DataFrame, f: Field, plain: bool = False) -> Column:
        """The text of a field, with its defaults unless plain."""
        s = f.source
        names = {c.upper(): c for c in df.columns}
        if "fixed_value" in s:
            return scan.sourced(None, fixed_value=s["fixed_value"])
        x = None
        if "macro" in s or f.lookup:
            x = F.col(f"`{f.name}`")
        elif "snowflake_path" in s:
            column = names[s["column"].upper()]
            x = scan.path_value(scan.variant(F.col(f"`{column}`"), df.schema[column].dataType), s["snowflake_path"])
        elif "column" in s or "pos" in s or not ({"default_value", "default_from_field"} & set(s)):
            column = names.get(str(s.get("column", f.id)).upper()) if "column" in s or "pos" not in s else None
            if column is None and "pos" in s:
                column = df.columns[s["pos"]] if s["pos"] < len(df.columns) else None
            if column is None:
                raise scan.SourceError(f"field `{f.id}` has no source column")
            x = F.col(f"`{column}`")
            x = F.try_variant_get(x, "$", "string") if isinstance(df.schema[column].dataType, VariantType) else x.cast("string")
        if plain:
            return x if x is not None else F.lit(s.get("default_value")).cast("string")
        other = s.get("default_from_field")
        reference = None
        if other:
            reference = self._text(df, next(g for g in self.spec.fields if g.name == other.upper()), plain=True)
        return scan.sourced(x, default_value=s.get("default_value"), default_from=reference)

    # ---- verdicts

    def _judge(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        """(rows of _src and _typed, messages in their order)."""
        typed, failures, repeated = [], [], []
        for f in self.spec.fields:
            kind = parse_type(f.data_type)
            x, unparsed = transforms.apply(self._text(df, f), list(f.transforms), self.macros, str(self.variables.get("local_timezone", "UTC")))
            direct = kind.base in ("date", "timestamp") or kind.spark.startswith("timestamp")
            base = x if direct else x.cast("string")
            value = base.try_cast(kind.spark) if self.spec.validated else base.cast(kind.spark)
            typed.append(value.alias(f.name))
            if not self.spec.validated:
                continue
            nullable = f.nullable and not (f.lookup or {}).get("required")
            failures += rules.field_failures(f.id, x, f.data_type, nullable, list(f.validations), unparsed, Rules(self.macros))
            if f.unique:
                repeated.append((len(failures), f))
                failures.append(F.lit(None).cast("string"))
        source = F.struct(*[self._as_text(df, c).alias(c.upper()) for c in df.columns])
        out = df.select(source.alias("_src"), F.struct(*typed).alias("_typed"), *[m.alias(f"_m{i}") for i, m in enumerate(failures)])
        for i, f in repeated:
            out = V.mark_repeated(out, F.col("_typed").getField(f.name), "_repeated")
            out = out.withColumn(f"_m{i}", rules.unique_failure(f.id, F.col("_repeated"))).drop("_repeated")
        return out, [F.col(f"_m{i}") for i in range(len(failures))]

    @staticmethod
    def _as_text(df: DataFrame, c: str) -> Column:
        x = F.col(f"`{c}`")
        kind = df.schema[c].dataType
        return F.to_json(x) if isinstance(kind, VariantType) or kind.typeName() in ("struct", "array", "map") else x.cast("string")

    def judged(self) -> DataFrame:
        """_src, _typed and FAILURE_DETAILS."""
        df, failures = self._judge(self.source())
        return V.verdict(df, failures).select("_src", "_typed", V.DETAILS)

    def messages(self) -> DataFrame:
        """Source rows with all messages of all fields (local validation)."""
        df, failures = self._judge(self.source())
        return V.all_failures(df, failures).select("_src.*", "failures").filter(F.size("failures") > 0)

    # ---- typed rows

    def _stamped(self, df: DataFrame, hashed: Callable[[list[Column]], Column] = keys.hash_key) -> DataFrame:
        """Typed rows with keys, hash and audit columns."""
        h, now = self.spec.history, F.lit(self.run_at).cast("timestamp_ntz")
        names = self.spec.keys
        out = df.withColumn(h.keys[0], hashed([F.col(f"`{k}`") for k in names]) if names else F.lit(None).cast("binary" if hashed is keys.packed else "string"))
        out = out.withColumn(DATA_HASH, hashed([F.col(f"`{k}`") for k in self.spec.hashed]))
        return out.withColumns({AUDIT[0]: now, AUDIT[1]: now, AUDIT[2]: F.lit(self.process_key)})

    def _columns(self) -> list[str]:
        """Output columns in order."""
        spec, h = self.spec, self.spec.history
        names = [f.name for f in spec.fields]
        made = [c for c in (spec.surrogate, spec.key_name) if c]
        data_hash = [] if spec.skip_hash else [DATA_HASH]
        if spec.change_type == "scd1":
            return [*names, *made, *data_hash, *AUDIT]
        apart = (CURRENT, DELETED, h.valid_from, h.valid_to)
        flags = list(apart) if spec.generated else [c for c in apart if c in names]
        return [*made, *[n for n in names if n not in (*apart, *SOURCE_AUDIT)], *flags, *data_hash, *[n for n in names if n in SOURCE_AUDIT], *AUDIT]

    def _scd1(self, valid: DataFrame) -> DataFrame:
        rows = self._stamped(valid.select("_typed.*"))
        deletes = self.spec.scd.get("delete_detection")
        if deletes:
            rows = rows.filter(~F.coalesce(F.col(deletes["field"].upper()).cast("string") == str(deletes["value"]), F.lit(False)))
        if self.spec.surrogate:
            rows = rows.withColumn(self.spec.surrogate, F.expr("uuid()"))
        return rows.select(*self._columns())

    def incoming(self, valid: DataFrame) -> DataFrame:
        """Typed rows of a generated history with their proposed start, and hidden columns of the order of duplicates. A null
        start is kept: the window checks find it. Key and hash are packed, as they are in all steps up to the commit."""
        spec, h = self.spec, self.spec.history
        names = {f.name for f in spec.fields}
        hidden = [c for c, _, _ in h.order if c not in names and c != h.valid_from]
        rows = self._stamped(valid.select("_typed.*", *[F.col(f"_src.`{c}`").alias(c) for c in hidden]), keys.packed)
        if h.kind == "auto":
            start = F.lit(str(spec.scd["insert_time"])).cast("timestamp").cast(h.type)
        else:
            start = (F.expr(spec.start) if spec.start else F.col(h.valid_from)).cast(h.type)
        flag = spec.scd.get("deleted_flag") or {}
        deleted = F.col(flag["field"].upper()).cast("string") if flag.get("field") else F.lit(str(flag.get("value", "N")))
        return rows.withColumns({h.valid_from: start, DELETED: deleted})

    def existing(self, incoming: DataFrame, m: dict | None, whole: bool = True) -> DataFrame:
        """The target's versions, as of a manifest, with the internal columns of `incoming`; empty where there is no table or it
        is rebuilt. Unless `whole`, only the buckets of the incoming keys are read."""
        h = self.spec.history
        wanted = [*incoming.columns, h.valid_to, CURRENT]
        kinds = {f.name: f.dataType for f in incoming.schema}
        if m is None or self.spec.control.get("truncate_before_load"):
            schema = StructType(list(incoming.schema.fields)).add(h.valid_to, kinds[h.valid_from]).add(CURRENT, "string")
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != self.spec.surrogate]
            return self.spark.range(0).select(*none).filter(F.lit(False))  # Catalyst sees that it is empty and leaves out joins
        found = incoming.withColumn(h.keys[0], keys.unpacked(F.col(h.keys[0])))
        df = self._packed(self.store.read(self.spec.table, only=None if whole else self.store.touched(m, found), manifest=m))
        return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in wanted])

    def _packed(self, df: DataFrame) -> DataFrame:
        """Rows of the target with packed key and hash, whether they are stored or not."""
        for name, fields in ((self.spec.history.keys[0], self.spec.keys), (DATA_HASH, self.spec.hashed)):
            own = [F.col(f"`{k}`") for k in fields]
            df = df.withColumn(name, keys.packed_as(F.col(name), own) if name in df.columns else keys.packed(own))
        return df

    def _form(self) -> Narrow:
        """How versions are moved: key and hash packed, and a surrogate key only where it is not the one that is computed."""
        spec, h = self.spec, self.spec.history
        columns = self._columns()
        carried = list(dict.fromkeys([*columns, h.keys[0]]))

        def narrow(df: DataFrame) -> DataFrame:
            if spec.surrogate:
                made = self._versions(df if h.keys[0] in df.columns else df.withColumn(h.keys[0], keys.hash_key([F.col(f"`{k}`") for k in spec.keys])), "_made")
                df = made.withColumn(spec.surrogate, F.when(~F.col(spec.surrogate).eqNullSafe(F.col("_made")), F.col(spec.surrogate)))
            return self._packed(df).select(*carried)

        def whole(df: DataFrame) -> DataFrame:
            more = [c for c in df.columns if c not in carried and c.startswith("_")]
            df = df.withColumns({c: keys.unpacked(F.col(c)) for c in (h.keys[0], DATA_HASH) if c in df.columns})
            if spec.surrogate:
                df = self._versions(df, "_made").withColumn(spec.surrogate, F.coalesce(spec.surrogate, "_made"))
            return self._tagged(df.select(*columns, *more))

        return Narrow(narrow, whole, lambda k: keys.unpacked(F.col(k)) if k == h.keys[0] else F.col(k))

    def _versions(self, rows: DataFrame, surrogate: str | None = None) -> DataFrame:
        h = self.spec.history
        if self.spec.surrogate:
            name = F.concat_ws("|", F.col(h.keys[0]), F.date_format(h.valid_from, "yyyy-MM-dd"))
            rows = rows.withColumn(surrogate or self.spec.surrogate, keys.uuid5(name))
        return rows

    # ---- runs

    def plan(self) -> DataFrame:
        """The rows that a load would write, without any check or write: for explain."""
        valid = self.judged().filter(F.col(V.DETAILS).isNull())
        if self.spec.change_type == "scd1":
            return self._scd1(valid)
        if self.spec.manual:
            return self._manual_rows(valid)
        rows = self.incoming(valid)
        return self._form().whole(self._carried(H.merge(self.existing(rows, self.store.manifest(self.spec.table), whole=False), rows, self.history)))

    def _carried(self, rows: DataFrame) -> DataFrame:
        """Merged versions as the narrow rows of the target."""
        if self.spec.surrogate:
            rows = rows.withColumn(self.spec.surrogate, F.lit(None).cast("string"))
        return rows.select(*dict.fromkeys([*self._columns(), self.spec.history.keys[0]]))

    def run(self) -> Report:
        """Load and record it; what goes wrong is recorded and raised."""
        report, began = Report(self.job_id), time.monotonic()
        self._event("JOB_START", None)
        try:
            self._load(report)
            if report.quarantined:
                report.result, report.details = "COMPLETED_WITH_QUARANTINE", _DETAIL_QUARANTINE
        except Exception as e:
            report.result = "FAILED"
            report.details = _DETAIL_RULES if isinstance(e, (V.ValidationFailed, H.HistoryError)) else _DETAIL_RUN
            raise
        finally:
            report.details = self.variables.get("job_details") or report.details
            report.seconds = time.monotonic() - began
            self._event("JOB_END", report)
            self.store.clear_stage()
        return report

    @staticmethod
    def _patiently(write: Callable, tries: int = 20):
        """Repeat a write until no other writer is in its way."""
        for left in range(tries - 1, -1, -1):
            try:
                return write()
            except Conflict:
                if not left:
                    raise
                time.sleep(random.random())

    def _load(self, report: Report) -> None:
        spec = self.spec
        if spec.control.get("truncate_before_load") and str(self.variables.get("allow_truncate", "")).lower() != "true":
            raise ValueError("truncate_before_load needs the variable allow_truncate")
        if spec.control.get("incremental_bookmark") and self.high is None:
            self._bounds(None)
        judged = self.judged()
        if not spec.manual and not (spec.generated and {c for c, _, _ in spec.history.order} - {f.name for f in spec.fields}):
            # the source's columns are read again for the quarantine only
            judged = judged.withColumn("_src", F.when(F.col(V.DETAILS).isNotNull(), F.col("_src")))
        judged = self.store.stage("verdict", judged)
        make = {"scd1": self._commit_scd1, "scd2_manual": self._commit_manual}.get(spec.change_type, self._commit_history)

        def target() -> tuple[DataFrame, int]:
            own = self._with_state(judged) if spec.manual else judged
            counts = V.guard(own).first()
            bad = counts.VALIDATION_FAILURE_COUNT
            if bad and not spec.quarantine:
                raise V.ValidationFailed(f"{bad} validation row(s) failed. First failure: {counts.VALIDATION_FAILURE_DETAILS}")
            commit = make(own.filter(F.col(V.DETAILS).isNull()), report)
            if self.fault:
                self.fault()
            commit()
            return own, bad

        judged, report.quarantined = self._patiently(target)
        if report.quarantined:
            head = [F.lit(self.run_at).cast("timestamp_ntz").alias("LOADED_AT"), F.lit(self.job_id).alias("JOB_ID"), F.col(V.DETAILS)]
            bad_rows = V.quarantined(judged).select(*head, "_src.*")
            self._patiently(lambda: self.store.append(spec.quarantine_table, bad_rows, widen=True))
        report.loaded = self.store.read(spec.table).count()
        self._patiently(self._advance)
        self._patiently(self._contract)
        if self.governance and spec.target.get("tag_application") == "apply_governance":
            self.governance(spec.table)

    def _extra(self) -> dict:
        return {"tags": self.spec.target.get("tags") or {}, "column_tags": {f.name: dict(f.tags) for f in self.spec.fields if f.tags}}

    def _tagged(self, rows: DataFrame) -> DataFrame:
        """rows whose columns carry their tags and descriptions as metadata of the schema, which every reader sees."""
        for f in self.spec.fields:
            about = {**({"tags": {str(k): str(v) for k, v in f.tags}} if f.tags else {}), **({"comment": f.description} if f.description else {})}
            if about and f.name in rows.columns:
                rows = rows.withMetadata(f.name, about)
        return rows

    def _commit_scd1(self, valid: DataFrame, report: Report):
        rows = self._tagged(self._scd1(valid))
        return lambda: self.store.overwrite(self.spec.table, rows, extra=self._extra())

    def _commit_history(self, valid: DataFrame, report: Report):
        spec, h = self.spec, self.history
        incoming = self.incoming(valid)
        mode = spec.window_mode
        m = self.store.manifest(spec.table)
        base = m["version"] if m else 0
        existing = self.existing(incoming, m, whole=False)
        rows = self.store.stage("versions", H.merge(existing, incoming, h))
        if mode:
            checked = rows
            if spec.whole_validation:
                checked = H.after_load(rows.select(*existing.columns), self.existing(incoming, m), h)
            if not spec.quarantine:
                H.require_windows(checked, h, mode)
            else:
                bad = H.window_failures(checked, h, mode).select(*h.keys).distinct()
                report.invalid_keys = bad.count()
                if report.invalid_keys:
                    rows = self.store.stage("sound", rows.join(bad, list(h.keys), "left_anti"))
        report.rewritten = rows.count()
        if str(self.variables.get("log_scd2_duplicate_hash_metrics", "")).lower() == "true":
            report.metrics = {**H.duplicate_metrics(rows, h).first().asDict(), "equal_current": H.equal_to_current(incoming, existing, h).count()}
        out, form = self._carried(rows), self._form()
        key = [spec.key_name] if spec.key_name else spec.keys
        if spec.control.get("truncate_before_load"):
            return lambda: self.store.overwrite(spec.table, out, key, self._extra(), base=base, form=form)
        if not report.rewritten and base:
            return lambda: None
        return lambda: self.store.replace_keys(spec.table, out, key, self._extra(), base=base, form=form)

    # ---- histories that the source manages

    def _manual_rows(self, valid: DataFrame) -> DataFrame:
        rows = self._stamped(valid.select("_typed.*"))
        if self.spec.surrogate:
            rows = rows.withColumn(self.spec.surrogate, F.expr("uuid()"))
        return rows.select(*self._columns())

    def _with_state(self, judged: DataFrame) -> DataFrame:
        """judged, with state failures of their entities on rows that have no other failure."""
        spec = self.spec
        h = H.History(tuple(spec.keys), valid_from=spec.history.valid_from, valid_to=spec.history.valid_to)
        typed = judged.filter(F.col(V.DETAILS).isNull()).select("_typed.*")
        m = self.store.manifest(spec.table)
        self.base = m["version"] if m else 0
        if m and not spec.control.get("truncate_before_load"):
            existing = self.store.read(spec.table, manifest=m).select(*typed.columns)
        else:
            existing = self.spark.createDataFrame([], typed.schema)
        upsert = spec.scd.get("update_mode") == "upsert"
        candidate = H.manual_candidate(existing, typed, h, spec.update_keys if upsert else None)
        bad = H.manual_state_failures(candidate, h, CURRENT in typed.columns).withColumnsRenamed({k: f"_k_{k}" for k in spec.keys})
        on = F.lit(True)
        for k in spec.keys:
            on = on & F.col(f"_typed.{k}").eqNullSafe(F.col(f"_k_{k}"))
        out = judged.join(bad, on, "left").withColumn(V.DETAILS, F.coalesce(V.DETAILS, "STATE_DETAILS")).select("_src", "_typed", V.DETAILS)
        return self.store.stage("state", out)

    def _commit_manual(self, valid: DataFrame, report: Report):
        spec = self.spec
        rows = self._tagged(self.store.stage("manual", self._manual_rows(valid)))
        report.rewritten = rows.count()
        key = [spec.key_name] if spec.key_name else spec.keys
        base = self.base
        if spec.control.get("truncate_before_load") or not base:
            return lambda: self.store.overwrite(spec.table, rows, key, self._extra(), base=base)
        if not report.rewritten:
            return lambda: None
        if spec.scd.get("update_mode") == "upsert":
            return lambda: self.store.replace_keys(spec.table, rows, key, self._extra(), spec.update_keys, base)
        return lambda: self.store.append(spec.table, rows, extra=self._extra(), base=base)

    # ---- bookmarks, jobs, governance

    def _bounds(self, where: str | None):
        """(last bookmark, new one); the new one is read once for a load."""
        b = self.spec.control["incremental_bookmark"]
        if self.high is None:
            df = self.relation(b["source_relation"])
            column = b.get("source_timestamp_column", "AIRFLOW_DAG_TIME")
            self.high = (df.filter(where) if where else df).agg(F.max(F.col(column).cast("timestamp_ntz"))).first()[0]
        last = self.store.read(b["bookmark_relation"], StructType.fromDDL(_BOOKMARKS)).filter((F.col("PIPELINE_NAME") == self._pipeline) & (F.col("SOURCE_RELATION") == b["source_relation"])).agg(F.max("LAST_SOURCE_TIMESTAMP")).first()[0]
        return last, self.high

    @property
    def _pipeline(self) -> str:
        return (self.spec.control.get("incremental_bookmark") or {}).get("pipeline_name", self.spec.id)

    def _advance(self) -> None:
        b = self.spec.control.get("incremental_bookmark")
        if b and self.high is not None:
            row = self.spark.createDataFrame([(self._pipeline, b["source_relation"], self.high, self.run_at, os.environ.get("USER", "spark"))], _BOOKMARKS)
            self.store.replace_keys(b["bookmark_relation"], row, ["PIPELINE_NAME", "SOURCE_RELATION"])

    def _event(self, kind: str, report: Report | None) -> None:
        done = report is not None and report.result != "FAILED"
        row = (
            self.job_id, kind, datetime.now(timezone.utc).replace(tzinfo=None), report and report.result, report and report.details, self.spec_name or self.spec.id, self.spec.table,
            self.spec.quarantine_table if self.spec.quarantine else None, None, None, self.process_key,
        )
        df = self.spark.createDataFrame([row], _JOBS)
        if done:
            df = df.withColumns({"LOADED_COUNT": F.lit(report.loaded).cast("decimal(38,0)"), "QUARANTINE_COUNT": F.lit(report.quarantined).cast("decimal(38,0)")})
        self._patiently(lambda: self.store.append(self.spec.job_table, df))  # loads that run at once share the table

    def _contract(self) -> None:
        """Contract rows of tagged or described columns."""
        target = self.spec.target
        contract = target.get("governance_contract") or {}
        if target.get("tag_application") != "apply_governance":
            return
        schema, table = self.spec.table.split(".")
        rows = []
        for f in self.spec.fields:
            tags = {str(k).split(".")[-1].upper(): str(v) for k, v in f.tags}
            known = [tags.get(t) for t in _KNOWN_TAGS]
            if any(known) or f.description:
                rows.append((str(target.get("database", "")).upper(), schema, table, f.name, *known, f.description, contract.get("source"), contract.get("version") and str(contract["version"]), self.run_at, os.environ.get("USER", "spark")))
        if rows and contract.get("table"):
            self.store.replace_keys(contract["table"], self.spark.createDataFrame(rows, _CONTRACTS), ["DATABASE_NAME", "SCHEMA_NAME", "TABLE_NAME", "COLUMN_NAME"])


def load_file(spark: SparkSession, path: str | Path, store: Snapshots, variables: dict | None = None, search: list[str] = (), macro_folders: list[str] = (), **more) -> Report:
    """Resolve, check and run a specification file."""
    path = Path(path)
    spec = require(spec_load.resolve(path, list(search), variables))
    macros = Macros([*macro_folders, path.parent / "macros", Path.cwd() / "macros"])
    return Loader(spark, spec, store, path.parent, variables, macros, spec_name=path.name, **more).run()
