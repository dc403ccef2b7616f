"""Versions of entities over time: merging, windows, and checks of windows.

Everything partitions by the business key. One exchange by key serves the whole chain of windows; of the target only the
entities that change are rewritten.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import keys

START, END = "0001-01-01 00:00:00", "9999-12-31 23:59:59"


class HistoryError(RuntimeError):
    """Validity windows that break their contract."""


@dataclass(frozen=True)
class History:
    """Names and policies of a history table. `kind`: auto (load time) or derived (source time). `by_order`: of versions of
    one start the configured order decides, whichever came first; its columns are kept in the target."""

    keys: tuple[str, ...]
    kind: str = "auto"
    valid_from: str = "VALID_FROM_DATETIME"
    valid_to: str = "VALID_TO_DATETIME"
    current: str = "IS_CURRENT_FLAG"
    deleted: str = "IS_DELETED_FLAG"
    hash: str = "BUSINESS_DATA_HASH"
    start_at_origin: bool = True
    dates: bool = False
    offset: str = "interval 1 microsecond"
    end: str = END
    order: tuple[tuple[str, str, str], ...] = field(default=())  # (column, asc or desc, first or last)
    by_order: bool = False

    def __post_init__(self):
        if self.dates and self.offset == "interval 1 microsecond":
            object.__setattr__(self, "offset", "interval 1 day")

    @property
    def type(self) -> str:
        return "date" if self.dates else "timestamp_ntz"

    def literal(self, text: str) -> Column:
        return F.lit(text[:10] if self.dates else text).cast(self.type)

    @property
    def by_key(self):
        return Window.partitionBy(*self.keys)


def _same(a: str, b: str, columns) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in columns])


def _deleted(alias: str, h: History) -> Column:
    return F.coalesce(F.col(f"{alias}.{h.deleted}"), F.lit("N"))


def suppress_unchanged(incoming: DataFrame, existing: DataFrame, h: History) -> DataFrame:
    """Incoming rows that say something new. A derived history drops versions that are there already; both kinds drop
    rows equal to the current version that do not begin before it. By order, a version is there already if its order is, too."""
    n, e = incoming.alias("n"), existing.alias("e")
    equal = _same("n", "e", [*h.keys, h.hash]) & (_deleted("n", h) == _deleted("e", h))
    if h.kind == "derived":
        there = equal & (F.col(f"n.{h.valid_from}") == F.col(f"e.{h.valid_from}"))
        for c in [c for c, _, _ in h.order] if h.by_order else []:
            there = there & F.col(f"n.{c}").eqNullSafe(F.col(f"e.{c}"))
        n = n.join(e, there, "left_anti").alias("n")
    now = existing.filter(F.col(h.current) == "Y").alias("e")
    a, b = F.col(f"n.{h.valid_from}"), F.col(f"e.{h.valid_from}")
    return n.join(now, equal & ((a > b) if h.by_order else (a >= b)), "left_anti")


def _order(h: History) -> list[Column]:
    out = []
    for name, direction, nulls in h.order:
        out.append(getattr(F.col(name), f"{direction}_nulls_{nulls}")())
    return out


def one_version(rows: DataFrame, h: History, existing: str = "_existing") -> DataFrame:
    """One row for each key and start: incoming before existing, then the configured order, then the hash; by order, incoming
    before existing only where order and hash are equal."""
    state = F.col(h.hash)
    if rows.schema[h.hash].dataType.typeName() == "binary":
        state = keys.unpacked(state)
    came, order = F.col(existing).asc(), [*_order(h), state.desc()]
    order = [*order, came] if h.by_order else [came, *order]
    nth = F.row_number().over(Window.partitionBy(*h.keys, h.valid_from).orderBy(*order))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def collapse_boundaries(rows: DataFrame, h: History, existing: str = "_existing") -> DataFrame:
    """Drop incoming rows equal to the version before them, and existing rows whose predecessor is an equal incoming row
    unless the row before that is equal as well. Neighbours that were equal before stay."""
    w = h.by_key.orderBy(h.valid_from)
    state = F.struct(F.col(h.hash), F.coalesce(h.deleted, F.lit("N")))
    one, two = F.lag(state, 1).over(w), F.lag(state, 2).over(w)
    kept = F.when(F.col(existing) == 0, ~F.coalesce(one == state, F.lit(False))).otherwise(
        ~(F.coalesce(one == state, F.lit(False)) & (F.coalesce(F.lag(F.col(existing), 1).over(w), F.lit(1)) == 0) & ~F.coalesce(two == state, F.lit(False)))
    )
    return rows.withColumn("_kept", kept).filter("_kept").drop("_kept")


def windows(rows: DataFrame, h: History) -> DataFrame:
    """valid_from of first versions, valid_to and the current flag."""
    w = h.by_key.orderBy(h.valid_from)
    if h.kind == "auto" and h.start_at_origin:
        rows = rows.withColumn(h.valid_from, F.when(F.row_number().over(w) == 1, h.literal(START)).otherwise(F.col(h.valid_from)))
    until = (F.lead(h.valid_from).over(w) - F.expr(h.offset)).cast(h.type)
    rows = rows.withColumn(h.valid_to, F.coalesce(until, h.literal(h.end)))
    return rows.withColumn(h.current, F.when(F.col(h.valid_to) == h.literal(h.end), "Y").otherwise("N"))


def merge(existing: DataFrame, incoming: DataFrame, h: History) -> DataFrame:
    """All versions of the entities that change. incoming: as existing, without valid_to and current."""
    columns = [c for c in existing.columns if c not in (h.valid_to, h.current)]
    changes = suppress_unchanged(incoming.select(*columns), existing, h).withColumn("_existing", F.lit(0))
    affected = existing.join(changes.select(*h.keys).distinct(), list(h.keys), "left_semi").select(*columns).withColumn("_existing", F.lit(1))
    # dealt by key before the first window, which would deal by key and start
    rows = collapse_boundaries(one_version(affected.unionByName(changes).repartition(*h.keys), h), h)
    return windows(rows, h).drop("_existing").select(*existing.columns)


def without_keys(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target without the rows whose keys are in rows; null equals null."""
    a, b = target.alias("a"), rows.select(*keys).distinct().alias("b")
    return a.join(b, reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]), "left_anti")


def keyed_replace(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target with all rows of the keys in `rows` replaced by `rows`; null equals null."""
    return without_keys(target, rows, keys).unionByName(rows)


def window_failures(rows: DataFrame, h: History, mode: str = "continuous") -> DataFrame:
    """Rows whose windows are open, empty or overlapping; continuous histories have no gaps and end at the end of time."""
    nxt = F.lead(h.valid_from).over(h.by_key.orderBy(h.valid_from))
    a, b, n = F.col(h.valid_from), F.col(h.valid_to), F.col("_next")
    bad = a.isNull() | b.isNull() | ((b < a) if h.dates else (b <= a)) | F.coalesce(n <= b, F.lit(False))
    if mode == "continuous":
        tick = (b + F.expr(h.offset)).cast(h.type)
        last = F.lit("9999-12-30").cast(h.type)
        bad = bad | F.coalesce(n != tick, F.lit(False)) | (n.isNull() & (b < last))
    return rows.withColumn("_next", nxt).filter(F.coalesce(bad, F.lit(True))).drop("_next")


def require_windows(rows: DataFrame, h: History, mode: str = "continuous") -> None:
    n = window_failures(rows, h, mode).count()
    if n:
        raise HistoryError(f"{n} validity window(s) break the {mode} contract")


def without_invalid_keys(rows: DataFrame, h: History, mode: str = "continuous") -> DataFrame:
    return rows.join(window_failures(rows, h, mode).select(*h.keys).distinct(), list(h.keys), "left_anti")


def after_load(rewritten: DataFrame, existing: DataFrame, h: History) -> DataFrame:
    """The whole target as it will be: rewritten entities and all others."""
    return keyed_replace(existing, rewritten, list(h.keys))


def duplicate_metrics(rows: DataFrame, h: History, existing: str = "_existing") -> DataFrame:
    """One row: versions, and how many are equal to the one before, the one after, and the second one before."""
    w = h.by_key.orderBy(h.valid_from)
    state = F.struct(F.col(h.hash), F.coalesce(h.deleted, F.lit("N")))
    flags = {"equal_previous": F.lag(state, 1), "equal_next": F.lead(state, 1), "equal_second_previous": F.lag(state, 2)}
    rows = rows.select(*[F.coalesce(f.over(w) == state, F.lit(False)).cast("int").alias(n) for n, f in flags.items()])
    return rows.agg(F.count(F.lit(1)).alias("versions"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in flags])


def equal_to_current(incoming: DataFrame, existing: DataFrame, h: History) -> DataFrame:
    """Incoming rows whose entity has a current version of the same content."""
    now = existing.filter(F.col(h.current) == "Y").alias("e")
    return incoming.alias("n").join(now, _same("n", "e", [*h.keys, h.hash]) & (_deleted("n", h) == _deleted("e", h)), "left_semi")


def manual_state_failures(candidate: DataFrame, h: History, has_current: bool = True) -> DataFrame:
    """keys and STATE_DETAILS of entities whose source-managed windows break a rule: the last message by name."""
    w = h.by_key
    rows = candidate.withColumn("_next", F.lead(h.valid_from).over(w.orderBy(h.valid_from)))
    rows = rows.withColumn("_current", F.count_if(F.col(h.current) == "Y").over(w) if has_current else F.lit(0))
    detail = F.coalesce(
        F.when(F.col("_current") > 1, "scd2_manual has multiple current rows for the same current-row key"),
        F.when(F.col(h.valid_to) <= F.col(h.valid_from), "scd2_manual valid_to must be after valid_from"),
        F.when(F.col("_next") <= F.col(h.valid_to), "scd2_manual validity windows overlap for the same business key"),
    )
    return rows.withColumn("_d", detail).filter("_d IS NOT NULL").groupBy(*h.keys).agg(F.max("_d").alias("STATE_DETAILS"))


def manual_candidate(existing: DataFrame, incoming: DataFrame, h: History, update_keys: list[str] | None = None) -> DataFrame:
    """What the touched entities would look like: live rows that are not replaced, and the incoming ones (null-safe)."""

    def match(columns):
        return reduce(lambda x, y: x & y, [F.col(f"e.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns])

    e, n = existing.alias("e"), incoming.alias("n")
    live = e.join(n, match(h.keys), "left_semi")
    if update_keys:
        live = live.alias("e").join(n, match(update_keys), "left_anti")
    return live.unionByName(incoming.select(*existing.columns))


def as_of(facts: DataFrame, versions: DataFrame, h: History, at: str) -> DataFrame:
    """facts with the version of their entity that is valid at `at`."""
    f, v = facts.alias("f"), versions.alias("v")
    inside = _same("f", "v", h.keys) & F.col(f"f.{at}").between(F.col(f"v.{h.valid_from}"), F.col(f"v.{h.valid_to}"))
    extra = [F.col(f"v.{c}") for c in versions.columns if c not in h.keys]
    return f.join(v, inside, "left").select("f.*", *extra)
