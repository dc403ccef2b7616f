"""CSV, table and query sources, and what is taken out of them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType, VariantType


class SourceError(ValueError):
    """A source that does not fit its declaration."""


def _spans_lines(spark: SparkSession, path: str, quotechar: str) -> bool:
    """Whether a quoted field may hold a line end: some line has an odd number of quotes."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(quotechar), F.lit("")))
    return not lines.filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, header: bool, columns: list[str] | None = None, delimiter: str = ",", quotechar: str = '"', lineterminator: str | None = None, width: int | None = None, quoting: str = "minimal") -> DataFrame:
    """All columns as strings; without a header they are COL_0, COL_1 ... Empty fields, quoted or not, are null.

    quoting: minimal or all, which reading treats alike. A file is one task only where quoted fields may hold line ends, which
    one distributed pass over its lines tells; all other files are split.
    """
    if quoting not in ("minimal", "all"):
        raise SourceError("quoting must be one of: minimal, all")
    reader = spark.read.option("sep", delimiter).option("quote", quotechar).option("escape", quotechar).option("header", header).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if lineterminator and lineterminator not in ("\n", "\r\n", "\r"):
        reader = reader.option("lineSep", lineterminator)
    if _spans_lines(spark, path, quotechar):
        reader = reader.option("multiLine", True)
    if not header:
        width = width or len(reader.csv(path).columns)
        columns = [f"COL_{k}" for k in range(width)]
    if columns:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    df = reader.csv(path)
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def check_header(columns: list[str], fields: list[tuple[int | None, str | None]]) -> list[str]:
    """Messages about fields that name both a position and a column, or a column that is not there."""
    out, lower = [], [c.lower() for c in columns]
    for pos, name in fields:
        if pos is not None and pos >= len(columns):
            out.append(f"position {pos} is outside the header")
        if name is not None and name.lower() not in lower:
            out.append(f"column {name} is not in the header")
        elif pos is not None and name is not None and pos < len(columns) and lower[pos] != name.lower():
            out.append(f"position {pos} holds {columns[pos]}, not {name}")
    return out


def read_table(spark: SparkSession, name: str | None = None, query: str | None = None, resolve: Callable[[str], str] = lambda n: n) -> DataFrame:
    """A table by name, or a single SELECT or WITH statement."""
    if query is None:
        return spark.table(resolve(name))
    if not re.match(r"\s*(?:select|with)\b", query, re.I) or ";" in query.strip().rstrip(";"):
        raise SourceError("a query is one SELECT or WITH statement")
    return spark.sql(query.strip().rstrip(";"))


def variant(x: Column, kind) -> Column:
    """A column as VARIANT: JSON text is parsed, null where it is no JSON; structs, arrays and maps of strings are turned."""
    if isinstance(kind, VariantType):
        return x
    if isinstance(kind, StringType):
        return F.try_parse_json(x)
    if isinstance(kind, (StructType, ArrayType)) or isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        return F.to_variant_object(x)
    raise SourceError(f"paths and flattening need semi-structured values or JSON text, not {kind.simpleString()}")


def path_value(x: Column, path: str) -> Column:
    """The text at a path such as a.b[0] of a VARIANT; null where there is none."""
    return F.try_variant_get(x, f"$.{path}" if not path.startswith("[") else f"${path}", "string")


def flatten(df: DataFrame, column: str, alias: str, path: str | None = None, outer: bool = False, mode: str = "both") -> DataFrame:
    """A row for each element of an array or object: <alias>_POS, <alias>_KEY and <alias> (VARIANT)."""
    x = variant(F.col(column), df.schema[column].dataType)
    if path:
        x = F.try_variant_get(x, f"$.{path}", "variant")
    if mode != "both":
        x = F.when(F.schema_of_variant(x).startswith(mode.upper()), x)
    df = df.withColumn("_flat", x).withColumn("_flat", F.coalesce("_flat", F.parse_json(F.lit("null"))))
    df.createOrReplaceTempView(view := f"_flatten_{uuid.uuid4().hex}")
    names = ", ".join(f"t.`{c}`" for c in df.columns if c != "_flat")
    function = "variant_explode_outer" if outer else "variant_explode"
    try:
        return df.sparkSession.sql(f"SELECT {names}, f.pos {alias}_POS, f.key {alias}_KEY, f.value {alias} FROM {view} t, LATERAL {function}(t._flat) f")
    finally:  # the plan has been resolved by now
        df.sparkSession.catalog.dropTempView(view)


def sourced(x: Column | None, fixed_value=..., default_value=None, default_from: Column | None = None) -> Column:
    """A field's text: a fixed value, or the source with its defaults. Empty text counts as missing only where a default is given."""
    if fixed_value is not ...:
        return F.lit(fixed_value).cast("string")
    parts = [p.cast("string") for p in (x, default_from) if p is not None]
    if default_value is None and default_from is None:
        return parts[0]
    parts = [F.nullif(p, F.lit("")) for p in parts]
    return F.coalesce(*parts, *([F.lit(str(default_value))] if default_value is not None else []))


def lookup(df: DataFrame, reference: DataFrame, on: Column, key: str, value: str, name: str, current: str = "IS_CURRENT_FLAG", deleted: str = "IS_DELETED_FLAG") -> DataFrame:
    """df with `name`: the value, as text, of the current, undeleted reference row whose key equals `on`; null without one.

    The reference is one row a key, so that no row of df is repeated; a key of several live rows with different values
    raises an error where a row asks for it. Spark broadcasts the reference if its size allows.
    """
    live = reference.filter((F.col(current) == "Y") & (F.coalesce(deleted, F.lit("N")) == "N"))
    live = live.select(F.col(key).cast("string").alias("_key"), F.col(value).cast("string").alias("_value")).filter("_key IS NOT NULL")
    one = live.groupBy("_key").agg(F.min(F.struct("_value")).alias("_low"), F.max(F.struct("_value")).alias("_high"))
    found = df.join(one, on.cast("string") == F.col("_key"), "left")
    several = F.concat(F.lit(f"lookup of {name}: several live rows have the key "), F.col("_key"))
    return found.withColumn(name, F.when(F.col("_low") != F.col("_high"), F.raise_error(several).cast("string")).otherwise(F.col("_low._value"))).drop("_key", "_low", "_high")


def between_bookmarks(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows after the last bookmark up to the new one. The bounds are literals, so that they reach the scan."""
    return df.filter((F.col(column) > F.lit(low)) & (F.col(column) <= F.lit(high)))
