"""Row verdicts and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETAILS = "FAILURE_DETAILS"


class ValidationFailed(RuntimeError):
    """Rows broke rules in a load that must not go on then."""


def verdict(df: DataFrame, failures: list[Column]) -> DataFrame:
    """df with FAILURE_DETAILS: the first message of a row, null for a valid one."""
    return df.withColumn(DETAILS, F.coalesce(*failures, F.lit(None).cast("string")))


def all_failures(df: DataFrame, failures: list[Column], name: str = "failures") -> DataFrame:
    """df with an array of all messages of a row."""
    return df.withColumn(name, F.array_compact(F.array(*failures)) if failures else F.array().cast("array<string>"))


def valid(df: DataFrame) -> DataFrame:
    return df.filter(F.col(DETAILS).isNull()).drop(DETAILS)


def quarantined(df: DataFrame) -> DataFrame:
    return df.filter(F.col(DETAILS).isNotNull())


def guard(df: DataFrame) -> DataFrame:
    """One row: VALIDATION_FAILURE_GUARD, VALIDATION_FAILURE_COUNT, VALIDATION_FAILURE_DETAILS."""
    n = F.count(F.col(DETAILS))
    return df.agg(F.when(n > 0, 1).otherwise(0).alias("VALIDATION_FAILURE_GUARD"), n.alias("VALIDATION_FAILURE_COUNT"), F.min(DETAILS).alias("VALIDATION_FAILURE_DETAILS"))


def require_valid(df: DataFrame) -> None:
    """Raise if any row failed; nothing has been written by then."""
    g = guard(df).first()
    if g.VALIDATION_FAILURE_COUNT:
        raise ValidationFailed(f"{g.VALIDATION_FAILURE_COUNT} validation row(s) failed. First failure: {g.VALIDATION_FAILURE_DETAILS}")


def mark_repeated(df: DataFrame, x: Column, name: str) -> DataFrame:
    """df with a flag: whether another row has the same value of x; never for null.

    Values are counted before anything is shuffled whole, and only those that occur more than once are joined, so that a value
    or null in very many rows never meets in one task.
    """
    counted = df.select(x.alias("_value")).filter("_value IS NOT NULL").groupBy("_value").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_value")
    marked = df.withColumn("_own", x).join(counted, F.col("_own") == F.col("_value"), "left")
    return marked.withColumn(name, F.col("_value").isNotNull()).drop("_own", "_value")
