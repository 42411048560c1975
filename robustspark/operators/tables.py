"""Checks of tables: nulls, domains, keys, totals, references, duplicates and differences. Violations come back as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` unchanged; fails when a column is missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def profile_nulls(df: DataFrame) -> DataFrame:
    """Rows and nulls of every column in one pass."""
    counts = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count("*").alias("n_rows")) for c in df.columns]
    return df.agg(F.array(*counts).alias("all")).select(F.inline("all"))


def violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule and row; all rules in one pass. A rule that is null is broken."""
    found = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.select(F.col(id_col).alias("row_id"), F.explode(found).alias("rule"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; null keys are equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Distinct values of the child's column that the parent lacks."""
    return child.select(F.col(column).alias("value")).filter("value is not null").distinct().join(parent.select(F.col(key).alias("value")), "value", "left_anti")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows replaced by new rows of the same key, and unknown keys appended."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def difference(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys added, removed or changed; equal nulls are no change."""
    a, b = left.select(F.col(key).alias("k"), F.col(value).alias("a"), F.lit(1).alias("in_a")), right.select(F.col(key).alias("k2"), F.col(value).alias("b"), F.lit(1).alias("in_b"))
    rows = a.join(b, F.col("k") == F.col("k2"), "full")
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return rows.select(F.coalesce("k", "k2").alias(key), status.alias("status")).filter("status is not null")


def cleaned(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places; NaN and infinities become null, -0 becomes 0."""
    fix = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.round(c, 6) + 0.0)
    return df.select(*(fix(F.col(c)).alias(c) if t == "double" else c for c, t in df.dtypes))
