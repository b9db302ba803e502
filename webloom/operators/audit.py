"""Checks of typed page rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.schema import COLUMNS, COUNTED, LISTS


def schema_faults(columns: list[str]) -> list[str]:
    """What is wrong with a header; nothing if it's the 90 columns in order."""
    faults = [f"missing: {c}" for c in COLUMNS if c not in columns] + [f"unknown: {c}" for c in columns if c not in COLUMNS] + [f"twice: {c}" for c in sorted(set(columns)) if columns.count(c) > 1]
    return faults or ([] if columns == COLUMNS else ["order differs"])


def violations(rows: DataFrame, key: str = "url") -> DataFrame:
    """``(key, check, column)``: each list that isn't sorted and distinct and each count that isn't its list's length."""
    checks = [F.when(F.col(c).isNotNull() & (F.col(c) != F.array_sort(F.array_distinct(c))), F.struct(F.lit("sorted_distinct").alias("check"), F.lit(c).alias("column"))) for c in LISTS]
    checks += [F.when(F.col(n).isNotNull() & (F.col(n) != F.size(c)), F.struct(F.lit("count").alias("check"), F.lit(n).alias("column"))) for n, c in COUNTED.items()]
    found = rows.select(F.col(key), F.explode(F.array_compact(F.array(*checks))).alias("v"))
    return found.select(key, "v.check", "v.column")


def audit_histogram(rows: DataFrame) -> DataFrame:
    """Rows by fetch status, most first."""
    return rows.groupBy("fetch_status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "fetch_status")


def width_faults(rows: DataFrame) -> DataFrame:
    """``(row_columns, n)`` of wire rows as arrays of cells in ``cells``: how many rows have another number of cells than there are columns, or a NULL cell (-1)."""
    width = F.when(F.exists("cells", lambda c: c.isNull()), F.lit(-1)).otherwise(F.size("cells"))
    return rows.groupBy(width.alias("row_columns")).agg(F.count(F.lit(1)).alias("n")).where(F.col("row_columns") != len(COLUMNS))
