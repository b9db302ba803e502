"""Running numbers and maxima over long orders, in two levels.

A window over one host, proxy or run would put all its rows into one task.  Rows are cut into buckets that keep the order; buckets
are summed up in a small table, over which the window of the whole order runs, and rows are finished within their bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALUES_PER_BUCKET = 256


def numbered(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], name: str = "rn") -> DataFrame:
    """``df`` with the 0-based number of each row among the rows of ``by``, ordered by ``bucket`` and then ``order``.

    ``bucket`` must not decrease along ``order``.  A global order has an empty ``by``.  Adds ``_bucket`` as well.
    """
    rows = df.withColumn("_bucket", bucket)
    keys = [*by, "_bucket"]
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    joined = _null_safe(local, sizes, keys)
    return joined.withColumn(name, F.col("_local") + F.col("_before")).drop("_local", "_before")


def running_max(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], name: str) -> DataFrame:
    """The maximum of ``value`` so far, over rows that ``numbered`` has given a ``_bucket``."""
    keys = [*by, "_bucket"]
    local = df.withColumn("_local", F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    tops = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, F.max("_top").over(before).alias("_before"))
    return _null_safe(local, tops, keys).withColumn(name, F.greatest("_local", "_before")).drop("_local", "_before")


def running_sum(df: DataFrame, by: Sequence[str], value: Column, order: Sequence[str], name: str) -> DataFrame:
    """The sum of ``value`` so far, over rows that ``numbered`` has given a ``_bucket``."""
    keys = [*by, "_bucket"]
    rows = df.withColumn("_value", value)
    local = rows.withColumn("_local", F.sum("_value").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = rows.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return _null_safe(local, sums, keys).withColumn(name, F.col("_local") + F.col("_before")).drop("_local", "_before", "_value")


def _null_safe(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    other = small.select(*[F.col(k).alias(f"_j_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & rows[k].eqNullSafe(other[f"_j_{k}"])
    return rows.join(other, condition).drop(*[f"_j_{k}" for k in keys])


def at_positions(values: DataFrame, value: str, positions: Column) -> DataFrame:
    """``(value, first, last)``: of each distinct value the 0-based places that it takes in ascending order.

    Equal values are counted before anything is ordered; the window of the whole order sees sums of ``VALUES_PER_BUCKET`` neighbouring values.  ``positions`` is a
    condition on ``first``, ``last`` and ``n``, the number of all values.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c")).withColumn("_bucket", F.floor(F.col(value) / VALUES_PER_BUCKET))
    placed = running_sum(counts, [], F.col("_c"), [value], "_up").crossJoin(F.broadcast(counts.agg(F.sum("_c").alias("n"))))  # one row
    placed = placed.select(value, (F.col("_up") - F.col("_c")).alias("first"), (F.col("_up") - 1).alias("last"), "n")
    return placed.where(positions)
