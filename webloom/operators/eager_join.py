"""Problem 2: per-key results where a few keys hold most rows.

Method: eager aggregation through joins.  Both inputs are aggregated by the join key before the
join, so the join sees at most one compact state a key and side; counts of joined rows are the
product of the sides' counts, sums over one side are multiplied by the other side's count, and the
result is rolled up to any coarser grouping.  Sums and counts of a heavy key are
reduced within each input split before they're shuffled; only where distinct values are counted do its rows go in a shuffle
on key and value, which spreads them over all tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact_states(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column] | None = None, distinct: Column | None = None) -> DataFrame:
    """One row a key: ``n`` rows and the ``sums``; rows whose key holds a NULL are left out, as no join finds them.

    With ``distinct`` each (key, distinct) counts once; the duplicates go in a shuffle on both, which
    spreads a heavy key over all tasks.  ``distinct`` takes no sums.
    """
    sums = dict(sums or {})
    if distinct is not None:
        if sums:
            raise ValueError("distinct states take no sums")
        df = df.select(*keys, distinct.alias("_distinct")).distinct()
    df = df.dropna(subset=list(keys))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])


def joined_states(left: DataFrame, right: DataFrame, keys: Sequence[str], left_sums: Sequence[str] = (), right_sums: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """States of the join of two inputs, from the states of each: ``keys``, ``n``, ``n_left``, ``n_right`` and the sums.

    ``n`` is the number of joined rows.  A sum keeps its name and is what SQL would sum over the
    joined rows, NULL if it has no value.  ``left`` and ``right`` may also be grouped by more
    columns than ``keys``; those come along for a roll-up.  With ``how='left'`` a left
    state without partner counts its rows once, as an outer join does.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how: {how}")
    a = left.withColumnRenamed("n", "n_left")
    b = right.withColumnRenamed("n", "n_right")
    j = a.join(b, list(keys), how)
    times_left = F.coalesce(F.col("n_right"), F.lit(1)) if how == "left" else F.col("n_right")
    j = j.withColumns({s: F.col(s) * times_left for s in left_sums} | {s: F.col(s) * F.col("n_left") for s in right_sums})
    return j.withColumn("n", F.col("n_left") * times_left)


def rolled_up(states: DataFrame, by: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """States by a coarser grouping; an empty ``by`` gives one row for everything."""
    return states.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])


def heavy_keys(df: DataFrame, key: Column, distinct: Column, min_share: float) -> DataFrame:
    """``(key, n, total)``: keys that hold at least ``min_share`` of all distinct ``distinct`` values.

    The states are joined with their own roll-up, one row, on a constant.  Values of which ``key`` is NULL or empty
    count in the total only; a NULL ``distinct`` counts nowhere.  An empty table gives an empty result.
    """
    rows = df.select(F.coalesce(key, F.lit("")).alias("key"), distinct.alias("value")).where(F.col("value").isNotNull())
    states = compact_states(rows, ["key"], distinct=F.col("value")).withColumn("all", F.lit(1))
    total = rolled_up(states, ["all"]).withColumnRenamed("n", "total")
    joined = joined_states(states, total.withColumn("n", F.lit(1).cast("bigint")), ["all"])
    # Whole numbers on both sides: a key exactly at the share belongs to the result.
    return joined.where((F.col("key") != "") & (F.col("n") >= F.lit(min_share).cast("decimal(9,6)") * F.col("total"))).select("key", "n", "total")
