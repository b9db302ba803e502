"""Queries of the general operators for training data (problems 2 and 4) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.eager_join import compact_states, heavy_keys, joined_states
from webloom.operators.packed_fields import packed_values
from webloom.sources.tables import table

PACKED = {"internal_links": True, "meta_keywords": False}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    heavy = heavy_keys(table(spark, d, "sites"), F.lower("domain"), F.col("site_id"), 0.02)
    return heavy.select(F.col("key").alias("domain"))


def p2_domain_fetches(spark: SparkSession, d: str) -> DataFrame:
    """Every domain's joined pages and fetches: pairs, attempts and time summed over the pairs."""
    sites = compact_states(table(spark, d, "sites").select(F.nullif(F.lower("domain"), F.lit("")).alias("domain"), "site_id"), ["domain"], distinct=F.col("site_id"))
    # Repeated fetch_ids differ in logged_at only; one is kept by the keys that are used here.
    log = table(spark, d, "fetch_log").select(F.lower("host").alias("domain"), "fetch_id", "attempts", "timing").distinct()
    fetches = compact_states(log, ["domain"], sums={"attempts": F.col("attempts"), "timing": F.col("timing")})
    both = joined_states(sites, fetches, ["domain"], right_sums=["attempts", "timing"])
    return both.select("domain", F.col("n").alias("pairs"), F.col("n_left").alias("sites"), F.col("n_right").alias("fetches"), F.col("attempts").cast("bigint"), F.col("timing").cast("bigint"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return packed_values(table(spark, d, "sites"), PACKED).select(F.col("doc_id").alias("site_id"), "field", "pos", "item")


def p4_errors(spark: SparkSession, d: str) -> DataFrame:
    """Values by field and error flag."""
    values = packed_values(table(spark, d, "sites"), PACKED)
    return values.groupBy("field", "error").agg(F.count(F.lit(1)).alias("n_values"), F.max("pos").alias("longest"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_domain_fetches, p4_found, p4_errors)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """SELECT lower(domain) AS domain FROM sites WHERE coalesce(domain, '') <> '' GROUP BY 1
            HAVING count(DISTINCT site_id) >= 0.02 * (SELECT count(DISTINCT site_id) FROM sites)""",
        "p2_domain_fetches": """WITH s AS (SELECT DISTINCT site_id, lower(domain) AS domain FROM sites WHERE coalesce(domain, '') <> ''),
            f AS (SELECT DISTINCT fetch_id, lower(host) AS domain, attempts, timing FROM fetch_log)
            SELECT domain, count(*) AS pairs, count(DISTINCT site_id) AS sites, count(DISTINCT fetch_id) AS fetches, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(timing) AS BIGINT) AS timing
            FROM s JOIN f USING (domain) GROUP BY domain""",
    }
