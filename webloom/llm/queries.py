"""Queries of the text operators and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import bpe, mixing, mojibake, neardup, pii, residue, site_lines
from webloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "sites")).select(F.col("doc_id").alias("site_id"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sites").select("site_id", "domain", "page_title", "visible_text_preview").dropDuplicates(["site_id"])
    return residue.without_residue(rows)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "sites")).select(F.col("doc_id").alias("site_id"), "field")


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    found = mojibake.garbled(table(spark, d, "sites"))
    return found.select(F.col("doc_id").alias("site_id"), "field", "text", "restored", F.array_join("channels", ", ").alias("channels"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.similar_pairs(table(spark, d, "sites"))
    return pairs.select(F.col("id_a").alias("site_id_a"), F.col("id_b").alias("site_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of the pairs of ``p5_found``."""
    return neardup.similar_groups(table(spark, d, "sites"), size=3, threshold=0.5, min_words=30)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = site_lines.repeated_lines(table(spark, d, "sites"))
    return found.select(F.col("doc_id").alias("site_id"), "line_no")


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    clean = site_lines.without_repeated_lines(table(spark, d, "sites"))
    return clean.select(F.col("doc_id").alias("site_id"), F.coalesce("clean_text", F.lit("")).alias("clean_text"), "n_removed")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    sized = mixing.sized_documents(table(spark, d, "documents"))
    return mixing.Mixture(sized, table(spark, d, "mix_targets")).sequence()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = mixing.sized_documents(table(spark, d, "documents"))
    return mixing.Mixture(sized, table(spark, d, "mix_targets")).shares()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_spans(table(spark, d, "documents")).select("doc_id", "kind", "start_pos")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_clean, p3_found, p3_restored, p5_found, p5_groups, p6_found, p6_clean, p7_ids, p8_mix, p8_shares, p9_found, p9_redacted)}


_LINES = """
WITH docs AS (SELECT site_id, max(coalesce(visible_text_preview, '')) AS v, max(lower(trim(coalesce(domain, '')))) AS d FROM sites GROUP BY site_id),
pieces AS (SELECT site_id, d, unnest(string_split(v, chr(10))) AS line, unnest(range(1, len(string_split(v, chr(10))) + 1)) AS line_no FROM docs),
keyed AS (SELECT site_id, d, line, line_no, regexp_replace(regexp_replace(lower(trim(line)), ' +', ' ', 'g'), '[0-9]+', '0', 'g') AS k FROM pieces),
frequent AS (SELECT d, k FROM keyed WHERE d <> '' AND k <> '' GROUP BY d, k HAVING count(DISTINCT site_id) >= 5)
"""

_PAIRS = r"""
WITH RECURSIVE docs AS (SELECT DISTINCT site_id, regexp_extract_all(lower(coalesce(page_title, '') || chr(10) || coalesce(meta_description, '') || chr(10) || coalesce(visible_text_preview, '')), '[\p{L}\p{N}]+') AS w,
    len(regexp_extract_all(lower(coalesce(visible_text_preview, '')), '[\p{L}\p{N}]+')) AS n FROM sites),
sh AS (SELECT DISTINCT site_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT site_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE n >= 30)),
sizes AS (SELECT site_id, count(*) AS c FROM sh GROUP BY site_id),
common AS (SELECT a.site_id AS a, b.site_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.site_id < b.site_id GROUP BY 1, 2),
pairs AS (SELECT a AS site_id_a, b AS site_id_b FROM common JOIN sizes x ON x.site_id = a JOIN sizes y ON y.site_id = b WHERE 2 * k >= x.c + y.c - k)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _LINES + "SELECT site_id, CAST(line_no AS INTEGER) AS line_no FROM keyed JOIN frequent USING (d, k)",
        "p6_clean": _LINES
        + """, marked AS (SELECT q.site_id, q.line, q.line_no, f.k IS NOT NULL AS gone FROM keyed q LEFT JOIN frequent f ON q.d = f.d AND q.k = f.k)
        SELECT site_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS clean_text, count(*) FILTER (gone) AS n_removed FROM marked GROUP BY site_id""",
        "p5_found": _PAIRS + "SELECT * FROM pairs",
        "p5_groups": _PAIRS
        + r""", texts AS (SELECT DISTINCT site_id, coalesce(page_title, '') AS t, coalesce(meta_description, '') AS m, coalesce(visible_text_preview, '') AS v FROM sites),
same AS (SELECT site_id AS a, min(site_id) OVER (PARTITION BY t, m, v) AS b FROM texts WHERE t || m || v <> ''),
edges AS (SELECT site_id_a AS a, site_id_b AS b FROM pairs UNION SELECT site_id_b, site_id_a FROM pairs UNION SELECT a, b FROM same UNION SELECT b, a FROM same),
reach(a, b) AS (SELECT site_id, site_id FROM texts UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
sets AS (SELECT site_id, string_agg(s, '|' ORDER BY s) AS shingles FROM sh GROUP BY site_id),
classes AS (SELECT site_id, min(site_id) OVER (PARTITION BY shingles) AS class FROM sets),
linked AS (SELECT x.site_id, y.class FROM edges e JOIN classes x ON x.site_id = e.a JOIN classes y ON y.site_id = e.b WHERE x.class <> y.class),
links AS (SELECT site_id, count(DISTINCT class) AS n_links FROM linked GROUP BY site_id)
SELECT a AS doc_id, min(b) AS group_id, CAST(coalesce(max(n_links), 0) AS BIGINT) AS n_links FROM reach LEFT JOIN links ON site_id = a GROUP BY a""",
    }
