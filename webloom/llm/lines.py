"""Lines of documents and per-source document bitmaps of those lines.

A bitmap of document ids is kept as its non-zero 64-bit words, one row per
word: ``(line_key, word, bits)``.  Rare lines cost one row, frequent ones one row per 64
neighbouring ids, so the form is compressed in the way that sparse-word bitmaps are, and every
step (build, union, cardinality, lookup) is a code-generated JVM expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_line(line: Column) -> Column:
    """Outer spaces off, runs of spaces one, lower case, each run of digits 0-9 one ``0``."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), " +", " "), "[0-9]+", "0")


def source_name(source: Column) -> Column:
    """Lower-cased source; NULL where there is none."""
    return F.nullif(F.lower(F.trim(source)), F.lit(""))


def exploded_lines(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``(doc_id, source, line_no, line, line_key)``; lines that are empty once normalised are left out.

    ``line_key`` is a 64-bit hash of source and normalised line, so that the text itself is never
    shuffled.  Rows without a source, an id or a text give nothing.
    """
    base = df.select(F.col(id_col).alias("doc_id"), source_name(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    rows = base.where(F.col("source").isNotNull() & F.col("doc_id").isNotNull() & (F.col("text") != ""))
    rows = rows.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("_norm", normal_line(F.col("line"))).where(F.col("_norm") != "")
    return rows.select("doc_id", "source", (F.col("pos") + 1).alias("line_no"), "line", F.xxhash64("source", "_norm").alias("line_key"))


def word_of(doc_id: Column) -> Column:
    return F.shiftright(doc_id.cast("bigint"), 6)


def bit_of(doc_id: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), doc_id.cast("bigint").bitwiseAND(F.lit(63)).cast("int"))


def line_bitmaps(lines: DataFrame) -> DataFrame:
    """``(line_key, word, bits)`` of ``(line_key, doc_id)``: raw variants of a line are united by its key.

    Partial aggregation unites the words of each input split before the shuffle; a line that
    stands in a third of all documents is spread over its words, so no task gets it whole.
    """
    return lines.groupBy("line_key", word_of(F.col("doc_id")).alias("word")).agg(F.bit_or(bit_of(F.col("doc_id"))).alias("bits"))


def frequent_lines(bitmaps: DataFrame, min_docs: int) -> DataFrame:
    """``(line_key, n_docs)`` of the lines whose exact cardinality reaches ``min_docs``."""
    return bitmaps.groupBy("line_key").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def has_doc(bits: Column, doc_id: Column) -> Column:
    return bits.bitwiseAND(bit_of(doc_id)) != 0
