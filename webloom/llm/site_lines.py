"""Problem 6: lines repeated across one source's documents.

Method: each line's documents are stored as a compressed bitmap per source (see ``lines``);
the bitmaps of variant lines (case, spaces, digits) are united under one key, exact
cardinalities are compared with a threshold, and lines are deleted by looking their document up
in the surviving bitmaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.lines import exploded_lines, frequent_lines, has_doc, line_bitmaps, word_of


def repeated_lines(df: DataFrame, id_col: str = "site_id", source_col: str = "domain", text_col: str = "visible_text_preview", min_docs: int = 5) -> DataFrame:
    """``(doc_id, source, line_no, n_docs)``: lines that stand in at least ``min_docs`` documents of their source.

    Null, empty and blank texts, and rows without source or id, give no row.  A row delivered
    twice sets the same bit and counts once; a line twice in one document counts as one
    document, and both its places come out.  An empty table gives an empty result; other columns
    of the input, whatever their names, are not touched.
    """
    lines = exploded_lines(df, id_col, source_col, text_col).select("doc_id", "source", "line_no", "line_key")
    bitmaps = line_bitmaps(lines)
    frequent = frequent_lines(bitmaps, min_docs)
    # The words of frequent lines only; a rare line's words never reach the lookup.
    words = bitmaps.join(frequent, "line_key")
    placed = lines.withColumn("word", word_of(F.col("doc_id")))
    hit = placed.join(words, ["line_key", "word"]).where(has_doc(F.col("bits"), F.col("doc_id")))
    return hit.select("doc_id", "source", "line_no", "n_docs").dropDuplicates(["doc_id", "line_no"])


def without_repeated_lines(df: DataFrame, id_col: str = "site_id", source_col: str = "domain", text_col: str = "visible_text_preview", min_docs: int = 5) -> DataFrame:
    """``(doc_id, clean_text, n_removed)``: every document once, its repeated lines deleted.

    The remaining lines keep their order and spelling.  Documents without a source keep their text;
    NULL stays NULL.  Of rows that share an id one is kept, the greatest text first.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    docs = docs.groupBy("doc_id").agg(F.max("text").alias("text"))
    gone = repeated_lines(df, id_col, source_col, text_col, min_docs).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    both = docs.join(gone, "doc_id", "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("gone", i + 1))
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return both.select("doc_id", clean.alias("clean_text"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"))
