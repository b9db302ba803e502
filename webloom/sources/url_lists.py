"""Lists of addresses from text and delimited files, and the column of a table that holds addresses."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.urls import looks_like_url

# Header names of an address column, the first that is present wins (fixed values).
HEADER_NAMES = ["url", "website", "website url", "site", "site url", "link", "web", "domain", "homepage", "web address", "address", "company website"]
TEXT_SUFFIXES = {".txt", ".text", ".list", ""}


def url_lines(lines: DataFrame) -> DataFrame:
    """Rows whose ``line``, trimmed, is neither blank nor a ``#`` comment and looks like an address."""
    trimmed = lines.withColumn("line", F.trim("line"))
    return trimmed.where((F.col("line") != "") & ~F.col("line").startswith("#") & looks_like_url(F.col("line")))


def vote_for_url_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, hits, cells)``: how many cells of each column look like an address."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in columns])).alias("x"))
    return cells.groupBy("x.column").agg(F.count_if(looks_like_url(F.trim("x.cell"))).alias("hits"), F.count(F.lit(1)).alias("cells"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file with their byte order as ``seq``; a file of addresses is read in one piece, so its order is kept."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("seq", "line")).withColumn("line", F.regexp_replace("line", "^﻿", ""))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, url)`` in order, each address once: lines of a text file, or the address column of a CSV or TSV file.

    The column is that of a known header name, else the leftmost with most address-like cells if that's at least half of the rows,
    else each row's first address-like cell.  A first row that holds an address is data.
    """
    suffix = PurePath(path).suffix.lower()
    if suffix in TEXT_SUFFIXES:
        found = url_lines(_numbered(spark, path)).select("seq", F.col("line").alias("url"))
    else:
        raw = spark.read.csv(path, sep="\t" if suffix == ".tsv" else ",", multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, header=False)
        names = raw.columns
        # A list of addresses is small; its order is that of the file, which one reader keeps.
        rows = raw.coalesce(1).withColumn("seq", F.monotonically_increasing_id())
        head = rows.orderBy("seq").limit(1).collect()
        if not head:
            return spark.createDataFrame([], "seq bigint, url string")
        first = [(head[0][c] or "").strip().lstrip("﻿") for c in names]
        lower = [c.lower() for c in first]
        named = next((lower.index(h) for h in HEADER_NAMES if h in lower), None)
        is_data = rows.orderBy("seq").limit(1).select(*[looks_like_url(F.regexp_replace(F.col(c), "^﻿", "")).alias(c) for c in names]).collect()[0]
        data = rows if named is None and any(is_data) else rows.where(F.col("seq") > head[0]["seq"])
        column = names[named] if named is not None else None
        if column is None:
            votes = {r["column"]: r for r in vote_for_url_column(data, names).collect()}
            best = max(names, key=lambda c: (votes[c].hits if c in votes else 0, -names.index(c)))
            if best in votes and votes[best].hits >= max(1, votes[best].cells // 2):
                column = best
        cells = [F.trim(F.regexp_replace(F.col(c), "^﻿", "")) for c in names]
        value = F.trim(F.regexp_replace(F.col(column), "^﻿", "")) if column else F.get(F.filter(F.array(*cells), looks_like_url), F.lit(0))
        found = data.select("seq", value.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#") & looks_like_url(F.col("url")))
    return found.groupBy("url").agg(F.min("seq").alias("seq")).select(F.col("seq").cast("bigint"), "url").orderBy("seq")


def read_proxies(spark: SparkSession, path: str) -> DataFrame:
    """Proxies of a file, one a line; comments are dropped and a missing scheme is ``http://``."""
    lines = _numbered(spark, path).select("seq", F.trim(F.substring_index("line", "#", 1)).alias("p")).where("p <> ''")
    return lines.select("seq", F.when(F.contains("p", F.lit("://")), F.col("p")).otherwise(F.concat(F.lit("http://"), F.col("p"))).alias("proxy"))


def first_column(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, url)``: the first cell of each row of a delimited file in order, a header and blank cells left out."""
    rows = _numbered(spark, path).select("seq", F.trim(F.regexp_replace(F.substring_index("line", ",", 1), '^"|"$', "")).alias("url"))
    return rows.where((F.col("url") != "") & ~((F.col("seq") == 0) & F.lower("url").isin(HEADER_NAMES)))


def urls_of_stream(spark: SparkSession, stream: Iterable[str]) -> DataFrame:
    """``(seq, url)`` of lines that a program is given, such as ``sys.stdin``."""
    lines = spark.createDataFrame(list(enumerate(line.rstrip("\r\n") for line in stream)), "seq bigint, line string")
    return url_lines(lines).select("seq", F.col("line").alias("url"))
