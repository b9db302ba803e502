"""Writers and readers of page rows: CSV, JSON, JSON lines, SQLite and Parquet.

Spark's commit protocol makes each write whole or absent.  Single files on the driver's disk (``write_csv_file``, JSON documents, SQLite) are made
row by row; ``mend_csv_file`` and ``salvaged_json_lines`` take what is whole of files that were left torn.
"""

from __future__ import annotations

import csv
import json
import os
import sqlite3
from collections.abc import Callable, Iterator
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.schema import COLUMNS, TYPED, WIRE, check_columns, to_typed, to_wire

# Format by suffix.
FORMATS = {".jsonl": "jsonl", ".ndjson": "jsonl", ".sqlite": "sqlite", ".sqlite3": "sqlite", ".db": "sqlite", ".json": "json", ".parquet": "parquet"}


def detect_format(path: str) -> str:
    return FORMATS.get(PurePath(path).suffix.lower(), "csv")


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV files with a header; quotes doubled, lines of a list within one quoted cell."""
    to_wire(check_columns(rows)).write.mode(mode).csv(path, header=True, escape='"', quote='"', lineSep="\n")


def write_csv_file(rows: DataFrame, path: str, append: bool = False) -> int:
    """One CSV file on the driver's disk with a byte order mark, a header and CRLF line ends; returns the rows.

    With ``append`` a last record that isn't whole is cut off first, and rows go behind the rest.
    """
    old = append and os.path.exists(path) and mend_csv_file(path) > 0
    n = 0
    with open(path, "a" if old else "w", encoding="utf-8" if old else "utf-8-sig", newline="") as f:
        out = csv.writer(f, lineterminator="\r\n")
        if not old:
            out.writerow(COLUMNS)
        for r in to_wire(check_columns(rows)).toLocalIterator(prefetchPartitions=True):
            out.writerow(r)
            n += 1
        f.flush()
        os.fsync(f.fileno())
    return n


def mend_csv_file(path: str) -> int:
    """Cut a CSV file behind its last whole record, one that ends outside quotes with a line end; returns the bytes that stay."""
    quoted, whole, at = False, 0, 0
    with open(path, "rb+") as f:
        while block := f.read(1 << 20):
            for part in block.splitlines(keepends=True):
                quoted ^= part.count(b'"') % 2 == 1  # a doubled quote counts twice
                at += len(part)
                if part.endswith(b"\n") and not quoted:
                    whole = at
        f.truncate(whole)
    return whole


def write_json_lines(rows: DataFrame, path: str, mode: str = "errorifexists", meta: dict | None = None) -> None:
    """A folder of JSON lines; with ``meta`` there is one more line, ``{"_meta": ...}``."""
    lines = check_columns(rows).select(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}).alias("value"))
    if meta is not None:
        lines = rows.sparkSession.createDataFrame([(json.dumps({"_meta": meta}, ensure_ascii=False),)], "value string").unionByName(lines)
    lines.write.mode(mode).text(path)


def write_json_document(rows: DataFrame, path: str, meta: dict | None = None) -> int:
    """One JSON document ``{"meta", "sites"}`` on the driver's disk, row by row through a temporary file; returns the rows."""
    temporary, n = path + ".tmp", 0
    with open(temporary, "w", encoding="utf-8") as f:
        f.write('{"meta": ' + json.dumps(meta or {}, ensure_ascii=False) + ', "sites": [')
        for r in check_columns(rows).select(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator(prefetchPartitions=True):
            f.write((",\n" if n else "\n") + r.j)
            n += 1
        f.write("\n]}\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)
    return n


def write_sqlite(rows: DataFrame, path: str, table: str = "sites") -> int:
    """Rows into a SQLite file on the driver's disk, replaced by address; one partition at a time passes through the driver."""
    names = ", ".join(f'"{c}"' for c in COLUMNS)
    db = sqlite3.connect(path)
    try:
        db.execute("PRAGMA journal_mode=WAL")
        db.execute(f'CREATE TABLE IF NOT EXISTS {table} ({", ".join(f"{chr(34)}{c}{chr(34)} TEXT" for c in COLUMNS)}, _scraped_at TEXT DEFAULT CURRENT_TIMESTAMP)')
        db.execute(f"CREATE UNIQUE INDEX IF NOT EXISTS {table}_url ON {table}(url)")
        n = 0
        with db:
            for r in to_wire(check_columns(rows)).toLocalIterator(prefetchPartitions=True):
                db.execute(f"INSERT OR REPLACE INTO {table} ({names}) VALUES ({', '.join('?' * len(COLUMNS))})", tuple(r))
                n += 1
        return n
    finally:
        db.close()


def write_parquet(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    check_columns(rows).write.mode(mode).parquet(path)


WRITERS: dict[str, Callable] = {"csv": write_csv, "jsonl": write_json_lines, "json": write_json_document, "sqlite": write_sqlite, "parquet": write_parquet}


def write(rows: DataFrame, path: str, format: str | None = None, **options) -> None:
    """Rows in ``format`` or that of the path's suffix; an unknown format raises ValueError."""
    name = format or detect_format(path)
    if name not in WRITERS:
        raise ValueError(f"unknown format: {name}")
    WRITERS[name](rows, path, **options)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of CSV files that ``write_csv`` made; rows of another width are dropped."""
    raw = spark.read.csv(path, schema=WIRE, header=True, multiLine=True, escape='"', quote='"', mode="DROPMALFORMED", enforceSchema=True)
    first = raw.columns[0]
    return to_typed(raw.withColumn(first, F.regexp_replace(F.col(first), "^﻿", "")))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of JSON lines; a ``_meta`` line and lines that can't be read are skipped."""
    return spark.read.json(path, schema=TYPED, mode="DROPMALFORMED").where(F.col("url").isNotNull())


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql.types import ArrayType, StructField, StructType

    document = spark.read.json(path, schema=StructType([StructField("sites", ArrayType(TYPED))]), multiLine=True)
    return document.select(F.inline("sites"))


def read_sqlite(spark: SparkSession, path: str, table: str = "sites", rows_per_task: int = 20_000) -> DataFrame:
    """Typed rows of a SQLite file, opened read-only by each task for its own range of row numbers; every executor must see ``path``."""
    import pyarrow as pa

    names = ", ".join(f'"{c}"' for c in COLUMNS)
    schema = pa.schema([(c, pa.string()) for c in COLUMNS])

    def opened() -> sqlite3.Connection:
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    db = opened()
    try:
        low, high = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {table}").fetchone()
    finally:
        db.close()

    def read_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = opened()
        try:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    start = low + k * rows_per_task
                    rows = db.execute(f"SELECT {names} FROM {table} WHERE rowid >= ? AND rowid < ?", (start, start + rows_per_task)).fetchall()
                    yield pa.RecordBatch.from_arrays([pa.array([None if r[i] is None else str(r[i]) for r in rows], pa.string()) for i in range(len(COLUMNS))], schema=schema)
        finally:
            db.close()

    tasks = max(1, -(-(high - low + 1) // rows_per_task))
    return to_typed(spark.range(0, tasks, 1, min(tasks, 200)).mapInArrow(read_range, WIRE))


def salvaged_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of every whole JSON object line in a torn file, also within an unfinished ``sites`` array."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), ",$", "").alias("line")).where(F.col("line").startswith("{"))
    return lines.select(F.from_json("line", TYPED).alias("r")).select("r.*").where(F.col("url").isNotNull())


def read(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    name = format or detect_format(path)
    readers = {"csv": read_csv, "jsonl": read_json_lines, "json": read_json_document, "sqlite": read_sqlite, "parquet": lambda s, p: s.read.parquet(p)}
    if name not in readers:
        raise ValueError(f"unknown format: {name}")
    return readers[name](spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def done_urls(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """``(url, fetch_status)`` of what a run has written, for ``fetchlog.pending``; empty where nothing is yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], "url string, fetch_status string")
    return read(spark, path, format).select("url", "fetch_status")


def rebuilt_json_document(spark: SparkSession, csv_path: str, json_path: str, meta: dict | None = None) -> int:
    """A JSON document of the rows of CSV files; returns the rows."""
    return write_json_document(read_csv(spark, csv_path), json_path, meta)


def whole_rows(spark: SparkSession, path: str) -> int:
    """The number of rows that can be read from JSON lines or a document, torn ones included."""
    return salvaged_json_lines(spark, path).count()


def reconciled(left: DataFrame, right: DataFrame, key: str = "url") -> DataFrame:
    """``(key, in_left, in_right)``: keys of two outputs that only one of them has, such as a CSV file and its JSON document."""
    a, b = (df.select(key).where(F.col(key).isNotNull()).distinct() for df in (left, right))
    both = a.withColumn("in_left", F.lit(True)).join(b.withColumn("in_right", F.lit(True)), key, "full")
    return both.where("in_left IS NULL OR in_right IS NULL").select(key, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))
