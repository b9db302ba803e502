"""Problem 4: several values packed in one field.

Method: a parsing expression grammar with ordered alternatives for quoted, bracketed and bare
values (``functions.packed``), which backtracks on malformed quotes and emits positions and error flags.
Rows of a field are parsed in Arrow batches where they lie; nothing is shuffled but the ids and values of
rows that may be delivered twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.packed import Packed

SCHEMA = "doc_id bigint, field string, pos int, item string, error string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("pos", pa.int32()), ("item", pa.string()), ("error", pa.string())])


def packed_values(df: DataFrame, fields: Mapping[str, bool], id_col: str = "site_id") -> DataFrame:
    """``(doc_id, field, pos, item, error)``: one row for each value of each of ``fields``.

    ``fields`` says of each column whether it holds links, which a lone space separates.  ``error`` is ``''``,
    ``bad_quote`` or ``bad_bracket``.  NULL, empty and blank fields give no row; empty values are skipped
    and take no position; a value that occurs twice comes out twice.  Rows with a NULL id are left out; of
    rows that share an id and a field's text one is taken.  An empty table gives an empty result.
    """
    parts = [df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.lit(name).alias("field"), F.col(name).cast("string").alias("packed")) for name in fields]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rows = rows.where(F.col("doc_id").isNotNull() & (F.trim("packed") != "")).distinct()
    links = dict(fields)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, field, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for v in Packed(text, links[field]).parse():
                    for column, x in zip(out, (doc, field, *v), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _ARROW.types, strict=True)], schema=_ARROW)

    return rows.mapInArrow(parse, SCHEMA)
