"""Problem 7: encoding of a corpus with a public byte-level BPE tokenizer.

Method: batched numpy merge rounds.  The distinct new pretokens of an Arrow batch lie as symbols in one
flat array; a round looks all adjacent pairs up by binary search over sorted pair keys, finds
each pretoken's lowest rank and merges all its occurrences at once, until no pretoken has a pair left.
Finished pretokens are remembered up to a bound.  Rows stay where they are: there is no shuffle.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# The published pattern that splits text before the merges (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = os.environ.get("WEBLOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
NO_RANK = np.int64(1 << 40)
REMEMBERED = 300_000


class Merges:
    """Pair table of a rank file: sorted keys ``left << 24 | right`` and the id each pair becomes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 24 | right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ids = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)

    def encode(self, words: Sequence[bytes]) -> list[list[int]]:
        """Ids of each word; empty words give an empty list."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_word, done_symbols = [], []
        while len(symbols) > 1:
            key = symbols[:-1] << 24 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ids[at], NO_RANK)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            # The last symbol of a word starts no pair.
            lowest = np.minimum.reduceat(np.append(rank, NO_RANK), starts)
            active = np.repeat(lowest < NO_RANK, sizes)
            if not active.all():
                done_word.append(word[~active])
                done_symbols.append(symbols[~active])
            if not active.any():
                symbols = symbols[:0]
                break
            merge = np.append(rank, NO_RANK) == np.repeat(lowest, sizes)
            merge &= active
            # Of overlapping occurrences, as in a run of equal symbols, every second one from the left.
            where = np.flatnonzero(merge)
            run = np.flatnonzero(np.append(True, np.diff(where) > 1))
            offset = np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))
            where = where[offset % 2 == 0]
            symbols[where] = rank[where]
            keep = active
            keep[where + 1] = False
            symbols, word = symbols[keep], word[keep]
        if len(symbols):
            done_word.append(word[: len(symbols)])
            done_symbols.append(symbols)
        if not done_word:
            return [[] for _ in words]
        word, symbols = np.concatenate(done_word), np.concatenate(done_symbols)
        order = np.argsort(word, kind="stable")
        bounds = np.searchsorted(word[order], np.arange(len(words) + 1))
        flat = symbols[order].tolist()
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@lru_cache(4)
def merges(path: str) -> Merges:
    return Merges(path)


class Encoder:
    def __init__(self, path: str):
        import regex

        self.merges, self.split, self.known = merges(path), regex.compile(PATTERN).findall, {}

    def encode_batch(self, texts: Sequence[str | None]) -> list[list[int]]:
        """Ids of each text; NULL and empty texts give an empty list.  Lone surrogates are read as U+FFFD."""
        pieces = [self.split(t) if t else [] for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({p for ps in pieces for p in ps if p not in known})
        for p, ids in zip(new, self.merges.encode([p.encode("utf-8", "replace") for p in new]), strict=True):
            known[p] = ids
        return [[i for p in ps for i in known[p]] for ps in pieces]


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(doc_id, ids)``: ids of every row's whole text without special tokens, whose strings are ordinary text.

    NULL and empty texts give an empty list.  Every row comes out, repeated rows repeatedly; an empty table gives
    none.  ``vocabulary`` is a rank file's path, the same on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            # Texts may be long: rows go out in slices, so that no slice's ids fill the memory.
            for part in _slices(batch):
                ids = encoder.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(df: DataFrame, keep: Sequence[str], text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` BIGINT, the number of ids of each row's text."""
    kept = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = kept.drop("_text").schema.add("n_tokens", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in _slices(batch):
                n = [len(x) for x in encoder.encode_batch(part.column(part.num_columns - 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64())], names=[*part.schema.names[:-1], "n_tokens"])

    return kept.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, characters: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > characters:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
