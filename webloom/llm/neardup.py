"""Problem 5: near-duplicate records.

Similarity is the Jaccard coefficient of the sets of word shingles.  A record's fingerprint is its set of shingles, 48 bits of
hash each.  The fingerprint is embedded as counts of set bits per segment of the hash range; the Manhattan distance of two
embeddings never exceeds the number of shingles that only one record has, so a pair beyond the allowed difference is dropped
without its sets, and the rest is verified on the exact sets.

A grid over the embedding alone can't find the pairs: at a similarity of 0.5 the allowed distance is a third of both
records' sizes, as wide as the spread of the embedding's coordinates, so that any grid of few dimensions joins nearly every
cell with every other (the README has the measured shares).  So the grid's first coordinate is a rare shingle, and its second
the record's size, range-joined under the same bound.  With shingles ordered from rare to frequent, two records of similarity ``t`` share
``c`` of the first ``n - ceil(t n) + c`` of each (prefix filtering), or all that they share if that is fewer, which loses no pair;
beyond it the place in the order bounds the overlap.  Unlike records often share one such shingle by chance, seldom ``COMMON``, so
pairs are counted as they are united and few of them go on.

How rare a shingle is comes from a sketch of counters, of a fixed size whatever the corpus.  Any order that all records
share is right; the sketch only makes it a good one.

Records of equal sets form one class and are compared once.  A class is known by the 64-bit hash of its set; pairs are verified on
the sets themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.sketch import counted
from webloom.operators.sized import checkpointed, shuffle_partitions

WORD = re.compile(r"[^\W_]+")
SEGMENTS = 64  # four bits a segment; a count above 15 stays 15, which keeps the bound
SKETCH_BITS = 24  # logarithm of the sketch's counters: 16 MB once they are levels, sent to every executor
LONG_RUN = 20_000  # records that share a shingle within their prefixes and are compared in one task; longer runs are joined in salted cells
MARK_BITS = 24  # logarithm of the bits that mark classes whose sets are needed: 2 MB, sent to every executor, whatever their number
COMMON = 3  # shingles that a pair of records shares within their prefixes, if the threshold asks for as many
REMEMBERED = 500_000  # words, or classes, that a task remembers before it forgets them all
# A shingle travels as one long: 40 bits of hash, which order and join shingles (two that fall together only add a
# candidate), and 18 bits of its record's size.  A record beyond that size has its whole set as prefix.
SIZE_BITS, LARGEST = 18, (1 << 18) - 1
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Words:
    """64-bit hashes of words, the same in every process; remembered up to a bound."""

    def __init__(self) -> None:
        import xxhash

        self.digest, self.known = xxhash.xxh3_64_intdigest, {}

    def __call__(self, words: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = self.digest(w)
            out.append(h)
        return out


def shingle_sets(texts: Sequence[Sequence[str | None]], size: int, min_words: int, hasher: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 48-bit hashes of the distinct shingles of rows whose last text has ``min_words`` words, sorted by both."""
    rows, starts, flat = [], [0], []
    for i, parts in enumerate(texts):
        last = WORD.findall((parts[-1] or "").lower())
        if len(last) < min_words:
            continue
        words = [w for p in parts[:-1] if p for w in WORD.findall(p.lower())] + last
        if len(words) >= size:
            rows.append(i)
            flat += hasher(words)
            starts.append(len(flat))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.array(flat, dtype=np.uint64)
    of = np.repeat(np.array(rows, dtype=np.int64), np.diff(starts))
    k = len(h) - size + 1
    with np.errstate(over="ignore"):
        s = np.zeros(k, dtype=np.uint64)
        for j in range(size):
            s = _mixed(s * _MULTIPLIERS[0] + h[j : j + k] + _MULTIPLIERS[1 + j % 7])
    inside = of[:k] == of[size - 1 :]
    of, s = of[:k][inside], s[inside] >> np.uint64(16)
    sets, at = [], 0
    while at < len(of):  # a row number of 16 bits and a shingle sort as one number
        base = int(of[at])
        end = int(np.searchsorted(of, base + 65536))
        sets.append((base, np.unique(of[at:end].astype(np.uint64) - np.uint64(base) << np.uint64(48) | s[at:end])))
        at = end
    return np.concatenate([(v >> np.uint64(48)).astype(np.int64) + b for b, v in sets]), np.concatenate([v & np.uint64((1 << 48) - 1) for _, v in sets])


def _blobs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """48-bit values as one binary a row."""
    data = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 6).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _values(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of values and the values of what ``_blobs`` made."""
    sizes = np.array([len(b) // 6 for b in blobs], dtype=np.int64)
    wide = np.zeros((int(sizes.sum()), 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    return sizes, wide.view("<u8").ravel().astype(np.uint64)


def _fingerprints(size: int, min_words: int):
    """``(id, k, shingles)``: the class and the set of each record; of one that isn't compared the class of its text and no set,
    and of an empty one no class either."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Words()
        for batch in batches:
            texts = list(zip(*(batch.column(i).to_pylist() for i in range(1, batch.num_columns)), strict=True))
            of, s = shingle_sets(texts, size, min_words, hasher)
            offsets = np.searchsorted(of, np.arange(len(texts) + 1))
            blobs = _blobs(s, offsets)
            keys = [xxhash.xxh3_64_intdigest(b) if len(b) else xxhash.xxh3_64_intdigest("\0".join(t), 1) if any(t) else None for b, t in zip(blobs.to_pylist(), texts, strict=True)]
            signed = pa.array([k if k is None or k < 1 << 63 else k - (1 << 64) for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), signed, blobs], names=["id", "k", "shingles"])

    return run


def _count_shingles(batches: Iterator[pa.RecordBatch], counters: np.ndarray) -> None:
    for batch in batches:
        _, s = _values(batch.column(0).to_pylist())
        np.add.at(counters, s >> np.uint64(48 - SKETCH_BITS), 1)


def _prefixes(threshold: Fraction, levels):
    """``(x, k, place)`` of ``(k, shingles)``: the shingles within the record's prefix that occur elsewhere, with their place in it."""

    def chosen(k: np.ndarray, sizes: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        level = levels.value[s >> np.uint64(48 - SKETCH_BITS)].astype(np.uint64)
        row = np.repeat(np.arange(len(k), dtype=np.uint64), sizes)
        order = np.sort(row << np.uint64(54) | level << np.uint64(48) | s)
        short = order >> np.uint64(8)
        again = np.append(False, short[1:] == short[:-1])[: len(short)]  # its set's shingle before has the same 40 bits, and they would count as one
        own = np.repeat(np.arange(len(k)), sizes)
        rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        n = np.minimum(sizes, LARGEST)
        take = np.where(n == LARGEST, sizes, sizes - -(-sizes * threshold.numerator // threshold.denominator) + COMMON)
        elsewhere = (order >> np.uint64(48) & np.uint64(63)) > 0  # a counter of one is this record's own
        keep = (rank < take[own]) & elsewhere
        own, place = own[keep], np.where(n[own] == LARGEST, 0, rank)[keep].astype(np.int32)
        x = ((short & np.uint64((1 << 40) - 1)).astype(np.int64) ^ again)[keep] << SIZE_BITS | n[own]
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(k[own]), pa.array(place)], names=["x", "k", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = []
            for i, key in enumerate(keys):  # copies within the task; those of other tasks go when a shingle's records meet
                if key not in seen:
                    seen.add(key)
                    at.append(i)
            if len(seen) > REMEMBERED:
                seen.clear()
            for i in range(0, len(at), 1024):  # ten bits of a sorted number are the row
                mine = at[i : i + 1024]
                sizes, s = _values([blobs[j] for j in mine])
                yield chosen(np.array([keys[j] for j in mine], dtype=np.int64), sizes, s)

    return run


def _pairs(threshold: Fraction):
    """Candidate pairs among ``(x, k, place)`` sorted by ``x`` and ``k``, hence by shingle and, within it, by the record's size: a range
    join over sizes.  ``weight`` comes to ``COMMON`` over the shingles that a similar pair shares.  Runs longer than ``LONG_RUN`` come
    out as they are, with their ``x``; a pair that shares one of those needs no others."""
    up, over = threshold.numerator, threshold.denominator
    names = ["k_s", "k_l", "x", "place", "weight"]

    def nothing(n: int) -> pa.Array:
        return pa.nulls(n, pa.int64())

    def marked(ids: np.ndarray, x: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), nothing(len(ids)), pa.array(x), pa.array(place.astype(np.int64)), nothing(len(ids))], names=names)

    def paired(x: np.ndarray, ids: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, n = x >> SIZE_BITS, x & LARGEST
        bounds = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        lengths = np.diff(np.append(bounds, len(h)))
        long = np.repeat(lengths > LONG_RUN, lengths)
        if long.any():
            yield marked(ids[long], x[long], place[long])
        ends = np.repeat(bounds + lengths, lengths)
        at, step, found = np.flatnonzero(~long), 1, []
        while len(at := at[at + step < ends[at]]):
            other = at + step
            # Sizes ascend within a run: beyond the first that is too large there is none that fits.
            near = (n[at] * over >= n[other] * up) | (n[other] == LARGEST)
            at, other = at[near], other[near]
            left = np.minimum(n[at] - place[at], n[other] - place[other]) + COMMON - 1
            whole, total = n[other] == LARGEST, (n[at] + n[other]) * up
            fits = ((left * (over + up) >= total) | whole) & (ids[at] != ids[other])
            a, b = ids[at[fits]], ids[other[fits]]
            shared = np.where(whole, 1, np.minimum(-(-total // (over + up)), COMMON))[fits]  # at least
            found.append((np.minimum(a, b), np.maximum(a, b), -(-COMMON // shared)))
            step += 1
            if sum(len(f[0]) for f in found) > 100_000:
                yield from together(found)
                found = []
        yield from together(found)

    def together(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if found:
            a, b, weight = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(a):
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), nothing(len(new)), nothing(len(new)), pa.array(np.add.reduceat(weight[order], new))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        for batch in batches:
            cols = [np.concatenate([a, b.to_numpy(zero_copy_only=False)]) for a, b in zip(held, batch.columns, strict=True)]
            if not len(cols[0]):
                continue
            new = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))  # copies
            cols = [c[new] for c in cols]
            cut = int(np.searchsorted(cols[0], cols[0][-1] >> SIZE_BITS << SIZE_BITS))
            if len(cols[0]) - cut > LONG_RUN + 1:  # the last run is long already; what has come of it goes out, but for what marks it
                part = [c[cut : len(cols[0]) - LONG_RUN - 1] for c in cols]
                if cut:
                    yield from paired(*(c[:cut] for c in cols))
                yield marked(part[1], part[0], part[2])
                cut = len(cols[0]) - LONG_RUN - 1
            elif cut:
                yield from paired(*(c[:cut] for c in cols))
            held = [c[cut:] for c in cols]
        if len(held[0]):
            yield from paired(*held)

    return run


def _embedded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(k, n, segments)`` of ``(k, shingles)``."""
    for batch in batches:
        sizes, s = _values(batch.column(1).to_pylist())
        rows = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.bincount(rows * SEGMENTS + (s % np.uint64(SEGMENTS)).astype(np.int64), minlength=len(sizes) * SEGMENTS)
        nibbles = np.minimum(counts, 15).astype(np.uint8).reshape(-1, 2)
        packed = nibbles[:, 0] << 4 | nibbles[:, 1]
        segments = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SEGMENTS // 2), len(sizes), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), segments], names=["k", "n", "segments"])


def _close(threshold: Fraction):
    """Of candidate pairs those whose embeddings are near enough: |A xor B| <= (1 - t) / (1 + t) (|A| + |B|) at
    similarity t, and the Manhattan distance is at most |A xor B|."""
    up, down = threshold.denominator + threshold.numerator, threshold.denominator - threshold.numerator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SEGMENTS // 2) for c in ("seg_s", "seg_l"))
            a, b = (np.concatenate([v >> 4, v & 15], axis=1).astype(np.int16) for v in (a, b))
            total = batch.column("n_s").to_numpy(zero_copy_only=False).astype(np.int64) + batch.column("n_l").to_numpy(zero_copy_only=False)
            keep = pa.array(np.abs(a - b).sum(axis=1, dtype=np.int64) * up <= total * down)
            yield batch.select(["k_s", "k_l"]).filter(keep)

    return run


def _cells(k: pa.Array) -> np.ndarray:
    return k.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - MARK_BITS)


def _count_classes(batches: Iterator[pa.RecordBatch], counters: np.ndarray) -> None:
    for batch in batches:
        counters[_cells(batch.column(0))] = 1


def _marked(marks):
    """The rows whose class, in the first column, is marked, and by chance some others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _cells(batch.column(0))
            yield batch.filter(pa.array(marks.value[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8) & 1 == 1))

    return run


def _verified(threshold: Fraction):
    """Of pairs with their sets those that are similar, with the numbers of shingles that both and that either has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [len(np.intersect1d(_values([a])[1], _values([b])[1], assume_unique=True)) for a, b in zip(batch.column("s").to_pylist(), batch.column("l").to_pylist(), strict=True)]
            shared = np.array(both, dtype=np.int64)
            either = np.array([(len(a) + len(b)) // 6 for a, b in zip(batch.column("s").to_pylist(), batch.column("l").to_pylist(), strict=True)], dtype=np.int64) - shared
            keep = pa.array(shared * threshold.denominator >= either * threshold.numerator)
            yield pa.RecordBatch.from_arrays([batch.column("k_s"), batch.column("k_l"), pa.array(shared), pa.array(either)], names=["k_a", "k_b", "shared", "either"]).filter(keep)

    return run


class Similar:
    """Pairs of similar records and their classes; build it once, as it checkpoints the fingerprints."""

    def __init__(self, df: DataFrame, id_col: str, text_cols: Sequence[str], size: int = 5, threshold: float = 0.8, min_words: int = 1):
        self.t = Fraction(str(threshold))
        texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"t{i}") for i, c in enumerate(text_cols)]
        docs = df.select(F.col(id_col).cast("bigint").alias("id"), *texts).where(F.col("id").isNotNull())
        self.prints = checkpointed(docs.mapInArrow(_fingerprints(size, min_words), "id bigint, k bigint, shingles binary"))
        self.compared = self.prints.where(F.octet_length("shingles") > 0)

    def classes(self) -> DataFrame:
        """``(id, class_id)``: each record once, with the least id of its class; a record without words is a class of its own."""
        # Rows delivered twice are united first, then the ids of a class within each input split.
        rows = self.prints.select("id", "k").distinct()
        least = rows.where("k IS NOT NULL").groupBy("k").agg(F.min("id").alias("class_id"))
        return rows.join(least, "k", "left").groupBy("id").agg(F.coalesce(F.min("class_id"), F.col("id")).alias("class_id"))

    def _levels(self):
        """The sketch, sent to the executors: ``2 ** SKETCH_BITS`` bytes for a corpus of any size."""
        levels = counted(self.compared.select("shingles"), _count_shingles, 1 << SKETCH_BITS)
        return self.prints.sparkSession.sparkContext.broadcast(levels)

    def pairs(self) -> DataFrame:
        """``(k_a, k_b, shared, either)``: pairs of classes, each once."""
        t, parts = self.t, shuffle_partitions(self.prints.sparkSession)
        sets = self.compared.select("k", "shingles")
        postings = sets.mapInArrow(_prefixes(t, self._levels()), "x bigint, k bigint, place int")
        by_shingle = postings.repartition(parts, F.shiftright("x", SIZE_BITS)).sortWithinPartitions("x", "k")
        found = by_shingle.mapInArrow(_pairs(t), "k_s bigint, k_l bigint, x bigint, place bigint, weight bigint").groupBy("k_s", "k_l", "x", "place").agg(F.sum("weight").alias("weight"))
        found = checkpointed(found.where((F.col("weight") >= COMMON) | F.col("x").isNotNull()))
        near, long = found.where("x IS NULL").select("k_s", "k_l"), found.where("x IS NOT NULL")
        near = near.unionByName(self._pairs_of_long_runs(long)).distinct() if long.limit(1).count() else near
        embedded = sets.mapInArrow(_embedded, "k bigint, n int, segments binary")
        both = near.join(embedded.select(F.col("k").alias("k_s"), F.col("n").alias("n_s"), F.col("segments").alias("seg_s")).distinct(), "k_s")
        both = both.join(embedded.select(F.col("k").alias("k_l"), F.col("n").alias("n_l"), F.col("segments").alias("seg_l")).distinct(), "k_l")
        maybe = checkpointed(both.select("k_s", "k_l", "n_s", "n_l", "seg_s", "seg_l").mapInArrow(_close(t), "k_s bigint, k_l bigint"))
        ids = maybe.select(F.explode(F.array("k_s", "k_l")).alias("k"))
        marks = counted(ids, _count_classes, 1 << MARK_BITS, lambda counts: np.packbits(counts > 0))
        needed = sets.mapInArrow(_marked(self.prints.sparkSession.sparkContext.broadcast(marks)), "k bigint, shingles binary").distinct()
        exact = maybe.join(needed.select(F.col("k").alias("k_s"), F.col("shingles").alias("s")), "k_s").join(needed.select(F.col("k").alias("k_l"), F.col("shingles").alias("l")), "k_l")
        return exact.mapInArrow(_verified(t), "k_a bigint, k_b bigint, shared bigint, either bigint")

    def _pairs_of_long_runs(self, rows: DataFrame) -> DataFrame:
        """Candidate pairs of shingles that very many records have in their prefix: a join of grid cells over the embedding's
        total, each cell cut into salted blocks that meet each other in different tasks."""
        t, blocks = self.t, 16
        h, n = F.shiftright("x", SIZE_BITS), F.col("x").bitwiseAND(F.lit(LARGEST))
        # Cells grow by 1/t, so a larger partner's size is in the same cell or the next.
        cell = F.floor(F.log(n.cast("double")) / F.log(F.lit(float(1 / t))) + 1e-9).cast("int")
        block = F.pmod(F.xxhash64("k_s"), F.lit(blocks)).cast("int")
        small = rows.select(h.alias("h"), cell.alias("cell"), block.alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("theirs"), F.col("k_s").alias("a"), n.alias("n_s"), F.col("place").alias("at_s"))
        large = rows.select(h.alias("h"), F.explode(F.array(cell, cell - 1)).alias("cell"), block.alias("theirs"), F.col("k_s").alias("b"), n.alias("n_l"), F.col("place").alias("at_l"))
        large = large.withColumn("mine", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        whole = F.col("n_l") == LARGEST
        fits = (F.col("n_l") >= F.col("n_s")) & ((F.col("n_s") * t.denominator >= F.col("n_l") * t.numerator) | whole) & ((F.col("n_s") < F.col("n_l")) | (F.col("a") < F.col("b")))
        left = F.least(F.col("n_s") - F.col("at_s"), F.col("n_l") - F.col("at_l")) + (COMMON - 1)
        fits = fits & ((left * (t.denominator + t.numerator) >= (F.col("n_s") + F.col("n_l")) * t.numerator) | whole)
        pairs = small.join(large, ["h", "cell", "mine", "theirs"]).where(fits & (F.col("a") != F.col("b")))
        return pairs.select(F.least("a", "b").alias("k_s"), F.greatest("a", "b").alias("k_l")).distinct()

    def class_pairs(self) -> DataFrame:
        """``(id_a, id_b, shared, either)``: pairs of classes by their least ids, which with ``classes`` say everything."""
        least = self.compared.groupBy("k").agg(F.min("id").alias("id"))
        pairs = self.pairs().join(least.withColumnsRenamed({"k": "k_a", "id": "x"}), "k_a").join(least.withColumnsRenamed({"k": "k_b", "id": "y"}), "k_b")
        return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "shared", "either")

    def expanded(self) -> DataFrame:
        """``(id_a, id_b)`` of records: the pairs of classes with all their members, and the pairs of members."""
        members = checkpointed(self.compared.select("k", "id").distinct())
        left, right = members.withColumnsRenamed({"k": "k_a", "id": "x"}), members.withColumnsRenamed({"k": "k_b", "id": "y"})
        across = self.pairs().select("k_a", "k_b").join(left, "k_a").join(right, "k_b").select("x", "y")
        twice = members.groupBy("k").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("k")
        copies = members.join(twice, "k")
        within = copies.select("k", F.col("id").alias("x")).join(copies.select("k", F.col("id").alias("y")), "k").where("x < y").select("x", "y")
        every = across.unionByName(within)
        return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


TEXT_COLS = ("page_title", "meta_description", "visible_text_preview")


def similar_pairs(df: DataFrame, id_col: str = "site_id", text_cols: Sequence[str] = TEXT_COLS, size: int = 3, threshold: float = 0.5, min_words: int = 30) -> DataFrame:
    """``(id_a, id_b)``, a < b: every pair of records whose similarity reaches ``threshold``, copies included.

    Words are the longest runs of letters and digits in the lower-cased texts, shingles ``size`` adjacent ones; only
    records with ``min_words`` words in the last of ``text_cols`` are compared.  NULL texts count as ``''``; empty texts
    are similar to nothing; rows delivered twice count once; texts of any length are taken whole; an empty table gives no pair.
    Copies of one text make as many pairs as the result's definition asks for; ``Similar.class_pairs`` with ``Similar.classes``
    say the same in one row a record and one a pair of different texts.
    """
    return Similar(df, id_col, text_cols, size, threshold, min_words).expanded()


def similar_groups(df: DataFrame, id_col: str = "site_id", text_cols: Sequence[str] = TEXT_COLS, size: int = 5, threshold: float = 0.8, min_words: int = 1, max_rounds: int = 60) -> DataFrame:
    """``(doc_id, group_id, n_links)``: one row a record, its group the least id that links reach.

    Groups are the connected components of the pairs of classes, found by label propagation with
    pointer jumping, a checkpoint a round; a copy has its class's group.  ``n_links`` counts links to other classes.  Equal texts
    that are too short to be compared are one group; an empty text is a group of its own.
    """
    found = Similar(df, id_col, text_cols, size, threshold, min_words)
    pairs = checkpointed(found.class_pairs().select("id_a", "id_b"))
    edges = pairs.unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    labels = checkpointed(edges.groupBy("id_a").agg(F.least(F.min("id_b"), F.first("id_a")).alias("label")).withColumnRenamed("id_a", "id"))
    for _ in range(max_rounds):
        offered = edges.join(labels.select(F.col("id").alias("id_b"), "label"), "id_b").groupBy("id_a").agg(F.min("label").alias("offer"))
        jumped = labels.join(labels.select(F.col("id").alias("label"), F.col("label").alias("root")), "label")
        new = jumped.join(offered, jumped["id"] == offered["id_a"]).select("id", F.col("label").alias("old"), F.least("root", "offer").alias("label"))
        new = checkpointed(new)
        changed = new.where(F.col("old") != F.col("label")).limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    links = edges.groupBy("id_a").agg(F.count(F.lit(1)).alias("n_links")).withColumnRenamed("id_a", "class_id")
    out = found.classes().join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").join(links, "class_id", "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("label", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
