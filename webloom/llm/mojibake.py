r"""Problem 3: text garbled by a wrong character encoding.

Method: noisy-channel decoding.  A channel is the pair of the encoding a text was wrongly read with and
its own.  For each distinct token that isn't plain ASCII a byte lattice is built for every channel: characters
go back to the bytes they were read from, bytes that were lost (U+FFFD) are wildcards, and runs that form
a character of the true encoding become an edge beside the unchanged characters.  The paths through a lattice with most such edges are
weighed by how often the corpus has the word that they spell, wildcards are filled by the most frequent word that fits, and a
Viterbi search over the tokens of a field picks the path of readings, with a price for changing channels.

Word frequencies come from all rows; they're joined, never broadcast by hand or collected.
"""

from __future__ import annotations

import heapq
import math
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOST = "�"
# Encodings in which UTF-8 is misread, and pairs (read as, true) of single-byte encodings (fixed values).
MISREAD_UTF8 = ["cp1252", "latin-1", "cp1250", "iso8859-2", "iso8859-15", "cp1251", "koi8-r", "cp437", "cp850", "cp852", "cp866", "mac-roman"]
MISREAD_BYTES = [
    ("mac-roman", "cp1252"), ("cp1252", "mac-roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1250", "cp1252"), ("cp1252", "cp1250"),
    ("iso8859-2", "cp1250"), ("cp1250", "iso8859-2"), ("cp1252", "iso8859-2"), ("iso8859-2", "cp1252"), ("cp1252", "iso8859-15"), ("iso8859-15", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"),
]
UTF8_CHANNELS = [f"utf-8 as {w}" for w in MISREAD_UTF8] + [f"utf-8 as {w} twice" for w in MISREAD_UTF8[:2]]
# Log-odds of a reading against the unchanged one: valid UTF-8 hardly arises by chance, swapped letters easily do.
PRIOR_UTF8, PRIOR_BYTES, PRIOR_LOST = 4.0, -2.0, 0.0
SWITCH, START = 1.0, 0.2
UNSURE = 6  # steps of rank that a path costs of which no run is whole
PATHS = 8  # paths through one lattice that are weighed under word frequencies: all of them where three runs can be restored
# What a swap of single bytes may give: letters, currency signs, dashes and quotes.
_WRITTEN = {"Lu", "Ll", "Lt", "Lo", "Sc", "Pd", "Pi", "Pf"}


@lru_cache(None)
def _to_byte(encoding: str) -> dict[str, int]:
    out = {chr(b): b for b in range(0x80, 0xA0)}  # bytes the encoding leaves open were kept as control characters
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(None)
def _swap(read_as: str, true: str) -> dict[int, str]:
    to_byte, table = _to_byte(read_as), {}
    for c, b in to_byte.items():
        try:
            table[ord(c)] = bytes([b]).decode(true)
        except UnicodeDecodeError:
            pass
    return table


def lattice(token: str, encoding: str) -> list[tuple[int, int, str]]:
    """The edges ``(start, end, character)`` beside the unchanged characters: runs whose bytes are one character of UTF-8.

    A lost byte within a run is a wildcard and makes the edge's character U+FFFD, as does a run that the token's end cuts off.
    """
    to_byte = _to_byte(encoding)
    units = [-1 if c == LOST else to_byte.get(c, 256) if ord(c) > 127 else 256 for c in token]
    edges, n = [], len(token)
    for i, b in enumerate(units):
        more = 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0
        tail = units[i + 1 : i + 1 + more]
        if not more or not all(t == -1 or 0x80 <= t <= 0xBF for t in tail):
            continue
        if len(tail) < more or -1 in tail:
            edges.append((i, min(n, i + 1 + more), LOST))
            continue
        try:
            edges.append((i, i + 1 + more, bytes([b, *tail]).decode("utf-8")))
        except UnicodeDecodeError:
            pass
    return edges


def paths(token: str, edges: list[tuple[int, int, str]], k: int = PATHS) -> list[tuple[str, int, int]]:
    """The ``k`` paths through the lattice with most edges that restore something, as ``(text, edges, edges without a lost byte)``, the fullest first.

    The last edge, where it's cut off by the token's end, needs another beside it.
    """
    starts = [e[0] for e in edges]
    best: list[list[tuple[int, tuple]]] = [[] for _ in edges] + [[(0, ())]]
    for i in range(len(edges) - 1, -1, -1):
        on = bisect_left(starts, edges[i][1], i + 1)
        taken = [(count + 1, (edges[i], chain)) for count, chain in best[on]]
        best[i] = heapq.nlargest(k, taken + best[i + 1], key=lambda x: x[0])
    out = []
    for count, chain in best[0]:
        parts, at, last, sure = [], 0, None, 0
        while chain:
            last, chain = chain
            sure += last[2] != LOST
            parts += [token[at : last[0]], last[2]]
            at = last[1]
        cut = last is not None and last[2] == LOST and last[1] == len(token) and LOST not in token[last[0] :]
        if count > cut:
            out.append(("".join([*parts, token[at:]]), count, sure))
    return out


@lru_cache(10_000)
def _script(c: str) -> str:
    if not unicodedata.category(c).startswith(("L", "M")):
        return ""
    return "LATIN" if ord(c) < 0x250 else unicodedata.name(c, "?").split(" ")[0]


def written(text: str) -> bool:
    """Whether a reading is something that is written: printable, with letters of one script.  Bytes of Cyrillic letters form characters of other scripts by chance."""
    return text.isprintable() and len({_script(c) for c in text} - {""}) <= 1


@lru_cache(100_000)
def readings(token: str) -> tuple[tuple[str, str, int], ...]:
    """``(channel, reading, rank)`` of a token, other than itself; equal readings once, under the first channel."""
    found: dict[str, tuple[str, int]] = {}
    for encoding in MISREAD_UTF8:
        for rank, (text, _, sure) in enumerate(paths(token, lattice(token, encoding))):
            if written(text):  # a run that owes all to its lost bytes proves little
                # Letters beyond ASCII that no run took in speak against the channel.
                strange = sum(ord(c) > 127 and c != LOST for c in text) - sure
                found.setdefault(text, (f"utf-8 as {encoding}", rank + strange + (0 if sure else UNSURE)))
            if encoding in MISREAD_UTF8[:2] and not rank:  # read wrongly twice; the halfway form may hold control characters
                again = max((p for e in MISREAD_UTF8[:2] for p in paths(text, lattice(text, e))[:1]), key=lambda p: p[1], default=None)
                if again and written(again[0]):
                    found.setdefault(again[0], (f"utf-8 as {encoding} twice", 0))
    for read_as, true in MISREAD_BYTES:
        text = token.translate(_swap(read_as, true))
        if text != token and text.isprintable() and LOST not in text and all(ord(c) < 128 or unicodedata.category(c) in _WRITTEN or c in "…·" for c in text):
            found.setdefault(text, (f"{true} as {read_as}", 0))
    if LOST in token:
        found.setdefault(token, ("lost", 0))
    return tuple((channel, text, rank) for text, (channel, rank) in found.items() if text != token or channel == "lost")


def prior(channel: str) -> float:
    return PRIOR_LOST if channel == "lost" else PRIOR_UTF8 + 0.5 if channel.endswith(" twice") else PRIOR_UTF8 if channel.startswith("utf-8 as ") else PRIOR_BYTES


def viterbi(tokens: Sequence[tuple[str, Sequence[tuple[str, str, float]]]]) -> list[tuple[str, str]]:
    """The best ``(channel, reading)`` of each token; each comes with its readings ``(channel, text, score)``.

    The state is the channel; leaving plain text for a channel or going back costs ``START``, changing between two
    channels ``SWITCH``.  Ties go to the reading named first, the unchanged one before all.
    """
    paths: dict[str, tuple[float, tuple]] = {"": (0.0, ())}
    for _, options in tokens:
        step: dict[str, tuple[float, tuple]] = {}
        for channel, text, score in options:
            best, chain = max(
                ((s - (0.0 if prev == channel else SWITCH if prev and channel else START), path) for prev, (s, path) in paths.items()),
                key=lambda x: x[0],
            )
            if channel not in step or best + score > step[channel][0]:
                step[channel] = (best + score, (chain, (channel, text)))
        paths = step
    chain = max(paths.values(), key=lambda x: x[0])[1]
    out: list[tuple[str, str]] = []
    while chain:
        chain, last = chain
        out.append(last)
    return out[::-1]


def _core(token: Column) -> Column:
    """A token without ASCII punctuation around it; a quote or dash inside stays."""
    return F.regexp_replace(token, r"^[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+$", "")


def _mask(word: Column) -> Column:
    return F.regexp_replace(word, r"[^\x00-\x7f]", LOST)


def _blanked(known: DataFrame) -> DataFrame:
    """``(shape, word, n)``: each known word with one and with two of its letters beyond ASCII turned to U+FFFD; of words that then are equal the most frequent."""
    places = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.ascii(F.substr(F.col("word"), i, F.lit(1))) > 127)
    one = known.select("word", "n", F.explode(places).alias("i"))
    blank = lambda word, i: F.concat(F.left(word, i - 1), F.lit(LOST), F.substr(word, i + 1))
    one = one.select("word", "n", "i", blank(F.col("word"), F.col("i")).alias("shape"))
    later = F.filter(F.sequence(F.col("i"), F.length("word")), lambda j: (j > F.col("i")) & (F.ascii(F.substr(F.col("word"), j, F.lit(1))) > 127))
    two = one.select("word", "n", "shape", F.explode(later).alias("j")).select("word", "n", blank(F.col("shape"), F.col("j")).alias("shape"))
    both = one.select("shape", "word", "n").unionByName(two.select("shape", "word", "n"))
    return both.groupBy("shape").agg(F.max(F.struct("n", "word")).alias("top")).select("shape", F.col("top.word").alias("word"), F.col("top.n").alias("n"))


_CANDIDATES = "core string, n_self bigint, channel string, reading string, rank int"


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(core, n, *r) for core, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in readings(core)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["core", "n_self", "channel", "reading", "rank"])


def _filled(reading: str, word: str | None) -> str:
    """A reading with its lost characters taken from a word that fits; all others stay as they are."""
    if not word or len(word) != len(reading):
        return word or reading
    known = "".join(c for c in reading if c != LOST)
    return "".join((w.upper() if known.isupper() and len(known) > 1 else w) if c == LOST else c for c, w in zip(reading, word, strict=True))


def _decode(texts: pd.Series, options: pd.Series) -> pd.DataFrame:
    """Restored text and the channels used; ``options``: of each core the readings with their counts."""
    out = []
    for text, listed in zip(texts, options, strict=True):
        by_core: dict[str, list] = {}
        for o in listed:
            by_core.setdefault(o["core"], []).append(o)
        tokens, lattice, places = text.split(" "), [], []
        for k, token in enumerate(tokens):
            core = token.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
            if core in by_core:
                found = by_core[core]
                edges = [] if LOST in core or any("\x80" <= c <= "\x9f" for c in core) else [("", core, math.log(found[0]["n_self"] + 0.1))]
                edges += [(o["channel"], _filled(o["reading"], o["filled"]), math.log(o["n"] + (0.5 if o["channel"].startswith("utf-8 as ") else 0.1)) + prior(o["channel"]) - o["rank"]) for o in sorted(found, key=lambda o: (o["rank"] - prior(o["channel"]), o["channel"], o["reading"]))]
                lattice.append((core, edges))
                places.append((k, core))
            elif core and not core.isascii():
                lattice.append((core, [("", core, 0.0)]))
                places.append((k, core))
        used = set()
        for (k, core), (channel, reading) in zip(places, viterbi(lattice), strict=True):
            if channel:
                used.add(channel)
                tokens[k] = tokens[k].replace(core, reading, 1)
        out.append((" ".join(tokens), sorted(used)))
    return pd.DataFrame(out, columns=["restored", "channels"])


def garbled(df: DataFrame, fields: Sequence[str] = ("page_title", "meta_description"), id_col: str = "site_id") -> DataFrame:
    """``(doc_id, field, text, restored, channels)``: the fields of which some token was read with a wrong encoding.

    ``restored`` is the best reading; bytes that nothing in the corpus can fill remain U+FFFD.  NULL counts as
    an empty text, empty and ASCII texts are never garbled, rows delivered twice come out once, an empty table
    gives an empty result.  Texts are taken whole, however long.  The declared charset isn't used: it is no sure guide.
    """
    parts = [df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]
    texts = parts[0]
    for more in parts[1:]:
        texts = texts.unionByName(more)
    texts = texts.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7f]"))
    tokens = texts.select("doc_id", "field", F.explode(F.split("text", " ")).alias("token")).where(F.col("token").rlike(r"[^\x00-\x7f]"))
    tokens = tokens.select("doc_id", "field", _core(F.col("token")).alias("core"))
    words = tokens.groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    # Frequencies disregard case; the token keeps its own.
    known = words.where(~F.contains("core", F.lit(LOST)) & ~F.col("core").rlike("[\\x80-\\x9f]")).groupBy(F.lower("core").alias("word")).agg(F.sum("n").alias("n"))
    selves = words.withColumn("word", F.lower("core")).join(known, "word", "left").select("core", F.coalesce(known["n"], F.lit(0)).alias("n_self"))
    proposed = selves.mapInArrow(_propose, _CANDIDATES)
    lost = F.contains("reading", F.lit(LOST))
    sure = proposed.where(~lost).withColumn("word", F.lower("reading")).join(known, "word", "left")
    sure = sure.select("core", "n_self", "channel", "reading", "rank", F.lit(None).cast("string").alias("filled"), F.coalesce("n", F.lit(0)).alias("n"))
    pattern = proposed.where(lost).withColumn("shape", F.lower("reading"))
    wild = F.length("shape") - F.length(F.replace("shape", F.lit(LOST), F.lit("")))
    # The most frequent words that agree wherever the reading kept its character: by the word with one or two of its letters blanked ...
    few = pattern.join(_blanked(known), "shape")
    # ... and with more of them lost by the word with all letters beyond ASCII blanked, which are few patterns.
    many = pattern.where(wild > 2).withColumn("mask", _mask(F.col("shape"))).join(known.select(_mask(F.col("word")).alias("mask"), "word", "n"), "mask")
    like = F.replace(F.regexp_replace("shape", r"([\\\\%_])", r"\\\\$1"), F.lit(LOST), F.lit("_"))
    fits = few.select("core", "channel", "reading", "n", "word").unionByName(many.where(F.like(F.col("word"), like)).select("core", "channel", "reading", "n", "word"))
    best = fits.groupBy("core", "channel", "reading").agg(F.max(F.struct("n", "word")).alias("top"))
    filled = pattern.drop("shape").join(best, ["core", "channel", "reading"], "left")
    filled = filled.select("core", "n_self", "channel", "reading", "rank", F.col("top.word").alias("filled"), F.coalesce("top.n", F.lit(0)).alias("n"))
    # A swap of single bytes needs a known word that is commoner than the token itself.
    useful = sure.where(F.col("channel").startswith("utf-8 as ") | (F.col("n") > F.col("n_self"))).unionByName(filled)
    options = useful.groupBy("core").agg(F.collect_list(F.struct("core", "n_self", "channel", "reading", "rank", "filled", "n")).alias("readings"))
    by_text = tokens.distinct().join(options, "core").groupBy("doc_id", "field").agg(F.flatten(F.collect_list("readings")).alias("options"))
    decode = F.pandas_udf(_decode, "restored string, channels array<string>")
    done = texts.join(by_text, ["doc_id", "field"]).withColumn("d", decode("text", "options"))
    result = done.select("doc_id", "field", "text", "d.restored", "d.channels").where(F.size("channels") > 0)
    return result.dropDuplicates(["doc_id", "field"])
