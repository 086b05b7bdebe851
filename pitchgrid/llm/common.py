"""Shared helpers: compact tables in the shared folder, Arrow batches, words and their hashes in numpy."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.shared import shared_folder

U64 = np.uint64
#: Rows of an Arrow batch that goes to a Python task, so that long texts stay within its memory.
BATCH_ROWS = 256
#: Bytes of text that are hashed at once.
PIECE = 2_000_000
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_session(spark: SparkSession) -> None:
    """Small Arrow batches; a smaller setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def unused(name: str, taken: list[str]) -> str:
    """``name``, with underscores until no column of ``taken`` has it (case aside)."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written once to the cluster's shared folder and read back: a cut of the lineage with known size."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)


def words_of(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """The fold of a label row: crc32 of the id's text modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def lower_table(lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    return table


def space_words() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    keep = np.ones(256, bool)
    keep[list(SPACES)] = False
    return keep


def alnum_words() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, after A-Z are lower-cased."""
    keep = np.ones(256, bool)
    for a, b in ((0x00, 0x30), (0x3A, 0x61), (0x7B, 0x80)):
        keep[a:b] = False
    return keep


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a batch (null: empty) and the offsets of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts [i, j) of about PIECE bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def merged(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of at least ``size`` bytes (the last may be smaller)."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def random_u64(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


class Words:
    """Finds and hashes the words of many texts at once, byte by byte in numpy."""

    def __init__(self, keep: np.ndarray, lower: bool = True, seed: int = 7):
        self.keep, self.lower = keep, lower_table(lower)
        self.rand = random_u64(256, seed)
        self.power = np.ones(1, np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        while len(self.power) < n:
            with np.errstate(over="ignore"):
                step = self.power[-1] * U64(0x9E3779B97F4A7C15)
                self.power = np.concatenate([self.power, self.power * step])
        return self.power

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and the lower-cased bytes."""
        low = self.lower[data]
        inside = self.keep[low]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        return np.flatnonzero(first), np.flatnonzero(last) + 1, low

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and 64-bit hashes of all words, and per text the number of the first word (n + 1 values)."""
        starts, ends, low = self.spans(data, offsets)
        if not len(starts):
            return starts, ends, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
        sizes = ends - starts
        begin = np.cumsum(sizes) - sizes
        chars = low[self.keep[low]]
        at = np.arange(len(chars)) - np.repeat(begin, sizes)
        with np.errstate(over="ignore"):
            hashed = np.add.reduceat(self.rand[chars] * self._powers(int(sizes.max()))[at], begin)
            hashed = mix(hashed + sizes.astype(np.uint64) * U64(0xD6E8FEB86659FD93))
        return starts, ends, hashed, np.searchsorted(starts, offsets, "left")


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (across text borders too)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n] * U64(0x9E3779B97F4A7C15)
        for j in range(1, k):
            out = mix(out) + words[j:j + n] * U64(0x9E3779B97F4A7C15 + 2 * j)
    return mix(out)


def letters_only(texts: pa.Array) -> pa.Array:
    """Lower-cased texts whose words of letters (and their marks) stand between single spaces; without a letter: empty.

    A run of other characters is one space, and one space stands before the first and after the last word.
    """
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    spaced = pc.replace_substring_regex(low, r"[^\p{L}\p{M}]+", " ")
    has = pc.match_substring_regex(spaced, r"\p{L}")
    none, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    return pc.if_else(has, pc.binary_join_element_wise(none, pc.utf8_trim(spaced, " "), none, space), none)


class Lookup:
    """Places of keys in a sorted vocabulary (-1: not there): two hash tables, the few keys that clash twice by search."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.bits = max(8, int(np.ceil(np.log2(max(len(vocabulary), 1) * 8))))
        self.tables, left = [], np.arange(len(vocabulary))
        for seed in (1, 2):
            table = np.full(1 << self.bits, -1, np.int32)
            table[self._slot(vocabulary[left], seed)] = left
            self.tables.append(table)
            left = left[table[self._slot(vocabulary[left], seed)] != left]
        self.rest = left

    def _slot(self, keys: np.ndarray, seed: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys + U64(seed)) * U64(0x9E3779B97F4A7C15) >> U64(64 - self.bits)).astype(np.int64) if seed == 1 else (mix(keys) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(keys), -1, np.int64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for seed, table in zip((1, 2), self.tables):
            place = table[self._slot(keys[left], seed)]
            hit = (place >= 0) & (self.vocabulary[np.maximum(place, 0)] == keys[left])
            out[left[hit]] = place[hit]
            left = left[~hit]
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.vocabulary, keys[left]), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == keys[left]
            out[left[hit]] = at[hit]
        return out
