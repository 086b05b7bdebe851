"""Token ids in ORC: stripes with integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchgrid.llm.common import arrow_session, merged, stored, utf8

#: Distinct runs whose ids a Python process remembers before it starts anew.
MEMORY = 1_000_000
ORC = {
    "compression": "zlib", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(64 << 20),
}


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes that are white space; ASCII letters and digits; ASCII signs other than the apostrophe."""
    space, word, sign = (np.zeros(256, bool) for _ in range(3))
    space[[0x20, 0x09, 0x0A, 0x0D]] = True
    word[48:58] = word[65:91] = word[97:123] = True
    sign[33:127] = ~word[33:127]
    sign[0x27] = False
    return space, word, sign


class Encoder:
    """Ids of whole texts from a ``tokenizers`` file, each distinct run of characters encoded once by the library.

    For tokenizers that drop white space, lower-case, and split letters, digits and signs from each other before they
    merge: a text's ids are then those of its runs, in order. Runs end at ASCII white space and between an ASCII sign
    and a Latin letter or digit. A chunk with an apostrophe (contractions), ``<`` (special tokens) or a control
    character stays whole and in its own case; characters outside Latin-1 letters never end a run.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.pool = np.empty(0, np.uint32)
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int64)

    @staticmethod
    def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First bytes of all runs, the bytes (ASCII letters lower-cased where that is safe), and which belong to runs."""
        space, word, sign = _classes()
        inside = ~space[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        first[cuts] = inside[cuts]
        starts = np.flatnonzero(first)
        if not len(starts):
            return starts, data, inside
        odd = (data == 0x27) | (data == 0x3C) | (data < 32) & inside | (data == 0x7F)
        plain = np.repeat(np.add.reduceat(odd, starts, dtype=np.int64) == 0, np.diff(np.append(starts, len(data))))
        plain = np.concatenate([np.ones(starts[0], bool), plain])
        low = np.where(plain & (data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        before, after = data[:-1], data[1:]
        # Latin-1 letters are C3 80 to C3 BF without the signs C3 97 and C3 B7.
        latin_end = np.zeros(len(before), bool)
        latin_end[1:] = (data[:-2] == 0xC3) & (before[1:] != 0x97) & (before[1:] != 0xB7)
        latin_start = np.zeros(len(after), bool)
        latin_start[:-1] = (after[:-1] == 0xC3) & (data[2:] != 0x97) & (data[2:] != 0xB7)
        border = ((word[before] | latin_end) & sign[after]) | (sign[before] & (word[after] | latin_start))
        first[1:] |= border & plain[1:] & inside[1:] & inside[:-1]
        return np.flatnonzero(first), low, inside

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch, each text's followed by ``end_id``; offsets of each text's ids."""
        data, offsets = utf8(texts)
        starts, low, inside = self.runs(data, offsets)
        if not len(starts):
            return np.full(len(texts), end_id, np.uint32), np.arange(len(texts) + 1)
        rows = np.searchsorted(starts, offsets[1:], "left")
        # An Arrow array over the runs alone: their bytes side by side.
        bounds = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(np.add.reduceat(inside, starts, dtype=np.int64), out=bounds[1:])
        runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(low[inside])))
        coded = pc.dictionary_encode(runs)
        words = coded.dictionary.to_pylist()
        if len(self.place) + len(words) > MEMORY:
            self.forget()
        new = [w for w in words if w not in self.place]
        if new:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            sizes = np.array([len(f) for f in found], np.int64)
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.pool = np.concatenate([self.pool, np.array([i for f in found for i in f], np.uint32)])
        own = np.array([self.place[w] for w in words], np.int64)[coded.indices.to_numpy()]
        pool = np.append(self.pool, np.uint32(end_id))
        # Each run, and an end after each text, is a stretch of the pool.
        begin = np.insert(self.start[own], rows, len(pool) - 1)
        size = np.insert(self.size[own], rows, 1)
        out = np.cumsum(size) - size
        take = np.repeat(begin - out, size) + np.arange(int(size.sum()))
        return pool[take], np.concatenate([[0], out[rows + np.arange(len(rows))] + 1])


def encoder(path: str) -> Encoder:
    """The encoder of this Python process, so that tasks of one worker share what it remembers."""
    kept = sys.modules.setdefault("pitchgrid_encoders", types.ModuleType("pitchgrid_encoders")).__dict__.setdefault("kept", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, files: int | None = None) -> None:
    """One ORC row a document in ascending doc_id order: doc_id, part_no, at (ids before it in the part), n_tokens, ids.

    Documents are range-partitioned by doc_id (ties by a hash of the text) and encoded where they land, so each file
    holds one range in order; ids are ORC integers (run-length encoded) and lookups by doc_id use the Bloom filters
    and row indexes. A null text is empty and has the end id alone. ``tokenizer`` is a file every executor can read.
    """
    spark = docs.sparkSession
    arrow_session(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(files, "doc_id", tie).sortWithinPartitions("doc_id", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        own, at, part = encoder(tokenizer), 0, TaskContext.get().partitionId()
        for batch in merged(batches, 3_000_000):
            step = max(1, int(len(batch) * 4_000_000 // max(batch.nbytes, 1)))
            for i in range(0, len(batch), step):
                rows = batch.slice(i, step)
                ids, offsets = own.encode(rows.column(1), end_id)
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(at + offsets[:-1], pa.int64()), pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))],
                    names=["doc_id", "part_no", "at", "n_tokens", "ids"])
                at += int(offsets[-1])

    ordered.mapInArrow(run, "doc_id long, part_no int, at long, n_tokens long, ids array<int>").write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`write_tokens` with ``start``: the number of ids of all documents before.

    Stripes are read in parallel. The length of each part is its last row's ``at + n_tokens``; the parts' first ids
    are running sums over one row a file, not over documents.
    """
    rows = spark.read.schema("doc_id long, part_no int, at long, n_tokens long, ids array<int>").orc(path)
    parts = rows.groupBy("part_no").agg(F.max(F.col("at") + F.col("n_tokens")).alias("n"))
    before = F.sum("n").over(Window.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1))
    parts = stored(parts.select(F.col("part_no").alias("p"), F.coalesce(before, F.lit(0)).alias("part_start")), "token-parts")
    return rows.join(parts, F.col("part_no") == F.col("p")).withColumn("start", F.col("part_start") + F.col("at")).drop("p", "part_start")


def token_digest(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ids_crc32, the crc32 of the ids as little-endian unsigned 32-bit integers, in place of ids."""
    arrow_session(tokens.sparkSession)
    kept = [f for f in tokens.schema.fields if f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            offsets = ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), pa.array(crc, pa.int64())], names=[*(f.name for f in kept), "ids_crc32"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "ids_crc32 long"])
    return tokens.mapInArrow(run, schema)
