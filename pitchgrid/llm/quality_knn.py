"""Quality by nearest-neighbour voting: exact blocked cosines with labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.common import Words, arrow_session, pieces, space_words, utf8

#: Hashed byte trigrams of a text, and shares of its words and bytes that stand beside them.
TRIGRAMS, SHARES = 1024, 10
WIDTH = TRIGRAMS + SHARES


def features(texts: pa.Array, words: Words) -> np.ndarray:
    """A row of WIDTH numbers per text, from the whole text: unit-length log counts of hashed byte trigrams, then shares."""
    data, offsets = utf8(texts)
    out = np.zeros((len(texts), WIDTH), np.float32)
    upper, digit, letter = (np.zeros(256, bool) for _ in range(3))
    upper[65:91] = digit[48:58] = True
    letter[65:91] = letter[97:123] = letter[128:] = True
    symbol = ~(letter | digit)
    symbol[[0x20, 0x0A, 0x09, 0x0D, 0x2C, 0x2E]] = False
    for i, j in pieces(offsets):
        own, part, n = offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]], j - i
        row = np.repeat(np.arange(n), np.diff(own))
        if len(part) > 2:
            b = part.astype(np.int64)
            code = ((b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA6B + b[2:] * 0xC2B2AE35) >> 11) % TRIGRAMS
            whole = row[:-2] == row[2:]
            counts = np.bincount((row[:-2] * TRIGRAMS + code)[whole], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
            grams = np.log1p(counts).astype(np.float32)
            grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
            out[i:j, :TRIGRAMS] = grams
        starts, ends, hashed, first = words.hashes(part, own)
        n_words, n_bytes = np.diff(first), np.maximum(np.diff(own), 1)
        per_word = np.maximum(n_words, 1)
        word_row = np.repeat(np.arange(n), n_words)
        order = np.lexsort((hashed, word_row))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hashed[order][1:] != hashed[order][:-1]) | (word_row[order][1:] != word_row[order][:-1])
        again = np.zeros(len(hashed), bool)
        again[1:] = (hashed[1:] == hashed[:-1]) & (word_row[1:] == word_row[:-1])
        share = lambda mask: np.bincount(row[mask[part]], minlength=n) / n_bytes
        newline = np.zeros(256, bool)
        newline[0x0A] = True
        lines = np.bincount(row[newline[part]], minlength=n)
        distinct = np.bincount(word_row[order][fresh], minlength=n)
        out[i:j, TRIGRAMS:] = np.stack([
            distinct / np.maximum(per_word, 1) ** 0.85, np.bincount(word_row[again], minlength=n) / per_word, share(upper), share(digit), share(symbol),
            np.log1p(n_words) / 12, np.minimum((ends - starts).sum() if n == 1 else np.bincount(word_row, ends - starts, minlength=n), 1e9) / per_word / 20,
            lines / per_word, 1 - share(letter), (n_words == 0).astype(float)], axis=1)
    return out


@dataclass(frozen=True)
class Neighbours:
    """Labelled examples as unit vectors of a latent space; of bounded size (the sample's rows x dimensions)."""

    mean: np.ndarray
    axes: np.ndarray
    scale: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float
    k: int
    power: float

    def place(self, raw: np.ndarray) -> np.ndarray:
        """Latent unit vectors of rows of features."""
        latent = ((raw - self.mean) * self.scale) @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def score(self, raw: np.ndarray) -> np.ndarray:
        """Votes of the k nearest examples by cosine (all that tie with the k-th vote too), weighted by similarity."""
        if not len(self.labels):
            return np.full(len(raw), self.prior)
        near = np.round(self.place(raw) @ self.vectors.T, 5)
        k = min(self.k, near.shape[1])
        edge = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        vote = np.where(near >= edge[:, None], np.maximum(near, 1e-3).astype(np.float64) ** self.power, 0.0) * self.weights
        return np.clip((vote @ self.labels) / vote.sum(axis=1), 0.0, 1.0)


def _featured(rows: DataFrame, keep: list[str]) -> DataFrame:
    arrow_session(rows.sparkSession)
    rows = rows.select(*keep, "text")
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(space_words())
        for batch in batches:
            raw = features(batch.column(len(keep)), words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array([r.tobytes() for r in raw], pa.binary())], names=[*keep, "features"])

    return rows.mapInArrow(run, f"{fields}, features binary")


def labelled_sample(labels: DataFrame, label: str, rows: int, seed: int = 11) -> DataFrame:
    """At most ``rows`` labelled ids (doc_id, label), half of each class if there are so many, by a hash of the id.

    Null labels do not count; an id with several labels counts once, with the largest.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    positive, negative = (known.filter(F.col("label") == v).orderBy(*order).limit(rows // 2) for v in (1, 0))
    return positive.union(negative)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", *, sample_rows: int = 4000, dimensions: int = 48, k: int = 25, power: float = 12.0) -> Neighbours:
    """Latent vectors of at most ``sample_rows`` labelled documents (a documented bound: the only rows that are collected).

    The latent axes are the leading singular vectors of the sample's features, columns scaled to their spread. Votes
    are weighted so that the sample's classes count as in all labelled rows. No labels: the score is 0.5.
    """
    sample = labelled_sample(labels, label, sample_rows)
    counts = {int(r[0]): r[1] for r in labels.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("int")).count().collect() if r[0] in (0, 1)}
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    rows = sorted(_featured(chosen, ["doc_id", "label"]).collect(), key=lambda r: r.doc_id)
    raw = np.array([np.frombuffer(r.features, np.float32) for r in rows]).reshape(len(rows), WIDTH)
    y = np.array([r.label for r in rows], np.float64)
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if not len(rows):
        return Neighbours(np.zeros(WIDTH), np.zeros((WIDTH, 1)), np.ones(WIDTH), np.zeros((0, 1)), y, y, prior, k, power)
    mean, scale = raw.mean(axis=0), np.ones(WIDTH, np.float32)
    # The shares stand beside 1024 trigrams of unit length: each gets the weight of a tenth of them.
    spread = raw[:, TRIGRAMS:].std(axis=0)
    scale[TRIGRAMS:] = np.where(spread > 1e-6, 0.3 / np.maximum(spread, 1e-6), 0.0)
    centred = (raw - mean) * scale
    values, axes = np.linalg.eigh(centred.T.astype(np.float64) @ centred)
    axes = axes[:, ::-1][:, :dimensions].astype(np.float32)
    vectors = centred @ axes
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = np.where(y == 1, prior, 1 - prior)
    own = np.where(y == 1, max(y.mean(), 1e-9), max(1 - y.mean(), 1e-9))
    return Neighbours(mean, axes, scale, vectors.astype(np.float32), y, share / own, prior, k, power)


def score_documents(docs: DataFrame, model: Neighbours, name: str = "score") -> DataFrame:
    """``docs`` with ``name``: 0 to 1, higher where label 1 is likelier.

    Each text is scored on its own from its whole content, in blocks against all examples: no shuffle, repeated rows
    and very long texts included. A null or empty text has no trigram and is scored like any other vector. A column
    called ``name`` is replaced; other columns, and rows of any id, stay.
    """
    arrow_session(docs.sparkSession)
    docs = docs.drop(name)
    at = docs.columns.index("text")
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{name}` double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(space_words())
        for batch in batches:
            scores = shared.value.score(features(batch.column(at), words))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, fields)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text modulo ``folds`` is ``fold``: such labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
