"""Toxicity from the nearest labelled examples: exact cosine of label-weighted TF-IDF over a block-max inverted index."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.common import U64, Lookup, arrow_session, grams, letters_only, mix, pieces, stored, utf8
from pitchgrid.llm.quality_knn import labelled_sample

#: The term that every word counts for: with it, the same marks weigh less in a longer text.
ANY = int(mix(np.array([42], np.uint64))[0])
#: Letters of the word beginnings that are terms beside the words themselves.
STEMS = (4, 5)
#: Weight of a term that labels do not set apart, against 1, and the chi-square that goes half of the way.
LEAST, HALF = 0.05, 24.0
#: Examples of a block, and texts that are scored together.
BLOCK, TOGETHER = 128, 128
#: A term of more than one in DENSE examples has a row of weights instead of postings.
DENSE = 16
#: Copies among the examples: words of a shingle, Jaccard similarity, and min-hashes that find candidates.
SHINGLE, COPY, SKETCH = 5, 0.8, 6


# --------------------------------------------------------------------------- #
# Terms
# --------------------------------------------------------------------------- #
def word_hashes(clean: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For runs [i, j) of texts as of ``letters_only``: row and 64-bit hash of every word, then of the beginnings of each of STEMS (0: no longer word)."""
    data, offsets = utf8(clean)
    lengths = pc.utf8_length(clean).to_numpy(zero_copy_only=False).astype(np.int64)
    for i, j in pieces(offsets):
        points = np.frombuffer(data[offsets[i]:offsets[j]].tobytes().decode().encode("utf-32-le"), np.uint32)
        inside = points != 0x20
        # Every text begins and ends with a space.
        start, end = (np.flatnonzero(x) + 1 for x in (inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]))
        row = np.searchsorted(np.cumsum(lengths[i:j]), start, "right")
        size = end - start
        at = np.arange(len(points)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(points)]])))
        power = np.full(int(size.max()) + 2 if len(size) else 1, 0x9E3779B97F4A7C15, np.uint64)
        power[0] = 1
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(power)
            upto = np.append(U64(0), np.cumsum(mix(points.astype(np.uint64)) * power[np.minimum(at, len(power) - 1)]))
            whole = mix(upto[end] - upto[start] + size.astype(np.uint64) * U64(0xD6E8FEB86659FD93))
            stems = [np.where(size > n, mix(upto[np.minimum(start + n, end)] - upto[start] + U64(n * 0x2545F4914F6CDD1D % 2 ** 64)), U64(0)) for n in STEMS]
        yield i, j, row, whole, stems


def term_keys(clean: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs [i, j) of texts: row and key of every occurrence of a word or beginning, and the number of words of each text."""
    for i, j, row, whole, stems in word_hashes(clean):
        long = [s != 0 for s in stems]
        yield i, j, np.concatenate([row, *(row[k] for k in long)]), np.concatenate([whole, *(s[k] for s, k in zip(stems, long))]), np.bincount(row, minlength=j - i)


def counted_terms(clean: pa.Array, lookup: Lookup) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs [i, j) of texts: row, term and count of every distinct known term, by row, then term."""
    width = max(len(lookup.vocabulary), 1)
    any_term = int(lookup(np.array([ANY], np.uint64))[0])
    for i, j, row, key, n_words in term_keys(clean):
        term = lookup(key)
        known = term >= 0
        pair, count = np.unique(row[known] * width + term[known], return_counts=True)
        if any_term >= 0:
            some = np.flatnonzero(n_words)
            pair, count = np.concatenate([pair, some * width + any_term]), np.concatenate([count, n_words[some]])
            order = np.argsort(pair)
            pair, count = pair[order], count[order]
        yield i, j, pair // width, pair % width, count


def example_terms(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: its distinct term keys, their counts, and its shingles."""
    out = []
    for text in letters_only(texts):  # few rows: one by one
        one = pa.array([text.as_py()], pa.large_string())
        (_, _, _, key, n_words), (_, _, _, whole, _) = next(term_keys(one)), next(word_hashes(one))
        key, count = np.unique(np.append(key, np.full(int(n_words[0] > 0), ANY, np.uint64)), return_counts=True)
        count[key == ANY] = n_words[0]
        k = min(SHINGLE, len(whole))
        out.append((key, count.astype(np.int32), np.unique(grams(whole, k)) if k else np.empty(0, np.uint64)))
    return out


def copies(shingles: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Which examples are copies of an earlier one that is none: of the same label, with a Jaccard similarity of COPY or more.

    Equal min-hashes only propose pairs; the full shingle sets decide.
    """
    seen: dict[tuple[int, int], list[int]] = defaultdict(list)
    out = np.zeros(len(shingles), bool)
    seeds = mix(np.arange(1, SKETCH + 1, dtype=np.uint64))
    for i, own in enumerate(shingles):
        if not len(own):
            continue
        sketch = [(c, int(mix(own ^ s).min())) for c, s in enumerate(seeds)]
        for other in sorted({o for key in sketch for o in seen[key] if labels[o] == labels[i]}):
            other_size = len(shingles[other])
            if min(len(own), other_size) >= COPY * max(len(own), other_size):
                both = len(np.intersect1d(own, shingles[other], assume_unique=True))
                if both >= COPY * (len(own) + other_size - both):
                    out[i] = True
                    break
        if not out[i]:
            for key in sketch:
                seen[key].append(i)
    return out


# --------------------------------------------------------------------------- #
# Index
# --------------------------------------------------------------------------- #
def spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each start to its end, and which of them each comes from."""
    size = end - start
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) + (start - np.cumsum(size) + size)[which], which


def unit(row: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, idf: np.ndarray, any_term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of unit vectors; a row with no term but the one that every word counts for has none."""
    alone = (np.bincount(row, minlength=n) == 1)[row] & (term == any_term)
    if alone.any():
        row, term, count = row[~alone], term[~alone], count[~alone]
    weight = np.log(count, dtype=np.float64)
    weight += 1.0
    weight *= idf[term]
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=n))
    weight /= np.where(norm > 0, norm, 1.0)[row]
    return row, term, weight


def block_order(vectors: np.ndarray, block: int) -> np.ndarray:
    """An order of the columns in which neighbours are alike: halved along their main axis until a part fits a block."""
    def halved(own: np.ndarray) -> np.ndarray:
        if len(own) <= block or not len(vectors):
            return own
        part = vectors[:, own] - vectors[:, own].mean(axis=1, keepdims=True)
        axis = part[:, np.square(part).sum(axis=0).argmax()]
        for _ in range(12):  # towards the main axis
            axis = part @ (axis @ part)
            axis = axis / max(np.linalg.norm(axis), 1e-12)
        order = own[np.argsort(np.round(axis @ part, 9), kind="stable")]
        half = -(-len(own) // (2 * block)) * block
        return np.concatenate([halved(order[:half]), halved(order[half:])]) if half < len(own) else order

    return halved(np.arange(vectors.shape[1]))


@dataclass(frozen=True)
class BlockMax:
    """Inverted index of unit vectors, examples in blocks of like ones.

    Lists of up to size / DENSE postings are grouped by block, each with its largest weight; longer ones are rows of a matrix with the
    largest weight of each block beside them.
    """

    vocabulary: np.ndarray
    idf: np.ndarray
    place: np.ndarray        # of each position in the blocks: the example
    post_at: np.ndarray      # position of each posting
    post_weight: np.ndarray
    block_start: np.ndarray  # per term: first of its blocks
    block_no: np.ndarray
    block_max: np.ndarray
    block_post: np.ndarray   # first posting of the block, one more at the end
    column: np.ndarray       # per term: its row of ``dense``, or -1
    dense: np.ndarray        # block x row x position, a short last block filled up with zeros
    dense_max: np.ndarray
    block: int

    @property
    def size(self) -> int:
        return len(self.place)

    def nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of ``n`` unit vectors (sorted by row): the k examples of largest cosine above 0, smallest number first among equals; exact.

        Upper bounds of all blocks come from the maxima. Texts with like bounds are scored together: first the blocks of
        largest bound, then those whose bound reaches the k-th score of one of them.
        """
        blocks = -(-self.size // self.block)
        out: list = [(np.empty(0, np.int64), np.empty(0))] * n
        if not self.size or not n:
            return out
        col = self.column[term]
        common = col >= 0
        query = np.zeros((n, len(self.dense_max)))
        query[row[common], col[common]] = weight[common]
        row, term, weight = row[~common], term[~common], weight[~common]
        at, which = spread(self.block_start[term], self.block_start[term + 1])
        owner = row[which]
        bound = query @ self.dense_max + np.bincount(owner * blocks + self.block_no[at], weight[which] * self.block_max[at], n * blocks).reshape(n, blocks)
        ranked = np.argsort(-bound, axis=1, kind="stable")
        first_at = np.searchsorted(owner, np.arange(n + 1))
        texts = np.lexsort((ranked[:, min(1, blocks - 1)], ranked[:, 0]))
        for t in range(0, n, TOGETHER):
            own = texts[t:t + TOGETHER]
            lists = np.concatenate([np.arange(first_at[x], first_at[x + 1]) for x in own])
            slot = np.repeat(np.arange(len(own)), first_at[own + 1] - first_at[own])
            open_ = np.zeros(blocks, bool)
            open_[ranked[own, :max(1, blocks // 8)]] = True
            scores = self._scores(query[own], lists, slot, at, which, weight, open_)
            edge = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(own), -1.0)
            edge = np.where(edge > 0, edge, -1.0)
            more = ~open_ & (bound[own] >= np.maximum(edge, 1e-12)[:, None] - 1e-9).any(axis=0)
            cols = np.flatnonzero(np.repeat(open_, self.block)[:self.size])
            if more.any():
                scores = np.hstack([scores, self._scores(query[own], lists, slot, at, which, weight, more)])
                cols = np.concatenate([cols, np.flatnonzero(np.repeat(more, self.block)[:self.size])])
            examples = self.place[cols]
            edge = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.zeros(len(own))
            for x, line, least in zip(own, scores, edge):
                hit = np.flatnonzero((line >= least) & (line > 0))
                top = hit[np.lexsort((examples[hit], -line[hit]))[:k]]
                out[x] = examples[top], line[top]
        return out

    def _scores(self, query: np.ndarray, lists: np.ndarray, slot: np.ndarray, at: np.ndarray, which: np.ndarray, weight: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Cosines of some texts with all examples of the open blocks."""
        numbers = np.flatnonzero(open_)
        first = np.zeros(len(open_), np.int64)
        first[numbers] = np.arange(len(numbers)) * self.block - numbers * self.block
        use = open_[self.block_no[at[lists]]]
        lists, slot = at[lists[use]], (slot[use], weight[which[lists[use]]], first[self.block_no[at[lists[use]]]])
        post, part = spread(self.block_post[lists], self.block_post[lists + 1])
        width = len(numbers) * self.block
        scores = np.bincount((slot[0] * width + slot[2])[part] + self.post_at[post], slot[1][part] * self.post_weight[post], len(query) * width).reshape(len(query), width).astype(np.float64, copy=False)
        if len(self.dense_max):
            for x, b in enumerate(numbers):
                scores[:, x * self.block:(x + 1) * self.block] += query @ self.dense[b].astype(np.float64)
        return np.round(scores[:, :width - max(0, (numbers[-1] + 1) * self.block - self.size)], 9)


def build_index(example: np.ndarray, term: np.ndarray, count: np.ndarray, size: int, vocabulary: np.ndarray, idf: np.ndarray, block: int = BLOCK, dense: int = DENSE) -> BlockMax:
    """Index of the unit vectors of ``size`` examples, from how often each (example, term) stands, by example."""
    any_term = int(Lookup(vocabulary)(np.array([ANY], np.uint64))[0])
    example, term, weight = unit(example, term, count, size, idf, any_term)
    weight = weight.astype(np.float32)
    held = np.bincount(term, minlength=len(vocabulary))
    often = np.flatnonzero(held > size / dense)
    column = np.full(len(vocabulary), -1, np.int32)
    column[often] = np.arange(len(often))
    matrix = np.zeros((len(often), size), np.float32)
    full = column[term] >= 0
    matrix[column[term[full]], example[full]] = weight[full]
    place = block_order(matrix, block)
    position = np.empty(size, np.int32)
    position[place] = np.arange(size)
    blocks = -(-size // block)
    filled = np.zeros((len(often), blocks * block), np.float32)
    filled[:, :size] = matrix[:, place]
    matrix = np.ascontiguousarray(filled.reshape(len(often), blocks, block).transpose(1, 0, 2))
    tops = np.ascontiguousarray(matrix.max(axis=2).T).astype(np.float64) if matrix.size else np.zeros((len(often), blocks))
    at, term, weight = position[example[~full]], term[~full], weight[~full]
    order = np.argsort(term.astype(np.int64) * max(size, 1) + at, kind="stable")
    at, term, weight = at[order], term[order], weight[order]
    new = np.ones(len(at), bool)
    new[1:] = (term[1:] != term[:-1]) | (at[1:] // block != at[:-1] // block)
    first = np.flatnonzero(new)
    return BlockMax(
        vocabulary, idf, place, at, weight, np.searchsorted(term[first], np.arange(len(vocabulary) + 1)), (at[first] // block).astype(np.int32),
        np.maximum.reduceat(weight, first) if len(first) else np.empty(0, np.float32), np.append(first, len(at)), column, matrix, tops, block)


# --------------------------------------------------------------------------- #
# Model
# --------------------------------------------------------------------------- #
@dataclass(frozen=True)
class Toxicity:
    """The index, labels and ids of the examples, and the shares that calibrate their votes."""

    index: BlockMax
    labels: np.ndarray
    ids: np.ndarray
    weights: np.ndarray  # per example: its class's share in all labels against that in the sample
    bare: float  # share of label 1 among labelled rows without a term
    k: int
    power: float

    def judge(self, texts: pa.Array, lookup: Lookup) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text: its score, and numbers and cosines of the neighbours that voted."""
        any_term = int(lookup(np.array([ANY], np.uint64))[0])
        out = []
        for i, j, row, term, count in counted_terms(letters_only(texts), lookup):
            for near, cosine in self.index.nearest(*unit(row, term, count, j - i, self.index.idf, any_term), j - i, self.k):
                vote = cosine ** self.power * self.weights[near]
                total = vote.sum()
                score = float((vote * self.labels[near]).sum() / total) if total > 0 else self.bare
                out.append((min(max(score, 0.0), 1.0), near, cosine))
        return out


def label_weights(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Weight of terms that stand in ``a`` of n1 and ``b`` of n0 examples: LEAST for those that labels do not set apart.

    It grows with the chi-square of presence (half of the way at HALF) and, up to threefold, with the ratio of the
    rates. No term gets 0, so any shared word brings two texts nearer.
    """
    off = a * (n0 - b) - b * (n1 - a)
    chi = (n1 + n0) * off * off / np.maximum((a + b) * ((n1 - a) + (n0 - b)) * n1 * n0, 1e-9)
    ratio = np.abs(np.log((a / max(n1, 1) + 1e-4) / (b / max(n0, 1) + 1e-4)))
    return LEAST + (1 - LEAST) * chi / (chi + HALF) * np.minimum(ratio / np.log(3), 1.0)


def _document_counts(docs: DataFrame, shared: Broadcast) -> tuple[int, np.ndarray]:
    """Number of all documents, and of those with each of the broadcast terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        width = len(lookup.vocabulary)
        total = np.zeros(width + 1, np.int64)
        for batch in batches:
            total[-1] += len(batch)
            for _, _, _, term, _ in counted_terms(letters_only(batch.column(0)), lookup):
                total[:-1] += np.bincount(term, minlength=width)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(total[term])], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(shared.value) + 1, np.int64)
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, sample_rows: int = 4000, k: int = 15, power: float = 6.0) -> Toxicity:
    """Index over all terms of at most ``sample_rows`` labelled documents (a documented bound).

    Terms are words and the first letters of longer ones, as 64-bit hashes. Of true copies with one label among the examples one is kept,
    else what they share would look like a mark of their label. Every term of the examples is indexed; labels only
    weigh it, and its document frequency is counted over all of ``docs``. The driver gets the examples' terms and
    shingles, and a count a term.
    """
    spark = docs.sparkSession
    arrow_session(spark)
    sample = labelled_sample(labels, label, sample_rows)
    counts = {int(r[0]): r[1] for r in labels.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("int")).count().collect() if r[0] in (0, 1)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = example_terms(batch.column(2))
            columns = [pa.array([np.ascontiguousarray(f[c]).tobytes() for f in found], pa.binary()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "label", "terms", "counts", "shingles"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    rows = sorted(chosen.mapInArrow(count, "doc_id long, label int, terms binary, counts binary, shingles binary").collect(), key=lambda r: r.doc_id)
    y = np.array([r.label for r in rows], np.float64)
    kept = ~copies([np.frombuffer(r.shingles, np.uint64) for r in rows], y)
    rows, y = [r for r, own in zip(rows, kept) if own], y[kept]
    ids = np.array([r.doc_id for r in rows], np.int64)
    # Keys ascend inside an example, and so do their places in the vocabulary.
    vocabulary = np.unique(np.concatenate([*(np.frombuffer(r.terms, np.uint64) for r in rows), np.array([ANY], np.uint64)]))
    term = np.concatenate([np.empty(0, np.int32), *(np.searchsorted(vocabulary, np.frombuffer(r.terms, np.uint64)).astype(np.int32) for r in rows)])
    example = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r.terms) // 8 for r in rows])
    number = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(r.counts, np.int32) for r in rows)])
    del rows
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    a = np.bincount(term, y.astype(np.float32)[example], len(vocabulary))
    b = np.bincount(term, minlength=len(vocabulary)) - a
    strength = label_weights(a, b, n1, n0)
    strength[vocabulary == U64(ANY)] = 1.0
    n, df = _document_counts(docs, spark.sparkContext.broadcast(vocabulary))
    bare = np.bincount(example, minlength=len(y)) == 0
    index = build_index(example, term, number, len(y), vocabulary, np.log1p(n / (1.0 + df)) * strength)
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    own = y.mean() if len(y) else 0.5
    weights = np.where(y == 1, prior / max(own, 1e-9), (1 - prior) / max(1 - own, 1e-9))
    without = float((weights * y)[bare].sum() / weights[bare].sum()) if bare.any() else prior
    return Toxicity(index, y, ids, weights, without, k, power)


def score_documents(docs: DataFrame, model: Toxicity, name: str = "score", evidence: str | None = "evidence") -> DataFrame:
    """``docs`` with ``name`` (0 to 1, higher: label 1 likelier) and the neighbours that voted (doc_id, cosine, label).

    The nearest labelled examples by exact TF-IDF cosine vote with cosine to a power; a text without a word of any example
    (null and empty ones too) gets the share of label 1 among labelled rows without one. Every whole text is scored
    where it is read, whatever its length and however often the row is there; nothing is shuffled. Columns of the added names are replaced.
    """
    arrow_session(docs.sparkSession)
    docs = docs.drop(name, *([evidence] if evidence else []))
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lookup = Lookup(own.index.vocabulary)
        for batch in batches:
            judged = own.judge(batch.column(at), lookup)
            columns = [*batch.columns, pa.array([j[0] for j in judged], pa.float64())]
            if evidence:
                said = [[{"doc_id": d, "cosine": c, "label": y} for d, c, y in zip(own.ids[near].tolist(), cosine.tolist(), own.labels[near].astype(int).tolist())] for _, near, cosine in judged]
                columns.append(pa.array(said, kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, name, *([evidence] if evidence else [])])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{name}` double"]
    return docs.mapInArrow(run, ", ".join(fields + ([f"`{evidence}` array<struct<doc_id:bigint,cosine:double,label:int>>"] if evidence else [])))
