"""Language by nearest centroid: TF-IDF vectors of character n-grams, several clustered centroids a language, cosine, rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.llm.common import U64, Lookup, arrow_session, letters_only, pieces, stored, utf8

#: Code points of the n-grams: three of 21 bits are one exact key. Words stand between spaces, so a single letter is one too.
GRAM = 3
UNDETERMINED = "und"
#: Texts are compared with others of as many distinct n-grams: a class for each power of two.
SIZE_CLASSES = 32
#: Products of terms and centroids that are held at once.
PRODUCTS = 1 << 22


# --------------------------------------------------------------------------- #
# n-grams
# --------------------------------------------------------------------------- #
def gram_keys(clean: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs [i, j) of texts as of :func:`letters_only`: the row (from i) and the exact key of every n-gram."""
    data, offsets = utf8(clean)
    lengths = pc.utf8_length(clean).to_numpy(zero_copy_only=False).astype(np.int64)
    for i, j in pieces(offsets):
        points = np.frombuffer(data[offsets[i]:offsets[j]].tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(j - i), lengths[i:j])
        key = points[:1 - GRAM]
        for k in range(1, GRAM):
            key = (key << U64(21)) | points[k:k + len(key)]
        whole = row[:len(key)] == row[GRAM - 1:]
        yield i, j, row[:len(key)][whole], key[whole]


def counted(clean: pa.Array, lookup: Lookup) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs [i, j) of texts: row, term and count of every distinct known n-gram, by row, then term; row and count of the others."""
    width = max(len(lookup.vocabulary), 1)
    for i, j, row, key in gram_keys(clean):
        term = lookup(key)
        known = term >= 0
        pair, count = np.unique(row[known] * width + term[known], return_counts=True)
        other_row, other_key = row[~known], key[~known]
        order = np.lexsort((other_key, other_row))
        other_row, other_key = other_row[order], other_key[order]
        head = np.flatnonzero((np.diff(other_row, prepend=-1) != 0) | np.append(True, other_key[1:] != other_key[:-1])[:len(other_key)])
        yield i, j, pair // width, pair % width, count, other_row[head], np.diff(np.append(head, len(other_key)))


# --------------------------------------------------------------------------- #
# Model
# --------------------------------------------------------------------------- #
@dataclass(frozen=True)
class Centroids:
    """Centroids as unit vectors over the sample's n-grams; of bounded size (n-grams of the sample x centroids)."""

    vocabulary: np.ndarray
    idf: np.ndarray             # of each term, and of n-grams that the sample lacks
    vectors: np.ndarray         # term x centroid
    languages: tuple[str, ...]  # of each centroid, ascending
    nearest: np.ndarray         # smallest cosine that is not rejected, by size class
    fallback: str | None        # the commonest language, for texts without a known n-gram

    def products(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Dot products of ``n`` sparse rows with all centroids, in blocks of about PRODUCTS numbers."""
        dots = np.zeros((n, len(self.languages)))
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        at = 0
        while at < len(heads):
            stop = max(at + 1, int(np.searchsorted(heads, heads[at] + PRODUCTS // len(self.languages))))
            own = slice(heads[at], heads[stop] if stop < len(heads) else len(row))
            dots[row[heads[at:stop]]] = np.add.reduceat(weight[own, None] * self.vectors[term[own]], heads[at:stop] - heads[at], axis=0)
            at = stop
        return dots

    def judge(self, texts: pa.Array, lookup: Lookup) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Nearest language, cosine and whether it is too far, for each text (without a letter: und, 0, rejected)."""
        names, score, far = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.languages:
            return names, score, far
        clean = letters_only(texts)
        written = pc.not_equal(clean, "").to_numpy(zero_copy_only=False)
        for i, j, row, term, count, other_row, other_count in counted(clean, lookup):
            weight, norm, size = weighted(self.idf, j - i, row, term, count, other_row, other_count)
            dots = self.products(row, term, weight, j - i)
            cosine = np.round(dots / np.maximum(norm, 1e-12)[:, None], 6)
            best = cosine.argmax(axis=1)
            some = np.bincount(row, minlength=j - i) > 0
            for t in range(j - i):
                if written[i + t]:
                    names[i + t] = self.languages[best[t]] if some[t] else self.fallback
            score[i:j] = np.clip(cosine[np.arange(j - i), best], 0, 1) * written[i:j]
            far[i:j] = ~some | (score[i:j] < self.nearest[size_class(size)])
        return names, score, far


def weighted(idf: np.ndarray, n: int, row: np.ndarray, term: np.ndarray, count: np.ndarray, other_row: np.ndarray, other_count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF weights of known n-grams; length of each of the ``n`` texts' whole vectors, and its number of distinct n-grams."""
    weight, other = (1 + np.log(count)) * idf[term], (1 + np.log(other_count)) * idf[-1]
    square = np.bincount(row, weight * weight, minlength=n) + np.bincount(other_row, other * other, minlength=n)
    return weight, np.sqrt(square), np.bincount(row, minlength=n) + np.bincount(other_row, minlength=n)


def size_class(distinct: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(distinct, 1)).astype(np.int64), SIZE_CLASSES - 1)


def clusters(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, width: int, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means over ``n`` sparse rows: centroids (k x width) and the centroid of each row.

    Starts with the row nearest to the mean and then the row farthest from all chosen ones, so it has no random part.
    """
    def centroid(weight_of_row: np.ndarray) -> np.ndarray:
        out = np.bincount(terms, weights * weight_of_row[rows], minlength=width)
        return out / max(np.linalg.norm(out), 1e-12)

    def cosines(vector: np.ndarray) -> np.ndarray:
        return np.round(np.bincount(rows, weights * vector[terms], minlength=n), 9)

    def alone(i: int) -> np.ndarray:
        return centroid((np.arange(n) == i).astype(float))

    chosen = [alone(int(cosines(centroid(np.ones(n))).argmax()))]
    near = cosines(chosen[0])
    while len(chosen) < min(k, n) and near.min() < 1 - 1e-6:
        chosen.append(alone(int(near.argmin())))
        near = np.maximum(near, cosines(chosen[-1]))
    vectors = np.array(chosen)
    for _ in range(rounds):
        own = np.stack([cosines(v) for v in vectors]).argmax(axis=0)
        moved = np.array([centroid((own == c).astype(float)) if (own == c).any() else vectors[c] for c in range(len(vectors))])
        if np.allclose(moved, vectors, atol=1e-9):
            break
        vectors = moved
    return vectors, np.stack([cosines(v) for v in vectors]).argmax(axis=0)


# --------------------------------------------------------------------------- #
# Learning
# --------------------------------------------------------------------------- #
def labelled_sample(docs: DataFrame, rows: int, languages: int) -> tuple[DataFrame, dict[str, int]]:
    """At most ``rows`` labelled rows (doc_id, lang, text), shared evenly by the languages; rows of each language.

    Languages beyond the ``languages`` commonest ones are not learnt. A language's rows are thinned by its count before
    they are ordered by a hash of the id, so no task holds all rows of a hot language.
    """
    counts = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    sizes = {r.lang: r.n for r in counts}
    share = max(1, rows // max(len(sizes), 1))
    # Four times the share on average: fewer than the share are left with a chance below 1 in 10^9.
    bounds = [(lang, min(1 << 40, (1 << 40) * (4 * share + 40) // n)) for lang, n in sizes.items()]
    bounds = docs.sparkSession.createDataFrame(bounds, "lang string, below long")
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40))
    thin = docs.join(F.broadcast(bounds), "lang").withColumn("place", place).where(F.col("place") < F.col("below"))
    order = Window.partitionBy("lang").orderBy("place", "doc_id", F.xxhash64("text"))
    picked = thin.withColumn("at", F.row_number().over(order)).where(F.col("at") <= share)
    return picked.select("doc_id", "lang", "text"), sizes


def _vocabulary(sample: DataFrame, least_rows: int, most: int) -> np.ndarray:
    """The n-grams of at least ``least_rows`` rows of the sample, the ``most`` commonest of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, key in gram_keys(letters_only(batch.column(0))):
                term, place = np.unique(key.view(np.int64), return_inverse=True)
                n = np.bincount(np.unique(place * (j - i) + row) // (j - i), minlength=len(term))
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n, pa.int64())], names=["term", "n"])

    found = sample.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_rows)
    return np.sort(np.array([r.term for r in found.orderBy(F.desc("n"), "term").limit(most).collect()], np.int64)).view(np.uint64)


def _document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all ``docs`` each n-gram stands, and how many docs there are; each task sends one row a term at most."""
    shared, width = docs.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = Lookup(shared.value), np.zeros(width + 1, np.int64)
        for batch in batches:
            total[width] += len(batch)
            for _, _, _, term, *_ in counted(letters_only(batch.column(0)), lookup):
                total[:width] += np.bincount(term, minlength=width)[:width]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(width + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out[:width], int(out[width])


def fit(
    docs: DataFrame, *, sample_rows: int = 4000, centroids: int = 4, most_languages: int = 500, most_centroids: int = 512, least_rows: int = 2,
    most_grams: int = 50_000, rounds: int = 20, tail: float = 0.01, slack: float = 0.8,
) -> Centroids:
    """Centroids of the languages of ``docs`` (doc_id, lang, text); rows without a text, lang or doc_id are not learnt from.

    Bounds: ``sample_rows`` labelled rows, ``most_languages`` languages, ``most_centroids`` centroids and ``most_grams`` n-grams
    of the sample; all that reaches the driver. Document frequencies count all rows. Spherical k-means makes up to
    ``centroids`` centroids of a language's sample rows. A text is rejected where its cosine lies below ``slack`` times the cosine that
    a share ``tail`` of the sample's rows with as many distinct n-grams (by powers of two) does not reach; sizes of fewer
    than 20 such rows take the bound of the next smaller size, and nothing is rejected below the first.
    """
    spark = docs.sparkSession
    arrow_session(spark)
    known = docs.select("doc_id", "lang", "text").where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    sample, sizes = labelled_sample(known, sample_rows, most_languages)
    sample = stored(sample, "language-sample")
    vocabulary = _vocabulary(sample, least_rows, most_grams)
    frequency, n_docs = _document_frequencies(known, vocabulary)
    idf = np.log((1 + n_docs) / (1 + np.append(frequency, 0))) + 1.0
    per_language = max(1, min(centroids, most_centroids // max(len(sizes), 1)))
    shared = spark.sparkContext.broadcast((vocabulary, idf))

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        words, weight_of = shared.value
        rows = rows.sort_values(["doc_id", "text"])
        texts, lookup, parts = letters_only(pa.array(rows.text, pa.string())), Lookup(words), []
        for i, j, row, *rest in counted(texts, lookup):
            weight, norm, size = weighted(weight_of, j - i, row, *rest)
            parts.append((i + row, rest[0], weight / norm[row], size[row]))
        row, term, weight, size = (np.concatenate(x) for x in zip(*parts))
        some, head, row = np.unique(row, return_index=True, return_inverse=True)
        if not len(some):
            return pd.DataFrame({"lang": [], "terms": [], "weights": [], "classes": [], "cosines": []})
        vectors, own = clusters(row, term, weight, len(some), len(words), per_language, rounds)
        cosine = np.bincount(row, weight * vectors[own[row], term])
        classes = size_class(size[head])
        out = []
        for c, v in enumerate(vectors):
            terms, mine = np.flatnonzero(v), own == c
            out.append((rows.lang.iloc[0], terms, v[terms], classes[mine], cosine[mine]))
        return pd.DataFrame(out, columns=["lang", "terms", "weights", "classes", "cosines"])

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, terms array<int>, weights array<double>, classes array<int>, cosines array<double>").collect()
    found.sort(key=lambda r: (r.lang, r.terms, r.weights))
    vectors = np.zeros((max(len(vocabulary), 1), len(found)), np.float32)
    for c, r in enumerate(found):
        vectors[r.terms, c] = r.weights
    classes = np.array([x for r in found for x in r.classes], np.int64)
    cosines = np.array([x for r in found for x in r.cosines])
    nearest = np.zeros(SIZE_CLASSES)
    for size in range(SIZE_CLASSES):
        own = cosines[classes == size]
        nearest[size] = slack * np.quantile(own, tail) if len(own) >= 20 else nearest[size - 1] if size else 0.0
    fallback = min(sizes, key=lambda k: (-sizes[k], k)) if found else None
    return Centroids(vocabulary, idf, vectors, tuple(r.lang for r in found), nearest, fallback)


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """``docs`` with lang_nearest, lang_score (cosine, 0 to 1), lang_rejected and lang_pred (``und`` where rejected).

    Each whole text is compared alone: no shuffle, whatever its length, repeated rows included. A null text, one without a letter, and every
    text of a model without languages is ``und`` with score 0 and rejected; a text with letters but no known n-gram
    gets the commonest language as nearest, score 0. Ties go to the smaller language code. Columns of the added names are
    replaced; other columns, and rows of any id, stay.
    """
    arrow_session(docs.sparkSession)
    added = "lang_nearest string, lang_score double, lang_rejected boolean, lang_pred string"
    names_added = [f.split()[0] for f in added.split(", ")]
    kept = docs.drop(*names_added)
    at, names = kept.columns.index("text"), kept.columns
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), added])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lookup = Lookup(own.vocabulary)
        for batch in batches:
            nearest, score, far = own.judge(batch.column(at), lookup)
            pred = [UNDETERMINED if f else x for x, f in zip(nearest, far)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_()), pa.array(pred, pa.string())], names=[*names, *names_added])

    return kept.mapInArrow(run, fields)
