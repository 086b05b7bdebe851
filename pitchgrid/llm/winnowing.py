"""Benchmark decontamination by winnowing: fingerprints that every long enough shared span must have in common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.common import U64, Words, alnum_words, arrow_session, grams, mix, pieces, stored, utf8

#: Words of a window, and of the k-grams that are hashed for windows of full length.
SPAN, GRAM = 13, 5
#: Bits of the filter that keeps document fingerprints without a counterpart out of the exchange: 1 MB at any size.
FILTER_BITS = 23
FINGERPRINT = "span int, key long, left int, context string"


def shape(span: int) -> tuple[int, int]:
    """k-gram length and window of a family: spans of k + w - 1 words share a selected k-gram. Short items take k = span."""
    return (GRAM, span - GRAM + 1) if span == SPAN else (span, 1)


def selected(words: np.ndarray, first_word: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the k-grams that have the smallest hash of a window, the last one among equals.

    A window's choice depends on its words alone, so a document and an item with a common span choose the same place.
    """
    k, w = shape(span)
    n = len(words) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    whole = row[:n] == row[span - 1:]
    hashes = grams(words, k)
    best, at = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        other = hashes[j:j + n]
        lower = other <= best
        best[lower], at[lower] = other[lower], j
    places = np.unique((np.arange(n) + at)[whole])
    return places, mix(hashes[places] + U64(span))


def context(low: bytes, starts: np.ndarray, ends: np.ndarray, first: int, last: int, place: int, span: int) -> tuple[int, str]:
    """Words around the k-gram that a window with it can reach, and how many of them stand before it."""
    k, w = shape(span)
    a, b = max(first, place - w + 1), min(last, place + k + w - 1)
    return place - a, b" ".join(low[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())).decode("utf-8", "replace")


def _scan(texts: pa.Array, words: Words, spans: list[int] | None, bits: np.ndarray | None) -> Iterator[tuple[int, int, list[tuple]]]:
    """Per text: its number, its words, and (span, key, left, context, place) of fingerprints that pass the filter.

    ``spans`` None: the one family that the text's own length has (an item).
    """
    data, offsets = utf8(texts)
    for i, j in pieces(offsets):
        own = offsets[i:j + 1] - offsets[i]
        part = data[offsets[i]:offsets[j]]
        starts, ends, hashed, first = words.hashes(part, own)
        low = words.lower[part].tobytes()
        found: list[list[tuple]] = [[] for _ in range(j - i)]
        sizes = np.diff(first)
        for span in spans if spans is not None else sorted({min(SPAN, int(n)) for n in sizes if n}):
            places, keys = selected(hashed, first, span)
            if bits is not None:
                at = keys >> U64(64 - FILTER_BITS)
                places, keys = (x[(bits[at >> U64(6)] >> (at & U64(63))) & U64(1) == 1] for x in (places, keys))
            for place, key, row in zip(places.tolist(), keys.view(np.int64).tolist(), (np.searchsorted(first, places, "right") - 1).tolist()):
                if spans is None and min(SPAN, sizes[row]) != span:
                    continue
                left, around = context(low, starts, ends, int(first[row]), int(first[row + 1]), place, span)
                found[row].append((span, key, left, around, place - int(first[row])))
        for row in range(j - i):
            yield i + row, int(sizes[row]), found[row]


def _fingerprints(rows: DataFrame, keep: list[str], text: str, spans: list[int] | None, bits: np.ndarray | None) -> DataFrame:
    """A row a text: the columns ``keep``, n_words and its fingerprints."""
    arrow_session(rows.sparkSession)
    rows = rows.select(*keep, F.col(text).alias("text"))
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    kind = pa.list_(pa.struct([("span", pa.int32()), ("key", pa.int64()), ("left", pa.int32()), ("context", pa.string()), ("place", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(alnum_words())
        for batch in batches:
            sizes, prints = [], []
            for _, n, found in _scan(batch.column(len(keep)), words, spans, bits):
                sizes.append(n)
                prints.append([dict(zip(("span", "key", "left", "context", "place"), f)) for f in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(sizes, pa.int64()), pa.array(prints, kind)], names=[*keep, "n_words", "prints"])

    return rows.mapInArrow(run, ", ".join([*fields, "n_words long", "prints array<struct<span:int,key:bigint,left:int,context:string,place:bigint>>"]))


def reach(own: str, left: int, other: str, other_left: int, span: int) -> tuple[int, int] | None:
    """From and to, relative to the k-gram, of the words in windows common to both contexts; None if there are none."""
    k, _ = shape(span)
    a, b = own.split(" "), other.split(" ")
    if a[left:left + k] != b[other_left:other_left + k]:
        return None
    before = 0
    while before < left and before < other_left and a[left - before - 1] == b[other_left - before - 1]:
        before += 1
    after = k
    while left + after < len(a) and other_left + after < len(b) and a[left + after] == b[other_left + after]:
        after += 1
    return (-before, after) if before + after >= span else None


def _extended(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            rows = [(s, k, n, c, i, *r) for s, k, n, c, i, on, oc in zip(*cols) if (r := reach(c, n, oc, on, s))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                names=["span", "key", "left", "context", "class_id", "from", "to"])

    return pairs.mapInArrow(run, FINGERPRINT + ", class_id long, from long, to long").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, *, percent: int = 5) -> DataFrame:
    """A row for each of ``docs``: doc_id, row_key, n_words, n_hit, n_items, item_ids (sorted as strings), hit_spans (from, to) and contaminated.

    Words: A-Z lower-cased runs of ASCII letters, digits and non-ASCII characters. A window is 13 consecutive words of
    an item, or the whole of a shorter one; a document's words inside any occurrence of a window are hit, and it is
    contaminated if any is and they make at least ``percent`` of its words.

    Items with equal words form a class, told by a 64-bit hash of them. Items without an item_id hit like others and count
    together as one item that ``item_ids`` has no name for. Both sides keep the smallest k-gram hash of each window of 9 5-grams (items
    of n < 13 words: their n-gram; documents then keep their n-grams for those lengths), with the up to eight words on
    either side. A bit table of fixed size over the items' keys keeps document fingerprints without a counterpart out
    of the exchange; it may let more through as the benchmark grows, but drops none that matches. Distinct contexts
    meet the items' once, are compared word by word and extended, and the outcome goes back to the documents, so a
    passage in a third of the documents is compared once and its documents are spread like any skewed join.

    Null, empty or wordless texts have no words and no hits, as documents and as items; repeated rows keep their
    number; tables may be empty; other columns of either table are not looked at.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("item_text")).filter("item_text is not null")
    canonical = F.array_join(F.regexp_extract_all(F.translate("item_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1)), " ")
    items = items.select("item_id", canonical.alias("words")).filter("words <> ''")
    items = stored(items.withColumn("class_id", F.xxhash64("words")), "benchmark-items")
    classes = items.select("class_id", "words").dropDuplicates(["class_id"])
    members = items.select("class_id", "item_id").distinct()
    prints = _fingerprints(classes, ["class_id"], "words", None, None)
    prints = stored(prints.select("class_id", F.explode("prints").alias("p")).select("class_id", "p.*").drop("place").distinct(), "benchmark-prints")
    spans = sorted(r.span for r in prints.select("span").distinct().collect())  # 13 values at most
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bit = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    for r in prints.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - FILTER_BITS}) & 63 as int))")).alias("set")).collect():
        bits[r["at"]] = np.int64(r["set"]).astype(np.uint64)  # 2^17 rows at most
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    found = stored(_fingerprints(keyed, ["doc_id", "row_key"], "text", spans, bits).withColumnRenamed("doc_id", "id"), "document-prints")
    hits = found.select("id", "row_key", F.explode("prints").alias("p")).select("id", "row_key", "p.*")
    pairs = hits.select("span", "key", "left", "context").distinct().join(
        prints.select("span", "key", "class_id", F.col("left").alias("item_left"), F.col("context").alias("item_context")), ["span", "key"])
    extended = stored(_extended(pairs.select("span", "key", "left", "context", "class_id", "item_left", "item_context")), "extended-prints")
    spans_hit = hits.join(extended, ["span", "key", "left", "context"]).select(
        "id", "row_key", "class_id", (F.col("place") + F.col("from")).alias("from"), (F.col("place") + F.col("to")).alias("to")).distinct()
    spans_hit = stored(spans_hit, "document-hits")
    merged = F.aggregate(
        F.sort_array(F.collect_set(F.struct("from", "to"))), F.expr("struct(cast(0 as bigint) as n, cast(0 as bigint) as reach)"),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(x["from"], acc["reach"]))).cast("long").alias("n"), F.greatest(acc["reach"], x["to"]).alias("reach")),
        lambda acc: acc["n"])
    covered = spans_hit.groupBy("id", "row_key").agg(merged.alias("n_hit"), F.sort_array(F.collect_set(F.struct("from", "to"))).alias("hit_spans"))
    named = spans_hit.select("id", "row_key", "class_id").distinct().join(members, "class_id").groupBy("id", "row_key").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("item_id").isNull().cast("int")).alias("nameless"))
    named = named.select(F.col("id").alias("named_id"), F.col("row_key").alias("named_key"), "item_ids", "nameless")
    outcome = covered.join(named, F.col("id").eqNullSafe(F.col("named_id")) & (F.col("row_key") == F.col("named_key"))).drop("named_id", "named_key")
    outcome = outcome.withColumnsRenamed({"id": "hit_id", "row_key": "hit_key"})
    judged = found.drop("prints").join(outcome, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key")), "left").drop("hit_id", "hit_key")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return judged.select(
        F.col("id").alias("doc_id"), "row_key", "n_words", n_hit.alias("n_hit"), (F.size(item_ids) + F.coalesce("nameless", F.lit(0))).cast("long").alias("n_items"), item_ids.alias("item_ids"),
        F.coalesce("hit_spans", F.array().cast("array<struct<from:bigint,to:bigint>>")).alias("hit_spans"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns as they are."""
    dirty = contamination(docs, benchmark, **options).filter("contaminated").select(F.col("doc_id").alias("dirty_id"), F.col("row_key").alias("dirty_key")).distinct()
    keyed = docs.withColumn("clean_row_key", F.xxhash64("doc_id", "text"))
    return keyed.join(dirty, F.col("doc_id").eqNullSafe(F.col("dirty_id")) & (F.col("clean_row_key") == F.col("dirty_key")), "left_anti").drop("clean_row_key")
