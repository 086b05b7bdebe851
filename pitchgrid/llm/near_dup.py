"""Near duplicates by an inverted join over signature coordinates, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.common import U64, Words, arrow_session, grams, mix, pieces, random_u64, space_words, stored, utf8
from pitchgrid.llm.components import components

#: Coordinates of a signature and min-hashes in each: at a similarity of s a coordinate agrees with probability s^5.
COORDINATES, HASHES = 40, 5
#: Of the pairs just as similar as asked for, at most this share may agree in fewer coordinates than are asked for.
MISSED = 1e-5
#: Members of a block, and members of other blocks that stand in each.
BLOCK, ANCHORS = 128, 16
#: Ids (8 bytes each) up to which a checked list is broadcast; a longer one is joined.
BROADCAST_IDS = 4_000_000


def matches_for(percent: int) -> int:
    """Coordinates that a pair must share: the most, up to three, that lose no more than MISSED."""
    p = (percent / 100) ** HASHES
    below = lambda m: sum(comb(COORDINATES, i) * p ** i * (1 - p) ** (COORDINATES - i) for i in range(m))
    return max(m for m in (1, 2, 3) if m == 1 or below(m) <= MISSED)


def shingle_sets(texts: pa.Array, words: Words, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes | None]]]:
    """Runs of texts: distinct shingle hashes (sorted within each text), first shingle of each text, keys of the word sequences.

    Shingles are ``shingle`` lower-cased words in a row, or the whole of a shorter text; a text without words has none and no key.
    """
    data, offsets = utf8(texts)
    for i, j in pieces(offsets):
        own = offsets[i:j + 1] - offsets[i]
        _, _, hashed, first = words.hashes(data[offsets[i]:offsets[j]], own)
        n = np.diff(first)
        row = np.repeat(np.arange(j - i), n)
        runs = grams(hashed, shingle)
        whole = row[:len(runs)] == row[shingle - 1:] if len(runs) else np.zeros(0, bool)
        short = np.flatnonzero((n > 0) & (n < shingle))
        extra = np.array([mix(grams(hashed[first[r]:first[r + 1]], int(n[r])) + U64(n[r]))[0] for r in short], np.uint64)
        values, rows = np.concatenate([runs[whole], extra]), np.concatenate([row[:len(runs)][whole], short])
        order = np.lexsort((values, rows))
        values, rows = values[order], rows[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        keys = [blake2b(hashed[first[r]:first[r + 1]].tobytes(), digest_size=16).digest() if n[r] else None for r in range(j - i)]
        yield values[fresh], np.searchsorted(rows[fresh], np.arange(j - i + 1)), keys


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """COORDINATES numbers per text with shingles (texts without any are left out): hashes of HASHES min-hashes each."""
    full = first[:-1][np.diff(first) > 0]
    if not len(full):
        return np.empty((0, COORDINATES), np.uint64)
    base = (values >> U64(32)).astype(np.uint32)
    salt = random_u64(COORDINATES * HASHES, 23)
    out = np.empty((len(full), COORDINATES), np.uint64)
    with np.errstate(over="ignore"):
        for c in range(COORDINATES):
            code = np.full(len(full), c, np.uint64)
            for s in salt[c * HASHES:(c + 1) * HASHES]:
                low = np.minimum.reduceat(base * np.uint32((s >> U64(32)) | U64(1)) + np.uint32(s & U64(0xFFFFFFFF)), full)
                code = mix(code * U64(0x9E3779B97F4A7C15) + low)
            out[:, c] = code
    return out


def _sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, words_key (null without words) and the signature's coordinates."""
    arrow_session(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(space_words())
        for batch in batches:
            sizes, keys, coordinates = [], [], []
            for values, first, own in shingle_sets(batch.column(1), words, shingle):
                n = np.diff(first)
                signed = iter(signatures(values, first))
                coordinates += [next(signed).tobytes() if x else None for x in n]
                sizes += n.tolist()
                keys += own
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(coordinates, pa.binary())], names=["doc_id", "n_shingles", "words_key", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, words_key binary, signature binary")


def _posted(sketches: DataFrame, matches: int) -> DataFrame:
    """A row for each coordinate of the prefix: pairs that share ``matches`` of all share one of these."""
    prefix = COORDINATES - matches + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, COORDINATES)[:, :prefix]
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(codes.ravel()), pa.array(np.repeat(docs, prefix))], names=["code", "doc"])

    return sketches.select("doc_id", "signature").mapInArrow(run, "code long, doc long")


def _full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """The shingle sets of the documents in ``ids`` (id, one row each), from their whole texts."""
    few = ids.count() <= BROADCAST_IDS
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(space_words())
        for batch in batches:
            sets, signs = [], []
            for values, first, _ in shingle_sets(batch.column(1), words, shingle):
                signed = iter(signatures(values, first))
                for a, b in zip(first[:-1], first[1:]):
                    sets.append(values[a:b].tobytes())
                    signs.append(next(signed).tobytes() if b > a else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), pa.array(signs, pa.binary())], names=["id", "shingles", "signature"])

    return chosen.mapInArrow(run, "id long, shingles binary, signature binary")


def retained(left: np.ndarray, right: np.ndarray, matches: int) -> np.ndarray:
    """Which pairs of rows of two blocks of signatures agree in ``matches`` coordinates or more."""
    count = np.zeros((len(left), len(right)), np.int16)
    for c in range(COORDINATES):
        count += left[:, c, None] == right[None, :, c]
    return count >= matches


def confirmed(ids: list, signs: list, sets: list, group: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links within one block that join what ``group`` does not yet join: a spanning forest, exact on full sets.

    Members of side 0 meet those of side 1 only, members of side 2 each other.

    Postings of the block are merged by counting agreeing coordinates of all pairs at once. Retained pairs of
    different groups and of sizes that can reach the similarity are compared set by set, skipping pairs that links
    found meanwhile have joined.
    """
    sketch = np.frombuffer(b"".join(signs), np.uint64).reshape(-1, COORDINATES)
    values = [np.frombuffer(s, np.uint64) for s in sets]
    size = np.array([len(v) for v in values], np.int64)
    near = retained(sketch, sketch, matches_for(percent))
    near &= (100 * size[:, None] >= percent * size[None, :]) & (100 * size[None, :] >= percent * size[:, None])
    near &= (group[:, None] != group[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] == 2))
    parent = {g: g for g in group.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    rows = group.tolist()
    for i, j in np.argwhere(np.triu(near, 1)).tolist():
        a, b = root(rows[i]), root(rows[j])
        if a == b:
            continue
        both = len(np.intersect1d(values[i], values[j], assume_unique=True))
        if 100 * both >= percent * (len(values[i]) + len(values[j]) - both):
            parent[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j]))
    return out


def _block_links(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links of all blocks; ``rows`` has ``keys`` (longs, one block each), id, part, side, shingles and signature."""
    arrow_session(rows.sparkSession)
    dealt = rows.select(*keys, "id", "part", "side", "shingles", "signature").repartition(*keys).sortWithinPartitions(*keys, "id")

    def links(held: list) -> list[tuple[int, int]]:
        held = list({h[0]: h for h in held}.values())
        return confirmed([h[0] for h in held], [h[4] for h in held], [h[3] for h in held], *(np.array([h[k] for h in held], np.int64) for k in (1, 2)), percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for *own, i, part, side, shingles, sign in zip(*cols):
                if own != key:
                    if len(held) > 1:
                        out += links(held)
                    key, held = own, []
                held.append((i, part, side, shingles, sign))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
                out = []
        if len(held) > 1:
            out += links(held)
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def duplicate_groups(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of all documents: the smallest doc_id reachable over links of a Jaccard
    similarity of at least ``percent`` hundredths between shingle sets.

    1. Texts with equal word sequences form a class; its smallest id stands for it from here on.
    2. Every class is posted under the coordinate values of its signature's prefix. A posting names its smallest
       member; (member, smallest member) edges, not pairs, leave the postings. Their components, the cohorts, contain
       every pair that shares a posting.
    3. Cohorts are cut into blocks of about BLOCK members by a hash, each with up to ANCHORS of the members that most
       postings name. In a block all pairs' agreeing coordinates are counted; those of enough matches (matches_for) are confirmed on
       full sets, skipping what is joined already; a spanning forest of links leaves the block.
    4. In cohorts of several blocks that are not one component yet, blocks of different components meet pairwise; blocks
       of one component do not. So a group of copies costs about its size, not its square, and no link is left out.

    Null, empty and wordless texts have no shingles and their own id. Rows that repeat a doc_id with the same words
    count as one document; doc_ids are taken to be unique otherwise, and rows without one are left out. An empty table
    gives an empty table. Other columns are not looked at.
    """
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    sketches = stored(_sketched(docs, shingle), "sketches")
    worded = sketches.filter("words_key is not null")
    classes = worded.groupBy("words_key").agg(F.min("doc_id").alias("rep"))
    classes = stored(classes, "classes")
    reps = worded.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    posts = stored(_posted(reps, matches_for(percent)), "posts")
    shared = posts.groupBy("code").agg(F.min("doc").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    stars = posts.join(shared, "code").filter("doc <> pivot").groupBy("doc", "pivot").agg(F.count("*").alias("collisions"))
    stars = stored(stars, "stars")
    cohorts = components(stars.select(F.col("doc").alias("a"), F.col("pivot").alias("b"))).select(F.col("node").alias("id"), F.col("component").alias("cohort"))
    cohorts = stored(cohorts, "cohorts")
    sets = stored(_full_sets(docs, cohorts.select("id"), shingle).dropDuplicates(["id"]), "shingle-sets")
    sizes = stored(cohorts.groupBy("cohort").agg(F.count("*").alias("members")).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("long")), "cohort-sizes")
    members = cohorts.join(sizes, "cohort").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    named = stars.groupBy(F.col("pivot").alias("id")).agg(F.sum("collisions").alias("times")).join(members.filter("blocks > 1"), "id")
    anchors = named.groupBy("cohort", "blocks", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(ANCHORS)).alias("place")).agg(F.max_by("id", F.struct("times", "id")).alias("id"))
    copies = anchors.select("cohort", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id")
    placed = members.select("cohort", "block", "id").union(copies).distinct()
    inner = stored(_block_links(placed.join(sets, "id").withColumns({"part": F.col("id"), "side": F.lit(2)}), ["cohort", "block"], percent), "inner-links")
    parts = stored(components(inner), "inner-parts")
    large = members.filter("blocks > 1").select("cohort", "id").join(parts.withColumnRenamed("node", "id"), "id", "left")
    large = stored(large.select("cohort", "id", F.coalesce("component", "id").alias("part")), "large-cohorts")
    counts = large.groupBy("cohort", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("own", F.col("n") >= BLOCK // 2)
    # Large parts have blocks of their own; small ones share blocks.
    small = counts.filter("not own").groupBy("cohort").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("bundles"))
    where = counts.join(small, "cohort", "left").select(
        "cohort", "part", F.when(F.col("own"), F.col("part")).otherwise(-1).alias("home"),
        F.when(F.col("own"), F.ceil(F.col("n") / BLOCK)).otherwise(F.col("bundles")).cast("long").alias("width"), "own")
    where = stored(where, "part-blocks")
    tile = F.when(F.col("own"), F.pmod(F.xxhash64("id"), "width")).otherwise(F.pmod(F.xxhash64("part"), "width"))
    tiled = stored(large.join(where, ["cohort", "part"]).select("cohort", "id", "part", "home", tile.alias("tile")), "tiles")
    tiles = where.select("cohort", "home", "width").distinct().select("cohort", "home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("tile"))
    one, two = tiles.toDF("cohort", "home", "tile"), tiles.toDF("cohort", "home2", "tile2")
    meet = one.join(two, "cohort").filter("home < home2 or (home = -1 and home2 = -1 and tile <= tile2)")
    meet = meet.withColumn("pair", F.xxhash64("cohort", "home", "tile", "home2", "tile2"))
    itself = (F.col("home") == F.col("home2")) & (F.col("tile") == F.col("tile2"))
    left = meet.select("cohort", "home", "tile", "pair", F.when(itself, 2).otherwise(0).alias("side"))
    seats = left.union(meet.filter(~itself).select("cohort", "home2", "tile2", "pair", F.lit(1)))
    outer = _block_links(tiled.join(seats, ["cohort", "home", "tile"]).select("cohort", "pair", "id", "part", "side").join(sets, "id"), ["cohort", "pair"], percent)
    joined = components(inner.union(outer)).select(F.col("node").alias("rep"), "component")
    resolved = classes.join(joined, "rep", "left").select("words_key", F.coalesce("component", "rep").alias("component_id"))
    return sketches.join(resolved, "words_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The row with the smallest doc_id of each group; columns as they are, rows without a doc_id stay."""
    kept = duplicate_groups(docs, **options).filter("doc_id <> component_id").select(F.col("doc_id").alias("near_dup_copy")).distinct()
    return docs.join(kept, F.col("doc_id") == F.col("near_dup_copy"), "left_anti")
