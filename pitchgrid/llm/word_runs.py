"""Runs (maximal periodic stretches) of words by maximal pairs of a bottom-up LCP-interval tree."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.common import U64, Words, arrow_session, mix, pieces, space_words, unused, utf8

#: Fewest words of a run, and fewest periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
ADDED = "n_words long, runs array<struct<start:long,length:long,period:long>>, top int, collapsed string"


# --------------------------------------------------------------------------- #
# Suffix order
# --------------------------------------------------------------------------- #
def suffix_ranks(keys: np.ndarray) -> list[np.ndarray]:
    """Ranks of all positions by their first 1, 2, 4, ... keys, until all differ; equal ranks stand for equal keys.

    A rank is the place of the first of its equals in the order, so only positions that still tie are sorted again.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, k = [rank], 1
    alone = fresh & np.append(fresh[1:], True)
    tied = order[~alone]
    while len(tied):
        own, ahead = rank[tied], rank[np.minimum(tied + k, n - 1)]
        again = np.lexsort((ahead, own))
        tied, own, ahead = tied[again], own[again], ahead[again]
        group = np.ones(len(tied), bool)
        group[1:] = own[1:] != own[:-1]
        fresh = group.copy()
        fresh[1:] |= ahead[1:] != ahead[:-1]
        place = np.arange(len(tied))
        inside = place - np.maximum.accumulate(np.where(group, place, 0))
        rank = rank.copy()
        rank[tied] = own + inside[np.maximum.accumulate(np.where(fresh, place, 0))]
        levels.append(rank)
        k *= 2
        tied = tied[~(fresh & np.append(fresh[1:], True))]
    return levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many keys the positions ``a`` and ``b`` have in common, pair by pair."""
    a, b, total, last = a.copy(), b.copy(), np.zeros(len(a), np.int64), len(levels[0]) - 1
    for i in range(len(levels) - 1, -1, -1):
        same = (levels[i][np.minimum(a, last)] == levels[i][np.minimum(b, last)]) & (a != b) & (np.maximum(a, b) <= last)
        step = same.astype(np.int64) << i
        a += step
        b += step
        total += step
    return total


# --------------------------------------------------------------------------- #
# LCP-interval tree
# --------------------------------------------------------------------------- #
class Interval:
    """The positions below a node of the tree, all of them and by the word on their left, each list ascending."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int):
        self.places, self.classes = [place], {left: [place]}

    def absorb(self, other: Interval) -> None:
        def join(into: list[int], more: list[int]) -> None:
            if more[0] > into[-1]:
                into.extend(more)
            elif len(more) == 1:
                insort(into, more[0])
            else:
                into.extend(more)
                into.sort()

        join(self.places, other.places)
        for left, places in other.classes.items():
            if left in self.classes:
                join(self.classes[left], places)
            else:
                self.classes[left] = places


def meet(small: Interval, large: Interval, depth: int, least: int, periods: int, out: list[tuple[int, int, int]]) -> None:
    """Maximal pairs of the two children, whose common prefix is ``depth`` long, as (start, end, distance).

    A pair is right-maximal as its positions stand in different children and left-maximal as their classes differ. Its
    words are a stretch of depth + distance words that repeats every ``distance`` words and can't be longer. Only
    distances that leave ``least`` words and ``periods`` periods are looked up: in the positions nearby or, where
    those are many (a periodic stretch, all but its first position of one class), class by class.
    """
    reach, nearest = depth // (periods - 1), least - depth
    for left, own in small.classes.items():
        for x in own:
            a, b = bisect_left(large.places, x - reach), bisect_right(large.places, x + reach)
            if b - a <= len(large.classes):
                same = large.classes.get(left, ())
                near = large.places[a:b]
                if same:
                    other = set(same[bisect_left(same, x - reach):bisect_right(same, x + reach)])
                    near = [y for y in near if y not in other]
            else:
                near = [y for c, places in large.classes.items() if c != left for y in places[bisect_left(places, x - reach):bisect_right(places, x + reach)]]
            for y in near:
                distance = y - x if y > x else x - y
                if distance >= nearest:
                    start = x if x < y else y
                    out.append((start, start + distance + depth, distance))


def interval_pairs(places: list[int], depths: list[int], lefts: list[int], least: int, periods: int) -> list[tuple[int, int, int]]:
    """Maximal pairs below one interval: ``places`` in suffix order, ``depths[i]`` the common prefix of place i and i + 1.

    Bottom-up: a stack holds the open intervals with rising depths; one is closed as soon as a smaller depth follows.
    """
    out: list[tuple[int, int, int]] = []
    stack, open_depths = [Interval(places[0], lefts[0])], []

    def close(until: int) -> None:
        while open_depths and open_depths[-1] >= until:
            depth, two, one = open_depths.pop(), stack.pop(), stack.pop()
            small, large = (one, two) if len(one.places) < len(two.places) else (two, one)
            meet(small, large, depth, least, periods, out)
            large.absorb(small)
            stack.append(large)

    for place, left, depth in zip(places[1:], lefts[1:], depths):
        close(depth)
        stack.append(Interval(place, left))
        open_depths.append(depth)
    close(0)
    return out


def maximal_pairs(keys: np.ndarray, first: np.ndarray, least: int, periods: int) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of the texts whose words ``keys[first[i]:first[i + 1]]`` are.

    A run needs two occurrences of a word gram of ``least`` - ``least`` // ``periods`` words at a distance of at most a
    ``periods``-th of the text; texts without are left out, and so are all nodes of a smaller depth.
    """
    depth = least - least // periods
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    # Words of different texts never equal each other.
    with np.errstate(over="ignore"):
        own = mix(keys ^ mix((text + 1).astype(np.uint64) * U64(0x9E3779B97F4A7C15)))
        gram, k = own, 1
        while 2 * k <= depth:
            gram = mix(gram[:-k] * U64(0xD6E8FEB86659FD93) + gram[k:]) if len(gram) > k else gram[:0]
            k *= 2
    if not len(gram):
        return np.empty((0, 4), np.int64)
    order = np.argsort(gram, kind="stable")
    a, b = order[:-1], order[1:]
    near = (gram[a] == gram[b]) & (text[a] == text[b]) & (b - a <= n[text[a]] // periods)
    chosen = np.unique(text[a[near]])
    if not len(chosen):
        return np.empty((0, 4), np.int64)
    # The chosen texts one after another, each with an end that equals no other key.
    sizes = n[chosen]
    starts = np.cumsum(sizes + 1) - sizes - 1
    total = int((sizes + 1).sum())
    which = np.repeat(np.arange(len(chosen)), sizes + 1)
    within = np.arange(total) - starts[which]
    ends = within == sizes[which]
    codes = np.unique(own[np.minimum(first[chosen][which] + within, len(own) - 1)], return_inverse=True)[1].astype(np.int64)
    codes[ends] = total + which[ends]
    levels = suffix_ranks(codes)
    suffixes = np.empty(total, np.int64)
    suffixes[levels[-1]] = np.arange(total)
    below = min(int(np.log2(depth)), len(levels) - 1)
    close = np.flatnonzero(levels[below][suffixes[:-1]] == levels[below][suffixes[1:]])
    if not len(close) or len(levels) <= below:
        return np.empty((0, 4), np.int64)
    depths = np.zeros(total, np.int64)
    depths[close] = common_prefix(levels, suffixes[close], suffixes[close + 1])
    depths[depths < depth] = 0
    lefts = np.where(within > 0, np.concatenate([[-1], codes[:-1]]), -1)
    # Stretches of the order whose neighbours share ``depth`` words are subtrees.
    inside = depths > 0
    begin = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    stop = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 2
    pair = stop - begin == 2
    x, y, d = suffixes[begin[pair]], suffixes[begin[pair] + 1], depths[begin[pair]]
    distance = np.abs(x - y)
    good = (distance * (periods - 1) <= d) & (distance + d >= least) & (lefts[x] != lefts[y])
    low = np.minimum(x, y)[good]
    found = [np.stack([low, low + (distance + d)[good], distance[good]], axis=1)]
    for i, j in zip(begin[~pair], stop[~pair]):
        places = suffixes[i:j]
        if rows := interval_pairs(places.tolist(), depths[i:j - 1].tolist(), lefts[places].tolist(), least, periods):
            found.append(np.array(rows, np.int64))
    rows = np.concatenate(found)
    # Multiples of a period give the same stretch.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    start, end, period = rows[keep].T
    return np.stack([chosen[which[start]], within[start], end - start, period], axis=1)


# --------------------------------------------------------------------------- #
# Texts
# --------------------------------------------------------------------------- #
def repeated_from(n: int, seed: int) -> np.ndarray:
    """Word numbers of a text of ``n`` words whose end is made periodic: where it starts and how long a period is come from ``seed``."""
    a = seed % n
    p = 1 + (n - a) // (3 + seed % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts of the words with the numbers ``words[first[i]:first[i + 1]]``, joined by one space."""
    sizes = ends[words] - starts[words]
    lead = np.ones(len(words), np.int64)  # the space before a word, but for the first of a text
    lead[first[:-1][np.diff(first) > 0]] = 0
    upto = np.concatenate([[0], np.cumsum(sizes + lead)])
    out = np.full(int(upto[-1]), 0x20, np.uint8)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at + np.repeat(upto[:-1] + lead, sizes)] = data[at + np.repeat(starts[words], sizes)]
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(upto[first].astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def best_run(length: np.ndarray, period: np.ndarray) -> int:
    """The first of the runs with the largest exact length / period; runs come by start, then period."""
    best = 0
    for i in range(1, len(length)):
        if int(length[i]) * int(period[best]) > int(length[best]) * int(period[i]):
            best = i
    return best


def collapse(texts: pa.Array, seeds: pa.Array, words: Words, least: int, periods: int) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """n_words, runs, top and collapsed of a batch of texts."""
    data, offsets = utf8(texts)
    counts, tops, out, found = [], [], [], []
    seeds = seeds.to_pylist()
    for i, j in pieces(offsets):
        part = data[offsets[i]:offsets[j]]
        starts, ends, hashed, first = words.hashes(part, offsets[i:j + 1] - offsets[i])
        own = np.arange(len(starts))
        n = np.diff(first)
        for t in range(j - i):
            if seeds[i + t] is not None and n[t]:
                own[first[t]:first[t + 1]] = first[t] + repeated_from(int(n[t]), seeds[i + t])
        runs = maximal_pairs(hashed[own], first, least, periods)
        runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
        # A word is dropped where more runs have begun (after their first period) than have ended.
        change = np.zeros(len(own) + 1, np.int64)
        np.add.at(change, first[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
        np.add.at(change, first[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
        kept = np.cumsum(change[:-1]) == 0
        out.append(joined(part, starts, ends, own[kept], np.concatenate([[0], np.cumsum(kept)])[first]))
        counts.append(n)
        bounds = np.searchsorted(runs[:, 0], np.arange(j - i + 1))
        tops += [best_run(runs[a:b, 2], runs[a:b, 3]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:])]
        found.append((np.diff(bounds), runs))
    n_runs = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
    runs = np.concatenate([f[1] for f in found]) if found else np.empty((0, 4), np.int64)
    items = pa.StructArray.from_arrays([pa.array(runs[:, c], pa.int64()) for c in (1, 2, 3)], names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_runs)]), pa.int32()), items)
    return (pa.array(np.concatenate(counts) if counts else [], pa.int64()), lists, pa.array(tops, pa.int32()),
            pa.concat_arrays(out) if out else pa.array([], pa.string()))


def find_runs(docs: DataFrame, *, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, repeat_seed: Column | None = None) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period; by start, then period), top and collapsed.

    A run is a stretch of at least ``least`` words and ``periods`` (two or more) periods that no neighbouring word
    extends, with its smallest period. ``top`` is the place in ``runs`` of the one with the largest length / period (ties: the
    first). ``collapsed`` holds the words that no run contains after its first period, joined by one space. Words
    ``[^\\x20\\x09-\\x0D]+`` are compared by 64-bit hashes. Where ``repeat_seed`` is not null, the end of the text is
    first made periodic (:func:`repeated_from`): planted cases for tests.

    Every text is worked on alone, whole, in memory of a fixed multiple of its length: no shuffle. A null or empty text has no
    words, no runs, a null ``top`` and an empty ``collapsed``. Columns of the added names are replaced; other columns, repeated
    rows, and rows of any id, stay.
    """
    if periods < 2:
        raise ValueError("a run has two periods at least")
    arrow_session(docs.sparkSession)
    added = [f.split()[0] for f in ADDED.replace("runs array<struct<start:long,length:long,period:long>>", "runs x").split(", ")]
    seed = F.lit(None).cast("long") if repeat_seed is None else repeat_seed.cast("long")
    kept = docs.drop(*added)
    names, at = kept.columns, kept.columns.index("text")
    rows = kept.select(*(F.col(f"`{c}`") for c in names), seed.alias(unused("seed", names)))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(space_words(), lower=False)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], *collapse(batch.column(at), batch.column(len(names)), words, least, periods)], names=[*names, *added])

    return rows.mapInArrow(run, fields)
