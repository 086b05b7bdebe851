"""Exact k most similar vectors by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.operators.ordered import top_k
from pitchgrid.shared import cut

SCHEMA = "target string, candidate string, similarity double"
#: Similarities that a task holds at a time.
SIMS = 2_000_000
#: Bytes of vectors that one packed block holds at most.
BLOCK_BYTES = 8_000_000
#: Hits of a target in a block that are worth an exact product each; for more, the whole row is computed.
FEW = 64


def _matrix(vectors) -> np.ndarray:
    return vectors if isinstance(vectors, np.ndarray) and vectors.ndim == 2 else np.asarray([np.asarray(v, dtype=float) for v in vectors], dtype=float)


def _unit(vectors) -> np.ndarray:
    m = _matrix(vectors)
    if m.size == 0:
        return m.reshape(0, 0)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _kept(sims: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row that reach ``least``, ties to the first columns."""
    hit = sims >= least[:, None] - 1e-11
    open_ = np.flatnonzero(hit.sum(axis=1) > k)
    if len(open_):  # values equal after 12 digits count as ties, so blocking cannot reorder them
        near = np.round(sims[open_], 12)
        edge = np.partition(near, -k, axis=1)[:, [-k]]
        over, tie = near > edge, near == edge
        hit[open_] = over | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k - over.sum(axis=1, keepdims=True)))
    return np.nonzero(hit)


def _reach(t_unit, c_unit, k: int, least: np.ndarray, shut):
    """(row, column, similarity) of the k best candidates of each target that reach ``least``, columns in the order of ties.

    Similarities are made in single precision first, SIMS at a time. Their error is bounded, so what cannot reach
    ``least`` is told by them; the others are computed again in double precision. ``shut(rows, columns)`` tells pairs that do not count.
    """
    n, dim = c_unit.shape
    slack = 2 * (dim + 4) * 2.0**-24 + 1e-11  # of a dot product of unit vectors in any order of its sum, their rounding included; doubled
    t32, c32 = t_unit.astype(np.float32), c_unit.astype(np.float32)
    step, groups, parts = max(1, SIMS // max(n, 1)), 16 * k, []
    for i in range(0, len(t_unit), step):
        sims, floor, every = t32[i:i + step] @ c32.T, least[i:i + step].copy(), np.arange(n)
        new = np.flatnonzero(floor <= -1.0)
        if len(new) and n >= 2 * groups:  # the k-th largest of the groups' largest is reached by k candidates
            own = sims[new]
            own[shut((i + new)[:, None], every)] = -np.inf
            most = own[:, :n // groups * groups].reshape(len(new), groups, -1).max(axis=2)
            floor[new] = np.maximum(floor[new], np.partition(most, -k, axis=1)[:, -k] - slack)
        floor -= slack
        some = np.flatnonzero(sims.max(axis=1, initial=-np.inf) >= floor)
        hit = sims[some] >= floor[some, None]
        much = hit.sum(axis=1) > FEW
        if much.any():
            rows = i + some[much]
            sims = t_unit[rows] @ c_unit.T
            sims[shut(rows[:, None], every)] = -np.inf
            at, c = _kept(sims, least[rows], k)
            parts.append((rows[at], c, sims[at, c]))
        at, c = np.nonzero(hit[~much])
        at = i + some[~much][at]
        on = ~shut(at, c)
        at, c = at[on], c[on]
        parts.append((at, c, np.einsum("ij,ij->i", t_unit[at], c_unit[c])))
    at, c, s = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, int), np.empty(0, int), np.empty(0))
    on = s >= least[at] - 1e-11
    at, c, s = at[on], c[on], s[on]
    order = np.lexsort((c, -np.round(s, 12), at))
    at, c, s = at[order], c[order], s[order]
    on = _turn(at) < k
    return at[on], c[on], s[on]


def _turn(at: np.ndarray) -> np.ndarray:
    """The place of each entry among those equal to it, for sorted entries."""
    return np.arange(len(at)) - np.searchsorted(at, at)


def _block_best(t_ids, t_unit, c_ids, c_unit, k: int, same: bool, least=None, cell=None, open_=None) -> pd.DataFrame:
    """Top k candidates of one block per target, ties by candidate id; about SIMS similarities are held at a time. ``row``: the target's place.

    ``least``: similarities below it can be left out, a number a target. With ``cell`` (of each candidate) and ``open_``
    (targets x cells), only candidates in a target's open cells count.
    """
    c_ids, t_ids = np.asarray(c_ids, dtype=object), np.asarray(t_ids, dtype=object)
    by_id = np.argsort(c_ids.astype(str), kind="stable")
    c_ids, c_unit = c_ids[by_id], c_unit[by_id]
    cell = None if cell is None else cell[by_id]
    number = pd.factorize(np.concatenate([c_ids, t_ids]))[0]
    c_number, t_number = number[:len(c_ids)], number[len(c_ids):]

    def shut(at, c):
        own = same & (t_number[at] == c_number[c])
        return own if cell is None else own | ~open_[at, cell[c]]

    at, c, s = _reach(t_unit, c_unit, k, np.full(len(t_ids), -2.0) if least is None else np.asarray(least, float), shut)
    return pd.DataFrame({"target": t_ids[at], "candidate": c_ids[c], "similarity": s, "row": at})


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between unit vectors; a zero vector stands at a right angle to all, which keeps the triangle inequality."""
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0)) if len(a) and len(b) else np.zeros((len(a), len(b)))


@dataclass(frozen=True)
class Cells:
    """Pivots, and of the candidates nearest to each: their number and the smallest and largest angle to it."""

    pivots: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, angles: np.ndarray) -> np.ndarray:
        """Smallest angle that a candidate of each cell can have to vectors at ``angles`` to the pivots; infinite for empty cells."""
        least = np.maximum(0.0, np.maximum(angles - self.high, self.low - angles))
        return np.where(self.counts > 0, least, np.inf)

    def first(self, angles: np.ndarray, need: int) -> np.ndarray:
        """The cells of smallest bound that hold ``need`` candidates together, for each vector."""
        bounds = self.bounds(angles)
        order = np.lexsort((angles, bounds), axis=1)
        held = np.cumsum(self.counts[order], axis=1)
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, (held - self.counts[order] < need) & (self.counts[order] > 0), axis=1)
        return out


def _known(df: DataFrame) -> DataFrame:
    """(id, vec) of the rows that have a cosine: null vectors and such with nulls, NaN or infinities have none."""
    return df.where(F.forall("vec", lambda x: F.abs(x) < float("inf"))).select("id", "vec")


def _encode(m: np.ndarray) -> bytes:
    """The numbers in single precision if that loses nothing, else in double precision."""
    with np.errstate(over="ignore"):
        short = m.astype(np.float32)
    return (short if (short == m).all() else m).tobytes()


def _decode(raw: bytes, shape: tuple[int, int]) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * shape[0] * shape[1] else np.float64).astype(float).reshape(shape)


def _cells(candidates: DataFrame, pivots: int) -> tuple[DataFrame, Cells]:
    """The candidates (id, vec: bytes) with their cell, and the cells; ``pivots`` vectors reach the driver, picked by a hash of the id."""
    known = _known(candidates)
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    centres = _unit([r.vec for r in chosen])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                m = _matrix(f["vec"])
                angles = _angles(_unit(m), centres)
                yield pd.DataFrame({"id": f["id"], "vec": [_encode(v) for v in m], "cell": angles.argmin(axis=1).astype(np.int32), "angle": angles.min(axis=1)})

    counts, low, high = np.zeros(len(chosen), np.int64), np.zeros(len(chosen)), np.zeros(len(chosen))
    if not len(chosen):
        return known.select("id", F.lit(b"").alias("vec"), F.lit(0).alias("cell")), Cells(centres, counts, low, high)
    placed = known.mapInPandas(place, "id string, vec binary, cell int, angle double")
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():
        counts[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
    return placed.select("id", "vec", "cell"), Cells(centres, counts, low, high)


def _aims(targets: DataFrame, cells: Cells, k: int, best: DataFrame | None = None) -> DataFrame:
    """(id, vec: bytes, home, open, kth) a target: its nearest cell and those to look at. These are first the cells of smallest bound that
    hold k candidates besides the target itself; with the ``best`` of those, all other cells whose bound reaches the k-th similarity ``kth``
    (-1 before it is known)."""
    rows = _known(targets)
    if best is not None:
        kth = best.groupBy(F.col("target").alias("id")).agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(-1.0).alias("kth"))
        rows = rows.join(kth, "id", "left")

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            m = _matrix(f["vec"])
            angles = _angles(_unit(m), cells.pivots)
            open_ = cells.first(angles, k + 1)
            kth = f["kth"].fillna(-1.0).to_numpy(float) if "kth" in f else np.full(len(f), -1.0)
            if "kth" in f:
                reach = np.arccos(np.clip(kth, -1.0, 1.0)) + 1e-6
                open_ = ~open_ & (cells.bounds(angles) <= reach[:, None])
            at, cell = np.nonzero(open_)
            yield pd.DataFrame({"id": f["id"], "vec": [_encode(v) for v in m], "home": angles.argmin(axis=1).astype(np.int32),
                                "open": np.split(cell.astype(np.int16), np.cumsum(np.bincount(at, minlength=len(f)))[:-1]), "kth": kth})

    return rows.mapInPandas(go, "id string, vec binary, home int, open array<smallint>, kth double").where(F.size("open") > 0)


def visits(targets: DataFrame, cells: Cells, k: int, best: DataFrame | None = None) -> DataFrame:
    """(id, vec, cell, kth): every cell that a target looks at, see ``_aims``."""
    return _aims(targets, cells, k, best).select("id", "vec", F.explode("open").alias("cell"), "kth")


def _packed(rows: DataFrame, near: str, count: int, cells: Cells, block: int) -> DataFrame:
    """``count`` rows (id, vec, and cell or open and kth) as blocks of at most ``block`` rows, rows of like cells ``near`` together; stored once."""
    dim, wide = cells.pivots.shape[1], len(cells.counts)
    block = max(1, min(block, BLOCK_BYTES // (8 * dim)))
    seek = "open" in rows.columns

    def row(f: pd.DataFrame) -> dict:
        m = np.concatenate([_decode(v, (1, dim)) for v in f["vec"]])
        one = {"ids": f["id"].to_numpy(), "vec": _encode(m)}
        if not seek:
            return one | {"cell": f["cell"].to_numpy(np.int32).tobytes(), "has": np.unique(f["cell"])}
        open_ = np.zeros((len(f), wide), bool)
        open_[np.repeat(np.arange(len(f)), f["open"].map(len)), np.concatenate(f["open"].to_list())] = True
        return one | {"open": np.packbits(open_).tobytes(), "kth": f["kth"].to_numpy(float).tobytes(), "aim": np.flatnonzero(open_.any(axis=0))}

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for f in frames:
            for i in range(0, len(f), block):
                held, size = [*held, f[i:i + block]], size + len(f[i:i + block])
                if size >= block:
                    whole = pd.concat(held)
                    yield pd.DataFrame([row(whole[:block])])
                    held, size = [whole[block:]], size - block
        if size:
            yield pd.DataFrame([row(pd.concat(held))])

    sets = ", open binary, kth binary, aim array<int>" if seek else ", cell binary, has array<int>"
    parts = max(1, math.ceil(count / (0.8 * block)))  # most partitions are a block
    return cut(rows.repartitionByRange(parts, near, F.xxhash64("id", "vec")).mapInPandas(pack, "ids array<string>, vec binary" + sets)
               .withColumn("block", F.monotonically_increasing_id()))


def _look(left: DataFrame, right: DataFrame, cells: Cells, k: int, same: bool, slices: int) -> DataFrame:
    """The k best of every target in its open cells: each block of targets meets every block that has one of them, candidates in ``slices`` tasks.

    The blocks are read where they are stored: no vector is shuffled, and a task holds its slice of the candidates and some pairs of blocks.
    What it has found of a target bounds what it looks for in the next block.
    """
    dim, wide = cells.pivots.shape[1], len(cells.counts)

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = None
        for f in frames:
            for r in f.itertuples(index=False):
                if r.block != block:
                    block, t_ids, n = r.block, r.ids, len(r.ids)
                    t_unit, kth = _unit(_decode(r.vec, (n, dim))), np.frombuffer(r.kth)
                    open_ = np.unpackbits(np.frombuffer(r.open, np.uint8), count=n * wide).reshape(n, wide).astype(bool)
                    top = np.full((n, k), -2.0)  # the similarities found, in rising order
                c_unit, cell = _unit(_decode(r.cvec, (len(r.cids), dim))), np.frombuffer(r.cell, np.int32)
                if (kth > -1.0).all():
                    parts = [(np.flatnonzero(open_[:, r.has].any(axis=1)), np.arange(len(cell)), cell)]
                else:  # cell by cell, where bounds are to be found in open cells
                    parts = [(np.flatnonzero(open_[:, c]), np.flatnonzero(cell == c), None) for c in r.has if open_[:, c].any()]
                for rows, cols, of in parts:
                    got = _block_best(t_ids[rows], t_unit[rows], r.cids[cols], c_unit[cols], k, same, np.maximum(kth, top[:, 0])[rows], of, open_[rows])
                    at = got.pop("row").to_numpy()
                    if len(at):
                        new = np.full((n, k), -2.0)
                        new[rows[at], _turn(at)] = got["similarity"]
                        hit = rows[np.unique(at)]
                        top[hit] = np.sort(np.concatenate([top[hit], new[hit]], axis=1), axis=1)[:, -k:]
                        yield got

    few = left.coalesce(4 * left.sparkSession.sparkContext.defaultParallelism)
    other = right.coalesce(slices).select(F.col("ids").alias("cids"), F.col("vec").alias("cvec"), "cell", "has")
    pairs = few.join(other.hint("shuffle_replicate_nl"), F.arrays_overlap("aim", "has"))
    return pairs.select("block", "ids", "vec", "open", "kth", "cids", "cvec", "cell", "has").mapInPandas(meet, SCHEMA)


def _meet(visits: DataFrame, placed: DataFrame, cells: Cells, k: int, same: bool, block: int, slice_rows: int) -> DataFrame:
    """The k best of every visited (target, cell)."""
    single = visits.select("id", "vec", F.col("cell").cast("int").alias("home"), F.array("cell").alias("open"), "kth")
    count = int(cells.counts.sum())
    return _look(_packed(single, "home", single.count(), cells, block), _packed(placed, "cell", count, cells, block), cells, k, same, math.ceil(count / slice_rows))


def nearest(targets: DataFrame, candidates: DataFrame, k: int, *, same: bool = True,
            block: int = 4000, slice_rows: int = 20_000, pivots: int = 64) -> DataFrame:
    """The k most similar candidates of every target; exact.

    Both inputs have (id string, vec array<double>). Candidates are placed in cells around ``pivots`` of them. The
    triangle inequality of angles bounds how near a cell can come to a target: the cells of smallest bound are looked
    at first, then only those whose bound reaches the k-th similarity found there. Targets and candidates are stored as
    blocks of ``block`` rows, those of a cell together, and meet in pairs of blocks: for any number of either a task holds
    a few blocks, and it reads ``slice_rows`` candidates a pass. Neither vectors nor pairs are multiplied on disk or in a
    shuffle; a task emits what reaches the k-th similarity that it knows, k rows per target and block at most.
    """
    known = cut(_known(candidates))
    own = known if targets is candidates else cut(_known(targets))
    placed, cells = _cells(known, pivots)
    if not len(cells.counts):
        return targets.sparkSession.createDataFrame([], SCHEMA + ", rank int")
    count, many = int(cells.counts.sum()), own.count()
    right, slices = _packed(placed, "cell", count, cells, block), math.ceil(count / slice_rows)
    order = [F.round("similarity", 12).desc(), F.col("candidate")]

    def look(best: DataFrame | None = None) -> DataFrame:
        return _look(_packed(_aims(own, cells, k, best), "home", many, cells, block), right, cells, k, same, slices)

    near = cut(top_k(look(), ["target"], order, k).drop("rank"))
    return top_k(near.unionByName(look(near)), ["target"], order, k)
