"""Histogram sort: near equal shards of a total order, found from exact byte counts below candidate boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.llm.common import arrow_session, stored

#: Probes between the known neighbours of each boundary that is still open, in one round.
PROBES = 64
#: A 64-bit key needs 11 rounds and a 64-bit id as many more at 6 bits a round; the ranges seen in the data need fewer.
MAX_ROUNDS = 40


def bins_of(hashes: np.ndarray, ids: np.ndarray, probe_h: np.ndarray, probe_id: np.ndarray) -> np.ndarray:
    """Number of probes at or below each (hash, id); the probes are sorted pairs."""
    left, right = np.searchsorted(probe_h, hashes, "left"), np.searchsorted(probe_h, hashes, "right")
    tied = np.flatnonzero(right > left)
    out = left
    if len(tied):
        for h in np.unique(hashes[tied]):
            rows = tied[hashes[tied] == h]
            a, b = int(left[rows[0]]), int(right[rows[0]])
            out[rows] = a + np.searchsorted(probe_id[a:b], ids[rows], "right")
    return out


def _binned(keys: DataFrame, probes: list[tuple[int, int]], columns: dict[str, list[int]] | None = None) -> DataFrame:
    """``keys`` with the number of its bin, and values of that bin."""
    probe_h = np.array([p[0] for p in probes], np.int64)
    probe_id = np.array([p[1] for p in probes], np.int64)
    tables = {k: np.array(v, np.int64) for k, v in (columns or {}).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = bins_of(batch.column("sort_key").to_numpy(zero_copy_only=False), batch.column("sort_id").to_numpy(zero_copy_only=False), probe_h, probe_id)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n, pa.int64()), *(pa.array(t[n], pa.int64()) for t in tables.values())],
                names=[*batch.schema.names, "bin", *tables])

    return keys.mapInArrow(run, T.StructType([*keys.schema.fields, *(T.StructField(k, T.LongType()) for k in ("bin", *tables))]))


class _Known:
    """Exact weight and rows below each boundary counted so far, and the open interval around each target."""

    def __init__(self, total: int, rows: int, low: tuple[int, int], high: tuple[int, int], id_low: int, id_high: int):
        self.span = id_high - id_low + 1
        self.id_low = id_low
        self.points = {self.pack(low): (0, 0), self.pack(high) + 1: (total, rows)}

    def pack(self, key: tuple[int, int]) -> int:
        return key[0] * self.span + (key[1] - self.id_low)

    def unpack(self, packed: int) -> tuple[int, int]:
        h, i = divmod(packed, self.span)
        return h, i + self.id_low

    def around(self, target: float, which: int) -> tuple[int, int]:
        points = sorted(self.points)
        at = next(i for i, p in enumerate(points) if self.points[p][which] >= target or i == len(points) - 1)
        return points[max(0, at - 1)], points[at]

    def best(self, target: float, which: int) -> int:
        a, b = self.around(target, which)
        return a if target - self.points[a][which] < self.points[b][which] - target else b


def histogram_shards(rows: DataFrame, shards: int, *, weight: str, sort_key: str, sort_id: str, tolerance: float = 0.01, bin_rows: int = 1_000_000) -> DataFrame:
    """Rows with ``shard`` and gapless ``slot``: shards are ranges of the order (sort_key, sort_id) of near equal weight.

    Each round counts, in one job, the exact weight and rows between candidate boundaries on all partitions (partial
    sums, at most a few thousand bins reach the driver). Probes then go only between the neighbours of boundaries that
    are not within ``tolerance`` of a shard's weight. Further boundaries by rows cut a shard into bins of about
    ``bin_rows``, so no task sorts a whole shard; all rows move once, to their bin, whose first slot is known exactly.

    Rows of one key stay together unless that key alone exceeds the tolerance; then its rows are divided by id, so a
    key that holds a third of all rows is spread as well. Keys and ids are longs; a null counts as the smallest long
    for both, a null weight as 0. Rows that tie in both columns share a bin; their order is open, not their number.
    An empty table gives an empty table. Other columns are carried along, whatever their names; columns called shard and
    slot are replaced.
    """
    spark = rows.sparkSession
    arrow_session(spark)
    smallest = F.lit(-(2**63)).cast("long")
    own = [f"row.`{c}`" for c in rows.columns if c not in ("shard", "slot")]
    keys = rows.select(
        F.struct("*").alias("row"), F.coalesce(F.col(sort_key), smallest).alias("sort_key"), F.coalesce(F.col(sort_id), smallest).alias("sort_id"),
        F.coalesce(F.col(weight), F.lit(0)).cast("long").alias("sort_weight"))
    keys = stored(keys, "shard-keys")
    lean = keys.select("sort_key", "sort_id", "sort_weight")
    measures = (
        F.sum("sort_weight").alias("w"), F.count("*").alias("n"), F.min(F.struct("sort_key", "sort_id")).alias("low"),
        F.max(F.struct("sort_key", "sort_id")).alias("high"))
    whole = lean.agg(*measures, F.min("sort_id").alias("id_low"), F.max("sort_id").alias("id_high")).first()
    if not whole.n:
        return keys.select(*own, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    known = _Known(whole.w, whole.n, tuple(whole.low), tuple(whole.high), whole.id_low, whole.id_high)
    cuts = max(1, -(-whole.n // bin_rows))
    targets = [(0, i * whole.w / shards, tolerance * whole.w / shards) for i in range(1, shards)]
    targets += [(1, i * whole.n / cuts, 0.2 * whole.n / cuts) for i in range(1, cuts)]
    for _ in range(MAX_ROUNDS):
        probes = set()
        for which, target, slack in targets:
            a, b = known.around(target, which)
            if min(target - known.points[a][which], known.points[b][which] - target) > slack and b - a > 1:
                probes.update(a + (b - a) * i // (PROBES + 1) for i in range(1, PROBES + 1))
        probes = sorted(probes - known.points.keys())
        if not probes:
            break
        border = sorted(known.points.keys() | set(probes))
        counted = {r.bin: r for r in _binned(lean, [known.unpack(p) for p in border]).groupBy("bin").agg(*measures).collect()}
        below, points = (0, 0), {}
        for i, p in enumerate(border):
            r = counted.get(i)
            below = (below[0] + (r.w if r else 0), below[1] + (r.n if r else 0))
            points[p] = below
        for i in range(1, len(border)):
            if r := counted.get(i):  # the range of keys that exist between two boundaries is all that the next probes need
                points.setdefault(known.pack(tuple(r.low)), points[border[i - 1]])
                points.setdefault(known.pack(tuple(r.high)) + 1, points[border[i]])
        keep = {q for which, target, _ in targets for q in _neighbours(points, target, which)} | {min(points), max(points)}
        known.points = {p: points[p] for p in keep}
    shard_cuts = [known.best(t, 0) for which, t, _ in targets if which == 0]
    row_cuts = [known.best(t, 1) for which, t, _ in targets if which == 1]
    edges = sorted({*shard_cuts, *row_cuts})
    shard_of = [0, *(sum(c <= e for c in shard_cuts) for e in edges)]
    first_row = [0, *(known.points[e][1] for e in edges)]
    start = {}
    for s, r in zip(shard_of, first_row):
        start.setdefault(s, r)
    slots = [r - start[s] for s, r in zip(shard_of, first_row)]
    placed = _binned(keys, [known.unpack(e) for e in edges], {"shard_no": shard_of, "first_slot": slots})
    order = Window.partitionBy("bin").orderBy("sort_key", "sort_id")
    return placed.select(
        "row", F.col("shard_no").cast("int").alias("shard"), (F.col("first_slot") + F.row_number().over(order) - 1).alias("slot")).select(*own, "shard", "slot")


def _neighbours(points: dict, target: float, which: int) -> tuple[int, int]:
    order = sorted(points)
    low, high = order[0], order[-1]
    for p in order:
        if points[p][which] < target:
            low = p
        elif points[p][which] >= target:
            high = p
            break
    return low, high


def text_shards(docs: DataFrame, shards: int = 16, **options) -> DataFrame:
    """Documents with size, text_crc32, shard and slot; equal texts are neighbours in the order.

    The order is (hash of the text, doc_id): it mixes sources over the shards, keeps copies side by side and lets a
    group of copies larger than a shard be divided. A null text has size 1 and crc 0, like an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.withColumns({
        "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary")),
        "text_key": F.xxhash64(text)})
    return histogram_shards(sized, shards, weight="size", sort_key="text_key", sort_id="doc_id", **options)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within each file."""
    sharded.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
