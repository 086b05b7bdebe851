"""Tables whose matches are replaced one by one: new files beside the old ones, and a version that names those in use.

A table's folder has ``data/write=<id>/`` with Parquet files by (group columns, bucket of the match) and ``versions/v=<n>/``
with the folders that make up version n. A reader takes the greatest finished version, so a write that is killed changes
nothing: its files are not named anywhere, and running it again gives the same table.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.operators.ordered import multiset_digest
from pitchgrid.shared import cut

BUCKET = "match_bucket"


def _numbers(spark: SparkSession, path: str, mark: str = "/_SUCCESS") -> list[int]:
    """Numbers of the versions that were written to the end; with no ``mark``, those begun too."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/v=*{mark}")) or []
    return sorted(int((f.getPath().getParent() if mark else f.getPath()).getName()[2:]) for f in found)


def parts(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """Group columns, bucket, folder and row schema of each part of a version (None: the newest); None if there is no table."""
    known = _numbers(spark, path)
    if version is None and not known:
        return None
    return spark.read.parquet(f"{path}/versions/v={known[-1] if version is None else version:09d}")


def _in(rows: DataFrame, keys: DataFrame, names: list[str], how: str) -> DataFrame:
    """Semi or anti join on columns that may be null."""
    same = [rows[c].eqNullSafe(keys[c]) for c in names]
    return rows.join(keys, reduce(lambda x, y: x & y, same), how)


def _rows(spark: SparkSession, path: str, listed: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the listed parts; the list is as long as the table has parts, not rows."""
    folders = listed.groupBy("folder").agg(F.any_value("row_schema").alias("schema")).orderBy("folder").collect()
    kept = listed.select(*by, BUCKET, F.substring_index("folder", "=", -1).alias("write"))
    schema = T.StructType.fromJson(json.loads(folders[0].schema)).add("write", "string")
    rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/{r.folder}" for r in folders])
    return _in(rows, F.broadcast(kept), [*by, BUCKET, "write"], "left_semi").drop("write")


def read(spark: SparkSession, path: str, by: list[str], version: int | None = None) -> DataFrame:
    """The rows of a version, without the bucket."""
    listed = parts(spark, path, version)
    if listed is None or listed.isEmpty():
        raise FileNotFoundError(f"no rows in a finished version of {path}")
    return _rows(spark, path, listed, by).drop(BUCKET)


def replace_matches(rows: DataFrame, path: str, by: list[str], *, buckets: int = 64) -> int:
    """A new version in which ``rows`` (match_id and the columns ``by``, competition say) stand for all earlier rows of their matches.

    Only the parts (``by``, bucket) that hold such a match, or get one, are written anew, with the other matches' rows
    as they are; all others stay where they are. A match that comes with other ``by`` values leaves its old part too.
    ``buckets`` is the table's and must not change, and rows have the table's columns and no null match_id. Returns the version's number;
    two writers of the same number cannot both finish.
    """
    spark = rows.sparkSession
    placed = rows.withColumn(BUCKET, F.pmod(F.xxhash64("match_id"), F.lit(buckets)).cast("int"))
    listed = parts(spark, path)
    number = max(_numbers(spark, path, ""), default=-1) + 1
    new, touched, own = placed, None, [*by, BUCKET]
    if listed is not None and not listed.isEmpty():
        placed = cut(placed)    # read for its matches, its parts and its rows
        new = placed
        old = _rows(spark, path, listed, by)
        ids = placed.select("match_id", BUCKET).distinct()
        # Parts that hold one of the matches now, and those that will: a row a part.
        touched = cut(old.join(ids, ["match_id", BUCKET], "left_semi").select(*own).unionByName(placed.select(*own)).distinct())
        inside = _in(old, F.broadcast(touched), own, "left_semi")
        new = inside.join(ids, ["match_id", BUCKET], "left_anti").select(*placed.columns).unionByName(placed)
    folder = f"write=w{uuid.uuid4().hex}"
    new.repartition(*own, F.pmod(F.xxhash64("match_id", F.lit(1)), F.lit(4))).write.partitionBy(*own).parquet(f"{path}/data/{folder}")
    written = spark.read.schema(new.schema).parquet(f"{path}/data/{folder}").select(*own).distinct()
    written = written.withColumn("folder", F.lit(folder)).withColumn("row_schema", F.lit(new.schema.json()))
    if touched is not None:
        written = _in(listed, touched, own, "left_anti").select(*written.columns).unionByName(written)
    written.coalesce(1).write.parquet(f"{path}/versions/v={number:09d}")
    return number


def fingerprints(inputs: DataFrame, fields: list[Column], code: str) -> DataFrame:
    """match_id and fingerprint: a digest of the rows a match is derived from and of the derivation's version ``code``."""
    digest = multiset_digest(inputs, ["match_id"], fields)
    return digest.select("match_id", F.substring(F.sha2(F.concat_ws("|", F.lit(code), "digest"), 256), 1, 16).alias("fingerprint"))


def stale(current: DataFrame, derived: DataFrame | None, *, rebuild: bool = False) -> DataFrame:
    """Matches of ``current`` fingerprints whose derived rows are missing or come from other inputs or code; all when rebuilding."""
    if rebuild or derived is None:
        return current
    have = derived.select("match_id", "fingerprint").distinct()
    return current.join(have, ["match_id", "fingerprint"], "left_anti")
