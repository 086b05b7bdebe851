"""Named queries over the given tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.bindings.tables import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Flat, comparable output: rounded doubles, bigint counts, text dates and lists."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType, T.DecimalType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def expand(sql: str) -> str:
    """Write R(expr) for a rounded double in the SQL text."""
    out, i = [], 0
    while i < len(sql):
        j = sql.find("R(", i)
        while j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            j = sql.find("R(", j + 1)
        if j < 0:
            out.append(sql[i:])
            break
        depth, k = 1, j + 2
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = expand(sql[j + 2:k - 1])
        out.append(sql[i:j] + f"(round(({inner})::DOUBLE, 6) + 0.0::DOUBLE)")
        i = k
    return "".join(out)


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)``; ``sql`` is the same result in plain SQL."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: present(fn(spark, sf_dir))
        if sql is not None:
            text = expand(sql)
            ORACLES[name] = with_tables(text, *tables) if tables else text
        return fn
    return wrap
