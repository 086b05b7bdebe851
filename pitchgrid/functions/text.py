"""Entity keys, ids and keyword rules on strings."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.settings import NEGATIVE_WORDS, POSITIVE_WORDS, STRUCTURAL_TOKENS


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str]:
    """translate() arguments for Latin letters that decompose to one base character.

    Built from the Unicode database over the Latin-1, Latin Extended-A/B and Latin
    Extended Additional blocks. Combining marks themselves are deleted.
    """
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
    marks = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))
    return "".join(source), "".join(target), marks


def fold_accents(text: Column) -> Column:
    """Strip diacritics inside the JVM (Latin letters)."""
    source, target, marks = _fold_tables()
    return F.translate(text, source + marks, target)


def fold_accents_exact(text: Column) -> Column:
    """Full NFKD folding for any script; Arrow-batched, only where Latin is not enough."""
    @F.pandas_udf("string")
    def nfkd(values: pd.Series) -> pd.Series:
        return values.map(
            lambda s: None if s is None else "".join(
                c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)
            )
        )
    return nfkd(text)


def _words(text: Column) -> Column:
    """Lower-case words without diacritics; '.', '-' and white space separate."""
    plain = F.lower(fold_accents(F.coalesce(text, F.lit(""))))
    return F.split(F.translate(plain, ".-\t\n\r\f\u00a0", "       "), " ")


def entity_key(name: Column) -> Column:
    """Provider-independent key of a team name, before aliases."""
    return F.array_join(F.filter(
        _words(name), lambda w: ~w.isin("", *STRUCTURAL_TOKENS) & ~w.rlike("^[0-9]+$")), " ")


def person_key(name: Column) -> Column:
    return F.array_join(F.filter(_words(name), lambda w: w != ""), " ")


def alias_lookup(aliases: DataFrame) -> DataFrame:
    """The alias table, one row a spelling; Spark broadcasts it where its size allows."""
    return aliases.select(F.col("alias").alias("__alias"), F.col("canonical").alias("__canonical"))


def apply_aliases(df: DataFrame, columns: list[str], aliases: DataFrame | None) -> DataFrame:
    """Replace spellings by their canonical form from ``aliases(alias, canonical)``."""
    if aliases is None:
        return df
    lookup = alias_lookup(aliases)
    for column in columns:
        df = df.join(lookup, F.col(column) == F.col("__alias"), "left").withColumn(
            column, F.coalesce("__canonical", column)).drop("__alias", "__canonical")
    return df


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def prefixed_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), short_hash(key))


def player_id(name: Column, birth_date: Column | None = None, external_id: Column | None = None) -> Column:
    """Strongest evidence first: external id, then name + birth date, then name."""
    key = person_key(name)
    by_name = F.concat(F.lit("name:"), key)
    born = F.lit(None).cast("string") if birth_date is None else birth_date.cast("string")
    ext = F.lit(None).cast("string") if external_id is None else external_id.cast("string")
    return prefixed_id("player", F.coalesce(
        F.concat(F.lit("ext:"), F.nullif(ext, F.lit(""))),
        F.concat(key, F.lit("|"), F.nullif(born, F.lit(""))),
        by_name,
    ))


def content_id(*parts: Column) -> Column:
    """16 hex digits over an ordered JSON array, so separators cannot collide."""
    return short_hash(F.to_json(F.array(*[p.cast("string") for p in parts])))


def direction_of(text: Column) -> Column:
    """'worse' / 'better' / 'same' from word lists; a negative word wins."""
    def any_of(words):
        return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(re.escape(w) for w in words))
    return F.when(any_of(NEGATIVE_WORDS), "worse").when(any_of(POSITIVE_WORDS), "better").otherwise("same")
