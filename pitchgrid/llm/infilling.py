"""Fill-in-the-middle by repeated-capture matching: one fullmatch of ``(unit)*`` keeps the end of every unit."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.common import arrow_session, unused

#: A unit of a text: a run of letters, or one other character.
UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: Prefix, suffix and middle marker.
MARKERS = ("<P>", "<S>", "<M>")
#: Code points of a text that are matched at once: a capture takes about 100 bytes a unit.
PIECE = 1 << 20
ADDED = "n_units long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(text: str, pattern, piece: int = PIECE) -> np.ndarray:
    """The end offset of every unit of ``text``.

    All captures of one fullmatch. A text of more than ``piece`` code points is matched in pieces that end with a
    unit, so the memory of the captures stays bounded however long it is.
    """
    if len(text) <= piece:
        return np.array(pattern["all"].fullmatch(text).ends(1), np.int64)
    found, at = [], 0
    while at < len(text):
        stop = min(at + piece, len(text))
        ends = pattern["all"].fullmatch(text, at, stop).ends(1)
        if stop < len(text):  # the last unit may go on: the next piece begins with it
            ends = ends[:-1] or [pattern["one"].match(text, at).end()]
        found.append(np.array(ends, np.int64))
        at = ends[-1]
    return np.concatenate(found)


def patterns(unit: str = UNIT) -> dict:
    import regex

    return {"all": regex.compile(f"({unit})*", regex.DOTALL), "one": regex.compile(unit, regex.DOTALL)}


def rearranged(text: str, key: str, pattern: dict, markers: tuple[str, str, str], plain: int, spm: int, piece: int = PIECE) -> tuple:
    """(number of units, form, prefix and middle length or None, output) of one text."""
    ends = unit_ends(text, pattern, piece)
    n = len(ends)
    digest = sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= 100 - plain or any(m in text for m in markers):
        return n, "plain", None, None, text
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[c - 1]) if c else 0 for c in (one, two))
    p, s, m = markers
    if h4 % 100 < spm:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def fill_in_middle(
    docs: DataFrame, *, seed: int = 1, plain: int = 10, spm: int = 20, unit: str = UNIT, markers: tuple[str, str, str] = MARKERS, piece: int = PIECE,
) -> DataFrame:
    """``docs`` with n_units, form (plain, psm, spm), prefix_chars, middle_chars and output.

    Both cuts, and the draw of the form, come from the sha256 of ``seed:doc_id``, so a rerun or another partitioning
    gives the same output and repeated rows get the same one. ``plain`` and ``spm`` are percentages: texts kept as
    they are, and, of the others, those with the suffix first. A text that is empty or null (then: empty) or holds
    one of ``markers`` stays plain, so that :func:`restore` is exact. A null doc_id counts as an empty id. Lengths are code points,
    null where plain. ``unit`` must match every character. Each row is worked on alone, whatever its length: no
    shuffle. Columns of the added names are replaced; other columns, and rows of any id, stay.
    """
    arrow_session(docs.sparkSession)
    added = [f.split()[0] for f in ADDED.split(", ")]
    kept = docs.drop(*added)
    # The id's decimal text stands at the end of the row, under a name that is not returned.
    rows = kept.select(*(F.col(f"`{c}`") for c in kept.columns), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(unused("key", kept.columns)))
    at, names = kept.columns.index("text"), kept.columns
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = patterns(unit)
        for batch in batches:
            done = [rearranged(t or "", f"{seed}:{k}", pattern, markers, plain, spm, piece) for t, k in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            n, form, prefix, middle, output = zip(*done) if done else ((),) * 5
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:len(names)], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                pa.array(output, pa.string())], names=[*names, *added])

    return rows.mapInArrow(run, fields)


def restore(form: Column, output: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``output`` was made from, rebuilt from it and its form alone."""
    parts = F.split(output, "|".join(re.escape(m) for m in markers), -1)
    psm, spm = (F.concat(*(F.get(parts, F.lit(i)) for i in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
