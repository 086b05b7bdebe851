"""Glob rules over canonical URLs: one multiword Shift-And automaton runs all rules at once over each URL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.common import arrow_session, utf8

ONE = np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """``pattern``: ``*`` stands for bytes other than ``/``, ``**`` for any bytes; all else is literal."""

    name: str
    pattern: str
    verdict: str
    weight: int  # the heaviest matching rule wins, the earlier one among equals


def host_rule(verdict: str, rule: str) -> Rule:
    """``host/path``: the host, its subdomains, and all paths that start with the rule's."""
    host, slash, path = rule.partition("/")
    return Rule(rule, f"*.{host}{slash}{path}**", verdict, len(rule))


def compile_rules(rules: list[Rule]) -> tuple[np.ndarray, ...]:
    """Masks of the automaton, packed into 64-bit words by descending precedence of the rules.

    A rule takes one bit for its start and one for each literal byte. ``step[c]`` has the bits that byte c reaches from
    the bit below, ``stay[c]`` those that keep their state under c (a star follows them).
    """
    ranked = sorted(range(len(rules)), key=lambda i: (-rules[i].weight, i))
    bits: list[tuple[int | None, int]] = []  # literal byte (None: start) and the star after it: 0 none, 1 not "/", 2 any
    final, owner = [], []
    for i in ranked:
        bits.append((None, 0))
        raw, at = rules[i].pattern.encode(), 0
        while at < len(raw):
            if raw[at] == 0x2A:
                run = len(raw[at:]) - len(raw[at:].lstrip(b"*"))
                bits[-1] = (bits[-1][0], max(bits[-1][1], min(run, 2)))
                at += run
            else:
                bits.append((raw[at], 0))
                at += 1
        final.append(len(bits) - 1)
        owner.append(i)
    words = -(-len(bits) // 64) if bits else 1
    step, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    start, end = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
    for k, (literal, star) in enumerate(bits):
        w, bit = k // 64, ONE << np.uint64(k % 64)
        if literal is None:
            start[w] |= bit
        else:
            step[literal, w] |= bit
        if star:
            stay[:, w] |= bit
            if star == 1:
                stay[0x2F, w] &= ~bit
    for k in final:
        end[k // 64] |= ONE << np.uint64(k % 64)
    return step, stay, start, end, np.array(final, np.int64), np.array(owner, np.int64)


def match_rules(data: np.ndarray, offsets: np.ndarray, masks: tuple[np.ndarray, ...]) -> np.ndarray:
    """The winning rule's number for each text, -1 for none. All texts advance together, a byte a step."""
    step, stay, start, end, final, owner = masks
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    state = np.repeat(start[None, :], len(sizes), axis=0)
    lengths = -sizes[order]
    for i in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(lengths, -i, "left"))  # texts longer than i come first
        byte = data[offsets[order[:live]] + i]
        now = state[:live]
        moved = now << ONE
        moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        state[:live] = (moved & step[byte]) | (now & stay[byte])
    hit = state & end
    out = np.full(len(sizes), -1, np.int64)
    found = hit.any(axis=1)
    rows = np.flatnonzero(found)
    if len(rows):
        word = (hit[rows] != 0).argmax(axis=1)
        value = hit[rows, word]
        low = value & (~value + ONE)
        bit = word * 64 + np.frexp(low.astype(np.float64))[1] - 1
        out[order[rows]] = owner[np.searchsorted(final, bit)]
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with url_host, url_path, url_rule (null: none fits) and url_verdict (``default`` where none fits).

    The canonical URL is ``.`` + host + path, so a rule for a host ends on a label border. Null, empty or malformed
    URLs have an empty host and path and get the default unless a rule fits that. Rows are judged one by one: nothing
    is shuffled and repeated rows or very common hosts cost no more than others. Rules travel with the task.
    Columns of the added names are replaced, others stay.
    """
    arrow_session(pages.sparkSession)
    masks = compile_rules(rules)
    names = np.array([*(r.name for r in rules), None], object)
    verdicts = np.array([*(r.verdict for r in rules), default], object)
    host, path = split_url(F.col(f"`{url}`"))
    pages = pages.drop("url_rule", "url_verdict")
    split = pages.withColumns({"url_host": host, "url_path": path})
    split = split.withColumn("url_canonical", F.concat(F.lit("."), "url_host", "url_path"))
    added = {"url_rule": "string", "url_verdict": "string"}
    kept = [f for f in split.schema.fields if f.name != "url_canonical"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("url_canonical")
            found = match_rules(*utf8(batch.column(at)), masks)
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            columns += [pa.array(names[found], pa.string()), pa.array(verdicts[found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{k} {v}" for k, v in added.items())])
    return split.mapInArrow(run, schema)
