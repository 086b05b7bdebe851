"""Repeated-capture cuts against an iterated matcher, exact round trips, and odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pitchgrid.llm import infilling


def plain_version(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    one, two, three = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(one), len(two), f"<S>{three}<P>{one}<M>{two}"
    return len(units), "psm", len(one), len(two), f"<P>{one}<S>{three}<M>{two}"


def texts():
    rnd = random.Random(3)
    rows = [None, "", " ", "a", "é", "<", "<P>", "x<S>y", "a <M", "P>", "\r\n\t", "𝔘nicode \U0001f600 mixed", "word " * 3, "日本語 text"]
    rows += ["".join(rnd.choice(["ab", "c", " ", "\n", "é", "<", ">", "P", "1"]) for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    return [*rows, "Long word and, more. " * 20_000, "a" * 100_000, *rows[:20]]


def test_cuts_match_an_iterated_matcher_and_restore(spark):
    rows = [(i if i != 7 else None, t, "kept", 5) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, extra int")
    done = infilling.fill_in_middle(docs)
    assert done.columns == ["doc_id", "text", "extra", "n_units", "form", "prefix_chars", "middle_chars", "output"]
    got = done.withColumn("back", infilling.restore(F.col("form"), F.col("output"))).collect()
    expected = [(i, t, *plain_version(i, t), t or "") for i, t, _, _ in rows]
    assert sorted(((r.doc_id, r.text, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=str) == sorted(expected, key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("piece", [1, 2, 7, 64])
def test_pieces_end_with_a_unit(piece):
    pattern = infilling.patterns(infilling.UNIT)
    for text in texts()[1:120]:
        assert infilling.unit_ends(text, pattern, piece).tolist() == infilling.unit_ends(text, pattern).tolist() == [m.end() for m in re.finditer(infilling.UNIT, text, re.DOTALL)]


def test_shares_markers_and_an_empty_table(spark):
    docs = spark.createDataFrame([(i, "one two three") for i in range(500)], "doc_id long, text string")
    marks = ("[a]", "(b", "c)")
    got = infilling.fill_in_middle(docs, seed=9, plain=0, spm=100, markers=marks).withColumn("back", infilling.restore(F.col("form"), F.col("output"), marks)).collect()
    assert {r.form for r in got} == {"spm"} and {r.back for r in got} == {"one two three"} and len({r.output for r in got}) > 10
    assert {r.form for r in infilling.fill_in_middle(docs, plain=100).collect()} == {"plain"}
    assert infilling.fill_in_middle(docs.limit(0)).collect() == []
