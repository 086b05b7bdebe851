"""The numbered queries against SQL, and the pipeline against a plain version, on the given tables."""

import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pitchgrid.llm import near_dup
from pitchgrid.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.llm.test_operators import brute_contamination, brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    if not Path(SF).is_dir():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def test_a_query_for_each_operator():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = sql.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, (tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())))


def test_divergence_sql_with_languages_on_either_side_of_the_bound(spark, tmp_path):
    """A language of 9,000 words has a word reference, one of 3,000 has none and loses no text for its words."""
    rnd = random.Random(3)
    rows, word = [], lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9)))
    for lang, letters, texts in (("aa", "abcdefg", 180), ("bb", "hijklmn", 60), ("cc", "opqrstu", 20), (None, "abhiop", 10)):
        often, seldom = [word(letters)[:5] for _ in range(12)], [word(letters) for _ in range(900)]
        rows += [(lang, " ".join(rnd.choice(often if rnd.random() < share else seldom) for _ in range(150))) for i in range(texts) for share in [0.5 if i % 9 else 0.02]]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cols = ["doc_id", "kept", "base_failed", "n_words"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES['op3_divergence']})").fetchall()
    got = [tuple(r[c] for c in cols) for r in QUERIES["op3_divergence"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    lost = {rows[i][0] for i, kept, *_ in got if not kept}
    assert {"aa", "bb"} <= lost and "cc" not in lost


def test_groups_over_the_given_documents(spark, sql):
    docs = sql.execute("SELECT doc_id, text FROM documents").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op7_signature_join"](spark, SF).collect()}
    assert got == brute_groups(docs, 3, 85)


@pytest.mark.parametrize("name, folds, fold", [("op6_toxicity", 5, 0), ("op9_quality_neighbours", 3, 1)])
def test_scores_of_all_documents(spark, sql, name, folds, fold):
    ids = {r[0] for r in sql.execute("SELECT doc_id FROM documents").fetchall()}
    rows = QUERIES[name](spark, SF).collect()
    assert {r.doc_id for r in rows} == ids and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)


def test_surrogates_leave_no_planted_data(spark, sql):
    planted = re.compile(r"\S+@mail\d\.example\.com|AKIA[0-9A-Z]{16}|password=\w+|\+1 \(\d{3}\) \d{3}-\d{4}")
    private = {p for (t,) in sql.execute("SELECT text FROM documents").fetchall() for p in planted.findall(t)}
    rows = QUERIES["op10_surrogates"](spark, SF).collect()
    assert private and not any(p in r.text for p in private for r in rows)


def test_pipeline_against_a_plain_version(spark, sql):
    """Each stage on its own input; the stages' files are read back here."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = sql.execute("SELECT item_id, text FROM benchmark").fetchall()
    quality = dict(sql.execute("SELECT doc_id, quality FROM labels").fetchall())
    own = None
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        kept = [r.doc_id for r in rows]
        if name == "quality classifier":
            assert sum(quality.get(d) == 1 for d in kept) >= 0.97 * sum(q == 1 for q in quality.values())
            assert sum(quality.get(d) == 0 for d in kept) <= 0.2 * sum(q == 0 for q in quality.values())
        elif name == "minhash near-dedup":
            assert sorted(kept) == sorted(d for d, (_, c) in brute_groups(before, 5, 80).items() if c == d)
        elif name == "benchmark decontamination":
            assert sorted(kept) == sorted(d for d, w in brute_contamination(before, bench).items() if not w[3])
        elif name == "mixing sources":
            assert set(kept) <= {d for d, _ in before} and max(np.unique(kept, return_counts=True)[1]) <= 2
            own = sorted((r.doc_id, r.text) for r in rows)
        if name != "token-id output":
            assert docs.columns == columns
    tokenizer, at = Tokenizer.from_file(tokenizer_path()), 0
    for (d, t), r in zip(own, sorted(rows, key=lambda r: r.start)):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert near_dup.matches_for(80) == 2


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows and clashing columns go through every stage; an empty table stays empty."""
    text = " ".join(f"w{i % 37}{i}" for i in range(200))
    rows = [(1, None, None, None, 1, "a"), (2, "", "en", "s", 2, "b"), (3, "x", "en", None, 3, "c"), (4, text, "en", "s", 4, "d"), (5, text, "en", "s", 5, "e"), (6, text.upper(), "en", "t", 6, "f"), (7, "y z", "en", "t", 7, "g"), (7, "y z", "en", "t", 7, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "y Z"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        left = table
        for name, stage in corpus_pipeline.STAGES:
            done = stage(spark, left, str(tmp_path))
            got = done.collect()
            assert name == "token-id output" or done.columns == docs.columns
            if table is docs and name == "minhash near-dedup":
                assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 7, 7]
            if table is docs and name == "benchmark decontamination":
                assert sorted(r.doc_id for r in got) == [1, 2, 3, 4]
            if table is docs and name == "mixing sources":
                assert {r["size"] for r in got} <= set("abcd") and all(r.doc_id != 4 or r.text == text for r in got)
            left = spark.createDataFrame(got, done.schema)
        assert table is docs or got == []
