"""Language by centroids: held-out accuracy, a plain version of the cosine, rejection, and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitchgrid.llm import common
from pitchgrid.llm import language_centroids as centroids

SYLLABLES = {"aa": "the ing tion and wh sh ed".split(), "bb": "ñor qué los ción el ar".split(), "cc": "щик ный ого это да ет".split()}


def text_of(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def learnt(spark):
    rnd = random.Random(1)
    rows = [(i, lang, text_of(rnd, lang, rnd.choice([3, 20, 200]))) for i, lang in enumerate(rnd.choices(["aa", "bb", "cc"], [8, 1, 1], k=900))]
    rows += [(1000, None, "the the"), (1001, "aa", None), (None, "bb", "qué"), (1002, "aa", "1 2 3"), (5, "aa", rows[5][2]), (1003, "dd", "zzz zzz")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("lang_score", F.lit("clash"))
    return rows, centroids.fit(docs, sample_rows=240, least_rows=1)


def grams_of(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    line = f" {' '.join(words)} " if words else ""
    return Counter(line[i:i + 3] for i in range(len(line) - 2))


def test_held_out_texts_get_their_language(spark, learnt):
    rnd = random.Random(2)
    rows = [(i, lang, text_of(rnd, lang, rnd.choice([2, 10, 400]))) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    got = centroids.identify(spark.createDataFrame(rows, "doc_id long, lang string, text string"), learnt[1]).collect()
    assert [r.lang_nearest for r in got] == [r.lang for r in got] and all(0 < r.lang_score <= 1 for r in got)
    assert sum(r.lang_rejected for r in got) < 9


def test_cosines_match_a_plain_version(learnt):
    rows, model = learnt
    grams = ["".join(chr(int(k) >> s & 0x1FFFFF) for s in (42, 21, 0)) for k in model.vocabulary]
    known = [(d, t) for d, lang, t in rows if lang and t and d is not None]
    frequency = Counter(g for _, t in known for g in grams_of(t))
    place = {g: i for i, g in enumerate(grams)}
    texts = [t for _, _, t in rows[:60]]
    names, score, _ = model.judge(pa.array(texts), common.Lookup(model.vocabulary))
    for text, name, own in zip(texts, names, score):
        vector, others = np.zeros(len(grams)), []
        for g, n in grams_of(text).items():
            weight = (1 + math.log(n)) * (1 + math.log((1 + len(known)) / (1 + (frequency[g] if g in place else 0))))
            if g in place:
                vector[place[g]] = weight
            else:
                others.append(weight)
        cosine = vector @ model.vectors / np.linalg.norm([*vector, *others])
        assert abs(cosine.max() - own) < 1e-5 and cosine.max() - max(c for c, k in zip(cosine, model.languages) if k == name) < 1e-5


def test_several_centroids_a_language_and_bounds(spark, learnt):
    rows, model = learnt
    assert Counter(model.languages)["aa"] == 4 and set(model.languages) == {"aa", "bb", "cc", "dd"} and model.fallback == "aa"
    assert np.allclose(np.linalg.norm(model.vectors, axis=0), 1, atol=1e-5)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    sample, sizes = centroids.labelled_sample(docs.dropna(), 40, 2)
    assert set(sizes) == {"aa", "bb"} and {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()} == {"aa": 20, "bb": 20}


def test_rejection_and_odd_rows(spark, learnt):
    texts = [None, "", "12 + 5 = !", "日本語の文章", "qwxz jkvq " * 40, "the", "the and " * 30_000]
    docs = spark.createDataFrame([(i if i else None, t, 1.5, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, lang_score double, lang_pred string")
    rows = centroids.identify(docs, learnt[1])
    assert rows.columns == ["doc_id", "text", "lang_nearest", "lang_score", "lang_rejected", "lang_pred"]
    got = [(r.lang_nearest, r.lang_rejected, r.lang_pred) for r in rows.collect()]
    assert got[:7] == got[7:]
    assert got[:3] == [("und", True, "und")] * 3
    assert got[3][0] == "aa" and got[4][1:] == (True, "und") and got[5][0] == "aa" and got[6] == ("aa", False, "aa")
    assert centroids.identify(docs.limit(0), learnt[1]).collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None, "the")], "doc_id long, lang string, text string")
    got = centroids.identify(docs, centroids.fit(docs)).collect()
    assert [(r.lang_nearest, r.lang_score, r.lang_rejected) for r in got] == [("und", 0.0, True)]


def test_lookup_finds_every_key_and_no_other():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2 ** 63, 30_000, dtype=np.uint64))
    find = common.Lookup(keys[::2])
    assert (find(keys[::2]) == np.arange(len(keys[::2]))).all() and (find(keys[1::2]) == -1).all()
