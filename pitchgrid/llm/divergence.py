"""Quality rules by distribution divergence: character classes and common words against references of each language.

All of it is DataFrame expressions: texts are looked at in their rows, and only counts per language are aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
#: A common word makes at least 1 in COMMON of its language's words (so there are COMMON at most) and is short.
COMMON, COMMON_LETTERS = 125, 6
#: A language has a reference of its own from so many words on, whatever other languages hold.
LANGUAGE_WORDS = 5000
#: Largest Jensen-Shannon distances, and the words a text must have for them to count.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.26
MIN_CLASS_WORDS, MIN_COMMON_WORDS = 50, 100


def kept_length(text: Column, pattern: str) -> Column:
    """Code points left when everything that matches is taken out."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def class_counts(text: Column) -> Column:
    """Characters by class: upper-case letters, digits, white space, punctuation, signs, all others."""
    upper = kept_length(text, r"[^\p{Lu}]+")
    digit = kept_length(text, r"[^\p{Nd}]+")
    space = kept_length(text, r"[^\x20\x09-\x0D]+")
    punctuation = kept_length(text, r"""[^.,;:!?'"()-]+""")
    sign = kept_length(text, r"""[\p{L}\p{M}\p{N}\x20\x09-\x0D.,;:!?'"()-]+""")
    return F.array(upper, digit, space, punctuation, sign, F.length(text).cast("long") - upper - digit - space - punctuation - sign)


def letter_words(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def known_languages(totals: DataFrame, language_words: int = LANGUAGE_WORDS) -> DataFrame:
    """(lang, total) of the whole corpus, '', and of languages with at least ``language_words`` words."""
    return totals.filter((F.col("lang") == "") | (F.col("total") >= language_words))


def word_references(docs: DataFrame, *, common: int = COMMON, common_letters: int = COMMON_LETTERS, language_words: int = LANGUAGE_WORDS) -> DataFrame:
    """lang, words and word_shares (the share of all other words last) of each known language; lang '' is the whole corpus.

    Counted over all documents with partial sums per task; longer words count as others. A row is bounded by the share
    that makes a word common; there are as many rows as languages of ``language_words`` words.
    """
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = rows.select("lang", F.explode(letter_words(F.col("text"))).alias("word"))
    sized = words.select("lang", F.when(F.length("word") <= common_letters, F.col("word")).otherwise("").alias("word"))
    counts = stored(sized.groupBy("lang", "word").agg(F.count("*").alias("n")), "word-counts")
    every = counts.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit("").alias("lang"), "word", "n")
    counts = counts.filter("lang <> ''").unionByName(every)
    known = stored(known_languages(counts.groupBy("lang").agg(F.sum("n").alias("total")), language_words), "known-languages")
    often = counts.join(known, "lang").filter((F.col("word") != "") & (F.col("n") * common >= F.col("total")))
    listed = often.groupBy("lang", "total").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("list"))
    shares = F.transform(F.col("list"), lambda x: x["n"] / F.col("total"))
    rest = F.aggregate(F.col("list"), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return stored(known.select("lang").join(listed, "lang", "left").select(
        "lang", F.coalesce(F.col("list.word"), F.array().cast("array<string>")).alias("words"),
        F.when(F.col("list").isNull(), F.array(F.lit(1.0))).otherwise(F.concat(shares, F.array(1 - rest / F.col("total")))).alias("word_shares")),
        "word-references")


def class_references(counted: DataFrame) -> DataFrame:
    """lang and class_shares, from the documents' (lang, classes); lang '' is the whole corpus."""
    sums = [f"c{i}" for i in range(6)]
    by_lang = counted.groupBy("lang").agg(*(F.sum(F.col("classes")[i]).alias(s) for i, s in enumerate(sums)))
    whole = counted.agg(*(F.sum(F.col("classes")[i]).alias(s) for i, s in enumerate(sums))).select(F.lit("").alias("lang"), *sums)
    size = sum((F.col(s) for s in sums[1:]), F.col(sums[0]))
    return by_lang.filter("lang <> ''").unionByName(whole).select("lang", F.array(*(F.col(s) / F.greatest(size, F.lit(1)) for s in sums)).alias("class_shares"))


def distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""
    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    terms = F.zip_with(left, right, lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def window_hashes(words: Column) -> Column:
    """Hashes of all three-word windows, in order."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def placed(hashes: Column) -> Column:
    """(hash, place) of all windows sorted by hash; nothing where all hashes differ, as in most texts."""
    rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), rows).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))


def covered_words(runs: Column) -> Column:
    """From (hash, place) sorted by hash: how many words the windows with an equal neighbour cover."""
    def twin(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(runs, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(runs, i + 1)["h"] == x["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter(runs, twin), lambda x: x["p"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    step = lambda a, p: F.struct((a["n"] + (p + 3 - F.greatest(p, a["reach"]))).cast("long").alias("n"), (p + 3).alias("reach"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def judge_documents(
    docs: DataFrame, *, common: int = COMMON, common_letters: int = COMMON_LETTERS, language_words: int = LANGUAGE_WORDS, max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE, min_class_words: int = MIN_CLASS_WORDS, min_common_words: int = MIN_COMMON_WORDS,
) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance and kept, a row for each of ``docs``.

    base_failed: fewer than 50 words, or more than half of the words in repeated three-word windows. Another text is
    kept unless its character classes are further than ``max_class_distance`` from its language's (from ``min_class_words``
    words on) or its common words further than ``max_word_distance`` (from ``min_common_words`` letter words on). A common word
    makes 1 in ``common`` of its language's words and has ``common_letters`` letters at most. A text of
    no language is held against the whole corpus; of one with less than ``language_words`` words its classes are, and it
    has no word_distance and is not rejected for its words. Null and empty texts have no words and fail the base
    rule; repeated rows are judged one by one; an empty table gives an empty table; other columns are not looked at.

    The references are stored, a row a language, and joined by language: Spark broadcasts them while they are small, so
    documents are not shuffled then, and each text is read twice: for the words of its language and for its own counts, from which the class references are summed.
    """
    refs = word_references(docs, common=common, common_letters=common_letters, language_words=language_words)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("doc_lang"), text.alias("text"))
    whole = refs.filter("lang = ''").select(F.col("words").alias("all_words"), F.col("word_shares").alias("all_word_shares"))
    joined = rows.join(refs, F.col("doc_lang") == F.col("lang"), "left").join(F.broadcast(whole), F.lit(True), "left")
    split = joined.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), ((F.col("doc_lang") != "") & F.col("lang").isNull()).alias("rare"), "text", F.array_remove(F.split("text", SPACE), "").alias("w"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        letter_words(F.col("text")).alias("letters"), class_counts(F.col("text")).alias("classes"),
        F.coalesce("words", "all_words").alias("words"), F.coalesce("word_shares", "all_word_shares").alias("word_shares"))
    counted = split.select(
        "doc_id", "lang", "rare", F.size("w").cast("long").alias("n_words"), (F.length("text") - F.col("classes")[2]).alias("word_chars"),
        kept_length(F.col("text"), r"[^#*$%&|<>]+").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.col("w")).alias("windows"), F.size("letters").cast("long").alias("n_letters"),
        F.filter("letters", lambda x: F.length(x) <= common_letters).alias("short"), "classes", "words", "word_shares")
    runs = counted.select("*", placed(F.col("windows")).alias("runs"))
    found = runs.select(
        *[c for c in runs.columns if c not in ("windows", "runs", "short")], covered_words(F.col("runs")).alias("n_repeat_words"),
        F.transform("words", lambda c: (F.size("short") - F.size(F.array_remove(F.col("short"), c))).cast("long")).alias("counts"))
    letters = F.greatest("n_letters", F.lit(1))
    rest = F.col("n_letters") - F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    own_words = F.concat(F.transform("counts", lambda n: n / letters), F.array(rest / letters))
    compact = stored(found.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "classes",
        F.when(~F.col("rare"), distance(own_words, F.col("word_shares"))).alias("word_distance")), "rule-counts")
    classes = stored(class_references(compact).withColumnRenamed("lang", "class_lang"), "class-references")
    chars = F.greatest(F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))
    measured = compact.join(classes, F.col("lang") == F.col("class_lang"), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        distance(F.transform("classes", lambda n: n / chars), F.col("class_shares")).alias("class_distance"), "word_distance")
    far = ((F.col("n_words") >= min_class_words) & (F.col("class_distance") > max_class_distance)) | (
        (F.col("n_letters") >= min_common_words) & (F.col("word_distance") > max_word_distance))
    return measured.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).drop("n_letters")
