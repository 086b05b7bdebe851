"""The numbered queries over the given tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.llm import divergence, infilling, language_centroids, mixing, near_dup, quality_knn, sharding, surrogates, token_orc, toxicity, url_rules, winnowing, word_runs
from pitchgrid.llm.common import load, words_of
from pitchgrid.shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key"))
    placed = sharding.histogram_shards(slim, 16, weight="size", sort_key="text_key", sort_id="doc_id")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The contract's rules.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@query
def op2_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the longest fitting rule on every url; ``allow`` where none fits."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.judge_urls(pages, [url_rules.host_rule(v, r) for v, r in URL_RULES])
    return judged.select(
        "page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


ORACLES["op2_url_automaton"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rule, rhost, rpath, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
         ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM s JOIN r ON ends_with('.' || host, '.' || rhost) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN best USING (page_id)
"""


@query
def op5_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150% of all words, shared by the weights 5, 2, 1 with at most two epochs of each source."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", words_of(F.col("text")).alias("n_words"))
    mixed = mixing.mix_sources(sized, size=F.col("n_words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).cast("long").alias("taken"))


_CLAMPS = ",\n".join(
    f"""f{i + 1} AS (
  SELECT f.* EXCLUDE (clamped), clamped OR (w * left2 > cap * 2 * den) AS clamped
  FROM f{i} f, (SELECT sum(w) FILTER (NOT clamped) AS den, 3 * (SELECT sum(size) FROM d) - 2 * coalesce(sum(cap) FILTER (clamped), 0) AS left2 FROM f{i})
)""" for i in range(12))
ORACLES["op5_water_filling"] = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('mix:' || doc_id), 1, 12) AS place FROM documents
), f0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, (2 * sum(size))::BIGINT AS cap, false AS clamped,
         [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::BIGINT AS w FROM d GROUP BY source
), {_CLAMPS}, t AS (
  SELECT f.*, CASE WHEN clamped THEN cap::DOUBLE ELSE (w * left2)::DOUBLE / (2 * den)::DOUBLE END AS target
  FROM f12 f, (SELECT sum(w) FILTER (NOT clamped) AS den, (3 * (SELECT sum(size) FROM d) - 2 * coalesce(sum(cap) FILTER (clamped), 0))::BIGINT AS left2 FROM f12)
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS whole FROM t
), h AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS missing,
         sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY d.source, place) AS own
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), k AS (
  SELECT *, max(place) FILTER (upto - own <= missing) OVER (PARTITION BY source) AS edge FROM h
)
SELECT doc_id, size, source_size, target,
       (size * least(whole + CASE WHEN place < edge OR (place = edge AND own <= 2 * (missing - (upto - own))) THEN 1 ELSE 0 END, 2))::BIGINT AS taken FROM k
"""


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids written as ORC in doc_id order and read back."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_folder(spark, "token-orc")
    token_orc.write_tokens(docs, path, tokenizer_path(), end_id=2)
    back = token_orc.token_digest(token_orc.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids"))
    return back.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document stands in 13-word windows of the benchmark."""
    judged = winnowing.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLES["op4_winnowing"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), i AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(p) WHERE len(w) > 0
), x AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM i), unnest(range(1, len(w) - n + 2)) AS r(p)
), h AS (
  SELECT doc_id, item_id, n, p FROM x JOIN i USING (n, win)
), c AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, n, p FROM h), unnest(range(p, p + n)) AS r(q) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def scored(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    return docs.select(
        "doc_id", quality_knn.held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by its nearest labelled examples; fold 0 of 5 is held out."""
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~quality_knn.held_out(F.col("doc_id"), 5, 0)))
    return scored(toxicity.score_documents(docs, model, evidence=None), 5, 0)


@query
def op9_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by votes of labelled neighbours; fold 1 of 3 is held out."""
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")
    model = quality_knn.fit(docs, labels.filter(~quality_knn.held_out(F.col("doc_id"), 3, 1)))
    return scored(quality_knn.score_documents(docs, model), 3, 1)


@query
def op7_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates of all documents."""
    groups = near_dup.duplicate_groups(load(spark, sf_dir, "documents"), shingle=3, percent=85)
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query
def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and Jensen-Shannon verdicts of every document."""
    judged = divergence.judge_documents(load(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _class_sql(text: str) -> str:
    keep = lambda pattern: f"length(regexp_replace({text}, '{pattern}', '', 'g'))"
    upper, digit, space = keep(r"[^\p{Lu}]+"), keep(r"[^\p{Nd}]+"), f"(length({text}) - {keep(r'[\x20\x09-\x0D]+')})"
    mark, sign = keep("""[^.,;:!?''"()-]+"""), keep(r"""[\p{L}\p{M}\p{N}\x20\x09-\x0D.,;:!?''"()-]+""")
    return f"[{upper}, {digit}, {space}, {mark}, {sign}, length({text}) - {upper} - {digit} - {space} - {mark} - {sign}]"


def _distance_sql(own: str, other: str) -> str:
    part = "CASE WHEN {a}[i] > 0 THEN {a}[i] * log2({a}[i] / (({a}[i] + {b}[i]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(list_sum(list_transform(range(1, len({own}) + 1), lambda i: ({part.format(a=own, b=other)} + {part.format(a=other, b=own)}) / 2)), 0))"


ORACLES["op3_divergence"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: x <> '') AS letters,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, {_class_sql("text")} AS classes FROM d
), n AS (
  SELECT lang, CASE WHEN length(word) <= {divergence.COMMON_LETTERS} THEN word ELSE '' END AS word, count(*) AS n FROM (SELECT lang, unnest(letters) AS word FROM l) GROUP BY ALL
), m AS (
  SELECT * FROM n WHERE lang <> '' UNION ALL SELECT '', word, sum(n) FROM n GROUP BY word
), t AS (
  SELECT lang, sum(n) AS total FROM m GROUP BY lang
), k AS (
  SELECT * FROM t WHERE lang = '' OR total >= {divergence.LANGUAGE_WORDS}
), c AS (
  SELECT lang, list(word ORDER BY word) AS words, list_append(list(n / total ORDER BY word), 1 - sum(n) / any_value(total)) AS word_shares
  FROM m JOIN k USING (lang) WHERE word <> '' AND n * {divergence.COMMON} >= total GROUP BY lang
), h AS (
  SELECT lang, i, sum(classes[i]) AS n FROM l, range(1, 7) AS r(i) GROUP BY ALL
), g AS (
  SELECT lang, list(n / greatest(s, 1) ORDER BY i) AS class_shares
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS s FROM (SELECT * FROM h WHERE lang <> '' UNION ALL SELECT '', i, sum(n) FROM h GROUP BY i)) GROUP BY lang
), r AS (
  SELECT lang, coalesce(words, []) AS words, coalesce(word_shares, [1.0]) AS word_shares, class_shares FROM k LEFT JOIN c USING (lang) LEFT JOIN g USING (lang)
), x AS (
  SELECT l.*, words, word_shares, class_shares, l.lang <> '' AND l.lang NOT IN (SELECT lang FROM r) AS rare FROM l JOIN r ON r.lang = CASE WHEN l.lang IN (SELECT lang FROM r) THEN l.lang ELSE '' END
), e AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (
    SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM (
      SELECT doc_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM l, unnest(range(1, len(w) - 1)) AS u(p))
  ), unnest([p, p + 1, p + 2]) AS v(q) WHERE times > 1 GROUP BY doc_id
), f AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(letters) AS n_letters,
         list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, word_shares, class_shares, rare,
         list_transform(classes, lambda z: z / greatest(list_sum(classes), 1)) AS own_classes,
         list_transform(words, lambda z: len(list_filter(letters, lambda y: y = z)) / greatest(len(letters), 1)) AS own
  FROM x LEFT JOIN e USING (doc_id)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         list_append(own, CASE WHEN n_letters = 0 THEN 0 ELSE 1 - coalesce(list_sum(own), 0) END) AS own_words FROM f
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words >= {divergence.MIN_CLASS_WORDS} AND {_distance_sql("own_classes", "class_shares")} > {divergence.MAX_CLASS_DISTANCE})
       AND NOT (NOT rare AND n_letters >= {divergence.MIN_COMMON_WORDS} AND {_distance_sql("own_words", "word_shares")} > {divergence.MAX_WORD_DISTANCE}) AS kept
FROM v
"""


#: A key for the given tables; a user's own is a secret.
SURROGATE_KEY = b"surrogates of the given tables"


@query
def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with surrogates for its personal data."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, SURROGATE_KEY).select("doc_id", "text", "n_entities")


@query
def op11_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest language of every text; fold 0 of 5 is held out. ``rejected`` tells texts that lie too far from it."""
    docs = load(spark, sf_dir, "documents")
    test = quality_knn.held_out(F.col("doc_id"), 5, 0)
    model = language_centroids.fit(docs.select("doc_id", "lang", "text").where(~test))
    judged = language_centroids.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", test.alias("held_out"), F.col("lang_nearest").alias("lang_pred"), F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


@query
def op12_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut into prefix, middle and suffix, rearranged, and rebuilt from what was written."""
    done = infilling.fill_in_middle(load(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(infilling.restore(F.col("form"), F.col("output"))).alias("restored_sha256"))


ORACLES["op12_infilling"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), h AS (
  SELECT *, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""


@query
def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every text, and the text without their repetitions; a tenth of the texts get a periodic end."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    done = word_runs.find_runs(docs, repeat_seed=F.when(h % 10 == 0, F.floor(h / 10)))
    top = F.get("runs", F.col("top"))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))))
    return done.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


#: Stretches of equal 16-word grams at one distance are what a run's words repeat; the shortest distance of a stretch is its period.
ORACLES["op13_word_runs"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) AS n,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))))) AS h
  FROM documents
), e AS (
  SELECT *, (h // 10) % greatest(n, 1) AS a FROM d
), f AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e
), t AS (
  SELECT id, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) ELSE w END AS w FROM f
), g AS (
  SELECT id, n, i, md5_number(array_to_string(w[i + 1:i + 16], ' ')) AS gram FROM t, unnest(range(n - 15)) AS r(i)
), m AS (
  SELECT x.id, x.i, y.i - x.i AS p FROM g x JOIN g y ON x.id = y.id AND x.gram = y.gram AND x.i < y.i AND 3 * (y.i - x.i) <= x.n
), s AS (
  SELECT id, p, min(i) AS a, max(i) + 16 + p AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY id, p ORDER BY i) AS island FROM m) GROUP BY id, p, island
), r AS (
  SELECT id, a, b - a AS len, min(p) AS p FROM s WHERE b - a >= greatest(24, 3 * p) GROUP BY id, a, b
), o AS (
  SELECT id, count(*) AS n_runs, arg_min({'start': a, 'length': len, 'period': p}, {'exponent': -len::DOUBLE / p, 'start': a, 'period': p}) AS top,
         string_agg(a || ',' || len || ',' || p || chr(10), '' ORDER BY a, p) AS lines FROM r GROUP BY id
), q AS (
  SELECT DISTINCT id, unnest(range(a + p, a + len)) AS i FROM r
), c AS (
  SELECT id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT id, i, w[i + 1] AS word FROM t, unnest(range(n)) AS u(i)) ANTI JOIN q USING (id, i) GROUP BY id
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.start::BIGINT AS start, top.length::BIGINT AS length, top.period::BIGINT AS period,
       (1000 * top.length // top.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN o USING (id) LEFT JOIN c USING (id)
"""
