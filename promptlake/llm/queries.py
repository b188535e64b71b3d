"""The queries of the operators, with the parameters that production uses."""

from __future__ import annotations

from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlake.llm import ann, bpe, decontaminate, html_extract, langid, lexical, mixing, quality_knn, resample, simhash, token_count, toxicity, url_filter
from promptlake.llm.base import held_out, new_path, table

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
TOKEN_LIMIT = 1024


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by the classifier learned from the labels of four fifths of the ids."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(0, 5))
    scored = toxicity.score(docs.select("doc_id", "text"), model, as_column="score")
    return scored.select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@cache
def page_model() -> html_extract.Model:
    return html_extract.fit(html_extract.labelled_pages())


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = html_extract.extract(table(spark, sf_dir, "pages"), page_model(), as_column="main_text")
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark, in words and items."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.col("contamination.items")
    return found.select(
        "doc_id",
        "contamination.n_words",
        "contamination.n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: token count and digests of both."""
    coded = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "coded.n_tokens", "coded.ids_sha256", "coded.decoded_sha256")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of every twentieth vector, among all vectors."""
    found = ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: text likelihoods trained on documents, declared language, suffix and host."""
    model = langid.train(table(spark, sf_dir, "documents"))
    html = F.coalesce("html", F.lit(""))
    host = url_filter.host(F.col("url"))
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ").alias("text"),
        F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)).alias("declared"),
        host.alias("host"),
    )
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    pages = pages.withColumns({"declared": empty("declared"), "host": empty("host")}).withColumn("suffix", F.substring_index("host", ".", -1))
    told = langid.identify(pages, model, host="host", suffix="suffix", declared="declared")
    return told.select("page_id", "url", "language.lang", F.round("language.probability", 6).alias("probability"), "language.by_text", "language.accepted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component of fingerprints that it is linked to."""
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, distance=2)
    return groups.select("doc_id", simhash.hexadecimal(F.col("mark")).alias("fingerprint"), "component_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url, by rule or by vocabulary."""
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts through the cache that the session's ``promptlake.token.cache`` names; without it, through a new one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    cache = spark.conf.get("promptlake.token.cache", None) or new_path(spark, "token-counts")
    counted = token_count.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by its labelled neighbours, learned from three quarters of the ids."""
    docs = table(spark, sf_dir, "documents")
    model = quality_knn.train(docs, table(spark, sf_dir, "labels"), ~held_out(2, 4))
    scored = quality_knn.score(docs.select("doc_id", "text"), model, as_column="score")
    return scored.select("doc_id", held_out(2, 4).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    found = lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), k=50)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark's distribution of words."""
    drawn = resample.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 of their sources, three copies at most."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_html_extraction,
        op3_decontamination,
        op4_bpe,
        op5_nearest_neighbours,
        op6_language_id,
        op7_simhash,
        op8_url_filter,
        op9_token_counts,
        op10_quality,
        op11_lexical_search,
        op12_importance_resampling,
        op13_mixing,
    )
}

_WEIGHT = url_filter.listed()
_STRICT = "|".join(t for t, w in _WEIGHT.items() if max(w.values()) >= url_filter.LIMIT)
_BEFORE, _AFTER = r"(^|[^\p{L}\p{N}])", r"([^\p{L}\p{N}]|$)"
_CONTEXTS = url_filter.context_pattern(url_filter.CONTEXTS).replace("\\ ", " ")


def _soft_sql(language: str) -> str:
    """The sum of a language's soft weights in `said`, 0 for a single term."""
    own = [(t, w[language]) for t, w in _WEIGHT.items() if language in w and max(w.values()) < url_filter.LIMIT]
    met = ", ".join(f"CASE WHEN regexp_matches(said, '{_BEFORE}{t}{_AFTER}') THEN {w} END" for t, w in own)
    counts = "true" if language == "en" else f"coalesce(spoken = '{language}', true)"
    return f"CASE WHEN {counts} AND len(list_filter([{met}], lambda x: x IS NOT NULL)) > 1 THEN list_sum(list_filter([{met}], lambda x: x IS NOT NULL)) ELSE 0 END"


ORACLE_SQL = {
    "op11_lexical_search": r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents)
  WHERE len(w) > 0),
item AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM doc),
asked AS (SELECT DISTINCT q, item_id, unnest(w) AS term FROM item),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM doc) SEMI JOIN asked USING (term) GROUP BY r, term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term),
scored AS (
  SELECT q, item_id, doc_id, r, CAST(sum(df.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN doc USING (r), size GROUP BY q, item_id, doc_id, r),
placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM placed WHERE rank <= 50""",
    # crc32 bit by bit, over each different word's bytes
    "op12_importance_resampling": r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
said AS (SELECT r, unnest(w) AS word FROM doc), asked AS (SELECT unnest(w) AS word FROM item),
word AS (SELECT DISTINCT word FROM (SELECT word FROM said UNION ALL SELECT word FROM asked)),
spelled AS (SELECT word, list_transform(generate_series(1, length(hex(word)) // 2), lambda i: CAST('0x' || substr(hex(word), 2 * i - 1, 2) AS BIGINT)) AS bytes FROM word),
bucket AS (
  SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda crc, byte:
    list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT) % 10000 AS b
  FROM spelled),
s AS (SELECT b, count(*) AS n FROM said JOIN bucket USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM asked JOIN bucket USING (word) GROUP BY b),
gain AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM said) + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM asked) + 10000)))) AS BIGINT) AS gain
  FROM (SELECT b FROM s UNION SELECT b FROM t) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
summed AS (SELECT r, sum(gain) AS weight FROM said JOIN bucket USING (word) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM doc LEFT JOIN summed USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank
FROM placed""",
    "op3_decontamination": r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
place AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT r, place.n, i, item FROM place JOIN win USING (n, win)),
hit AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS spot FROM found) GROUP BY r),
items AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
    "op8_url_filter": rf"""
WITH cut AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
told AS (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
    regexp_replace(regexp_replace(lower(url_decode(host || path)), '{_CONTEXTS}', '\1/\2', 'g'), '{_CONTEXTS}', '\1/\2', 'g') AS said,
    CASE regexp_extract(host, '[^.]*$') {" ".join(f"WHEN '{x}' THEN '{y}'" for x, y in url_filter.SUFFIXES.items())} END AS spoken FROM cut)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(said, '{_BEFORE}({_STRICT}){_AFTER}') THEN 'block'
    WHEN greatest({", ".join(_soft_sql(x) for x in sorted({x for x, _, _ in url_filter.VOCABULARY}))}) >= {url_filter.LIMIT} THEN 'block'
    ELSE 'allow' END AS verdict
FROM told""",
}
