"""The registered queries of this subpackage and their SQL: one ``opN_<name>`` for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, gam, html, jaccard, langid, lexical, media, mixing, negatives, pieces, rules, toxicity, urlfilter
from .common import crc_mod, table

#: Where the public vocabularies lie; read by the driver only.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def piece_model(path: str = PIECE_MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of every document."""
    return pieces.encode_and_verify(table(spark, sf_dir, "documents"), piece_model())


#: Dated entries that stand on the registered query's list whatever the pages are: list, pattern, action, effective date.
URL_LIST = (
    ("spam", "spam-farm.example.org", "block", "2024-01-15"),
    ("spam", "cheap-pills.example.com", "block", "2024-02-01"),
    ("spam", "cheap-pills.example.com", "clear", "2024-06-10"),
    ("spam", "cheap-pills.example.com", "block", "2024-09-05"),
    ("partners", "www.cheap-pills.example.com", "allow", "2024-10-20"),
    ("partners", "www.cheap-pills.example.com", "clear", "2024-11-20"),
    ("locale", "spam-farm.example.org/en", "allow", "2024-07-01"),
    ("locale", "blog.tionsh.example.net/es", "block", "2024-03-01"),
    ("abuse", "tionble.example.org", "block", "2024-05-01"),
    ("abuse", "tionble.example.org", "clear", "2024-05-20"),
)


def url_list(pages: DataFrame) -> DataFrame:
    """``list, pattern, action, effective``: ``URL_LIST`` and entries dealt by hash to the pages' own hosts, their parent domains and
    first path segments. The list grows with the number of distinct hosts; each of three lists has up to three entries for a name."""
    sites = pages.select(urlfilter.host_of(F.col("url")).alias("host"), urlfilter.segment_of(F.col("url")).alias("segment")).where("host <> ''").distinct()
    path = F.when(F.col("segment") != "", F.concat_ws("/", "host", "segment"))
    names = sites.select(F.explode(F.array("host", F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1), path)).alias("pattern")).where("pattern <> ''").distinct()
    dealt = names.withColumn("h", F.conv(F.substring(F.md5("pattern"), 1, 7), 16, 10).cast("long")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    x, first = F.expr("shiftright(h, 8 * k) & 255"), F.expr("date_add(date'2024-01-01', cast(x * 7 % 300 as int))")
    on = dealt.withColumn("x", x).where("x % 4 = 0").select("pattern", "x", F.concat(F.lit("list"), "k").alias("list"), first.alias("first"))
    entry = lambda action, days: F.struct(action.alias("action"), F.date_add("first", days).alias("effective"))
    steps = F.array(
        entry(F.when(F.floor(F.col("x") / 4) % 3 == 0, "allow").otherwise("block"), F.lit(0)),
        F.when(F.floor(F.col("x") / 16) % 2 == 0, entry(F.lit("clear"), (20 + F.col("x") % 50).cast("int"))),
        F.when(F.floor(F.col("x") / 32) % 2 == 0, entry(F.lit("block"), F.lit(120))),
    )
    made = on.withColumn("e", F.explode(steps)).where("e is not null").select("list", "pattern", "e.action", F.col("e.effective").cast("string").alias("effective"))
    return made.unionByName(pages.sparkSession.createDataFrame(list(URL_LIST), "list string, pattern string, action string, effective string"))


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` as a capture, fetched on a date dealt by its id, against ``url_list`` of the same pages."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id, 365) as int))").alias("fetch_date"))
    return urlfilter.judge(captures, url_list(pages)).withColumn("fetch_date", F.col("fetch_date").cast("string"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    return langid.predict(docs, langid.fit(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at 100 * intersection >= 85 * union over 4-word shingles."""
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text without duplicate passages, and what was cut, of every document."""
    return chunks.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store(table(spark, sf_dir, "documents")))


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, epoch, block, tokens, place of every visit of the mixture."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"))


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gam.classify(docs, gam.fit(docs, table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; every seventh row has its label moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("id") % 100 == 0)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of each benchmark item."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_url_lists": op2_url_lists,
    "op3_main_text": op3_main_text,
    "op4_byte_cnn": op4_byte_cnn,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_substring_dedup": op6_substring_dedup,
    "op9_avi_mjpeg": op9_avi_mjpeg,
    "op10_temperature_mix": op10_temperature_mix,
    "op7_host_rules": op7_host_rules,
    "op8_quality_gam": op8_quality_gam,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_toxicity": op12_toxicity,
    "op13_lexical_search": op13_lexical_search,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP10_SQL = rf"""
WITH RECURSIVE slim AS (SELECT doc_id, source, len({_WORDS}) AS tokens FROM documents),
shares AS (SELECT source, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS total FROM slim GROUP BY source),
grid AS (SELECT range AS k FROM range(0, 1025)),
trial AS (
  SELECT k, ln(sum(w)) - sum(w * ln(w)) / sum(w) AS entropy, max(w / total) / sum(w) AS per_token, max(total / w) * sum(w) AS full_budget
  FROM (SELECT k, total, pow(CAST(total AS DOUBLE), k / 1024.0::DOUBLE) AS w FROM shares, grid WHERE total > 0) GROUP BY k),
ends AS (SELECT max(entropy) FILTER (k = 1024) AS own, max(entropy) FILTER (k = 0) AS flat FROM trial),
exponent AS (
  SELECT CASE WHEN bool_and(per_token * full_budget <= 4.0 + 1e-9) FILTER (k = wanted) THEN max(wanted)
              ELSE coalesce(min(k) FILTER (per_token * full_budget <= 4.0 + 1e-9), 1024) END AS k
  FROM trial, (SELECT max(k) AS wanted FROM trial, ends WHERE entropy >= own + 0.25 * (flat - own) - 1e-9)),
weights AS (SELECT source, total, CASE WHEN total > 0 THEN pow(CAST(total AS DOUBLE), k / 1024.0::DOUBLE) ELSE 0 END AS w FROM shares, exponent),
plan AS (
  SELECT source, total, CAST(round(w / (SELECT sum(w) FROM weights) * (SELECT full_budget FROM trial JOIN exponent USING (k))) AS BIGINT) AS quota,
         least(1048576, CAST(floor(total / 200000.0::DOUBLE + 1) AS INTEGER)) AS blocks
  FROM weights),
dealt AS (
  SELECT s.*, p.total, p.quota, CASE WHEN p.total > 0 THEN CAST(ceil(p.quota / CAST(p.total AS DOUBLE)) AS INTEGER) ELSE 1 END AS epochs,
         CAST(CAST('0x' || substr(md5(concat_ws('/', '0', CAST(doc_id AS VARCHAR))), 1, 7) AS INTEGER) % p.blocks AS INTEGER) AS block
  FROM slim s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
visits AS (
  SELECT source, block, t, total, quota, unnest(range(0, greatest(epochs, 1))) AS epoch
  FROM (SELECT source, block, sum(tokens) AS t, max(total) AS total, max(quota) AS quota, max(epochs) AS epochs FROM dealt GROUP BY source, block)),
starts AS (
  SELECT source, block, epoch, epoch * total + sum(t) OVER (PARTITION BY source, epoch ORDER BY md5(concat_ws('/', '0', CAST(epoch AS VARCHAR), CAST(block AS VARCHAR))), block) - t AS start
  FROM visits),
placed AS (
  SELECT d.doc_id, d.source, CAST(s.epoch AS INTEGER) AS epoch, d.block, CAST(d.tokens AS BIGINT) AS tokens, d.quota, d.total,
         s.start + coalesce(sum(d.tokens) OVER (PARTITION BY d.source, s.epoch, d.block ORDER BY md5(concat_ws('/', '0', CAST(s.epoch AS VARCHAR), CAST(d.doc_id AS VARCHAR))), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM dealt d JOIN starts s ON s.source IS NOT DISTINCT FROM d.source AND s.block = d.block WHERE s.start <= d.quota OR d.total = 0)
SELECT doc_id, source, epoch, block, tokens, CASE WHEN quota > 0 THEN round(CAST(before AS DOUBLE) / quota, 9) ELSE 0 END AS place
FROM placed WHERE before < quota OR (before = quota AND tokens = 0) OR total = 0
"""

OP7_SQL = rf"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (SELECT *, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END AS g FROM split),
positions AS (SELECT doc_id, source, unnest(g) AS h, unnest(range(1, len(g) + 1)) AS p FROM grams),
twice AS (SELECT doc_id, source, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, source, h) AS n FROM positions) WHERE n > 1),
covered AS (
  SELECT doc_id, source, CAST(sum(least(3, gap)) AS BIGINT) AS n
  FROM (SELECT *, p - coalesce(lag(p) OVER (PARTITION BY doc_id, source ORDER BY p), p - 3) AS gap FROM twice) GROUP BY doc_id, source),
base AS (
  SELECT g.doc_id, g.source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM grams g LEFT JOIN covered c ON g.doc_id = c.doc_id AND g.source IS NOT DISTINCT FROM c.source),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS docs, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS failed FROM judged GROUP BY source),
moments AS (SELECT sum(failed) / sum(docs) AS mean, avg(failed / docs) AS m, var_pop(failed / docs) AS v, avg(1.0::DOUBLE / docs) AS inv FROM hosts),
prior AS (SELECT mean, CASE WHEN v - m * (1 - m) * inv <= 0 THEN 1000.0 ELSE greatest(1.0, least(1000.0, m * (1 - m) / (v - m * (1 - m) * inv) - 1)) END AS weight FROM moments),
rated AS (SELECT source, (failed + mean * weight) / (docs + weight) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate, NOT base_failed AND rate <= 0.5 AS kept
FROM judged j JOIN rated r ON j.source IS NOT DISTINCT FROM r.source
"""

_VALUES = ", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in URL_LIST)

OP2_SQL = rf"""
WITH seen AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetch_date,
         rtrim(regexp_extract(lower(trim(coalesce(url, ''))), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.') AS host,
         regexp_extract(lower(trim(coalesce(url, ''))), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS segment
  FROM pages),
names AS (
  SELECT host AS pattern FROM seen WHERE host <> '' UNION SELECT host || '/' || segment FROM seen WHERE host <> '' AND segment <> ''
  UNION SELECT regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) FROM seen WHERE regexp_matches(host, '^[^.]+\.(.+\..+)$')),
dealt AS (
  SELECT pattern, 'list' || k AS list, x, DATE '2024-01-01' + CAST(x * 7 % 300 AS INTEGER) AS first
  FROM (SELECT pattern, k, (CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) >> (8 * k)) & 255 AS x FROM names, (VALUES (0), (1), (2)) t(k)) WHERE x % 4 = 0),
entries(list, pattern, action, valid_from) AS (
  VALUES {_VALUES}
  UNION ALL SELECT list, pattern, CASE WHEN x // 4 % 3 = 0 THEN 'allow' ELSE 'block' END, first FROM dealt
  UNION ALL SELECT list, pattern, 'clear', first + CAST(20 + x % 50 AS INTEGER) FROM dealt WHERE x // 16 % 2 = 0
  UNION ALL SELECT list, pattern, 'block', first + 120 FROM dealt WHERE x // 32 % 2 = 0),
intervals AS (SELECT *, lead(valid_from) OVER (PARTITION BY list, pattern ORDER BY valid_from) AS valid_to FROM entries),
hits AS (
  SELECT s.host, s.segment, s.fetch_date, min(pattern) FILTER (action = 'allow') AS allow, min(pattern) FILTER (action = 'block') AS block
  FROM (SELECT DISTINCT host, segment, fetch_date FROM seen) s JOIN intervals i
    ON s.fetch_date >= i.valid_from AND (i.valid_to IS NULL OR s.fetch_date < i.valid_to)
   AND (s.host = i.pattern OR ends_with(s.host, '.' || i.pattern) OR s.host || '/' || s.segment = i.pattern)
  GROUP BY 1, 2, 3),
judged AS (
  SELECT page_id, url, host, fetch_date, coalesce(allow, block) AS rule,
         CASE WHEN host = '' THEN 'invalid' WHEN allow IS NOT NULL THEN 'allowed' WHEN block IS NOT NULL THEN 'blocked' ELSE 'clean' END AS verdict
  FROM seen LEFT JOIN hits USING (host, segment, fetch_date))
SELECT page_id, url, host, CAST(fetch_date AS VARCHAR) AS fetch_date, verdict, rule, verdict NOT IN ('invalid', 'blocked') AS kept FROM judged
"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

OP13_SQL = r"""
WITH terms AS (
  SELECT n AS d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS n FROM documents)),
postings AS (SELECT d, term, count(*) AS tf FROM terms GROUP BY 1, 2),
docs AS (SELECT d, doc_id, count(*) AS n FROM terms GROUP BY 1, 2),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, total GROUP BY term),
sizes AS (SELECT d, doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM docs, total),
wanted AS (SELECT DISTINCT i, item_id, term FROM (
  SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS i FROM benchmark))),
scores AS (
  SELECT i, item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (d) GROUP BY 1, 2, 3, 4)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, d) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {"op2_url_lists": OP2_SQL, "op7_host_rules": OP7_SQL, "op10_temperature_mix": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_lexical_search": OP13_SQL}
