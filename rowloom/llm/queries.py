"""The queries of the text operators, with production parameters over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import bpe, langid, lzprint, media, packing, simhash, substrings, suffixes, toxicity, urlfilters
from rowloom.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text", "lang")
    model = langid.fit(held.where("NOT held_out"))
    predicted = langid.predict(docs, model)
    return predicted.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, limit=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(table(spark, sf_dir, "documents")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=2, capacity=1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures: pages carry no time, so their day of 2024 follows from their number."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched_on"))


def dated_list(captures: DataFrame) -> DataFrame:
    """The list: every host and parent domain of the captures is blocked on one day and allowed again on another, as digits of its MD5 say."""
    domain = captures.select(F.explode(urlfilters.domains_of(urlfilters.host_of(F.col("url")))).alias("domain")).distinct()
    day = lambda i, step: F.date_add(F.lit("2024-01-01").cast("date"), F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("domain"), i, 1)) * step)
    blocked = domain.where(F.substring(F.md5("domain"), 3, 1) < "8").select("domain", day(1, 20).alias("listed_on"), F.lit("block").alias("status"))
    allowed = domain.where(F.substring(F.md5("domain"), 4, 1) < "8").select("domain", day(2, 22).alias("listed_on"), F.lit("allow").alias("status"))
    return blocked.unionByName(allowed)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = fetched_pages(spark, sf_dir)
    return urlfilters.filter_urls(captures, dated_list(captures))


OP7_SQL = r"""
WITH own AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host,
         CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched_on
  FROM pages),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS parts FROM own WHERE host IS NOT NULL),
domains AS (SELECT host, array_to_string(parts[i:], '.') AS domain
            FROM (SELECT host, parts, unnest(range(1, greatest(1, len(parts) - 1) + 1)) AS i FROM hosts)),
listed AS (SELECT DISTINCT domain FROM domains),
entries AS (
  SELECT domain, CAST(DATE '2024-01-01' + CAST(strpos('0123456789abcdef', substr(md5(domain), 1, 1)) * 20 AS INTEGER) AS DATE) AS listed_on, 'block' AS status
  FROM listed WHERE substr(md5(domain), 3, 1) < '8'
  UNION ALL
  SELECT domain, CAST(DATE '2024-01-01' + CAST(strpos('0123456789abcdef', substr(md5(domain), 2, 1)) * 22 AS INTEGER) AS DATE), 'allow'
  FROM listed WHERE substr(md5(domain), 4, 1) < '8'),
days AS (SELECT domain, listed_on, CASE WHEN bool_or(status = 'block') THEN 'block' ELSE 'allow' END AS status FROM entries GROUP BY domain, listed_on),
intervals AS (SELECT domain, status, listed_on AS valid_from, lead(listed_on) OVER (PARTITION BY domain ORDER BY listed_on) AS valid_to FROM days),
matched AS (
  SELECT o.host, o.fetched_on, i.domain, i.status, i.valid_from,
         row_number() OVER (PARTITION BY o.host, o.fetched_on ORDER BY length(i.domain) DESC) AS k
  FROM (SELECT DISTINCT host, fetched_on FROM own) o JOIN domains d ON d.host = o.host
  JOIN intervals i ON i.domain = d.domain AND i.valid_from <= o.fetched_on AND (i.valid_to IS NULL OR o.fetched_on < i.valid_to))
SELECT own.page_id, own.host, own.fetched_on, m.domain AS matched_domain, m.status AS status, m.valid_from AS listed_on, coalesce(m.status <> 'block', true) AS kept
FROM own LEFT JOIN (SELECT * FROM matched WHERE k = 1) m ON m.host = own.host AND m.fetched_on = own.fetched_on
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.compare(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS k
  FROM (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS key
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words))),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM windows WHERE k > 1),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words),
kept AS (
  SELECT p.doc_id, count(*) - count(g.j) AS n_kept, string_agg(CASE WHEN g.j IS NULL THEN word END, ' ' ORDER BY p.j) AS rest
  FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.j = p.j GROUP BY p.doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM words LEFT JOIN kept ON kept.doc_id = words.doc_id
"""

QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash, op3_byte_bpe, op4_mpeg_audio, op5_packing, op6_substring_dedup, op7_url_filters, op8_toxicity, op9_lz_fingerprint, op10_suffix_dedup)}
SQL = {"op7_url_filters": OP7_SQL, "op6_substring_dedup": OP6_SQL}
