"""The queries of the text operators, and DuckDB SQL for those SQL can express.

Each query applies its operator to a whole table with production parameters
and derives the digest columns from what the operator returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import bpe, filter_audit, html_extract, lexical, license_scan, media, quality, secret_scan, simhash, source_mix, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found.withColumn("base", F.filter("spans", lambda s: s["kind"] != "literal"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = source_mix.plan_mix(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(md5(text), 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT *, (place % 3 + 1)::BIGINT AS weight, source_size * 3 AS ceiling FROM per),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(ceiling) OVER (ORDER BY ceiling::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weight) OVER (ORDER BY ceiling::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
targets AS (
  SELECT source, source_size, least(ceiling::DOUBLE, weight * max(level) OVER ()) AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
tried AS (
  SELECT s.source, k, s.size, s.draw + k / 16.0::DOUBLE AS spot, r.rate, r.source_size, r.target
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source CROSS JOIN (SELECT unnest(range(16)) AS k)),
offs AS (
  SELECT source, k, abs(floor(any_value(rate))::BIGINT * any_value(source_size) + sum(CASE WHEN spot - floor(spot) < rate - floor(rate) THEN size ELSE 0 END)::BIGINT - any_value(target)) AS gap
  FROM tried GROUP BY source, k),
turns AS (SELECT source, arg_min(k, {'gap': gap, 'k': k}) AS turn FROM offs GROUP BY source),
drawn AS (
  SELECT s.doc_id, s.size, s.draw + t.turn / 16.0::DOUBLE AS spot, r.source_size, r.target, r.rate
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source JOIN turns t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (floor(rate)::BIGINT + CASE WHEN spot - floor(spot) < rate - floor(rate) THEN 1 ELSE 0 END) * size AS taken
FROM drawn
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, quality.ratios(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.with_license(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license", "dice", "n_licenses")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
firsts AS (SELECT body, min(page_id) AS first FROM p GROUP BY body),
hexed AS (
  SELECT p.page_id, strlen(p.body) AS payload_bytes, sha1(p.body) AS hex, f.first
  FROM p JOIN firsts f USING (body))
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4)::INT)) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM hexed
"""

def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model, out_col="score")
    held_out = toxicity.fold(F.col("doc_id")) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    both = table(spark, sf_dir, "documents").select("doc_id", tokenizer.round_trip("text").alias("both")).select("doc_id", "both.*")
    return both.select("doc_id", bpe.n_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP11_SQL = """
WITH told AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM told q JOIN told c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
norms AS (SELECT doc_id, 100 - 75 + ((75 * n * docs) // terms) AS m FROM lengths CROSS JOIN total),
held AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held CROSS JOIN total GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
failing AS (
  SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
      + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM d),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
classes AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM failing LEFT JOIN said USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT [a, b, c, d, e] AS path FROM f a CROSS JOIN f b CROSS JOIN f c CROSS JOIN f d CROSS JOIN f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (
  SELECT list_aggregate(list_transform(path, lambda p: p.name), 'string_agg', '') AS filter_order, step, path[step].bit AS bit,
         coalesce(list_sum(list_transform(path[1:step - 1], lambda p: p.bit)), 0)::INT AS prefix
  FROM orders CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counts AS (
  SELECT part, bit, prefix, sum(CASE WHEN mask & (prefix | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit > 0 AND mask & prefix = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & prefix > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & prefix = 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & bit > 0 AND mask & prefix = 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
  FROM classes CROSS JOIN (SELECT DISTINCT bit, prefix FROM steps) GROUP BY part, bit, prefix),
every AS (SELECT * FROM steps JOIN counts USING (bit, prefix))
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM every
"""

QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_source_mix": op2_source_mix, "op3_toxicity": op3_toxicity, "op4_simhash": op4_simhash, "op5_html_text": op5_html_text, "op6_media": op6_media, "op7_bpe": op7_bpe, "op8_quality": op8_quality, "op9_license_scan": op9_license_scan, "op10_warc": op10_warc, "op11_topk_search": op11_topk_search, "op12_lexical_search": op12_lexical_search, "op13_filter_audit": op13_filter_audit}
ORACLES = {"op2_source_mix": OP2_SQL, "op9_license_scan": license_scan.oracle("documents"), "op10_warc": OP10_SQL, "op11_topk_search": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_filter_audit": OP13_SQL}
