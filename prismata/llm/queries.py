"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismata.llm import decontamination, exact_dedup, html_extraction, language_id, language_model, license_scan, mixing, ngram_join, sharding, toxicity

SHARDS = [f"shard-{k:02d}" for k in range(16)]
TABLE_SIZE = 2039  # a prime over 100 times the shards


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = language_model.train(docs.where(~language_model.held_out(7)))
    scored = language_model.score(docs, model)
    return scored.select("doc_id", language_model.held_out(7).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "text", "copy_no", "n_copies", "shuffle_key")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extraction.extract_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_table(spark, sf_dir, "documents"), SHARDS, TABLE_SIZE)
    return placed.select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "slot", "shard")


def op5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_model.held_out(4)))
    said = language_id.identify(docs, model)
    return said.select("doc_id", language_model.held_out(4).alias("held_out"), "lang_pred", "score", "rejected", "bits")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    index = toxicity.train(docs.where(~language_model.held_out(4)), _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, index)
    return scored.select("doc_id", language_model.held_out(4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    places, base = F.col("base.place"), F.array_distinct("base.label")
    both = F.array_sort(F.array_distinct(F.concat(base, F.col("detections.label"))))
    score = F.greatest(F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)), F.when(F.size("base") > 0, 0.6).otherwise(0.0))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"), F.size("detections").alias("n_detections"))


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_mix": op2_mix,
    "op3_main_text": op3_main_text,
    "op4_shard": op4_shard,
    "op5_leaks": op5_leaks,
    "op6_language": op6_language,
    "op7_jaccard": op7_jaccard,
    "op8_toxicity": op8_toxicity,
    "op9_licenses": op9_licenses,
    "op10_exact": op10_exact,
}

_OP2_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, sum(greatest(coalesce(octet_length(encode(text)), 1), 1))::DOUBLE AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, pow(size, 0.7) / sum(pow(size, 0.7)) OVER () * sum(size) OVER () / size AS mean FROM sizes
), cdf(source, mean, k, lp, c) AS (
  SELECT source, mean, 0, -mean, exp(-mean) FROM rates
  UNION ALL
  SELECT source, mean, k + 1, lp + ln(mean) - ln(k + 1), c + exp(lp + ln(mean) - ln(k + 1)) FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean) + 40)
), docs AS (
  SELECT doc_id, source, text, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / pow(16, 13) AS u FROM documents
), counted AS (
  SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u)::INTEGER AS n_copies FROM docs d
)
SELECT doc_id, source, text, copy_no::INTEGER AS copy_no, n_copies, md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy_no) AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM counted WHERE n_copies > 0)
"""

_OP4_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT k, 'shard-' || lpad(k::VARCHAR, 2, '0') AS shard FROM range({len(SHARDS)}) t(k)
), seeds AS (
  SELECT k, shard, ('0x' || substr(md5('offset:' || shard), 1, {sharding.HEX}))::BIGINT % {TABLE_SIZE} AS pos, ('0x' || substr(md5('skip:' || shard), 1, {sharding.HEX}))::BIGINT % ({TABLE_SIZE} - 1) + 1 AS skip FROM shards
), wishes AS (
  SELECT k, list((pos + j * skip) % {TABLE_SIZE} ORDER BY j) AS wish FROM seeds, range({TABLE_SIZE}) t(j) GROUP BY k
), turns(turn, taken, slot) AS (
  SELECT 0, list_transform(range({TABLE_SIZE}), lambda x: false), NULL::BIGINT
  UNION ALL
  SELECT turn + 1, list_transform(range({TABLE_SIZE}), lambda x: taken[x + 1] OR x = next), next
  FROM (SELECT turn, taken, list_filter(wish, lambda s: NOT taken[s + 1])[1] AS next FROM turns JOIN wishes ON wishes.k = turn % {len(SHARDS)} WHERE turn < {TABLE_SIZE})
), filled AS (
  SELECT slot, shard FROM turns JOIN shards ON shards.k = (turn - 1) % {len(SHARDS)} WHERE slot IS NOT NULL
)
SELECT d.doc_id, d.source, coalesce(octet_length(encode(d.text)), 0)::BIGINT AS n_bytes, d.slot, f.shard
FROM (SELECT *, (('0x' || substr(md5('key:' || coalesce(doc_id::VARCHAR, 'null')), 1, {sharding.HEX}))::BIGINT % {TABLE_SIZE})::INTEGER AS slot FROM documents) d
LEFT JOIN filled f ON f.slot = d.slot
"""

_OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT o.a, o.b FROM common o JOIN sizes x ON x.doc_id = o.a JOIN sizes y ON y.doc_id = o.b WHERE 100 * o.n >= 80 * (x.n + y.n - o.n)
), reach(id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.n, 0)::BIGINT AS n_links, r.component_id
FROM documents d
LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = d.doc_id
JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) r ON r.id = d.doc_id
"""

_OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

ORACLES: dict[str, str] = {"op2_mix": _OP2_SQL, "op4_shard": _OP4_SQL, "op7_jaccard": _OP7_SQL, "op10_exact": _OP10_SQL}
