"""The registered queries of this subpackage: production parameters, whole tables, whole results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import cluster, decontaminate, exact_dedup, jaccard_join, langid, language_model, mixing, substring_dedup, surrogates, tokens, warc
from halyard.session import read_table

#: Uniform hash for folds: crc32 of the id as text; a null id counts as the empty text.
def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score_texts(read_table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_windows(read_table(spark, sf_dir, "documents"), digest=True)
    return out.withColumnsRenamed({"id": "doc_id", "kept": "kept_sha256"})


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = surrogates.replace_personal_data(docs)
    return done.select("doc_id", F.col("clean_text").alias("text"), "n_entities", "entity_kinds", (F.col("n_entities") > 0).alias("has_pii"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"), digests=True).withColumnRenamed("id", "doc_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.poisson_mix(docs, size=F.length(F.coalesce("text", F.lit(""))), temperature=0.5, total=1.0, seed=17)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = cluster.shared_dir(spark)
    warc.write_warc(read_table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path, with_payload=False).where("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = cluster.shared_dir(spark)
    tokens.write_tokens(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_tokens(spark, path)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = langid.fit(docs.where(fold("doc_id", 4) != 2))
    said = langid.identify(docs.select("doc_id", "text"), filters)
    return said.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_decontamination": op4_decontamination,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mixing": op7_mixing,
    "op8_warc": op8_warc,
    "op9_token_ids": op9_token_ids,
    "op10_language_id": op10_language_id,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op4_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win FROM starts),
places AS (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win) AS sizes),
found AS (SELECT p.r, p.s, p.n, win.item_id FROM places AS p JOIN win ON win.win = array_to_string(p.w[p.s:p.s + p.n - 1], ' ')),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT r, s, n FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)""",
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op7_mixing": """
WITH RECURSIVE sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
shares AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size, 0.5) ELSE 0 END AS share FROM sizes),
rates AS (SELECT source, CASE WHEN share > 0 THEN share / (SELECT sum(share) FROM shares) * 1.0 * (SELECT sum(size) FROM shares) / size ELSE 0 END AS rate FROM shares),
cdf(source, rate, k, log_p, c) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM rates WHERE rate > 0
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate) - ln(k + 1), c + exp(log_p + ln(rate) - ln(k + 1)) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
drawn AS (SELECT doc_id, source, text, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (SELECT doc_id, d.source, text, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND c <= u) AS n_copies FROM drawn AS d),
copied AS (SELECT doc_id, source, text, n_copies::INTEGER AS n_copies, unnest(generate_series(1, n_copies))::INTEGER AS copy FROM counted)
SELECT doc_id, source, text, n_copies, copy, md5('17 order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR) AS shuffle_key FROM copied""",
    "op8_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, count(*) OVER (PARTITION BY h) AS copies FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND copies > 1 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND copies > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g""",
}
