"""A corpus from raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; ``run`` writes it as Parquet and reads it again as the next one's docs.  All stages but
the last return the columns of documents.

Defined results: documents without an id or with a repeated one are kept or dropped with that id
(one without an id is never dropped as a copy or as contaminated); empty tables go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import cluster, decontaminate, jaccard_join, langid, mixing, tokens
from halyard.llm.queries import fold
from halyard.session import made_so_far, read_table, ship_package, sweep

#: A text of at least this many characters whose coverage is below this is in no learned language.
LONG_CHARS, LEAST_COVERAGE = 200, 0.3


def _as(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of documents, in their order."""
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: goes what has no letter, and long texts few of whose n-grams
    the filters know in any one language."""
    ship_package(spark)
    filters = langid.fit(docs.where(fold("doc_id", 4) != 2))
    lang, score, coverage = cluster.unused(docs, "said_lang", "said_score", "said_coverage")
    said = langid.identify(docs, filters, lang=lang, score=score, coverage=coverage)
    unclear = (F.length("text") >= LONG_CHARS) & (F.col(coverage) < LEAST_COVERAGE)
    return _as(docs, said.where((F.col(lang) != "und") & ~unclear))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by Jaccard similarity, the one with the smallest id."""
    ship_package(spark)
    found = jaccard_join.jaccard_components(docs)
    copies = found.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    return _as(docs, docs.join(copies, "doc_id", "left_anti"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    ship_package(spark)
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    hit = found.where("n_hit > 0").select(F.col("id").alias("doc_id")).distinct()
    return _as(docs, docs.join(hit, "doc_id", "left_anti"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by the square root of the sources' sizes, in global random order."""
    ship_package(spark)
    copy, copies, key = cluster.unused(docs, "copy", "n_copies", "shuffle_key")
    return _as(docs, mixing.poisson_mix(docs, size=F.length(F.coalesce("text", F.lit(""))), temperature=0.5, total=1.0, seed=17, copy=copy, copies=copies, key=key))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of all copies; a row for each, read back from the files."""
    ship_package(spark)
    import public_tokenizers

    path = cluster.shared_dir(spark, "tokens")
    tokens.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_tokens(spark, path)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_ids", token_files),
]

#: Language filters, the Poisson draw over what is left and BPE are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage wrote on its way, and its input, go when its result is kept;
    the token files stay."""
    docs, before = read_table(spark, sf_dir, "documents"), made_so_far(spark)
    for _, stage in STAGES:
        path = cluster.shared_dir(spark)
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        sweep(spark, before, keep=(path,))
    return docs
