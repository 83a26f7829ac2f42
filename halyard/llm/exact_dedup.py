"""Exact deduplication by progressive refinement, in DataFrame functions only.

Level by level: documents are grouped by the length of their normalised text, groups of two or
more by a hash of its first bytes, and what is left in company by the SHA-256 of the whole
normalised text.  The first scan takes lengths and prefix hashes only.  The second scan, after
those have decided, reads the full text of what survives and takes its digest.  A caller who wants
the digest of every row (``digests=True``) has the others taken there too, for the output alone.
No text enters a shuffle: the second scan meets the surviving classes in a broadcast while they are
below ``BROADCAST_CLASSES``; beyond that it digests all rows, which costs time but no memory.

Hot groups: lengths and prefixes are counted before they are joined, so a common length costs a
row for each of its prefixes, not for each document; group sizes come from pre-aggregated counts
and are saved, so that rows meet them in a plain equi-join whose large partitions Spark may split.

Defined results: a null text counts as empty; a null id is larger than any id; rows that share the
id of the row that stays count as that row; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm import cluster

WHITE_SPACE = r"[\x20\x09-\x0D]+"
PREFIX_CHARS = 64
#: So many (length, prefix) classes with company are broadcast to the second scan.
BROADCAST_CLASSES = 200_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def company(docs: DataFrame, text_col: str) -> DataFrame:
    """(n_bytes, head) of the lengths, and in those of the prefixes, that more than one row has."""
    norm = normalised(F.col(text_col))
    first = docs.select(F.octet_length(norm).alias("n_bytes"), F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("head"))
    classes = cluster.saved(first.groupBy("n_bytes", "head").agg(F.count(F.lit(1)).alias("n")))
    lengths = classes.groupBy("n_bytes").agg(F.sum("n").alias("n")).where("n > 1").select("n_bytes")
    return classes.join(lengths, "n_bytes", "left_semi").where("n > 1").select("n_bytes", "head")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept; with ``digests`` also text_sha256.

    Of equal texts the row with the most code points in the original text stays, of those the one
    with the smallest id."""
    left = cluster.saved(company(docs, text_col))
    norm = normalised(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("n_chars"), norm.alias("norm"))
    head = F.xxhash64(F.substring("norm", 1, PREFIX_CHARS))
    keyed = keyed.select("id", "n_chars", F.octet_length("norm").alias("n_bytes"), head.alias("head"), "norm")
    digest = F.sha2("norm", 256)
    if not digests and left.count() <= BROADCAST_CLASSES:
        keyed = keyed.join(F.broadcast(left.withColumn("company", F.lit(True))), ["n_bytes", "head"], "left")
        digest = F.when(F.col("company"), digest)
    rows = cluster.saved(keyed.select("id", "n_chars", "n_bytes", "head", digest.alias("text_sha256")))

    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id"))
    survivors = rows.join(left, ["n_bytes", "head"], "left_semi")
    groups = survivors.groupBy("n_bytes", "text_sha256").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).where("group_size > 1")
    groups = cluster.saved(groups.select("n_bytes", "text_sha256", "group_size", F.col("best.id").alias("keep_id")))
    out = rows.join(groups, ["n_bytes", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("id"))
    out = out.select("id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), "text_sha256")
    return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), *(["text_sha256"] if digests else []))
