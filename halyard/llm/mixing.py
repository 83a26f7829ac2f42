"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate (target share x wanted total / its size).  A document's
uniform number comes from a hash of seed and id; inverting the Poisson distribution of its
source's rate at that number gives its count of copies.  A rate above ``PIECE`` is a sum of whole
pieces and a rest: Poisson counts add up, so the rest and each piece are drawn on their own, with a
hash of seed, id and the piece's number, and the distribution to invert never has more than a
few hundred steps, whatever the rate.  Copies are exploded and shuffled globally:
each has a sort key hashed from seed, id and copy number, partitions are slices of the key space
and are sorted by the key.  Nothing is drawn at run time, so a lost executor's work repeats alike.

The rates have one row per source, of bounded size; they are broadcast while below
``BROADCAST_SOURCES`` rows and joined by shuffle beyond.  The only shuffle of documents is the wanted one.

Defined results: a null source is a source of its own; rows with the same id (or a null id) draw
the same count; a source without a given target gets none (rate 0); an empty table gives an empty
result; all input columns are kept but those that have the name of an added one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm import cluster

BROADCAST_SOURCES = 10_000
#: Bits of a hash that make the uniform number (exact in a double).
BITS = 52
#: The largest rate that is drawn in one piece.
PIECE = 64.0


def _hash_bits(*parts: Column) -> Column:
    """The first 52 bits of the MD5 of the parts joined by ':'."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")


def uniform(seed: int, *parts: Column) -> Column:
    return _hash_bits(F.lit(seed), *parts) / F.lit(float(1 << BITS))


def poisson_cdf(rate: Column) -> Column:
    """P(count <= 0), P(count <= 1), ... up to where 1 - P is far below the 2^-52 of the draw."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log_p"), F.array(F.exp(-rate)).alias("cdf"))
    step = lambda a, k: F.struct(
        (a.log_p + F.log(rate) - F.log(k.cast("double"))).alias("log_p"),
        F.array_append(a.cdf, F.element_at(a.cdf, -1) + F.exp(a.log_p + F.log(rate) - F.log(k.cast("double")))).alias("cdf"),
    )
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), top), start, step, lambda a: a.cdf)).otherwise(F.array(F.lit(1.0)))


def repetition_rates(docs: DataFrame, source_col: str, size: Column, targets: dict[str, float] | None, temperature: float, total: float) -> DataFrame:
    """source, size, rate.  Without ``targets`` a source's share is its size to the power ``temperature``."""
    sizes = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.sum(size).cast("double").alias("mix_size"))
    if targets is None:
        share = F.pow("mix_size", F.lit(float(temperature)))
    else:
        given = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
        share = F.coalesce(given[F.col("mix_source")], F.lit(0.0)).cast("double")
    sizes = sizes.withColumn("share", F.when(F.col("mix_size") > 0, share).otherwise(0.0))
    sums = sizes.agg(F.sum("share").alias("all_shares"), F.sum("mix_size").alias("all_sizes"))
    rate = F.col("share") / F.col("all_shares") * F.lit(float(total)) * F.col("all_sizes") / F.col("mix_size")
    return sizes.crossJoin(F.broadcast(sums)).select("mix_source", "mix_size", F.when(F.col("share") > 0, rate).otherwise(0.0).alias("mix_rate"))


def poisson_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, targets: dict[str, float] | None = None, temperature: float = 0.5, total: float = 1.0, seed: int = 17, copy: str = "copy", copies: str = "n_copies", key: str = "shuffle_key") -> DataFrame:
    """The documents' columns, one row per copy, and copy (from 1), copies, key; in global random order."""
    spark = docs.sparkSession
    docs = cluster.without(docs, copy, copies, key)
    of, pieces, cdf, full, u = cluster.unused(docs, "mix_source", "mix_pieces", "mix_cdf", "mix_full", "mix_u")
    rates = repetition_rates(docs, source_col, F.lit(1) if size is None else size, targets, temperature, total)
    whole = F.when(F.col("mix_rate") > PIECE, F.floor(F.col("mix_rate") / PIECE)).otherwise(0).cast("int")
    rates = cluster.saved(rates.withColumn("whole", whole).withColumn("cdf", poisson_cdf(F.col("mix_rate") - F.col("whole") * PIECE)))
    known = rates.select(F.col("mix_source").alias(of), F.col("whole").alias(pieces), F.col("cdf").alias(cdf), poisson_cdf(F.lit(PIECE)).alias(full))
    if rates.count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    drawn = docs.join(known, F.col(source_col).eqNullSafe(F.col(of))).withColumn(u, uniform(seed, F.col(id_col)))
    inverted = lambda steps, at: F.size(F.filter(steps, lambda c: c <= at))
    more = F.aggregate(F.sequence(F.lit(1), F.col(pieces)), F.lit(0), lambda n, i: n + inverted(full, uniform(seed, F.col(id_col), F.concat(F.lit("piece "), i))))
    drawn = drawn.withColumn(copies, inverted(cdf, F.col(u)) + F.when(F.col(pieces) > 0, more).otherwise(0)).where(F.col(copies) > 0)
    out = drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(of, pieces, cdf, full, u)
    out = out.withColumn(key, F.md5(F.concat_ws(":", F.lit(f"{seed} order"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(copy))))
    n = cluster.partitions(spark)
    slot = (F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * n / F.lit(float(1 << 32))).cast("int")
    return out.repartitionById(n, slot).sortWithinPartitions(key)
