"""What operators need to know of the cluster: folders, partition counts, saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.session import discard, shared_dir  # noqa: F401

#: Text bytes that one chunk of documents or one bucket should hold; bounds a Python group's memory.
CHUNK_BYTES = 4 << 20


def saved(df: DataFrame, codec: str = "zstd", **options) -> DataFrame:
    """The rows written to the shared folder and read back: cuts lineage, survives lost executors."""
    return saved_at(shared_dir(df.sparkSession), df, codec, **options)


def saved_at(path: str, df: DataFrame, codec: str = "zstd", **options) -> DataFrame:
    """The same at a given place, for tables that ``discard`` is to delete."""
    df.write.options(compression=codec, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_size(df: DataFrame, column: str) -> int:
    """Bytes of all texts of a column."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def pieces(n_bytes: int, least: int, size: int = CHUNK_BYTES) -> int:
    """How many chunks or buckets hold n_bytes in pieces of about ``size``, not below ``least``."""
    return max(1, least if n_bytes > least * 4096 else 1, -(-n_bytes // size))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until the table has no column of that name."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without columns that an operator is about to add under these names."""
    lost = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lost])
