"""Tables with identities, run records and manifests.

Content identities are digests of a table's rows in key order, computed as a pre-aggregated sum
of row hashes, so no row order has to be restored and nothing is gathered.
"""

from __future__ import annotations

import hashlib
import json
import platform
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.session import byte_chunks, put_bytes


def row_hash(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def content_digest(df: DataFrame, *columns: str) -> str:
    """16 hexadecimal digits that depend on the rows but not on their order or partitioning."""
    columns = columns or tuple(df.columns)
    h = row_hash(*columns)
    count, xor, total = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(row_hash(F.lit(1), *columns), F.lit(1 << 31)))).first()
    return f"{(xor or 0) & (1 << 64) - 1 ^ ((total or 0) * 0x9E3779B97F4A7C15 + (count or 0)) & (1 << 64) - 1:016x}"


def write_neighbours(df: DataFrame, path: str) -> None:
    """A neighbour table (long form) without identity."""
    df.select("query_id", "rank", "neighbor_id", "distance").write.mode("overwrite").parquet(path)


def read_neighbours(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_ground_truth(df: DataFrame, path: str, condition_id: str, mask_hash: str, query_hash: str) -> None:
    """Rows with their identity, partitioned by condition, so a reader of one condition prunes the rest."""
    named = df.select(F.lit(mask_hash).alias("mask_hash"), F.lit(query_hash).alias("query_hash"), "query_id", "rank", "neighbor_id", "distance", F.lit(condition_id).alias("condition_id"))
    named.write.mode("append").partitionBy("condition_id").parquet(path)


def read_ground_truth(spark: SparkSession, path: str, condition_id: str, mask_hash: str, query_hash: str) -> DataFrame:
    """The rows of a condition, refused unless all three identities agree."""
    rows = spark.read.parquet(path).where(F.col("condition_id") == condition_id)
    found = rows.select("mask_hash", "query_hash").distinct().limit(2).collect()
    if [tuple(r) for r in found] != [(mask_hash, query_hash)]:
        raise ValueError(f"ground truth of {condition_id} has other identities: {found}")
    return rows


def write_attribute(df: DataFrame, path: str) -> str:
    """A rank attribute with its content digest beside it; returns the digest."""
    digest = content_digest(df, "vec_id", "rank", "cluster")
    df.withColumn("content_hash", F.lit(digest)).write.mode("overwrite").parquet(path)
    return digest


def read_attribute(spark: SparkSession, path: str, expected: str | None = None) -> DataFrame:
    """The attribute, after its content was digested again and compared."""
    rows = spark.read.parquet(path)
    said = [r[0] for r in rows.select("content_hash").distinct().limit(2).collect()]
    found = content_digest(rows, "vec_id", "rank", "cluster")
    if said != [found] or expected not in (None, found):
        raise ValueError(f"attribute content is {found}, stored {said}, expected {expected}")
    return rows.drop("content_hash")


def cached(spark: SparkSession, folder: str, name: str, key: str, compute) -> DataFrame:
    """The table kept under name and key, computed and written first if it is not there."""
    path = f"{folder.rstrip('/')}/{name}-{key}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_partitioned_csv(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(pattern)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def read_json_records(spark: SparkSession, pattern: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(pattern)


def _put_text(path: str, text: str, spark: SparkSession | None) -> None:
    """A small document, in any file system that Spark knows if a session is given, else a local one."""
    if spark is None:
        Path(path).write_text(text)
    else:
        put_bytes(spark, path, text.encode())


def read_text(path: str, spark: SparkSession | None = None) -> str:
    return Path(path).read_text() if spark is None else b"".join(byte_chunks(spark, path)).decode()


def write_run_record(path: str, record: dict, spark: SparkSession | None = None) -> None:
    """A small document from the driver: keys keep their order, numbers that JSON lacks become null."""
    clean = {k: (None if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v) for k, v in record.items()}
    _put_text(path, json.dumps(clean, indent=2) + "\n", spark)


def read_manifest(path: str, spark: SparkSession | None = None) -> dict:
    import yaml

    return yaml.safe_load(read_text(path, spark))


def write_manifest(path: str, header: dict, conditions: DataFrame, spark: SparkSession | None = None) -> None:
    """A YAML manifest: a header and the list of conditions (one row per condition: small)."""
    import yaml

    _put_text(path, yaml.safe_dump(header | {"conditions": [r.asDict() for r in conditions.collect()]}, sort_keys=False), spark)


def manifest_conditions(spark: SparkSession, manifest: dict, schema: T.StructType) -> DataFrame:
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(c.get(n) for n in names) for c in manifest["conditions"]], schema)


def select_manifest(conditions: DataFrame, levels=None, realizations=None, selectivities=None, renames: dict[str, str] | None = None) -> DataFrame:
    """The conditions of some levels, realizations and selectivities, renamed where asked."""
    out = conditions
    for column, wanted in (("level", levels), ("realization", realizations), ("s_requested", selectivities)):
        if wanted is not None:
            out = out.where(F.col(column).isin(list(wanted)))
    if renames:
        names = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair])
        out = out.withColumn("condition", F.coalesce(names[F.col("condition")], F.col("condition")))
    return out


def file_digest(path: str, chunk: int = 4 << 20, spark: SparkSession | None = None) -> str:
    """SHA-256 of a file, read in chunks."""
    h = hashlib.sha256()
    if spark is not None:
        for block in byte_chunks(spark, path, chunk):
            h.update(block)
        return h.hexdigest()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def run_header(spark: SparkSession, stage: str, **more) -> dict:
    """What a run record starts with: a UTC stamp, versions and the machine."""
    stamp = time.strftime("%Y%m%dT%H%M%SZ", time.gmtime())
    return {"run_id": stamp, "stage": stage, "spark": spark.version, "python": platform.python_version(), "machine": platform.machine(), "cores": spark.sparkContext.defaultParallelism, **more}


def markdown(df: DataFrame, limit: int = 100) -> str:
    """A report table as text: the first rows only, it is for reading."""
    rows = [[str(v) for v in r] for r in df.limit(limit).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["-"] * len(df.columns), *rows])
