"""Session helpers shared by the whole library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="halyard-code-"), "halyard_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession, name: str = "halyard") -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share.  Where that setting is
    absent a temporary folder serves a local master; a cluster needs the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="halyard-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if name == "halyard":
        _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def sweep(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the intermediate folders that this application made, from number ``since`` on, but those
    in ``keep``.  Tables that still read them must have been written elsewhere."""
    discard(spark, *[path for path in _made.get(spark.sparkContext.applicationId, [])[since:] if path not in keep])


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate folders that nothing reads any more."""
    made = _made.get(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in made:
            made.remove(path)


def made_so_far(spark: SparkSession) -> int:
    """The number of intermediate folders, for ``sweep``."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system, path) of a place, whatever file system Spark knows it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path by which Python opens a place, or None if only Spark can."""
    at = file_system(spark, path)[1].toUri()
    return at.getPath() if at.getScheme() == "file" else None


def put_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, from the driver."""
    fs, at = file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def byte_chunks(spark: SparkSession, path: str, chunk: int = 4 << 20) -> Iterator[bytes]:
    """A file's bytes in pieces, to the driver."""
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        while block := bytes(stream.readNBytes(chunk)):
            yield block
    finally:
        stream.close()


def written(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: cuts lineage in loops and survives lost
    executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
