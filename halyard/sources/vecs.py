"""Vector files (fvecs, ivecs): per row a 32-bit dimension and that many 32-bit numbers.

The reader is a Spark data source: a file is cut into row ranges, one task each, so a large file is
read by many tasks; ``max_rows`` ends the ranges early instead of filtering afterwards.  The writer
makes one file per partition.  After a first ingest, Parquet is the better home for the rows.

Where the files are in a file system that Python cannot open, Hadoop's records of fixed length are
read instead, in ranges too, and what Spark's tasks write is copied by the driver, without the byte
that ends a text, to files of the format.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from halyard.session import byte_chunks, discard, file_system, mounted, shared_dir

RANGE_BYTES = 32 << 20
NUMBERS = {"fvecs": np.dtype("<f4"), "ivecs": np.dtype("<i4")}


def file_shape(path: str, spark: SparkSession | None = None) -> tuple[int, int]:
    """(rows, dimension) from the header and the size; an error if they do not fit together.  With a
    session the file may be in any file system that Spark knows."""
    if spark is not None:
        fs, at = file_system(spark, path)
        if not fs.exists(at):
            raise FileNotFoundError(path)
        size, head = fs.getFileStatus(at).getLen(), np.frombuffer(next(byte_chunks(spark, path, 4), b"")[:4].ljust(4, b"\0"), "<i4")
    else:
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        size, head = os.path.getsize(path), np.fromfile(path, "<i4", 1)
    if len(head) == 0 or head[0] <= 0:
        raise ValueError(f"{path}: bad header")
    record = 4 * (int(head[0]) + 1)
    if size % record:
        raise ValueError(f"{path}: {size} bytes are not a whole number of records of {record}")
    return size // record, int(head[0])


def read_rows(path: str, first: int, last: int, dim: int, kind: np.dtype) -> np.ndarray:
    record = 4 * (dim + 1)
    raw = np.fromfile(path, "<i4", (last - first) * (dim + 1), offset=first * record).reshape(-1, dim + 1) if last > first else np.zeros((0, dim + 1), "<i4")
    if len(raw) != last - first:
        raise ValueError(f"{path}: truncated")
    if (raw[:, 0] != dim).any():
        raise ValueError(f"{path}: rows differ in dimension")
    return raw[:, 1:].copy().view(kind)


def row_bytes(rows: np.ndarray, kind: np.dtype) -> np.ndarray:
    head = np.full((len(rows), 1), rows.shape[1] if rows.ndim == 2 else 0, "<i4")
    return np.hstack([head, np.ascontiguousarray(rows, kind).view("<i4")])


def write_rows(path: str, rows: np.ndarray, kind: np.dtype) -> None:
    row_bytes(rows, kind).tofile(path)


class _Range(InputPartition):
    def __init__(self, path: str, base: int, first: int, last: int, dim: int):
        self.path, self.base, self.first, self.last, self.dim = path, base, first, last, dim


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kind: np.dtype):
        self.path, self.kind = options["path"], kind
        self.limit = int(options.get("max_rows", -1))
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        paths = sorted(os.path.join(self.path, p) for p in os.listdir(self.path) if p.endswith("vecs")) if os.path.isdir(self.path) else [self.path]
        out, base = [], 0
        for path in paths:
            rows, dim = file_shape(path)
            if self.limit >= 0:
                rows = min(rows, self.limit - base)
            step = max(1, self.range_bytes // (4 * (dim + 1)))
            out += [_Range(path, base, a, min(a + step, rows), dim) for a in range(0, rows, step)]
            base += rows
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        rows = read_rows(partition.path, partition.first, partition.last, partition.dim, self.kind)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, partition.dim, dtype=np.int32)), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.last) + partition.base), lists], ["vec_id", "embedding"])


class _Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceArrowWriter):
    """Rows in task order; each task's file becomes visible when the job commits."""

    def __init__(self, options: dict, kind: np.dtype, suffix: str):
        self.folder, self.kind, self.suffix = options["path"], kind, suffix

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        batches = [b for b in iterator if b.num_rows]
        path = os.path.join(self.folder, f".{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.{self.suffix}.tmp")
        if batches:
            rows = np.concatenate([np.stack(b.column(b.schema.get_field_index("embedding")).to_numpy(zero_copy_only=False)) for b in batches])
            write_rows(path, rows, self.kind)
        return _Written(path if batches else "")

    def commit(self, messages) -> None:
        for m in messages:
            if m and m.path:
                folder, name = os.path.split(m.path)
                os.replace(m.path, os.path.join(folder, name[1:-4]))

    def abort(self, messages) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class _Vecs(DataSource):
    kind = "fvecs"

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return f"vec_id bigint, embedding array<{'float' if self.kind == 'fvecs' else 'int'}>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), NUMBERS[self.kind])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), NUMBERS[self.kind], self.kind)


class Fvecs(_Vecs):
    kind = "fvecs"


class Ivecs(_Vecs):
    kind = "ivecs"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Fvecs)
    spark.dataSource.register(Ivecs)


def read_vecs(spark: SparkSession, path: str, kind: str = "fvecs", max_rows: int = -1, range_bytes: int = RANGE_BYTES) -> DataFrame:
    local = mounted(spark, path)
    if local is None:
        return _read_remote(spark, path, kind, max_rows, range_bytes)
    register(spark)
    return spark.read.format(kind).option("max_rows", max_rows).option("range_bytes", range_bytes).load(local)


def write_vecs(df: DataFrame, path: str, kind: str = "fvecs") -> None:
    local = mounted(df.sparkSession, path)
    if local is None:
        return _write_remote(df.select("embedding"), path, kind)
    register(df.sparkSession)
    df.select("vec_id", "embedding").write.format(kind).mode("append").save(local)


def _files(spark: SparkSession, path: str, ending: str) -> list[str]:
    """The files with that ending below a folder, by name; a file itself."""
    fs, at = file_system(spark, path)
    if fs.exists(at) and not fs.getFileStatus(at).isDirectory():
        return [path]
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names) if n.endswith(ending)]


def _read_remote(spark: SparkSession, path: str, kind: str, max_rows: int, range_bytes: int) -> DataFrame:
    def rows(base: int, record: int, last: int, number: np.dtype):
        def of_range(records):
            for at, raw in records:
                if at // record >= last:
                    return
                row = np.frombuffer(raw, "<i4")
                if row[0] != len(row) - 1:
                    raise ValueError(f"{path}: rows differ in dimension")
                yield base + at // record, row[1:].view(number).tolist()

        return of_range

    parts, base, sc, hadoop = [], 0, spark.sparkContext, "org.apache.hadoop"
    for file in _files(spark, path, "vecs"):
        n, dim = file_shape(file, spark)
        n = n if max_rows < 0 else min(n, max_rows - base)
        if n > 0:
            record = 4 * (dim + 1)
            conf = {"fixedlengthinputformat.record.length": str(record), "mapreduce.input.fileinputformat.split.maxsize": str(max(record, range_bytes))}
            read = sc.newAPIHadoopFile(file, f"{hadoop}.mapreduce.lib.input.FixedLengthInputFormat", f"{hadoop}.io.LongWritable", f"{hadoop}.io.BytesWritable", conf=conf)
            parts.append(read.mapPartitions(rows(base, record, n, NUMBERS[kind])))
            base += n
    found = sc.union(parts) if parts else sc.emptyRDD()
    return spark.createDataFrame(found, f"vec_id bigint, embedding array<{'float' if kind == 'fvecs' else 'int'}>", verifySchema=False)


def _write_remote(df: DataFrame, path: str, kind: str) -> None:
    spark, number = df.sparkSession, NUMBERS[kind]

    def blobs(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([row_bytes(np.stack(b.column(0).to_numpy(zero_copy_only=False)), number).tobytes()], pa.binary())], ["value"])

    staged = shared_dir(spark)
    # a string column may hold any bytes, and the text writer writes them as they are and one byte more
    df.mapInArrow(blobs, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(staged)
    (fs, at), jvm, name = file_system(spark, path), spark._jvm, uuid.uuid4().hex
    fs.mkdirs(at)
    placed = []
    for file in _files(spark, staged, ".txt"):
        task, part = re.search(r"part-(\d+)-.*-c(\d+)", file.rsplit("/", 1)[1]).groups()
        own, source = file_system(spark, file)
        if (size := own.getFileStatus(source).getLen() - 1) > 0:
            target = f"{int(task):06d}-{int(part):06d}-{name}.{kind}"
            hidden, to = jvm.org.apache.hadoop.fs.Path(at, f".{target}.tmp"), jvm.org.apache.hadoop.fs.Path(at, target)
            stream, out = own.open(source), fs.create(hidden, True)
            try:
                jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, size)
            finally:
                stream.close()
                out.close()
            placed.append((hidden, to))
    for hidden, to in placed:
        if not fs.rename(hidden, to):
            raise OSError(f"{to} was not made")
    discard(spark, staged)
