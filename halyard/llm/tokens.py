"""Token ids as flat binary files.

A part file is a run of documents in ascending id order::

    ids       n_tokens unsigned integers (16 bits if all ids fit, else 32), little-endian
    offsets   n_docs + 1 unsigned 64-bit integers: where each document's ids start in this part
    doc_ids   n_docs signed 64-bit integers
    footer    magic, item size, n_docs, n_tokens, null flag (five 64-bit integers)
    guard     GUARD zero bytes

so ``numpy.memmap(path, dtype, "r", shape=n_tokens)`` maps the ids without a header to skip, and
``map_part`` maps a whole file.  Readers map files of a mounted file system (``file:``); from any
other store Spark hands over the bytes.  A part's place in the whole is the prefix sum of the
parts before it (``bases``): a table of one row per part, summed over the cluster and joined.

Documents are range-partitioned by id (null ids first) and the beginning of the text, so rows that
share an id, or have none, are spread too; each task encodes its documents and emits files of
about ``FILE_TOKENS`` tokens, and Spark writes them, so any file system it knows will do.  A file
in progress is the only thing a task holds.

Encoding: as the tokenizers library does by default without adding special tokens.  Strings of the
vocabulary's added tokens get their own ids; the text between them is cut where the byte-level
pattern always starts a new piece (see ``Encoder.cuts``), and each distinct piece is encoded once.

Defined results: a null text is empty and has only the end id; repeated ids are separate
documents, in text order; an empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import cluster
from halyard.llm.text import as_binary, flat_bytes, release
from halyard.operators.ranks import running_total

MAGIC = int.from_bytes(b"tokparts", "little")
FILE_TOKENS = 4 << 20
BATCH_BYTES = 1 << 20
GUARD = 4
#: Beginning of a text that range-partitions rows of one id.
HEAD_CHARS = 16
NO_ID = np.iinfo(np.int64).min
_LETTER = np.array([chr(b).isalpha() and b < 0x80 for b in range(256)])
_MARK = np.array([0x20 < b < 0x7F and not chr(b).isalnum() for b in range(256)])


class Encoder:
    """Encodes batches of texts.  A text is cut into pieces that encode alone as they do in place;
    each distinct piece of a batch is encoded once, and the first ``REMEMBER`` pieces a worker meets
    (the frequent ones among them) are kept with their ids.  ``encode_whole`` takes any text;
    ``encode`` reads the string of an added token as ordinary text."""

    REMEMBER = 200_000
    TOGETHER = 500

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # pieces are cut inside added tokens; encode_whole knows those
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content.encode(): i for i, t in added.items() if t.content}
        #: Whether a token takes in or looks at what is beside it: then the library reads the whole text.
        self.bound = any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.library = Tokenizer.from_file(path) if self.bound else None
        longest = sorted(self.added, key=len, reverse=True)  # the first match, and of those the longest
        self.token = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        vocabulary = self.tokenizer.get_vocab()
        self.top = max(vocabulary.values())
        self.length = np.zeros(self.top + 1, np.int64)  # bytes: a byte-level token has a letter for each
        for token, i in vocabulary.items():
            self.length[i] = len(token)
        self.seen: dict[bytes, bytes] = {}

    @staticmethod
    def _firm(data: np.ndarray) -> np.ndarray:
        """Bytes that end a printable ASCII character or a letter of U+00C0 to U+00FF: no white space."""
        firm = (data > 0x20) & (data < 0x7F)
        firm[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
        return firm

    @classmethod
    def cuts(cls, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin: at each text, at each space after a firm byte, and at each ASCII
        punctuation mark after an ASCII letter (a run of letters ends there in any case)."""
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets] = True
        begin[1:-1] |= (data[1:] == 0x20) & cls._firm(data)[:-1]
        begin[1:-1] |= _MARK[data[1:]] & _LETTER[data[:-1]]
        return np.flatnonzero(begin)

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces, each as the bytes of unsigned 32-bit integers.  Pieces between
        a space and a firm byte encode alike side by side, so many go through the library as one
        text and are told apart by the lengths of their tokens; others go one by one."""
        out: list[bytes] = [b""] * len(pieces)
        last = np.array([(p[-2:-1] == b"\xc3") | (0x20 < p[-1] < 0x7F) for p in pieces])
        firm = [i for i, ok in enumerate(last.tolist()) if ok and pieces[i][0] == 0x20]
        alone = sorted(set(range(len(pieces))).difference(firm))
        encode = self.tokenizer.encode_batch_fast
        for i, e in zip(alone, encode([pieces[i].decode("utf-8") for i in alone], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32).tobytes()
        for at in range(0, len(firm), self.TOGETHER):
            some = firm[at : at + self.TOGETHER]
            text = b"".join([pieces[i] for i in some]).decode("utf-8")
            ids = np.array(encode([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.length[ids])
            stop = np.searchsorted(ends, np.cumsum([len(pieces[i]) for i in some]), "right")
            raw, begin = ids.tobytes(), 0
            for i, end in zip(some, (4 * stop).tolist()):
                out[i] = raw[begin:end]
                begin = end
        return out

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        data, offsets = flat_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        cuts = self.cuts(data, offsets)
        coded = as_binary(data, cuts).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        ids = [self.seen.get(p) for p in pieces]
        missing = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(missing, self._ids([pieces[i] for i in missing]) if missing else ()):
            ids[i] = x
            if len(self.seen) < self.REMEMBER:
                self.seen[pieces[i]] = x
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        start = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        length = size[which]
        to = np.concatenate([[0], np.cumsum(length)])
        source = np.repeat(start[which] - to[:-1], length)
        source += np.arange(to[-1])
        return flat[source], np.diff(to[np.searchsorted(cuts, offsets)])

    def encode_whole(self, column) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, but strings of added tokens get the ids of those."""
        data, offsets = flat_bytes(column)
        raw = data.tobytes()
        if self.token is None or not self.token.search(raw):
            return self.encode(column)
        edges = [0]  # of the parts: of each text in turn one without a token, then a token, and so on
        first, known = [0], []  # a text's first part; (part, ids) of those that are not to be cut
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if self.bound and self.token.search(raw, a, b):
                known.append((len(edges) - 1, self.library.encode(raw[a:b].decode("utf-8"), add_special_tokens=False).ids))
            else:
                for m in self.token.finditer(raw, a, b):
                    known.append((len(edges), [self.added[m[0]]]))
                    edges += m.span()
            edges.append(b)
            first.append(len(edges) - 1)
        size = np.diff(edges)
        which = np.array([i for i, _ in known], np.int64)
        plain = np.ones(len(size), bool)
        plain[which] = False
        rest = np.concatenate([[0], np.cumsum(size * plain)])
        flat, count = self.encode(as_binary(data[np.repeat(plain, size)], rest))
        ids = np.array([x for _, more in known for x in more], np.uint32)
        more = np.array([len(x) for _, x in known], np.int64)
        flat = np.insert(flat, np.repeat((np.cumsum(count) - count)[which], more), ids)
        count[which] = more
        return flat, np.diff(np.concatenate([[0], np.cumsum(count)])[first])


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The worker's encoder; it outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _part(ids: list[np.ndarray], counts: list[np.ndarray], doc_ids: list[np.ndarray], nulls: bool, kind) -> bytes:
    flat, count, doc = np.concatenate(ids), np.concatenate(counts), np.concatenate(doc_ids)
    ids.clear()
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.uint64)
    footer = np.array([MAGIC, np.dtype(kind).itemsize, len(count), len(flat), int(nulls)], np.int64)
    return b"".join([flat.data, offsets.data, doc.astype(np.int64).data, footer.data])


def map_part(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """``parse_part`` of a file that is mapped into memory: only the pages that are used are read."""
    return parse_part(np.memmap(path, np.uint8, "r"))


def parse_part(content: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(ids, offsets, doc_ids, whether NO_ID stands for null) of a part file's bytes."""
    end = len(content) - GUARD
    magic, item, docs, tokens, nulls = np.frombuffer(content, np.int64, 5, end - 40).tolist()
    if magic != MAGIC or item not in (2, 4) or tokens * item + (docs + 1) * 8 + docs * 8 + 40 + GUARD != len(content):
        raise ValueError("not a whole part file")
    ids = np.frombuffer(content, f"<u{item}", tokens)
    offsets = np.frombuffer(content, "<u8", docs + 1, tokens * item)
    return ids, offsets, np.frombuffer(content, "<i8", docs, tokens * item + (docs + 1) * 8), bool(nulls)


def _write_partition(tokenizer_path: str, end_id: int, file_tokens: int):
    def of_partition(batches):
        encoder = encoder_for(tokenizer_path)
        kind = np.uint16 if max(encoder.top, end_id) < 1 << 16 else np.uint32
        ids, counts, docs, held, nulls, number = [], [], [], 0, False, 0

        def flush():
            nonlocal ids, counts, docs, held, nulls, number
            out = pa.RecordBatch.from_arrays([pa.array([_part(ids, counts, docs, nulls, kind)], pa.binary())], ["value"])
            ids, counts, docs, held, nulls, number = [], [], [], 0, False, number + 1
            return out

        for batch in batches:
            offsets = flat_bytes(batch.column(1))[1]
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, "right")) - 1)
                piece = batch.slice(at, to - at)
                flat, count = encoder.encode_whole(piece.column(1))
                ids.append(np.insert(flat.astype(kind), np.cumsum(count), end_id))
                counts.append(count + 1)
                nulls |= piece.column(0).null_count > 0
                docs.append(piece.column(0).fill_null(NO_ID).to_numpy())
                held += len(ids[-1])
                at = to
                if held >= file_tokens:
                    yield flush()
                    release()
        if held:
            yield flush()
        release()

    return of_partition


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_tokens: int = FILE_TOKENS) -> None:
    """Write part files below ``path``: partition order is id order, and so is file name order."""
    n = cluster.partitions(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.substring(text_col, 1, HEAD_CHARS).alias("head"))
    ordered = own.repartitionByRange(n, "id", "head").sortWithinPartitions("id", "text").select("id", "text")
    parts = ordered.mapInArrow(_write_partition(tokenizer_path, end_id, file_tokens), "value binary")
    # a string column may hold any bytes, and the text writer writes them as they are
    parts.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0" * GUARD).text(path)


def _documents(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    """(task, file, doc_id, at, n_tokens, ids_crc32): the documents of each part file, which Spark names
    by task and by number within the task; ``at`` counts from the start of the file."""
    mounted = path.startswith("file:") or "://" not in path and spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:").startswith("file:")

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), [None] * batch.num_rows if mounted else batch.column(1).to_pylist()):
                ids, offsets, docs, nulls = map_part(unquote(urlparse(name).path)) if mounted else parse_part(content)
                task, file = (int(x) for x in re.search(r"part-(\d+)-.*-c(\d+)", name).groups())
                n = len(docs)
                edges = offsets.astype(np.int64)
                cut = edges.tolist()
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(cut[:-1], cut[1:])]
                doc = pa.array(docs, pa.int64(), mask=(docs == NO_ID) if nulls else None)
                columns = [pa.array([task] * n, pa.int64()), pa.array([file] * n, pa.int64()), doc, pa.array(edges[:-1]), pa.array(np.diff(edges)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["task", "file", "doc_id", "at", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    schema = "task bigint, file bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select("path", *([] if mounted else ["content"])).mapInArrow(rows, schema)


def bases(documents: DataFrame) -> DataFrame:
    """(task, file, tokens, base): of each part file its tokens and those of all parts before it."""
    totals = documents.groupBy("task", "file").agg(F.sum("n_tokens").alias("tokens"))
    return running_total(totals, ["task", "file"], "tokens", "base")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (over the ids as
    little-endian unsigned 32-bit integers), with ``with_ids`` also the ids."""
    narrow = cluster.saved(_documents(spark, path, False))
    rows = _documents(spark, path, True) if with_ids else narrow
    placed = rows.join(bases(narrow).select("task", "file", "base"), ["task", "file"])
    return placed.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
