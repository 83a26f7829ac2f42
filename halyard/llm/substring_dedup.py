"""Exact removal of repeated word windows (super-k-mer partitioning).

A window is ``k`` consecutive words of one document.  Consecutive windows that share a minimiser
(the least hash among their ``m``-word pieces) travel together as one packed string to the bucket
of that minimiser.  Equal windows have equal minimisers, so each bucket sees all copies of its
windows; there they are sorted by hash, neighbours are compared byte by byte, and each gets the
smallest document id in which it starts.

Hot keys: documents are dealt into chunks by a hash of the id, and a chunk sends each different
packed string once, with the smallest and largest id it stands in.  A passage that a third of all
documents share therefore costs a bucket one string per chunk, not one per document.  The answers
go back to the chunks (again once per string), which apply them to all their documents.

Defined results: a null text has no words; a null id is larger than any id; rows with the same id
count as one document for "smaller id", and each such row is treated by itself; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm import cluster
from halyard.llm.text import Runs, Words, by_chunk, in_order, mix, range_hash, release, words_of

WINDOW = 13
MINIMISER = 3
NO_ID = np.iinfo(np.int64).max


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob: names are implied by order, sizes stand in front."""
    parts = [np.ascontiguousarray(a) for a in arrays.values()]
    head = np.array([a.nbytes for a in parts], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in parts))


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(types))
    at, out = 8 * len(types), []
    for size, kind in zip(sizes, types):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


class _Chunk:
    """The documents of a chunk in id order, and their packed strings without repetition."""

    def __init__(self, table: pa.Table, k: int, m: int, buckets: int):
        self.table = in_order(table.select(["id", "text"]))
        self.ids = pc.fill_null(self.table["id"], pa.scalar(NO_ID, pa.int64())).to_numpy()
        self.words = words = words_of(self.table["text"])
        self.k = k
        n = len(words.start)
        doc = words.doc_of_word()
        end = words.first[1:][doc] if n else np.zeros(0, np.int64)
        starts = np.flatnonzero(np.arange(n) + k <= end)
        h = words.hashes()
        low = range_hash(h, np.arange(max(0, n - m + 1)), np.arange(max(0, n - m + 1)) + m) if n >= m else np.zeros(0, np.uint64)
        low, width, span = low, 1, k - m + 1  # the least of `span` consecutive pieces, by doubling
        while 2 * width <= span and len(low) > width:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        if width < span and len(low) > span - width:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        least = low[starts] if len(starts) else np.zeros(0, np.uint64)
        new = np.ones(len(starts), bool)
        new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
        begin = np.flatnonzero(new)
        self.begin = starts[begin]  # the first word of each packed string
        self.windows = np.diff(np.append(begin, len(starts)))
        self.doc = doc[self.begin] if n else np.zeros(0, np.int64)
        self.bucket = (mix(least[begin]) % np.uint64(buckets)).astype(np.int64)
        last = self.begin + self.windows - 1 + k - 1
        raw = words.data.tobytes()
        strings = pa.array([raw[a:b] for a, b in zip(words.start[self.begin].tolist(), words.end[last].tolist())], pa.large_binary())
        coded = strings.dictionary_encode()
        self.strings = coded.dictionary
        self.of = coded.indices.to_numpy().astype(np.int64)
        count = len(self.strings)
        every = np.arange(len(self.of))
        self.first, self.last = np.zeros(count, np.int64), np.zeros(count, np.int64)
        self.last[self.of] = every
        self.first[self.of[::-1]] = every[::-1]
        # strings are numbered within their bucket, in order of first appearance
        self.by_bucket = np.argsort(self.bucket[self.first], kind="stable")
        self.runs = Runs(self.bucket[self.first][self.by_bucket])

    def blobs(self):
        text = self.strings
        for b, run in self.runs:
            mine = self.by_bucket[run]
            joined = b"\n".join(text.take(pa.array(mine)).to_pylist())
            yield b, _pack(low=self.ids[self.doc[self.first[mine]]], high=self.ids[self.doc[self.last[mine]]], text=np.frombuffer(joined, np.uint8))

    def removed(self, answers) -> np.ndarray:
        """Which words a window covers that also starts in a document with a smaller id."""
        cover = np.zeros(len(self.words.start) + 1, np.int64)
        by_string = np.argsort(self.of, kind="stable")
        edge = np.searchsorted(self.of[by_string], np.arange(len(self.strings) + 1))
        for b, blob in answers:
            index, offset, length, smallest = _unpack(blob, np.int32, np.int32, np.int32, np.int64)
            string = self.by_bucket[self.runs[b].start + index]
            times = edge[string + 1] - edge[string]
            row = np.repeat(np.arange(len(index)), times)
            at = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            occurrence = by_string[edge[string][row] + at]
            hit = smallest[row] < self.ids[self.doc[occurrence]]
            begin = self.begin[occurrence[hit]] + offset[row[hit]]
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + length[row[hit]] + self.k - 1, -1)
        return np.cumsum(cover)[:-1] > 0


def _send(k: int, m: int, buckets: int):
    def of_partition(batches):
        for c, docs in by_chunk(batches):
            out = list(_Chunk(docs, k, m, buckets).blobs())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([c] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "chunk", "blob"])
            release()

    return of_partition


ANSWER = "chunk int, bucket int, blob binary"


def _answer(k: int):
    def of_bucket(table: pa.Table) -> pa.Table:
        low, high, index, chunk, strings = [], [], [], [], []
        bucket = table["bucket"][0].as_py()
        for c, blob in zip(table["chunk"].to_pylist(), table["blob"].to_pylist()):
            a, b, text = _unpack(blob, np.int64, np.int64, np.uint8)
            low.append(a)
            high.append(b)
            index.append(np.arange(len(a), dtype=np.int32))
            chunk.append(np.full(len(a), c, np.int32))
            strings += text.tobytes().split(b"\n")
        low, high, index, chunk = map(np.concatenate, (low, high, index, chunk))
        coded = pa.array(strings, pa.large_binary()).dictionary_encode()  # equal strings of several chunks
        of = coded.indices.to_numpy()
        least = np.full(len(coded.dictionary), NO_ID)
        np.minimum.at(least, of, low)
        words = words_of(coded.dictionary)
        per = words.counts() - k + 1
        to = np.concatenate([[0], np.cumsum(per)])
        string = np.repeat(np.arange(len(per)), per)
        first = np.arange(to[-1]) - to[string] + words.first[string]
        h = range_hash(words.hashes(), first, first + k)
        begin, end = words.start[first], words.end[first + k - 1]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        raw = words.data.tobytes()
        for i in np.flatnonzero(same).tolist():  # a hash proposes, the bytes decide
            a, b = order[i], order[i + 1]
            if raw[begin[a] : end[a]] != raw[begin[b] : end[b]]:
                return _exactly(raw, begin, end, least, string, to, of, low, high, index, chunk, bucket)
        group = np.zeros(len(order), np.int64)
        group[order] = np.concatenate([[0], np.cumsum(~same)]) if len(order) else group
        return _reply(group, least, string, to, of, high, index, chunk, bucket)

    def _exactly(raw, begin, end, least, string, to, of, low, high, index, chunk, bucket):
        """Two windows share a hash but differ: number the windows by their text."""
        texts = pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.large_binary())
        return _reply(texts.dictionary_encode().indices.to_numpy().astype(np.int64), least, string, to, of, high, index, chunk, bucket)

    def _reply(group, least, string, to, of, high, index, chunk, bucket):
        smallest = np.full(int(group.max()) + 1, NO_ID)
        np.minimum.at(smallest, group, least[string])
        window = smallest[group]
        asks = np.minimum.reduceat(window, to[:-1])[of] < high
        e = np.flatnonzero(asks)
        size = (to[1:] - to[:-1])[of[e]]
        row = np.repeat(np.arange(len(e)), size)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        value = window[to[of[e]][row] + offset]
        hit = value < high[e][row]
        row, offset, value = row[hit], offset[hit], value[hit]
        start = np.ones(len(row), bool)  # runs of windows with one answer
        start[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1) | (value[1:] != value[:-1])
        s = np.flatnonzero(start)
        length = np.diff(np.append(s, len(row)))
        entry = e[row[s]]
        to_chunk = np.argsort(chunk[entry], kind="stable")
        out_chunk, out = [], []
        for part in np.split(to_chunk, np.flatnonzero(np.diff(chunk[entry][to_chunk])) + 1):
            if len(part):
                out_chunk.append(int(chunk[entry[part[0]]]))
                out.append(_pack(index=index[entry[part]], offset=offset[s[part]].astype(np.int32), length=length[part].astype(np.int32), value=value[s[part]]))
        release()
        return pa.table([pa.array(out_chunk, pa.int32()), pa.array([bucket] * len(out), pa.int32()), pa.array(out, pa.binary())], ["chunk", "bucket", "blob"])

    return of_bucket


RESULT = "id bigint, n_words bigint, n_removed bigint, kept string"


def _apply(k: int, m: int, buckets: int, digest: bool):
    def of_chunk(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], ["id", "n_words", "n_removed", "kept"])
        chunk = _Chunk(docs.select(["id", "text"]), k, m, buckets)
        gone = chunk.removed(zip(answers["bucket"].to_pylist(), answers["blob"].to_pylist()))
        words: Words = chunk.words
        first = words.first
        lost = np.concatenate([[0], np.cumsum(gone)])
        n_gone = lost[first[1:]] - lost[first[:-1]]
        raw = words.data.tobytes()
        kept = []
        for d, n in enumerate(n_gone.tolist()):
            a, b = int(first[d]), int(first[d + 1])
            if a == b:
                text = b""
            elif not n:
                text = raw[words.start[a] : words.end[b - 1]]
            else:
                text = b" ".join([raw[words.start[i] : words.end[i]] for i in (a + np.flatnonzero(~gone[a:b])).tolist()])
            kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
        release()
        return pa.table([chunk.table["id"].cast(pa.int64()), pa.array(words.counts(), pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return of_chunk


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = MINIMISER, digest: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, and in ``kept`` the words that stay, joined by
    one space (with ``digest`` the SHA-256 of that string instead)."""
    spark = docs.sparkSession
    n = cluster.partitions(spark)
    size = cluster.text_size(docs, text_col)
    chunks, buckets = cluster.pieces(size, n), cluster.pieces(2 * size, n)
    dealt = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    dealt = dealt.select("*", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(chunks)).cast("int").alias("chunk")).repartition(n, "chunk")
    sent = dealt.sortWithinPartitions("chunk").mapInArrow(_send(k, m, buckets), "bucket int, chunk int, blob binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer(k), ANSWER)
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_apply(k, m, buckets, digest), RESULT)
