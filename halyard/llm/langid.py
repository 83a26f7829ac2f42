"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each slot holds a mask with a bit per language (as
many 64-bit words as that takes), and the AND over an n-gram's slots gives every language that contains the n-gram.  A text's
n-grams are counted per language bit; a count is corrected for the rate f at which the filter
answers falsely for that language, (hits - n f) / (1 - f), and the largest corrected count decides.
The score is its share among the counts of all languages, the coverage its share of the n-grams.

The filter is fitted on a bounded sample: about ``SAMPLE_DOCS`` documents of each language, chosen
by a hash of the id and thinned to the rate bound / count.  It has a fixed number of slots, so its
size does not grow with the rows but with the languages; prediction reads every byte of every text.

N-grams are runs of ``N`` bytes of the UTF-8 text after A-Z are lower-cased and each run of other
ASCII than letters has become one space, so they see word starts and ends.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for all if
nothing could be learned; a text whose n-grams are all unknown gets the most frequent learned
language, score 0; ties go to the alphabetically first language; all languages that label a text are
learned; all input columns are kept but those that have the name of an added one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.llm import cluster
from halyard.llm.text import flat_bytes, mix, release

N = 4
SLOTS_LOG2 = 21
HASHES = 2
SAMPLE_DOCS = 1_000
#: An n-gram belongs to a language if that many of its sampled documents hold it; one does if the
#: language has fewer than FEW_DOCS.
MIN_DOCS = 3
FEW_DOCS = 10
#: Bytes of text worked on at a time.
BATCH_BYTES = 1 << 19

_MAP = np.full(256, 0x20, np.uint8)
_MAP[0x61:0x7B] = np.arange(0x61, 0x7B)
_MAP[0x41:0x5B] = np.arange(0x61, 0x7B)
_MAP[0x80:] = np.arange(0x80, 0x100)


def ngrams(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of a batch of texts, and the len + 1 edges of the texts among them."""
    data, offsets = flat_bytes(column)
    data = _MAP[data]
    n = len(data)
    keep = np.ones(n, bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[first] = True
    to = np.concatenate([[0], np.cumsum(keep)])[offsets]
    data = data[keep]
    x = data.astype(np.uint64)
    m = max(0, len(x) - N + 1)
    g = np.zeros(m, np.uint64)
    for i in range(N):
        g |= x[i : i + m] << np.uint64(8 * i)
    inside = np.ones(m, bool)  # no n-gram runs over the end of its text
    for e in range(1, N):
        at = to[1:] - e
        at = at[(at >= 0) & (at < m) & (at >= to[:-1])]
        inside[at] = False
    edges = np.concatenate([[0], np.cumsum(inside)])[np.minimum(to, m)]
    return mix(g[inside]), edges


def _slots(h: np.ndarray):
    for i in range(HASHES):
        yield (h >> np.uint64(i * SLOTS_LOG2)) & np.uint64((1 << SLOTS_LOG2) - 1)


class Filters:
    """The bit-sliced filters of all languages."""

    def __init__(self, languages: list[str], default: str):
        self.languages, self.default = languages, default
        self.kind = np.uint8 if len(languages) <= 8 else np.uint64
        self.masks = np.zeros((-(-len(languages) // 64), 1 << SLOTS_LOG2), self.kind)

    def add(self, h: np.ndarray, language: int) -> None:
        word, bit = divmod(language, 64)
        for slot in _slots(h):
            self.masks[word][slot] |= self.kind(1 << bit)

    def _bits(self, words: np.ndarray, language: int) -> np.ndarray:
        return (words >> self.kind(language % 64)) & self.kind(1)

    def false_rates(self) -> np.ndarray:
        return np.array([np.mean(self._bits(self.masks[i // 64], i)) ** HASHES for i in range(len(self.languages))])

    def counts(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams per text, corrected hits per text and language)."""
        h, edges = ngrams(column)
        n = np.diff(edges)
        out = np.zeros((len(n), len(self.languages)))
        for i, f in enumerate(self.false_rates()):
            if i % 64 == 0:
                hit = np.full(len(h), np.iinfo(self.kind).max, self.kind)
                for slot in _slots(h):
                    hit &= self.masks[i // 64][slot]
            total = np.concatenate([[0], np.cumsum(self._bits(hit, i), dtype=np.int64)])
            out[:, i] = np.maximum(0.0, (total[edges[1:]] - total[edges[:-1]] - n * f) / (1 - f))
        return n, out

    def decide(self, column) -> tuple[list[str], np.ndarray]:
        return self.judge(column)[:2]

    def judge(self, column) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, coverage) per text."""
        n, hits = self.counts(column)
        total = hits.sum(axis=1)
        best = hits.argmax(axis=1) if self.languages else np.zeros(len(n), int)
        score = np.divide(hits.max(axis=1, initial=0.0), total, out=np.zeros(len(n)), where=total > 0)
        said = [self.languages[b] if t > 0 else self.default for b, t in zip(best, total)] if self.languages else ["und"] * len(n)
        coverage = np.divide(hits.max(axis=1, initial=0.0), n, out=np.zeros(len(n)), where=n > 0)
        texts = column.to_pylist()
        for i, text in enumerate(texts):
            if text is None or not any(map(str.isalpha, text)):
                said[i], score[i], coverage[i] = "und", 0.0, 0.0
        return said, np.clip(score, 0.0, 1.0), np.clip(coverage, 0.0, 1.0)


def _gram_rows(batches):
    """Each batch's distinct (gram, language) and how many of its documents hold the gram."""
    for batch in batches:
        h, edges = ngrams(batch.column(0))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(edges))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, language = h[new], batch.column(1).to_numpy()[doc[new]]
        order = np.lexsort((h, language))
        h, language = h[order], language[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (language[1:] != language[:-1])
        at = np.flatnonzero(new)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(language[at].astype(np.int32)), pa.array(np.diff(np.append(at, len(h))))], ["gram", "language", "n"])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Filters:
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}  # one row per language
    languages = sorted(counts)
    filters = Filters(languages, max(languages, key=lambda x: (counts[x], x), default="und"))
    if not languages:
        return filters
    known: Column = F.array_position(F.array(*map(F.lit, languages)), F.col(lang_col)).cast("int")
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), known)
    rate = at([min(1.0, sample_docs / counts[x]) for x in languages])
    chosen = F.pmod(F.xxhash64(id_col, F.lit("language sample")), F.lit(1 << 30)) < rate * (1 << 30)
    sample = usable.where(chosen).select(F.col(text_col), (known - 1).alias("language"))
    grams = sample.mapInArrow(_gram_rows, "gram bigint, language int, n bigint")
    few = [i for i, x in enumerate(languages) if min(counts[x], sample_docs) < FEW_DOCS]
    least = F.when(F.array_contains(F.array(*map(F.lit, few)).cast("array<int>"), F.col("language")), 1).otherwise(MIN_DOCS)
    held = grams.groupBy("gram", "language").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    for batch in held.select("gram", "language").toArrow().to_batches():  # bounded by the sample
        gram, language = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        order = np.argsort(language, kind="stable")
        gram, language = gram[order], language[order]
        own, first = np.unique(language, return_index=True)
        for i, some in zip(own.tolist(), np.split(gram, first[1:])):
            filters.add(some, i)
    return filters


def _slices(batch: pa.RecordBatch, column: int):
    """The rows of a batch in pieces of about BATCH_BYTES of text."""
    offsets = flat_bytes(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def identify(docs: DataFrame, filters: Filters, text_col: str = "text", lang: str = "lang_pred", score: str = "score", coverage: str | None = None) -> DataFrame:
    """The documents with two more columns, with a name for ``coverage`` three."""
    more = [lang, score, *([coverage] if coverage else [])]
    docs = cluster.without(docs, *more)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2^SLOTS_LOG2 masks of a bit per language
    at = docs.columns.index(text_col)
    names = [*docs.columns, *more]

    def of_partition(batches):
        model = shared.value
        for batch in batches:
            for piece in _slices(batch, at):
                said, *shares = model.judge(piece.column(at))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(said, pa.string()), *[pa.array(x, pa.float64()) for x in shares[: len(more) - 1]]], names)
        release()

    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), *[T.StructField(x, T.DoubleType()) for x in more[1:]]])
    return docs.mapInArrow(of_partition, schema)
