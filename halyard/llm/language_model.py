"""A gated recurrent language model in numpy, trained and applied over the cluster.

Tokens are the lower-cased words of a text and one end.  The most frequent ``HEAD`` tokens are
predicted one by one, the rest through their class (a hash of the last two bytes), within which
they keep their smoothed frequency; so log p(token) = log p(class | state) + log p(token | class,
state), a softmax over classes and one over the tokens of a head class.  The state is a GRU's,
carried from window to window through a whole document and reset at its start, so a text's score
is the log-likelihood of all of it.

Steps, each a Spark job on tables in the shared folder:

1. Counts.  Documents are dealt into chunks; a chunk sends each of its distinct words once, with its
   training count, to the word's bucket.  Buckets sum and answer, so no vocabulary is ever gathered
   in one place: each bucket names its ``HEAD`` most frequent words, and of those only the head's, and
   the sums, reach the driver.
2. Codes.  Each chunk turns its documents into 16-bit codes (head word or tail class) and adds up
   what does not depend on the state: the base score and the tail words' part.
3. Training.  Every training document is used.  Each of ``ROUNDS`` rounds takes a share of the chunks;
   tasks train on theirs from the same weights by truncated backpropagation (windows of ``WINDOW``
   tokens, many documents side by side) and their weights are averaged by tokens seen, in a tree.
   Which chunks train together follows from how the rows are dealt into files, so scores vary a
   little with the number of partitions; on the same partitions they repeat.
4. Scoring of every document.  Training and scoring hold a bounded group of documents at a time.

Output weights start from the class and word frequencies, so training starts from a unigram model.

Defined results: a null text is empty and has only its end; a null id falls in the fold of the
empty text; without training documents the score is the base score; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm import cluster
from halyard.llm.substring_dedup import _pack, _unpack
from halyard.llm.text import Runs, Words, as_binary, by_chunk, flat_bytes, in_order, range_hash, release, words_of

HEAD = 1024
HEAD_CLASSES = 32
TAIL_CLASSES = 32
UNITS = 16
EMBEDDING = 16
WINDOW = 16
LANES = 384
ROUNDS = 2
RATE = 0.01
SMOOTHING = 0.1
CHUNK_BYTES = 8 << 20
#: Models averaged by one task; the driver gets no more than that many.
FAN_IN = 64
#: Bytes of codes that a task holds at a time when it trains or scores (two a token).
GROUP_BYTES = 16 << 20
END = b""
LN10 = np.log(10.0)


# ---------------------------------------------------------------- counting


class _Vocabulary:
    """The distinct tokens of a chunk by bucket, and its documents as indexes into them."""

    def __init__(self, docs: pa.Table, buckets: int):
        docs = self.docs = in_order(docs)
        self.words: Words = words_of(docs["text"], lower=True)
        w = self.words
        self.train = docs["train"].to_numpy(zero_copy_only=False).astype(bool)
        coded = as_binary(w.data, np.append(w.start, len(w.data))).dictionary_encode()
        data, offsets = flat_bytes(coded.dictionary)  # each word and the space behind it
        self.data, self.begin, self.end = data, offsets[:-1], offsets[1:] - 1
        self.of = coded.indices.to_numpy()
        n = len(self.begin)
        training_word = np.repeat(self.train, w.counts())
        self.times = np.bincount(self.of[training_word], minlength=n).astype(np.int64)
        self.bucket = (range_hash(data, self.begin, self.end) % np.uint64(buckets)).astype(np.int64) if n else np.zeros(0, np.int64)
        self.order = np.argsort(self.bucket, kind="stable")
        self.runs = Runs(self.bucket[self.order])

    def blobs(self):
        raw = self.data.tobytes()
        for b, run in self.runs:
            mine = self.order[run]
            text = b"".join([raw[x : y + 1] for x, y in zip(self.begin[mine].tolist(), self.end[mine].tolist())])
            yield b, _pack(times=self.times[mine].astype(np.uint32), text=np.frombuffer(text, np.uint8))

    def tail_class(self) -> np.ndarray:
        return tail_class(self.data, self.begin, self.end)


def tail_class(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros(0, np.int64)
    return (range_hash(data, np.maximum(end - 2, begin), end) % np.uint64(TAIL_CLASSES)).astype(np.int64)


def _send(buckets: int):
    def of_partition(batches):
        for c, docs in by_chunk(batches):
            out = list(_Vocabulary(docs, buckets).blobs())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([c] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "chunk", "blob"])
            release()

    return of_partition


COUNTED = "kind string, chunk int, bucket int, blob binary"


def _merge_sums(top: int):
    def of_partition(batches):
        """The sums of all rows together, and the most frequent words of all."""
        total, counts, words = None, [], []
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                sums, n, text = _unpack(blob, np.float64, np.int64, np.uint8)
                total = sums if total is None else total + sums
                counts += n.tolist()
                words += text.tobytes().split(b" ")[:-1]
                if len(counts) > 8 * top:
                    counts, words = (list(x) for x in zip(*sorted(zip(counts, words), key=lambda x: (-x[0], x[1]))[:top]))
        if total is not None:
            best = sorted(zip(counts, words), key=lambda x: (-x[0], x[1]))[:top]
            merged = _pack(sums=total, n=np.array([n for n, _ in best], np.int64), words=np.frombuffer(b"".join(w + b" " for _, w in best), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([merged], pa.binary())], ["blob"])

    return of_partition


def _count(top: int):
    def of_bucket(table: pa.Table) -> pa.Table:
        """Answers ("count"), and in one row this bucket's sums and most frequent words ("sums")."""
        bucket = table["bucket"][0].as_py()
        parts = [_unpack(b, np.uint32, np.uint8) for b in table["blob"].to_pylist()]
        times = np.concatenate([p[0] for p in parts]).astype(np.int64)
        data = np.concatenate([p[1] for p in parts])
        stop = np.flatnonzero(data == 0x20) + 1
        coded = as_binary(data, np.concatenate([[0], stop])).dictionary_encode()
        of = coded.indices.to_numpy()
        total = np.bincount(of, weights=times, minlength=len(coded.dictionary)).astype(np.int64)
        answer = total[of]
        edge = np.cumsum([0, *(len(p[0]) for p in parts)])
        blobs = [_pack(n=answer[a:b].astype(np.uint64)) for a, b in zip(edge[:-1], edge[1:])]
        text, offsets = flat_bytes(coded.dictionary)
        begin, end = offsets[:-1], offsets[1:] - 1
        known = total > 0
        mass = np.bincount(tail_class(text, begin, end)[known], weights=total[known] + SMOOTHING, minlength=TAIL_CLASSES)
        most = np.argsort(-total, kind="stable")[:top]
        most = most[total[most] > 0]
        raw = text.tobytes()
        words = b"".join([raw[begin[i] : end[i] + 1] for i in most.tolist()])
        sums = _pack(sums=np.append(mass, [total.sum(), known.sum()]).astype(np.float64), n=total[most], words=np.frombuffer(words, np.uint8))
        m = len(blobs)
        return pa.table(
            [pa.array(["count"] * m + ["sums"]), pa.array([*table["chunk"].to_pylist(), None], pa.int32()), pa.array([bucket] * (m + 1), pa.int32()), pa.array([*blobs, sums], pa.binary())],
            ["kind", "chunk", "bucket", "blob"],
        )

    return of_bucket


@dataclass
class Vocabulary:
    """What the model knows of tokens: bounded in size, whatever the corpus."""

    words: list[bytes]  # the head, most frequent first; END is among them
    counts: np.ndarray
    tokens: int  # N
    distinct: int  # V
    tail_mass: np.ndarray

    def __post_init__(self):
        # classes of the head hold about equal sums of square roots of counts
        share = np.sqrt(self.counts.astype(float))
        cut = np.cumsum(share) / max(share.sum(), 1e-300)
        number = np.minimum((cut * HEAD_CLASSES).astype(int), HEAD_CLASSES - 1) if len(share) else np.zeros(0, int)
        _, number = np.unique(number, return_inverse=True)
        self.word_class = number
        self.head_classes = int(number.max()) + 1 if len(number) else 0
        self.first = np.searchsorted(number, np.arange(self.head_classes + 1))
        self.code = {w: i for i, w in enumerate(self.words)}

    def class_mass(self) -> np.ndarray:
        head = np.bincount(self.word_class, weights=self.counts + SMOOTHING, minlength=self.head_classes) if len(self.words) else np.zeros(0)
        return np.concatenate([head, self.tail_mass])


CODED = "id bigint, chunk int, train boolean, n_tokens bigint, n_known bigint, base_score double, fixed double, codes binary"


def _code(vocabulary, buckets: int):
    def of_chunk(docs: pa.Table, answers: pa.Table) -> pa.Table:
        v: Vocabulary = vocabulary.value
        own = _Vocabulary(docs, buckets)
        docs = own.docs
        count = np.zeros(len(own.begin), np.float64)
        for b, blob in zip(answers["bucket"].to_pylist(), answers["blob"].to_pylist()):
            count[own.order[own.runs[b]]] = _unpack(blob, np.uint64)[0]
        raw = own.data.tobytes()
        head = len(v.words)
        in_class = own.tail_class()
        code = head + in_class
        frequent = np.flatnonzero(count >= (v.counts.min() if head else np.inf))
        for i in frequent.tolist():
            code[i] = v.code.get(raw[own.begin[i] : own.end[i]], code[i])
        base = np.log10((count + SMOOTHING) / (v.tokens + SMOOTHING * (v.distinct + 1)))
        fixed = np.where(code >= head, np.log10((count + SMOOTHING) / v.tail_mass[in_class]), 0.0)
        first = own.words.first
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[own.of])])[first])
        end_code = v.code.get(END, 0)
        end_count = float(v.counts[end_code]) if END in v.code else 0.0
        end_base = np.log10((end_count + SMOOTHING) / (v.tokens + SMOOTHING * (v.distinct + 1)))
        codes = np.insert(code[own.of].astype(np.uint16), first[1:], np.uint16(end_code))
        at = first + np.arange(len(first))
        blob = [codes[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        n = own.words.counts()
        release()
        return pa.table(
            [docs["id"].cast(pa.int64()), docs["chunk"].cast(pa.int32()), docs["train"].cast(pa.bool_()), pa.array(n + 1, pa.int64()), pa.array(sums((count > 0).astype(np.int64)).astype(np.int64) + int(end_count > 0), pa.int64()), pa.array(sums(base) + end_base, pa.float64()), pa.array(sums(fixed), pa.float64()), pa.array(blob, pa.binary())],
            ["id", "chunk", "train", "n_tokens", "n_known", "base_score", "fixed", "codes"],
        )

    return of_chunk


# ---------------------------------------------------------------- the model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Model:
    """Weights, forward pass, backward pass.  All arrays are float32."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 1):
        v = vocabulary
        self.head, self.first, self.head_classes, self.word_class = len(v.words), v.first, v.head_classes, v.word_class
        self.classes = v.head_classes + TAIL_CLASSES
        draw = np.random.default_rng(seed)
        small = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        mass = np.maximum(v.class_mass(), 1e-9)
        self.w = {
            "e": (0.3 * draw.standard_normal((self.head + TAIL_CLASSES, EMBEDDING))).astype(np.float32),
            "wx": small(EMBEDDING, 3 * UNITS),
            "b": np.concatenate([np.ones(UNITS), np.zeros(2 * UNITS)]).astype(np.float32),
            "uzr": small(UNITS, 2 * UNITS),
            "un": small(UNITS, UNITS),
            "wc": np.zeros((UNITS, self.classes), np.float32),
            "bc": np.log(mass / mass.sum()).astype(np.float32),
            "wo": np.zeros((UNITS, self.head), np.float32),
            "bo": np.log(v.counts + SMOOTHING).astype(np.float32),
        }

    def class_of(self, code: np.ndarray) -> np.ndarray:
        lookup = np.concatenate([self.word_class, self.head_classes + np.arange(TAIL_CLASSES)])
        return lookup[code]

    def states(self, code: np.ndarray, keep: np.ndarray, h: np.ndarray):
        """Run over code[t, lane]; keep[t, lane] is 0 where a document starts.  Returns all that the
        backward pass needs; state t + 1 has seen the input of step t."""
        steps, lanes = code.shape
        a = (self.w["e"] @ self.w["wx"] + self.w["b"])[code]
        hs = np.empty((steps + 1, lanes, UNITS), np.float32)
        zr = np.empty((steps, lanes, 2 * UNITS), np.float32)
        n = np.empty((steps, lanes, UNITS), np.float32)
        start = np.empty((steps, lanes, UNITS), np.float32)
        hs[0] = h
        for t in range(steps):
            p = np.multiply(hs[t], keep[t][:, None], out=start[t])
            g = p @ self.w["uzr"]
            g += a[t, :, : 2 * UNITS]
            zr[t] = _sigmoid(g)
            z, r = zr[t, :, :UNITS], zr[t, :, UNITS:]
            m = (r * p) @ self.w["un"]
            m += a[t, :, 2 * UNITS :]
            m *= 2
            m = _sigmoid(m)
            m *= 2
            m -= 1
            n[t] = m
            np.subtract(p, m, out=hs[t + 1])
            hs[t + 1] *= z
            hs[t + 1] += m
        return hs, start, zr, n

    def output(self, h: np.ndarray, code: np.ndarray, backward: bool):
        """log p of each code given its state h, without the tail's fixed part; with ``backward`` also
        the gradients of the sum of -log p."""
        which = self.class_of(code)
        logits = h @ self.w["wc"]
        logits += self.w["bc"]
        logits -= logits.max(axis=1, keepdims=True)
        rows = np.arange(len(code))
        chosen = logits[rows, which]
        np.exp(logits, out=logits)
        total = logits.sum(axis=1)
        logp = chosen - np.log(total)
        grad = {}
        if backward:
            logits /= total[:, None]
            logits[rows, which] -= 1
            grad["wc"], grad["bc"] = h.T @ logits, logits.sum(axis=0)
            dh = logits @ self.w["wc"].T
            grad["wo"], grad["bo"] = np.zeros_like(self.w["wo"]), np.zeros_like(self.w["bo"])
        head = np.flatnonzero(code < self.head)
        order = head[np.argsort(which[head].astype(np.uint8), kind="stable")]
        edges = np.searchsorted(which[order], np.arange(self.head_classes + 1))
        for c in range(self.head_classes):
            mine = order[edges[c] : edges[c + 1]]
            a, b = int(self.first[c]), int(self.first[c + 1])
            if not len(mine) or b - a < 2:
                continue
            own = h[mine]
            x = own @ self.w["wo"][:, a:b]
            x += self.w["bo"][a:b]
            x -= x.max(axis=1, keepdims=True)
            k, at = np.arange(len(mine)), code[mine] - a
            said = x[k, at]
            np.exp(x, out=x)
            total = x.sum(axis=1)
            logp[mine] += said - np.log(total)
            if backward:
                x /= total[:, None]
                x[k, at] -= 1
                grad["wo"][:, a:b] = own.T @ x
                grad["bo"][a:b] = x.sum(axis=0)
                dh[mine] += x @ self.w["wo"][:, a:b].T
        return (logp, grad, dh) if backward else logp

    def backward(self, code, keep, hs, start, zr, n, dout):
        """Gradients of a window from dout[t], the gradient at state t + 1."""
        steps = len(code)
        da = np.empty((*code.shape, 3 * UNITS), np.float32)
        dh = np.zeros_like(hs[0])
        duzr, dun = np.zeros_like(self.w["uzr"]), np.zeros_like(self.w["un"])
        for t in range(steps - 1, -1, -1):
            dh = dh + dout[t]
            p, z, r, m = start[t], zr[t, :, :UNITS], zr[t, :, UNITS:], n[t]
            dz = dh * (p - m) * z * (1 - z)
            dm = dh * (1 - z) * (1 - m * m)
            drp = dm @ self.w["un"].T
            dr = drp * p * r * (1 - r)
            da[t, :, :UNITS], da[t, :, UNITS : 2 * UNITS], da[t, :, 2 * UNITS :] = dz, dr, dm
            duzr += p.T @ da[t, :, : 2 * UNITS]
            dun += (r * p).T @ dm
            dh = (dh * z + drp * r + da[t, :, : 2 * UNITS] @ self.w["uzr"].T) * keep[t][:, None]
        flat, symbols = da.reshape(-1, 3 * UNITS), code.reshape(-1)
        order = np.argsort(symbols, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(symbols[order]) != 0]))
        dtable = np.add.reduceat(flat[order], begin, axis=0)
        used = symbols[order][begin]
        de = np.zeros_like(self.w["e"])
        de[used] = dtable @ self.w["wx"].T
        return {"e": de, "wx": self.w["e"][used].T @ dtable, "b": flat.sum(axis=0), "uzr": duzr, "un": dun}

    def blob(self) -> bytes:
        return b"".join(x.tobytes() for x in self.w.values())

    def load(self, blob: bytes) -> "Model":
        at = 0
        for k, x in self.w.items():
            self.w[k] = np.frombuffer(blob, np.float32, x.size, at).reshape(x.shape).copy()
            at += x.nbytes
        return self


class _Lanes:
    """Documents side by side: each lane is a run of documents, lanes are about equally long and the
    longest come first, so the lanes still busy at a step are the first ones.  The codes stay one flat
    array; a window's matrix is cut from it when its turn comes, so one very long document costs
    its own length and not that of all lanes."""

    def __init__(self, docs: list[np.ndarray], lanes: int, end: int):
        lanes = max(1, min(lanes, len(docs)))
        heap = [(0, i) for i in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            size, i = heapq.heappop(heap)
            held[i].append(d)
            heapq.heappush(heap, (size + len(docs[d]), i))
        length = {i: s for s, i in heap}
        rows = sorted(range(lanes), key=lambda i: -length[i])
        self.end = end
        self.length = np.array([length[i] for i in rows], np.int64)
        self.lane = np.cumsum(self.length) - self.length  # where each lane begins in the flat array
        self.order = np.array([d for i in rows for d in held[i]], np.int64)
        self.flat = np.concatenate([docs[d] for d in self.order.tolist()]) if docs else np.zeros(0, np.uint16)
        size = np.array([len(docs[d]) for d in self.order.tolist()], np.int64)
        self.begins = np.zeros(len(self.flat), bool)
        self.begins[np.cumsum(size) - size] = True
        self.document = np.repeat(self.order.astype(np.int32), size)  # of each place

    def windows(self, size: int):
        """(busy lanes, input codes, target codes, keep, real, place) of the windows in turn; keep is 0
        where a document begins, place is where a token stands in the flat array."""
        for t in range(0, int(self.length.max(initial=0)), size):
            busy = int(np.searchsorted(-self.length, -t, "left"))
            step = np.arange(t, min(t + size, int(self.length[0])))[:, None]
            real = step < self.length[None, :busy]
            place = np.where(real, self.lane[None, :busy] + step, self.lane[None, :busy])
            new = self.begins[place]
            code = np.where(new, self.end, self.flat[place - ~new])  # a document's first input is an end
            yield busy, code, self.flat[place], (~new).astype(np.float32), real, place


def train(model: Model, groups, end: int, lanes: int = LANES, rate: float = RATE) -> int:
    """One pass of truncated backpropagation with Adam steps over groups of documents, one group held
    at a time; returns the tokens seen."""
    seen, step = 0, 0
    first = {k: np.zeros_like(x) for k, x in model.w.items()}
    second = {k: np.zeros_like(x) for k, x in model.w.items()}
    for docs in groups:
        packed = _Lanes(docs, lanes, end)
        h = np.zeros((len(packed.length), UNITS), np.float32)
        for busy, code, target, keep, real, _ in packed.windows(WINDOW):
            hs, start, zr, n = model.states(code, keep, h[:busy])
            h[:busy] = hs[-1]
            flat = hs[1:][real]
            _, grad, dh = model.output(flat, target[real].astype(np.int64), True)
            dout = np.zeros((*code.shape, UNITS), np.float32)
            dout[real] = dh
            grad |= model.backward(code, keep, hs, start, zr, n, dout)
            seen, step = seen + len(flat), step + 1
            scale = 1.0 / max(len(flat), 64)
            pace = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * min(1.0, len(flat) / 512)
            for k, g in grad.items():
                g *= np.float32(scale)
                first[k] += np.float32(0.1) * (g - first[k])
                second[k] += np.float32(0.01) * (g * g - second[k])
                model.w[k] -= np.float32(pace) * first[k] / (np.sqrt(second[k]) + np.float32(1e-6))
    return seen


def log10_likelihood(model: Model, docs: list[np.ndarray], end: int, lanes: int = LANES) -> np.ndarray:
    """log10 p of each document's codes, the state carried through all of it."""
    packed = _Lanes(docs, lanes, end)
    total = np.zeros(len(docs))
    h = np.zeros((len(packed.length), UNITS), np.float32)
    for busy, code, target, keep, real, place in packed.windows(WINDOW):
        hs, *_ = model.states(code, keep, h[:busy])
        h[:busy] = hs[-1]
        np.add.at(total, packed.document[place[real]], model.output(hs[1:][real], target[real].astype(np.int64), False))
    return total / LN10


# ---------------------------------------------------------------- over the cluster


def _groups(batches):
    """Rows in tables of about ``GROUP_BYTES`` of codes, or one row that has more."""
    held, size = [], 0
    for batch in batches:
        codes = batch.column(batch.schema.get_field_index("codes"))
        ends = np.cumsum(pc.binary_length(codes).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, before + GROUP_BYTES - size, "right"))
            if to <= at and held:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            to = max(at + 1, to)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - before
            at = to
    if held:
        yield pa.Table.from_batches(held)


def _codes(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint16) for b in table["codes"].to_pylist()]


def _train_partition(vocabulary, weights):
    def of_partition(batches):
        v = vocabulary.value
        model = Model(v).load(weights.value)
        seen = train(model, map(_codes, _groups(batches)), v.code.get(END, 0))
        release()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([model.blob()], pa.binary()), pa.array([float(seen)])], ["blob", "seen"])

    return of_partition


def _average(batches):
    total, seen = None, 0.0
    for batch in batches:
        for blob, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(blob, np.float32).astype(np.float64) * n
            total, seen = (x if total is None else total + x), seen + n
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary()), pa.array([seen])], ["blob", "seen"])


def _score_partition(vocabulary, weights):
    def of_partition(batches):
        v = vocabulary.value
        model = Model(v).load(weights.value) if v.words else None
        for table in _groups(batches):
            score = log10_likelihood(model, _codes(table), v.code.get(END, 0)) if v.words else np.zeros(table.num_rows)
            fixed = table["fixed"].to_numpy() if v.words else table["base_score"].to_numpy()
            yield from table.select(["id", "train", "n_tokens", "n_known", "base_score"]).append_column("score", pa.array(score + fixed)).to_batches()
            release()

    return of_partition


def score_texts(docs: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: id, train, n_tokens, n_known, train_tokens, base_score, score.  Learns
    from the rows where ``train_rows`` holds."""
    spark = docs.sparkSession
    n = cluster.partitions(spark)
    size = cluster.text_size(docs, text_col)
    chunks = buckets = cluster.pieces(size, n, CHUNK_BYTES)
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.coalesce(train_rows, F.lit(False)).alias("train"))
    dealt = own.select("*", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(chunks)).cast("int").alias("chunk")).repartition(n, "chunk")

    sent = dealt.sortWithinPartitions("chunk").mapInArrow(_send(buckets), "bucket int, chunk int, blob binary")
    counted = cluster.saved(sent.groupBy("bucket").applyInArrow(_count(HEAD), COUNTED))
    ends = own.where("train").count()
    mass, tokens, distinct, head = np.zeros(TAIL_CLASSES), ends, int(ends > 0), []
    parts = cluster.saved(counted.where("kind = 'sums'").select("blob").mapInArrow(_merge_sums(HEAD - 1), "blob binary"))
    while (held := parts.count()) > FAN_IN:
        parts = cluster.saved(parts.repartition(-(-held // FAN_IN)).mapInArrow(_merge_sums(HEAD - 1), "blob binary"))
    for row in parts.repartition(1).mapInArrow(_merge_sums(HEAD - 1), "blob binary").collect():  # one row of HEAD words
        sums, n, text = _unpack(bytes(row.blob), np.float64, np.int64, np.uint8)
        mass, tokens, distinct = sums[:-2].copy(), tokens + int(sums[-2]), distinct + int(sums[-1])
        head = list(zip(text.tobytes().split(b" ")[:-1], n.tolist()))
    head = sorted([*head, *([(END, ends)] if ends else [])], key=lambda x: (-x[1], x[0]))
    text = b"".join(w for w, _ in head)
    edge = np.cumsum([0, *(len(w) for w, _ in head)])
    counts = np.array([c for _, c in head], np.int64)
    inside = tail_class(np.frombuffer(text + b" ", np.uint8), edge[:-1], edge[1:])
    for (w, c), t in zip(head, inside.tolist()):
        if w != END:
            mass[t] -= c + SMOOTHING
    vocabulary = Vocabulary([w for w, _ in head], counts, tokens, distinct, np.maximum(mass, 0) + SMOOTHING)
    shared = spark.sparkContext.broadcast(vocabulary)  # HEAD words

    answers = counted.where("kind = 'count'").select("chunk", "bucket", "blob")
    coded = cluster.saved(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_code(shared, buckets), CODED))
    weights = spark.sparkContext.broadcast(Model(vocabulary).blob())
    for i in range(rounds if tokens else 0):
        mine = coded.where(F.col("train") & (F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == i)).select("codes")
        models = cluster.saved(mine.mapInArrow(_train_partition(shared, weights), "blob binary, seen double"))
        while (held := models.count()) > FAN_IN:
            models = cluster.saved(models.repartition(-(-held // FAN_IN)).mapInArrow(_average, "blob binary, seen double"))
        got = models.repartition(1).mapInArrow(_average, "blob binary, seen double").collect()
        if got:
            weights = spark.sparkContext.broadcast(bytes(got[0].blob))
    out = coded.select("id", "train", "n_tokens", "n_known", "base_score", "fixed", "codes").mapInArrow(_score_partition(shared, weights), "id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(tokens).cast("bigint"))

