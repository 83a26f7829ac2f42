"""Approximate search on layered proximity graphs, with exact effort accounting.

The base is dealt into shards of a bounded number of rows by a hash of the id; each shard has its
own graph, built and searched by one task, and the shards' answers are merged by (distance, id).
An index is a table (shard, level, src, pos, dst) beside the vectors, so it is saved, read and
inspected like any other.

Two kinds: ``hnsw`` (insertion with beam search, links chosen to lead to different places) for unfiltered
search, and ``acorn`` (m * gamma nearest links, compressed at level 0 beyond m_beta) for search under
a predicate, where only passing rows get distances and lists are expanded by two hops.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.functions.random import unit_hash
from halyard.functions.vectors import matrix
from halyard.operators.nearest import query_blocks

SHARD_ROWS = 50_000
INDEX = "shard int, level int, src bigint, pos int, dst bigint"


class Counted:
    """Squared distances to rows of a matrix.  ``count`` is what a search says it spent; ``read`` counts
    the rows that really leave the matrix, also those of ``alone``, which a search does not count."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.count, self.read = vectors, 0, 0

    def to(self, q: np.ndarray, rows) -> list[float]:
        self.count += len(rows)
        return self._far(q, rows).tolist()

    def alone(self, q: np.ndarray, row: int) -> float:
        return float(self._far(q, [row])[0])

    def _far(self, q: np.ndarray, rows) -> np.ndarray:
        taken = self.vectors[rows]
        self.read += taken.shape[0]
        d = taken - q
        return np.einsum("ij,ij->i", d, d)


def diverse(vectors: np.ndarray, near: list[tuple[float, int]], limit: int) -> list[int]:
    """Links for a row from its candidates by ascending distance: one that is nearer to a link already
    chosen than to the row leads where that link leads, and is left out."""
    rows = np.array([j for _, j in near], np.int64)
    x = vectors[rows]
    norm = np.einsum("ij,ij->i", x, x)
    between = norm[:, None] - 2 * x @ x.T + norm[None, :]
    chosen: list[int] = []
    for i, (d, _) in enumerate(near):
        if len(chosen) == limit:
            break
        if not chosen or between[i, chosen].min() >= d:
            chosen.append(i)
    return rows[chosen].tolist()


def levels_of(ids: np.ndarray, m: int, seed: int) -> np.ndarray:
    """Exponentially falling levels from a hash of the id, so a graph does not depend on row order."""
    u = np.maximum(unit_hash(ids, seed), 1e-18)
    return np.floor(-np.log(u) / math.log(m)).astype(int)


def beam(space: Counted, q: np.ndarray, links, entries: list[tuple[float, int]], ef: int) -> list[tuple[float, int]]:
    """Best-first search of one layer; the ef nearest found, ascending."""
    seen = {i for _, i in entries}
    todo = list(entries)
    heapq.heapify(todo)
    found = [(-d, -i) for d, i in entries]
    heapq.heapify(found)
    while todo:
        d, i = heapq.heappop(todo)
        if len(found) >= ef and d > -found[0][0]:
            break
        fresh = [j for j in links(i) if j not in seen]
        seen.update(fresh)
        for e, j in zip(space.to(q, fresh), fresh) if fresh else ():
            if len(found) < ef or e < -found[0][0]:
                heapq.heappush(todo, (e, j))
                heapq.heappush(found, (-e, -j))
                if len(found) > ef:
                    heapq.heappop(found)
    return sorted((-d, -i) for d, i in found)


class Hnsw:
    """Layers[level][row] is the list of linked rows."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, m: int):
        self.space, self.levels, self.m = Counted(vectors), levels, m
        self.layers: list[dict[int, list[int]]] = [{} for _ in range(int(levels.max(initial=0)) + 1)]
        self.entry = -1

    def build(self, ef: int) -> "Hnsw":
        for i in range(len(self.levels)):
            self._insert(i, ef)
        return self

    def _insert(self, i: int, ef: int) -> None:
        top = int(self.levels[i])
        q = self.space.vectors[i]
        for level in range(top + 1):
            self.layers[level][i] = []
        if self.entry < 0:
            self.entry = i
            return
        at = self._descend(q, top)
        for level in range(min(top, int(self.levels[self.entry])), -1, -1):
            at = beam(self.space, q, lambda x, level=level: self.layers[level][x], at, ef)
            limit = 2 * self.m if level == 0 else self.m
            for j in diverse(self.space.vectors, at, self.m):
                self.layers[level][i].append(j)
                theirs = self.layers[level][j]
                theirs.append(i)
                if len(theirs) > limit:
                    d = self.space.to(self.space.vectors[j], theirs)
                    self.layers[level][j] = diverse(self.space.vectors, sorted(zip(d, theirs)), limit)
        if top > self.levels[self.entry]:
            self.entry = i

    def _descend(self, q: np.ndarray, above: int) -> list[tuple[float, int]]:
        at = [(self.space.to(q, [self.entry])[0], self.entry)]
        for level in range(int(self.levels[self.entry]), above, -1):
            at = beam(self.space, q, lambda x, level=level: self.layers[level].get(x, []), at, 1)
        return at

    def search(self, q: np.ndarray, k: int, ef: int) -> tuple[list[tuple[float, int]], dict]:
        before, read = self.space.count, self.space.read
        at = self._descend(q, 0)
        found = beam(self.space, q, lambda x: self.layers[0].get(x, []), at, max(ef, k))[:k]
        native = self.space.count - before
        return found, {"dist_native": native, "dist_exact": native, "dist_audit": self.space.read - read, "n_scanned": 0, "seed": at[0][1]}


class Acorn:
    def __init__(self, vectors: np.ndarray, levels: np.ndarray, m: int, gamma: int, m_beta: int):
        self.space, self.levels, self.m, self.gamma, self.m_beta = Counted(vectors), levels, m, gamma, m_beta
        self.layers: list[dict[int, list[int]]] = []
        self.entry = int(np.lexsort((np.arange(len(levels)), -levels))[0]) if len(levels) else -1

    def build(self) -> "Acorn":
        x = self.space.vectors
        for level in range(int(self.levels.max(initial=0)) + 1):
            rows = np.flatnonzero(self.levels >= level)
            width = min(self.m * self.gamma, len(rows) - 1)
            norm = np.einsum("ij,ij->i", x[rows], x[rows])
            near: dict[int, list[int]] = {}
            for a in range(0, len(rows), 256):
                d = norm[a : a + 256, None] - 2 * x[rows[a : a + 256]] @ x[rows].T + norm[None, :]
                d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
                best = np.argsort(d, axis=1, kind="stable")[:, :width]
                for i, row in enumerate(best):
                    near[int(rows[a + i])] = rows[row].tolist()
            self.layers.append(self._compressed(near) if level == 0 else near)
        return self

    def _compressed(self, near: dict[int, list[int]]) -> dict[int, list[int]]:
        """Beyond the first m_beta links one is dropped if a kept one beyond them leads to it."""
        out = {}
        for i, links in near.items():
            kept, covered = links[: self.m_beta], set()
            for j in links[self.m_beta :]:
                if len(kept) + len(covered) >= self.m * self.gamma:
                    break
                if j not in covered:
                    kept.append(j)
                    covered.update(near[j])
            out[i] = kept
        return out

    def _marked(self, row: int) -> np.ndarray:
        marks = np.zeros(len(self.levels), bool)
        marks[row] = True
        return marks

    def _list(self, level: int, u: int) -> np.ndarray:
        links = self.layers[level].get(u)
        return np.zeros(0, np.int64) if links is None else np.asarray(links, np.int64)

    def _neighbours(self, level: int, u: int, passes: np.ndarray, seen: np.ndarray) -> tuple[list[int], int]:
        """Passing unseen rows around u in scan order, which become seen, and the list entries read.

        The list of u falls into blocks: an entry and, if it was unseen and its place is an open one,
        its own list.  ``left`` passing entries may still be counted; the one that uses them up ends
        the scan if it is a new entry of u's list, and closes all further lists (unless all are to be
        opened) if it is inside another's."""
        direct = self._list(level, u)
        left, closed, read, out = 2 * self.m, False, len(direct), []
        for pos, v in enumerate(direct.tolist()):
            left -= int(passes[v])
            if seen[v]:
                continue
            if passes[v]:
                seen[v] = True
                out.append(v)
                if left <= 0:
                    return out, read - (len(direct) - pos - 1)
            if closed or self.gamma != 1 and pos < self.m_beta:
                continue
            block = self._list(level, v)
            counted = np.cumsum(passes[block])
            stop = int(np.searchsorted(counted, max(left, 1)))
            if stop < len(block):
                block, closed = block[: stop + 1], self.gamma != 1
            read, left = read + len(block), left - int(passes[block].sum())
            fresh = block[passes[block] & ~seen[block]]
            fresh = fresh[np.sort(np.unique(fresh, return_index=True)[1])]
            seen[fresh] = True
            out += fresh.tolist()
        return out, read

    def search(self, q: np.ndarray, k: int, ef: int, passes: np.ndarray) -> tuple[list[tuple[float, int]], dict]:
        """Greedy descent to the level-0 seed (which may fail the filter), then best-first among passing
        rows.  The entry's own distance is not in the native count: exact = native + 1."""
        before, already, scanned = self.space.count, self.space.read, 0
        at, d = self.entry, self.space.alone(q, self.entry)
        for level in range(len(self.layers) - 1, 0, -1):
            while True:
                near, read = self._neighbours(level, at, passes, self._marked(at))
                scanned += read
                best = min(zip(self.space.to(q, near), near), default=(math.inf, -1)) if near else (math.inf, -1)
                if best[0] >= d:
                    break
                d, at = best
        seed, size = at, max(ef, k)
        visited, todo = self._marked(seed), [(d, seed)]
        found = [(-d, -seed)] if passes[seed] else []
        while todo:
            e, u = heapq.heappop(todo)
            if len(found) >= size and e > -found[0][0]:
                break
            near, read = self._neighbours(0, u, passes, visited)
            scanned += read
            for x, v in zip(self.space.to(q, near), near) if near else ():
                if len(found) < size or x < -found[0][0]:
                    heapq.heappush(todo, (x, v))
                    heapq.heappush(found, (-x, -v))
                    if len(found) > size:
                        heapq.heappop(found)
        native = self.space.count - before
        return sorted((-x, -v) for x, v in found)[:k], {"dist_native": native, "dist_exact": native + 1, "dist_audit": self.space.read - already, "n_scanned": scanned, "seed": seed}


def _shards(base: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    shards = max(1, -(-base.count() // shard_rows))
    return base.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")), shards


def _ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    ids = table["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    table = table.take(pa.array(order))
    return ids[order], matrix(table["embedding"]), table


def build_index(base: DataFrame, kind: str = "hnsw", m: int = 16, ef: int = 40, gamma: int = 1, m_beta: int = 32, seed: int = 42, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The links of every shard's graph: shard, level, src, pos, dst."""

    def build(table: pa.Table) -> pa.Table:
        ids, vectors, _ = _ordered(table)
        levels = levels_of(ids, m, seed)
        graph = Hnsw(vectors, levels, m).build(ef) if kind == "hnsw" else Acorn(vectors, levels, m, gamma, m_beta).build()
        rows = [(level, ids[i], pos, ids[j]) for level, layer in enumerate(graph.layers) for i, links in sorted(layer.items()) for pos, j in enumerate(links)]
        level, src, pos, dst = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0, int),) * 4
        return pa.table([pa.array([table["shard"][0].as_py()] * len(rows), pa.int32()), pa.array(level, pa.int32()), pa.array(src, pa.int64()), pa.array(pos, pa.int32()), pa.array(dst, pa.int64())], ["shard", "level", "src", "pos", "dst"])

    dealt, _ = _shards(base.select("vec_id", "embedding"), shard_rows)
    return dealt.groupBy("shard").applyInArrow(build, INDEX)


SPENT = ("dist_native", "dist_exact", "dist_audit", "n_scanned")
FOUND = "query_id bigint, neighbor_id bigint, distance double, " + ", ".join(f"{c} bigint" for c in SPENT) + ", seed0 bigint, shard bigint"


def search_index(base: DataFrame, index: DataFrame, queries: DataFrame, k: int, ef: int, kind: str = "hnsw", predicate=None, m: int = 16, gamma: int = 1, m_beta: int = 32, seed: int = 42, shard_rows: int = SHARD_ROWS, traced: bool = False) -> DataFrame:
    """query_id, rank, neighbor_id, distance and the query's effort summed over shards (dist_native,
    dist_exact, dist_audit, n_scanned; seed0, the smallest seed of any shard).  ``traced``: also the
    neighbour's shard, the seed of the search in that shard, and searches, the number of shards that
    were searched for the query: each search has a seed and an effort of its own."""
    passes = F.lit(True) if predicate is None else predicate
    dealt, _ = _shards(base.select("vec_id", "embedding", passes.alias("passes")), shard_rows)
    out = None

    def searcher(block):
        def search(rows: pa.Table, links: pa.Table) -> pa.Table:
            shard = rows["shard"][0].as_py()
            ids, vectors, table = _ordered(rows)
            ok = table["passes"].to_numpy(zero_copy_only=False).astype(bool)
            levels = levels_of(ids, m, seed)
            order = np.lexsort((links["pos"].to_numpy(), links["src"].to_numpy(), links["level"].to_numpy()))
            level = links["level"].to_numpy()[order]
            src, dst = np.searchsorted(ids, links["src"].to_numpy()[order]), np.searchsorted(ids, links["dst"].to_numpy()[order])
            graph = Hnsw(vectors, levels, m) if kind == "hnsw" else Acorn(vectors, levels, m, gamma, m_beta)
            graph.layers = [{} for _ in range(int(levels.max(initial=0)) + 1)]
            for a, i, j in zip(level.tolist(), src.tolist(), dst.tolist()):
                graph.layers[a].setdefault(i, []).append(j)
            graph.entry = int(np.lexsort((np.arange(len(levels)), -levels))[0])
            found = []
            for q, v in zip(block.value[0].tolist(), block.value[1]):
                hits, effort = graph.search(v, k, ef) if kind == "hnsw" else graph.search(v, k, ef, ok)
                first = True
                for d, i in hits or [(math.inf, -1)]:
                    found.append((q, int(ids[i]) if i >= 0 else -1, d, *(effort[c] if first else 0 for c in SPENT), int(ids[effort["seed"]]), shard))
                    first = False
            kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * (len(SPENT) + 2)]
            columns = list(zip(*found)) if found else [[]] * len(kinds)
            return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in FOUND.split(", ")])

        return search

    for block in query_blocks(queries, None):
        part = dealt.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(searcher(block), FOUND)
        out = part if out is None else out.unionByName(part)
    own = Window.partitionBy("query_id")
    sums = out.select("*", *[F.sum(c).over(own).alias(f"_{c}") for c in SPENT], F.min("seed0").over(own).alias("_seed0"), F.size(F.collect_set("shard").over(own)).cast("bigint").alias("searches"))
    ranked = sums.where("neighbor_id >= 0").withColumn("rank", F.row_number().over(own.orderBy("distance", "neighbor_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbor_id", "distance", *[F.col(f"_{c}").alias(c) for c in (*SPENT, "seed0")], *(["shard", F.col("seed0").alias("seed"), "searches"] if traced else []))


def level0_edges(index: DataFrame) -> DataFrame:
    return index.where("level = 0").select("src", "pos", "dst")


def index_statistics(index: DataFrame) -> DataFrame:
    """Per level: nodes with links and their average number of distinct links."""
    per = index.groupBy("level", "src").agg(F.count_distinct("dst").alias("degree"))
    return per.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.avg("degree").alias("avg_degree"))


def save_index(index: DataFrame, path: str, parameters: dict, rows: int) -> None:
    """The links and, beside them, what the index was built with and over how many rows."""
    index.write.mode("overwrite").parquet(f"{path}/links")
    spark = index.sparkSession
    spark.createDataFrame([(str(k), str(v)) for k, v in sorted({**parameters, "rows": rows}.items())], "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")


def load_index(spark: SparkSession, path: str, parameters: dict, rows: int) -> DataFrame:
    """The links, refused if built otherwise or over another number of rows."""
    found = {r.name: r.value for r in spark.read.parquet(f"{path}/parameters").collect()}
    wanted = {str(k): str(v) for k, v in {**parameters, "rows": rows}.items()}
    if found != wanted:
        raise ValueError(f"index was built with {found}, wanted {wanted}")
    return spark.read.schema(INDEX).parquet(f"{path}/links")
