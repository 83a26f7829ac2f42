"""Exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance d(x, y) = 1 - |x n y| / |x u y| is a metric; documents link when d <= r.

1. Blocking.  Unrelated documents are at distance 1 from each other and from every pivot, where no
   pivot can tell them apart, so first a prefix filter brings together what might be closer: with
   shingles ordered by rarity (document counts over the whole corpus), linked documents share one of
   the first |x| - ceil((1 - r)|x|) + 1.  Points that share such a shingle are chained only if their
   sizes allow a link and so do their counts of shingles in ``CLASSES`` classes, whose differences
   bound the symmetric difference from below.  What is chained forms disjoint regions, and members of
   a region are no longer all unrelated.
2. Voronoi cells.  In every region members are taken as pivots, each farther than ``REACH`` from
   those before, and every member within ``REACH`` of a pivot belongs to the cell of its nearest one;
   what no pivot reaches forms a cell of its own.  By the triangle inequality a partner y of a member
   of cell p has d(y, p) <= d(y, nearest) + 2r and d(y, p) <= REACH + r, so y is replicated to the
   cells where that holds and to no other.  Cells are joined in the same way until they are small or
   no longer shrink, then directly, with differences of pivot distances and of sizes ruling pairs
   out.  What is linked already, by a pivot or by others, is not compared again.
3. A region that is too large for a task goes through the same step over the cluster, in pieces that
   meet the region's pivots; cells whose members are all linked are done, and what does not shrink
   is compared block against block in separate tasks.

Documents with equal sets are one point throughout.  Only membership in components is formed,
never all pairs of a group.  Counting goes by chunks and buckets: a chunk sends each shingle once
with its count, so a shingle that many documents share costs a bucket one entry per chunk.

Defined results: null or wordless texts have the empty set and link with nothing; a null id is
larger than any id; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm import cluster
from halyard.llm.components import connected_components
from halyard.llm.substring_dedup import _pack, _unpack
from halyard.llm.text import Runs, by_chunk, mix, range_hash, release, words_of

SHINGLE = 4
#: Documents link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Bytes of sets that one task may hold of a region.
REGION_BYTES = 4 << 20
#: Pivots of one step, and the distance up to which they draw members into their cells.
PIVOTS = 16
REACH = 0.5
#: Members compared directly, and steps over the cluster before blocks are compared.
LEAF = 16
MAX_LEVELS = 6
#: Classes of shingles that are counted to tell points apart before they are chained, and the
#: members of a chain that are told apart one by one; longer chains hold together as they are.
CLASSES = 64
CHAIN = 4096


class _Sets:
    """The shingle sets of some texts: text d has the sorted hashes ``h[first[d]:first[d + 1]]``."""

    def __init__(self, column, k: int):
        words = words_of(column, lower=True)
        word = words.hashes()
        doc = words.doc_of_word()
        at = np.arange(len(word))
        full = at + k <= words.first[1:][doc] if len(word) else np.zeros(0, bool)
        count = words.counts()
        short = np.flatnonzero((count > 0) & (count < k))
        h = np.concatenate([range_hash(word, at[full], at[full] + k), range_hash(word, words.first[short], words.first[short + 1])])
        d = np.concatenate([doc[full], short])
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        self.h, self.doc = h[new], d[new]
        self.size = np.bincount(self.doc, minlength=len(count)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def classes(self, docs: np.ndarray) -> np.ndarray:
        """Of each of some texts, how many of its shingles are in each class."""
        row = np.full(len(self.size), -1)
        row[docs] = np.arange(len(docs))
        of = row[self.doc]
        own = of >= 0
        cell = of[own] * CLASSES + (self.h[own] >> np.uint64(7)).astype(np.int64) % CLASSES
        return np.minimum(np.bincount(cell, minlength=len(docs) * CLASSES), 0xFFFF).astype(np.uint16).reshape(-1, CLASSES)

    def points(self) -> list[bytes | None]:
        """16 bytes that name the set, None for the empty one."""
        a = range_hash(self.h, self.first[:-1], self.first[1:])
        b = range_hash(mix(self.h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), self.first[:-1], self.first[1:])
        both = np.stack([a, b], axis=1).astype(">u8")
        return [both[i].tobytes() if n else None for i, n in enumerate(self.size.tolist())]


class _Shares:
    """The distinct shingles of a chunk by bucket, ready to be counted over the corpus."""

    def __init__(self, sets: _Sets, buckets: int):
        self.value, self.of, times = np.unique(sets.h, return_inverse=True, return_counts=True)
        bucket = ((self.value >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        low = (self.value & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.order = np.lexsort((low, bucket))
        self.runs = Runs(bucket[self.order])
        self.low, self.times = low, np.minimum(times, 60_000).astype(np.uint16)

    def blobs(self):
        for b, run in self.runs:
            mine = self.order[run]
            low = self.low[mine]
            yield b, _pack(step=np.diff(low, prepend=low.dtype.type(0)), times=self.times[mine])


def _count_send(k: int, buckets: int):
    def of_partition(batches):
        for c, docs in by_chunk(batches):
            out = list(_Shares(_Sets(docs["text"], k), buckets).blobs())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([c] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "chunk", "blob"])
            release()

    return of_partition


def _count_answer(table: pa.Table) -> pa.Table:
    """Document counts of the shingles that stand in more than one document of the corpus.  They
    rank shingles; that two shingles may share the 32 bits compared here changes no result."""
    parts = [_unpack(b, np.uint32, np.uint16) for b in table["blob"].to_pylist()]
    low = np.concatenate([np.cumsum(step, dtype=np.uint32) for step, _ in parts])
    times = np.concatenate([t for _, t in parts]).astype(np.int64)
    order = np.argsort(low, kind="stable")
    ordered = low[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.add.reduceat(times[order], begin)
    held = np.empty(len(low), np.int64)
    held[order] = np.repeat(total, np.diff(np.append(begin, len(low))))
    edge = np.cumsum([0, *(len(s) for s, _ in parts)])
    out = []
    for a, b in zip(edge[:-1], edge[1:]):
        common = np.flatnonzero(held[a:b] > 1).astype(np.int32)
        out.append(_pack(step=np.diff(common, prepend=np.int32(0)), n=np.minimum(held[a:b][common], 0xFFFFFFFF).astype(np.uint32)))
    release()
    return pa.table([table["chunk"], table["bucket"], pa.array(out, pa.binary())], ["chunk", "bucket", "blob"])


PLACED = "kind string, id bigint, n bigint, point binary, chunk int, bucket int, blob binary"


def _table(kind, ids, n, point, chunk, bucket, blob) -> pa.Table:
    size = len(n)
    columns = [pa.array([kind] * size, pa.string()), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(point, pa.binary()), pa.array([chunk] * size, pa.int32()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())]
    return pa.table(columns, ["kind", "id", "n", "point", "chunk", "bucket", "blob"])


def _place(k: int, buckets: int, percent: int):
    def of_chunk(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Of a chunk: its documents ("doc"), the regions of its points ("region", by bucket), and the
        sets of points that are in a region ("set")."""
        if docs.num_rows == 0:
            return _table("doc", [], [], [], 0, [], [])
        c = docs["chunk"][0].as_py()
        sets = _Sets(docs["text"], k)
        shares = _Shares(sets, buckets)
        held = np.ones(len(shares.value), np.int64)
        for b, blob in zip(answers["bucket"].to_pylist(), answers["blob"].to_pylist()):
            step, n = _unpack(blob, np.int32, np.uint32)
            held[shares.order[shares.runs[b].start + np.cumsum(step)]] = n
        points = sets.points()
        seen, fresh = set(), np.zeros(len(points), bool)
        for i, p in enumerate(points):
            if p is not None and p not in seen:
                seen.add(p)
                fresh[i] = True
        rank = held[shares.of]
        order = np.lexsort((sets.h, rank, sets.doc))
        at = np.arange(len(order)) - sets.first[sets.doc]
        window = sets.size - (percent * sets.size + 99) // 100 + 1
        take = (at < window[sets.doc]) & (rank[order] > 1) & fresh[sets.doc]
        shingle, doc = sets.h[order][take], sets.doc[take]
        none = [None] * len(points)
        out = [_table("doc", docs["id"].to_pylist(), sets.size, points, c, none, none)]
        if len(doc):
            to = (shingle % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            member, row = np.unique(doc, return_inverse=True)
            names = np.frombuffer(b"".join(points[d] for d in member.tolist()), np.uint8).reshape(-1, 16)
            classes = sets.classes(member)
            used, blobs = [], []
            for b, run in Runs(to[by]):
                own, who = np.unique(row[by[run]], return_inverse=True)
                used.append(b)
                blobs.append(_pack(h=shingle[by[run]], who=who.astype(np.uint32), n=sets.size[member[own]], point=names[own], classes=classes[own]))
            out.append(_table("region", [None] * len(used), [0] * len(used), [None] * len(used), c, used, blobs))
            blobs = [sets.h[sets.first[d] : sets.first[d + 1]].tobytes() for d in member.tolist()]
            out.append(_table("set", [None] * len(member), sets.size[member], [points[d] for d in member.tolist()], c, [None] * len(member), blobs))
        release()
        return pa.concat_tables(out)

    return of_chunk


class _Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def may_link(n: np.ndarray, classes: np.ndarray, x: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and class counts allow x to link with others: 100 i >= percent u means
    (100 + percent) |x - y| <= (100 - percent) (|x| + |y|), and the differences of the counts add up
    to no more than the symmetric difference |x - y|."""
    apart = np.abs(classes[others].astype(np.int32) - classes[x].astype(np.int32)).sum(axis=1)
    return (100 + percent) * apart <= (100 - percent) * (n[others] + n[x])


def _chain(percent: int):
    def of_bucket(table: pa.Table) -> pa.Table:
        """Edges (u, v) that chain the points of each shingle that may link: a tree for each group, so
        there are fewer edges than points."""
        parts = [_unpack(b, np.uint64, np.uint32, np.int64, np.uint8, np.uint16) for b in table["blob"].to_pylist()]
        own = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])])
        h = np.concatenate([p[0] for p in parts])
        who = np.concatenate([p[1].astype(np.int64) + at for p, at in zip(parts, own)])
        name = np.ascontiguousarray(np.concatenate([p[3] for p in parts]).reshape(-1, 16)).view("V16").ravel()
        names, first, same = np.unique(name, return_index=True, return_inverse=True)
        n = np.concatenate([p[2] for p in parts])[first]
        classes = np.concatenate([p[4].reshape(-1, CLASSES) for p in parts])[first]
        point = same[who]
        order = np.lexsort((point, n[point], h))
        h, point = h[order], point[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (point[1:] != point[:-1])
        h, point = h[new], point[new]
        forest, seen = _Forest(len(names)), set()
        for _, run in Runs(h):
            members = point[run]
            if len(members) < 2 or (mark := members.tobytes()) in seen:
                continue
            seen.add(mark)
            if len(members) > CHAIN:
                near = 100 * n[members[:-1]] >= percent * n[members[1:]]
                for a, b in zip(members[:-1][near].tolist(), members[1:][near].tolist()):
                    forest.join(a, b)
                continue
            last = np.searchsorted(percent * n[members], 100 * n[members], "right")  # sizes ascend
            for i, x in enumerate(members.tolist()):
                mine = forest.root(x)
                later = np.array([y for y in members[i + 1 : last[i]].tolist() if forest.root(y) != mine], np.int64)
                if len(later):
                    for y in later[may_link(n, classes, x, later, percent)].tolist():
                        forest.join(x, y)
        raw = [v.tobytes() for v in names]
        edges = [(raw[x], raw[r]) for x in range(len(names)) if (r := forest.root(x)) != x]
        release()
        return pa.table([pa.array([e[0] for e in edges], pa.binary()), pa.array([e[1] for e in edges], pa.binary())], ["u", "v"])

    return of_bucket


class _Region:
    """Members of a region with their sets, joined recursively by Voronoi cells.  ``roots``: names of
    what members are known to be linked with; those of one name start in one component."""

    def __init__(self, sets: list[np.ndarray], percent: int, roots: list | None = None):
        self.sets, self.percent, self.r = sets, percent, 1 - percent / 100
        self.n = np.array([len(s) for s in sets], np.int64)
        self.forest = _Forest(len(sets))
        self.cells = self.compared = 0
        first: dict = {}
        for i, root in enumerate(roots or []):
            if root is not None:
                self.forest.join(first.setdefault(root, i), i)

    def distances(self, x: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of x to others, and which of them link with it (in whole numbers)."""
        i = common(self.sets[x], [self.sets[y] for y in others.tolist()])
        u = self.n[x] + self.n[others] - i
        self.compared += len(others)
        return 1 - i / u, 100 * i >= self.percent * u

    def together(self, members: np.ndarray) -> bool:
        """Whether the members are one component already."""
        return len({self.forest.root(x) for x in members.tolist()}) < 2

    def join(self, members: np.ndarray) -> None:
        """Pivots as far from each other as can be, until all members are within their reach."""
        if self.together(members):
            return
        d, pivots, nearest = [], [], np.full(len(members), np.inf)
        while len(pivots) < PIVOTS and nearest.max() > REACH:
            p = int(nearest.argmax())
            far, linked = self.distances(int(members[p]), members)
            for y in members[linked].tolist():
                self.forest.join(int(members[p]), y)
            pivots.append(p)
            d.append(far)
            nearest = np.minimum(nearest, far)
        for cell in voronoi_cells(np.array(d), self.r):
            self.cells += 1
            left = members[np.setdiff1d(cell, pivots)]  # pivots have been compared with all
            if self.together(left):
                continue
            if len(left) <= LEAF or len(left) > 0.8 * len(members):
                self.leaf(left)
            else:
                self.join(left)

    def leaf(self, members: np.ndarray) -> None:
        """Each member against those after it that are not yet in its component and that neither
        sizes nor pivot distances (the triangle inequality) rule out."""
        members = members[np.argsort(self.n[members], kind="stable")]
        to_pivot: list[np.ndarray] = []
        for j, x in enumerate(members[:-1].tolist()):
            later = np.arange(j + 1, len(members))
            later = later[100 * self.n[x] >= self.percent * self.n[members[later]]]
            for d in to_pivot:
                later = later[~(np.abs(d[later] - d[j]) > self.r + 1e-9)]
            mine = self.forest.root(x)
            later = later[[self.forest.root(y) != mine for y in members[later].tolist()]] if len(later) else later
            if not len(later):
                continue
            d, linked = self.distances(x, members[later])
            for y in members[later[linked]].tolist():
                self.forest.join(x, y)
            if len(to_pivot) < 8 and len(later) > 16:
                known = np.full(len(members), np.nan)
                known[later], known[j] = d, 0.0
                to_pivot.append(known)


def common(mine: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
    size = np.array([len(x) for x in others])
    return np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(size) - size)


def voronoi_cells(d: np.ndarray, r: float, reach: float = REACH) -> list[np.ndarray]:
    """The members of each pivot's cell with its window, from the distances d[pivot, member], and last
    the members that no pivot reaches: a pair within r is together in one of them.  A member's
    copies are its own cell and those whose pivots its distances allow."""
    nearest = d.argmin(axis=0)
    least = d[nearest, np.arange(d.shape[1])]
    reached = least <= reach
    cells = []
    for p in range(len(d)):
        core = reached & (nearest == p)
        radius = least[core].max() if core.any() else -np.inf
        window = (d[p] <= least + 2 * r + 1e-9) & (d[p] <= radius + r + 1e-9)
        cells.append(np.flatnonzero(core | window))
    cells.append(np.flatnonzero(~reached))
    return [c for c in cells if len(c)]


EDGES = "u binary, v binary"
LINKS = EDGES + ", cells bigint, compared bigint"


def _join_regions(percent: int):
    def of_group(table: pa.Table) -> pa.Table:
        """Edges from each member of a component to its smallest member, for whole regions, and a row
        without edge that says what was done."""
        region, point, root = (table[c].to_pylist() for c in ("region", "point", "root"))
        sets = [np.frombuffer(b, np.uint64) for b in table["blob"].to_pylist()]
        out_u, out_v, cells, compared = [], [], 0, 0
        by: dict[bytes, list[int]] = {}
        for i in sorted(range(len(point)), key=point.__getitem__):
            by.setdefault(region[i], []).append(i)
        for rows in by.values():
            work = _Region([sets[i] for i in rows], percent, [root[i] for i in rows])
            work.join(np.arange(len(rows)))
            cells, compared = cells + work.cells, compared + work.compared
            for j, i in enumerate(rows):
                up = work.forest.root(j)
                if up != j:
                    out_u.append(point[i])
                    out_v.append(point[rows[up]])
        release()
        none = [None] * len(out_u)
        return pa.table([pa.array([*out_u, None], pa.binary()), pa.array([*out_v, None], pa.binary()), pa.array([*none, cells], pa.int64()), pa.array([*none, compared], pa.int64())], ["u", "v", "cells", "compared"])

    return of_group


MEMBERS = "region binary, point binary, n bigint, blob binary, root binary"


def separated(pivots: list[tuple[bytes, np.ndarray]]) -> list[tuple[bytes, np.ndarray]]:
    """Those of the pivots that are out of reach of the ones kept before them."""
    kept: list[tuple[bytes, np.ndarray]] = []
    for name, mine in pivots:
        if kept:
            i = common(mine, [s for _, s in kept])
            if (1 - i / (len(mine) + np.array([len(s) for _, s in kept]) - i)).min() <= REACH:
                continue
        kept.append((name, mine))
    return kept


def _assign(percent: int):
    r = 1 - percent / 100

    def of_piece(members: pa.Table, chosen: pa.Table) -> pa.Table:
        """A piece of a too large region to the cells of the region's pivots, windows included.  Rows
        without a region are links: a point and the pivot (in root) it is linked with."""
        out: list[tuple] = []
        pivots = separated(sorted((n, np.frombuffer(b, np.uint64)) for n, b in zip(chosen["point"].to_pylist(), chosen["blob"].to_pylist())))
        names, sets = [n for n, _ in pivots], [s for _, s in pivots]
        size = np.array([len(s) for s in sets], np.int64)
        for region, point, n, blob, root in zip(*(members[c].to_pylist() for c in ("region", "point", "n", "blob", "root"))):
            i = common(np.frombuffer(blob, np.uint64), sets)
            u = n + size - i
            d, linked = 1 - i / u, 100 * i >= percent * u
            out += [(None, point, n, None, names[j]) for j in np.flatnonzero(linked).tolist() if names[j] != point]
            near = int(d.argmin())
            home = near if d[near] <= REACH else -1
            window = np.flatnonzero(d <= min(d[near] + 2 * r, REACH + r) + 1e-9).tolist()
            for j in sorted({home, *window}):
                cell = hashlib.md5(region + b"rest" if j < 0 else region + names[j]).digest()
                out.append((cell, point, n, blob, names[j] if j >= 0 and linked[j] else root))
        release()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()))], ["region", "point", "n", "blob", "root"])

    return of_piece


def _split(large: DataFrame, sizes: DataFrame, percent: int, level: int, region_bytes: int) -> DataFrame:
    """Members in pieces of about the size that a task may hold, each with the pivots of its region:
    about ``PIVOTS`` that a hash chooses, so no region is gathered to choose them."""
    own = large.join(sizes.select("region", "members", F.ceil(2 * F.col("bytes") / F.lit(region_bytes)).cast("int").alias("pieces")), "region")
    draw = F.pmod(F.xxhash64(F.lit(level), "point"), F.col("members"))
    first = own.groupBy("region").agg(F.min("point").alias("point"), F.first("pieces").alias("pieces"))
    drawn = own.where(draw < PIVOTS).select("region", "point", "pieces").unionByName(first).distinct()
    # saved, because a cogroup of two tables that share columns by their origin is refused as ambiguous
    pivots = cluster.saved(large.select("region", "point", "blob").join(drawn, ["region", "point"]), codec="none").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    pieces = own.withColumn("piece", F.pmod(F.xxhash64("point", F.lit("piece")), F.col("pieces")).cast("int"))
    return pieces.groupBy("region", "piece").cogroup(pivots.groupBy("region", "piece")).applyInArrow(_assign(percent), MEMBERS)


def _in_blocks(large: DataFrame, sizes: DataFrame, region_bytes: int) -> DataFrame:
    """Regions that cells do not shrink: every pair of blocks of members becomes a region."""
    blocks = F.ceil(2 * F.col("bytes") / F.lit(region_bytes)).cast("int")
    cut = large.join(sizes.select("region", "bytes"), "region").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.concat_ws(":", F.hex("region"), F.least("mine", "other"), F.greatest("mine", "other"))
    return cut.select(F.unhex(F.md5(pair)).alias("region"), "point", "n", "blob", "root")


def _region_links(members: DataFrame, percent: int, region_bytes: int) -> tuple[DataFrame, bool]:
    """(links that span the components, whether a region was split and they must be merged)."""
    spark = members.sparkSession
    found, split = [], False
    for level in range(MAX_LEVELS + 1):
        alike = F.min("root").eqNullSafe(F.max("root")) & (F.count("root") == F.count(F.lit(1)))
        sizes = cluster.saved(members.groupBy("region").agg((8 * F.sum("n")).alias("bytes"), F.count(F.lit(1)).alias("members"), alike.alias("done")).where("not done and members > 1"))
        all_bytes, most = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
        groups = cluster.pieces(all_bytes, cluster.partitions(spark))
        small = members.join(sizes.where(F.col("bytes") <= region_bytes).select("region"), "region", "left_semi")
        group = F.pmod(F.xxhash64("region"), F.lit(groups)).alias("group")
        found.append(small.select("region", "point", "blob", "root", group).groupBy("group").applyInArrow(_join_regions(percent), LINKS))
        if most <= region_bytes:
            break
        split = True
        over = sizes.where(F.col("bytes") > region_bytes)
        large = members.join(over.select("region"), "region", "left_semi")
        if level < MAX_LEVELS - 1:
            placed = cluster.saved(_split(large, over, percent, level, region_bytes), codec="none")
            found.append(placed.where("region IS NULL").select(F.col("point").alias("u"), F.col("root").alias("v"), F.lit(None).cast("bigint").alias("cells"), F.lit(None).cast("bigint").alias("compared")))
            members = placed.where("region IS NOT NULL")
        else:
            members = cluster.saved(_in_blocks(large, over, region_bytes), codec="none")
            region_bytes = 1 << 62  # blocks are small by construction
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links, split


def _regions(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(points, members): every row's id, set size and point, and the regions' members with their sets."""
    spark = docs.sparkSession
    n = cluster.partitions(spark)
    size = cluster.text_size(docs, text_col)
    chunks = buckets = cluster.pieces(size, n)
    dealt = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    dealt = dealt.select("*", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(chunks)).cast("int").alias("chunk")).repartition(n, "chunk")
    sent = dealt.sortWithinPartitions("chunk").mapInArrow(_count_send(k, buckets), "bucket int, chunk int, blob binary")
    counts = sent.groupBy("bucket").applyInArrow(_count_answer, "chunk int, bucket int, blob binary")
    placed = cluster.saved(dealt.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_place(k, buckets, percent), PLACED))

    points = placed.where("kind = 'doc'").select("id", F.col("n").alias("n_shingles"), "point")
    chains = placed.where("kind = 'region'").select("bucket", "blob").groupBy("bucket").applyInArrow(_chain(percent), EDGES)
    regions = connected_components(chains)
    sets = placed.where("kind = 'set'").select("point", "n", "chunk", "blob").join(regions.select(F.col("node").alias("point"), F.col("component").alias("region")), "point")
    one = sets.groupBy("point").agg(F.min("chunk").alias("chunk"))
    members = sets.join(one, ["point", "chunk"], "left_semi").select("region", "point", "n", "blob", F.lit(None).cast("binary").alias("root"))
    return points, cluster.saved(members, codec="none")


def region_counters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, region_bytes: int = REGION_BYTES) -> DataFrame:
    """One row: regions, members in them, Voronoi cells formed in tasks, and distances computed there."""
    _, members = _regions(docs, id_col, text_col, k, percent)
    links, _ = _region_links(members, percent, region_bytes)
    done = links.agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"), F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
    return members.agg(F.count_distinct("region").alias("regions"), F.count(F.lit(1)).alias("members")).join(F.broadcast(done))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, region_bytes: int = REGION_BYTES) -> DataFrame:
    """One row per input row: id, n_shingles, point (names the set; null if empty), component_id (the
    smallest id reachable by links, itself included)."""
    points, members = _regions(docs, id_col, text_col, k, percent)
    links, split = _region_links(members, percent, region_bytes)
    edges = links.where("u IS NOT NULL").select("u", "v")
    if split:
        labels = connected_components(edges).select(F.col("node").alias("point"), F.col("component").alias("label"))
    else:
        edges = cluster.saved(edges)
        labels = edges.select(F.col("u").alias("point"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("point"), F.col("v").alias("label")).distinct())

    smallest = points.where("point IS NOT NULL").groupBy("point").agg(F.min("id").alias("least"))
    named = smallest.join(labels, "point", "left").withColumn("label", F.coalesce("label", "point"))
    by_label = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_point = named.join(by_label, "label").select("point", "component_id")
    out = points.join(of_point, "point", "left")
    return out.select("id", "n_shingles", "point", F.when(F.col("point").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
