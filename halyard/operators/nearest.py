"""Exact nearest neighbours.

Queries come in blocks of a fixed number of rows; a block is broadcast and every task compares it
with its own part of the base in matrix form, keeping k candidates per query.  Only those reach the
shuffle: tasks x queries x k rows, whatever the size of the base.  Ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.vectors import close_pairs, distances_between, matrix
from halyard.session import written

#: Queries in one broadcast, and the distances one step of a task may hold.
QUERY_BLOCK = 2_000
STEP_CELLS = 1 << 21


def best(q: np.ndarray, d: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first candidates of each query by (distance, id)."""
    order = np.lexsort((i, d, q))
    first = np.flatnonzero(np.concatenate([[True], np.diff(q[order]) != 0])) if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[place < k]


def _search(block, k: int, by_attr: bool, skip_self: bool):
    def of_partition(batches):
        q_ids, q_vectors, q_attr = block.value
        kept = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        bound = np.full(len(q_ids), np.inf)
        for batch in batches:
            step = max(1, STEP_CELLS // max(1, len(q_ids)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(0).to_numpy()
                apart = q_attr[:, None] != part.column(2).to_numpy(zero_copy_only=False)[None, :] if by_attr else None
                if skip_self:
                    own = q_ids[:, None] == ids[None, :]
                    apart = own if apart is None else apart | own
                q, j, d = close_pairs(q_vectors, matrix(part.column(1)), bound, k, apart)
                q, dist, i = np.concatenate([kept[0], q]), np.concatenate([kept[1], d]), np.concatenate([kept[2], ids[j]])
                keep = best(q, dist, i, k)
                kept = [q[keep], dist[keep], i[keep]]
                count = np.bincount(kept[0], minlength=len(q_ids))
                last = np.cumsum(count) - 1
                full = count == k
                bound[full] = kept[1][last[full]]
        if len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[kept[0]]), pa.array(kept[2]), pa.array(kept[1])], ["query_id", "neighbor_id", "distance"])

    return of_partition


def query_blocks(queries: DataFrame, attr: str | None, block: int = QUERY_BLOCK):
    """(ids, vectors, attributes) of about ``block`` queries at a time, broadcast."""
    spark = queries.sparkSession
    count = queries.count()
    blocks = -(-count // block)
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        table = part.select("query_id", "embedding", *([attr] if attr else [])).toArrow()
        if table.num_rows:
            yield spark.sparkContext.broadcast((table["query_id"].to_numpy(), matrix(table["embedding"]), table[attr].to_numpy() if attr else None))


def nearest(base: DataFrame, queries: DataFrame, k: int, attr: str | None = None, skip_self: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance (squared) of the k nearest rows of base
    (vec_id, embedding); with ``attr`` only rows whose attribute equals the query's."""
    own = base.select("vec_id", "embedding", *([attr] if attr else []))
    schema = "query_id bigint, neighbor_id bigint, distance double"
    parts = [own.mapInArrow(_search(b, k, attr is not None, skip_self), schema) for b in query_blocks(queries, attr, block)]
    if not parts:
        parts = [base.sparkSession.createDataFrame([], schema)]
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbor_id", "distance")


def padded(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k rows per query: missing ones have neighbour -1 at infinite distance."""
    slots = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    joined = slots.join(found, ["query_id", "rank"], "left")
    return joined.select("query_id", "rank", F.coalesce("neighbor_id", F.lit(-1)).alias("neighbor_id"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def _cells(pivots):
    def of_partition(batches):
        """vec_id, embedding, cell and to_pivot: each row with its nearest pivot and the distance."""
        for batch in batches:
            x = matrix(batch.column(1))
            d = np.sqrt(distances_between(x, pivots.value))
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["vec_id", "embedding", "cell", "to_pivot"])

    return of_partition


NEAR = "src bigint, dst bigint, distance double"


def _near(q: np.ndarray, vectors: np.ndarray, wanted: np.ndarray, base: pa.Table, m: int) -> pa.Table:
    """The m nearest of a block's rows to each asking row, within the distance that it still wants."""
    ids, x, found = base["vec_id"].to_numpy(), matrix(base["embedding"]), []
    step = max(1, STEP_CELLS // max(1, len(ids)))
    for at in range(0, len(q) if len(ids) else 0, step):
        row, col, d = close_pairs(vectors[at : at + step], x, wanted[at : at + step], m, q[at : at + step, None] == ids[None, :])
        keep = best(row, d, ids[col], m)
        found.append((q[at + row[keep]], ids[col[keep]], d[keep]))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [[]] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["src", "dst", "distance"])


def _pairs(m: int):
    def of_group(asked: pa.Table, base: pa.Table) -> pa.Table:
        return _near(asked["vec_id"].to_numpy(), matrix(asked["embedding"]), asked["wanted"].to_numpy(), base, m)

    return of_group


def _packed_pairs(m: int):
    def of_group(asked: pa.Table, base: pa.Table) -> pa.Table:
        """The same for asking rows that came many in a row, as bytes."""
        joined = lambda name, kind: np.frombuffer(b"".join(asked[name].to_pylist()), kind)
        q = joined("ids", np.int64)
        vectors = joined("vectors", np.float32).astype(np.float64)
        return _near(q, vectors.reshape(len(q), -1) if len(q) else vectors.reshape(0, 0), joined("wanted", np.float64), base, m)

    return of_group


def _messages(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["cell", "block", "part", "ids", "vectors", "wanted"])


def _best_of(found: DataFrame, m: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy("distance", "dst")  # candidates of one row: m a block
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= m)


def knn_edges(base: DataFrame, m: int, block_rows: int = 4_000, max_pivots: int = 1_024) -> DataFrame:
    """src, pos (from 0), dst: the m nearest others of every row.

    Rows are dealt to the cells of a bounded number of pivots, and large cells to blocks.  A row
    first asks its own block, which bounds the distance it still wants; then only those blocks
    that the triangle inequality does not rule out (by their cell's pivot and its least and largest
    distance), in groups of bounded size.  Only the pivots pass through the driver."""
    spark = base.sparkSession
    own = base.select(F.col("vec_id").cast("bigint"), "embedding")
    n = own.count()
    if n < 2:
        return spark.createDataFrame([], "src bigint, pos int, dst bigint")
    few = min(max_pivots, -(-n // block_rows))
    chosen = own.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(few).select("embedding").toArrow()  # at most max_pivots rows
    pivots = matrix(chosen["embedding"])
    placed = written(own.mapInArrow(_cells(spark.sparkContext.broadcast(pivots)), "vec_id bigint, embedding array<float>, cell int, to_pivot double"))
    cells = placed.groupBy("cell").agg(F.min("to_pivot").alias("least"), F.max("to_pivot").alias("most"), F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("blocks"))
    sizes = cells.collect()  # at most max_pivots rows
    table = spark.createDataFrame(sizes, cells.schema)
    blocked = written(placed.join(F.broadcast(table.select("cell", "blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks")).cast("int")))
    key = ["cell", "block"]
    asked = blocked.select(*key, "vec_id", "embedding", F.lit(float("inf")).alias("wanted"))
    rows = blocked.select(*key, "vec_id", "embedding")
    first = written(asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(_pairs(m), NEAR))
    if sum(c.blocks for c in sizes) == 1:
        return _best_of(first, m).select("src", (F.col("place") - 1).alias("pos"), "dst")
    full = first.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
    radius = full.select(F.col("src").alias("vec_id"), F.when(F.col("n") >= m, F.col("far")).otherwise(float("inf")).alias("wanted"))
    asking = blocked.join(radius, "vec_id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(float("inf"))))
    shared = spark.sparkContext.broadcast((pivots, {c.cell: (c.least, c.most, c.blocks) for c in sizes}))

    parts = max(1, -(-n // (8 * block_rows)))  # askers of a block come in parts of bounded size

    def sent(batches):
        """A row to every other block that may hold something nearer than what it has, the rows of a
        batch for one block together."""
        pivots, known = shared.value
        for batch in batches:
            cell, block, ids, wanted = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            x = matrix(batch.column(3))
            d, x = np.sqrt(distances_between(x, pivots)), x.astype(np.float32)
            reach = np.sqrt(wanted) * (1 + 1e-6) + 1e-6
            part = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
            out = []
            for c, (least, most, blocks) in known.items():
                near = (d[:, c] - reach <= most) & (d[:, c] + reach >= least)
                for b in range(blocks):
                    mine = near & ~((cell == c) & (block == b))
                    for p in np.unique(part[mine]).tolist():
                        own = np.flatnonzero(mine & (part == p))
                        out.append((c, b, p, ids[own].tobytes(), x[own].tobytes(), wanted[own].tobytes()))
                        if len(out) == 16:
                            yield _messages(out)
                            out = []
            if out:
                yield _messages(out)

    wide = asking.select(*key, "vec_id", "embedding", "wanted").mapInArrow(sent, "cell int, block int, part int, ids binary, vectors binary, wanted binary")
    again = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    more = wide.groupBy(*key, "part").cogroup(again.groupBy(*key, "part")).applyInArrow(_packed_pairs(m), NEAR)
    return _best_of(first.unionByName(more), m).select("src", (F.col("place") - 1).alias("pos"), "dst")


def prefilter(base: DataFrame, queries: DataFrame, k: int, predicate) -> DataFrame:
    """Filter first: exact search over the passing rows, with its effort (distances = passing rows,
    filter checks = all rows)."""
    passing = base.where(predicate)
    effort = base.agg(F.count(F.lit(1)).alias("filter_checks"), F.sum(predicate.cast("bigint")).alias("dist_exact"))
    return nearest(passing, queries, k).join(F.broadcast(effort))


def compare_neighbours(a: DataFrame, b: DataFrame, slack: float = 1e-9) -> DataFrame:
    """Queries by agreement of two tables: identical ids, only ties exchanged, or a mismatch."""
    joined = a.alias("a").join(b.alias("b"), ["query_id", "rank"], "full_outer")
    same_id = F.coalesce(F.col("a.neighbor_id") == F.col("b.neighbor_id"), F.lit(False))
    same_distance = F.coalesce(F.abs(F.col("a.distance") - F.col("b.distance")) <= slack, F.lit(False))
    per = joined.groupBy("query_id").agg(F.min(same_id.cast("int")).alias("ids"), F.min(same_distance.cast("int")).alias("distances"))
    return per.select("query_id", F.when(F.col("ids") == 1, "identical").when(F.col("distances") == 1, "ties").otherwise("mismatch").alias("agreement"))
