"""What a graph search can reach under its traversal rules.

Edges are (src, pos, dst); pos is the place in the adjacency list.  ``passing`` is a table (vec_id)
of the rows that pass the filter.  Graphs of at most ``BROADCAST_EDGES`` steps (counted first) are
broadcast and searched in memory; larger ones advance by frontiers: join, drop what is known,
write, until nothing is new, and nothing is gathered.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.operators.ranks import global_rank
from halyard.session import written

#: Rings of a closure that are kept apart.
COMPACT = 12
#: Steps (and nodes) of a graph that is searched in memory.
BROADCAST_EDGES = 1_000_000
GRAPH, SEM, CAP, UNFILTERED = "graph", "sem", "cap", "unfiltered"


def _passing(edges: DataFrame, passing: DataFrame) -> DataFrame:
    return edges.join(passing.select(F.col("vec_id").alias("dst")), "dst", "left_semi")


def successors(edges: DataFrame, passing: DataFrame, rule: str, gamma: int = 1, m_beta: int = 0, m: int = 0) -> DataFrame:
    """Distinct (src, dst), itself excluded.  graph: passing neighbours; sem: also the passing
    neighbours of any neighbour at an expanded position (all if gamma is 1, else pos >= m_beta);
    cap: a replay of one scan that stops after 2m passing entries; unfiltered: all neighbours."""
    if rule == UNFILTERED:
        found = edges
    elif rule == GRAPH:
        found = _passing(edges, passing)
    elif rule == SEM:
        over = edges if gamma == 1 else edges.where(F.col("pos") >= m_beta)
        second = _passing(edges, passing).select(F.col("src").alias("via"), F.col("dst").alias("end"))
        hops = over.select("src", F.col("dst").alias("via")).join(second, "via").select("src", F.col("end").alias("dst"))
        found = _passing(edges, passing).select("src", "dst").unionByName(hops)
    elif rule == CAP:
        return capped_successors(edges, passing, gamma, m_beta, m)
    else:
        raise ValueError(rule)
    return found.select("src", "dst").where("src <> dst").distinct()


def capped_scans(source: np.ndarray, first: np.ndarray, node: np.ndarray, ok: np.ndarray, inner_first: np.ndarray, inner: np.ndarray, gamma: int, m_beta: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Many capped scans side by side: (which source, node found), each source's in order.

    Source i has the entries ``first[i]:first[i + 1]`` of node and ok, in list order; entry e leads to
    the passing nodes ``inner[inner_first[e]:inner_first[e + 1]]``.  All sources take their next entry
    at once.  Passing entries count, repeated ones too; a scan is over when a new direct entry is the
    2m-th or later, and opens no further lists once a new entry inside one is.  Within a list the
    running count is the count so far and the place in the list, so where it ends is a search."""
    size, inner_size = np.diff(first), np.diff(inner_first)
    of_entry = np.repeat(np.arange(len(source)), size)
    of_inner = np.repeat(of_entry, inner_size)
    # what was seen is a flag per distinct (source, node)
    codes = np.unique(np.concatenate([source, node, inner]), return_inverse=True)[1]
    who = np.concatenate([np.arange(len(source)), of_entry, of_inner])
    flags = np.unique(who * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
    own, direct, within = np.split(flags, [len(source), len(source) + len(node)])
    seen = np.zeros(int(flags.max(initial=-1)) + 1, bool)
    seen[own] = True
    count, scanning, opening = np.zeros(len(source), np.int64), np.ones(len(source), bool), np.ones(len(source), bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for pos in range(int(size.max(initial=0))):
        s = np.flatnonzero(scanning & (size > pos))
        e = first[s] + pos
        count[s] += ok[e]
        fresh = ~seen[direct[e]]
        new = fresh & ok[e]
        seen[direct[e[new]]] = True
        found.append((s[new], node[e[new]]))
        scanning[s[new]] = count[s[new]] < 2 * m
        wide = fresh & scanning[s] & (np.full(len(s), gamma == 1) | (opening[s] & (pos >= m_beta)))
        s, e = s[wide], e[wide]
        length = inner_size[e]
        row = np.repeat(np.arange(len(e)), length)
        place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        at = inner_first[e][row] + place
        new = np.zeros(len(at), bool)
        new[np.unique(within[at], return_index=True)[1]] = True
        new &= ~seen[within[at]]
        full = new & (count[s][row] + place + 1 >= 2 * m)
        read = length.copy()
        np.minimum.at(read, row[full], place[full] + 1)
        new &= place < read[row]
        seen[within[at[new]]] = True
        found.append((s[row[new]], inner[at[new]]))
        count[s] += read
        opening[s[np.unique(row[full])]] = False
    which, nodes = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(which, kind="stable")
    return which[order], nodes[order]


def capped_scan(u: int, entries: list[tuple[int, bool]], lists: dict[int, list[int]], gamma: int, m_beta: int, m: int) -> list[int]:
    """``capped_scans`` of one source.  ``entries``: (neighbour, passes); ``lists``: passing members of a
    neighbour's own list, in its order."""
    inner = [lists.get(v, ()) for v, _ in entries]
    numbers = lambda x, kind=np.int64: np.array(list(x), kind)
    return capped_scans(numbers([u]), numbers([0, len(entries)]), numbers(v for v, _ in entries), numbers((p for _, p in entries), bool), np.cumsum([0, *map(len, inner)]), numbers(w for x in inner for w in x), gamma, m_beta, m)[1].tolist()


def capped_successors(edges: DataFrame, passing: DataFrame, gamma: int, m_beta: int, m: int) -> DataFrame:
    marked = edges.join(passing.select(F.col("vec_id").alias("dst"), F.lit(True).alias("ok")), "dst", "left").select("src", "pos", "dst", F.coalesce("ok", F.lit(False)).alias("ok"))
    own = marked.where("ok").groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "dst"))), lambda e: e.dst).alias("list"))
    lists = own.select(F.col("src").alias("dst"), "list")
    entries = marked.join(lists, "dst", "left").groupBy("src").agg(F.sort_array(F.collect_list(F.struct("pos", "dst", "ok", F.coalesce("list", F.array().cast("array<bigint>")).alias("list")))).alias("e"))
    columns = entries.select(F.col("src").cast("bigint"), F.col("e.dst").cast("array<bigint>").alias("node"), F.col("e.ok").alias("ok"), F.col("e.list").cast("array<array<bigint>>").alias("inner"))

    def scan(batches):
        for batch in batches:
            source, node, ok, inner = batch.columns
            lists = inner.flatten()
            which, found = capped_scans(source.to_numpy(), _offsets(node), node.flatten().to_numpy(), ok.flatten().to_numpy(zero_copy_only=False), _offsets(lists), lists.flatten().to_numpy(), gamma, m_beta, m)
            yield pa.RecordBatch.from_arrays([pa.array(source.to_numpy()[which]), pa.array(found, pa.int64())], ["src", "dst"])

    return columns.mapInArrow(scan, "src bigint, dst bigint")


def _offsets(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins in the flattened array, and the end."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)


def induced(steps: DataFrame, passing: DataFrame) -> DataFrame:
    """The steps among passing rows."""
    return _passing(steps, passing).join(passing.select(F.col("vec_id").alias("src")), "src", "left_semi").select("src", "dst")


class Graph:
    """A graph of at most ``BROADCAST_EDGES`` steps as arrays: ids ascending, and the places of each
    node's successors in one flat array."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, nodes: np.ndarray | None = None):
        self.ids = np.unique(np.concatenate([src, dst, *([] if nodes is None else [nodes])]))
        src, dst = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        order = np.argsort(src, kind="stable")
        self.src, self.dst = src[order], dst[order]
        self.first = np.searchsorted(self.src, np.arange(len(self.ids) + 1))

    def after(self, rows: np.ndarray) -> np.ndarray:
        """The successors of some rows, one after another."""
        size = self.first[rows + 1] - self.first[rows]
        return self.dst[np.repeat(self.first[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def reach(self, rows: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """Flags of all rows that some rows reach, themselves included; ``inside``: the rows that count."""
        seen = np.zeros(len(self.ids), bool)
        seen[rows] = True
        while len(rows):
            rows = self.after(rows)
            rows = np.unique(rows[~seen[rows]] if inside is None else rows[~seen[rows] & inside[rows]])
            seen[rows] = True
        return seen

    def reaches(self, seeds: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """For pairs of ids, whether the seed is the node or reaches it: 64 seeds at a time, a bit of each
        row's mask per seed, until no mask grows."""
        hit = seeds == nodes
        if not len(self.src):
            return hit
        order = np.argsort(self.dst, kind="stable")
        src, dst = self.src[order], self.dst[order]
        starts = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
        ends = dst[starts]
        row, at = (np.minimum(np.searchsorted(self.ids, x), len(self.ids) - 1) for x in (seeds, nodes))
        asked = np.flatnonzero(~hit & (self.ids[row] == seeds) & (self.ids[at] == nodes))
        which, number = np.unique(row[asked], return_inverse=True)
        for a in range(0, len(which), 64):
            mask = np.zeros(len(self.ids), np.uint64)
            mask[which[a : a + 64]] = np.uint64(1) << np.arange(len(which[a : a + 64]), dtype=np.uint64)
            while True:
                more = mask[ends] | np.bitwise_or.reduceat(mask[src], starts)
                if (more == mask[ends]).all():
                    break
                mask[ends] = more
            mine = (number >= a) & (number < a + 64)
            hit[asked[mine]] = (mask[at[asked[mine]]] >> (number[mine] - a).astype(np.uint64)) & np.uint64(1) == 1
        return hit


def _arrays(steps: DataFrame, *columns: str) -> tuple[np.ndarray, ...] | None:
    """The columns if they are few enough to broadcast, else None."""
    if steps.count() > BROADCAST_EDGES:
        return None
    table = steps.select(*[F.col(c).cast("bigint") for c in columns]).toArrow()
    return tuple(table[c].to_numpy() for c in columns)


def closure(steps: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): all nodes reached from each seed by one step or more, and the seed itself.  A
    graph of bounded size is broadcast and searched seed by seed where the seeds are; a larger one
    is searched ring by ring, in joins."""
    steps = written(steps.select(F.col("src").alias("from_node"), "dst"))
    seeds = seeds.select(F.col("seed").cast("bigint")).distinct()
    small = _arrays(steps, "from_node", "dst")
    if small is None:
        return _rings(steps, seeds)
    shared = seeds.sparkSession.sparkContext.broadcast(Graph(*small))  # at most BROADCAST_EDGES steps

    def search(batches):
        graph = shared.value
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                row = int(np.searchsorted(graph.ids, seed))
                known = row < len(graph.ids) and graph.ids[row] == seed
                nodes = graph.ids[graph.reach(np.array([row]))] if known else np.array([seed])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), seed)), pa.array(nodes)], ["seed", "node"])

    return seeds.mapInArrow(search, "seed bigint, node bigint")


def _rings(steps: DataFrame, seeds: DataFrame) -> DataFrame:
    rings = [written(seeds.select("seed", F.col("seed").alias("node")).distinct())]
    while True:
        next_nodes = rings[-1].join(steps, F.col("node") == F.col("from_node")).select("seed", F.col("dst").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, rings)
        ring = written(next_nodes.join(known, ["seed", "node"], "left_anti"))
        if ring.isEmpty():
            return known
        # the rings are files; they are put together now and then so that plans stay short
        rings = [written(known), ring] if len(rings) == COMPACT else [*rings, ring]


def reached_pairs(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (seed, node and more) with reached: whether the seed is the node or reaches it.  Nothing
    but the pairs leaves the search: a graph of bounded size is broadcast to them, in a larger one
    the nodes keep a bit per seed."""
    steps = written(steps.select(F.col("src").alias("from_node"), "dst"))
    small = _arrays(steps, "from_node", "dst")
    if small is None:
        return _marked_pairs(steps, pairs)
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(Graph(*small))  # at most BROADCAST_EDGES steps
    seed, node = pairs.columns.index("seed"), pairs.columns.index("node")
    schema = T.StructType([*pairs.schema.fields, T.StructField("reached", T.BooleanType())])

    def look(batches):
        for batch in batches:
            hit = shared.value.reaches(*(batch.column(c).cast(pa.int64()).to_numpy() for c in (seed, node)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], [*batch.schema.names, "reached"])

    return pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seed").mapInArrow(look, schema)


def _marked_pairs(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same ring by ring, in joins of (node, word, bits): 64 seeds are the bits of a word."""
    seeds = global_rank(pairs.select("seed").distinct(), ["seed"], "number")
    seeds = written(seeds.select("seed", F.floor(F.col("number") / 64).alias("word"), F.expr("shiftleft(1L, CAST(number % 64 AS INT))").alias("bits")))
    rings = [written(seeds.select(F.col("seed").alias("node"), "word", "bits"))]
    merged = lambda: reduce(DataFrame.unionByName, rings).groupBy("node", "word").agg(F.bit_or("bits").alias("known"))
    while True:
        sent = rings[-1].join(steps, F.col("node") == F.col("from_node")).groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("bigint"))))
        ring = written(sent.join(merged(), ["node", "word"], "left").select("node", "word", fresh.alias("bits")).where("bits <> 0"))
        if ring.isEmpty():
            break
        rings = [written(merged().withColumnRenamed("known", "bits")), ring] if len(rings) == COMPACT else [*rings, ring]
    found = pairs.join(seeds, "seed").join(merged(), ["node", "word"], "left")
    return found.select(*pairs.columns, (F.coalesce(F.col("bits").bitwiseAND(F.col("known")), F.lit(0)) != 0).alias("reached"))


def reached_in_parts(links: DataFrame, passing: DataFrame, pairs: DataFrame, part: str, gamma: int = 1, m_beta: int = 0) -> DataFrame:
    """pairs (part, seed, node and more) with reached under the rule sem, for a graph (part, src, pos,
    dst) of parts without links between them, each of which fits in a task: the list of a
    neighbour that is opened is a node of its own, so steps are as many as links, not pairs of them."""
    marked = links.join(passing.select(F.col("vec_id").alias("dst"), F.lit(True).alias("ok")), "dst", "left").select(part, "src", "pos", "dst", F.coalesce("ok", F.lit(False)).alias("ok"))
    schema = T.StructType([*pairs.schema.fields, T.StructField("reached", T.BooleanType())])

    def look(asked: pa.Table, lists: pa.Table) -> pa.Table:
        src, pos, dst = (lists[c].to_numpy() for c in ("src", "pos", "dst"))
        ok = lists["ok"].to_numpy().astype(bool)
        ids = np.unique(np.concatenate([src, dst, asked["seed"].to_numpy(), asked["node"].to_numpy()]))
        src, dst, seed, node = (np.searchsorted(ids, x) for x in (src, dst, asked["seed"].to_numpy(), asked["node"].to_numpy()))
        opened = np.ones(len(pos), bool) if gamma == 1 else pos >= m_beta
        graph = Graph(np.concatenate([src[ok], src[opened], src[ok] + len(ids)]), np.concatenate([dst[ok], dst[opened] + len(ids), dst[ok]]))
        return asked.append_column("reached", pa.array(graph.reaches(seed, node)))

    return pairs.groupBy(part).cogroup(marked.groupBy(part)).applyInArrow(look, schema)


def reach_targets(steps: DataFrame, passing: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (query_id, seed, rank, target) with reachable.  A target that is the seed is reached even
    if the seed fails the filter; a target that does not pass is not."""
    ok = passing.select(F.col("vec_id").alias("node"), F.lit(True).alias("ok"))
    asked = targets.select("query_id", "seed", "rank", F.col("target").alias("node")).join(ok, "node", "left")
    hit = (F.col("seed") == F.col("node")) | (F.col("reached") & F.coalesce("ok", F.lit(False)))
    return reached_pairs(steps, asked).select("query_id", "seed", "rank", F.col("node").alias("target"), hit.alias("reachable"))


def target_bits(reached: DataFrame) -> DataFrame:
    """One bit per target, the nearest lowest."""
    bit = F.when(F.col("reachable"), F.expr("shiftleft(1L, CAST(rank AS INT) - 1)")).otherwise(F.lit(0).cast("long"))
    return reached.groupBy("query_id").agg(F.sum(bit).alias("bits"), F.count(F.lit(1)).alias("n_targets"))


def _in_memory(nodes: DataFrame, steps: DataFrame, label) -> DataFrame | None:
    """(node, component) by labels of a graph's rows, or None if the graph is too large for that."""
    steps, nodes = written(steps.select("src", "dst").where("src <> dst")), written(nodes.select("vec_id"))
    edges, ids = _arrays(steps, "src", "dst"), _arrays(nodes, "vec_id")
    if edges is None or ids is None:
        return None
    graph = Graph(*edges, *ids)
    of = label(graph)
    own = np.searchsorted(graph.ids, ids[0])
    return nodes.sparkSession.createDataFrame(pa.table({"node": pa.array(ids[0], pa.int64()), "component": pa.array(graph.ids[of[own]], pa.int64())}))


def _weak(graph: Graph) -> np.ndarray:
    """The smallest row of each row's weak component."""
    of = np.arange(len(graph.ids))
    while True:
        least = of.copy()
        np.minimum.at(least, graph.src, of[graph.dst])
        np.minimum.at(least, graph.dst, of[graph.src])
        least = least[least]
        if (least == of).all():
            return of
        of = least


def _strong(graph: Graph) -> np.ndarray:
    """The largest row of each row's strong component: rows take the colour of the largest row that
    reaches them, and what reaches that row back within its colour is its component."""
    back = Graph(graph.ids[graph.dst], graph.ids[graph.src], graph.ids)
    of, left = np.full(len(graph.ids), -1), np.ones(len(graph.ids), bool)
    while left.any():
        colour = np.where(left, np.arange(len(left)), -1)
        src, dst = graph.src[left[graph.src] & left[graph.dst]], graph.dst[left[graph.src] & left[graph.dst]]
        while True:
            best = colour.copy()
            np.maximum.at(best, dst, colour[src])
            if (best == colour).all():
                break
            colour = best
        same = colour[back.src] == colour[back.dst]
        within = Graph(graph.ids[back.src[same]], graph.ids[back.dst[same]], graph.ids)
        found = within.reach(np.flatnonzero(colour == np.arange(len(colour))), left)
        of[found] = colour[found]
        left &= ~found
    return of


def weak_components(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """(node, component): smallest node of each weakly connected component, by minimum labels that
    jump along the labels they find; in memory if the graph is of bounded size."""
    found = _in_memory(nodes, steps, _weak)
    if found is not None:
        return found
    both = written(steps.select("src", "dst").unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    labels = written(nodes.select(F.col("vec_id").alias("node"), F.col("vec_id").alias("component")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("best"))
        closer = labels.join(seen, F.col("node") == F.col("src"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("best", "component")).alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        jumped = written(closer.join(hop, "label").select("node", F.least("label", "further").alias("component"), "old"))
        if jumped.where("old <> component").isEmpty():
            return labels
        labels = jumped.select("node", "component")


def strong_components(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """(node, component): the largest node of each strongly connected component.  Colours: the largest
    node that reaches a node; what reaches the colour's own node backwards within the colour is a
    component; the rest goes on.  In memory if the graph is of bounded size."""
    found = _in_memory(nodes, steps, _strong)
    if found is not None:
        return found
    left_nodes = written(nodes.select(F.col("vec_id").alias("node")))
    left_steps = written(steps.select("src", "dst").where("src <> dst").distinct())
    done = None
    while not left_nodes.isEmpty():
        colour = written(left_nodes.select("node", F.col("node").alias("colour")))
        while True:
            best = left_steps.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("colour").alias("best"))
            moved = written(colour.join(best, F.col("node") == F.col("dst"), "left").select("node", F.greatest("colour", F.coalesce("best", "colour")).alias("colour"), (F.col("best") > F.col("colour")).alias("changed")))
            colour = moved.select("node", "colour")
            if moved.where("changed").isEmpty():
                break
        c = colour.select(F.col("node").alias("n"), "colour")
        same = left_steps.join(c.withColumnsRenamed({"n": "src", "colour": "c1"}), "src").join(c.withColumnsRenamed({"n": "dst", "colour": "c2"}), "dst").where("c1 = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.select(F.col("colour").alias("seed")).distinct()
        found = closure(same, roots).select("node", F.col("seed").alias("component"))
        found = written(found.join(colour.select("node", F.col("colour").alias("component")), ["node", "component"], "left_semi"))
        done = found if done is None else done.unionByName(found)
        left_nodes = written(left_nodes.join(found, "node", "left_anti"))
        alive = left_nodes.select("node")
        left_steps = written(left_steps.join(alive.withColumnRenamed("node", "src"), "src", "left_semi").join(alive.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return done if done is not None else nodes.select(F.col("vec_id").alias("node"), F.col("vec_id").alias("component"))


def condensation(steps: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct steps between components."""
    a = components.select(F.col("node").alias("src"), F.col("component").alias("a"))
    b = components.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    return steps.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def component_statistics(nodes: DataFrame, steps: DataFrame, strong: DataFrame, weak: DataFrame) -> DataFrame:
    """One row: nodes, edges, number and largest size of both kinds, and the smallest label among the
    largest strong components."""
    sizes = lambda c: c.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    s = sizes(strong).agg(F.count(F.lit(1)).alias("sccs"), F.max("size").alias("largest_scc"), F.min(F.struct((-F.col("size")).alias("less"), "component")).component.alias("largest_member"))
    w = sizes(weak).agg(F.count(F.lit(1)).alias("wccs"), F.max("size").alias("largest_wcc"))
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = steps.agg(F.count(F.lit(1)).alias("edges"))
    return n.join(F.broadcast(e)).join(F.broadcast(s)).join(F.broadcast(w))


def unsound(returned: DataFrame, reached: DataFrame) -> DataFrame:
    """Returned ids (query_id, neighbor_id, seed) that the rules cannot reach: there should be none."""
    return returned.join(reached.select("seed", F.col("node").alias("neighbor_id")), ["seed", "neighbor_id"], "left_anti")


def unreached(returned: DataFrame, steps: DataFrame) -> DataFrame:
    """The same without a table of all that is reached."""
    pairs = returned.select("seed", F.col("neighbor_id").alias("node"), "query_id")
    return reached_pairs(steps, pairs).where(~F.col("reached")).select("seed", F.col("node").alias("neighbor_id"), "query_id")
