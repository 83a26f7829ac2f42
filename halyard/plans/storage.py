"""Registered round trips: what a source reads must be what its sink wrote."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard import schemas
from halyard.operators import conditions, graph_search, nearest
from halyard.plans import catalog, workload
from halyard.plans.registry import query
from halyard.plans.registry import with_parts as _with
from halyard.plans.workload import K
from halyard.session import put_bytes, shared_dir, written
from halyard.sources import tables, vecs


def _in_order(w: workload.Workload) -> DataFrame:
    return w.base.select("vec_id", "embedding").repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id")


_PLACED = "p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, embedding FROM embeddings)"


@query(f"WITH {_PLACED} SELECT vec_id, len(embedding)::INTEGER AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM p")
def fvecs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors through files of 32-bit floats, read in ranges of 64 KB."""
    path = shared_dir(spark)
    vecs.write_vecs(_in_order(workload.load(spark, sf_dir)), path, "fvecs")
    rows = vecs.read_vecs(spark, path, "fvecs", range_bytes=1 << 16)
    return rows.select("vec_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query(f"WITH {_PLACED} SELECT count(*) AS n, max(vec_id) AS last, (SELECT min(len(embedding)) FROM p)::INTEGER AS dim FROM p WHERE vec_id < 150")
def fvecs_row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of rows ends the ranges that are read."""
    path = shared_dir(spark)
    vecs.write_vecs(_in_order(workload.load(spark, sf_dir)), path, "fvecs")
    return vecs.read_vecs(spark, path, "fvecs", 150).agg(F.count(F.lit(1)).alias("n"), F.max("vec_id").alias("last"), F.min(F.size("embedding")).alias("dim"))


@query(_with(catalog._Q, catalog._PAIRS, catalog._ORDERED) + f", n AS (SELECT query_id, place, vec_id FROM o WHERE place <= {K}), q2 AS (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS row FROM q) SELECT row, (place - 1)::INTEGER AS pos, vec_id AS neighbor_id FROM n JOIN q2 USING (query_id)")
def ivecs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours as lists of 32-bit ids, one row for each query."""
    w = workload.load(spark, sf_dir)
    path = shared_dir(spark)
    lists = nearest.nearest(w.base, w.queries, K).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id"))), lambda x: x.neighbor_id.cast("int")).alias("embedding"))
    ordered = lists.select(F.col("query_id").alias("vec_id"), "embedding").repartitionByRange(2, "vec_id").sortWithinPartitions("vec_id")
    vecs.write_vecs(ordered, path, "ivecs")
    rows = vecs.read_vecs(spark, path, "ivecs")
    return rows.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("pos", "neighbor_id")).select("row", "pos", F.col("neighbor_id").cast("bigint").alias("neighbor_id"))


@query("SELECT * FROM (VALUES ('bad header', true), ('not whole', true), ('absent', true), ('good', false)) AS t(file, refused)")
def vecs_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that do not fit together are refused before any row is read."""
    import numpy as np

    folder = shared_dir(spark)
    for name, numbers in (("a", np.array([0, 1], "<i4")), ("b", np.array([2, 1, 1, 2], "<i4")), ("d", vecs.row_bytes(np.ones((2, 3), "<f4"), np.dtype("<f4")))):
        put_bytes(spark, f"{folder}/{name}.fvecs", numbers.tobytes())
    found = []
    for name, file in (("bad header", "a"), ("not whole", "b"), ("absent", "c"), ("good", "d")):
        try:
            vecs.file_shape(f"{folder}/{file}.fvecs", spark)
            found.append((name, False))
        except (ValueError, FileNotFoundError):
            found.append((name, True))
    return spark.createDataFrame(found, "file string, refused boolean")


_NEAREST = _with(catalog._Q, catalog._PAIRS, catalog._ORDERED) + " SELECT query_id, place::INTEGER AS rank, vec_id AS neighbor_id, round(d, 6) AS distance FROM o WHERE place <= {k}"


@query(_NEAREST.format(k=K))
def neighbour_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    path = shared_dir(spark)
    tables.write_neighbours(nearest.nearest(w.base, w.queries, K), path)
    return catalog._rounded(tables.read_neighbours(spark, path, T.StructType(schemas.NEIGHBOURS.fields)), "distance")


@query(_with(catalog._Q, catalog._PAIRS, catalog._ORDERED) + f" SELECT 'all' AS condition_id, count(*) AS n, sum(vec_id)::BIGINT AS ids, true AS refused FROM o WHERE place <= {K} UNION ALL SELECT 'few', count(*), sum(vec_id)::BIGINT, true FROM o WHERE place <= 3")
def ground_truth_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of two conditions in one table: each comes back by its identities and by no others."""
    w = workload.load(spark, sf_dir)
    near, path = written(nearest.nearest(w.base, w.queries, K)), shared_dir(spark)
    tables.write_ground_truth(near, path, "all", "mask-a", "query-a")
    tables.write_ground_truth(near.where("rank <= 3"), path, "few", "mask-b", "query-a")
    out = None
    for condition, mask in (("all", "mask-a"), ("few", "mask-b")):
        try:
            tables.read_ground_truth(spark, path, condition, "mask-c", "query-a")
            refused = False
        except ValueError:
            refused = True
        part = tables.read_ground_truth(spark, path, condition, mask, "query-a").agg(F.lit(condition).alias("condition_id"), F.count(F.lit(1)).alias("n"), F.sum("neighbor_id").alias("ids"), F.lit(refused).alias("refused"))
        out = part if out is None else out.unionByName(part)
    return out


@query(_with(catalog._RANKS) + " SELECT vec_id, rank, label::INTEGER AS cluster, true AS refused FROM r")
def rank_attribute_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rank attribute with its digest, which a wrong expectation refuses."""
    w, path = workload.load(spark, sf_dir), shared_dir(spark)
    ranks = workload.ranked(w).select("vec_id", "rank", F.col("label").cast("int").alias("cluster"))
    digest = tables.write_attribute(written(ranks), path)
    try:
        tables.read_attribute(spark, path, "0" * 16)
        refused = False
    except ValueError:
        refused = True
    return tables.read_attribute(spark, path, digest).select("vec_id", "rank", "cluster", F.lit(refused).alias("refused"))


_SWEEP_SCHEMA = T.StructType([T.StructField("condition", T.StringType()), T.StructField("method", T.StringType()), T.StructField("budget", T.IntegerType()), T.StructField("query_id", T.LongType()), T.StructField("recall", T.DoubleType()), T.StructField("dist_exact", T.LongType())])


def _csv(spark: SparkSession, sf_dir: str, gzip: bool) -> str:
    path = shared_dir(spark)
    s = workload.sweep(spark, workload.load(spark, sf_dir)).select(*_SWEEP_SCHEMA.names)
    tables.write_csv(s.where("method = 'pre'"), f"{path}/part=pre", gzip)
    tables.write_csv(s.where("method <> 'pre'"), f"{path}/part=other", gzip)
    return path


@query(_with(*catalog._SWEEP) + " SELECT condition, method, budget, query_id, round(recall, 6) AS recall, dist_exact FROM sweep")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep as text in two folders, read by one pattern."""
    return catalog._rounded(tables.read_partitioned_csv(spark, f"{_csv(spark, sf_dir, False)}/part=*", _SWEEP_SCHEMA), "recall")


@query(_with(*catalog._SWEEP) + " SELECT condition, query_id, dist_exact FROM sweep WHERE method = 'post' AND budget = 40")
def gzip_csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some columns of some rows of compressed text."""
    rows = tables.read_partitioned_csv(spark, f"{_csv(spark, sf_dir, True)}/part=*", _SWEEP_SCHEMA)
    return rows.where("method = 'post' AND budget = 40").select("condition", "query_id", "dist_exact")


@query("SELECT * FROM (VALUES ('a', 1::BIGINT, 0.5::DOUBLE), ('b', 2, NULL), ('c', 3, NULL)) AS t(stage, n, score)")
def json_records_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records, where numbers that JSON lacks become null, read by one pattern."""
    folder = shared_dir(spark)
    for stage, n, score in (("a", 1, 0.5), ("b", 2, float("nan")), ("c", 3, float("inf"))):
        tables.write_run_record(f"{folder}/{stage}.json", {"stage": stage, "n": n, "score": score}, spark)
    return tables.read_json_records(spark, f"{folder}/*.json", T.StructType([T.StructField("stage", T.StringType()), T.StructField("n", T.LongType()), T.StructField("score", T.DoubleType())]))


_CONDITION = T.StructType([T.StructField("condition", T.StringType()), T.StructField("correlation", T.StringType()), T.StructField("level", T.StringType()), T.StructField("realization", T.StringType()), T.StructField("s_requested", T.DoubleType()), T.StructField("threshold", T.LongType())])


@query("SELECT 'kept_' || level || '_' || realization AS condition, 'clustered' AS correlation, level, realization, s AS s_requested, 100::BIGINT AS threshold FROM (VALUES ('c10'), ('c50')) AS a(level), (VALUES ('r0')) AS b(realization), (VALUES (0.1::DOUBLE)) AS c(s)")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of conditions written, read, narrowed and renamed."""
    folder = shared_dir(spark)
    rows = [(f"{level}_{r}_{s}", "clustered", level, r, s, 100) for level in ("c10", "c50", "c99") for r in ("r0", "r1") for s in (0.1, 1.0)]
    tables.write_manifest(f"{folder}/m.yaml", {"dataset": "embeddings"}, spark.createDataFrame(rows, _CONDITION), spark)
    read = tables.manifest_conditions(spark, tables.read_manifest(f"{folder}/m.yaml", spark), _CONDITION)
    return tables.select_manifest(read, levels=["c10", "c50"], realizations=["r0"], selectivities=[0.1], renames={f"{level}_r0_0.1": f"kept_{level}_r0" for level in ("c10", "c50")})


@query(_NEAREST.format(k=5).replace("SELECT query_id, place::INTEGER AS rank, vec_id AS neighbor_id, round(d, 6) AS distance", "SELECT count(*) AS n, sum(vec_id)::BIGINT AS ids, 1 AS computed"))
def cached_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is asked for twice and computed once."""
    w, folder, calls = workload.load(spark, sf_dir), shared_dir(spark), []

    def compute() -> DataFrame:
        calls.append(1)
        return nearest.nearest(w.base, w.queries, 5)

    tables.cached(spark, folder, "near", "k5", compute)
    return tables.cached(spark, folder, "near", "k5", compute).agg(F.count(F.lit(1)).alias("n"), F.sum("neighbor_id").alias("ids"), F.lit(len(calls)).alias("computed"))


@query("SELECT kind, n AS nodes, true AS same, true AS refused FROM (SELECT count(*) AS n FROM embeddings), (VALUES ('hnsw'), ('acorn')) AS k(kind)")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of graph saved and loaded; another parameter refuses them; all rows have level-0 links."""
    w = workload.load(spark, sf_dir)
    out = []
    for kind, more in (("hnsw", {"m": 8, "ef": 20}), ("acorn", {"m": 8, "gamma": 2, "m_beta": 8})):
        index, path = written(graph_search.build_index(w.base, kind, **more)), shared_dir(spark)
        graph_search.save_index(index, path, {"kind": kind, **more}, w.n)
        try:
            graph_search.load_index(spark, path, {"kind": kind, **more, "m": 9}, w.n)
            refused = False
        except ValueError:
            refused = True
        read = graph_search.load_index(spark, path, {"kind": kind, **more}, w.n)
        same = tables.content_digest(read) == tables.content_digest(index)
        out.append((kind, graph_search.level0_edges(read).select("src").distinct().count(), same, refused))
    return spark.createDataFrame(out, "kind string, nodes bigint, same boolean, refused boolean")


@query("SELECT sha256('some bytes ' || repeat('x', 100000)) AS whole, sha256('some bytes ') = sha256('other') AS same")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a file read in chunks, and of two files that differ."""
    folder = shared_dir(spark)
    for name, text in (("a", "some bytes " + "x" * 100_000), ("b", "some bytes "), ("c", "other")):
        put_bytes(spark, f"{folder}/{name}", text.encode())
    whole, b, c = (tables.file_digest(f"{folder}/{name}", chunk=4096, spark=spark) for name in "abc")
    return spark.createDataFrame([(whole, b == c)], "whole string, same boolean")


@query("SELECT '| r_regionkey | r_name |' AS line, 0::BIGINT AS at UNION ALL SELECT '| - | - |', 1 UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |', row_number() OVER (ORDER BY r_regionkey) + 1 FROM region")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.session import read_table

    text = tables.markdown(read_table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.createDataFrame([(line, at) for at, line in enumerate(text.split("\n"))], "line string, at bigint")


@query("SELECT true AS same_rows, false AS changed_row, false AS missing_row FROM (SELECT 1)")
def content_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a table does not depend on order or partitions and does on every row."""
    base = workload.load(spark, sf_dir).base.select("vec_id", "embedding", "label")
    digest = tables.content_digest(base)
    shuffled = tables.content_digest(base.orderBy(F.desc("label"), "vec_id").repartition(7))
    changed = tables.content_digest(base.withColumn("label", F.when(F.col("vec_id") == 17, F.col("label") + 1).otherwise(F.col("label"))))
    fewer = tables.content_digest(base.where("vec_id <> 17"))
    return spark.createDataFrame([(digest == shuffled, digest == changed, digest == fewer)], "same_rows boolean, changed_row boolean, missing_row boolean")


@query("SELECT 'UTC' AS zone, true AS stamped, true AS versions, md5('x') AS digest")
def run_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run record starts with, through its JSON file."""
    import hashlib
    import re

    folder = shared_dir(spark)
    tables.write_run_record(f"{folder}/run.json", tables.run_header(spark, "search", digest=hashlib.md5(b"x").hexdigest()), spark)
    record = json.loads(tables.read_text(f"{folder}/run.json", spark))
    return spark.createDataFrame([("UTC" if record["run_id"].endswith("Z") else "", bool(re.fullmatch(r"\d{8}T\d{6}Z", record["run_id"])), {"spark", "python", "machine", "cores"} <= set(record), record["digest"])], "zone string, stamped boolean, versions boolean, digest string")


# ---- generators

#: splitmix64 of (x xor seed), in numbers of 128 bits.
_SPLITMIX = """h0 AS (SELECT query_id, (xor(query_id::UHUGEINT, 7::UHUGEINT) + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM q),
h1 AS (SELECT query_id, (xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM h0),
h2 AS (SELECT query_id, (xor(z, z >> 27) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM h1),
h3 AS (SELECT query_id, xor(z, z >> 31) AS z FROM h2)"""


@query(_with(catalog._Q, _SPLITMIX) + " SELECT query_id, round(z::DOUBLE / 18446744073709551616::DOUBLE, 9) AS u FROM h3")
def unit_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = workload.load(spark, sf_dir).queries
    return queries.select("query_id", F.round(conditions.unit_column("query_id", 7), 9).alias("u"))


#: The same for every row, by the seed that indexes use.
_ROW_HASH = _SPLITMIX.replace("query_id", "vec_id").replace("7::UHUGEINT", "42::UHUGEINT").replace("FROM q)", "FROM embeddings)")


@query(_with(_ROW_HASH) + """, lv AS (SELECT vec_id, floor(-ln(greatest(z::DOUBLE / 18446744073709551616::DOUBLE, 1e-18)) / ln(8::DOUBLE)) AS top FROM h3)
SELECT level::INTEGER AS level, count(*) AS nodes FROM lv, generate_series(0, 20) AS g(level) WHERE top >= level GROUP BY level HAVING count(*) > 1""")
def index_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows stand on each level of a graph; a row alone on its level has no links there."""
    index = graph_search.build_index(workload.load(spark, sf_dir).base, "acorn", m=8, gamma=2, m_beta=8)
    return graph_search.index_statistics(index).select("level", "nodes")


@query(_with(catalog._Q) + f" SELECT query_id, row_number() OVER (ORDER BY md5('{workload.SEED}:' || query_id), query_id) <= 7 AS is_train, ((row_number() OVER (ORDER BY md5('{workload.SEED}:' || query_id), query_id) - 1) % 3)::INTEGER AS fold FROM q")
def query_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.split_queries(workload.load(spark, sf_dir).queries.select("query_id"), workload.SEED, 7, 3)


@query(_with(catalog._Q) + f" SELECT 'first' AS subset, query_id FROM q WHERE query_id < 200 UNION ALL SELECT 'sample', query_id FROM (SELECT query_id FROM q ORDER BY md5('5:' || query_id), query_id LIMIT 6) UNION ALL SELECT 'all', query_id FROM q")
def query_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = workload.load(spark, sf_dir).queries.select("query_id")
    named = lambda name, df: df.select(F.lit(name).alias("subset"), "query_id")
    return named("first", conditions.query_subset(queries, first=200)).unionByName(named("sample", conditions.query_subset(queries, sample=6, seed=5))).unionByName(named("all", conditions.query_subset(queries)))


@query(_with(catalog._N) + """ SELECT level, k::INTEGER AS num_clusters, r::INTEGER AS realization, (1000 * i + r)::BIGINT AS seed, s::DOUBLE AS s_requested, least(floor(s * n + 0.5), n)::BIGINT AS threshold, level || '_r' || r || '_s' || printf('%.4f', s::DOUBLE) AS condition
FROM n, (VALUES ('coarse', 10, 1), ('fine', 100, 2)) AS l(level, k, i), generate_series(0, 2) AS g(r), (VALUES (0.05), (0.2), (1.0)) AS x(s)""")
def fragmentation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.fragmentation_grid(spark, {"coarse": 10, "fine": 100}, 3, [0.05, 0.2, 1.0], workload.load(spark, sf_dir).n)


@query("SELECT 1::BIGINT AS several_clusterings, 1::BIGINT AS repeated_attributes, 6::BIGINT AS without_attribute")
def fragmentation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid with one level clustered twice, one attribute used twice and two realizations missing."""
    grid = conditions.fragmentation_grid(spark, {"coarse": 10, "fine": 100}, 3, [0.05, 0.2, 1.0], workload.load(spark, sf_dir).n)
    attributes = spark.createDataFrame([("coarse", 0, "c", "a0"), ("coarse", 1, "c", "a1"), ("coarse", 2, "c", "a1"), ("fine", 0, "d", "b0"), ("fine", 7, "e", "b1")], "level string, realization int, cluster_hash string, attribute_hash string")
    return conditions.grid_problems(grid, attributes)


@query("SELECT draw::INTEGER AS draw, vec_id FROM embeddings, generate_series(1, 5) AS g(draw) WHERE ('0x' || substr(md5('3:' || draw || ':' || vec_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.1")
def null_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.null_draws(workload.load(spark, sf_dir).base.select("vec_id"), 5, 0.1, 3)


@query("SELECT DISTINCT b::INTEGER AS budget FROM (SELECT * FROM generate_series(10, 50, 10) AS a(b) UNION ALL SELECT * FROM generate_series(50, 250, 50) AS c(b))")
def budget_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(b,) for b in conditions.budget_grid((10, 50, 10), (50, 250, 50))], "budget int")


@query("SELECT condition, budget::INTEGER AS budget, row_number() OVER (ORDER BY md5('9:' || condition || ':' || budget), condition, budget) - 1 AS place FROM (VALUES ('a'), ('b'), ('c')) AS c(condition), (VALUES (10), (20), (40)) AS b(budget)")
def block_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a sweep in a seeded order that any engine can repeat."""
    blocks = spark.createDataFrame([(c, b) for c in "abc" for b in (10, 20, 40)], "condition string, budget int")
    return conditions.block_order(blocks, ["condition", "budget"], 9)


@query("SELECT count(*) AS n, min(rank) AS least, max(rank) AS most, count(DISTINCT rank) AS different FROM (SELECT row_number() OVER () - 1 AS rank FROM embeddings)")
def seeded_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The permutation of the seeded twister takes every rank once."""
    ranks = conditions.permutation_ranks(spark, workload.load(spark, sf_dir).n, workload.SEED)
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("least"), F.max("rank").alias("most"), F.count_distinct("rank").alias("different"))


@query("SELECT count(*) AS n, 3 AS least, 9 AS most, 0::BIGINT AS outside FROM embeddings")
def uniform_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbiased bounded draws: whole range, nothing outside."""
    drawn = conditions.uniform_attribute(spark, workload.load(spark, sf_dir).n, 3, 9, 11)
    return drawn.agg(F.count(F.lit(1)).alias("n"), F.min("attr").alias("least"), F.max("attr").alias("most"), F.sum(F.when(F.col("attr").between(3, 9), 0).otherwise(1)).alias("outside"))
