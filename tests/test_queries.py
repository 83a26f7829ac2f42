"""Every registered query with SQL against DuckDB, on whole tables; the others for rows."""

import os

import pytest

import __spark_entry__ as entry_points
from halyard.operators import graph_search
from halyard.plans import analysis, catalog, storage

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if isinstance(x, float):
        return "nan" if x != x else round(x, 6) + 0.0
    return x


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("test tables are absent")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = entry_points.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    if name in catalog.ORACLE:
        found = duck.sql(catalog.ORACLE[name])
        columns = sorted(found.columns)
        assert columns == sorted(df.columns)
        place = [found.columns.index(c) for c in columns]
        assert sorted(repr([_cell(r[c]) for c in columns]) for r in rows) == sorted(repr([_cell(r[i]) for i in place]) for r in found.fetchall())


ROUND_TRIPS = "file_digests fvecs_round_trip fvecs_row_limit json_records_round_trip manifest_round_trip vecs_validation run_provenance ivecs_round_trip".split()


@pytest.mark.parametrize("name", ROUND_TRIPS)
def test_round_trips_without_a_mounted_folder(spark, sf_dir, duck, tmp_path, monkeypatch, name):
    """The shared folder is one that only Spark's file systems can open."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelf.link./shared", f"file://{tmp_path}")
    monkeypatch.setattr(storage, "shared_dir", lambda _: f"viewfs://shelf/shared/{name}")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://other:7077")
    test_query(spark, sf_dir, duck, name)


@pytest.mark.parametrize("name", ["acorn_seeds", "accounting_check", "scan_integrity_check"])
def test_queries_over_several_shards(spark, sf_dir, duck, monkeypatch, name):
    """Each shard's graph is searched from a seed of its own, whose distance is not in the native count."""
    whole = graph_search._shards
    monkeypatch.setattr(graph_search, "_shards", lambda base, _: whole(base, 200))
    test_query(spark, sf_dir, duck, name)


def test_entry(spark, sf_dir):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_pushdown_and_pruning(spark, sf_dir):
    from halyard.session import read_table

    plan = read_table(spark, sf_dir, "embeddings").where("label = 3").select("label")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan and "ReadSchema: struct<label:int>" in plan


def test_wilcoxon_small_leaves_large_groups_out(spark, sf_dir, monkeypatch):
    """The SQL knows only groups for which the exact test is defined."""
    rows = [(i, label, float(i + 1)) for label, n in ((1, 50), (2, 51)) for i in range(0, 40 * n, 40)]
    monkeypatch.setattr(analysis, "_numbers", lambda *_: spark.createDataFrame(rows, "vec_id long, label int, d double"))
    assert [(r.label, r.n) for r in entry_points.queries()["wilcoxon_small"](spark, sf_dir).collect()] == [(1, 50)]
