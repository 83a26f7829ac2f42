import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard import schemas
from halyard.operators.conditions import conditions, random_ranks
from halyard.sources import tables, vecs


@pytest.mark.parametrize(("kind", "dtype"), [("fvecs", "<f4"), ("ivecs", "<i4")])
def test_vector_files(spark, tmp_path, kind, dtype):
    rows = np.arange(700, dtype=dtype).reshape(100, 7)
    path = f"{tmp_path}/x.{kind}"
    vecs.write_rows(path, rows, vecs.NUMBERS[kind])
    df = vecs.read_vecs(spark, path, kind)
    got = sorted(map(tuple, df.collect()))
    assert [i for i, _ in got] == list(range(100)) and all(list(v) == r.tolist() for (_, v), r in zip(got, rows))
    assert vecs.read_vecs(spark, path, kind, max_rows=30).count() == 30
    vecs.register(spark)
    assert spark.read.format(kind).option("range_bytes", 64).load(path).rdd.getNumPartitions() > 5
    vecs.write_vecs(df.orderBy("vec_id").coalesce(1), f"{tmp_path}/out", kind)
    again = vecs.read_vecs(spark, f"{tmp_path}/out", kind)
    assert sorted(map(tuple, again.collect())) == got


def test_bad_vector_files(tmp_path):
    path = tmp_path / "x.fvecs"
    with pytest.raises(FileNotFoundError):
        vecs.file_shape(str(path))
    path.write_bytes(np.array([-1], "<i4").tobytes())
    with pytest.raises(ValueError, match="header"):
        vecs.file_shape(str(path))
    path.write_bytes(np.array([2, 0, 0, 2, 0], "<i4").tobytes())
    with pytest.raises(ValueError, match="whole number"):
        vecs.file_shape(str(path))
    path.write_bytes(np.array([2, 0, 0, 3, 0, 0], "<i4").tobytes())
    with pytest.raises(ValueError, match="differ in dimension"):
        vecs.read_rows(str(path), 0, 2, 2, np.dtype("<f4"))


def test_digest_ignores_order_but_not_content(spark):
    a = spark.range(100).withColumn("x", F.col("id") * 2)
    assert tables.content_digest(a) == tables.content_digest(a.orderBy(F.desc("id")).repartition(7))
    assert tables.content_digest(a) != tables.content_digest(a.where("id <> 5"))
    assert tables.content_digest(a) != tables.content_digest(a.withColumn("x", F.when(F.col("id") == 5, 0).otherwise(F.col("x"))))


def test_ground_truth_is_refused_with_another_identity(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 5, 0.5)], schemas.NEIGHBOURS)
    tables.write_ground_truth(rows, f"{tmp_path}/gt", "c1", "m1", "q1")
    assert tables.read_ground_truth(spark, f"{tmp_path}/gt", "c1", "m1", "q1").count() == 1
    for identity in (("c2", "m1", "q1"), ("c1", "m2", "q1"), ("c1", "m1", "q2")):
        with pytest.raises(ValueError):
            tables.read_ground_truth(spark, f"{tmp_path}/gt", *identity)


def test_attribute_round_trip_and_corruption(spark, tmp_path):
    ranks = random_ranks(spark.range(50).withColumnRenamed("id", "vec_id"), 3).withColumn("cluster", F.lit(0))
    digest = tables.write_attribute(ranks, f"{tmp_path}/a")
    assert tables.read_attribute(spark, f"{tmp_path}/a", digest).count() == 50
    with pytest.raises(ValueError):
        tables.read_attribute(spark, f"{tmp_path}/a", "0" * 16)
    spark.read.parquet(f"{tmp_path}/a").withColumn("rank", F.col("rank") + 1).write.parquet(f"{tmp_path}/b")
    with pytest.raises(ValueError):
        tables.read_attribute(spark, f"{tmp_path}/b")


def test_cached_csv_json_manifest(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    assert tables.cached(spark, f"file://{tmp_path}", "t", "k", make).count() == 3
    assert tables.cached(spark, f"file://{tmp_path}", "t", "k", make).count() == 3 and len(calls) == 1
    tables.write_csv(spark.createDataFrame([(1, 0.5)], "a int, b double"), f"{tmp_path}/csv", gzip=True)
    schema = spark.createDataFrame([], "a int, b double").schema
    assert [tuple(r) for r in tables.read_partitioned_csv(spark, f"{tmp_path}/csv", schema).collect()] == [(1, 0.5)]
    tables.write_run_record(f"{tmp_path}/run.json", {"b": 1, "a": float("inf")})
    assert tables.read_json_records(spark, f"{tmp_path}/run.json").first().b == 1
    grid = conditions(spark, 100, [0.1, 1.0], ["random"])
    tables.write_manifest(f"{tmp_path}/m.yaml", {"base_hash": "x"}, grid)
    manifest = tables.read_manifest(f"{tmp_path}/m.yaml")
    again = tables.manifest_conditions(spark, manifest, grid.schema)
    assert manifest["base_hash"] == "x" and sorted(map(tuple, again.collect())) == sorted(map(tuple, grid.collect()))
    kept = tables.select_manifest(again, selectivities=[0.1], renames={"random_s0.1000": "new"}).collect()
    assert [r.condition for r in kept] == ["new"]


def test_neighbour_tables(spark, tmp_path):
    tables.write_neighbours(spark.createDataFrame([(1, 1, 5, 0.5)], schemas.NEIGHBOURS), f"{tmp_path}/n")
    assert tables.read_neighbours(spark, f"{tmp_path}/n").count() == 1


def test_run_record_pieces(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    assert tables.file_digest(str(tmp_path / "f"), 2) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert tables.run_header(spark, "sweep", k=10)["k"] == 10
    assert tables.markdown(spark.createDataFrame([(1, "a")], "x int, y string")).splitlines()[2] == "| 1 | a |"
