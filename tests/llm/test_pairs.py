"""Substring dedup and the Jaccard join against brute force."""

import random

import numpy as np
import pytest
from brute import jaccard, substring_dedup, table
from conftest import AWKWARD
from pyspark.sql import functions as F

from halyard.llm import components, jaccard_join, substring_dedup as op2
from halyard.llm.queries import op2_substring_dedup, op3_jaccard_join


def _rows(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_op2_awkward(awkward):
    got = op2.remove_repeated_windows(awkward, digest=True).collect()
    assert table(got) == table(substring_dedup(AWKWARD))


def test_op2_returns_texts(spark):
    rows = [(1, "a b c d e"), (2, "x a b c d y"), (3, "a b c")]
    got = op2.remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), k=3, m=2).collect()
    assert {r.id: (r.n_removed, r.kept) for r in got} == {1: (0, "a b c d e"), 2: (4, "x y"), 3: (3, "")}


def test_op2_empty(nothing):
    assert op2.remove_repeated_windows(nothing).count() == 0


def test_op2_colliding_hashes_are_told_apart(spark, monkeypatch):
    import pyarrow as pa

    docs = pa.table({"id": pa.array([1, 2], pa.int64()), "text": ["a b c d", "a b x d"]})
    chunk = op2._Chunk(docs, 3, 1, 1)
    (bucket, blob), = chunk.blobs()
    monkeypatch.setattr(op2, "range_hash", lambda v, a, b: np.zeros(len(a), np.uint64))
    answer = op2._answer(3)(pa.table({"bucket": pa.array([bucket], pa.int32()), "chunk": pa.array([0], pa.int32()), "blob": pa.array([blob], pa.binary())}))
    assert answer.num_rows == 0  # no window repeats, whatever the hashes say


def test_op2_query(spark, sf_dir):
    got = op2_substring_dedup(spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert table(got) == table(substring_dedup(_rows(spark, sf_dir)))


def test_op3_awkward(awkward):
    got = jaccard_join.jaccard_components(awkward).select("id", "n_shingles", "component_id").collect()
    assert table(got) == table(jaccard(AWKWARD))


def test_op3_empty(nothing):
    assert jaccard_join.jaccard_components(nothing).count() == 0


def _near_copies():
    draw, rows = random.Random(5), []
    for g in range(4):
        text = [f"g{g}w{draw.randrange(900)}" for _ in range(120)]
        for c in range(25):
            copy = list(text)
            for _ in range(draw.randrange(6)):
                copy[draw.randrange(len(copy))] = f"new{draw.randrange(10**6)}"
            rows.append((g * 100 + c, " ".join(copy)))
    common = " ".join(f"boiler{i}" for i in range(30))
    rows += [(1000 + i, common + " " + " ".join(f"own{i}_{j}" for j in range(draw.randrange(5, 60)))) for i in range(40)]
    return rows


@pytest.mark.parametrize("region_bytes", [jaccard_join.REGION_BYTES, 20_000])
def test_op3_near_copies_whole_and_split(spark, region_bytes):
    """Small regions force pivots, windows and blocks over the cluster."""
    rows = _near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs, region_bytes=region_bytes).select("id", "n_shingles", "component_id").collect()
    assert table(got) == table(jaccard(rows))


def test_op3_split_more_than_once(spark):
    """A region whose members drift apart is still too large after a first split over the cluster."""
    draw = random.Random(11)
    text, rows = [f"w{draw.randrange(10**6)}" for _ in range(120)], []
    for i in range(40):
        text[draw.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs, region_bytes=8_000).select("id", "n_shingles", "component_id").collect()
    assert table(got) == table(jaccard(rows))


def test_op3_region_join_by_cells(monkeypatch):
    """In memory: cells of a large region find the components of all pairs."""
    draw = random.Random(7)
    base = list(range(200))
    sets = []
    for _ in range(160):
        start = draw.choice([0, 60, 120]) + draw.randrange(8)
        sets.append(np.array(sorted(set(range(start, start + 60)) - set(draw.sample(base, 3))), np.uint64))
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    region = jaccard_join._Region(sets, 85)
    region.join(np.arange(len(sets)))
    plain = jaccard_join._Forest(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            i = len(np.intersect1d(sets[a], sets[b]))
            if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
                plain.join(a, b)
    assert [region.forest.root(x) for x in range(160)] == [plain.root(x) for x in range(160)]


def test_op3_forms_cells_on_the_tables(spark, sf_dir):
    done = jaccard_join.region_counters(spark.read.parquet(f"{sf_dir}/documents.parquet")).first()
    assert done.cells >= done.regions > 0 and done.members > done.regions


def test_op3_copies_only_where_distances_allow():
    """Members that no pivot reaches are in one cell, and near copies of a pivot in one too."""
    d = np.ones((16, 100))
    assert [len(c) for c in jaccard_join.voronoi_cells(d, 0.15)] == [100]
    d[3, :40] = 0.1
    cells = jaccard_join.voronoi_cells(d, 0.15)
    assert sorted(map(len, cells)) == [40, 60] and sum(map(len, cells)) == 100


@pytest.mark.parametrize("percent", [50, 85])
def test_op3_class_counts_never_rule_out_a_link(percent):
    draw = random.Random(2)
    for _ in range(300):
        x = set(draw.sample(range(400), draw.randrange(5, 120)))
        y = (x - set(draw.sample(sorted(x), draw.randrange(len(x) // 3 + 1)))) | set(draw.sample(range(400), draw.randrange(20)))
        n = np.array([len(x), len(y)])
        classes = np.stack([np.bincount([v % jaccard_join.CLASSES for v in s], minlength=jaccard_join.CLASSES) for s in (x, y)]).astype(np.uint16)
        if 100 * len(x & y) >= percent * len(x | y):
            assert jaccard_join.may_link(n, classes, 0, np.array([1]), percent).all()


def test_op3_texts_of_common_passages_stay_apart(spark):
    """Each text is two of twelve passages, so all share rare shingles with many others and none links:
    class counts keep them out of common regions."""
    draw = random.Random(4)
    passages = [" ".join(f"p{i}w{draw.randrange(10**6)}" for _ in range(20)) for i in range(12)]
    rows = [(12 * i + j, passages[i] + " " + passages[j]) for i in range(12) for j in range(i)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert jaccard_join.region_counters(docs).first().members < len(rows) // 4
    got = jaccard_join.jaccard_components(docs).select("id", "n_shingles", "component_id").collect()
    assert table(got) == table(jaccard(rows))


def test_op3_query(spark, sf_dir):
    got = op3_jaccard_join(spark, sf_dir).collect()
    assert table(got) == table(jaccard(_rows(spark, sf_dir)))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert got.where("component not in (0, 100)").count() == 0
    assert got.where("component = 0").count() == 21 and got.where("component = 100").count() == 40
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert got.agg(F.count_distinct("node")).first()[0] == 61
