import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from halyard.functions import random as draws
from halyard.functions import scalars, special, vectors
from halyard.operators import nearest


def test_pinned_draw():
    assert draws.uniform_ints(8, 1, 12, 20261003) == [12, 8, 6, 7, 1, 7, 7, 6]
    assert draws.uniform_ints(100, 0, 9, 5) == draws.uniform_ints(1000, 0, 9, 5)[:100]
    assert set(draws.uniform_ints(20, 5, 5, 1)) == {5}
    with pytest.raises(ValueError):
        draws.uniform_ints(1, 2, 1, 0)


def test_permutation_is_one():
    p = draws.seeded_permutation(200, 7)
    assert sorted(p) == list(range(200)) and p != list(range(200)) and p == draws.seeded_permutation(200, 7)


def test_hashes():
    assert draws.hex64(draws.fnv1a(b"")) == f"{draws.FNV_BASIS:016x}"
    assert draws.fnv1a(b"ab") == draws.fnv1a(b"b", draws.fnv1a(b"a"))
    u = draws.unit_hash(np.arange(10_000), 3)
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02


def test_special_functions():
    assert special.binomial_two_sided(0, 0) == 1 and abs(special.binomial_two_sided(0, 5) - 2 / 32) < 1e-12
    assert abs(special.chi_square_tail(5.991464547, 2) - 0.05) < 1e-9
    assert abs(special.student_quantile(0.975, 4) - 2.776445105) < 1e-8
    assert abs(special.normal_tail(1.959963985) - 0.025) < 1e-9
    assert abs(special.student_cdf(1.0, 1) - 0.75) < 1e-12


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def _array(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_distances(spark):
    assert _one(spark, vectors.squared_l2(_array(1, 2, 3, 4, 5), _array(0, 2, 5, 1, 5))) == 14
    assert _one(spark, vectors.l2(_array(3, 0), _array(0, 4))) == 5
    a, b = np.random.default_rng(0).standard_normal((2, 5, 7))
    assert np.allclose(vectors.distances_between(a, b), ((a[:, None] - b[None]) ** 2).sum(2))


def test_score_concentration(spark):
    assert _one(spark, vectors.score_concentration(_array(1, 2, 4, 8), 4)) == 1 / 8
    assert _one(spark, vectors.score_concentration(_array(1, 2, 4, 8), 2)) == 1 / 2
    assert _one(spark, vectors.score_concentration(_array(0, 0), 2)) == 1


def test_local_intrinsic_dimension(spark):
    assert abs(_one(spark, vectors.local_intrinsic_dimension(_array(1, 2, 4), 3)) - 2 / math.log(8)) < 1e-12
    assert _one(spark, vectors.local_intrinsic_dimension(_array(0, 2, 4), 3)) == 0
    assert _one(spark, vectors.local_intrinsic_dimension(_array(2, 2, 2), 3)) == math.inf
    with pytest.raises(ValueError):
        vectors.local_intrinsic_dimension(_array(1), 1)


def test_centroid(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([2.0, 4.0],), ([4.0, 8.0],)], "v array<double>")
    assert vectors.centroid(df, "v").first()[0] == [2.0, 4.0]
    assert vectors.check_dimension(df, "v", 2) == 2
    with pytest.raises(ValueError):
        vectors.check_dimension(df.unionByName(spark.createDataFrame([([1.0],)], "v array<double>")), "v")


def test_log2_ratio(spark):
    inf = math.inf
    rows = spark.createDataFrame([(4.0, 1.0), (inf, inf), (2.0, inf), (inf, 8.0)], "a double, b double")
    assert [r[0] for r in rows.select(scalars.log2_ratio(F.col("a"), F.col("b"))).collect()] == [2, 0, -inf, inf]


def test_scalars(spark):
    assert _one(spark, scalars.target_bits(F.lit(0b101), 3)) == [True, False, True]
    assert _one(spark, scalars.condition_name(F.lit("random"), F.lit(0.1))) == "random_s0.1000"
    assert _one(spark, scalars.guarded_ratio(F.lit(1.0), F.lit(0.0))) is None
    assert _one(spark, scalars.hex64(F.lit(255))) == "00000000000000ff"
    assert _one(spark, scalars.at_least(F.lit(0.9 - 1e-13), 0.9)) and _one(spark, scalars.close(F.lit(1.0), F.lit(1.000001)))


def test_close_pairs_are_those_of_all_distances(monkeypatch):
    """Ties, equal vectors far from the origin, bounds, and rows that do not count."""
    draw = np.random.default_rng(5)
    base = draw.integers(0, 3, (300, 6)).astype(float) + 1e4
    queries = np.concatenate([base[:40], draw.normal(size=(20, 6)), np.full((1, 6), np.nan)])
    apart = draw.random((len(queries), len(base))) < 0.2
    bound = np.where(np.arange(len(queries)) % 2, np.inf, 3.0)
    plain = vectors.distances_between(queries, base)
    row, col, d = vectors.close_pairs(queries, base, bound, 7, apart)
    assert (d == plain[row, col]).all() and not apart[row, col].any() and (d <= bound[row]).all()
    plain[apart] = np.inf
    for i in range(len(queries)):
        expected = [(x, j) for x, j in sorted((x, j) for j, x in enumerate(plain[i])) if x <= bound[i] and x < np.inf][:7]
        assert sorted(zip(d[row == i], col[row == i]))[:7] == expected
    done = 0

    def counted(*a):
        nonlocal done
        done += 1
        return plain

    monkeypatch.setattr(nearest, "distances_between", counted)
    table = pa.table({"vec_id": pa.array(np.arange(300)), "embedding": pa.array(base.tolist()), "wanted": pa.array(np.full(300, np.inf))})
    assert nearest._pairs(4)(table, table).num_rows == 1200 and done == 0  # no matrix of all exact distances
