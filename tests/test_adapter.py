"""Adapters trained on pairs: gradients, falling loss, repeatable fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import adapter as A
from corpusloom.operators import pairs as P


@pytest.fixture(scope="module")
def pairs(spark):
    """Two of six dimensions tell the class, the others are louder noise."""
    r = np.random.default_rng(7)
    codes = r.integers(0, 2, 160)
    x = np.hstack([np.eye(2)[codes] + r.normal(0, 0.2, (160, 2)), r.normal(0, 1.0, (160, 4))])
    ends = r.integers(0, 160, (900, 2))
    rows = [(k, int(codes[i] == codes[j]), x[i].tolist(), x[j].tolist()) for k, (i, j) in enumerate(ends.tolist())]
    return spark.createDataFrame(rows, "pair long, target int, u array<double>, v array<double>").repartition(5).cache()


def test_gradient_matches_finite_differences():
    r = np.random.default_rng(1)
    u, v, target, matrix = r.normal(0, 1, (20, 4)), r.normal(0, 1, (20, 4)), r.integers(0, 2, 20).astype(float), r.normal(0, 1, (3, 4))
    u[3] = 0
    gradient, loss, n = A.pair_gradient(u, v, target, matrix)
    assert n == 19
    for at in np.ndindex(3, 4):
        moved = matrix.copy()
        moved[at] += 1e-6
        assert (A.pair_gradient(u, v, target, moved)[1] - loss) / 1e-6 == pytest.approx(gradient[at], rel=1e-3, abs=1e-4)


def test_eval_loss_falls_and_fits_repeat(spark, pairs):
    train, held_out = pairs.where("pair % 4 <> 0"), pairs.where("pair % 4 = 0")
    extra = spark.createDataFrame([(5000, 1, None, [1.0] * 6), (5001, None, [1.0] * 6, [1.0] * 6), (5002, 1, [0.0] * 6, [1.0] * 6)], pairs.schema)
    matrix, log = A.fit_adapter(train.unionAll(extra), held_out, epochs=4, batches=3, learning_rate=0.1)
    assert [x[0] for x in log] == [0, 1, 2, 3, 4] and log[-1][2] < 0.7 * log[0][2] and log[-1][1] < log[0][1]
    again, same = A.fit_adapter(train.unionAll(extra).repartition(3), held_out.repartition(2), epochs=4, batches=3, learning_rate=0.1)
    assert np.array_equal(matrix, again) and log == same
    rows = A.adapted(pairs.select("pair", "u").unionAll(extra.select("pair", "u")), matrix, "u").collect()
    assert all(r.adapted is None if r.u is None else np.allclose(r.adapted, matrix @ np.array(r.u)) for r in rows)
    with pytest.raises(ValueError):
        A.fit_adapter(train.limit(0), held_out)


def test_pair_vectors_feed_a_fit(make):
    vectors = make([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    pairs = make([(0, 1, 1, 2), (1, 0, 2, 2), (2, 1, 1, 9)], "pair long, target int, id_left long, id_right long")
    got = {r.pair: (r.u, r.v) for r in P.pair_vectors(pairs, vectors).collect()}
    assert got == {0: ([1.0, 0.0], [0.0, 2.0]), 1: ([0.0, 2.0], [0.0, 2.0]), 2: ([1.0, 0.0], None)}
