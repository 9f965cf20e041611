"""Centroid clustering and near duplicates of vectors, against brute force."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import neardup, zonemaps

SCHEMA = "vec_id long, embedding array<double>, cluster string, n_links string, node string, run string, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


# --- centroid clustering


def by_hand(rows, k, rounds, width, scale, salt):
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{salt}{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        mine = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), m in zip(kept, mine) if m == j]
            if members:
                centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    final = [(i, *nearest(v)) for i, v in kept]
    cost = {j: sum(d for _, d, m in final if m == j) for j in range(len(centroids))}
    long = lambda x: x if x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, long(d), long(cost[j]), long(sum(cost.values())), digest[j]) for i, d, j in final), key=repr)


def clustered(df, **options):
    return sorted((tuple(r) for r in zonemaps.cluster(df, **options).collect()), key=repr)


def test_clusters_with_nulls_ties_and_repeats(spark):
    random = np.random.default_rng(4)
    rows = [(i, random.normal(0, 0.3, 4).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)] + [rows[3]] * 3 + [(None, rows[5][1]), (None, rows[6][1])]
    rows += [(900, None), (901, [1.0, 2.0, 3.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan")] * 4), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [])]
    options = dict(k=5, rounds=4, width=4, scale=16, salt="t:")
    assert clustered(frame(spark, rows).repartition(7), **options) == by_hand(rows, **options)
    few = rows[:3]
    assert clustered(frame(spark, few), **options) == by_hand(few, **options)
    assert clustered(frame(spark, []), **options) == []
    assert clustered(frame(spark, [(900, None)]), **options) == []


def test_clusters_of_huge_components_stay_exact(spark):
    rows = [(1, [1e30, -3.0]), (2, [2.0, 5e9]), (3, [4e9, 1.0]), (4, [4e9, 2.0]), (5, [0.5, 0.25]), (6, [-1e30, 7.0])]
    options = dict(k=3, rounds=3, width=2, scale=1024, salt="3:")
    assert clustered(frame(spark, rows), **options) == by_hand(rows, **options)


def test_hilbert_curve_visits_neighbours():
    """Along the curve, consecutive cells differ by one step in one axis."""
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        keys = [k.tobytes() for k in zonemaps.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_boxes_never_lose_the_nearest():
    random = np.random.default_rng(5)
    x = np.floor(random.normal(0, 1, (40, 8, 3)) * 50 + random.normal(0, 4, (40, 1, 3)) * 100)
    centroids = np.floor(random.normal(0, 400, (30, 3)))
    allowed = zonemaps.candidates(x.min(1), x.max(1), centroids)
    distance = np.square(x[:, :, None] - centroids).sum(-1)
    assert allowed.sum() < allowed.size / 2  # the boxes do exclude centroids
    for block in range(len(x)):
        assert allowed[block, distance[block].argmin(1)].all()


# --- near duplicates


def links_by_hand(rows, cosine):
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def alike(v, w):
        a, b = np.array(v), np.array(w)
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine

    n = len(rows)
    near = [[j for j in range(n) if j != i and usable(rows[i][1]) and usable(rows[j][1]) and len(rows[i][1]) == len(rows[j][1]) and alike(rows[i][1], rows[j][1])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids, default=None)
        out.append((rows[i][0], len(near[i]), component, rows[i][0] == component))
    return sorted(out, key=repr)


def groups(df, **options):
    return sorted((tuple(r) for r in neardup.near_groups(df, **options).collect()), key=repr)


def planted(random, width, sizes, spread):
    rows = []
    for size in sizes:
        center = random.normal(0, 1, width)
        rows += [(center + random.normal(0, spread, width)).tolist() for _ in range(size)]
    return rows


def test_links_with_nulls_zeros_and_repeats(spark):
    random = np.random.default_rng(6)
    vectors = planted(random, 5, [1] * 40 + [2] * 10 + [12, 30], 0.12)
    rows = list(enumerate(vectors)) + [(500 + i, vectors[3]) for i in range(40)]
    rows += [(None, vectors[0]), (None, vectors[60]), (7, vectors[7]), (700, [2 * x for x in vectors[8]]), (701, vectors[9][:3])]
    rows += [(800, None), (801, []), (802, [0.0] * 5), (803, [1.0, None, 0.0, 0.0, 0.0]), (804, [float("nan")] * 5), (805, [float("inf")] * 5), (806, [1e200, 1e-200, 0.0, 0.0, 0.0]), (807, [1e300, 0.0, 0.0, 0.0, 0.0])]
    assert groups(frame(spark, rows).repartition(6)) == links_by_hand(rows, 0.9)
    assert groups(frame(spark, [])) == []
    assert groups(frame(spark, [(1, None)])) == [(1, 0, 1, True)]
    assert [f.dataType for f in neardup.near_groups(frame(spark, rows)).schema] == [T.LongType(), T.LongType(), T.LongType(), T.BooleanType()]


@pytest.mark.parametrize("spread, share", [(0.04, 1), (0.25, 0.9)])
def test_links_across_cells_cores_and_blocks(spark, monkeypatch, spread, share):
    """Tiny cells force four rounds of cuts, cores and pairs of blocks; the hot group is tight, or a cloud with most pairs near the bound."""
    monkeypatch.setattr(neardup, "CELL_ROWS", 48)
    monkeypatch.setattr(neardup, "AIM_ROWS", 24)
    random = np.random.default_rng(7)
    rows = list(enumerate(planted(random, 12, [1] * 200 + [2] * 30 + [5] * 10 + [260, 40], spread)))
    found, expected = groups(frame(spark, rows)), links_by_hand(rows, 0.9)
    right = {r[0]: r for r in expected}
    assert all(r[1] <= right[r[0]][1] for r in found)  # no pair is counted twice or below the cosine
    total = sum(r[1] for r in expected)
    assert sum(r[1] for r in found) >= share * total


def test_a_hot_group_is_counted_not_compared(spark, monkeypatch):
    """A third of all vectors are near copies: the blocks meet only what is near the core."""
    monkeypatch.setattr(neardup, "CELL_ROWS", 100)
    random = np.random.default_rng(8)
    rows = list(enumerate(planted(random, 32, [1] * 600 + [400], 0.03)))
    assert groups(frame(spark, rows)) == links_by_hand(rows, 0.9)
    units = spark.createDataFrame([(i, neardup.unit(np.array(v)).tobytes()) for i, v in rows], "node long, unit binary")
    angle = math.acos(0.9)
    placed = neardup.cells(units, math.cos(angle / 2) + 1e-9, math.cos(1.5 * angle) - 1e-9)
    assert placed.where("core is not null and node >= 600").count() == 400
    dealt = neardup._deal(placed.join(units, "node").withColumn("n", F.lit(1).cast("long")))
    assert dealt.where("node >= 600").count() <= 40
