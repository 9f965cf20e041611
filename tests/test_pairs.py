from collections import Counter

import pytest

from conftest import sorted_rows
from corpusloom.operators import classes as C
from corpusloom.operators import pairs as P


def corpus(make, sizes):
    rows = [(i, c, f"c{c}") for c, n in enumerate(sizes) for i in range(c * 1000, c * 1000 + n)]
    return make(rows, "doc_id bigint, label_code bigint, label_text string")


def pairs_of(df, **options):
    return P.contrastive_pairs(df, C.coded_classes(df), **options)


def brute(df):
    rows = df.collect()
    ids = {r.doc_id: r.label_code for r in rows}
    same = {frozenset((a, b)) for a in ids for b in ids if ids[a] == ids[b]}
    other = {frozenset((a, b)) for a in ids for b in ids if ids[a] != ids[b]}
    return same, other


@pytest.mark.parametrize("sizes", [[5, 3], [1, 1], [7, 2, 4], [1, 9]])
def test_all_pairs_and_equal_sides(make, sizes):
    df = corpus(make, sizes)
    same, other = brute(df)
    side = max(len(same), len(other))
    got = pairs_of(df, max_pairs=10_000, batch_size=1).collect()
    positive = Counter(frozenset((r.id_left, r.id_right)) for r in got if r.target == 1)
    negative = Counter(frozenset((r.id_left, r.id_right)) for r in got if r.target == 0)
    assert set(positive) == same and set(negative) == other
    assert sum(positive.values()) == sum(negative.values()) == side
    # the smaller side starts over: no pair is used twice more than another
    assert max(positive.values()) - min(positive.values()) <= 1
    assert max(negative.values()) - min(negative.values()) <= 1


def test_one_class_gives_positive_pairs_only(make):
    got = pairs_of(corpus(make, [6]), batch_size=1).collect()
    assert len(got) == 21 and {r.target for r in got} == {1}
    assert len({frozenset((r.id_left, r.id_right)) for r in got}) == 21


def test_the_run_ends_with_the_last_full_batch(make):
    df = corpus(make, [40, 30])
    got = pairs_of(df, max_pairs=500, batch_size=64)
    assert got.count() == 448 and got.filter("target = 1").count() == 224
    assert sorted_rows(got) == sorted_rows(pairs_of(df.repartition(7), max_pairs=500, batch_size=64))
    assert got.select("id_left", "id_right").distinct().count() == 448


def test_numbers_hold_for_huge_classes(spark):
    sizes = [30_000_000_000, 7, 60_000_000_000]
    starts = [0, sizes[0], sizes[0] + 7]
    rows = P.numbered_pairs(spark, sizes, 2000).collect()
    assert len(rows) == len({(r.g_left, r.g_right) for r in rows}) == 2000

    def slot(g):
        return max(c for c in range(3) if starts[c] <= g)

    for r in rows:
        assert 0 <= r.g_left <= r.g_right < sum(sizes)
        assert (slot(r.g_left) == slot(r.g_right)) == bool(r.target)
    positives = [r.g_left for r in rows if r.target]
    assert len({g // 10**9 for g in positives}) > 40  # spread over the classes


def test_triangle_numbers_are_exact(spark):
    total = P.pair_totals([10**6])[0]
    rows = P.numbered_pairs(spark, [10**6], 3000).collect()
    for r in rows:
        index = r.pair * (P.PAIR_STRIDE % total) % total
        assert r.g_right * (r.g_right + 1) // 2 + r.g_left == index and r.g_left <= r.g_right


def test_embedding_loss(make):
    vectors = make([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 0.0]), (4, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    pairs = make([(0, 1, 1, 3), (1, 0, 1, 2), (2, 1, 2, 3), (3, 1, 1, 4)],
                 "pair bigint, target int, id_left bigint, id_right bigint")
    loss = P.embedding_loss(pairs, vectors).first()
    assert loss.embedding_loss == pytest.approx(1 / 3) and (loss.n_pairs, loss.n_dropped) == (3, 1)
