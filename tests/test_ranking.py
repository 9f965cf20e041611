import math

import pytest
from pyspark.sql import functions as F

from conftest import sorted_rows
from corpusloom.functions.hashing import md5_key, percent_bucket, uniform
from corpusloom.operators import ranking as R
from corpusloom.operators import splits as S
from corpusloom.session import bounded_rows, local_table, write_through


def keyed(spark, n, groups=3):
    return spark.range(n).select(
        (F.col("id") % groups).alias("label_code"), F.col("id"), md5_key("t", "id").alias("h")
    )


@pytest.mark.parametrize("fetch", [1, 7, 10_000])
@pytest.mark.parametrize("rank", [1, 2, 250, 999, 1000])
def test_nth_key_matches_a_sort(spark, fetch, rank):
    keys = keyed(spark, 1000).select("h", "id")
    key = R.nth_key(keys, lambda n: rank, fetch)
    expected = sorted((r.h, r.id) for r in keys.collect())[rank - 1]
    assert (key.hash, key.id) == expected and key.rows == 1000
    assert keys.filter(key.reached(F.col("h"), F.col("id"))).count() == rank


def test_nth_key_of_nothing(spark):
    keys = keyed(spark, 0).select("h", "id")
    key = R.nth_key(keys, lambda n: math.ceil(0.2 * n))
    assert key.rows == 0
    assert keys.filter(key.reached(F.col("h"), F.col("id"))).count() == 0


@pytest.mark.parametrize("max_rows", [1, 5, 40, 10_000])
def test_positions_by_hash_do_not_depend_on_the_cut(spark, max_rows):
    df = spark.range(500).select(
        F.when(F.col("id") < 350, 0).otherwise(F.col("id") % 3).alias("g"), "id", md5_key("t", "id").alias("h")
    )
    got = R.positions_by_hash(df, "g", "h", "id", max_rows=max_rows)
    expected, seen = set(), {}
    for r in sorted(df.collect(), key=lambda r: (r.g, r.h, r.id)):
        seen[r.g] = seen.get(r.g, -1) + 1
        expected.add((r.g, r.id, seen[r.g]))
    assert {(r.g, r.id, r.pos) for r in got.collect()} == expected


def test_positions_by_hash_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(R, "bounded_rows", lambda df: None)
    df = keyed(spark, 400, 5).withColumnRenamed("label_code", "g")
    got = R.positions_by_hash(df, "g", "h", "id", max_rows=9)
    by_group = {}
    for r in got.collect():
        by_group.setdefault(r.g, []).append((r.pos, r.h))
    assert all([h for _, h in sorted(v)] == sorted(h for _, h in v) for v in by_group.values())
    assert all(sorted(p for p, _ in v) == list(range(80)) for v in by_group.values())


def test_positions_by_order_of_clustered_keys(spark):
    ids = [i * i * i for i in range(200)] + [-5, 10**15]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(7)
    got = R.positions_by_order(df, ["id"], rows_per_part=20)
    assert [r.id for r in sorted(got.collect(), key=lambda r: r.pos)] == sorted(ids)
    assert sorted(r.pos for r in got.collect()) == list(range(len(ids)))


@pytest.mark.parametrize("n", [1, 2, 5, 9, 100, 101])
def test_split_sizes(spark, n):
    rows = S.train_val_eval(spark.range(n).withColumnRenamed("id", "doc_id"))
    counts = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
    held_out = math.ceil(0.2 * n)
    assert counts.get("eval", 0) == held_out
    assert counts.get("val", 0) == math.ceil(0.2 * (n - held_out))
    assert sum(counts.values()) == n


def test_split_is_the_same_under_any_partitioning(spark):
    df = spark.range(300).withColumnRenamed("id", "doc_id")
    one = sorted_rows(S.exact_split(df.coalesce(1)))
    assert one == sorted_rows(S.exact_split(df.repartition(13)))
    assert one != sorted_rows(S.exact_split(df, seed=43))


def test_split_without_val(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    assert {r[0] for r in S.train_val_eval(df, val=False).select("split").distinct().collect()} == {"train", "eval"}


def test_hashes(spark):
    u = spark.range(1000).select(uniform(md5_key("u", "id")).alias("u"), percent_bucket("p", "id").alias("p"))
    row = u.agg(F.min("u"), F.max("u"), F.min("p"), F.max("p"), F.avg("u")).first()
    assert 0 <= row[0] and row[1] < 1 and row[2] == 0 and row[3] == 99 and abs(row[4] - 0.5) < 0.05


def test_session_helpers(spark):
    table = local_table(spark, [(1, "a", None)], "x bigint, y string, z double")
    assert table.collect()[0].asDict() == {"x": 1, "y": "a", "z": None}
    assert "LocalTableScan" in table._jdf.queryExecution().executedPlan().toString()
    assert local_table(spark, [], "x bigint").count() == 0
    assert bounded_rows(spark.range(5), 4) is None and len(bounded_rows(spark.range(4), 4)) == 4
    noisy = write_through(spark.range(50).select(F.rand().alias("r")), "noise")
    assert noisy.collect() == noisy.collect()
