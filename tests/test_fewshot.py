import pytest
from pyspark.sql import functions as F

from conftest import sorted_rows
from corpusloom.operators import classes as C
from corpusloom.operators import fewshot as S


def test_draws_of_many_queries_are_independent(spark):
    queries = spark.range(20_000).withColumnRenamed("id", "query_id")
    drawn = S.draw_positions(queries, {0: 1000, 1: 2, 2: 5}, 2)
    pairs = drawn.groupBy("query_id", "label_code").agg(F.array_sort(F.collect_list("pos")).alias("pair"))
    counts = {}
    for r in pairs.groupBy("label_code", "pair").count().collect():
        counts.setdefault(r.label_code, {})[tuple(r.pair)] = r["count"]
    assert len(counts[0]) > 19_000 and all(0 <= a < b < 1000 for a, b in counts[0])
    assert counts[1] == {(0, 1): 20_000}
    # each of the ten pairs of five rows is as likely as any other
    assert len(counts[2]) == 10 and all(abs(n - 2000) < 250 for n in counts[2].values())


@pytest.fixture
def train(spark):
    """Three classes of 3, 30 and 167 rows."""
    i = F.col("id")
    code = F.when(i < 3, 0).when(i < 33, 1).otherwise(2).cast("bigint")
    return spark.range(200).select(
        i.alias("doc_id"), code.alias("label_code"), F.concat(F.lit("c"), code).alias("label_text"),
        F.concat(F.lit("text\n"), i).alias("text"),
    )


@pytest.fixture
def queries(spark):
    return spark.range(1000, 1050).withColumnRenamed("id", "query_id")


def draw(train, queries, n, attempt=0, **options):
    return S.few_shot_sample(S.shot_pool(train), C.coded_classes(train), queries, n, attempt, **options)


def test_n_distinct_rows_of_every_class(train, queries):
    shots = draw(train, queries, 3)
    cells = shots.groupBy("query_id", "label_code").agg(
        F.count("*").alias("n"), F.countDistinct("train_id").alias("d"), F.collect_set("k").alias("k")
    ).collect()
    assert len(cells) == 150 and all(r.n == r.d == 3 and sorted(r.k) == [0, 1, 2] for r in cells)
    codes = {r.doc_id: r.label_code for r in train.collect()}
    assert all(codes[r.train_id] == r.label_code for r in shots.collect())


def test_draws_reach_the_whole_pool_and_change_with_the_attempt(train, queries):
    first, again, retry = (sorted_rows(draw(train, queries, 2, a)) for a in (0, 0, 1))
    assert first == again and first != retry
    assert draw(train, queries, 3).select("train_id").distinct().count() > 100


def test_draws_do_not_depend_on_partitioning(train, queries):
    assert sorted_rows(draw(train, queries, 2)) == sorted_rows(draw(train.repartition(11), queries.repartition(5), 2))


def test_a_short_class_is_an_error_or_gives_all_its_rows(train, queries):
    with pytest.raises(ValueError, match="class 0 has fewer than 4 rows"):
        draw(train, queries, 4)
    shots = draw(train, queries, 4, on_short="all")
    counts = {r.label_code: r["count"] for r in shots.groupBy("label_code").count().collect()}
    assert counts == {0: 150, 1: 200, 2: 200}


def test_salted_join_gives_the_same_draws(train, queries, monkeypatch):
    plain = sorted_rows(draw(train, queries, 3).select("query_id", "label_code", "k", "train_id"))
    monkeypatch.setattr(S, "HITS_PER_ROW", 4)
    salted = draw(train, queries, 3)
    assert "salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted_rows(salted.select("query_id", "label_code", "k", "train_id")) == plain


def examples(train, queries, n=2):
    pool, classes = S.shot_pool(train), C.coded_classes(train)
    shots = S.few_shot_sample(pool, classes, queries, n)
    return S.with_examples(shots, train, pool, classes, n, queries.count())


def test_examples_are_ordered_by_class_and_draw(train, queries):
    row = S.examples_array(examples(train, queries)).first()
    assert [(e.label_code, e.k) for e in row.examples] == [(c, k) for c in range(3) for k in range(2)]


def test_texts_of_rare_classes_arrive_through_salts(train, queries, monkeypatch):
    columns = ["query_id", "label_code", "k", "train_id", "label_text", "example"]
    plain = sorted_rows(examples(train, queries).select(columns))
    assert len(plain) == 300 and all(r[5] == f"text\n{r[3]}" for r in plain)
    monkeypatch.setattr(S, "HITS_PER_ROW", 4)
    salted = examples(train, queries)
    assert "Union" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted_rows(salted.select(columns)) == plain
