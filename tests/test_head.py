import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import classes as C
from corpusloom.operators import explain as E
from corpusloom.operators import head as H
from corpusloom.operators import splits


@pytest.fixture(scope="module")
def vectors(spark):
    """Three separable, uneven classes in four dimensions."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        code = 0 if i % 8 < 5 else 1 if i % 8 < 7 else 2
        rows.append((i, [float(x) for x in rng.normal(0, 0.4, 4) + np.eye(4)[code] * 1.5], code))
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label_code bigint").cache()


@pytest.fixture(scope="module")
def parts(vectors):
    rows = splits.train_val_eval(H.as_features(vectors), "vec_id")
    train = rows.filter("split = 'train'")
    return C.with_class_weight(train, C.class_weights(train)), rows.filter("split = 'val'"), rows.filter("split = 'eval'")


@pytest.fixture(scope="module")
def model(parts):
    return H.fit_head(parts[0], reg=0.001, max_iter=30)


def test_head_beats_the_majority(parts, model):
    got = H.evaluate_head(model, parts[2]).first()
    assert got.balanced_accuracy > 0.8 and got.f1_score_macro > 0.8


def test_prediction_is_the_argmax_of_the_logits(parts, model):
    scored = H.predict(model, parts[2]).withColumn("a", V.argmax_code(F.col("logits")))
    assert scored.filter("a <> pred_code").count() == 0
    assert all(1 / 3 < r.pred_prob <= 1 for r in scored.collect())


def test_head_ignores_rows_without_a_class(parts, model):
    noise = parts[0].limit(20).withColumn("label_code", F.lit(-1).cast("bigint"))
    again = H.fit_head(parts[0].unionByName(noise), reg=0.001, max_iter=30)
    assert np.allclose(again.coefficientMatrix.toArray(), model.coefficientMatrix.toArray(), atol=1e-3)


def test_search_and_refit(parts):
    train, val, held_out = parts
    grid = [{"trial": 0, "reg": 0.001, "max_iter": 0}, {"trial": 1, "reg": 0.001, "max_iter": 20}]
    results = H.search_head(train, val, grid)
    values = {r.trial: r.value for r in results.collect()}
    assert values[1] > values[0]
    refit, best = H.refit_best(train, results)
    assert best["trial"] == 1 and best["max_iter"] == 20
    assert H.evaluate_head(refit, held_out).first().f1_score_macro > 0.8
    own = H.search_head(train, val, grid, metric=lambda runs: runs.groupBy("trial").agg(F.avg("pred_code").alias("value")))
    assert {r.trial for r in own.collect()} == {0, 1}
    with pytest.raises(ValueError, match="no valid metric"):
        H.search_head(train, val, grid, metric="loss")


def test_attributions_are_complete(vectors, model):
    records = E.integrated_gradients(vectors, model, target=1, batch=7).collect()
    start = np.exp(model.interceptVector.toArray())
    base = start[1] / start.sum()
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    for r in records:
        z = np.exp(weights @ np.array(r.embedding) + bias)
        p = z / z.sum()
        assert sum(r.attributions) == pytest.approx(p[1] - base, abs=1e-3) and abs(r.delta) < 1e-3
        assert r.pred_class == p.argmax() and r.pred_prob == pytest.approx(p.max(), abs=1e-6)
        assert r.attr_score == pytest.approx(sum(r.attributions) / np.linalg.norm(r.attributions), abs=1e-6)
    assert len(records) == 240 and records[0].attr_class == 1


def test_errors_only(vectors, parts):
    weak = H.fit_head(parts[0], max_iter=0)
    errors = H.predict(weak, parts[2]).filter("pred_code <> label_code").count()
    records = E.attribute_errors(parts[2], weak, target=1).collect()
    assert errors == len(records) > 0 and all(r.pred_class != r.label_code for r in records)


def test_attributions_match_a_plain_path_integral(vectors, model):
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    row = E.integrated_gradients(vectors.limit(1), model, target=2, n_steps=50).first()
    x, total = np.array(row.embedding), np.zeros(4)
    for k in range(50):
        z = np.exp(weights @ x * (k + 0.5) / 50 + bias)
        p = z / z.sum()
        total += p[2] * (weights[2] - p @ weights) / 50
    assert np.allclose(row.attributions, x * total)


def test_token_attributions(make, model):
    """Against a path integral over every token's own vector; unknown tokens, repeats, empty and null rows."""
    rng = np.random.default_rng(2)
    known = {w: rng.normal(0, 1.5, 4) for w in "abcdef"}
    table = make([(w, [float(x) for x in v]) for w, v in known.items()], "token string, vector array<double>")
    texts = {1: list("aab"), 2: list("cdefz"), 3: ["z"], 4: [], 5: None, None: list("ff")}
    df = make(list(texts.items()), "doc_id bigint, tokens array<string>").withColumn("n", F.lit("x"))
    got = {(r.doc_id, r.token): r for r in E.token_attributions(df, table, model, target=1, n_steps=200).collect()}
    assert set(got) == {(i, w) for i, t in texts.items() for w in t or []}
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()

    def prob(x):
        z = np.exp(weights @ x + bias)
        return z / z.sum()

    for i, t in texts.items():
        own = [w for w in t or [] if w in known]
        if not own:
            continue
        e, want = np.stack([known[w] for w in own]), np.zeros(len(own))
        for k in range(200):
            p = prob((e * (k + 0.5) / 200).mean(0))
            want += e @ (p[1] * (weights[1] - p @ weights)) / len(own) / 200
        for w in set(own):
            r = got[i, w]
            assert r.n == own.count(w) and r.attribution == pytest.approx(sum(x for x, o in zip(want, own) if o == w), abs=1e-9)
            assert r.pred_class == prob(e.mean(0)).argmax() and r.attr_prob == pytest.approx(prob(e.mean(0))[1])
        gain = prob(e.mean(0))[1] - prob(np.zeros(4))[1]
        assert sum(got[i, w].attribution for w in set(own)) == pytest.approx(gain, abs=1e-3) and abs(got[i, own[0]].delta) < 1e-3
    assert got[2, "z"].attribution == got[3, "z"].attribution == 0 and got[3, "z"].pred_class is None
    none = E.token_attributions(df.limit(0), table, model, target=1)
    assert none.collect() == []


def test_centroids(make):
    df = make([(1, [1.0, 0.0], 4), (2, [0.8, 0.2], 4), (3, [0.0, 1.0], 2), (4, [0.5, 0.5], 2)],
              "vec_id int, embedding array<float>, label bigint")
    centroids = H.class_centroids(df)
    assert {r.label: [round(x, 6) for x in r.centroid] for r in centroids.collect()} == {4: [0.9, 0.1], 2: [0.25, 0.75]}
    tied = make([(1, [1.0, 0.0], 5), (2, [1.0, 0.0], 3)], "vec_id int, embedding array<float>, label bigint")
    assert {r.label_pred for r in H.centroid_predict(tied, H.class_centroids(tied)).collect()} == {3}


def test_encoders(make):
    df = make([(1, "a b"), (2, "a c c")], "doc_id int, text string")
    _, encoded = H.hash_encoder(df, dims=64)
    first, second = (r.features for r in encoded.orderBy("doc_id").collect())
    assert first.numNonzeros() == 1 and second.numNonzeros() == 1  # "a" is everywhere: weight 0
    lengths = H.encode(df, lambda: lambda batch: [[float(len(t))] for t in batch])
    assert {r.doc_id: r.embedding for r in lengths.collect()} == {1: [3.0], 2: [5.0]}


def test_projection_keeps_the_largest_variance(make):
    df = make([(i, [float(i), float(i % 2), 0.0]) for i in range(20)], "vec_id int, embedding array<float>")
    got = H.project_2d(df).orderBy("vec_id").collect()
    assert len({r.x for r in got}) == 20 and np.std([r.x for r in got]) > 5 * np.std([r.y for r in got])


# -- vector functions ------------------------------------------------------------

def test_vector_functions(make):
    df = make([([3.0, 4.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "u array<double>, v array<float>")
    u, v = F.col("u"), F.col("v")
    got = df.select(
        V.l2_norm(u), V.l2_normalize(u), V.cosine(u, v), V.softmax(u), V.argmax_code(v), V.attribution_score(u),
        V.dot(u, v), V.predicted_prob(u),
    ).collect()
    assert got[0][0] == 5 and got[0][1] == pytest.approx([0.6, 0.8]) and got[0][2] == pytest.approx(0.8)
    assert got[0][3] == pytest.approx([1 / (1 + np.e), np.e / (1 + np.e)]) and got[0][4] == 1
    assert got[0][5] == pytest.approx(1.4) and got[0][6] == 8 and got[0][7] == pytest.approx(np.e / (1 + np.e))
    assert got[1][1] is None and got[1][2] is None and got[1][5] is None and got[1][4] == 0


def test_softmax_survives_large_logits(make):
    df = make([([1000.0, 0.0], 1)], "z array<double>, c int")
    got = df.select(V.softmax(F.col("z")), V.log_prob(F.col("z"), F.col("c"))).first()
    assert got[0] == [1.0, 0.0] and got[1] == -1000.0


def test_nucleus_draws(make):
    import math

    logits = [[0.0, 2.0, 1.0, 2.0, -3.0], [5.0], [None, float("nan"), 1.0], [None], [], None, [1.0] * 6, [float("inf"), 0.0, float("inf")], [-1e9, 3.0, 1e9]]
    df = make([(i, z, u / 20) for i, z in enumerate(logits) for u in range(20)], "k int, z array<double>, u double")
    for top_k, top_p in [(50, 0.95), (2, 0.95), (None, 0.5), (3, None), (1, 1.0)]:
        options = dict(temperature=0.7, top_k=top_k, top_p=top_p)
        got = df.select("k", "z", "u", V.nucleus_weights(F.col("z"), **options).alias("w"), V.nucleus_sample(F.col("z"), F.col("u"), **options).alias("c")).collect()
        for r in got:
            valid = [(-z, i) for i, z in enumerate(r.z or []) if z is not None and not math.isnan(z)]
            if not valid:
                assert r.w is None and r.c is None
                continue
            order = sorted(valid)[: top_k or len(valid)]
            e = [1.0 if m == order[0][0] else math.exp((order[0][0] - m) / 0.7) for m, _ in order]
            q, kept, mass = [x / sum(e) for x in e], [], 0.0
            for p, (_, i) in zip(q, order):
                if top_p is None or mass < top_p:
                    kept.append((p, i))
                    mass += p
            assert [c.code for c in r.w] == [i for _, i in kept]
            assert sum(c.p for c in r.w) == pytest.approx(1)
            upto = 0.0
            for p, i in kept:
                upto += p / mass
                if upto > r.u:
                    break
            assert r.c == i
    with pytest.raises(ValueError):
        V.nucleus_weights(F.col("z"), temperature=0)


def test_words_of_attributions_are_counted_once(make, model):
    df = make([(1, ["a", "b", "a"]), (2, ["b"])], "doc_id long, tokens array<string>")
    table = make([("a", [0.5, 1.0]), ("b", [-0.5, 0.0])], "token string, vector array<double>")
    plan = E.token_attributions(df, table, model, target=1, n_steps=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan


def test_words_of_attributions_are_not_shuffled(make, model):
    df = make([(1, ["a", "b", "a"]), (2, ["b"])], "doc_id long, tokens array<string>")
    table = make([("a", [0.5, 1.0, 0.0, 2.0]), ("b", [-0.5, 0.0, 1.0, 1.0])], "token string, vector array<double>")
    found = E.token_attributions(df, table, model, target=1, n_steps=20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 3 and "Exchange" not in plan and "Join" not in plan


@pytest.fixture
def odd_texts(spark, make):
    """Ids of many rows and none, words unknown, null, or told twice by the table; rows, the table, and vectors by word."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)] + [None, "strange", "empty"]
    rows = [(int(i) if i else None, [words[k] for k in rng.integers(0, 33, rng.integers(0, 9))]) for i in rng.integers(0, 25, 120)]
    rows += [(77, None), (78, []), (79, ["strange"])] + [(80, ["w1", "w2", "w1"])] * 90
    vectors = {w: [[float(x) for x in rng.normal(0, 1, 4)]] for w in words[:30]}
    vectors["w3"].append([1.0, 2.0, 3.0, 4.0])
    table = [(w, v) for w, vs in vectors.items() for v in vs] + [("unasked", [0.0] * 4), ("empty", None), (None, [9.0] * 4)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    yield rows, make(rows, "doc_id bigint, tokens array<string>"), make(table, "token string, vector array<double>"), vectors
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("part_tokens", [1, 40, None])
def test_packed_tokens(odd_texts, model, part_tokens):
    """Counts, vectors, means and attributions in parts of any size against those worked out row by row."""
    from collections import Counter, defaultdict

    rows, df, table, vectors = odd_texts
    counts = defaultdict(Counter)
    for i, tokens in rows:
        counts[i].update(tokens or [])
    packed = E.pack_tokens(df.repartition(3), part_tokens=part_tokens)
    n_parts = packed.rows.select("part").distinct().count()
    assert n_parts > 20 if part_tokens == 1 else 8 < n_parts <= 20 if part_tokens else n_parts <= 8
    assert {w for r in packed.words().collect() for w in r.tokens} == {w for c in counts.values() for w in c}
    counted = E.token_counts(packed, table)
    want = Counter(
        (i, w, n, None if v is None else tuple(v)) for i, c in counts.items() for w, n in c.items() for v in vectors.get(w, [None])
    )
    assert Counter((r.doc_id, r.token, r.n, r.vector and tuple(r.vector)) for r in counted.collect()) == want
    pooled = {r.doc_id: r for r in E.pooled_tokens(counted).collect()}
    plain = {r.doc_id: r for r in E.pooled_tokens(counted.select("*")).collect()}
    assert set(pooled) == set(plain) and 79 not in pooled and 78 not in pooled
    for i, r in plain.items():
        assert pooled[i].embedding == pytest.approx(r.embedding) and pooled[i].n_tokens == r.n_tokens
    got = E.token_attributions(packed, table, model, target=1, n_steps=20, counted=counted).collect()
    again = E.token_attributions(df, table, model, target=1, n_steps=20).collect()

    def shown(rows):
        return sorted((str(r.doc_id), str(r.token), r.n, round(r.attribution, 9), r.pred_class) for r in rows)

    assert shown(got) == shown(again) and len(got) == want.total()
    total = defaultdict(float)
    for r in got:
        total[r.doc_id] += r.attribution
        assert (r.pred_class is None) == (r.doc_id == 79) and (r.token in vectors or r.attribution == 0)
    for r in H.predict(model, H.as_features(E.pooled_tokens(counted))).collect():
        first = next(g for g in got if g.doc_id == r.doc_id)
        assert first.pred_class == r.pred_code and first.pred_prob == pytest.approx(r.pred_prob)
        start = np.exp(model.interceptVector.toArray())
        assert total[r.doc_id] == pytest.approx(first.attr_prob - start[1] / start.sum() + first.delta)
