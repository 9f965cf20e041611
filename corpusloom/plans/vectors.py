"""Queries on embeddings: vector functions, losses, the softmax head, attributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.functions.hashing import md5_key, uniform
from corpusloom.operators import classes as C
from corpusloom.operators import descent as N
from corpusloom.operators import explain as E
from corpusloom.operators import head as H
from corpusloom.operators import metrics as M
from corpusloom.operators import splits
from corpusloom.operators import trials as T
from corpusloom.operators.tokens import vocabulary, word_tokens
from corpusloom.plans.sql import key, unit, with_ctes
from corpusloom.session import shuffles_removed, write_through
from corpusloom.sources import derived as D


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.embeddings(spark, sf_dir)


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).withColumnRenamed("label", "label_code")


def l2_normalize(spark, sf_dir):
    scaled = F.transform(V.doubles(F.col("embedding")), lambda x: x * (F.col("label") + 1))
    unit = V.l2_normalize(F.col("scaled"))
    return _vectors(spark, sf_dir).select("vec_id", scaled.alias("scaled")).select(
        "vec_id",
        F.round(V.l2_norm(F.col("scaled")), 6).alias("norm"),
        F.round(unit[0], 6).alias("first"),
        F.round(V.vsum(unit), 6).alias("total"),
    )


def argmax_predict(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", V.argmax_code(F.col("embedding")).alias("pred_code"))


def softmax_probs(spark, sf_dir):
    probs = V.softmax(F.col("embedding"))
    return _vectors(spark, sf_dir).select("vec_id", probs.alias("p")).select(
        "vec_id",
        F.round(F.array_max("p"), 9).alias("pred_prob"),
        F.round(F.col("p")[0], 9).alias("first_prob"),
        V.argmax_code(F.col("p")).alias("pred_code"),
    )


def nucleus_sample(spark, sf_dir):
    """Three seeded draws a row; logits are stretched so that both cuts bind."""
    rows = _vectors(spark, sf_dir).select(
        "vec_id", F.transform(V.doubles(F.col("embedding")), lambda x: x * 8).alias("logits"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2))).alias("draw"),
    )
    u = uniform(md5_key("draw42", "vec_id", "draw"))
    options = dict(temperature=0.7, top_k=50, top_p=0.95)
    return rows.select(
        "vec_id", "draw", V.nucleus_sample(F.col("logits"), u, **options).alias("code"),
        F.size(V.nucleus_weights(F.col("logits"), **options)).cast("bigint").alias("n_kept"),
    )


def weighted_ce(spark, sf_dir):
    coded = _coded(spark, sf_dir)
    rows = C.with_class_weight(coded, C.class_weights(coded)).withColumnRenamed("embedding", "logits")
    loss = M.weighted_ce(rows)
    return loss.withColumn("weighted_ce", F.round("weighted_ce", 6))


def weighted_bce(spark, sf_dir):
    size = F.size("embedding")
    rows = _vectors(spark, sf_dir).select(
        F.col("embedding").alias("logits"),
        F.transform(F.sequence(F.lit(0), size - 1), lambda i: (i == F.col("label")).cast("double")).alias("targets"),
        F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lit(1.0) / (i + 1)).alias("weights"),
    )
    loss = M.weighted_bce(rows)
    return loss.withColumn("weighted_bce", F.round("weighted_bce", 6))


def attribution_summary(spark, sf_dir):
    scaled = F.transform(V.doubles(F.col("embedding")), lambda x: x * 2.5)
    return _vectors(spark, sf_dir).select("vec_id", scaled.alias("a")).select(
        "vec_id",
        F.round(V.attribution_score(F.col("a")), 6).alias("attr_score"),
        F.round(V.attribution_summary(F.col("a"))[0], 6).alias("first"),
    )


def centroid_predict(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    near = H.centroid_predict(vectors, H.class_centroids(vectors))
    return near.select("vec_id", "label", "label_pred", F.round("score", 6).alias("score"))


def _fitted(spark, sf_dir, **options):
    """A head fitted on the train vectors, and the eval vectors with features."""
    coded = H.as_features(_coded(spark, sf_dir))
    rows = splits.exact_split(coded, "vec_id")
    train = rows.filter(F.col("split") == "train")
    train = C.with_class_weight(train, C.class_weights(train))
    return H.fit_head(train, **options), rows.filter(F.col("split") == "eval")


def head_fit_predict(spark, sf_dir):
    model, held_out = _fitted(spark, sf_dir)
    return H.predict(model, held_out).select(
        "vec_id", "label_code", "pred_code", F.round("pred_prob", 6).alias("pred_prob")
    )


def head_evaluate(spark, sf_dir):
    model, held_out = _fitted(spark, sf_dir, reg=0.01)
    return H.evaluate_head(model, held_out)


def head_search(spark, sf_dir):
    coded = H.as_features(_coded(spark, sf_dir))
    rows = splits.train_val_eval(coded, "vec_id")
    train = rows.filter(F.col("split") == "train")
    train = C.with_class_weight(train, C.class_weights(train))
    space = {"reg": {"low": 1e-4, "high": 1e-1, "log": True}, "max_iter": {"choices": "5,10,25"}}
    grid = [r.asDict() for r in T.param_grid(spark.range(4).withColumnRenamed("id", "trial"), space).collect()]
    return H.search_head(train, rows.filter(F.col("split") == "val"), grid)


def head_search_pruned(spark, sf_dir):
    rows = splits.train_val_eval(_coded(spark, sf_dir), "vec_id")
    train = rows.filter(F.col("split") == "train")
    train = C.with_class_weight(train, C.class_weights(train))
    n_classes = rows.agg(F.max("label_code")).first()[0] + 1
    space = {
        "learning_rate": {"low": 1e-3, "high": 1e-1, "log": True}, "l2_weight": {"low": 1e-4, "high": 1e-3},
        "num_epochs": {"choices": "5,10"},
    }
    grid = [r.asDict() for r in T.param_grid(spark.range(8).withColumnRenamed("id", "trial"), space).collect()]
    results, _ = N.search_head_pruned(train, rows.filter(F.col("split") == "val"), grid, n_classes)
    return results.withColumn("value", F.round("value", 6))


def multi_target_fit(spark, sf_dir):
    """Two targets of a vector: whether its class is even, and whether it is above the middle."""
    coded = _coded(spark, sf_dir)
    targets = F.array((F.col("label_code") % 2 == 0).cast("double"), (F.col("label_code") >= 5).cast("double"))
    rows = splits.exact_split(coded, "vec_id").withColumn("targets", targets)
    weights, _ = N.fit_targets(rows.filter(F.col("split") == "train"), 2, epochs=15)
    scored = N.predict_targets(rows.filter(F.col("split") == "eval"), weights)
    return scored.select(
        "vec_id", *[F.round(F.get("target_probs", F.lit(k)), 6).alias(f"prob_{name}") for k, name in enumerate(("even", "high"))]
    )


def integrated_gradients(spark, sf_dir):
    model, _ = _fitted(spark, sf_dir, max_iter=25)
    records = E.integrated_gradients(_vectors(spark, sf_dir), model, target=1)
    return records.select(
        "vec_id", F.col("label").alias("true_class"), "pred_class", "attr_class",
        F.round("pred_prob", 6).alias("pred_prob"), F.round("attr_score", 6).alias("attr_score"), "delta",
    )


def error_attributions(spark, sf_dir):
    model, held_out = _fitted(spark, sf_dir, max_iter=25)
    records = E.attribute_errors(held_out, model, target=1)
    return records.select("vec_id", "label_code", "pred_class", F.round("attr_score", 6).alias("attr_score"), "delta")


def token_attributions(spark, sf_dir):
    """Tokens of all documents, with hashed vectors of 16 numbers and a head on their means."""
    corpus = D.corpus(spark, sf_dir)
    vectors = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.pmod(F.xxhash64("token", i), F.lit(2001)) / 1000 - 1)
    with shuffles_removed(spark):
        # texts are read once, and their words counted; all that follows reads the counts
        docs = E.pack_tokens(corpus.select("doc_id", "text"), tokens=word_tokens(F.col("text")))
        table = write_through(vocabulary(docs.words()).select("token"), "words").select("token", vectors.alias("vector"))
        counted = E.token_counts(docs, table)
        coded = C.factorize(corpus.select("doc_id", "label"), C.class_table(corpus))
        pooled = write_through(E.pooled_tokens(counted).join(coded, "doc_id"), "pooled")
    model = H.fit_head(H.as_features(C.with_class_weight(pooled, C.class_weights(pooled))), max_iter=10)
    found = E.token_attributions(docs, table, model, target=1, counted=counted)
    return found.select(
        "doc_id", "token", "n", F.round("attribution", 6).alias("attribution"), "pred_class", "attr_class",
        F.round("pred_prob", 6).alias("pred_prob"), "delta",
    )


def project_2d(spark, sf_dir):
    return H.project_2d(_vectors(spark, sf_dir)).select("vec_id", "label", "x", "y")


QUERIES = {
    f.__name__: f
    for f in (
        l2_normalize, argmax_predict, softmax_probs, nucleus_sample, weighted_ce, weighted_bce, attribution_summary,
        centroid_predict, head_fit_predict, head_evaluate, head_search, head_search_pruned, multi_target_fit, integrated_gradients,
        error_attributions, token_attributions, project_2d,
    )
}

_V = "cast(embedding as double[])"
_EXP = f"list_transform({_V}, lambda z: exp(z - list_max({_V})))"
_LSE = f"(list_max({_V}) + ln(list_sum({_EXP})))"

ORACLES = {
    "l2_normalize":
        "select vec_id, round(norm, 6) as norm, round(s[1] / norm, 6) as first, round(list_sum(s) / norm, 6) as total"
        f" from (select vec_id, s, sqrt(list_dot_product(s, s)) as norm"
        f" from (select vec_id, list_transform({_V}, lambda x: x * (label + 1)) as s from embeddings))",
    "argmax_predict":
        "select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as bigint) as pred_code from embeddings",
    "softmax_probs":
        "select vec_id, round(list_max(e) / t, 9) as pred_prob, round(e[1] / t, 9) as first_prob,"
        " cast(list_position(e, list_max(e)) - 1 as bigint) as pred_code"
        f" from (select vec_id, e, list_sum(e) as t from (select vec_id, {_EXP} as e from embeddings))",
    "nucleus_sample": with_ctes(
        "",
        "select p.vec_id, draw, cast(arg_min(code, place) filter (where upto > u or place = n_kept) as bigint) as code,"
        " any_value(n_kept) as n_kept from parts p, draws d where p.vec_id = d.vec_id group by p.vec_id, draw",
        logits=f"select vec_id, unnest({_V}) * 8 as z, unnest(range(len(embedding))) as code from embeddings",
        ranked="select *, row_number() over (partition by vec_id order by z desc, code) as place,"
               " exp((z - max(z) over (partition by vec_id)) / cast(0.7 as double)) as e from logits",
        few="select *, e / sum(e) over (partition by vec_id) as q from ranked where place <= 50",
        front="select * from (select *, sum(q) over (partition by vec_id order by place) - q as before from few) where before < 0.95 or place = 1",
        parts="select *, sum(q) over (partition by vec_id order by place) / sum(q) over (partition by vec_id) as upto,"
              " count(*) over (partition by vec_id) as n_kept from front",
        draws=f"select vec_id, draw, {unit(key('draw42', 'vec_id', 'draw'))} as u from embeddings, (select unnest(range(3)) as draw)",
    ),
    "weighted_ce":
        f"select round(sum(w * ({_LSE} - {_V}[label + 1])) / sum(w), 6) as weighted_ce, count(*) as n"
        " from (select *, cast(1 as double) / count(*) over (partition by label) as w from embeddings)",
    "weighted_bce":
        "select round(sum((greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) / i) / count(*), 6) as weighted_bce,"
        " count(distinct vec_id) as n from (select vec_id, z, i, case when i - 1 = label then cast(1 as double) else 0 end as y"
        f" from (select vec_id, label, unnest({_V}) as z, unnest(range(1, len(embedding) + 1)) as i from embeddings))",
    "attribution_summary":
        f"select vec_id, round(list_sum(a) / norm, 6) as attr_score, round(a[1] / norm, 6) as first"
        " from (select *, sqrt(list_dot_product(a, a)) as norm"
        f" from (select vec_id, list_transform({_V}, lambda x: x * cast(2.5 as double)) as a from embeddings))",
    "centroid_predict": with_ctes(
        "",
        "select vec_id, label, label_pred, round(score, 6) as score from scored"
        " qualify row_number() over (partition by vec_id order by score desc, label_pred) = 1",
        dims=f"select vec_id, cast(label as bigint) as label, unnest({_V}) as x, unnest(range(1, len(embedding) + 1)) as i from embeddings",
        centroids="select label as label_pred, list(m order by i) as c from"
                  " (select label, i, avg(x) as m from dims group by label, i) group by label",
        scored=f"select vec_id, cast(label as bigint) as label, label_pred, list_dot_product({_V}, c) as score from embeddings, centroids",
    ),
}
