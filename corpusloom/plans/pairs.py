"""Queries on contrastive pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import adapter as A
from corpusloom.operators import pairs as P
from corpusloom.operators import splits
from corpusloom.plans import corpus as base
from corpusloom.plans.sql import key, with_ctes
from corpusloom.sources import derived as D


def contrastive_pairs(spark, sf_dir):
    loaded = base.load(spark, sf_dir)
    pairs = P.contrastive_pairs(loaded.part("train"), loaded.train_classes)
    return pairs.withColumn("target", F.col("target").cast("bigint"))


def embedding_loss(spark, sf_dir):
    loss = P.embedding_loss_over_all(D.embeddings(spark, sf_dir))
    return loss.withColumn("embedding_loss", F.round("embedding_loss", 6))


def adapter_fit(spark, sf_dir):
    """All vectors by an adapter trained on pairs of four in five rows; the log of its losses in every row."""
    coded = D.embeddings(spark, sf_dir).withColumnRenamed("label", "label_code")
    rows = splits.exact_split(coded, "vec_id")

    def paired(part):
        own = rows.filter(F.col("split") == part)
        classes = own.groupBy("label_code").agg(F.count("*").alias("n"))
        return P.pair_vectors(P.contrastive_pairs(own, classes, id_col="vec_id"), own)

    matrix, log = A.fit_adapter(paired("train"), paired("eval"))
    losses = {f"eval_loss_{when}": F.lit(log[at][2]).cast("double") for when, at in (("before", 0), ("after", -1))}
    return A.adapted(coded, matrix).select(
        "vec_id", "label_code", F.round(V.l2_norm(F.col("adapted")), 6).alias("norm"),
        F.round(F.get("adapted", F.lit(0)), 6).alias("first"), *[F.round(c, 6).alias(name) for name, c in losses.items()],
    )


QUERIES = {f.__name__: f for f in (contrastive_pairs, embedding_loss, adapter_fit)}


def _pairs(source: str, id_col: str, batch: int = 16) -> dict[str, str]:
    """CTEs up to ``picked(pair, target, id_left, id_right)`` over ``source(id, label_code)``."""
    prime = f"{P.PAIR_STRIDE}::hugeint"
    cap = P.MAX_PAIRS // batch * batch
    return {
        "sizes": f"select label_code, count(*)::hugeint as n from {source} group by label_code",
        "slots": """select label_code, n, b, p as p_n, n * b as q_n, sum(p) over w - p as p_lo, sum(n * b) over w - n * b as q_lo
          from (select label_code, n, n * (n + 1) // 2 as p, sum(n) over (order by label_code) - n as b from sizes)
          window w as (order by label_code)""",
        "totals": "select sum(p_n)::hugeint as pt, sum(q_n)::hugeint as qt from slots",
        "placed": f"""select r.id, (s.b + r.pos)::bigint as g from (select {id_col} as id, label_code,
            row_number() over (partition by label_code order by {key('pairs42', id_col)}, {id_col}) - 1 as pos
          from {source}) r join slots s on s.label_code = r.label_code""",
        "numbers": f"""select unnest(range(least({cap}, 2 * greatest(pt, qt))::bigint)) as pair, pt, qt from totals""",
        "spots": f"""select pair, pair % 2 as side, pt, qt,
            ((pair // 2) % pt * ({prime} % pt)) % pt as pi, ((pair // 2) % qt * ({prime} % qt)) % qt as qi from numbers""",
        "pos": """select pair, cast(1 as bigint) as target, b + l - j * (j + 1) // 2 as gl, b + j as gr from (
            select pair, s.b, pi - s.p_lo as l, floor((sqrt(8 * cast(pi - s.p_lo as double) + 1) - 1) / 2)::hugeint as j
            from spots join slots s on pi >= s.p_lo and pi < s.p_lo + s.p_n where side = 0)""",
        "neg": """select pair, cast(0 as bigint) as target, (qi - s.q_lo) % s.b as gl, s.b + (qi - s.q_lo) // s.b as gr
            from spots join slots s on qi >= s.q_lo and qi < s.q_lo + s.q_n where side = 1""",
        "picked": """select pair, target, a.id as id_left, c.id as id_right
            from (select * from pos union all select * from neg) p
            join placed a on a.g = p.gl::bigint join placed c on c.g = p.gr::bigint""",
    }


_U, _V = "cast(u.embedding as double[])", "cast(v.embedding as double[])"

ORACLES = {
    "contrastive_pairs": with_ctes(
        "train", "select pair, target, id_left, id_right from picked", **_pairs("train", "doc_id")
    ),
    # every pair of vectors is listed here, in place of the sums the query takes
    "embedding_loss": "select round((avg((cos - 1) ** 2) filter (target = 1) + avg(cos ** 2) filter (target = 0)) / 2, 6)"
    " as embedding_loss, count(cos) as n_pairs, count(*) - count(cos) as n_dropped from ("
    f"select cast(u.label = v.label as integer) as target, list_dot_product({_U}, {_V})"
    f" / sqrt(list_dot_product({_U}, {_U}) * list_dot_product({_V}, {_V})) as cos"
    " from embeddings u join embeddings v on u.vec_id <= v.vec_id)",
}
