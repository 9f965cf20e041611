"""Vector arithmetic on ``array<float|double>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression named inside a lambda would otherwise run once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def vsum(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x)


def dot(u: Column, v: Column) -> Column:
    return vsum(F.zip_with(doubles(u), doubles(v), lambda a, b: a * b))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """``v / |v|``; null for the zero vector."""
    return let(l2_norm(v), lambda n: F.when(n > 0, F.transform(doubles(v), lambda x: x / n)))


def cosine(u: Column, v: Column) -> Column:
    """Cosine similarity; null when either side is the zero vector."""
    return let(l2_norm(u) * l2_norm(v), lambda scale: F.when(scale > 0, dot(u, v) / scale))


def softmax(logits: Column) -> Column:
    def scaled(peak: Column) -> Column:
        return F.transform(doubles(logits), lambda z: F.exp(z - peak))

    def divided(parts: Column) -> Column:
        return let(vsum(parts), lambda total: F.transform(parts, lambda e: e / total))

    return let(F.array_max(doubles(logits)), lambda peak: let(scaled(peak), divided))


def log_sum_exp(logits: Column) -> Column:
    return let(
        F.array_max(doubles(logits)),
        lambda peak: peak
        + F.log(F.aggregate(doubles(logits), F.lit(0.0), lambda acc, z: acc + F.exp(z - peak))),
    )


def log_prob(logits: Column, code: Column) -> Column:
    """Log-softmax of the entry ``code`` (0-based)."""
    return F.get(doubles(logits), code) - log_sum_exp(logits)


def argmax_code(scores: Column) -> Column:
    """0-based position of the largest entry; the lowest position on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("bigint")


def predicted_prob(logits: Column) -> Column:
    """Probability of the predicted class."""
    return F.array_max(softmax(logits))


def attribution_summary(v: Column) -> Column:
    """Attributions scaled to unit norm; null for the zero vector."""
    return l2_normalize(v)


def attribution_score(v: Column) -> Column:
    """Sum of the scaled attributions; null for the zero vector."""
    return let(l2_norm(v), lambda n: F.when(n > 0, vsum(v) / n))


def nucleus_weights(logits: Column, temperature: float = 0.7, top_k: int | None = 50, top_p: float | None = 0.95) -> Column:
    """The codes that a draw may take, as ``array<struct<p, code>>``, the likeliest first.

    Logits are divided by ``temperature`` and become probabilities.  The ``top_k`` largest
    stay, equal ones in the order of their codes; of these, renormalised, the shortest front
    part whose mass reaches ``top_p`` stays, at least one code.  ``p`` sums to 1 over the
    codes that stay.  Null and NaN logits are never drawn; null if none is left.
    """
    if temperature <= 0 or (top_k is not None and top_k < 1) or (top_p is not None and not 0 < top_p <= 1):
        raise ValueError("temperature and top_k are positive, top_p is in (0, 1]")
    coded = F.transform(doubles(logits), lambda z, i: F.struct((-z).alias("minus"), i.alias("code")))
    valid = F.filter(coded, lambda c: c["minus"].isNotNull() & ~F.isnan(c["minus"]))

    def cut(ordered: Column) -> Column:
        few = ordered if top_k is None else F.slice(ordered, 1, top_k)
        top = F.get(ordered, F.lit(0))["minus"]
        # a probability a place below the likeliest; equal infinite logits share what there is
        return F.transform(few, lambda c: F.struct(
            F.when(c["minus"] == top, F.lit(1.0)).otherwise(F.exp((top - c["minus"]) / F.lit(float(temperature)))).alias("p"), c["code"].alias("code"),
        ))

    def normal(parts: Column) -> Column:
        total = F.aggregate(parts, F.lit(0.0), lambda s, c: s + c["p"])
        return let(total, lambda t: F.transform(parts, lambda c: F.struct((c["p"] / t).alias("p"), c["code"].alias("code"))))

    def front(parts: Column) -> Column:
        if top_p is None:
            return parts
        start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("n"))
        reached = F.aggregate(
            parts, start,
            lambda s, c: F.when(s["mass"] < top_p, F.struct((s["mass"] + c["p"]).alias("mass"), (s["n"] + 1).alias("n"))).otherwise(s),
        )
        return let(reached["n"], lambda n: F.slice(parts, F.lit(1), n))

    kept = let(let(let(let(F.array_sort(valid), cut), normal), front), normal)
    return F.when(F.size(valid) > 0, kept)


def nucleus_sample(logits: Column, u: Column, **options) -> Column:
    """The code drawn by a uniform ``u`` in [0, 1) from ``nucleus_weights``; null where nothing can be drawn."""
    def drawn(parts: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("mass"), F.lit(None).cast("int").alias("code"))
        at = F.aggregate(
            parts, start,
            lambda s, c: F.when(
                s["code"].isNull() | (s["mass"] <= u), F.struct((s["mass"] + c["p"]).alias("mass"), c["code"].alias("code"))
            ).otherwise(s),
        )
        return at["code"]

    return let(nucleus_weights(logits, **options), lambda parts: F.when(parts.isNotNull(), drawn(parts))).cast("bigint")
