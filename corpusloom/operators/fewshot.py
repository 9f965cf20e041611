"""Class-balanced few-shot draws.

Every train row has one shuffled position in its class.  A query draws positions of each
class by Floyd's sampling on hashed numbers, so every subset is as likely as any other and
a draw is an equi-join on ``(class, position)``: no query meets the whole train set.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import hash_bigint, md5_key
from corpusloom.operators.classes import class_rows
from corpusloom.operators.ranking import positions_by_hash

#: Draws that one pool row may answer before it is copied under a salt.
HITS_PER_ROW = 100_000


def shot_pool(
    train: DataFrame, id_col: str = "doc_id", seed: int = 42, classes: DataFrame | None = None
) -> DataFrame:
    """``label_code, label_text, pos, train_id`` of the coded train rows.

    ``classes``, counted on the same rows, saves counting them again.
    """
    coded = train.filter(F.col("label_code") >= 0)
    keys = coded.select("label_code", "label_text", F.col(id_col).alias("train_id"))
    keyed = keys.withColumn("h", md5_key(f"pool{seed}", "train_id"))
    sizes = None if classes is None else _sizes(classes)
    return positions_by_hash(keyed, "label_code", "h", "train_id", sizes=sizes).drop("h")


def draw_positions(
    queries: DataFrame, sizes: dict[int, int], n: int, attempt: int = 0, query_id: str = "query_id"
) -> DataFrame:
    """``query_id, label_code, k, pos``: ``n`` distinct positions per query and class.

    Floyd's sampling: the k-th draw takes a number up to ``size - n + k``, or that bound
    itself if the number was drawn before.  A class with fewer than ``n`` rows gives all.
    """
    cells = F.array(*[
        F.struct(F.lit(code).cast("bigint").alias("label_code"), F.lit(size).cast("bigint").alias("size"))
        for code, size in sorted(sizes.items())
        if size > 0
    ])
    taken = F.least(F.lit(n).cast("bigint"), F.col("size"))

    def draw(drawn: Column, k: Column) -> Column:
        last = F.col("size") - taken + k
        number = hash_bigint(md5_key(f"draw{attempt}", query_id, "label_code", k)) % (last + 1)
        return F.concat(drawn, F.array(F.when(F.array_contains(drawn, number), last).otherwise(number)))

    steps = F.sequence(F.lit(0).cast("bigint"), taken - 1)
    drawn = F.aggregate(steps, F.array().cast("array<bigint>"), draw)
    return (
        queries.select(query_id, F.explode(cells).alias("c"))
        .select(query_id, "c.label_code", "c.size")
        .select(query_id, "label_code", F.posexplode(drawn).alias("k", "pos"))
        .withColumn("k", F.col("k").cast("bigint"))
    )


def _sizes(classes: DataFrame) -> dict[int, int]:
    return {r["label_code"]: r["n"] for r in class_rows(classes)}


def _salts(sizes: dict[int, int], n: int, n_queries: int) -> dict[int, int]:
    """Copies per row that keep each copy below ``HITS_PER_ROW`` draws, for the hot classes."""
    copies = {c: math.ceil(n_queries * n / size / HITS_PER_ROW) for c, size in sizes.items()}
    return {c: k for c, k in copies.items() if k > 1}


def _by_class(values: dict[int, int], other: int | None = None) -> Column:
    """The value of a row's class."""
    found = F.create_map(*[F.lit(v).cast("bigint") for item in values.items() for v in item])[F.col("label_code")]
    return found if other is None else F.coalesce(found, F.lit(other).cast("bigint"))


def _salted(draws: DataFrame, salts: dict[int, int], query_id: str) -> DataFrame:
    return draws.withColumn("salt", hash_bigint(md5_key("salt", query_id, "k")) % _by_class(salts, 1))


def _copied(rows: DataFrame, salts: dict[int, int]) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), _by_class(salts, 1) - 1)))


def few_shot_sample(
    pool: DataFrame,
    classes: DataFrame,
    queries: DataFrame,
    n: int,
    attempt: int = 0,
    on_short: str = "error",
    query_id: str = "query_id",
    n_queries: int | None = None,
) -> DataFrame:
    """``query_id, label_code, k, train_id, label_text``: ``n`` pool rows of every class.

    ``classes`` holds the train counts.  A class with fewer than ``n`` rows is an error,
    or with ``on_short="all"`` gives all its rows.  Rows of a rare class answer many
    queries; they are copied under salts, so that no key is hot.
    """
    sizes = _sizes(classes)
    if n <= 0:
        raise ValueError("draw at least one row per class; with no examples skip the draw")
    short = [c for c, size in sizes.items() if size < n]
    if short and on_short == "error":
        raise ValueError(f"class {short[0]} has fewer than {n} rows")
    draws = draw_positions(queries, sizes, n, attempt, query_id)
    salts = _salts(sizes, n, queries.count() if n_queries is None else n_queries)
    if not salts:
        return draws.join(pool, ["label_code", "pos"]).drop("pos")
    keys = ["label_code", "pos", "salt"]
    return _salted(draws, salts, query_id).join(_copied(pool, salts), keys).drop("pos", "salt")


def with_examples(
    shots: DataFrame, texts: DataFrame, pool: DataFrame, classes: DataFrame, n: int, n_queries: int,
    id_col: str = "doc_id", query_id: str = "query_id",
) -> DataFrame:
    """The drawn rows with their texts, as ``example``.

    Draws are narrow, so each text moves once, by its id.  The texts of rare classes,
    which many draws ask for, are few; they alone are copied under salts.
    """
    payload = texts.select(F.col(id_col).alias("train_id"), F.col("text").alias("example"))
    salts = _salts(_sizes(classes), n, n_queries)
    if not salts:
        return shots.join(payload, "train_id")
    is_hot = F.col("label_code").isin(list(salts))
    copies = _copied(pool.filter(is_hot).select("label_code", "train_id").join(payload, "train_id"), salts)
    hot = _salted(shots.filter(is_hot), salts, query_id).join(copies.drop("label_code"), ["train_id", "salt"])
    return shots.filter(~is_hot).join(payload, "train_id").unionByName(hot.drop("salt"))


def examples_array(shots: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One ``examples`` array per query, by class code and then draw order."""
    item = F.struct("label_code", "k", "example", "label_text")
    return shots.groupBy(query_id).agg(F.array_sort(F.collect_list(item)).alias("examples"))
