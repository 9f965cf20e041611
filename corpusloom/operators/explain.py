"""Attribution of predictions to the head's input dimensions, and to the tokens behind them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import head
from corpusloom.session import shuffles_removed, write_bucketed

N_STEPS = 500
BATCH = 40
#: Tokens in a part of the texts, whose words are looked up together.  A part holds whole texts, so it may exceed
#: this by one of them.  Vectors of some dozen numbers are meant; longer ones want smaller parts.
PART_TOKENS = 1 << 20
#: Buckets a core at least, as parts fall into them by hash.
BUCKETS_CORE = 16
#: Words in a row of a part's word list.
WORDS_ROW = 1 << 12
#: Pieces of one part after which they are counted together, so that a text of many rows stays small.
PIECES = 64
#: Rows of an Arrow batch on its way back to Spark.
ROWS = 10_000

_SCHEMA = "attributions array<double>, pred_class bigint, pred_prob double, attr_prob double, delta double"


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _mean_gradient(x, weights, bias, target, steps):
    """Mean gradient on the path from the zero baseline, end probabilities, and the target's gain.

    The logits are linear along the path, so each step needs only ``x @ W.T`` scaled;
    the gradient ``p_t (W_t - sum_k p_k W_k)`` is averaged before it meets ``W``.
    """
    alphas = (np.arange(steps) + 0.5) / steps
    base = x @ weights.T
    p = _softmax(alphas[None, :, None] * base[:, None, :] + bias)
    p_t = p[:, :, target]
    mean_t = p_t.mean(axis=1)
    mean_tk = np.einsum("bs,bsk->bk", p_t, p) / steps
    gradient = mean_t[:, None] * weights[target] - mean_tk @ weights
    end = _softmax(base + bias)
    start = _softmax(bias[None, :])[0, target]
    return gradient, end, end[:, target] - start


def _attribute(x, weights, bias, target, steps):
    """Path integral from the zero baseline for one batch of rows."""
    gradient, end, gain = _mean_gradient(x, weights, bias, target, steps)
    attributions = x * gradient
    return attributions, end, attributions.sum(axis=1) - gain


def integrated_gradients(
    df: DataFrame,
    model: LogisticRegressionModel,
    target: int,
    vector: str = "embedding",
    n_steps: int = N_STEPS,
    batch: int = BATCH,
) -> DataFrame:
    """Add an attribution record per row: attributions to class ``target``, the predicted
    class and its probability, the score (sum of the scaled attributions) and the
    convergence delta."""
    weights = np.asarray(model.coefficientMatrix.toArray(), dtype="float64")
    bias = np.asarray(model.interceptVector.toArray(), dtype="float64")

    @F.pandas_udf(_SCHEMA)
    def attribute(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parts = []
            for start in range(0, len(rows), batch):
                x = np.stack(rows.iloc[start:start + batch].to_numpy()).astype("float64")
                attributions, probs, delta = _attribute(x, weights, bias, target, n_steps)
                pred = probs.argmax(axis=1)
                parts.append(pd.DataFrame({
                    "attributions": list(attributions),
                    "pred_class": pred.astype("int64"),
                    "pred_prob": probs[np.arange(len(pred)), pred],
                    "attr_prob": probs[:, target],
                    "delta": delta,
                }))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(
                columns=["attributions", "pred_class", "pred_prob", "attr_prob", "delta"]
            )

    return (
        df.withColumn("_ig", attribute(vector))
        .select(*df.columns, "_ig.*")
        .withColumns({
            "attr_class": F.lit(target).cast("bigint"),
            "attr_score": V.attribution_score(F.col("attributions")),
        })
    )


def attribute_errors(
    df: DataFrame, model: LogisticRegressionModel, target: int, label: str = "label_code", **options
) -> DataFrame:
    """Attribution records of the rows the head gets wrong."""
    wrong = head.predict(model, df).filter(F.col("pred_code") != F.col(label)).select(*df.columns)
    return integrated_gradients(wrong, model, target, **options)


# -- tokens ----------------------------------------------------------------------

@dataclass(frozen=True)
class PackedTokens:
    """The counted tokens of texts, written once, in parts of about ``PART_TOKENS`` tokens.

    ``rows`` has the columns ``part, at, words, id, codes, counts``.  A part lists its
    words once, some thousand a row from place ``at``; a row without ``at`` is a text,
    which tells its words by their places in that list.  Rows are bucketed by part.
    """

    rows: DataFrame
    id_col: str
    buckets: int

    def words(self) -> DataFrame:
        """``part, at, tokens``: the words of every part, each once in a part."""
        return self.rows.where(F.col("at").isNotNull()).select("part", "at", F.col("words").alias("tokens"))


def pack_tokens(
    df: DataFrame, id_col: str = "doc_id", tokens: str | Column = "tokens", part_tokens: int | None = None
) -> PackedTokens:
    """Count the tokens of each id in one pass over ``df``; rows of one id count as one text.

    One task holds a part, of ``part_tokens`` tokens, and the vectors of its words.

    ``tokens`` may be an expression over the other columns, which is worked out where the
    rows of an id have met, so that what it is made from is shuffled and not the tokens.
    """
    spark = df.sparkSession
    if isinstance(tokens, str):
        df, tokens = df.select(id_col, tokens), F.col(tokens)
    # the window brings the rows of an id together, in no shuffle if they are already, and tells where the next begins
    met = df.withColumn("_nth", F.row_number().over(W.partitionBy(id_col).orderBy(id_col)))
    rows = met.select(F.col(id_col).alias("id"), (F.col("_nth") == 1).alias("first"), tokens.alias("tokens"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"part bigint, at int, words {kinds['tokens']}, id {kinds['id']}, codes array<int>, counts array<bigint>"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), BUCKETS_CORE * spark.sparkContext.defaultParallelism)
    packed = rows.mapInArrow(_pack(part_tokens or PART_TOKENS), schema)
    return PackedTokens(write_bucketed(packed, "token_counts", buckets, "part", compression="zstd"), id_col, buckets)


@dataclass
class _Piece:
    """Words of some rows: ``ids`` that begin there, and per word its id's number (-1 goes on with the piece before)."""

    ids: pa.Array
    words: pa.Array
    docs: np.ndarray
    codes: np.ndarray
    counts: np.ndarray | None = None


def _piece(batch: pa.RecordBatch) -> _Piece:
    ids, first, tokens = batch.columns
    begins = first.to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(tokens.flatten(), null_encoding="encode")
    docs = np.repeat(np.cumsum(begins) - 1, _sizes(tokens))
    return _Piece(ids.filter(first), coded.dictionary, docs, coded.indices.to_numpy())


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("int64")


def _counted(pieces: list[_Piece]) -> _Piece:
    """One piece with every word of an id once, ordered by id and word."""
    ids = pa.concat_arrays([p.ids for p in pieces])
    coded = pc.dictionary_encode(pa.concat_arrays([p.words for p in pieces]), null_encoding="encode")
    place, n = coded.indices.to_numpy(), max(len(coded.dictionary), 1)
    keys, ids_before, words_before = [], 0, 0
    for p in pieces:
        keys.append((p.docs + ids_before + 1) * n + place[words_before:][p.codes])
        ids_before, words_before = ids_before + len(p.ids), words_before + len(p.words)
    keys, counts = np.concatenate(keys), None
    if any(p.counts is not None for p in pieces):
        counts = np.concatenate([np.ones(len(p.codes), "int64") if p.counts is None else p.counts for p in pieces])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    else:
        keys.sort()
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(begins, append=len(keys)) if counts is None else np.add.reduceat(counts, begins) if len(keys) else counts
    docs, codes = np.divmod(keys[begins], n)
    return _Piece(ids, coded.dictionary, docs - 1, codes, counts)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, sizes)), pa.int32()), values)


def _pack(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``id, first, tokens``, those of an id in sequence, to the rows of ``PackedTokens``."""

    def told(part: int, pieces: list[_Piece]) -> Iterator[pa.RecordBatch]:
        whole = _counted(pieces)
        ids, words = whole.ids, whole.words

        def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
            kinds = {"part": pa.int64(), "at": pa.int32(), "words": pa.list_(words.type), "id": ids.type,
                     "codes": pa.list_(pa.int32()), "counts": pa.list_(pa.int64())}
            columns["part"] = pa.array(np.full(n, part))
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, k)) for c, k in kinds.items()], list(kinds))

        for start in range(0, len(words), WORDS_ROW):
            some = words.slice(start, WORDS_ROW)
            yield rows(1, at=pa.array([start], pa.int32()), words=_lists(some, np.array([len(some)])))
        begins = np.flatnonzero(np.diff(whole.docs, prepend=-1))
        ends = np.append(begins[1:], len(whole.docs))
        for some in (slice(k, k + ROWS) for k in range(0, len(begins), ROWS)):
            here, sizes = slice(begins[some][0], ends[some][-1]), ends[some] - begins[some]
            yield rows(
                len(sizes), id=ids.take(pa.array(whole.docs[begins[some]])),
                codes=_lists(pa.array(whole.codes[here], pa.int32()), sizes),
                counts=_lists(pa.array(whole.counts[here], pa.int64()), sizes),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pieces, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            before = np.cumsum(np.append(0, _sizes(batch.column("tokens"))))
            begins, at = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False)), 0
            while True:
                full = begins[(begins >= at) & (held + before[begins] - before[at] >= limit)]
                end = full[0] if len(full) else batch.num_rows
                pieces.append(_piece(batch.slice(at, end - at)))
                held, at = held + before[end] - before[at], end
                if not len(full):
                    break
                yield from told(part, pieces)
                part, pieces, held = part + 1, [], 0
            if len(pieces) > PIECES:
                pieces = [_counted(pieces)]
        if pieces:
            yield from told(part, pieces)

    return run


def token_counts(
    df: DataFrame | PackedTokens, table: DataFrame, id_col: str = "doc_id", tokens: str | Column = "tokens"
) -> DataFrame:
    """``id, token, n, vector``: the tokens of each row with their vectors from ``table`` (token, vector).

    A token without a vector keeps its row with a null one.  The words of a part are
    looked up once a part; rows of words are not shuffled.
    """
    packed = df if isinstance(df, PackedTokens) else pack_tokens(df, id_col, tokens)
    words = packed.words().select("part", "at", F.posexplode("tokens").alias("pos", "token"))
    asked = words.select("part", (F.col("at") + F.col("pos")).alias("code"), "token")
    known = table.select("token", V.doubles(F.col("vector")).alias("vector")).where(F.col("vector").isNotNull())
    replies = asked.join(known, "token").select("part", "code", "vector").repartition(packed.buckets, "part")
    with shuffles_removed(replies.sparkSession):
        vectors = write_bucketed(replies, "token_vectors", packed.buckets, "part", compression="zstd")

    def told(texts: pa.Table, replies: pa.Table) -> pa.Table:
        part = _Part(texts, replies)
        pairs, rows = part.pairs(unknown=True)
        values = pa.array(np.ascontiguousarray(part.vectors[:, rows[rows >= 0]].T).ravel())
        found = _lists(values, np.where(rows >= 0, len(part.vectors), 0))
        vectors = pc.if_else(pa.array(rows >= 0), found, pa.nulls(len(rows), found.type))
        return _batched(part.named(pairs) | {"vector": vectors})

    schema = f"id {packed.rows.schema['id'].dataType.simpleString()}, token {_token_type(packed)}, n bigint, vector array<double>"
    counted = _met(packed, vectors).applyInArrow(told, schema).withColumnRenamed("id", packed.id_col)
    counted._packed = packed, vectors
    return counted


def _token_type(packed: PackedTokens) -> str:
    return packed.rows.schema["words"].dataType.elementType.simpleString()


def _met(packed: PackedTokens, vectors: DataFrame):
    """The parts with their vectors; both tables are bucketed by part, so neither is shuffled."""
    return packed.rows.groupBy("part").cogroup(vectors.groupBy("part"))


def _batched(columns: dict[str, pa.Array]) -> pa.Table:
    table = pa.table(columns)
    return pa.Table.from_batches(table.to_batches(max_chunksize=ROWS), table.schema)


class _Part:
    """A part with its vectors, one a column of ``vectors``; ``docs, codes, counts`` have one entry per text and word."""

    def __init__(self, texts: pa.Table, replies: pa.Table):
        listed = texts.filter(pc.is_valid(texts["at"])).sort_by("at")
        told = texts.filter(pc.is_null(texts["at"]))
        self.words = pa.concat_arrays([c.flatten() for c in listed["words"].chunks])
        self.ids = told["id"].combine_chunks()
        codes = told["codes"].combine_chunks()
        self.codes, self.counts = codes.flatten().to_numpy(), told["counts"].combine_chunks().flatten().to_numpy()
        self.docs = np.repeat(np.arange(len(self.ids)), _sizes(codes))
        places, found = replies["code"].to_numpy(), replies["vector"].combine_chunks()
        if len(set(_sizes(found))) > 1:
            raise ValueError("vectors of different lengths")
        order, values = np.argsort(places, kind="stable"), found.flatten().to_numpy()
        self.vectors = np.ascontiguousarray(values.reshape(len(places), -1)[order].T) if len(places) else np.empty((0, 0))
        #: how many vectors a word has (one, if the table tells it once), and where they begin
        self.times = np.bincount(places, minlength=len(self.words))
        self.begins = np.cumsum(self.times) - self.times

    def pairs(self, unknown: bool) -> tuple[np.ndarray, np.ndarray]:
        """Entries and their columns of ``vectors``; with ``unknown``, -1 for entries that have none."""
        times = self.times[self.codes]
        shown = np.maximum(times, 1) if unknown else times
        pairs = np.repeat(np.arange(len(times)), shown)
        rows = self.begins[self.codes][pairs] + np.arange(len(pairs)) - (np.cumsum(shown) - shown)[pairs]
        return pairs, np.where(times[pairs] > 0, rows, -1)

    def named(self, pairs: np.ndarray) -> dict[str, pa.Array]:
        """``id, token, n`` of entries."""
        return {
            "id": self.ids.take(pa.array(self.docs[pairs])), "token": self.words.take(pa.array(self.codes[pairs])),
            "n": pa.array(self.counts[pairs]),
        }

    def pooled(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean vector of each text's known words, a text a column, and how many they are."""
        pairs, rows = self.pairs(unknown=False)
        docs, counts = self.docs[pairs], self.counts[pairs]
        n = np.zeros(len(self.ids), "int64")
        np.add.at(n, docs, counts)
        sums = [np.bincount(docs, v[rows] * counts, len(n)) for v in self.vectors]
        return np.array(sums).reshape(-1, len(n)) / np.maximum(n, 1), n


def pooled_tokens(counted: DataFrame, id_col: str = "doc_id", out: str = "embedding") -> DataFrame:
    """``id, embedding, n_tokens``: the mean vector of a row's tokens that have one.

    What ``token_counts`` returns is pooled where its parts are.  Of other rows the sums
    combine in each task, so a long row meets as one vector per task.
    """
    if packed := getattr(counted, "_packed", None):
        def told(texts: pa.Table, replies: pa.Table) -> pa.Table:
            part = _Part(texts, replies)
            means, n = part.pooled()
            known = np.flatnonzero(n)
            values = pa.array(np.ascontiguousarray(means[:, known].T).ravel())
            pooled = _lists(values, np.full(len(known), len(means)))
            return _batched({"id": part.ids.take(pa.array(known)), out: pooled, "n_tokens": pa.array(n[known])})

        schema = f"id {packed[0].rows.schema['id'].dataType.simpleString()}, {out} array<double>, n_tokens bigint"
        return _met(*packed).applyInArrow(told, schema).withColumnRenamed("id", id_col)
    known = counted.where(F.col("vector").isNotNull())
    mean = Summarizer.mean(array_to_vector("vector"), F.col("n").cast("double"))
    return known.groupBy(id_col).agg(vector_to_array(mean).alias(out), F.sum("n").alias("n_tokens"))


def token_attributions(
    df: DataFrame | PackedTokens,
    table: DataFrame,
    model: LogisticRegressionModel,
    target: int,
    id_col: str = "doc_id",
    tokens: str | Column = "tokens",
    n_steps: int = N_STEPS,
    batch: int = BATCH,
    counted: DataFrame | None = None,
) -> DataFrame:
    """What each token of a row adds to the probability of class ``target``.

    The model pools the token vectors of ``table`` by their mean and puts the head on top;
    the path runs from zero vectors of all tokens.  Mean pooling gives all tokens of a row
    one gradient, so a row's gradient is worked out once on its pooled vector, in the part
    that holds the row's tokens.

    Returns ``id, token, n, attribution, pred_class, pred_prob, attr_class, attr_prob,
    delta``, one row per row id and token; the attribution is that of all n occurrences.
    Attributions of an id add up to the gain in probability over the baseline, but for
    ``delta``.  Tokens without a vector are not pooled and have attribution 0 (in a row
    without any known token, all predictions are null); rows without tokens have none.
    Rows of one id count as one text.  ``counted`` is what ``token_counts`` gave for ``df``
    and ``table``, if it is at hand; else it is found here.
    """
    weights = np.asarray(model.coefficientMatrix.toArray(), dtype="float64")
    bias = np.asarray(model.interceptVector.toArray(), dtype="float64")
    if not hasattr(counted, "_packed"):
        counted = token_counts(df, table, id_col, tokens)
    packed, vectors = counted._packed

    def attributed(texts: pa.Table, replies: pa.Table) -> pa.Table:
        part = _Part(texts, replies)
        means, n = part.pooled()
        known = np.flatnonzero(n)
        gradients, numbers = np.zeros(means.shape), np.zeros((4, len(n)))
        for start in range(0, len(known), batch):
            some = known[start:start + batch]
            x = np.ascontiguousarray(means[:, some].T)
            gradient, probs, gain = _mean_gradient(x, weights, bias, target, n_steps)
            pred = probs.argmax(axis=1)
            gradients[:, some] = gradient.T
            numbers[:, some] = pred, probs[np.arange(len(pred)), pred], probs[:, target], (x * gradient).sum(axis=1) - gain
        pairs, rows = part.pairs(unknown=True)
        docs = part.docs[pairs]
        share = np.zeros(len(pairs))
        for v, g in zip(part.vectors, gradients) if len(known) else ():
            share += v[rows] * g[docs]
        share = np.where(rows >= 0, share * (part.counts[pairs] / np.maximum(n, 1)[docs]), 0.0)
        # of texts without a known word nothing is predicted
        unknown = (n == 0)[docs]
        told = dict(zip(("pred_class", "pred_prob", "attr_prob", "delta"), (pa.array(v[docs], mask=unknown) for v in numbers)))
        told["pred_class"] = told["pred_class"].cast("int64")
        return _batched(part.named(pairs) | {"attribution": pa.array(share)} | told)

    schema = (
        f"id {packed.rows.schema['id'].dataType.simpleString()}, token {_token_type(packed)}, n bigint, attribution double,"
        " pred_class bigint, pred_prob double, attr_prob double, delta double"
    )
    return _met(packed, vectors).applyInArrow(attributed, schema).select(
        F.col("id").alias(packed.id_col), "token", "n", "attribution", "pred_class", "pred_prob",
        F.lit(target).cast("bigint").alias("attr_class"), "attr_prob", "delta",
    )
