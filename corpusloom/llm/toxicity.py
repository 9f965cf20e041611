"""Toxic spans by a linear-chain conditional random field, and document scores from them.

Only documents carry labels, so tokens are labelled first: in a bounded sample of labelled
documents without near copies, a token of a toxic document is toxic if its word, or one of
its leading pieces, is far more common in toxic than in clean documents.  The field is
trained on these tokens; its forward-backward marginals over a whole text give the
offending spans, and a logistic function of their largest value, sum and number gives the
score of the document.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import as_bytes, fresh
from corpusloom.llm.crf import ChainCrf
from corpusloom.llm.decontam import TO_WORDS
from corpusloom.llm.wordhash import U, hasher
from corpusloom.session import local_table

BUCKETS = 1 << 18
CUTS = (3, 4, 5, -4)
#: A chain is cut after so many tokens.
CHAIN = 64
#: Labelled rows of each class that the model learns from.
ROWS_PER_CLASS = 1000
#: Bytes of whole texts of each class that it learns from, one text at least.
BYTES_PER_CLASS = 32 << 20
MIN_DOCUMENTS, MIN_RATIO = 8, 15.0
SPAN_AT = 0.5


def _tokens(texts: list[bytes]):
    """Start and end bytes in the joined texts, features, and each text's first token."""
    starts, ends, whole, *pieces, begins = hasher().pieces(texts, CUTS, TO_WORDS)
    columns = [whole, *pieces]
    features = np.stack([(c >> U(40 - k)) & U(BUCKETS - 1) for k, c in enumerate(columns)], 1).astype(np.int32)
    return starts, ends, columns, features, begins


def _chains(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token and length of every chain."""
    sizes = np.diff(begins)
    counts = -(-sizes // CHAIN)
    firsts = np.repeat(begins[:-1], counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    firsts = firsts + CHAIN * number
    lengths = np.minimum(CHAIN, np.repeat(begins[1:], counts) - firsts)
    return firsts, lengths


def _padded(values: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.zeros((len(firsts), CHAIN, *values.shape[1:]), values.dtype)
    live = np.arange(CHAIN)[None] < lengths[:, None]
    out[live] = values[(firsts[:, None] + np.arange(CHAIN))[live]]
    return out


def _unlike(hashes: list[np.ndarray]) -> list[int]:
    """Indices of documents that are not near copies of an earlier one (half of their words shared)."""
    kept: dict[tuple[int, int], list[int]] = {}
    out = []
    for k, words in enumerate(hashes):
        keys = [(0, int(words[0])), (1, int(words[np.argmin(words * U(0xDA942042E4DD58B5))]))] if len(words) else []
        near = {j for key in keys for j in kept.get(key, [])[-20:]}
        if all(2 * len(np.intersect1d(words, hashes[j], True)) < min(len(words), len(hashes[j])) for j in near):
            out.append(k)
            for key in keys:
                kept.setdefault(key, []).append(k)
    return out


class ToxicModel:
    def __init__(self):
        self.crf = ChainCrf(BUCKETS)
        self.logistic = np.zeros(5)
        self.base = 0.0

    def marginals(self, texts: list[bytes]):
        starts, ends, _, features, begins = _tokens(texts)
        firsts, lengths = _chains(begins)
        p = np.zeros(len(starts))
        scores = self.crf.emissions(features) if len(features) else p
        for at in range(0, len(firsts), 1 << 14):
            f, n = firsts[at : at + (1 << 14)], lengths[at : at + (1 << 14)]
            got = self.crf.marginals(_padded(scores, f, n), n)
            live = np.arange(CHAIN)[None] < n[:, None]
            p[(f[:, None] + np.arange(CHAIN))[live]] = got[live]
        return starts, ends, begins, p

    @staticmethod
    def evidence(p: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Per document: 1, the logit of the largest marginal, and logs of their sum, number and share."""
        out = np.zeros((len(begins) - 1, 5))
        out[:, 0] = 1
        strong = np.where(p > 0.1, p, 0)
        totals = np.concatenate([[0], np.cumsum(strong)])
        many = np.concatenate([[0], np.cumsum(p > SPAN_AT)])
        top = np.full(len(out), 1e-6)
        sizes = np.diff(begins)
        full = np.flatnonzero(sizes)
        if len(full):
            top[full] = np.maximum(np.maximum.reduceat(p, begins[:-1][full]), 1e-6)
        top = np.minimum(top, 1 - 1e-6)
        out[:, 1] = np.log(top / (1 - top)) / 5
        out[:, 2] = np.log1p(totals[begins[1:]] - totals[begins[:-1]])
        out[:, 3] = np.log1p(many[begins[1:]] - many[begins[:-1]])
        out[:, 4] = out[:, 2] / np.log(sizes + 10.0)
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.logistic, -30, 30)))


def train(texts: list[bytes], toxic: list[int], clean_weight: float = 1.0, seed: int = 7) -> ToxicModel:
    """A model from labelled texts; ``clean_weight`` is how many clean rows a sampled one stands for."""
    model = ToxicModel()
    if not texts:
        return model
    starts, _, columns, features, begins = _tokens(texts)
    truth = np.array(toxic)
    words = [np.unique(columns[0][b:e]) for b, e in zip(begins[:-1], begins[1:])]
    chosen = _unlike(words)
    owner = np.repeat(np.arange(len(texts)), np.diff(begins))
    use = np.zeros(len(texts), bool)
    use[chosen] = True
    n_toxic, n_clean = int((use & (truth == 1)).sum()), int((use & (truth == 0)).sum())
    marked = np.zeros(len(starts), bool)
    for column in columns:
        kept = np.flatnonzero(use[owner])
        names, inverse = np.unique(column[kept], return_inverse=True)
        seen = np.unique(inverse.astype(np.int64) * len(texts) + owner[kept])
        name, doc = seen // len(texts), seen % len(texts)
        a = np.bincount(name[truth[doc] == 1], minlength=len(names))
        b = np.bincount(name[truth[doc] == 0], minlength=len(names))
        ratio = ((a + 0.5) / (n_toxic + 1)) / ((b + 0.5) / (n_clean + 1))
        bad = names[(a >= MIN_DOCUMENTS) & (ratio >= MIN_RATIO)]
        marked |= np.isin(column, bad)
    labels = (marked & (truth[owner] == 1)).astype(np.int64) if len(owner) else np.zeros(0, np.int64)
    firsts, lengths = _chains(begins)
    if len(firsts):
        rng = np.random.default_rng(seed)
        holds = np.add.reduceat(labels, firsts) > 0
        sure = holds | (rng.random(len(firsts)) < max(0.05, min(1.0, 2.0 * holds.sum() / len(firsts))))
        # a marked-looking token in a clean document teaches that it is clean
        sure |= (np.add.reduceat(marked.astype(np.int64), firsts) > 0) & use[owner[firsts]]
        f, n = firsts[sure], lengths[sure]
        padded, truths = _padded(features, f, n), _padded(labels, f, n)
        # the fit takes as much memory again as what is no longer needed
        del starts, columns, column, words, owner, use, kept, inverse, seen, name, doc, marked, features, labels
        del firsts, lengths, holds, sure, f
        model.crf.fit(padded, truths, n)
        del padded, truths
    _, _, begins, p = model.marginals(texts)
    x = model.evidence(p, begins)
    weight = np.where(truth == 1, 1.0, clean_weight)
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps of a penalised logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (q - truth)) + 1e-2 * w
        curve = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    model.logistic = w
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows_per_class: int = ROWS_PER_CLASS,
        id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> ToxicModel:
    """Train on at most ``rows_per_class`` labelled rows of each class, chosen by a hash.

    ``learn`` says which rows may teach.  Rows without a text or a 0/1 label teach nothing.
    Of an id with several texts the one with the smallest hash teaches.  Whole texts of a
    class are taken up to BYTES_PER_CLASS, one at least.
    """
    named = labels.select(F.col(id_column), F.col(label_column).cast("int").alias("_label")).where("_label in (0, 1)")
    known = named.where(learn).distinct()
    totals = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    u = F.pmod(F.xxhash64(F.lit("toxic"), F.col(id_column)), F.lit(1 << 30))
    rate = {k: int(min(1.0, rows_per_class / max(1, n)) * (1 << 30)) for k, n in totals.items()}
    some = known.where(u < F.when(F.col("_label") == 1, rate.get(1, 0)).otherwise(rate.get(0, 0)))
    # the ids of the sample are few; only their texts reach the driver
    kind = some.schema[id_column].dataType.simpleString()
    ids = [tuple(r) for r in some.limit(3 * rows_per_class).collect()]
    sample = local_table(docs.sparkSession, ids, f"_sample_id {kind}, _label int")
    texts = docs.where(F.col(text_column).isNotNull()).join(sample, F.col(id_column) == F.col("_sample_id"))
    texts = texts.select("_sample_id", "_label", F.xxhash64(text_column).alias("_hash"), F.col(text_column).alias("_text"))
    first = F.min(F.struct("_hash", F.octet_length("_text").alias("size")))
    chosen, taken = [], {}
    found = (tuple(r) for r in texts.groupBy("_sample_id", "_label").agg(first).collect())
    for sample_id, label, (hashed, size) in sorted(found, key=lambda r: (*r[2], r[0])):
        if label not in taken or taken[label] + size <= BYTES_PER_CLASS:
            taken[label] = taken.get(label, 0) + size
            chosen.append((sample_id, label, hashed))
    named = local_table(docs.sparkSession, chosen, f"_sample_id {kind}, _label int, _hash long")
    keys = ["_sample_id", "_label", "_hash"]
    told = texts.join(named, keys).dropDuplicates(keys).select("_sample_id", "_label", "_text")
    rows = sorted(tuple(r) for r in told.collect())
    n = {k: sum(1 for r in rows if r[1] == k) for k in (0, 1)}
    weight = (totals.get(0, 0) / max(1, n[0])) / max(1e-9, totals.get(1, 0) / max(1, n[1])) if n[1] else 1.0
    return train([as_bytes(r[2]) for r in rows], [r[1] for r in rows], weight)


@lru_cache(maxsize=1)
def _loaded(packed: bytes) -> ToxicModel:
    return pickle.loads(packed)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
SPANS = "array<struct<start:long,end:long,p:double>>"


def _spans(text: bytes, starts: np.ndarray, ends: np.ndarray, p: np.ndarray) -> list[dict]:
    """Character offsets of runs of toxic tokens; p is the largest marginal of a run."""
    out, at, chars = [], 0, 0
    hot = np.flatnonzero(p > SPAN_AT)
    for run in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1) if len(hot) else ():
        place = []
        for byte in (int(starts[run[0]]), int(ends[run[-1]])):
            chars += len(text[at:byte].decode("utf-8", "replace"))
            at = byte
            place.append(chars)
        out.append({"start": place[0], "end": place[1], "p": float(p[run].max())})
    return out


def _scorer(packed, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(packed.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [as_bytes(t) for t in part.column(part.num_columns - 1).to_pylist()]
                starts, ends, begins, p = model.marginals(texts)
                scores = model.score(model.evidence(p, begins))
                offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
                spans = []
                for k, text in enumerate(texts):
                    b, e = begins[k], begins[k + 1]
                    hot = b < e and p[b:e].max() > SPAN_AT
                    spans.append(_spans(text, starts[b:e] - offset[k], ends[b:e] - offset[k], p[b:e]) if hot else [])
                others = part.columns if keep_text else part.columns[:-1]
                names = part.schema.names if keep_text else part.schema.names[:-1]
                arrays = [pa.array(scores, pa.float64()), pa.array(spans, _SPANS)]
                yield pa.record_batch([*others, *arrays], names=[*names, "score", "spans"])

    return run


def score(docs: DataFrame, model: ToxicModel, text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (the text only with ``keep_text``) plus ``score`` and ``spans``.

    ``score`` is the probability that the text is labelled toxic; ``spans`` are character
    offsets of runs of toxic tokens with their largest marginal.  Null and empty texts
    score like a text without evidence and have no spans.  Columns named ``score`` or
    ``spans`` are replaced.
    """
    text = text_column if keep_text else fresh("text")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in (text_column, "score", "spans")],
        F.col(text_column).cast("string").alias(text))
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # a fixed number of weights
    kept = rows.schema.fields if keep_text else rows.schema.fields[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"score double, spans {SPANS}"])
    return rows.mapInArrow(_scorer(packed, keep_text), schema)
