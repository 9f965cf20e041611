"""Labelling by a pluggable scorer: prompt, generate, parse, validate, retry."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import templates
from corpusloom.functions import text as X
from corpusloom.operators import fewshot, prompts
from corpusloom.operators.classes import class_rows
from corpusloom.session import write_through

#: Makes, once per Python worker, a function from a batch of prompts to completions.
ScorerFactory = Callable[..., Callable[[pd.Series], pd.Series]]
#: Bytes of requests that a scorer is given at once.
REQUEST_BYTES = 8 * 2**20


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with at most ``most`` bytes in a column; a longer row is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype("int64"))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        upto = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(begin, upto - begin)
        begin = upto


def _answers(requests: pd.Series, answer: Callable[[pd.Series], pd.Series], prefix: str = "") -> pa.Array:
    asked = requests.to_frame("request")
    told = asked.assign(completion=answer(prefix + requests if prefix else requests))
    return pa.Array.from_pandas(told["completion"], type=pa.string())


def generate(df: DataFrame, scorer: ScorerFactory, request: str = "prompt", **sampling: Any) -> DataFrame:
    """``df`` with the scorer's ``completion`` of each request.

    The scorer is made once per task and sees slices of Arrow batches of at most
    ``REQUEST_BYTES`` of requests.  Pass only the columns the answer is parsed with; the
    rest joins back by id.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = scorer(**sampling)
        for batch in batches:
            for part in _slices(batch, request, REQUEST_BYTES):
                told = _answers(part.column(request).to_pandas(), answer)
                yield pa.record_batch([*part.columns, told], names=[*part.schema.names, "completion"])

    return df.mapInArrow(run, f"{fields}, completion string")


def map_text(df: DataFrame, scorer: ScorerFactory, prefix: str = templates.TRANSLATE_PREFIX,
             text: str = "text", **sampling: Any) -> DataFrame:
    """``df`` with its text column replaced by the scorer's output, all else unchanged."""
    sampling = {"max_new_tokens": 1024, **sampling}
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = scorer(**sampling)
        for batch in batches:
            for part in _slices(batch, text, REQUEST_BYTES):
                told = _answers(part.column(text).to_pandas(), answer, prefix)
                columns = [told if name == text else c for name, c in zip(part.schema.names, part.columns)]
                yield pa.record_batch(columns, names=part.schema.names)

    return df.mapInArrow(run, schema)


# -- parsers: (prompt, completion) -> columns ---------------------------------

def validate(
    raw: Column, allowed: Sequence[str] | None, whole: Column | None = None
) -> tuple[Column, Column]:
    """``(label_pred, status)``: an exact match with an allowed label, or marked invalid.

    Without allowed labels every answer is valid.
    """
    known = raw.isNotNull() if allowed is None else F.coalesce(raw.isin(list(allowed)), F.lit(False))
    marked = X.invalid_label(raw if whole is None else whole)
    return F.when(known, raw).otherwise(marked), known


def answer_suffix(prompt: Column, completion: Column, allowed: Sequence[str] | None) -> tuple[Column, Column]:
    """The answer is all that follows the prompt."""
    generated = F.concat(prompt, completion)
    return validate(X.parse_suffix(prompt, generated), allowed)


def answer_category(prompt: Column, completion: Column, allowed: Sequence[str] | None) -> tuple[Column, Column]:
    """The answer is the first category line of prompt and completion together."""
    generated = F.concat(prompt, completion)
    return parse_generated(generated, allowed)


def answer_category_da(prompt: Column, completion: Column, allowed: Sequence[str] | None) -> tuple[Column, Column]:
    """As ``answer_category``, with the Danish mark."""
    return parse_generated(F.concat(prompt, completion), allowed, templates.CATEGORY_PATTERN_DA)


def parse_generated(
    generated: Column, allowed: Sequence[str] | None, pattern: str = templates.CATEGORY_PATTERN
) -> tuple[Column, Column]:
    found = X.parse_category(generated, pattern)
    label, status = validate(found, allowed, whole=generated)
    return F.when(found.isNull(), X.invalid_match(generated)).otherwise(label), status


def answer_message(prompt: Column, completion: Column, allowed: Sequence[str] | None) -> tuple[Column, Column]:
    """The answer is the content of the last message, which the scorer wrote."""
    return validate(completion, allowed)


def last_messages(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """``conv_id, role, content`` of the last turn; a long conversation is never gathered."""
    last = F.max_by(F.struct("role", F.col("text").alias("content")), "turn")
    return turns.groupBy(conversation).agg(last.alias("m")).select(conversation, "m.*")


@dataclass(frozen=True)
class Strategy:
    """How a model family is asked and how its answer is read."""

    template: Callable[[Column, Sequence[str], Column], Column]
    parser: Callable[[Column, Column, Sequence[str] | None], tuple[Column, Column]]
    sampling: dict[str, Any] = field(default_factory=lambda: dict(templates.SAMPLING_COMPLETION))

    def prompt(self, query: Column, labels: Sequence[str], examples: Column) -> Column:
        return self.template(query, labels, examples)


def _chat(query: Column, labels: Sequence[str], examples: Column) -> Column:
    return prompts.render_messages(prompts.prompt_messages(query, labels, examples))


STRATEGIES = {
    "inst": Strategy(prompts.prompt_inst, answer_suffix),
    "im": Strategy(prompts.prompt_im, answer_suffix),
    "inquiry": Strategy(prompts.prompt_inquiry, answer_category),
    "inquiry_da": Strategy(prompts.prompt_inquiry_da, answer_category_da),
    "messages": Strategy(_chat, answer_message, dict(templates.SAMPLING_CHAT)),
}


def validate_labels(df: DataFrame, classes: DataFrame, label: str = "label_pred") -> DataFrame:
    """Check a label column against the class table: bad labels are marked, status false."""
    names = classes.select(F.col("label_text").alias(label), F.lit(True).alias("_known"))
    checked = df.join(names, label, "left")
    known = F.coalesce("_known", F.lit(False))
    return checked.withColumns(
        {label: F.when(known, F.col(label)).otherwise(X.invalid_label(F.col(label))), "status": known}
    ).drop("_known")


def build_prompts(
    queries: DataFrame, shots: DataFrame | None, labels: Sequence[str], strategy: Strategy,
    query_id: str = "query_id",
) -> DataFrame:
    """``query_id, text, prompt`` for queries with ``query_id, text``."""
    if shots is None:
        none = F.lit(None).cast("array<struct<example:string,label_text:string>>")
        asked = queries.withColumn("examples", none)
    else:
        asked = queries.join(fewshot.examples_array(shots, query_id), query_id, "left")
    prompt = strategy.prompt(F.col("text"), labels, F.col("examples"))
    return asked.select(query_id, "text", prompt.alias("prompt"))


def label_once(
    queries: DataFrame, pool: DataFrame | None, texts: DataFrame, classes: DataFrame, labels: Sequence[str],
    strategy: Strategy, scorer: ScorerFactory, n: int, attempt: int = 0, n_queries: int | None = None,
    id_col: str = "doc_id", on_short: str = "error", rows_per_task: int | None = None, check: bool = True,
) -> DataFrame:
    """One round: ``query_id, label_pred, status, attempt, text``.

    The text stays only with the rows that have to be asked again.  Spark sizes tasks
    by bytes; for a slow scorer ``rows_per_task`` bounds the prompts of one task.  With
    ``check=False`` any answer that can be read is valid.
    """
    if n_queries is None:
        n_queries = queries.count()
    shots = None
    if n > 0:
        shots = fewshot.few_shot_sample(
            pool, classes, queries.select("query_id"), n, attempt, on_short, n_queries=n_queries
        )
        shots = fewshot.with_examples(shots, texts, pool, classes, n, n_queries, id_col)
    asked = build_prompts(queries, shots, labels, strategy)
    if rows_per_task is not None:
        asked = asked.repartition(max(1, math.ceil(n_queries / rows_per_task)), "query_id")
    answered = generate(asked, scorer, **strategy.sampling)
    label, status = strategy.parser(F.col("prompt"), F.col("completion"), labels if check else None)
    return answered.select(
        "query_id",
        label.alias("label_pred"),
        status.alias("status"),
        F.lit(attempt).cast("bigint").alias("attempt"),
        F.when(~status, F.col("text")).alias("text"),
    )


def label_with_retry(
    queries: DataFrame,
    train: DataFrame,
    texts: DataFrame,
    classes: DataFrame,
    strategy: Strategy,
    scorer: ScorerFactory,
    n: int = 2,
    max_retry: int = 5,
    labels: Sequence[str] | None = None,
    id_col: str = "doc_id",
    on_short: str = "error",
    n_queries: int | None = None,
    rows_per_task: int | None = None,
    check: bool = True,
) -> DataFrame:
    """Ask up to ``max_retry`` times, each time only the rows still without a valid label.

    ``queries`` has ``query_id, text``, ``train`` has ``id, label_code, label_text`` and
    ``texts`` the texts by id; ``classes`` holds the train counts.  ``labels``
    are the allowed answers in the order the prompt lists them (code order if not given).  A round is written once before it
    is split, so a scorer that answers differently each time is asked once per row and
    round.  The last answer of a row is the one kept.
    """
    if max_retry < 1:
        raise ValueError("ask at least once")
    if labels is None:
        labels = [r["label_text"] for r in class_rows(classes)]
    pool = write_through(fewshot.shot_pool(train, id_col, classes=classes), "pool") if n > 0 else None
    left = queries.select("query_id", "text")
    result = None
    for attempt in range(max_retry):
        done = write_through(
            label_once(
                left, pool, texts, classes, labels, strategy, scorer, n, attempt, n_queries,
                id_col, on_short, rows_per_task, check,
            ),
            f"answers{attempt}",
        )
        last = attempt + 1 == max_retry
        kept = (done if last else done.filter("status")).drop("text")
        result = kept if result is None else result.unionByName(kept)
        if not last:
            left = done.filter(~F.col("status")).select("query_id", "text")
            n_queries = left.count()
            if n_queries == 0:
                break
    return result


# -- built-in scorers, deterministic in the prompt ----------------------------

def echo_scorer(labels: Sequence[str], end: str = "", invalid_percent: int = 0, opening: str = "") -> ScorerFactory:
    """Answers with a label picked by the prompt's hash; some answers are no label."""
    import hashlib

    names = list(labels)

    def factory(**_: Any) -> Callable[[pd.Series], pd.Series]:
        def one(prompt: str) -> str:
            digest = hashlib.md5(prompt.encode("utf-8")).hexdigest()
            if int(digest[:8], 16) % 100 < invalid_percent:
                return f"{opening}maybe{end}"
            return f"{opening}{names[int(digest[8:16], 16) % len(names)]}{end}"

        return lambda batch: batch.map(one)

    return factory


def template_scorer(template: str) -> ScorerFactory:
    """Answers with ``template`` formatted with the request."""
    def factory(**_: Any) -> Callable[[pd.Series], pd.Series]:
        return lambda batch: batch.map(lambda request: template.format(request))

    return factory
