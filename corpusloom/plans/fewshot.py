"""Queries on few-shot draws, prompts and labelling rounds."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import templates as t
from corpusloom.functions.hashing import md5_key
from corpusloom.operators import classes as C
from corpusloom.operators import fewshot as S
from corpusloom.operators import head as H
from corpusloom.operators import labelling as L
from corpusloom.operators import prompts as P
from corpusloom.plans import corpus as base
from corpusloom.plans.sql import big, key, text, with_ctes
from corpusloom.sources import derived as D


class Inputs(NamedTuple):
    train: DataFrame  # doc_id, label, label_code, label_text
    texts: DataFrame  # doc_id, text
    classes: DataFrame  # counted on the train rows
    queries: DataFrame  # query_id: the eval rows
    n_queries: int

    def pool(self) -> DataFrame:
        return S.shot_pool(self.train, classes=self.classes)

    def draw(self, pool: DataFrame, n: int, attempt: int = 0) -> DataFrame:
        return S.few_shot_sample(
            pool, self.classes, self.queries, n, attempt, on_short="all", n_queries=self.n_queries
        )

    def examples(self, n: int) -> DataFrame:
        pool = self.pool()
        return S.with_examples(self.draw(pool, n), self.texts, pool, self.classes, n, self.n_queries)


def _inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    loaded = base.load(spark, sf_dir)
    queries = loaded.part("eval").select(F.col("doc_id").alias("query_id"))
    texts = D.table(spark, sf_dir, "documents").select("doc_id", "text")
    return Inputs(loaded.part("train"), texts, loaded.train_classes, queries, loaded.sizes["eval"])


def _with_text(x: Inputs) -> DataFrame:
    return x.queries.join(x.texts.withColumnRenamed("doc_id", "query_id"), "query_id")


def _prompt_labels(train: DataFrame) -> list[str]:
    """Labels as the prompt lists them: by first appearance in the shuffled train rows."""
    shuffled = train.select("label", md5_key("split42", "doc_id").alias("h"))
    return C.label_list(shuffled, "h")


def _draw(spark, sf_dir, n, attempt):
    x = _inputs(spark, sf_dir)
    return x.draw(x.pool(), n, attempt).drop("label_text")


def few_shot_sample(spark, sf_dir):
    return _draw(spark, sf_dir, 2, 0)


def few_shot_retry(spark, sf_dir):
    return _draw(spark, sf_dir, 3, 1)


def _asked(spark, sf_dir, n=2):
    x = _inputs(spark, sf_dir)
    examples = S.examples_array(x.examples(n))
    return _with_text(x).join(examples, "query_id", "left"), _prompt_labels(x.train)


def _prompt(builder):
    def run(spark, sf_dir):
        asked, labels = _asked(spark, sf_dir)
        prompt = builder(F.col("text"), labels, F.col("examples"))
        return asked.select("query_id", prompt.alias("p")).select(
            "query_id", F.char_length("p").cast("bigint").alias("n_chars"), F.md5("p").alias("prompt_md5")
        )

    run.__name__ = builder.__name__
    return run


def prompt_messages(spark, sf_dir):
    asked, labels = _asked(spark, sf_dir)
    messages = P.prompt_messages(F.col("text"), labels, F.col("examples"))
    return (
        asked.select("query_id", F.posexplode(messages).alias("pos", "m"))
        .select("query_id", F.col("pos").cast("bigint").alias("pos"), "m.role", F.md5("m.content").alias("content_md5"))
    )


#: Share of answers of the built-in scorer that are no label, in percent.
_INVALID = 30


def label_by_scorer(spark, sf_dir):
    x = _inputs(spark, sf_dir)
    labels = _prompt_labels(x.train)
    scorer = L.echo_scorer(labels, "", _INVALID)
    answers = L.label_once(
        _with_text(x), x.pool(), x.texts, x.classes, labels, L.STRATEGIES["inst"], scorer, 1,
        n_queries=x.n_queries, on_short="all",
    )
    return answers.drop("attempt", "text")


def label_with_retry(spark, sf_dir):
    x = _inputs(spark, sf_dir)
    labels = _prompt_labels(x.train)
    scorer = L.echo_scorer(labels, "\n###", _INVALID, opening="\nCategory: ")
    answers = L.label_with_retry(
        _with_text(x), x.train, x.texts, x.classes, L.STRATEGIES["inquiry"], scorer,
        n=2, max_retry=5, labels=labels, on_short="all", n_queries=x.n_queries,
    )
    return answers.select("query_id", F.md5("label_pred").alias("label_md5"), "status", "attempt")


def encode_hash(spark, sf_dir):
    rows = D.corpus(spark, sf_dir).select("doc_id", "text")
    _, encoded = H.hash_encoder(rows)
    values = H.vector_to_array("features")
    return encoded.select(
        "doc_id",
        F.size(F.filter(values, lambda x: x > 0)).cast("bigint").alias("n_dims"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


QUERIES = {
    "few_shot_sample": few_shot_sample,
    "few_shot_retry": few_shot_retry,
    **{b.__name__: _prompt(b) for b in (P.prompt_inst, P.prompt_im, P.prompt_inquiry, P.prompt_inquiry_da)},
    "prompt_messages": prompt_messages,
    "label_by_scorer": label_by_scorer,
    "label_with_retry": label_with_retry,
    "encode_hash": encode_hash,
}

# -- SQL twins -----------------------------------------------------------------

_POOL = f"""select label_code, label_text, doc_id as train_id, replace(text, chr(10), ' ') as example,
  row_number() over (partition by label_code order by {key('pool42', 'doc_id')}, doc_id) - 1 as pos from train"""
_QUERY = "select doc_id as query_id, text from splits where split = 'eval'"


def _shots(n: int, attempt: str = "0", source: str = "asked") -> str:
    """Floyd's sampling with one column a draw."""
    def number(k):
        digest = big(f"md5(concat('draw', {attempt}, ':', query_id, ':', label_code, ':', {k}))")
        return f"({digest}) % greatest(n - least({n}, n) + {k} + 1, 1)"

    drawn = ["{0} as t0, t0 as p0".format(number(0))]
    for k in range(1, n):
        before = ", ".join(f"p{i}" for i in range(k))
        drawn.append(f"{number(k)} as t{k}, case when t{k} in ({before}) then n - least({n}, n) + {k} else t{k} end as p{k}")
    places = ", ".join(f"p{k}" for k in range(n))
    return f"""
select d.query_id, d.attempt, d.label_code, d.k, p.train_id, p.example, p.label_text
from (select query_id, attempt, label_code, k, list_extract([{places}], cast(k + 1 as bigint)) as pos
  from (select query_id, {attempt} as attempt, label_code, n, {", ".join(drawn)} from {source}, train_classes),
    (select unnest(range({n})) as k) where k < n) d
join pool p on p.label_code = d.label_code and p.pos = d.pos"""


_LABELS = f"""select string_agg(label, chr(10) order by h) as names, list(label order by h) as listed
from (select label, min({key('split42', 'doc_id')}) as h from train group by label)"""


def _lines(expr: str) -> str:
    """Examples of each query and attempt, joined in class and draw order."""
    return f"""select query_id, attempt, string_agg({expr}, '' order by label_code, k) as lines
from (select *, row_number() over (partition by query_id, attempt order by label_code, k) as i from shots)
group by query_id, attempt"""


def _style(name: str) -> tuple[str, str]:
    """Example line and whole prompt of a style, over ``text``, ``names`` and ``lines``."""
    if name == "inst":
        line = (f"case when i = 1 then '' else '[INST]' end, {text(chr(10) + t.CATEGORIZE)}, example,"
                f" {text(chr(10) + '[/INST]')}, label_text, '</s>'")
        whole = (f"{text('<s>[INST]' + t.ROLE_INST + t.TASK_CATEGORIES)}, names, {text(t.RULES)}, coalesce(lines, '[/INST]'),"
                 f" {text('[INST]' + chr(10) + t.CATEGORIZE)}, text, {text(chr(10) + '[/INST]')}")
    elif name == "im":
        question = text("\n<|im_start|> question\n" + t.CATEGORIZE)
        answer = text("\n<|im_end|>\n<|im_start|> answer\n")
        line = f"{question}, example, {answer}, label_text, '<|im_end|>'"
        whole = (f"{text('<|im_start|> system' + chr(10) + t.ROLE + t.TASK_CATEGORIES)}, names,"
                 f" {text(t.RULES + '<|im_end|>')}, coalesce(lines, ''), {question}, text, {answer}")
    else:
        danish = name == "inquiry_da"
        header, rules, opening = (
            (t.ROLE_DA, t.RULES_DA, t.EXAMPLES_DA) if danish else (t.ROLE + t.TASK_INQUIRY, t.RULES, t.EXAMPLES)
        )
        inquiry, category = ("Forespørgsel: ", "\nKategori: ") if danish else ("Inquiry: ", "\nCategory: ")
        line = f"{text(inquiry)}, example, {text(category)}, label_text, chr(10)"
        block = f"coalesce(concat({text(opening)}, lines, {text('###' + chr(10) + chr(10))}), '')"
        whole = (f"{text(header)}, names, {text(rules)}, {block},"
                 f" {text('<<<' + chr(10) + inquiry)}, text, {text(chr(10) + '>>>')}")
    return f"concat({line})", f"concat({whole})"


def _prompts(style: str, n: int, attempts: int = 1) -> dict[str, str]:
    """CTEs up to ``prompts(query_id, attempt, p)``."""
    line, whole = _style(style)
    asked = f"select q.*, a.attempt from ({_QUERY}) q, (select unnest(range({attempts})) as attempt) a"
    return {
        "pool": _POOL,
        "asked": asked,
        "shots": _shots(n, "attempt"),
        "labels": _LABELS,
        "joined": _lines(line),
        "prompts": f"select a.query_id, a.attempt, {whole} as p from asked a left join joined j"
                   " on j.query_id = a.query_id and j.attempt = a.attempt cross join labels",
    }


def _prompt_oracle(style: str) -> str:
    return with_ctes(
        "train train_classes",
        "select query_id, length(p) as n_chars, md5(p) as prompt_md5 from prompts", **_prompts(style, 2),
    )


def _draw_oracle(n: int, attempt: int) -> str:
    return with_ctes(
        "train train_classes", "select query_id, label_code, k, train_id from shots",
        pool=_POOL, asked=_QUERY, shots=_shots(n, str(attempt)),
    )


_SPEECH = f"{text(t.CATEGORIZE)}"
_MESSAGES = f"""
select query_id, 0 as pos, 'system' as role,
  md5(concat({text(t.ROLE + t.TASK_CATEGORIES)}, names, {text(t.RULES)})) as content_md5 from asked, labels
union all
select query_id, 2 * i - 1, 'user', md5(concat({_SPEECH}, example)) from numbered
union all
select query_id, 2 * i, 'assistant', md5(label_text) from numbered
union all
select a.query_id, 2 * (select count(*) from numbered n where n.query_id = a.query_id) + 1, 'user',
  md5(concat({_SPEECH}, text)) from asked a"""

_DIGEST = "md5(p)"
_ANSWER = (
    f"case when {big(_DIGEST, 8)} % 100 < {_INVALID} then 'maybe'"
    f" else listed[cast(concat('0x', substr({_DIGEST}, 9, 8)) as bigint) % len(listed) + 1] end"
)

ORACLES = {
    "few_shot_sample": _draw_oracle(2, 0),
    "few_shot_retry": _draw_oracle(3, 1),
    **{f"prompt_{s}": _prompt_oracle(s) for s in ("inst", "im", "inquiry", "inquiry_da")},
    "prompt_messages": with_ctes(
        "train train_classes", f"select * from ({_MESSAGES})",
        pool=_POOL, asked=_QUERY, shots=_shots(2), labels=_LABELS,
        numbered="select *, row_number() over (partition by query_id order by label_code, k) as i from shots",
    ),
    "label_by_scorer": with_ctes(
        "train train_classes",
        "select query_id, case when a = 'maybe' then concat('INVALID LABEL: ', a) else a end as label_pred,"
        f" a <> 'maybe' as status from (select query_id, {_ANSWER} as a from prompts, labels)",
        **_prompts("inst", 1),
    ),
    "label_with_retry": with_ctes(
        "train train_classes",
        "select query_id, md5(case when status then a else concat('INVALID LABEL: ', p, chr(10), 'Category: ', a,"
        " chr(10), '###') end) as label_md5, status, attempt from answered"
        " qualify row_number() over (partition by query_id order by case when status then attempt else 99 end,"
        " attempt desc) = 1",
        **_prompts("inquiry", 2, attempts=5),
        answered=f"select query_id, attempt, p, a, a <> 'maybe' as status"
                 f" from (select query_id, attempt, p, {_ANSWER} as a from prompts, labels)",
    ),
}
