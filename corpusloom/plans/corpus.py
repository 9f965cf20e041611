"""Queries on the labelled corpus: load, encode, split, weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import templates
from corpusloom.functions import text as X
from corpusloom.operators import classes as C
from corpusloom.operators import splits
from corpusloom.plans.sql import key, text, with_ctes
from corpusloom.session import shared_path
from corpusloom.sources import corpus as S
from corpusloom.sources import derived as D


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, label, label_code, label_text``."""
    rows = D.corpus(spark, sf_dir)
    return C.factorize(rows, C.class_table(rows)).withColumn("label_text", F.col("label"))


def load(spark: SparkSession, sf_dir: str) -> splits.Splits:
    return splits.load_splits(D.corpus(spark, sf_dir))


def corpus_load(spark, sf_dir):
    clean = S.clean_corpus(D.raw_corpus(spark, sf_dir))
    return clean.select("doc_id", F.md5("text").alias("text_md5"), "label")


def corpus_parts_union(spark, sf_dir):
    documents = D.table(spark, sf_dir, "documents").select("doc_id", "text")
    root = shared_path(spark, "parts")
    for path, part in zip(S.part_paths(["radiology_reports"], root), range(3)):
        documents.filter(F.col("doc_id") % 3 == part).select("text").write.options(**S.CSV_OPTIONS).csv(path)
    return S.read_parts(spark, ["radiology_reports"], root).select("part", F.md5("text").alias("text_md5"))


def label_factorize(spark, sf_dir):
    return coded(spark, sf_dir).select("doc_id", "label", "label_code")


def label_decode(spark, sf_dir):
    rows = S.clean_corpus(D.raw_corpus(spark, sf_dir))
    classes = C.class_table(rows)
    codes = C.factorize(rows, classes).select("doc_id", "label_code")
    return C.decode_label(codes, classes).select("doc_id", "label_code", "label_text")


def category_summary(spark, sf_dir):
    return C.category_summary(C.class_table(D.corpus(spark, sf_dir)))


def label_list(spark, sf_dir):
    classes = C.class_table(D.corpus(spark, sf_dir))
    return classes.select("label_text", F.col("label_code").alias("position"))


def instruct_prefix(spark, sf_dir):
    rows = D.corpus(spark, sf_dir)
    names = C.label_list(rows, "doc_id")
    asked = F.concat(F.lit(X.instruction(names)), "text")
    return rows.select("doc_id", F.char_length(asked).cast("bigint").alias("n_chars"), F.md5(asked).alias("prompt_md5"))


def translate_requests(spark, sf_dir):
    asked = S.map_requests(D.corpus(spark, sf_dir))
    return asked.select("doc_id", F.md5("request").alias("request_md5"))


def split_exact(spark, sf_dir):
    return splits.exact_split(D.table(spark, sf_dir, "documents").select("doc_id"))


def split_nested(spark, sf_dir):
    return load(spark, sf_dir).rows.select("doc_id", "split")


def class_weights(spark, sf_dir):
    weights = C.class_weights(load(spark, sf_dir).part("train"))
    return weights.select("label_code", "n", F.round("weight", 9).alias("weight"))


def weighted_rows(spark, sf_dir):
    train = load(spark, sf_dir).part("train")
    weighted = C.with_class_weight(train, C.class_weights(train))
    return weighted.select("doc_id", "label_code", F.round("weight", 9).alias("weight"))


def min_class_support(spark, sf_dir):
    return C.min_class_support(coded(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        corpus_load, corpus_parts_union, label_factorize, label_decode, category_summary, label_list,
        instruct_prefix, translate_requests, split_exact, split_nested, class_weights, weighted_rows,
        min_class_support,
    )
}

_NA = ", ".join(text(v) for v in templates.NA_STRINGS)
_CLEAN = f"""
select doc_id, text, case when label not in ({_NA}) then label end as label
from raw_corpus where text not in ({_NA})"""
_PREFIX = "Instruct: " + templates.TASK.split("{")[0]
_NAMES = (
    "(select concat(string_agg(label_text, ', ' order by label_code) filter (label_code < m), ' or ',"
    " string_agg(label_text, '') filter (label_code = m))"
    " from classes, (select max(label_code) as m from classes))"
)

ORACLES = {
    "corpus_load": with_ctes("raw_corpus", "select doc_id, md5(text) as text_md5, label from clean", clean=_CLEAN),
    "corpus_parts_union": """
        select concat('radiology_reports_part', doc_id % 3 + 1) as part, md5(text) as text_md5 from documents""",
    "label_factorize": with_ctes("coded", "select doc_id, label, label_code from coded"),
    "label_decode": with_ctes(
        "raw_corpus",
        "select c.doc_id, coalesce(k.code, -1) as label_code, c.label as label_text"
        " from clean c left join k on c.label = k.label",
        clean=_CLEAN,
        k="select label, cast(row_number() over (order by min(doc_id)) - 1 as bigint) as code"
          " from clean where label is not null group by label",
    ),
    "category_summary": with_ctes(
        "classes", "select label_code, label_text, n, concat(' ', label_text, ' (n=', n, ')') as summary from classes"
    ),
    "label_list": with_ctes("classes", "select label_text, label_code as position from classes"),
    "instruct_prefix": with_ctes(
        "corpus classes",
        f"select doc_id, length(p) as n_chars, md5(p) as prompt_md5 from"
        f" (select doc_id, concat({text(_PREFIX)}, {_NAMES}, chr(10), 'Query: ', text) as p from corpus)",
    ),
    "translate_requests": with_ctes("corpus", "select doc_id, md5(concat('<2en> ', text)) as request_md5 from corpus"),
    "split_exact": f"""
        select doc_id, case when row_number() over (order by {key('split42', 'doc_id')}, doc_id)
          <= ceil(cast(0.2 as double) * count(*) over ()) then 'eval' else 'train' end as split from documents""",
    "split_nested": with_ctes("splits", "select doc_id, split from splits"),
    "class_weights": with_ctes(
        "train_classes", "select label_code, n, round(cast(1 as double) / n, 9) as weight from train_classes"
    ),
    "weighted_rows": with_ctes(
        "train train_classes",
        "select t.doc_id, t.label_code, round(cast(1 as double) / k.n, 9) as weight"
        " from train t join train_classes k on t.label_code = k.label_code",
    ),
    "min_class_support": with_ctes("classes", "select min(n) as min_support from classes"),
}
