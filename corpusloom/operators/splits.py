"""Shuffled splits of exact size, as filters: no row is moved to split a table."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import md5_key
from corpusloom.operators import classes as C
from corpusloom.operators.ranking import RankKey, nth_key
from corpusloom.session import write_through


def held_out_key(df: DataFrame, id_col: str, fraction: float, salt: str | int) -> RankKey:
    """Rank key of the last of the first ``ceil(fraction * n)`` rows in shuffled order."""
    keys = df.select(md5_key(salt, id_col).alias("h"), F.col(id_col).alias("id"))
    return nth_key(keys, lambda n: math.ceil(fraction * n))


def _reached(key: RankKey, salt: str, id_col: str) -> Column:
    return key.reached(md5_key(salt, id_col), F.col(id_col))


def exact_split(
    df: DataFrame, id_col: str = "doc_id", fraction: float = 0.2, seed: int = 42,
    names: tuple[str, str] = ("train", "eval"),
) -> DataFrame:
    """Add ``split``: ``ceil(fraction * n)`` rows in the second part, the rest in the first."""
    key = held_out_key(df, id_col, fraction, f"split{seed}")
    return df.withColumn("split", F.when(_reached(key, f"split{seed}", id_col), names[1]).otherwise(names[0]))


def train_val_eval(
    df: DataFrame, id_col: str = "doc_id", fraction: float = 0.2, seed: int = 42, val: bool = True
) -> DataFrame:
    """Add ``split`` in train, val, eval; the val rows are split off the train rows."""
    which, _ = split_column(df.select(id_col), id_col, fraction, seed, val)
    return df.withColumn("split", which)


def split_column(
    ids: DataFrame, id_col: str, fraction: float = 0.2, seed: int = 42, val: bool = True
) -> tuple[Column, dict[str, int]]:
    """The split as a Column over the id, and the rows per split; reads only ``ids``."""
    outer = held_out_key(ids, id_col, fraction, f"split{seed}")
    held_out = _reached(outer, f"split{seed}", id_col)
    sizes = {"eval": math.ceil(fraction * outer.rows)}
    which = F.when(held_out, "eval")
    if val:
        inner = held_out_key(ids.filter(~held_out), id_col, fraction, f"val{seed}")
        which = which.when(_reached(inner, f"val{seed}", id_col), "val")
        sizes["val"] = math.ceil(fraction * inner.rows)
    sizes["train"] = outer.rows - sum(sizes.values())
    return which.otherwise("train"), sizes


class Splits(NamedTuple):
    """A labelled corpus ready for training: narrow rows and the class tables."""

    rows: DataFrame  # id, label, label_code, label_text, split
    sizes: dict[str, int]  # rows per split
    classes: DataFrame  # all classes, coded by first appearance
    train_classes: DataFrame  # the same codes, counted on the train rows

    def part(self, name: str) -> DataFrame:
        return self.rows.filter(F.col("split") == name)


def load_splits(
    corpus: DataFrame, id_col: str = "doc_id", fraction: float = 0.2, seed: int = 42, val: bool = True
) -> Splits:
    """Encode, split and count a corpus.

    Only ids and labels are written and passed over; texts join back by id where they
    are needed.  Rows without a label have code -1 and no name.
    """
    keys = write_through(corpus.select(id_col, "label"), "labels")
    classes = C.class_table(keys, order=id_col)
    coded = C.factorize(keys, classes).withColumn("label_text", F.col("label"))
    which, sizes = split_column(keys.select(id_col), id_col, fraction, seed, val)
    rows = write_through(coded.withColumn("split", which), "splits")
    return Splits(rows, sizes, classes, C.coded_classes(rows.filter(F.col("split") == "train")))
