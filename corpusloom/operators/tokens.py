"""Word tokens, truncation, padded batches, whole-word masking, vocabularies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.hashing import hash_bigint, md5_key
from corpusloom.functions.vectors import let
from corpusloom.operators.ranking import positions_by_order
from corpusloom.session import write_through

MAX_TOKENS = 512
SENTENCE_TOKENS = 128
EVAL_BATCH = 128
MASK_TOKEN = "[MASK]"
PAD_TOKEN = "[PAD]"

#: Makes, once per Python worker, a function from a batch of texts to token lists.
TokenizerFactory = Callable[[], Callable[[pd.Series], pd.Series]]


def word_tokens(text: Column) -> Column:
    """Tokens between runs of white space."""
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda t: t != "")


def tokenize(
    df: DataFrame,
    max_length: int = MAX_TOKENS,
    tokenizer: TokenizerFactory | None = None,
    n_special: int = 0,
    text: str = "text",
) -> DataFrame:
    """Add ``tokens``, cut so that tokens and special tokens fit ``max_length``."""
    if tokenizer is None:
        tokens = word_tokens(F.col(text))
    else:
        # answers go to Spark as one Arrow array, not row by row
        @F.arrow_udf("array<string>")
        def tokens_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            run = tokenizer()
            for batch in batches:
                yield pa.Array.from_pandas(run(pd.Series(batch.to_pandas())), type=pa.list_(pa.string()))

        tokens = tokens_of(text)
    most = max_length - n_special
    # no array is longer than that, and a cut copies it
    return df.withColumn("tokens", tokens if most == 2**31 - 1 else F.slice(tokens, 1, most))


def tokenize_splits(df: DataFrame, keep: Sequence[str] = ("label",), **options) -> DataFrame:
    """Tokens of every split in one pass; of the input columns only ``keep`` stay."""
    return tokenize(df, **options).select("tokens", *keep)


def pad_batches(
    df: DataFrame, batch_size: int = EVAL_BATCH, pad: str = PAD_TOKEN, id_col: str = "doc_id"
) -> DataFrame:
    """Batches of consecutive rows by id, each padded to its own longest row.

    Adds ``batch, input_ids, attention_mask`` to ``id, tokens``.  Batches and widths are
    found on ``(id, length)`` alone; the tokens move once, when the widths come back.
    """
    lengths = df.select(id_col, F.size("tokens").alias("_n"))
    placed = positions_by_order(lengths, [id_col], name="batches")
    widths = placed.select(
        id_col, F.floor(F.col("pos") / batch_size).cast("bigint").alias("batch"), "_n"
    ).withColumn("_width", F.max("_n").over(W.partitionBy("batch")))
    n, gap = F.size("tokens"), F.col("_width") - F.size("tokens")
    return df.select(id_col, "tokens").join(widths.drop("_n"), id_col).select(
        id_col,
        "batch",
        F.concat("tokens", F.array_repeat(F.lit(pad), gap)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), gap)).alias("attention_mask"),
    )


def vocabulary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``token, n``; counts combine before the shuffle, so frequent tokens cost nothing."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def indexed_vocabulary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``token, vocab_pos`` with positions 0.. in token order."""
    return positions_by_order(
        vocabulary(df, tokens).select("token"), ["token"], "vocab_pos", name="vocabulary"
    )


def whole_word_mask(
    df: DataFrame,
    vocab: DataFrame,
    p: float = 0.15,
    seed: int = 42,
    id_col: str = "doc_id",
    mask: str = MASK_TOKEN,
) -> DataFrame:
    """Mask a share of the words of each row: ``id, tokens, input_tokens, labels``.

    The choice of words is made inside the row.  Only the few words that become a
    random word are joined with the vocabulary, on its position.
    """
    vocab_size = vocab.count()
    n = F.size("tokens")
    # round half to even in double arithmetic, at least one word of a non-empty row
    wanted = F.when(n > 0, F.greatest(F.lit(1), F.rint(n * F.lit(p)).cast("int"))).otherwise(0)
    draw = F.concat_ws(":", F.lit(f"act{seed}"), F.col(id_col).cast("string"))

    def action(i: Column) -> Column:
        return let(
            hash_bigint(F.md5(F.concat_ws(":", draw, i.cast("string"))), 8) % 100,
            lambda u: F.when(u < 80, "mask").when(u < 90, "random").otherwise("keep"),
        )

    # The wanted-th smallest key bounds the chosen words: no lookup per word.
    actions = let(
        let(
            F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"), F.lit(":")),
            lambda key: F.transform("tokens", lambda t, i: F.md5(F.concat(key, i.cast("string")))),
        ),
        lambda keys: let(
            F.get(F.sort_array(keys), F.col("_wanted") - 1),
            lambda bound: F.transform(keys, lambda k, i: F.when(k <= bound, action(i))),
        ),
    )
    chosen = (
        df.select(id_col, "tokens")
        .withColumn("_wanted", wanted)
        .select(id_col, "tokens", actions.alias("_act"))
    )
    if vocab_size == 0:  # no words anywhere, so nothing to mask
        empty = F.array().cast("array<string>")
        return chosen.select(
            id_col, "tokens", empty.alias("input_tokens"), empty.alias("labels"), F.col("_act").alias("action")
        )
    # Spots follow from the id and the number of tokens alone: they find their words as
    # narrow rows, meet by id, and every row moves once.  The choice is made once and read twice.
    chosen = write_through(chosen, "masked-words")
    random_at = F.filter(
        F.transform("_act", lambda a, i: F.when(a == "random", i)), lambda i: i.isNotNull()
    )
    pick = hash_bigint(md5_key(f"word{seed}", id_col, "at")) % vocab_size
    words = (
        chosen.select(id_col, F.explode(random_at).alias("at"))
        .withColumn("vocab_pos", pick)
        .join(vocab, "vocab_pos")
        .groupBy(id_col)
        # rows of one id draw the same word at the same spot
        .agg(F.map_from_entries(F.collect_set(F.struct("at", "token"))).alias("_words"))
    )
    found = chosen.join(words, id_col, "left")

    def act_at(i: Column) -> Column:
        return F.get(F.col("_act"), i)

    filled = F.transform(
        "tokens",
        lambda t, i: F.when(act_at(i).isNull() | (act_at(i) == "keep"), t)
        .when(act_at(i) == "mask", F.lit(mask))
        .otherwise(F.col("_words")[i]),
    )
    labels = F.transform("tokens", lambda t, i: F.when(act_at(i).isNotNull(), t))
    return found.select(
        id_col, "tokens", filled.alias("input_tokens"), labels.alias("labels"), F.col("_act").alias("action")
    )
