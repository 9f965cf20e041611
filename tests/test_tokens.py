import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import sorted_rows
from corpusloom.operators import tokens as K


@pytest.fixture
def docs(spark):
    words = F.transform(F.sequence(F.lit(1), (F.col("id") * 7) % 50 + 1), lambda i: F.concat(F.lit("w"), i))
    return spark.range(130).select(F.col("id").alias("doc_id"), words.alias("tokens"))


def test_word_tokens(make):
    df = make([("  a\tb\n c  ",), ("",), (" \n",)], "text string")
    assert [r.tokens for r in K.tokenize(df).collect()] == [["a", "b", "c"], [], []]


def test_truncation_leaves_room_for_special_tokens(make):
    df = make([(" ".join(["x"] * 600), "l")], "text string, label string")
    assert len(K.tokenize(df).first().tokens) == 512
    assert len(K.tokenize(df, K.SENTENCE_TOKENS, n_special=2).first().tokens) == 126
    assert K.tokenize_splits(df, max_length=3).columns == ["tokens", "label"]


def test_custom_tokenizer(make):
    def factory():
        return lambda batch: pd.Series([list(t) for t in batch])

    assert K.tokenize(make([("abc",)], "text string"), 2, factory).first().tokens == ["a", "b"]


@pytest.mark.parametrize("size", [1, 16, 128, 1000])
def test_padding_reaches_the_longest_row_of_the_batch(docs, size):
    lengths = {r.doc_id: len(r.tokens) for r in docs.collect()}
    batches = {}
    for r in K.pad_batches(docs.repartition(5), size).collect():
        batches.setdefault(r.batch, []).append(r)
    for number, rows in batches.items():
        ids = [r.doc_id for r in rows]
        assert sorted(ids) == list(range(number * size, min((number + 1) * size, 130)))
        for r in rows:
            assert len(r.input_ids) == len(r.attention_mask) == max(lengths[i] for i in ids)
            assert sum(r.attention_mask) == lengths[r.doc_id]
            assert r.input_ids[lengths[r.doc_id]:] == [K.PAD_TOKEN] * (len(r.input_ids) - lengths[r.doc_id])


def test_vocabulary(make):
    df = make([(["a", "b", "a"],), ([],)], "tokens array<string>")
    assert sorted_rows(K.vocabulary(df)) == [("a", 2), ("b", 1)]
    assert sorted_rows(K.indexed_vocabulary(df)) == [("a", 0), ("b", 1)]


def test_masking(docs):
    vocab = K.indexed_vocabulary(docs)
    known = {r.token for r in vocab.collect()}
    actions = []
    for r in K.whole_word_mask(docs, vocab).collect():
        chosen = [i for i, a in enumerate(r.action) if a]
        assert len(chosen) == max(1, round(0.15 * len(r.tokens)))
        actions += [r.action[i] for i in chosen]
        for i, token in enumerate(r.tokens):
            assert r.labels[i] == (token if r.action[i] else None)
            if r.action[i] == "mask":
                assert r.input_tokens[i] == K.MASK_TOKEN
            elif r.action[i] == "random":
                assert r.input_tokens[i] in known
            else:
                assert r.input_tokens[i] == token
    assert 0.7 < actions.count("mask") / len(actions) < 0.9 and {"random", "keep"} <= set(actions)


def test_masking_is_stable_and_seeded(docs):
    vocab = K.indexed_vocabulary(docs)
    one = sorted_rows(K.whole_word_mask(docs, vocab))
    assert one == sorted_rows(K.whole_word_mask(docs.repartition(9), vocab))
    assert one != sorted_rows(K.whole_word_mask(docs, vocab, seed=7))


def test_masking_of_empty_rows(make):
    df = make([(1, []), (2, ["a"])], "doc_id int, tokens array<string>")
    got = {r.doc_id: r for r in K.whole_word_mask(df, K.indexed_vocabulary(df)).collect()}
    assert got[1].input_tokens == [] and got[1].labels == [] and got[2].labels == ["a"]
    none = df.filter("doc_id = 1")
    assert K.whole_word_mask(none, K.indexed_vocabulary(none)).first().input_tokens == []


def test_masking_keeps_rows_of_one_id_apart(make):
    words = [f"w{k}" for k in range(300)]
    df = make([(1, words), (1, words[:150]), (1, words), (None, ["x"])], "doc_id int, tokens array<string>")
    rows = K.whole_word_mask(df, K.indexed_vocabulary(df)).collect()
    assert sorted(len(r.input_tokens) for r in rows) == [1, 150, 300, 300]
    assert all(len(r.tokens) == len(r.input_tokens) == len(r.labels) and None not in r.input_tokens for r in rows)
    assert any("random" in r.action for r in rows)


def test_words_are_chosen_once(spark):
    words = F.transform(F.sequence(F.lit(1), F.col("doc_id") % 40 + 1), lambda k: F.concat(F.lit("w"), k))
    docs = spark.range(60).withColumnRenamed("id", "doc_id").select("doc_id", words.alias("tokens"))
    plan = K.whole_word_mask(docs, K.indexed_vocabulary(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "act42" not in plan  # actions are read from a table, not worked out for the spots and again for the rows
