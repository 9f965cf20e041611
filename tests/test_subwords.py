"""Merges against a plain loop, longest match against a scan, masks over whole words."""

from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import subwords as S
from corpusloom.operators import tokens as K

WORDS = {"low": 5, "lower": 2, "newest": 6, "widest": 3, "aaaa": 4, "aaa": 1, "é": 2, "übermut": 1, "𝒳y": 3, "x": 9}


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "token string, n long").repartition(3)


def by_hand(words, merges, per_round, least=2):
    state = [([w[0]] + ["##" + c for c in w[1:]], n) for w, n in words.items()]
    out = []
    while len(out) < merges:
        counts = Counter()
        for pieces, n in state:
            for pair in zip(pieces, pieces[1:]):
                counts[pair] += n
        best = sorted((p for p, n in counts.items() if n >= least), key=lambda p: (-counts[p], p[0].encode(), p[1].encode()))
        used, chosen = set(), []
        for pair in best[: S.LOOKED_AT * per_round]:
            if len(chosen) < min(per_round, merges - len(out)) and not set(pair) & used:
                used |= set(pair)
                chosen.append(pair)
        if not chosen:
            break
        for a, b in chosen:
            out.append((len(out), a, b, a + b[2:], counts[a, b]))
            for pieces, _ in state:
                i = 0
                while i < len(pieces) - 1:
                    if (pieces[i], pieces[i + 1]) == (a, b):
                        pieces[i : i + 2] = [a + b[2:]]
                    i += 1
    return out


@pytest.mark.parametrize("per_round", [1, 3])
def test_merges(spark, per_round):
    found = S.learn_merges(table(spark, WORDS), 12, per_round).orderBy("rank").collect()
    assert [tuple(r) for r in found] == by_hand(WORDS, 12, per_round)


def test_merges_of_odd_words(spark):
    odd = spark.createDataFrame([(None, 3), ("", 4), ("ab", 1), ("ab", 2), ("ab", 5), ("z", 7), ("c$d\\e", 2)], "token string, n long")
    found = S.learn_merges(odd, 3, 1).orderBy("rank").collect()
    assert (found[0].left, found[0].right, found[0].n) == ("a", "##b", 8)
    assert S.learn_merges(odd.limit(0), 5).count() == 0
    vocabulary = S.subword_vocabulary(odd, S.learn_merges(odd.limit(0), 5)).orderBy("rank").collect()
    assert [r.piece for r in vocabulary][:3] == ["##b", "a", "z"] and len(vocabulary) == 8


def scan(word, vocabulary):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(piece)
                at = end
                break
        else:
            return ["[UNK]"]
    return out


def test_longest_match(spark):
    words = table(spark, WORDS)
    vocabulary = S.subword_vocabulary(words, S.learn_merges(words, 15, 4))
    known = {r.piece for r in vocabulary.collect()}
    texts = ["lowest newer  widest\tlow", "", None, "aaaaaaa é", "zebra low", "##low #", "𝒳y", "x\x0by lowx"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in K.tokenize(df, 10_000, S.subword_tokenizer(vocabulary)).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert got[i] is None
        else:
            cut = [w for w in text.replace("\t", " ").split(" ") if w]
            assert got[i] == [p for w in cut for p in scan(w, known)]
    assert "".join(p.removeprefix("##") for p in got[0]) == "lowestnewerwidestlow"  # pieces spell the words again


def test_no_word_is_half_masked(spark):
    vocabulary = spark.createDataFrame([(f"v{k}", k) for k in range(7)], "piece string, rank int")
    rows = [(i, [("##" if (i * 7 + k) % 3 else "") + f"p{k}" for k in range(i % 60)]) for i in range(200)]
    rows += [(5, ["##a", "##b", "c"]), (None, ["one", "##two"] * 30), (900, None), (901, ["single"]), (902, ["w"] + ["##c"] * 50)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(4)
    found = S.mask_word_pieces(df, vocabulary).collect()
    assert Counter((r.doc_id, tuple(r.tokens)) for r in found) == Counter((i, tuple(t or ())) for i, t in rows)
    kinds = Counter()
    for r in found:
        n = len(r.tokens)
        assert len(r.input_tokens) == len(r.labels) == len(r.action) == n
        words = []
        for k, t in enumerate(r.tokens):
            if k and t.startswith("##"):
                words[-1].append(k)
            else:
                words.append([k])
        for word in words:
            acts = {r.action[k] for k in word}
            assert len(acts) == 1
            kinds.update(acts)
            for k in word:
                act = r.action[k]
                assert r.labels[k] == (None if act is None else r.tokens[k])
                want = {"mask": "[MASK]", None: r.tokens[k], "keep": r.tokens[k]}.get(act)
                assert r.input_tokens[k] == want if act != "random" else r.input_tokens[k].startswith("v")
        masked = sum(a is not None for a in r.action)
        wanted = max(1, round(0.15 * n))
        taken = [len(w) for w in words if r.action[w[0]] is not None]
        assert (masked > 0) == (n > 0) and (masked <= wanted or len(taken) == 1)
    assert kinds["mask"] > kinds["random"] > 0 and kinds["keep"] > 0
    again = S.mask_word_pieces(df.repartition(2), vocabulary).collect()
    assert Counter(map(str, again)) == Counter(map(str, found))


def test_masks_move_no_rows(spark, monkeypatch):
    vocabulary = spark.createDataFrame([(f"v{k}", k) for k in range(9)], "piece string, rank int")
    rows = [(i % 90, [("##" if (i % 90 + k) % 3 else "") + f"p{k}" for k in range(i % 45)]) for i in range(120)] + [(None, ["a", None, "##b"]), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3).localCheckpoint()
    found = S.mask_word_pieces(df, vocabulary)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    held = Counter(map(str, found.collect()))
    monkeypatch.setattr(S, "PIECES_AT_ONCE", 20)
    assert Counter(map(str, S.mask_word_pieces(df, vocabulary).collect())) == held
    monkeypatch.setattr(S, "MAX_PIECES", 3)  # past the bound the vocabulary is joined
    assert Counter(map(str, S.mask_word_pieces(df, vocabulary).collect())) == held


def test_pieces_reach_spark_as_one_array(spark):
    words = table(spark, WORDS)
    vocabulary = S.subword_vocabulary(words, S.learn_merges(words, 5, 4))
    made = S.subword_tokenizer(vocabulary)()(pd.Series(["low lower", None, "", "zebra"], index=[3, 5, 7, 9]))
    assert isinstance(made.dtype, pd.ArrowDtype) and list(made.index) == [3, 5, 7, 9]
    known = {r.piece for r in vocabulary.collect()}
    assert pa.Array.from_pandas(made).to_pylist() == [scan("low", known) + scan("lower", known), None, [], ["[UNK]"]]
    whole = K.tokenize(spark.createDataFrame([("a b",)], "text string"), 2**31 - 1)
    assert "slice(" not in whole._jdf.queryExecution().optimizedPlan().toString() and whole.first().tokens == ["a", "b"]
