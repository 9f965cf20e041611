"""Queries on whole documents: tokens, vocabularies, padded batches, masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import templates
from corpusloom.functions import text as X
from corpusloom.operators import subwords as S
from corpusloom.operators import tokens as K
from corpusloom.plans.sql import big, key, with_ctes, words
from corpusloom.session import write_through
from corpusloom.sources import derived as D


def _documents(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", "text")


def _tokens(spark, sf_dir):
    return K.tokenize(_documents(spark, sf_dir)).select("doc_id", "tokens")


def _whole_tokens(spark, sf_dir):
    """Tokens of whole texts: batches and masks are not cut."""
    return _documents(spark, sf_dir).select("doc_id", K.word_tokens(F.col("text")).alias("tokens"))


def _digest(tokens):
    return F.md5(F.array_join(tokens, " ", "~"))


def tokenize_truncate(spark, sf_dir):
    return _tokens(spark, sf_dir).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), _digest(F.col("tokens")).alias("tokens_md5")
    )


def vocabulary(spark, sf_dir):
    whole = _documents(spark, sf_dir).select(K.word_tokens(F.col("text")).alias("tokens"))
    return K.vocabulary(whole)


def pad_batches(spark, sf_dir):
    padded = K.pad_batches(_whole_tokens(spark, sf_dir))
    return padded.select(
        "doc_id",
        "batch",
        F.size("input_ids").cast("bigint").alias("width"),
        F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m).cast("bigint").alias("mask_sum"),
        _digest(F.col("input_ids")).alias("ids_md5"),
    )


def whole_word_mask(spark, sf_dir):
    tokens = _whole_tokens(spark, sf_dir)
    vocab = K.indexed_vocabulary(tokens)
    masked = K.whole_word_mask(tokens, vocab)

    def count(action):
        return F.size(F.filter("action", lambda x: x == action)).cast("bigint").alias(f"n_{action}")

    return masked.select(
        "doc_id",
        *[count(action) for action in ("mask", "random", "keep")],
        _digest(F.col("input_tokens")).alias("input_md5"),
        _digest(F.col("labels")).alias("labels_md5"),
    )


def strip_wordpiece(spark, sf_dir):
    pieces = F.transform(
        K.word_tokens(F.col("text")),
        lambda t, i: F.when(i % 3 == 2, F.concat(F.lit(templates.WORDPIECE_MARK), t)).otherwise(t),
    )
    clean = X.strip_wordpiece(F.col("pieces"))
    return _documents(spark, sf_dir).select("doc_id", pieces.alias("pieces")).select(
        "doc_id", F.size("pieces").cast("bigint").alias("n_tokens"),
        _digest(F.col("pieces")).alias("pieces_md5"), _digest(clean).alias("clean_md5"),
    )


MERGES, PER_ROUND = 64, 16


def _merges(spark, sf_dir):
    words = write_through(vocabulary(spark, sf_dir), "words")
    return words, S.learn_merges(words, MERGES, PER_ROUND)


def subword_vocab(spark, sf_dir):
    return _merges(spark, sf_dir)[1]


def _pieces(spark, sf_dir):
    """The learned vocabulary, and whole texts in its pieces."""
    pieces = S.subword_vocabulary(*_merges(spark, sf_dir))
    cut = K.tokenize(_documents(spark, sf_dir), 2**31 - 1, S.subword_tokenizer(pieces))
    return pieces, cut.select("doc_id", "tokens")


def subword_encode(spark, sf_dir):
    return _pieces(spark, sf_dir)[1].select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_pieces"), _digest(F.col("tokens")).alias("pieces_md5")
    )


def subword_mask(spark, sf_dir):
    pieces, cut = _pieces(spark, sf_dir)
    masked = S.mask_word_pieces(cut, pieces)

    def count(action):
        return F.size(F.filter("action", lambda x: x == action)).cast("bigint").alias(f"n_{action}")

    return masked.select(
        "doc_id",
        *[count(action) for action in ("mask", "random", "keep")],
        _digest(F.col("input_tokens")).alias("input_md5"),
        _digest(F.col("labels")).alias("labels_md5"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_truncate, vocabulary, pad_batches, whole_word_mask, strip_wordpiece,
        subword_vocab, subword_encode, subword_mask,
    )
}

_WHOLE = f"select doc_id, {words('text')} as tokens from documents"
_WORD = "t.doc_id, ':', t.i"
_MASK_STEPS = {
    "words": "select doc_id, unnest(tokens) as token, unnest(range(len(tokens))) as i, len(tokens) as n from tokens",
    "ranked": f"""select *, row_number() over (partition by doc_id order by {key('42', 'doc_id', 'i')})
      <= greatest(1, round_even(n * cast(0.15 as double), 0)) as chosen from words""",
    "vocab": "select token, row_number() over (order by token) - 1 as vocab_pos from (select distinct token from words)",
    "acted": f"""select *, case when chosen then case
        when {big(key('act42', 'doc_id', 'i'), 8)} % 100 < 80 then 'mask'
        when {big(key('act42', 'doc_id', 'i'), 8)} % 100 < 90 then 'random' else 'keep' end end as act,
      {big(key('word42', 'doc_id', 'i'))} % (select count(*) from vocab) as vocab_pos from ranked""",
    "filled": """select a.doc_id, a.i, a.act, a.token,
        case a.act when 'mask' then '[MASK]' when 'random' then v.token else a.token end as input
      from acted a left join vocab v on a.vocab_pos = v.vocab_pos""",
}

_OPEN, _CLOSE = "chr(57344)", "chr(57345)"
_ROUNDS = 8


def _merge_steps() -> dict[str, str]:
    """Rounds of merges on spelled words, each piece between two private characters."""
    spelled = f"{_OPEN} || substr(token, 1, 1) || {_CLOSE} || array_to_string(list_transform(range(2, length(token) + 1)," \
              f" lambda i: {_OPEN} || '##' || substr(token, i, 1) || {_CLOSE}), '')"
    steps = {
        "counted": f"select token, count(*) as n from (select unnest({words('text')}) as token from documents) group by token",
        "state0": f"select token, n, {spelled} as sp from counted",
        "chosen0": "select cast([] as struct(l varchar, r varchar, n hugeint)[]) as picks, 0 as total",
    }
    for r in range(1, _ROUNDS + 1):
        steps[f"pieces{r}"] = f"select n, string_split(substr(sp, 2, length(sp) - 2), {_CLOSE} || {_OPEN}) as p from state{r - 1}"
        steps[f"best{r}"] = f"""select l, r, sum(n) as n from (
            select p[i] as l, p[i + 1] as r, n from (select p, n, unnest(range(1, len(p))) as i from pieces{r}))
            group by l, r having sum(n) >= 2 order by sum(n) desc, l, r limit {S.LOOKED_AT * PER_ROUND}"""
        steps[f"chosen{r}"] = f"""select picks, total + len(picks) as total from (
            select total, list_reduce(list_prepend(cast([] as struct(l varchar, r varchar, n hugeint)[]), coalesce(e, [])), lambda acc, x:
              case when len(acc) >= least({PER_ROUND}, {MERGES} - total)
                or list_has_any(flatten(list_transform(acc, lambda m: [m.l, m.r])), [x[1].l, x[1].r]) then acc else list_concat(acc, x) end) as picks
            from chosen{r - 1}, (select list([{{'l': l, 'r': r, 'n': n}}] order by n desc, l, r) as e from best{r}))"""
        steps[f"state{r}"] = f"""select token, n, list_reduce(list_prepend(sp, list_transform(picks,
            lambda m: {_OPEN} || m.l || {_CLOSE} || {_OPEN} || m.r || {_CLOSE})),
            lambda s, m: replace(s, m, replace(m, {_CLOSE} || {_OPEN} || '##', ''))) as sp from state{r - 1}, chosen{r}"""
    steps["merges"] = " union all ".join(
        f"select cast(total - len(picks) + i - 1 as integer) as rank, picks[i].l as left, picks[i].r as right,"
        f" picks[i].l || substr(picks[i].r, 3) as piece, cast(picks[i].n as bigint) as n"
        f" from (select total, picks, unnest(range(1, len(picks) + 1)) as i from chosen{r})"
        for r in range(1, _ROUNDS + 1)
    )
    return {k: f"{v}" for k, v in steps.items()}


_ENCODE_STEPS = {
    "letters": "select piece, sum(n) as n from (select n, unnest(p) as piece from pieces1) group by piece",
    "known": "select piece, cast(row_number() over (order by part, n desc, rank, piece) - 1 as integer) as rank from ("
             " select piece, part, n, rank from (select piece, 0 as part, n, 0 as rank from letters union all"
             " select piece, 1 as part, 0 as n, rank from merges)"
             " qualify row_number() over (partition by piece order by part, rank) = 1)",
    "listed": "select list(piece) as v from known",
    "coded": """select token, 0 as pos, cast([] as varchar[]) as p from counted
        union all
        select token, case when k is null then length(token) else pos + k end,
          case when k is null then ['[UNK]'] else list_append(p, case when pos > 0 then '##' else '' end || substr(token, pos + 1, k)) end
        from (select token, pos, p, list_filter(range(length(token) - pos, 0, -1), lambda k:
                list_contains(v, case when pos > 0 then '##' else '' end || substr(token, pos + 1, k)))[1] as k
              from coded, listed where pos < length(token))""",
    "words_coded": "select token, p from coded where pos >= length(token)",
    "spots": f"select doc_id, unnest(w) as token, unnest(range(len(w))) as place from (select doc_id, {words('text')} as w from documents)",
    "pieced": "select d.doc_id, coalesce(flatten(list(p order by place) filter (where p is not null)), []) as tokens"
              " from documents d left join (select doc_id, place, p from spots s join words_coded c on s.token = c.token) x"
              " on d.doc_id = x.doc_id group by d.doc_id",
}


def _h(salt: str, *cols: str) -> str:
    return key(salt, *cols)


_PIECE_MASK_STEPS = {
    "starts": "select doc_id, tokens, greatest(1, cast(round_even(len(tokens) * cast(0.15 as double), 0) as bigint)) as wanted,"
              " list_filter(range(len(tokens)), lambda i: i = 0 or not starts_with(tokens[i + 1], '##')) as s from pieced",
    "spans": f"select doc_id, place, length, {_h('word42', 'doc_id', 'place')} as h from ("
             "select doc_id, s[k] as place, coalesce(s[k + 1], len(tokens)) - s[k] as length"
             " from (select doc_id, tokens, s, unnest(range(1, len(s) + 1)) as k from starts))",
    "ordered": "select doc_id, list({'used': length, 'taken': [{'place': place, 'length': length}]} order by h, place) as e from spans group by doc_id",
    "taken": "select s.doc_id, list_reduce(list_prepend({'used': cast(0 as bigint), 'taken': cast([] as struct(place bigint, length bigint)[])}, e),"
             " lambda acc, x: case when acc.used = 0 or acc.used + x.used <= wanted"
             " then {'used': acc.used + x.used, 'taken': list_concat(acc.taken, x.taken)} else acc end).taken as taken"
             " from starts s join ordered o on s.doc_id = o.doc_id",
    "acts": f"select doc_id, unnest(range(place, place + length)) as i, case when {big(_h('act42', 'doc_id', 'place'), 8)} % 100 < 80 then 'mask'"
            f" when {big(_h('act42', 'doc_id', 'place'), 8)} % 100 < 90 then 'random' else 'keep' end as act"
            " from (select doc_id, w.place as place, w.length as length from (select doc_id, unnest(taken) as w from taken))",
    "cells": "select doc_id, unnest(tokens) as token, unnest(range(len(tokens))) as i from pieced",
    "inputs": f"select c.doc_id, c.i, c.token, a.act, case a.act when 'mask' then '[MASK]' when 'random' then k.piece else c.token end as input"
              " from cells c left join acts a on c.doc_id = a.doc_id and c.i = a.i"
              f" left join known k on a.act = 'random' and k.rank = {big(_h('piece42', 'c.doc_id', 'c.i'))} % (select count(*) from known)",
}


def _recursive(sql: str) -> str:
    """Every step may be read by several others, and one refers to itself."""
    return sql.replace("with ", "with recursive ", 1)


ORACLES = {
    "subword_vocab": with_ctes("", "select rank, \"left\", \"right\", piece, n from merges", **_merge_steps()),
    "subword_encode": _recursive(with_ctes(
        "", "select doc_id, len(tokens) as n_pieces, md5(array_to_string(tokens, ' ')) as pieces_md5 from pieced",
        **_merge_steps(), **_ENCODE_STEPS,
    )),
    "subword_mask": _recursive(with_ctes(
        "",
        "select d.doc_id, count(*) filter (act = 'mask') as n_mask, count(*) filter (act = 'random') as n_random,"
        " count(*) filter (act = 'keep') as n_keep, md5(coalesce(string_agg(input, ' ' order by i), '')) as input_md5,"
        " md5(coalesce(string_agg(case when act is null then '~' else token end, ' ' order by i), '')) as labels_md5"
        " from pieced d left join inputs f on d.doc_id = f.doc_id group by d.doc_id",
        **_merge_steps(), **_ENCODE_STEPS, **_PIECE_MASK_STEPS,
    )),
    "tokenize_truncate": with_ctes(
        "tokens", "select doc_id, len(tokens) as n_tokens, md5(array_to_string(tokens, ' ')) as tokens_md5 from tokens"
    ),
    "vocabulary": f"select token, count(*) as n from (select unnest({words('text')}) as token from documents) group by token",
    "pad_batches": with_ctes(
        "",
        "select doc_id, batch, width, len(tokens) as mask_sum, md5(array_to_string(list_concat(tokens,"
        " list_transform(range(width - len(tokens)), lambda x: '[PAD]')), ' ')) as ids_md5"
        " from (select *, max(len(tokens)) over (partition by batch) as width from placed)",
        tokens=_WHOLE,
        placed="select *, (row_number() over (order by doc_id) - 1) // 128 as batch from tokens",
    ),
    "whole_word_mask": with_ctes(
        "",
        "select d.doc_id, count(*) filter (act = 'mask') as n_mask, count(*) filter (act = 'random') as n_random,"
        " count(*) filter (act = 'keep') as n_keep,"
        " md5(coalesce(string_agg(input, ' ' order by i), '')) as input_md5,"
        " md5(coalesce(string_agg(case when act is null then '~' else token end, ' ' order by i), '')) as labels_md5"
        " from tokens d left join filled f on d.doc_id = f.doc_id group by d.doc_id",
        tokens=_WHOLE,
        **_MASK_STEPS,
    ),
    "strip_wordpiece":
        "select doc_id, len(w) as n_tokens, md5(array_to_string(list_transform(w, lambda t, i:"
        " case when (i - 1) % 3 = 2 then concat('##', t) else t end), ' ')) as pieces_md5,"
        " md5(array_to_string(list_transform(w, lambda t, i: case when (i - 1) % 3 <> 2 and starts_with(t, '##')"
        " then substr(t, 3) else t end), ' ')) as clean_md5"
        f" from (select doc_id, {words('text')} as w from documents)",
}
