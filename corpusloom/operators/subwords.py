"""Subword vocabularies: pair merges learned from counted words, longest-match encoding, masks over whole words.

A word is a run of pieces, the first plain and the others with the continuation mark, as in
``play ##ing ##s``.  While merges are learned a word is one string with every piece between
two private characters, so that a merge is a plain string replacement.

Only distinct words take part, with their counts.  Counts of pairs are kept as a table and
changed by the words that a round touches; the driver sees the few best pairs of a round.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.hashing import hash_bigint, md5_key
from corpusloom.functions.templates import WORDPIECE_MARK
from corpusloom.functions.vectors import let
from corpusloom.operators.tokens import MASK_TOKEN
from corpusloom.session import bounded_rows, discard, local_table, write_through

OPEN, CLOSE = "\ue000", "\ue001"
UNKNOWN = "[UNK]"
#: Most pairs merged in one round, and how many of the best are looked at for them.
PER_ROUND = 32
LOOKED_AT = 4
#: Most pieces of a vocabulary that workers hold as a trie.
MAX_PIECES = 200_000
#: Pieces that are masked together in a worker.
PIECES_AT_ONCE = 1_000_000


def spelled(word: Column) -> Column:
    """A word as its characters, each a piece; the two private characters are left out."""
    clean = F.translate(word, OPEN + CLOSE, "")
    rest = F.regexp_replace(F.substring(clean, 2, 2**31 - 1), "(?s)(.)", f"{OPEN}{WORDPIECE_MARK}$1{CLOSE}")
    return F.when(clean != "", F.concat(F.lit(OPEN), F.substring(clean, 1, 1), F.lit(CLOSE), rest))


def pieces_of(spelling: Column) -> Column:
    return F.split(F.substr(spelling, F.lit(2), F.length(spelling) - 2), CLOSE + OPEN)


def _pairs(spelling: str) -> Column:
    """All neighbouring pieces, as struct(left, right)."""
    pieces = pieces_of(F.col(spelling))
    return let(pieces, lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.struct(a.alias("left"), b.alias("right"))))


def _counted(words: DataFrame, spelling: str, sign: int) -> DataFrame:
    return words.select(F.inline(_pairs(spelling)), (F.col("n") * sign).alias("n"))


def joined(left: str, right: str) -> tuple[str, str]:
    """The pair as it stands in a spelling, and what it becomes."""
    pair = f"{OPEN}{left}{CLOSE}{OPEN}{right}{CLOSE}"
    return pair, pair.replace(f"{CLOSE}{OPEN}{WORDPIECE_MARK}", "")


def disjoint(best: list, most: int) -> list:
    """The best pairs, in order, that share no piece with a better one of the round."""
    used, out = set(), []
    for row in best:
        if len(out) < most and not {row["left"], row["right"]} & used:
            used |= {row["left"], row["right"]}
            out.append(row)
    return out


def learn_merges(words: DataFrame, merges: int = 2000, per_round: int = PER_ROUND, least: int = 2) -> DataFrame:
    """``rank, left, right, piece, n`` of the learned merges, from ``token, n``.

    In a round the most frequent pairs that share no piece are merged together, equal counts
    in the order of their pieces; ``n`` is a pair's count in its round.  Learning ends with
    ``merges`` merges, or when no pair is seen ``least`` times.  Null and empty words are
    left out, repeated words add up.
    """
    spark = words.sparkSession
    state = words.groupBy("token").agg(F.sum("n").alias("n")).select(spelled(F.col("token")).alias("spelling"), "n")
    state = write_through(state.where("spelling is not null and n > 0"), "spellings")
    counts = write_through(_counted(state, "spelling", 1).groupBy("left", "right").agg(F.sum("n").alias("n")), "pair-counts")
    found: list[tuple] = []
    while len(found) < merges:
        best = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "left", "right").limit(LOOKED_AT * per_round).collect()
        chosen = disjoint(best, min(per_round, merges - len(found)))
        if not chosen:
            break
        after = F.col("spelling")
        for row in chosen:
            pair, piece = joined(row["left"], row["right"])
            found.append((len(found), row["left"], row["right"], piece[1:-1], row["n"]))
            after = F.replace(after, F.lit(pair), F.lit(piece))
        moved = write_through(state.select("spelling", after.alias("after"), "n"), "spellings")
        touched = moved.where("spelling <> after")
        change = _counted(touched, "spelling", -1).unionAll(_counted(touched, "after", 1)).groupBy("left", "right").agg(F.sum("n").alias("n"))
        summed = counts.unionAll(change).groupBy("left", "right").agg(F.sum("n").alias("n")).where("n <> 0")
        next_counts = write_through(summed, "pair-counts")
        discard(counts, state)
        counts, state = next_counts, moved.select(F.col("after").alias("spelling"), "n")
        state._written_path = moved._written_path
    discard(counts, state)
    return local_table(spark, found, "rank int, left string, right string, piece string, n bigint")


def subword_vocabulary(words: DataFrame, merges: DataFrame) -> DataFrame:
    """``piece, rank``: the single characters by frequency, then the merges in order.

    Characters of equal frequency stand in their own order; a piece that several merges make
    keeps its first rank.  The alphabet is a table of its own and is bounded like a lookup table.
    """
    alphabet = (
        words.select(spelled(F.col("token")).alias("spelling"), "n").where("spelling is not null")
        .select(F.explode(pieces_of(F.col("spelling"))).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n"))
    )
    letters = bounded_rows(alphabet, MAX_PIECES)
    made = bounded_rows(merges.select("rank", "piece"), MAX_PIECES)
    if letters is None or made is None:
        raise ValueError("the vocabulary has too many pieces for one trie")
    ordered = [r.piece for r in sorted(letters, key=lambda r: (-r.n, r.piece.encode()))]
    ordered += [r.piece for r in sorted(made, key=lambda r: r.rank)]
    return local_table(words.sparkSession, [(p, k) for k, p in enumerate(dict.fromkeys(ordered))], "piece string, rank int")


def trie(pieces: list[str]) -> dict:
    """Nested characters; the empty key holds the piece that ends there."""
    root: dict = {}
    for piece in pieces:
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = piece
    return root


def longest_match(word: str, root: dict, unknown: str = UNKNOWN) -> list[str]:
    """The pieces of a word, the longest first; a word that cannot be spelled is unknown as a whole."""
    rest = root
    for c in WORDPIECE_MARK:
        rest = rest.get(c, {})
    out, at, node = [], 0, root
    while at < len(word):
        end, found = at, None
        for i in range(at, len(word)):
            node = node.get(word[i])
            if node is None:
                break
            if "" in node:
                end, found = i + 1, node[""]
        if found is None:
            return [unknown]
        out.append(found)
        at, node = end, rest
    return out


def subword_tokenizer(vocabulary: DataFrame, unknown: str = UNKNOWN) -> Callable:
    """A tokenizer for ``tokenize``: words between white space, each cut by longest match.

    The vocabulary is fetched once, up to ``MAX_PIECES``; a worker keeps a trie and the words
    it has seen, until these are as many.  Pieces are numbers until a batch is told as one
    Arrow array.
    """
    rows = bounded_rows(vocabulary.select("piece"), MAX_PIECES)
    if rows is None:
        raise ValueError("the vocabulary has too many pieces for one trie")
    pieces = [r.piece for r in rows]

    def factory():
        names = list(dict.fromkeys([unknown, *pieces]))
        number = {piece: k for k, piece in enumerate(names)}
        root, seen, named = trie(pieces), {}, pa.array(names, pa.string())

        def cut(word: str) -> array:
            if len(seen) >= MAX_PIECES:
                seen.clear()
            found = seen[word] = array("i", [number[piece] for piece in longest_match(word, root, unknown)])
            return found

        def run(texts: pd.Series) -> pd.Series:
            flat, ends, missing = array("i"), array("i", [0]), []
            for text in texts:
                missing.append(text is None)
                for word in _words(text or ""):
                    flat += seen.get(word) or cut(word)
                ends.append(len(flat))
            tokens = named.take(pa.array(np.frombuffer(flat, "int32") if flat else [], pa.int32()))
            lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, "int32")), tokens, mask=pa.array(missing, pa.bool_()))
            return pd.Series(pd.arrays.ArrowExtensionArray(lists), index=texts.index)

        return run

    return factory


def _words(text: str) -> list[str]:
    """As ``word_tokens`` cuts them, without the private characters."""
    clean = text.replace(OPEN, "").replace(CLOSE, "")
    for c in "\t\n\r\f":
        clean = clean.replace(c, " ")
    return [w for w in clean.split(" ") if w]


def _starts(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where rows begin and end among all tokens, and which tokens begin a word."""
    ends = np.asarray(tokens.offsets, dtype="int64") - tokens.offsets[0].as_py()
    plain = pc.invert(pc.starts_with(tokens.flatten(), WORDPIECE_MARK))
    starts = pc.fill_null(plain, False).to_numpy(zero_copy_only=False).copy()
    starts[ends[:-1][ends[:-1] < ends[1:]]] = True
    return ends, starts


def _taken(starts: list[int], n: int, key: bytes, act: bytes, p: float) -> Iterator[tuple[int, int, int]]:
    """``(at, end, action)`` of the words of a row of ``n`` pieces that are taken, in their order."""
    wanted = max(1, round(n * p))
    ends = [*starts[1:], n]
    digests = [md5(key + b"%d" % at).digest() for at in starts]
    used = 0
    for word in sorted(range(len(starts)), key=digests.__getitem__):
        at, end = starts[word], ends[word]
        if used == 0 or used + end - at <= wanted:
            used += end - at
            draw = int.from_bytes(md5(act + b"%d" % at).digest()[:4], "big") % 100
            yield at, end, 0 if draw < 80 else 1 if draw < 90 else 2
            if used >= wanted:
                return


def _masked(batch: pa.RecordBatch, pieces: dict | None, size: int, p: float, seed: int, mask: str) -> pa.RecordBatch:
    """The rows of ``id, tokens, text of the id`` with ``input_tokens, labels, action``."""
    tokens = batch.column(1)
    ends, starts = _starts(tokens)
    at = np.flatnonzero(starts)
    first = np.searchsorted(at, ends)
    acts = np.full(ends[-1], -1, dtype="int8")
    spots, found = [], []
    for row, text in enumerate(batch.column(2).to_pylist()):
        base, n = int(ends[row]), int(ends[row + 1] - ends[row])
        if n == 0:
            continue
        words = (at[first[row]:first[row + 1]] - base).tolist()
        keys = [f"{salt}{seed}:{text}:".encode() for salt in ("word", "act", "piece")]
        for begin, end, act in _taken(words, n, *keys[:2], p):
            acts[base + begin:base + end] = act
            if act == 1 and pieces is not None:
                for k in range(begin, end):
                    drawn = md5(keys[2] + b"%d" % k).hexdigest()
                    spots.append(base + k)
                    found.append(pieces.get(int(drawn[:15], 16) % size))
    flat = tokens.flatten()
    source = np.arange(len(flat))
    source[acts == 0] = len(flat)
    source[np.array(spots, dtype="int64")] = len(flat) + 1 + np.arange(len(found))
    unknown = (acts == 1) & (source < len(flat))
    inputs = pa.concat_arrays([flat, pa.array([mask, *found], pa.string())]).take(pa.array(source, mask=unknown))
    labels = flat.take(pa.array(np.arange(len(flat)), mask=acts < 0))
    names = pa.array(["mask", "random", "keep"]).take(pa.array(acts, mask=acts < 0))
    offsets = pa.array(ends.astype("int32"))
    columns = [pa.ListArray.from_arrays(offsets, c) for c in (flat, inputs, labels, names)]
    return pa.record_batch([batch.column(0), *columns], names=[batch.schema.names[0], "tokens", "input_tokens", "labels", "action"])


def mask_word_pieces(
    df: DataFrame, vocabulary: DataFrame, p: float = 0.15, seed: int = 42, id_col: str = "doc_id", mask: str = MASK_TOKEN,
) -> DataFrame:
    """Mask whole words of pieces: ``id, tokens, input_tokens, labels, action``.

    A word is a piece and the continuations behind it (a row may begin with one).  Words are
    taken in hashed order until ``max(1, round(p * pieces))`` pieces are masked; a word that
    would go beyond is passed over, but the first word is always taken, so a row that has a
    piece has a mask.  A taken word is masked (80 %), replaced piece by piece by random
    pieces (10 %) or kept (10 %) as a whole.

    Rows are masked where they are, in Arrow batches, and do not move: the vocabulary goes to
    the workers up to ``MAX_PIECES``.  Past that the places of random pieces meet it by rank,
    and rows move once to meet what was found.
    """
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    tokens = F.coalesce(F.col("tokens"), F.array().cast("array<string>"))
    held = bounded_rows(vocabulary.select("rank", "piece"), MAX_PIECES)
    size = vocabulary.count() if held is None else len(held)
    pieces = None if held is None else {r["rank"]: r["piece"] for r in held}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.asarray(batch.column(1).offsets, dtype="int64")
            begin = 0
            while begin < batch.num_rows:
                upto = max(begin + 1, int(np.searchsorted(ends, ends[begin] + PIECES_AT_ONCE, "right")) - 1)
                upto = min(upto, batch.num_rows)
                yield _masked(batch.slice(begin, upto - begin), pieces, max(size, 1), p, seed, mask)
                begin = upto

    many = T.ArrayType(T.StringType())
    schema = T.StructType([df.schema[id_col], *[T.StructField(c, many) for c in ("tokens", "input_tokens", "labels", "action")]])
    rows = df.select(id_col, tokens.alias("tokens"), id_text.alias("_text")).mapInArrow(run, schema)
    if held is not None:
        return rows

    rows = write_through(rows, "masked-pieces")
    at = F.filter(F.transform("action", lambda a, i: F.when(a == "random", i)), lambda i: i.isNotNull())
    pick = hash_bigint(md5_key(f"piece{seed}", F.coalesce(F.col(id_col).cast("string"), F.lit("")), "at")) % max(size, 1)
    spots = rows.select(id_col, F.explode(at).alias("at")).distinct().withColumn("rank", pick.cast("int"))
    words = spots.join(vocabulary.select("rank", "piece"), "rank").groupBy(F.col(id_col).alias("_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("at", "piece"))).alias("_found")
    )
    filled = F.transform("input_tokens", lambda t, i: F.when(F.get("action", i) == "random", F.col("_found")[i]).otherwise(t))
    met = rows.join(words, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return met.select(id_col, "tokens", filled.alias("input_tokens"), "labels", "action")
