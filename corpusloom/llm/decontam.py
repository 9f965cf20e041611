"""Benchmark decontamination by one Aho-Corasick automaton over item windows.

Items and documents are lower-cased (A-Z) and cut into words.  Every run of 13 item words
is a pattern; all patterns go into one automaton, and each document is scanned once.  The
words that any occurrence covers are hit, and their byte and character offsets in the
original text follow from the words' places.
"""

from __future__ import annotations

import bisect
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import LOWER, as_bytes, fresh
from corpusloom.session import discard, write_through

#: Words are runs of digits, letters and all bytes outside ASCII.
WORD_BYTES = frozenset([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
TO_WORDS = bytes(LOWER[b] if b in WORD_BYTES else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")

#: Bytes of normalised items that one automaton may hold.  Larger benchmarks are scanned in blocks.
MAX_PATTERN_BYTES = 32 << 20


def words_of(text) -> list[bytes]:
    return as_bytes(text).translate(TO_WORDS).split()


def item_windows(text, width: int) -> set[bytes]:
    """The windows of an item; one of fewer words than ``width`` is a window itself."""
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def window_table(benchmark: DataFrame, width: int, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Distinct windows with their sorted item ids and their number of words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, i) for i, t in zip(*(c.to_pylist() for c in batch.columns)) for w in item_windows(t, width)]
            yield pa.record_batch(
                [pa.array([w for w, _ in rows], pa.binary()), pa.array([i for _, i in rows], pa.string())],
                names=["window", "item"],
            )

    narrow = benchmark.select(F.col(id_column).cast("string"), F.col(text_column).cast("string"))
    # an item without an id has windows that hit like any other; the set of ids leaves it out
    pairs = narrow.mapInArrow(cut, "window binary, item string")
    return pairs.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


@lru_cache(maxsize=2)
def _automaton(packed: bytes):
    """Built once per Python worker; bytes are held as characters 0-255."""
    automaton = ahocorasick.Automaton()
    for window, items in pickle.loads(packed):
        automaton.add_word(" " + window.decode("latin-1") + " ", (window.count(b" ") + 1, items))
    automaton.make_automaton()
    return automaton


def scan(automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Disjoint hit ranges of words (start, end) in order, and the items found."""
    text = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits, items, places = [], set(), None
    for end, (n, found) in automaton.iter(text):
        if places is None:
            places = [m.start() for m in re.finditer(" ", text)]
        last = bisect.bisect_left(places, end)  # words before the closing space
        start = last - n
        items.update(found)
        hits.append((start, last))
    return _merged(hits), items


def offsets(text, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of ranges of words."""
    if not ranges:
        return []
    raw = as_bytes(text)
    found = [m.span() for m in _WORD.finditer(raw.translate(TO_WORDS))]
    spans, at, chars = [], 0, 0
    for start, end in ranges:
        place = []
        for byte in (found[start][0], found[end - 1][1]):
            chars += len(raw[at:byte].decode("utf-8", "replace"))
            at = byte
            place.append(chars)
        spans.append((place[0], place[1]))
    return spans


def _spans(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("start", kind), T.StructField("end", kind)]))


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("ranges", _spans(T.IntegerType())),
    T.StructField("spans", _spans(T.LongType())),
])

_SPAN32 = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SPAN64 = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _scanner(packed, last: bool, keep_text: bool):
    """The last three columns are the ranges and items of earlier blocks, and the text.

    A block that is not the last passes all columns on; the last one puts the fields of
    ``FOUND`` in their place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(packed.value)
        for batch in batches:
            *others, earlier, known, texts = batch.columns
            columns: list[list] = [[] for _ in range(6)]
            for cell, had, had_items in zip(texts, earlier.to_pylist(), known.to_pylist()):
                text = cell.as_py()
                words = words_of(text)
                ranges, items = scan(automaton, words) if words and len(automaton) else ([], set())
                if had:
                    ranges = _merged(ranges + [(r["start"], r["end"]) for r in had])
                items = sorted(items.union(had_items or ()))
                spans = offsets(text, ranges) if last else []
                values = (
                    len(words), sum(e - s for s, e in ranges), len(items), items,
                    [{"start": s, "end": e} for s, e in ranges], [{"start": s, "end": e} for s, e in spans],
                )
                for column, value in zip(columns, values):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), _SPAN32, _SPAN64]
            found = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = batch.schema.names
            if last:
                keep = 1 if keep_text else 0
                yield pa.record_batch(
                    [*others, *[texts] * keep, *found], names=[*names[:-3], *names[-1:] * keep, *FOUND.names]
                )
            else:
                yield pa.record_batch([*others, found[4], found[3], texts], names=names)

    return run


def _blocks(windows: DataFrame, max_bytes: int) -> Iterator:
    """First the number of blocks, then each block's windows; one block is the rule."""
    total = windows.agg(F.sum(F.octet_length("window"))).first()[0] or 0
    n = max(1, -(-total // max_bytes))
    yield n
    for k in range(n):
        part = windows if n == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k)
        yield [(bytes(r[0]), list(r[1])) for r in part.collect()]


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 13,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    max_bytes: int = MAX_PATTERN_BYTES,
    keep_text: bool = False,
) -> DataFrame:
    """The columns of ``docs`` (the text only with ``keep_text``) plus the fields of ``FOUND``.

    Null and empty texts have no words and no hits; items without words have no windows;
    items with a null id hit, but are not among ``items`` and not counted in ``n_items``.  An empty benchmark hits nothing.  Columns of
    ``docs`` named as in ``FOUND`` are replaced by the result.  ``spans`` are character
    offsets in the original text.

    The automaton is broadcast: the size of its patterns is measured first, and a
    benchmark of more than ``max_bytes`` is scanned block by block, one pass over the
    documents for each, carrying the hits so far.
    """
    spark = docs.sparkSession
    ranges, items = fresh("ranges"), fresh("items")
    others = [c for c in docs.columns if c not in FOUND.names and c != text_column]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in others],
        F.lit(None).cast("array<struct<start:int,end:int>>").alias(ranges),
        F.lit(None).cast("array<string>").alias(items),
        F.col(text_column).cast("string").alias(text_column),
    )
    blocks = _blocks(window_table(benchmark, width, item_column, item_text), max_bytes)
    n = next(blocks)
    for k, block in enumerate(blocks, 1):
        packed = spark.sparkContext.broadcast(pickle.dumps(block))
        fields = rows.schema.fields
        if k == n:
            schema = T.StructType([*fields[:-3], *fields[-1:] * keep_text, *FOUND.fields])
            return rows.mapInArrow(_scanner(packed, True, keep_text), schema)
        scanned = write_through(rows.mapInArrow(_scanner(packed, False, keep_text), rows.schema), "scanned-block")
        discard(rows)
        rows = scanned
    raise AssertionError("there is always a last block")


def contaminated(min_share_inverse: int = 20) -> Column:
    """Whether at least one word in ``min_share_inverse`` is hit."""
    return (F.col("n_hit") > 0) & (min_share_inverse * F.col("n_hit") >= F.col("n_words"))


def items_digest() -> Column:
    """Hex SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join("items", ",").cast("binary"), 256)
