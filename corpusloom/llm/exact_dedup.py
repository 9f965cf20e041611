"""Exact duplicates by a tree-merge of sorted digest runs.

The rows of an input partition are cut into runs of at most ``RUN_ROWS`` rows.  A run is
reduced to one entry per digest, sorted, and stored as blocks: a row holds a whole slice of
a sorted run as packed columns.  In each round, runs 0..k-1, k..2k-1, ... meet (``k`` is the
fan-in; 2 gives plain binomial rounds): a task gets the k blocks of one slice of the digest
space and merges them in one pass, keeping the best identifier of a digest.  Slices get
finer as runs grow, so a block stays small whatever the input, and a round has work for
every task.  Entries are equal only if digest, byte length and a second checksum agree, so a
digest collision can never merge two texts.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, answer_by_runs, as_bytes, fresh
from corpusloom.session import write_through

KEYS = ["digest", "n_bytes", "checksum"]
#: Most rows of a run, and entries that a block of a run aims at.
RUN_ROWS = 1 << 18
BLOCK_ENTRIES = 1 << 14
_DIGEST = 32
BLOCK = "run long, slice long, n long, digests binary, n_bytes binary, checksums binary, ids binary, with_id binary, copies binary"
_NAMES = ["run", "slice", "n", "digests", "n_bytes", "checksums", "ids", "with_id", "copies"]

#: An entry of a run: digest, length, checksum, identifier or None, number of rows.
Entry = tuple[bytes, int, int, int | None, int]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, raw, texts = batch.columns
        digest, n_bytes, checksum = [], [], []
        for cell in texts:
            text = as_bytes(cell.as_py()).translate(LOWER)
            digest.append(hashlib.sha256(text).digest())
            n_bytes.append(len(text))
            checksum.append(zlib.crc32(text))
        piece = (np.arange(seen, seen + batch.num_rows) // RUN_ROWS).astype(np.int32)
        seen += batch.num_rows
        yield pa.record_batch(
            [
                ids, raw, pa.array(digest, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(checksum, pa.int64()),
                pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(piece),
            ],
            names=["id", "raw", *KEYS, "part", "piece"],
        )


def _raw(text_column: str):
    return F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))


def digest_table(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One narrow row per document: id, a hash of the raw text, the keys, and the run it lies in.

    Written through, as the run numbers must not change between the passes.
    """
    narrow = docs.select(
        F.col(id_column).cast("long").alias("id"), _raw(text_column).alias("raw"), F.col(text_column).alias("text")
    )
    schema = "id long, raw long, digest binary, n_bytes long, checksum long, part int, piece int"
    found = write_through(narrow.mapInArrow(_digests, schema), "digests")
    pieces = (found.agg(F.max("piece")).first()[0] or 0) + 1
    return found.withColumn("run", F.col("part").cast("long") * pieces + F.col("piece")).drop("part", "piece")


def _better(a: int | None, b: int | None, best) -> int | None:
    return b if a is None else a if b is None else best(a, b)


def _reduced(entries, best) -> Iterator[Entry]:
    """Sorted entries with equal keys put together."""
    last = None
    for entry in entries:
        if last is not None and last[:3] == entry[:3]:
            last = (*last[:3], _better(last[3], entry[3], best), last[4] + entry[4])
        else:
            if last is not None:
                yield last
            last = entry
    if last is not None:
        yield last


def _key(entry: Entry) -> tuple[bytes, int, int]:
    return entry[:3]


def _slice(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - bits) if bits else 0


def _pack(run: int, entries: Iterator[Entry], bits: int) -> pa.Table:
    """Sorted entries as blocks, one for each slice of the digest space."""
    blocks: list[tuple[int, list[Entry]]] = []
    for entry in entries:
        at = _slice(entry[0], bits)
        if not blocks or blocks[-1][0] != at:
            blocks.append((at, []))
        blocks[-1][1].append(entry)
    rows: list[tuple] = []
    for at, block in blocks:
        digests, lengths, checksums, ids, copies = zip(*block)
        rows.append((
            run, at, len(block), b"".join(digests), np.array(lengths, np.int64).tobytes(), np.array(checksums, np.int64).tobytes(),
            np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is not None for i in ids]).tobytes(), np.array(copies, np.int64).tobytes(),
        ))
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    kinds = [pa.int64()] * 3 + [pa.binary()] * 6
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)


def unpacked(row: dict) -> Iterator[Entry]:
    """The entries of a block, in order."""
    digests = row["digests"]
    long = lambda name: np.frombuffer(row[name], np.int64).tolist()
    known = np.frombuffer(row["with_id"], bool).tolist()
    for i, (n, c, identifier, has, k) in enumerate(zip(long("n_bytes"), long("checksums"), long("ids"), known, long("copies"))):
        yield digests[_DIGEST * i : _DIGEST * (i + 1)], n, c, identifier if has else None, k


def _bits(entries: float) -> int:
    """Bits of the digest that cut a run of so many entries into blocks."""
    return max(0, int(np.ceil(np.log2(max(1.0, entries / BLOCK_ENTRIES)))))


def sorted_runs(digests: DataFrame, bits: int, keep: str = "smallest") -> DataFrame:
    """The blocks of every run: each digest once, in order."""
    best = {"smallest": min, "largest": max}[keep]

    def sort(table: pa.Table) -> pa.Table:
        columns = [table[n].to_pylist() for n in (*KEYS, "id")]
        entries = sorted(((d, n, c, i, 1) for d, n, c, i in zip(*columns)), key=_key)
        return _pack(table["run"][0].as_py(), _reduced(entries, best), bits)

    return digests.select("run", *KEYS, "id").groupBy("run").applyInArrow(sort, BLOCK)


def merge_round(runs: DataFrame, fan_in: int, bits: int, next_bits: int, keep: str = "smallest") -> DataFrame:
    """The runs that meet, merged: blocks of ``bits`` come in, blocks of ``next_bits`` go out."""
    best = {"smallest": min, "largest": max}[keep]

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return _pack(rows[0]["met"], _reduced(heapq.merge(*map(unpacked, rows), key=_key), best), next_bits)

    met = runs.withColumn("met", F.floor(F.col("run") / fan_in).cast("long"))
    return met.groupBy("met", "slice").applyInArrow(merge, BLOCK)


def merge_runs(digests: DataFrame, keep: str = "smallest", fan_in: int = 16) -> DataFrame:
    """One row per distinct text: the keys, ``keep_id`` and ``copies``.

    ``keep`` says which identifier stays, "smallest" or "largest".  A null identifier stays
    only where all of a text's identifiers are null.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    total, last = digests.agg(F.count("*"), F.max("run")).first()
    n_runs = (last or 0) + 1
    each = total / n_runs
    bits = _bits(each)
    runs = sorted_runs(digests, bits, keep)
    while n_runs > 1:
        n_runs, each = -(-n_runs // fan_in), min(total, each * fan_in)
        next_bits = max(bits, _bits(each))
        runs = merge_round(runs, fan_in, bits, next_bits, keep)
        bits = next_bits

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = zip(*unpacked(row))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*KEYS, "keep_id", "copies"])

    return runs.mapInArrow(entries, "digest binary, n_bytes long, checksum long, keep_id long, copies long")


def _answered(docs: DataFrame, id_column: str, text_column: str, keep: str, fan_in: int) -> DataFrame:
    digests = digest_table(docs, id_column, text_column)
    answered = answer_by_runs(digests, merge_runs(digests, keep, fan_in), KEYS, "run")
    return answered.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest", fan_in: int = 16
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null
    and empty texts are one group.  ``kept`` marks the row whose id is the one that stays;
    if an id repeats inside a group, all rows that carry it are kept.  Rows with a null id
    are kept only in groups without any id.  An empty table gives an empty result; other
    columns of ``docs`` are not read.
    """
    return _answered(docs, id_column, text_column, keep, fan_in).select(
        F.col("id").alias(id_column),
        "keep_id",
        F.col("copies").alias("group_size"),
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest", fan_in: int = 16
) -> DataFrame:
    """The documents that stay, with all their columns.

    The rows to drop are narrow; an anti join on the id and the raw text's hash takes them
    out, so a repeated id with another text is not hit.
    """
    answered = _answered(docs, id_column, text_column, keep, fan_in)
    gone_id, gone_raw = fresh("gone"), fresh("raw")
    gone = answered.where(~F.col("kept")).select(F.col("id").alias(gone_id), F.col("raw").alias(gone_raw)).distinct()
    match = F.col(id_column).cast("long").eqNullSafe(F.col(gone_id)) & (_raw(text_column) == F.col(gone_raw))
    return docs.join(gone, match, "left_anti")
