"""Hierarchical Pitman-Yor language model of words, with seatings sampled by Gibbs sweeps.

Each context, the whole word before, has a restaurant.  Its parent is the restaurant of the
context's class (two bytes at its end), and all classes hang on one root, whose base measure
is continuous: every new table at the root is a new word, so the mass of the root's next new
table is the probability of a word never seen.  A customer of a restaurant joins a table of
its word or opens one, which sends a customer to the parent.

The state is the number of tables of every word in every context and class; it is written
after each sweep and the next one starts from it.  What no sweep changes (the cells, their
customers, and who asked for them) is written once, bucketed by part, and read where it
lies.  A sweep takes the customers of a cell (a
word in a restaurant) out and seats them again, given the other cells' tables in the
restaurant and the word's tables in the parents.  Cells of up to EXACT customers are drawn
from that distribution itself; the customers of larger ones leave and return in runs.
All cells of a sweep see the totals of contexts, classes and root that the sweep before left.

Every pair that any text asks for has a cell, those without customers too.  In the end each
kept state adds the pair's whole probability to its cell, so the prediction is the mean
of probabilities, which add up to 1 over all words of a context.  The strength of all
restaurants is fixed at STRENGTH; discounts follow from the counts in every sweep.

Counts cover all training texts.  Texts are cut into blocks; words and contexts are dealt
into parts by hash.  A block asks each part for its pairs of context and word, a part asks
the owners of its contexts for their tables, and both get back only what they asked for.
Both ask by name once: a part keeps the places of what a block asked for, and an owner of
contexts those of what a part asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.wordhash import U, hasher
from corpusloom.session import discard, shuffles_removed, write_bucketed, write_through

CLASSES = 16  # 0 is the start of a text, the rest are classes of the last two bytes before
END = np.array([0x1F83D9ABFB41BD6B], U)
SWEEPS, BURN_IN = 6, 2
STRENGTH = 1.0
ADD = 0.1  # of the base score
#: Bytes of text in a block, which one task scores at a time, and for each part of the words.
BLOCK_BYTES, PART_BYTES = 8 << 20, 4 << 20
#: Parts in a bucket of what is written once.
BUCKET_PARTS = 8
#: Customers of a cell whose tables are drawn exactly.
EXACT = 64
#: Runs in which the customers of larger cells are moved.
RUNS = 32
#: Records of a state in one row; readers and writers hold thousands of rows at once.
ROW_RECORDS = 4096

_PAIR = np.dtype([("word", "<u8"), ("context", "<u8"), ("n", "<u8")])
_CELL = np.dtype([("word", "<u8"), ("context", "<u8"), ("n", "<u8"), ("t", "<u8"), ("sum", "<f4")])
_TABLES = np.dtype([("word", "<u8"), ("context", "<u8"), ("n", "<u8"), ("t", "<u8")])
_WORD = np.dtype([("word", "<u8"), ("s", "<u8", CLASSES)])
_SEATS = np.dtype([("s", "<u8", CLASSES)])
_NUMBER = np.dtype([("value", "<u8")])
_PLACE = np.dtype([("class", "<u8"), ("part", "<u8"), ("lone", "<u8")])
_NAME = np.dtype([("context", "<u8")])
_CONTEXT = np.dtype([("context", "<u8"), ("n", "<u8"), ("t", "<u8")])
_SEATED = np.dtype([("n", "<u8"), ("t", "<u8")])
_ANSWER = np.dtype([("n", "<u8"), ("p", "<f4")])
ASK, CELLS, WORDS, CONTEXTS, SUMS, REPLY, TOTAL, ASKED, OWN, TABLES, SEATS, TOLD, KEPT, MOVING, ALONE, PLACES = range(16)
_ROW = "part long, kind int, source long, data binary"
#: What only some readers need has columns of its own, so that the others do not read it.
_STATE = f"{_ROW}, sums binary, total binary, asked binary, moving binary"


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes (words and one end per text), contexts, and each text's first token.

    A context is the hash of the whole word before with its class in the last four bits.
    """
    _, _, hashes, tails, begins = hasher().pieces(texts, (-2,))
    n, counts = len(texts), np.diff(begins)
    firsts = begins + np.arange(n + 1)
    words = np.empty(len(hashes) + n, U)
    contexts = np.zeros(len(words), U)
    ends = firsts[1:] - 1
    inner = np.ones(len(words), bool)
    inner[ends] = False
    words[ends] = END
    words[inner] = hashes
    classes = (tails >> U(7)) % U(CLASSES - 1) + U(1)
    after = np.flatnonzero(inner) + 1  # the token behind each word
    contexts[after] = hashes & ~U(CLASSES - 1) | classes
    assert counts.sum() == len(hashes)
    return words, contexts, firsts


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> U(20)) % U(parts)).astype(np.int64)


def _by_part(part: np.ndarray) -> np.ndarray:
    """The order that brings records together by part."""
    return np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")


def _class(contexts: np.ndarray) -> np.ndarray:
    return (contexts & U(CLASSES - 1)).astype(np.int64)


def _steps(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where sorted records differ from those before."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return new


def _added(words: np.ndarray, contexts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with their counts, sorted by word and context, and each token's pair."""
    key = words & ~U((1 << 20) - 1) | contexts >> U(44)
    order = np.argsort(key)
    key, words, contexts = key[order], words[order], contexts[order]
    new = _steps(words, contexts)
    first = _steps(key)
    if (new & ~first).any():  # contexts that the key does not tell apart are sorted among themselves
        run = np.cumsum(first) - 1
        mixed = np.zeros(run[-1] + 1, bool)
        mixed[run[new & ~first]] = True
        at = np.flatnonzero(mixed[run])
        again = at[np.lexsort((contexts[at], words[at]))]
        order[at], words[at], contexts[at] = order[again], words[again], contexts[again]
        new = _steps(words, contexts)
    if ((words[1:] < words[:-1]) | (words[1:] == words[:-1]) & (contexts[1:] < contexts[:-1])).any():
        again = np.lexsort((contexts, words))  # words that it does not tell apart
        order, words, contexts = order[again], words[again], contexts[again]
        new = _steps(words, contexts)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    out = np.empty(int(new.sum()), _PAIR)
    out["word"], out["context"] = words[new], contexts[new]
    out["n"] = np.bincount(inverse, n, len(out))  # doubles count exactly up to 2^53
    return out, inverse


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    part, kind, source, data = zip(*rows)
    return pa.record_batch(
        [pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(source, pa.int64()), pa.array(data, pa.binary())],
        names=["part", "kind", "source", "data"])


def _state_rows(rows: list[tuple]) -> pa.Table:
    part, kind, source, data = zip(*rows)
    longs = [pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(source, pa.int64())]
    own = {SUMS: "sums", TOTAL: "total", ASKED: "asked", **dict.fromkeys((MOVING, ALONE, PLACES), "moving")}
    names = ["data", "sums", "total", "asked", "moving"]
    told = [pa.array([d if own.get(k, "data") == name else None for k, d in zip(kind, data)], pa.binary()) for name in names]
    return pa.table([*longs, *told], names=["part", "kind", "source", *names])


def _bytes(records: np.ndarray) -> bytes:
    """Records field by field, which packs well; of whole numbers the bytes that the largest one needs."""
    out = [len(records).to_bytes(8, "little")]
    for name in records.dtype.names:
        column = np.ascontiguousarray(records[name])
        if column.dtype.kind == "u":
            width = (int(column.max(initial=0)).bit_length() + 7) // 8
            out.append(bytes([width]))
            if width < 8:  # lowest bytes of all, then the next ones
                column = np.ascontiguousarray(column.view(np.uint8).reshape(-1, 8)[:, :width].T)
        out.append(column.tobytes())
    return b"".join(out)


def _records(data: bytes, dtype: np.dtype) -> np.ndarray:
    out = np.zeros(int.from_bytes(data[:8], "little"), dtype)
    at = 8
    for name in dtype.names:
        base, shape = dtype[name].base, out[name].shape
        count = math.prod(shape)
        width = base.itemsize
        if base.kind == "u":
            width, at = data[at], at + 1
        if width == base.itemsize:
            out[name] = np.frombuffer(data, base, count, at).reshape(shape)
        elif width:
            column = np.zeros((count, base.itemsize), np.uint8)
            column[:, :width] = np.frombuffer(data, np.uint8, width * count, at).reshape(width, count).T
            out[name] = column.reshape(-1).view(base).reshape(shape)
        at += width * count
    return out


def _numbers(values: np.ndarray) -> bytes:
    out = np.empty(len(values), _NUMBER)
    out["value"] = values
    return _bytes(out)


def _short(part: int, kind: int, records: np.ndarray, first: int = 0) -> list[tuple]:
    """Records in short rows, numbered from ``first`` on."""
    return [(part, kind, first + at, _bytes(records[at : at + ROW_RECORDS])) for at in range(0, len(records), ROW_RECORDS)]


def _dealt(records: np.ndarray, key: str, parts: int, kind: int, source: int) -> list[tuple]:
    """One row per part that owns some of the records."""
    part = _part(records[key], parts)
    order = _by_part(part)
    records = records[order]
    return [(p, kind, source, _bytes(records[at:upto])) for p, at, upto in zip(*_runs(part[order]))]


def _chosen(table: pa.Table, kind: int, column: str = "data", sweep: int | None = None) -> list[tuple[int, bytes]]:
    """Sources and data of all rows of a kind (or of those of one sweep), by source."""
    sources, wanted = table.column("source").to_numpy(), table.column("kind").to_numpy() == kind
    if sweep is not None:
        wanted &= sources >> 32 == sweep
    return sorted(zip(sources[wanted].tolist(), table.column(column).filter(pa.array(wanted)).to_pylist()))


def _read(table: pa.Table, kind: int, dtype: np.dtype, sweep: int | None = None) -> np.ndarray:
    """The records of all rows of a kind, by source."""
    chosen = _chosen(table, kind, sweep=sweep)
    return np.concatenate([np.empty(0, dtype), *(_records(d, dtype) for _, d in chosen)])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the number of their block; blocks are runs of a task's texts."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        numbers = []
        for length in pc.binary_length(batch.column(2)).to_pylist():
            if size and size + length > BLOCK_BYTES:
                block, size = block + 1, 0
            size += length
            numbers.append(block)
        yield pa.record_batch([pa.array(numbers, pa.int64()), *batch.columns], names=["block", *batch.schema.names])


def _count(parts: int):
    """What each block asks of each part: its pairs, with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def flush():
            pairs, _ = _added(*(np.concatenate(c) for c in zip(*held)))
            held.clear()
            return _rows(_dealt(pairs, "word", parts, ASK, now))

        for batch in batches:
            blocks, train = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]  # a task's files have any order
            for first, upto in zip(cuts[:-1], cuts[1:]):
                block = int(blocks[first]) if upto else None
                if held and block != now:
                    yield flush()
                now = block
                for at in range(first, upto, 512):
                    end = min(at + 512, upto)
                    words, contexts, firsts = tokens(batch.column(2).slice(at, end - at).cast(pa.binary()).to_pylist())
                    held.append((words, contexts, np.repeat(train[at:end].astype(float), np.diff(firsts))))
        if held:
            yield flush()

    return run


class Totals:
    """Customers, tables and discounts of the classes and the root, and the contexts' discounts."""

    def __init__(self, sums: np.ndarray):
        cells, at_class = sums[:48].reshape(3, CLASSES), sums[48:112].reshape(4, CLASSES)
        self.all, self.words = float(cells[0].sum()), float(sums[112])
        self.context_discount = _discount(*cells[1:])
        self.customers, self.tables = at_class[:2]
        self.discount = _discount(*at_class[2:])
        self.root_discount = float(_discount(*sums[113:115]))

    @property
    def new_word(self) -> float:
        """Probability at the root of a word never seen."""
        return (STRENGTH + self.root_discount * self.words) / (STRENGTH + self.tables.sum())

    @property
    def back_off(self) -> np.ndarray:
        """Share of every class that the root decides."""
        return (STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers)

    def root(self, tables: np.ndarray) -> np.ndarray:
        """Probability at the root of words with so many tables in the classes."""
        seen = (tables - self.root_discount) / (STRENGTH + self.tables.sum())
        return np.where(tables > 0, seen, self.new_word)


def _discount(ones, twos):
    """From the numbers of cells with one and with two customers."""
    known = (ones > 0) & (twos > 0)
    return np.clip(np.where(known, ones / np.maximum(ones + 2 * twos, 1), 0.5), 0.02, 0.98)


@lru_cache(maxsize=256)
def _ways(discount: float) -> np.ndarray:
    """Logarithms of the weights of n customers at t tables (generalised Stirling numbers)."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    t = np.arange(1, EXACT + 1)
    for n in range(1, EXACT):
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(n - discount * t, 1e-300)) + out[n, 1:]
        out[n + 1, 1:] = np.logaddexp(out[n, :-1], stay)
    return out


def _alone(n: np.ndarray, t: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Expected tables with one customer among t tables of n customers.

    Table sizes are tilted Sibuya numbers; the tilt x = 1 - exp(-z) makes their mean n / t.
    The mean's logarithm is convex in z and its slope (1 - d) / 2 at least, so Newton's steps
    come down to z from the first one.
    """
    wanted = np.log(n / t)
    z = np.clip(2 * wanted / (1 - d), 1e-9, 700)
    for _ in range(40):
        mean = np.log(d * np.expm1(-z) / np.expm1(-d * z)) + (1 - d) * z
        slope = 1 / np.expm1(z) - d / np.expm1(d * z) + 1 - d
        last, z = z, np.clip(z - (mean - wanted) / np.maximum(slope, (1 - d) / 2), 1e-9, 700)
        if (abs(z - last) <= 1e-8 * z).all():  # steps square the error
            break
    return np.minimum((t - 1) * d * np.expm1(-z) / np.expm1(-d * z), n)


def reseat(n: np.ndarray, t: np.ndarray, others: np.ndarray, d: np.ndarray, p: np.ndarray, rng) -> np.ndarray:
    """Tables of cells with n customers, drawn anew from the state with t tables.

    ``others`` counts the tables of other words in the restaurant, ``d`` is its discount and
    ``p`` the parent's probability of the word, given the word's other tables.
    """
    n, t, p = n.astype(np.int64), t.astype(np.int64), np.maximum(p, 1e-300)
    out = np.minimum(np.maximum(t, 1), n)
    rates = np.unique(d)
    rate_of = np.searchsorted(rates, d)
    ways = np.stack([_ways(float(x)) for x in rates]) if len(rates) else None
    small = np.flatnonzero((n > 1) & (n <= EXACT))
    small = small[np.argsort(n[small].astype(np.uint8), kind="stable")]
    for size, at, upto in zip(*_runs(n[small])):
        for k in range(at, upto, 2_000_000 // size):
            rows = small[k : min(k + 2_000_000 // size, upto)]
            opened = STRENGTH + d[rows, None] * (others[rows, None] + np.arange(1, size))
            weight = ways[rate_of[rows], size, 1 : size + 1]
            weight[:, 1:] += np.cumsum(np.log(opened * p[rows, None]), 1)
            share = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            out[rows] = 1 + (share < rng.random(len(rows))[:, None] * share[:, -1:]).sum(1)
    large = np.flatnonzero(n > EXACT)
    if len(large):
        n, d, others, p, now = n[large], d[large], others[large], p[large], out[large]
        for k in range(RUNS):
            moved = n * (k + 1) // RUNS - n * k // RUNS
            rest = np.maximum(now - 1, 1)
            leave = rng.binomial(now - 1, np.clip(moved / (n - moved / 2) * _alone(n, now, d) / rest, 0, 1))
            opens = (STRENGTH + d * (others + now)) * p
            now = np.clip(now - leave + rng.binomial(moved, opens / (opens + n - moved / 2 - d * now)), 1, n)
        out[large] = now
    return out


def _runs(values: np.ndarray) -> tuple[list, list, list]:
    """Distinct sorted values with the places where each begins and ends."""
    firsts = np.flatnonzero(_steps(values))
    return values[firsts].tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(values)][: len(firsts)]


class _State:
    """A part's cells, words and the contexts they need, all sorted."""

    def __init__(self, cells: np.ndarray, words: np.ndarray, contexts: np.ndarray, owner: np.ndarray, place: np.ndarray):
        self.cells, self.words, self.contexts, self.owner, self.place = cells, words, contexts, owner, place
        self.kind = _class(self.cells["context"])

    @classmethod
    def begun(cls, pairs: np.ndarray) -> _State:
        return cls.of(_added(pairs["word"], pairs["context"], pairs["n"])[0])

    @classmethod
    def of(cls, pairs: np.ndarray) -> _State:
        """One table per word and context with customers, and per word and class; each pair stands there once, sorted."""
        cells = np.zeros(len(pairs), _CELL)
        cells["word"], cells["context"], cells["n"], cells["t"] = pairs["word"], pairs["context"], pairs["n"], pairs["n"] > 0
        first = _steps(cells["word"])
        names, owner = cells["word"][first], np.cumsum(first) - 1
        asked, place = np.unique(cells["context"], return_inverse=True)
        words, contexts = np.zeros(len(names), _WORD), np.zeros(len(asked), _NAME)
        words["word"], contexts["context"] = names, asked
        out = cls(cells, words, contexts, owner, place)
        out.words["s"] = out.at_classes(out.cells["t"]) > 0
        return out

    @classmethod
    def read(cls, table: pa.Table) -> _State:
        told, words, contexts = _read(table, CELLS, _TABLES), _read(table, WORDS, _WORD), _read(table, CONTEXTS, _NAME)
        # rows name words and contexts by their numbers, which take fewer bytes
        owner, place = told["word"].astype(np.int64), told["context"].astype(np.int64)
        cells = np.zeros(len(told), _CELL)
        cells["word"], cells["context"] = words["word"][owner], contexts["context"][place]
        cells["n"], cells["t"] = told["n"], told["t"]
        return cls(cells, words, contexts, owner, place)

    def move(self, table: pa.Table, sweep: int) -> None:
        """On to the seating that a sweep has left; only cells of more than one customer can have changed."""
        self.cells["t"][self.cells["n"] > 1] = _read(table, TABLES, _NUMBER, sweep)["value"]
        self.words["s"] = _read(table, SEATS, _SEATS, sweep)["s"]

    def at_classes(self, values: np.ndarray) -> np.ndarray:
        """Cells' values summed by word and class."""
        size = len(self.words) * CLASSES
        return np.bincount(self.owner * CLASSES + self.kind, values, size)[:size].reshape(-1, CLASSES)

    def sample(self, totals: Totals, told: np.ndarray) -> None:
        """Add every pair's probability under the present seating to its sum."""
        m, s = self.at_classes(self.cells["t"]), self.words["s"].astype(float)
        parent = np.maximum(m - totals.discount * s, 0) / (STRENGTH + totals.customers)
        parent += totals.back_off * totals.root(s.sum(1))[:, None]
        d, n, t = totals.context_discount[self.kind], *(self.cells[c].astype(float) for c in ("n", "t"))
        customers, tables = (told[c].astype(float)[self.place] for c in ("n", "t"))
        back_off = (STRENGTH + d * tables) * parent.ravel()[self.owner * CLASSES + self.kind]
        self.cells["sum"] += (np.maximum(n - d * t, 0) + back_off) / (STRENGTH + customers)

    def sweep(self, totals: Totals, tables: np.ndarray, rng) -> None:
        """Seat all customers again: those of contexts given the classes, then those of classes given the root."""
        t, s = self.cells["t"].astype(np.int64), self.words["s"].astype(float)
        m = self.at_classes(t)
        root = totals.root(s.sum(1))
        moving = np.flatnonzero(self.cells["n"] > 1)  # a lone customer has a table, none has none
        t, owner, kind = t[moving], self.owner[moving], self.kind[moving]
        # the cell's other customers at the parent, and the one that its first table has sent
        at = owner * CLASSES + kind
        rest = m.ravel()[at] - t + 1
        open_tables = np.minimum(s.ravel()[at], rest)
        p = (rest - totals.discount[kind] * open_tables) / (STRENGTH + totals.customers[kind])
        p = p + totals.back_off[kind] * root[owner]
        others = np.maximum(tables[self.place[moving]] - t, 0)
        self.cells["t"][moving] = reseat(self.cells["n"][moving], t, others, totals.context_discount[kind], p, rng)
        m = self.at_classes(self.cells["t"])
        at = np.flatnonzero(m.ravel())
        owner, kind = np.divmod(at, CLASSES)
        before = s.ravel()[at]
        p = totals.root(np.maximum(s.sum(1)[owner] - before, 0) + 1)
        others = np.maximum(totals.tables[kind] - before, 0)
        self.words["s"][owner, kind] = reseat(m.ravel()[at], before, others, totals.discount[kind], p, rng)

    def sent(self) -> np.ndarray:
        """What the cells add to their contexts."""
        out = np.zeros(len(self.contexts), _CONTEXT)
        out["context"] = self.contexts["context"]
        for c in ("n", "t"):
            out[c] = np.bincount(self.place, self.cells[c], len(out))
        return out

    def sums(self) -> np.ndarray:
        """What the state adds to the totals."""
        n = self.cells["n"]
        return np.concatenate([*(np.bincount(self.kind, x, CLASSES) for x in (n, n == 1, n == 2)), self.seated()]).astype("<f8")

    def seated(self) -> np.ndarray:
        """Those of the sums that follow from the tables."""
        m, s = self.at_classes(self.cells["t"]), self.words["s"].astype(np.int64)
        classes = [x.sum(0) for x in (m, s, m == 1, m == 2)]
        root = s.sum(1)
        return np.concatenate([*classes, [(root > 0).sum(), (root == 1).sum(), (root == 2).sum()]]).astype("<f8")

    def held(self, part: int) -> list[tuple]:
        """The state and its sums by class; no sums of probabilities, which are only made in the end."""
        cells = np.empty(len(self.cells), _TABLES)
        cells["word"], cells["context"], cells["n"], cells["t"] = self.owner, self.place, self.cells["n"], self.cells["t"]
        out = [row for kind, records in ((CELLS, cells), (WORDS, self.words), (CONTEXTS, self.contexts))
               for row in _short(part, kind, records)]
        return [*out, (part, TOTAL, 0, self.sums().tobytes())]

    def asks(self, part: int, parts: int) -> list[tuple]:
        """What the cells add to their contexts, by name."""
        return _dealt(self.sent(), "context", parts, SUMS, part)

    def rows(self, part: int, parts: int) -> list[tuple]:
        return self.held(part) + self.asks(part, parts)

    def moving(self, part: int, parts: int) -> list[tuple]:
        """What a sweep needs: cells of more than one customer, and the tables of the others by word and by context."""
        moving = self.cells["n"] > 1
        cells = np.empty(int(moving.sum()), _TABLES)
        cells["word"], cells["context"] = self.owner[moving], self.place[moving]
        cells["n"], cells["t"] = self.cells["n"][moving], self.cells["t"][moving]
        lone = np.where(moving, 0, self.cells["t"])
        alone, places = np.empty(len(self.words), _SEATS), np.empty(len(self.contexts), _PLACE)
        alone["s"] = self.at_classes(lone)
        places["class"], places["part"] = _class(self.contexts["context"]), _part(self.contexts["context"], parts)
        places["lone"] = np.bincount(self.place, lone, len(places))
        return [row for kind, records in ((MOVING, cells), (ALONE, alone), (PLACES, places)) for row in _short(part, kind, records)]


class _Moving(_State):
    """Of a state what ``moving`` has told; its cells move as those of the whole state do."""

    def __init__(self, table: pa.Table):
        self.cells, places = _read(table, MOVING, _TABLES), _read(table, PLACES, _PLACE)
        self.alone = _read(table, ALONE, _SEATS)["s"].astype(float)
        self.owner, self.place = self.cells["word"].astype(np.int64), self.cells["context"].astype(np.int64)
        self.kind = places["class"].astype(np.int64)[self.place]
        self.part, self.lone = places["part"].astype(np.int64), places["lone"]
        self.order = _by_part(self.part)  # as contexts were asked for by name
        self.words = np.zeros(len(self.alone), _SEATS)

    def begin(self) -> None:
        """One table per word and class."""
        self.words["s"] = self.at_classes(self.cells["t"]) > 0

    def at_classes(self, values: np.ndarray) -> np.ndarray:
        return super().at_classes(values) + self.alone

    def told(self, records: np.ndarray) -> np.ndarray:
        """Replies in the order of the contexts."""
        out = np.empty_like(records)
        out[self.order] = records
        return out

    def moved(self, part: int, sweep: int, told: np.ndarray | None) -> list[tuple]:
        """What a sweep has changed, its sums, and the tables of the contexts that it was told if these are kept."""
        first, seats = sweep << 32, np.empty(len(self.words), _SEATS)
        seats["s"] = self.words["s"]
        out = _short(part, TABLES, self.cells["t"].astype("<u8").view(_NUMBER), first) + _short(part, SEATS, seats, first)
        if told is not None:
            out += _short(part, KEPT, told.astype("<u8").view(_NUMBER), first)
        tables = (np.bincount(self.place, self.cells["t"], len(self.lone)) + self.lone)[self.order]
        names, firsts, ends = _runs(self.part[self.order])
        out += [(p, SUMS, part, _numbers(tables[at:upto])) for p, at, upto in zip(names, firsts, ends)]
        return [*out, (part, TOTAL, 0, np.concatenate([np.zeros(3 * CLASSES), self.seated()]).astype("<f8").tobytes())]


def _begin(parts: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """A part's first state, and for each block the steps between the cells it asked for."""
        part, chosen = key[0].as_py(), _chosen(table, ASK)
        asked = [_records(d, _PAIR) for _, d in chosen]
        cuts = np.cumsum([len(x) for x in asked])[:-1]
        flat = np.concatenate(asked)
        asked.clear()
        pairs, cell = _added(flat["word"], flat["context"], flat["n"])
        of_block: dict[int, list[np.ndarray]] = {}
        for (block, _), cells in zip(chosen, np.split(cell, cuts)):
            of_block.setdefault(block, []).append(cells)
        state = _State.of(pairs)
        out = state.held(part) + state.moving(part, parts)
        for block, cells in of_block.items():  # one that two tasks have read stands there twice
            cells = cells[0] if len(cells) == 1 else np.unique(np.concatenate(cells))
            out.append((part, ASKED, block, _numbers(np.diff(cells, prepend=0))))
        return _state_rows(out)

    return run


def _send(parts: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_rows(_State.read(table).asks(key[0].as_py(), parts))])

    return run


def _reply(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Customers and tables of the part's contexts, to each part that has cells in them, in the order it asked.

    The part keeps the places of the contexts that each one asked for.
    """
    kinds = table.column("kind").to_numpy()
    parts = table.column("source").to_numpy()[kinds == SUMS].tolist()
    sent = [_records(d, _CONTEXT) for d in table.column("data").filter(pa.array(kinds == SUMS)).to_pylist()]
    flat = np.concatenate(sent)
    names, owner = np.unique(flat["context"], return_inverse=True)
    added = np.zeros(len(names), _SEATED)
    for c in ("n", "t"):
        added[c] = np.bincount(owner, flat[c], len(names))
    own = np.split(owner, np.cumsum([len(x) for x in sent])[:-1])
    replies = [(p, REPLY, key[0].as_py(), _bytes(added[o])) for p, o in zip(parts, own)]
    return pa.Table.from_batches([_rows(replies + [(key[0].as_py(), OWN, p, _numbers(o)) for p, o in zip(parts, own)])])


def _tell(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """Tables of the part's contexts after a sweep, to each part in the order in which it once asked by name."""
    asked, sent = _chosen(left, OWN), _chosen(right, SUMS)
    if [p for p, _ in asked] != [p for p, _ in sent]:
        raise RuntimeError("the tables of a sweep have not come from all parts that asked")
    places = [_records(d, _NUMBER)["value"].astype(np.int64) for _, d in asked]
    added = np.zeros(max(int(x.max(initial=-1)) for x in places) + 1)
    for place, (_, data) in zip(places, sent):
        added[place] += _records(data, _NUMBER)["value"]  # a part asks for a context once
    return pa.Table.from_batches(
        [_rows([(p, TOLD, key[0].as_py(), _numbers(added[place])) for (p, _), place in zip(asked, places)])])


def _told(table: pa.Table, state: _State, parts: int, kind: int = REPLY, dtype: np.dtype = _SEATED) -> np.ndarray:
    """The replies in the order of the state's contexts."""
    told = _read(table, kind, dtype)
    out = np.empty(len(state.contexts), dtype)  # a reply for each context
    out[_by_part(_part(state.contexts["context"], parts))] = told
    return out


def _sweep(packed):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        totals, sweep, kept = packed.value
        part = key[0].as_py()
        state = _Moving(left)
        if sweep == 1:
            state.begin()
            told = state.told(_read(right, REPLY, _SEATED)["t"])
        else:
            state.move(right, sweep - 1)
            told = state.told(_read(right, TOLD, _NUMBER)["value"])
        state.sweep(totals, told.astype(float), np.random.default_rng([sweep, part]))
        return _state_rows(state.moved(part, sweep, told if sweep - 1 in kept else None))

    return run


def _answer(packed, parts: int):
    """Per block the probabilities of the pairs it asked for, in their order, and the words' training counts."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        of_sweep, last = packed.value
        state = _State.read(left)
        told = _told(right, state, parts)
        for sweep, totals in sorted(of_sweep.items()):
            if sweep > 0:
                state.move(right, sweep)
            if sweep == last > 0:
                told["t"] = _told(right, state, parts, TOLD, _NUMBER)["value"]
            elif sweep > 0:
                told["t"] = _read(right, KEPT, _NUMBER, sweep + 1)["value"]
            state.sample(totals, told)
        count = np.bincount(state.owner, state.cells["n"], len(state.words))
        out = []
        for block, data in _chosen(left, ASKED, "asked"):
            cells = np.cumsum(_records(data, _NUMBER)["value"].astype(np.int64))
            records = np.empty(len(cells), _ANSWER)
            records["p"] = state.cells["sum"][cells] / len(of_sweep)
            records["n"] = count[state.owner[cells]]
            out.append((block, ASK, key[0].as_py(), _bytes(records)))
        return pa.Table.from_batches([_rows(out)])

    return run


def _score(packed, parts: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        of_sweep, last = packed.value
        totals = of_sweep[last]
        held, texts = [], left.column("text")
        for at in range(0, left.num_rows, 512):
            words, contexts, firsts = tokens(texts.slice(at, 512).cast(pa.binary()).to_pylist())
            held.append((words, contexts, np.diff(firsts)))
        words, contexts, sizes = (np.concatenate(c) for c in zip(*held))
        held.clear()
        pairs, pair = _added(words, contexts, np.ones(len(words)))
        told = np.empty(len(pairs), _ANSWER)  # a block has an answer for each of its pairs
        told[_by_part(_part(pairs["word"], parts))] = _read(right, ASK, _ANSWER)
        base = np.log10((told["n"] + ADD) / (totals.all + ADD * (totals.words + 1)))
        logs = np.log10(np.maximum(told["p"].astype(float), 1e-300))
        cuts = np.cumsum(sizes) - sizes
        out = [sizes, *(np.add.reduceat(x[pair], cuts) for x in ((told["n"] > 0).astype(np.int64), base, logs))]
        n = left.num_rows
        return pa.table(
            [left.column("id"), left.column("train"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
             pa.array([int(totals.all)] * n, pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())],
            names=["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text",
          sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """Learn from the rows for which ``train`` holds and score all rows.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).
    Tokens are words between white space, lower-cased (A-Z), and one end per text; null and
    empty texts are the end alone.  Repeated rows count and are scored as often as they
    stand there; rows with a null id are dealt and scored like others.  Without training
    rows every word is new.  ``score`` is finite for every text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, math.ceil(total / PART_BYTES))
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), text.alias("text"))
    # blocks follow from the partitions, which must not change between the passes
    rows = write_through(
        rows.mapInArrow(_cut, f"block long, id {kind}, train boolean, text string"), "blocks", compression="zstd")
    buckets = math.ceil(parts / BUCKET_PARTS)

    def sums(table: DataFrame) -> np.ndarray:
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(115)
            for batch in batches:
                for d in batch.column(0).to_pylist():
                    sums += np.frombuffer(d, "<f8")
            yield pa.record_batch([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["sums"])

        found = table.where(F.col("kind") == TOTAL).select("total").mapInArrow(read, "sums array<double>")
        added = found.agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(115)]).first()
        return np.array([x or 0.0 for x in added])

    def totals(moved: list[DataFrame]) -> Totals:
        """After the last of the sweeps; customers stay what they were."""
        return Totals(np.concatenate([begun[: 3 * CLASSES], sums(moved[-1])[3 * CLASSES :]]) if moved else begun)

    def told(moved: list[DataFrame]) -> DataFrame:
        """The tables of the contexts that every part asked for, after the last of the sweeps."""
        if not moved:
            return links.where(F.col("kind") == REPLY)
        sent = seatings(moved[-1], SUMS, column="sums")
        return links.where(F.col("kind") == OWN).groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(_tell, _ROW)

    def seatings(table: DataFrame, *kinds: int, column: str = "data") -> DataFrame:
        return table.where(F.col("kind").isin(*kinds)).select("part", "kind", "source", F.col(column).alias("data"))

    with shuffles_removed(spark):
        asks = rows.select("block", "train", "text").mapInArrow(_count(parts), _ROW)
        state = write_bucketed(asks.groupBy("part").applyInArrow(_begin(parts), _STATE), "state", buckets, "part", compression="zstd")
        begun = sums(state)
        moving = seatings(state, MOVING, ALONE, PLACES, column="moving")
        sent = seatings(state, CELLS, WORDS, CONTEXTS).groupBy("part").applyInArrow(_send(parts), _ROW)
        # replies go to parts other than the one that makes them
        replies = sent.groupBy("part").applyInArrow(_reply, _ROW).repartition(buckets, "part")
        links = write_bucketed(replies, "links", buckets, "part", compression="zstd")
        kept, left, moved = range(burn_in + 1, sweeps + 1), {}, []
        for sweep in range(1, sweeps + 1):
            left[sweep - 1] = totals(moved)
            packed = spark.sparkContext.broadcast((left[sweep - 1], sweep, kept))  # a few numbers per class
            heard = told(moved)
            for table in moved[-1:]:
                heard = heard.unionAll(seatings(table, TABLES, SEATS))
            swept = moving.groupBy("part").cogroup(heard.groupBy("part")).applyInArrow(_sweep(packed), _STATE)
            moved.append(write_through(swept, "moved"))
            if sweep > 1 and sweep - 1 not in kept and sweep - 2 not in kept:
                discard(moved[-2])
        left[sweeps] = totals(moved)
        packed = spark.sparkContext.broadcast(({k: left[k] for k in kept}, sweeps))
        heard = told(moved)
        if moved:
            heard = heard.unionAll(links.where(F.col("kind") == REPLY))
        for k, table in enumerate(moved, 1):
            kinds = [x for x, wanted in ((TABLES, k in kept), (SEATS, k in kept), (KEPT, k - 1 in kept)) if wanted]
            if kinds:
                heard = heard.unionAll(seatings(table, *kinds))
        whole = state.where(F.col("kind").isin(CELLS, WORDS, CONTEXTS, ASKED)).select("part", "kind", "source", "data", "asked")
        answers = write_through(
            whole.groupBy("part").cogroup(heard.groupBy("part")).applyInArrow(_answer(packed, parts), _ROW), "answers")
    discard(state, links, *moved)
    result = f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = rows.groupBy("block").cogroup(answers.groupBy("part")).applyInArrow(_score(packed, parts), result)
    return scored.select(
        F.col("id").alias(id_column), (~F.col("train")).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score")
