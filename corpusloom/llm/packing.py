"""Hierarchical packing of token sequences into windows of several lengths.

Each document is tokenised to one run of ids.  Its length routes it to a tier: documents
that reach the longest window are cut into whole windows of it, and what remains is routed
like a document of its own length, to the shortest tier that can hold it.  Every tier packs
its own documents, best fit by room left; a window that cannot be filled by its own tier is
closed by documents of shorter tiers, the last of them cut where the window ends.  At the
end of a task the open rests are cut into powers of two, so no window needs padding.

A task packs what its partition holds and keeps a bounded number of open documents, so
memory does not depend on the partition, and only a task's end leaves short windows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm.common import fresh

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Documents a task may hold open per tier while it looks for a good fit.
OPEN_DOCUMENTS = 512
#: Distinct chunks whose ids a worker remembers, in each of two generations.
CACHE_CHUNKS = 500_000
#: Tokens of a step group: as many as 64 of the longest windows.
STEP_WINDOWS = 64

#: White space ends a word of the tokenizer and has no ids, so chunks between white space are
#: encoded apart.  ``str.split`` also cuts at these four characters, which are no white space to it.
_NO_SPACE = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: ASCII and precomposed Latin letters: normalising leaves them alone, and each is lower-cased by
#: itself.  Only U+0130 is left out.  Such a chunk is cut where the tokenizer cuts it, and the
#: cuts, of which there are far fewer different ones, are encoded.
_LATIN = "\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"[!-~{_LATIN}]+")
# Where the vocabulary's words end.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it is printable, else one past 255, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ChunkEncoder:
    """Little-endian uint32 ids of texts, by a cache of chunks between white space.

    The cache has two generations: what was not asked for while a generation filled up goes
    with the next one, so a rare chunk does not throw out the frequent ones.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.merges, self.letters = self.tokenizer.model, _byte_letters()
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _missing(self, chunks: set[str]) -> None:
        """Puts the chunks into the cache; words that chunks are made of are chunks as well."""
        if len(self.cache) + len(chunks) > CACHE_CHUNKS:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        cut: list[tuple[str, list[str]]] = []
        new: set[str] = set()  # to be encoded whole
        plain: set[str] = set()  # words: nothing is left to do but their merges
        for chunk in chunks:
            if chunk in older:
                cache[chunk] = older[chunk]
            elif _PLAIN.fullmatch(chunk) and "<|" not in chunk:  # the vocabulary's special marks stay whole
                low = chunk.lower()
                words = _WORDS.findall(low)
                if len(words) > 1 or low != chunk:
                    cut.append((chunk, words))
                plain.update(words)
            else:
                new.add(chunk)
        ordered = [w for w in new if w not in cache]
        for word, coded in zip(ordered, self.tokenizer.encode_batch_fast(ordered, add_special_tokens=False)):
            cache[word] = array("I", coded.ids).tobytes()
        merge, letters = self.merges.tokenize, self.letters
        for word in plain:
            if word not in cache:
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
                cache[word] = array("I", [t.id for t in merge(spelled)]).tobytes()
        for chunk, words in cut:
            cache[chunk] = cache[words[0]] if len(words) == 1 else b"".join([cache[w] for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_SPACE.split(t) if any(c in t for c in _NO_SPACE) else t.split() for t in texts]
        get = self.cache.get
        found = [list(map(get, chunks)) for chunks in cut]
        new = {c for chunks, ids in zip(cut, found) if None in ids for c, i in zip(chunks, ids) if i is None}
        if new:
            self._missing(new)
            get = self.cache.get
            # a text whose chunks were all known keeps what it got, from whichever generation
            found = [list(map(get, chunks, ids)) if None in ids else ids for chunks, ids in zip(cut, found)]
        return [b"".join(ids) for ids in found]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core, not the machine
    return ChunkEncoder(path)


class Packer:
    """Packs the documents of one task; yields (document, start, length, sequence, offset, tier)."""

    def __init__(self, tiers: tuple[int, ...], base: int):
        self.tiers, self.longest = tiers, tiers[-1]
        self.next = base
        #: per tier: open pieces as (length, number), shortest first
        self.open: list[list[tuple[int, int]]] = [[] for _ in tiers]
        self.pieces: dict[int, tuple[int, int, int]] = {}  # number -> document, start, length
        self.count = 0

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _tier(self, length: int) -> int:
        return bisect_left(self.tiers, length)

    def _hold(self, doc: int, start: int, length: int) -> None:
        if length:
            self.pieces[self.count] = (doc, start, length)
            insort(self.open[self._tier(length)], (length, self.count))
            self.count += 1

    def _take(self, tier: int, room: int):
        """The longest open piece of the tier that fits the room."""
        pool = self.open[tier]
        at = bisect_left(pool, (room + 1, -1)) - 1
        return self.pieces.pop(pool.pop(at)[1]) if at >= 0 else None

    def _fill(self, tier: int) -> Iterator[tuple]:
        """Close one window of the tier: its own pieces first, then shorter ones, the last one cut."""
        window = self.tiers[tier]
        sequence, offset = self._sequence(), 0
        for level in range(tier, -1, -1):
            while offset < window and (piece := self._take(level, window - offset)):
                doc, start, length = piece
                yield doc, start, length, sequence, offset, window
                offset += length
        if offset < window:  # every open piece is longer than the room: cut the shortest
            level = next(k for k in range(len(self.tiers)) if self.open[k])
            doc, start, length = self.pieces.pop(self.open[level].pop(0)[1])
            room = window - offset
            yield doc, start, room, sequence, offset, window
            self._hold(doc, start + room, length - room)

    def add(self, doc: int, length: int) -> Iterator[tuple]:
        whole = length // self.longest * self.longest
        for start in range(0, whole, self.longest):
            yield doc, start, self.longest, self._sequence(), 0, self.longest
        self._hold(doc, whole, length - whole)
        for tier, pool in enumerate(self.open):
            if len(pool) > OPEN_DOCUMENTS:
                yield from self._fill(tier)

    def finish(self) -> Iterator[tuple]:
        """Fill windows while enough is open, then cut the rest into powers of two."""
        left = sum(length for _, _, length in self.pieces.values())
        for tier in range(len(self.tiers) - 1, -1, -1):
            while left >= self.tiers[tier]:
                yield from self._fill(tier)
                left -= self.tiers[tier]
        rest = sorted(self.pieces.values())
        self.pieces, self.open = {}, [[] for _ in self.tiers]
        power = 1 << max(0, left.bit_length() - 1)
        sequence, offset = (self._sequence(), 0) if left else (0, 0)
        for doc, start, length in rest:
            while length:
                part = min(length, power - offset)
                yield doc, start, part, sequence, offset, power
                start, length, offset, left = start + part, length - part, offset + part, left - part
                if offset == power and left:
                    power = 1 << (left.bit_length() - 1)
                    sequence, offset = self._sequence(), 0


PIECE = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier long, step_group long"
)
_KINDS = [pa.int64()] * 8


def _pack(path: str, tiers: tuple[int, ...], end_id: int, keep_ids: bool, keep_cache: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        base = TaskContext.get().partitionId() << 33
        packer = Packer(tiers, base)
        held: dict[int, tuple] = {}  # document number -> row id, ids from a place on, that place, all ids
        end = array("I", [end_id]).tobytes()
        group, room, numbers = base, STEP_WINDOWS * tiers[-1], {}
        done: list[tuple] = []
        number = 0

        def emit(pieces) -> None:
            nonlocal group, room
            for doc, start, length, sequence, offset, window in pieces:
                # a document is placed from its front, so what lies before the piece's end can go
                row, ids, at, total = held.pop(doc)
                part = ids[4 * (start - at) : 4 * (start - at + length)]
                if start + length < total:
                    held[doc] = (row, ids[4 * (start - at + length) :], start + length, total)
                if sequence not in numbers:  # windows join step groups of equal tokens as they open
                    numbers.clear()
                    if window > room:
                        group, room = group + 1, STEP_WINDOWS * tiers[-1]
                    numbers[sequence] = group
                    room -= window
                done.append((row, start, length, zlib.crc32(part), total, sequence, offset, window,
                             numbers[sequence], part if keep_ids else None))

        def flush(kind):
            columns = list(zip(*done)) if done else [()] * 10
            arrays = [pa.array(list(columns[0]), kind)]
            arrays += [pa.array(list(c), k) for c, k in zip(columns[1:9], _KINDS)]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            if keep_ids:
                lists = [list(memoryview(p).cast("I")) for p in columns[9]]
                arrays.append(pa.array(lists, pa.list_(pa.int64())))
                names.append("ids")
            done.clear()
            return pa.record_batch(arrays, names=names)

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = part.column(0).to_pylist()
                texts = [t or "" for t in part.column(1).to_pylist()]
                for row, ids in zip(rows, coder.encode(texts)):
                    ids += end
                    held[number] = (row, ids, 0, len(ids) // 4)
                    emit(packer.add(number, len(ids) // 4))
                    number += 1
                if len(done) > 20_000:
                    yield flush(kind)
        emit(packer.finish())
        yield flush(kind)
        if not keep_cache:
            encoder.cache_clear()

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_ids: bool = False,
    keep_cache: bool = True,
) -> DataFrame:
    """One row per piece of a document: where it stands in its document and its sequence.

    A document is the ids of its text and then ``end_id``; null and empty texts are the end
    alone.  ``tiers`` are ascending powers of two.  Sequences are full windows of a tier, or
    shorter powers of two at a task's end; none is padded.  ``tier`` is the sequence's
    length, ``step_group`` numbers groups of sequences of nearly equal tokens; ids of
    sequences and groups are unique over all tasks.  Rows are packed one by one, so repeated
    rows and null ids are packed like any other; other columns are not read.  ``ids`` holds
    the piece's tokens with ``keep_ids``.  Without ``keep_cache`` a worker forgets the chunks
    it has encoded when its task ends, for jobs whose other stages need the memory.
    """
    if not tiers or list(tiers) != sorted(set(tiers)) or any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError("tiers must be ascending powers of two")
    narrow = docs.select(F.col(id_column).alias(name := fresh("id")), F.col(text_column).cast("string").alias("text"))
    kind = narrow.schema[name].dataType.simpleString()
    schema = f"id {kind}, {PIECE}" + (", ids array<long>" if keep_ids else "")
    return narrow.mapInArrow(_pack(tokenizer_path, tiers, end_id, keep_ids, keep_cache), schema).withColumnRenamed("id", id_column)
