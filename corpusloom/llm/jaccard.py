"""Exact n-gram Jaccard join by partitioning the universe of shingles.

A text's set holds the hashes of its distinct word shingles.  Two sets of sizes r and s
that reach the threshold differ in at most H = (r + s)(1 - t)/(1 + t) elements.  Sizes are
cut into bands; a band fixes m segments of the universe of hashes, of which g also index
their one-deletion neighbourhood.  Segments without deletions weigh 1, the others 2, and
the weights reach H + 1 plus some slack, so by the pigeonhole principle two such sets agree
in a segment, or differ by one element in one that indexes deletions.  How m and g are
allocated follows from a cost per band.  A set meets partners in its own band and, as the
smaller partner, in the next band.

Empty segments say nothing and give no key; the slack makes up for them, and a set with
more empty segments than slack indexes those too.  Where slack is left, a set leaves out
its most crowded keys: in one order of all keys by crowding, two sets that link share a
key among the H + 1 first of both, if each segment weighs 1.  A set that has more than H
keys to itself thus has no candidates at all.

Agreeing sets are candidates, not yet links.  Each key compares its members with one pivot
first; components of verified links make most other pairs needless, and only members of
one key that are still apart are compared with each other.  There a parity sketch of each
set, a bitmap with one parity per bit, tells most pairs apart before whole sets are fetched:
two sketches differ in at most as many bits as the sets do in elements, so no link is lost.
All candidates are verified on their whole sets, so the components are exact.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import answer_by_runs, as_bytes, fresh
from corpusloom.llm.graph import components
from corpusloom.llm.wordhash import U, hasher, mix
from corpusloom.session import discard, write_through

#: Bits of the filters that keep keys and sets without partners out of shuffles.  Their size
#: is fixed; when they fill up they let more rows through, which changes no result.
FILTER_BITS = 1 << 26
#: Keys in one row of the signatures, so that batches of rows stay small whatever the texts' length.
ROW_KEYS = 64
#: Rows whose keys are looked up in the filter at once.
ENTRY_ROWS = 4096
#: Low bits of a key that are counted to find the keys that sets share.
COUNTED_BITS = 40
SECOND_AT = COUNTED_BITS - 26
#: Weight of a likely false candidate against an index entry, in the allocation.
CANDIDATE_COST = 1.5
MAX_SLACK = 4095
#: Keys of a set that ride with its entries, to make each pair once.
SHORT_LIST = 64
#: Bits of a parity sketch for each shingle of the largest set of its band, at least.
SKETCH_BITS = 4


@functools.lru_cache(maxsize=64)
def bands(num: int, den: int, upto: int) -> list[tuple[int, int]]:
    """Bands (smallest, largest size); a partner lies in the same band or a neighbour."""
    out, low = [], 1
    while low <= upto:
        high = max(low, low * den // num)
        out.append((low, high))
        low = high + 1
    return out


def max_difference(r: int, s: int, num: int, den: int) -> int:
    return (r + s) * (den - num) // (den + num)


@functools.lru_cache(maxsize=4096)
def allocation(low: int, high: int, num: int, den: int, spare: float) -> tuple[int, int, int]:
    """(m, g, H) of a band: m segments, of which the first g index deletions.

    ``spare`` is the weight beyond H + 1, as a share of it, that lets sets leave out keys.
    """
    most = max_difference(high, high, num, den)
    if most == 0:
        return 0, 0, 0  # only equal sets link
    best = None
    for share in (0.0, 0.5, 1.0):
        m = max(1, math.ceil((most + 1) / (1 + share)))
        while True:
            g = min(m, math.ceil(share * m))
            mean = low / m
            empty = (m + g) * math.exp(-mean)
            need = most + 1 + empty + 3 * math.sqrt(empty) + spare * most
            if m + g >= need or m > 4 * (most + 1):
                break
            m += max(1, int(need - m - g) // 2)
        small = math.exp(-mean) * (1 + mean)
        smaller = small + math.exp(-mean) * mean * mean / 2
        cost = m + g * mean + CANDIDATE_COST * ((m - g) * small + g * smaller)
        if best is None or cost < best[0]:
            best = (cost, m, g)
    return best[1], best[2], most


# info: bits 0 own band, 1 subset (else a deletion), 2 weight 2, 3 no deletions in the band,
# 4-15 slack, 16- band
OWN, SUBSET, HEAVY, STRICT, SLACK_AT, BAND_AT = 1, 2, 4, 8, 4, 16


def segment_keys(
    shingles: np.ndarray, band: int, own: bool, low: int, high: int, num: int, den: int, spare: float
):
    """Keys and infos of one set (sorted distinct hashes) in one band."""
    m, g, most = allocation(low, high, num, den, spare)
    if m == 0:
        return np.empty(0, U), np.empty(0, np.int64)
    # the universe is cut into equal ranges of the hash, so a sorted set is cut in order
    segment = ((shingles >> U(32)) * U(m)) >> U(32)
    bounds = np.searchsorted(segment, np.arange(m + 1, dtype=U))
    sizes = np.diff(bounds)
    mixed = mix(shingles ^ U(0x5851F42D4C957F2D))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed)])
    content = sums[bounds[1:]] - sums[bounds[:-1]]
    place = mix(np.arange(m, dtype=U) + U((band + 1) << 32))
    # a segment that indexes deletions counts twice only if a deletion leaves something
    heavy = (np.arange(m) < g) & (sizes >= 2)
    weight = int((sizes > 0).sum() + heavy.sum())
    slack = weight - most - 1
    covered = slack >= 0
    used = sizes > 0 if covered else np.ones(m, bool)
    keys = [mix(content[used] ^ place[used])]
    infos = [SUBSET + HEAVY * ((np.arange(m) < g)[used]).astype(np.int64)]
    # an uncovered set also indexes what is left when its only element is deleted
    deleting = np.flatnonzero((np.arange(m) < g) & (sizes >= (2 if covered else 1)))
    for k in deleting:
        part = mixed[bounds[k] : bounds[k + 1]]
        keys.append(mix((content[k] - part) ^ place[k]))
        infos.append(np.full(len(part), HEAVY, np.int64))
    shared = OWN * own + STRICT * (g == 0) + (max(0, min(slack, MAX_SLACK)) << SLACK_AT) + (band << BAND_AT)
    info = np.concatenate(infos) + shared
    return np.concatenate(keys), info


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, begins = hasher().words(texts)
    with np.errstate(over="ignore"):
        whole = hashes * U(0)
        n = max(0, len(hashes) - width + 1)
        rolled = np.zeros(n, U)
        for k in range(width):
            rolled += mix(hashes[k : k + n] + U(k + 1)) if k else hashes[:n]
            rolled = rolled * U(0xDA942042E4DD58B5)
        rolled = mix(rolled)
        out = []
        for b, e in zip(begins[:-1].tolist(), begins[1:].tolist()):
            words = e - b
            if words >= width:
                out.append(np.unique(rolled[b : e - width + 1]))
            elif words:
                value = U(words)
                for h in hashes[b:e]:
                    value = mix(np.array([value * U(0xDA942042E4DD58B5) + h], U))[0]
                out.append(np.array([value], U))
            else:
                out.append(whole[:0])
    return out


def _identity(shingles: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent 64-bit names of a set, as signed longs."""
    if not len(shingles):
        return 0, 0
    with np.errstate(over="ignore"):
        a = mix(np.array([mix(shingles + U(2 * seed + 1)).sum() + U(len(shingles))], U))
        b = mix(np.array([mix(shingles ^ U(0xA0761D6478BD642F + seed)).sum()], U))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


SIGNATURE = "id long, raw long, set_id long, check long, n long, keys array<long>, infos array<long>"


def _sign(width: int, num: int, den: int, spare: float, seed: int):
    """Signatures of texts: a row for each, and rows without ``n`` for the keys past its first ROW_KEYS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a set that a task has already indexed is not indexed again
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [as_bytes(t) for t in part.column(1).to_pylist()]
                ids, raws = part.column(0).to_pylist(), part.column(2).to_pylist()
                columns: list[list] = [[] for _ in range(7)]
                for row_id, raw, shingles in zip(ids, raws, shingle_sets(texts, width)):
                    n = len(shingles)
                    set_id, check = _identity(shingles, seed)
                    keys, infos = np.empty(0, np.int64), np.empty(0, np.int64)
                    if n and set_id not in seen:
                        seen.add(set_id)
                        cut = bands(num, den, 2 * n * den // num + 2)
                        own = next(k for k, (low, high) in enumerate(cut) if low <= n <= high)
                        with np.errstate(over="ignore"):
                            found = [segment_keys(shingles, own, True, *cut[own], num, den, spare)]
                            if n * den >= num * cut[own + 1][0]:
                                found.append(segment_keys(shingles, own + 1, False, *cut[own + 1], num, den, spare))
                        keys = np.concatenate([f[0] for f in found]).view(np.int64)
                        infos = np.concatenate([f[1] for f in found])
                    for first in range(0, max(len(keys), 1), ROW_KEYS):
                        told = (row_id, raw, set_id, check, n) if first == 0 else (None, None, set_id, None, None)
                        some = keys[first : first + ROW_KEYS], infos[first : first + ROW_KEYS]
                        for column, value in zip(columns, (*told, *some)):
                            column.append(value)
                longs = [pa.array(c, pa.int64()) for c in columns[:5]]
                lists = [pa.array(c, pa.list_(pa.int64())) for c in columns[5:]]
                yield pa.record_batch([*longs, *lists], names=["id", "raw", "set_id", "check", "n", "keys", "infos"])

    return run


def _filter_places(value):
    """Two places in the filter of a long that is itself a hash."""
    mask = F.lit(FILTER_BITS - 1).cast("long")
    return F.array(value.bitwiseAND(mask), F.shiftrightunsigned(value, SECOND_AT).bitwiseAND(mask))


def bit_filter(values: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of fixed size over a column of hashes, as words of 64 bits."""
    words = (
        values.select(F.explode(_filter_places(F.col(column))).alias("place"))
        .select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    got = words.toArrow()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return bits


def in_filter(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    values = values.view(U)
    good = np.ones(len(values), bool)
    for place in (values & U(FILTER_BITS - 1), (values >> U(SECOND_AT)) & U(FILTER_BITS - 1)):
        good &= (bits.view(U)[place >> U(6)] >> (place & U(63))) & U(1) == 1
    return good


def _entries(bits):
    """Index entries (key, set_id, info) of signatures, those whose key passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # few rows at a time bound what is held beside the batch
            for at in range(0, batch.num_rows, ENTRY_ROWS):
                set_ids, key_lists, info_lists = batch.slice(at, ENTRY_ROWS).columns
                keys = key_lists.flatten().to_numpy(zero_copy_only=False)
                infos = info_lists.flatten().to_numpy(zero_copy_only=False)
                lengths = key_lists.value_lengths().to_numpy(zero_copy_only=False)
                good = np.flatnonzero(in_filter(keys, bits.value))
                owners = np.repeat(set_ids.to_numpy(zero_copy_only=False), lengths)
                yield pa.record_batch([keys[good], owners[good], infos[good]], names=["key", "set_id", "info"])

    return run


def _whole_sets(bits, width: int, seed: int):
    """Shingle sets, by their names, of the rows whose id passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.flatnonzero(in_filter(batch.column(0).to_numpy(zero_copy_only=False), bits.value))
            chosen = batch.take(pa.array(good))
            for at in range(0, chosen.num_rows, 128):
                part = chosen.slice(at, 128)
                sets = shingle_sets([as_bytes(t) for t in part.column(1).to_pylist()], width)
                names = pa.array([_identity(s, seed)[0] for s in sets], pa.int64())
                lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.record_batch([part.column(0), names, lists], names=["row", "set_id", "shingles"])

    return run


def parity_sketch(shingles: np.ndarray, high: int) -> np.ndarray:
    """Words of 64 bits; each bit is the parity of the shingles that fall on it.

    Sets of one band have sketches of one length.
    """
    bits = max(256, 1 << (SKETCH_BITS * high - 1).bit_length())
    parity = np.bincount((shingles & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def _sketches(num: int, den: int):
    """Parity sketches of the sets (set_id, band, shingles), with the sizes of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, made = [], []
            for band, shingles in zip(batch.column(1).to_pylist(), batch.column(2)):
                values = shingles.values.to_numpy(zero_copy_only=False).view(U)
                high = bands(num, den, 2 * len(values) * den // num + 2)[band][1]
                sizes.append(len(values))
                made.append(parity_sketch(values, high))
            columns = [pa.array(sizes, pa.int64()), pa.array(made, pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["set_id", "band", "n", "sketch"])

    return run


def _row_hash(column):
    return F.xxhash64(F.coalesce(column, F.lit(-(2**63))))


class _Join:
    """One run of the join; the steps share the texts and the signatures."""

    def __init__(self, narrow: DataFrame, num: int, den: int, width: int, spare: float, star_rounds: int):
        self.spark, self.narrow = narrow.sparkSession, narrow
        self.num, self.den, self.width = num, den, width
        self.spare, self.star_rounds = spare, star_rounds

    def sign(self) -> DataFrame:
        """Signatures of all texts, and the smallest id of every set."""
        for seed in range(8):
            signed = self.narrow.mapInArrow(_sign(self.width, self.num, self.den, self.spare, seed), SIGNATURE)
            self.signed = write_through(signed.withColumn("run", F.spark_partition_id()), "signatures")
            names = self.signed.where("n > 0").groupBy("set_id")
            if not names.agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").limit(1).count():
                self.seed = seed
                texts = self.signed.where("n is not null")
                self.named = write_through(texts.select("id", "raw", "run", "set_id", "n"), "names")
                self.members = self.named.where("n > 0")
                self.smallest = self.members.groupBy("set_id").agg(F.min("id").alias("min_id"))
                return self.signed
            discard(self.signed)
        raise RuntimeError("set names collide under every seed")

    def buckets(self) -> DataFrame:
        """Entries of keys that several sets share: key, set_id, own, subset, probe.

        In a band without deletions only probing entries are left, so both sides probe; in
        the others one side is enough.
        """
        exploded = self.signed.select(F.explode("keys").alias("key"))
        counted = exploded.select(F.expr(f"key & {(1 << COUNTED_BITS) - 1}L").alias("key")).groupBy("key").count()
        bits = self.spark.sparkContext.broadcast(bit_filter(counted.where("count > 1"), "key"))
        indexed = self.signed.where("size(keys) > 0").select("set_id", "keys", "infos")
        entries = indexed.mapInArrow(_entries(bits), "key long, set_id long, info long").distinct()
        entries = write_through(entries, "shared-keys")
        discard(self.signed)
        sizes = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        flags = [F.expr(f"(info & {bit}) <> 0").alias(name)
                 for bit, name in ((OWN, "own"), (SUBSET, "subset"), (HEAVY, "heavy"), (STRICT, "strict"))]
        slack = F.expr(f"(info >> {SLACK_AT}) & {MAX_SLACK}").alias("slack")
        shared = entries.join(sizes, "key").select(
            "key", "set_id", "c", *flags, slack, F.expr(f"info >> {BAND_AT}").alias("band"))
        # in one order of all keys, a set leaves out as many of its last ones as its slack allows
        last = Window.partitionBy("set_id", "band", "heavy").orderBy(F.col("c").desc(), F.col("key").desc())
        probe = F.col("heavy") | (F.row_number().over(last) > F.col("slack"))
        ranked = shared.withColumn("probe", probe).where("probe or not strict")
        ranked = write_through(ranked.select("key", "set_id", "own", "subset", "probe", "strict", "band"), "shared-keys")
        # near copies share most of their keys: of the keys with the same members, one is enough
        name = F.xxhash64("set_id", "own", "subset", "probe")
        alike = ranked.groupBy("key").agg(F.count("*").alias("n"), *[
            F.sum(F.shiftrightunsigned(name, bits).bitwiseAND(F.lit((1 << 32) - 1))).alias(f"h{bits}") for bits in (0, 32)
        ]).where("n > 1")
        chosen = alike.groupBy("n", "h0", "h32").agg(F.min("key").alias("key")).select("key")
        buckets = write_through(ranked.join(chosen, "key"), "shared-keys")
        discard(entries, ranked)
        return buckets

    def whole_sets(self, needed: DataFrame) -> DataFrame:
        """set_id and shingles of the needed sets, made again from one text of each."""
        holders = self.members.join(needed, "set_id").groupBy("set_id").agg(F.min("id").alias("id"))
        holders = write_through(holders.select("set_id", _row_hash(F.col("id")).alias("row")), "needed-sets")
        bits = self.spark.sparkContext.broadcast(bit_filter(holders, "row"))
        rows = self.narrow.select(_row_hash(F.col("id")).alias("row"), "text")
        made = rows.mapInArrow(_whole_sets(bits, self.width, self.seed), "row long, set_id long, shingles array<long>")
        made = made.join(holders, ["row", "set_id"])
        sets = write_through(made.groupBy("set_id").agg(F.first("shingles").alias("shingles")), "needed-sets")
        discard(holders)
        return sets

    def sketches(self, entries: DataFrame, sets: DataFrame) -> DataFrame:
        """set_id, band, n and parity sketch of the sets of some entries."""
        asked = entries.select("set_id", "band").distinct().join(sets, "set_id").select("set_id", "band", "shingles")
        made = asked.mapInArrow(_sketches(self.num, self.den), "set_id long, band long, n long, sketch array<long>")
        return write_through(made, "sketches")

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (u, v) whose whole sets reach the threshold."""
        left = sets.select(F.col("set_id").alias("u"), F.col("shingles").alias("a"))
        right = sets.select(F.col("set_id").alias("v"), F.col("shingles").alias("b"))
        both = pairs.join(left, "u").join(right, "v")
        sized = both.select(
            "u", "v", F.size(F.array_intersect("a", "b")).alias("c"), (F.size("a") + F.size("b")).alias("total")
        )
        return sized.where(f"cast(c as long) * {self.num + self.den} >= cast(total as long) * {self.num}").select("u", "v")

    @staticmethod
    def _pairs(joined: DataFrame) -> DataFrame:
        """Distinct pairs of joined entries (columns x_* and y_*) that the pigeonholes vouch for."""
        fit = "(x_own or y_own) and (x_subset or y_subset) and (x_probe or y_probe)"
        ordered = joined.where(fit).select(F.least("x_set", "y_set").alias("u"), F.greatest("x_set", "y_set").alias("v"))
        return ordered.where("u < v").distinct()

    def star_pairs(self, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Each key's members against its pivot, and the pivots."""
        best = F.struct(~(F.col("own") & F.col("probe")), ~F.col("own"), "set_id", "own", "subset", "probe")
        pivots = entries.groupBy("key").agg(F.min(best).alias("p")).select(
            "key", *[F.col(f"p.{c}").alias(f"x_{c}") for c in ("set_id", "own", "subset", "probe")]
        ).withColumnRenamed("x_set_id", "x_set")
        members = entries.select("key", *_prefixed("y"))
        return self._pairs(members.join(pivots, "key")), pivots.select("key", F.col("x_set").alias("set_id"))

    def links(self) -> DataFrame:
        entries = self.buckets()
        sets = self.whole_sets(entries.select("set_id").distinct())
        links, linked, apart = None, None, entries
        for _ in range(self.star_rounds):
            pairs, pivots = self.star_pairs(apart)
            found = write_through(self.verify(pairs, sets), "links")
            links = found if links is None else links.unionAll(found)
            linked = self.merged(linked, found)
            rest = apart.drop("component").join(pivots, ["key", "set_id"], "left_anti")
            placed = rest.join(linked.withColumnRenamed("node", "set_id"), "set_id", "left")
            placed = placed.withColumn("component", F.coalesce("component", "set_id"))
            split = placed.groupBy("key").agg(
                F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("probe").alias("any")
            ).where("lo <> hi and any").select("key")
            left = write_through(placed.join(split, "key"), "apart")
            discard(apart)
            apart = left
        sketched = self.sketches(apart, sets)
        found = write_through(self.verify(self.apart_pairs(apart, sketched), sets), "links")
        discard(apart, sketched, sets)
        links = found if links is None else links.unionAll(found)
        self.linked = self.merged(linked, found)
        return links

    @staticmethod
    def merged(linked: DataFrame | None, found: DataFrame) -> DataFrame:
        """Components after more links: what hung together before goes in as one edge a node."""
        if linked is None:
            return components(found)
        before = linked.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        return components(before.unionAll(found))

    def apart_pairs(self, apart: DataFrame, sketched: DataFrame) -> DataFrame:
        """Pairs of one key whose components the stars left apart and whose sketches allow a link."""
        # a pair shares many keys; if both key lists are short, its first one makes it
        lists = apart.where("strict").groupBy("set_id", "band").agg(F.collect_list("key").alias("keys"))
        described = sketched.join(lists.where(f"size(keys) <= {SHORT_LIST}"), ["set_id", "band"], "left")
        listed = apart.join(described, ["set_id", "band"])
        extra = ("component", "n", "sketch", "keys")
        probing = listed.where("probe").select("key", *_prefixed("x"), *[F.col(c).alias(f"x_{c}") for c in extra])
        others = listed.select(
            F.col("key").alias("y_key"), *_prefixed("y"), *[F.col(c).alias(f"y_{c}") for c in extra])
        differ = F.expr(
            "aggregate(zip_with(x_sketch, y_sketch, (a, b) -> bit_count(a ^ b)), 0, (total, bits) -> total + bits)")
        near = differ * (self.num + self.den) <= (F.col("x_n") + F.col("y_n")) * (self.den - self.num)
        first = F.array_min(F.array_intersect("x_keys", "y_keys")) == F.col("key")
        meet = (F.col("key") == F.col("y_key")) & (F.col("x_component") != F.col("y_component"))
        meet &= (F.col("x_set") < F.col("y_set")) | ~F.col("y_probe")
        meet &= F.coalesce(near, F.lit(True)) & F.coalesce(first, F.lit(True))
        return self._pairs(probing.join(others, meet))

    def groups(self) -> DataFrame:
        self.sign()
        links = self.links()
        linked = write_through(self.linked.withColumnRenamed("node", "set_id"), "linked")
        least = self.smallest.join(linked, "set_id").groupBy("component").agg(F.min("min_id").alias("least"))
        both = links.select(F.col("u").alias("set_id")).unionAll(links.select(F.col("v").alias("set_id")))
        degree = both.groupBy("set_id").agg(F.count("*").alias("n_links"))
        joined = linked.join(least, "component").join(degree, "set_id", "left").select("set_id", "least", "n_links")
        winners = self.smallest.join(joined, "set_id", "left").select(
            "set_id", F.coalesce("least", "min_id").alias("component_id"),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        )
        found = answer_by_runs(self.members, winners, ["set_id"], "run").drop("run")
        alone = self.named.where("n = 0").select(
            "id", "raw", "set_id", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links")
        )
        return found.select(*alone.columns).unionAll(alone)


def _prefixed(side: str) -> list:
    return [F.col("set_id").alias(f"{side}_set"), *[F.col(c).alias(f"{side}_{c}") for c in ("own", "subset", "probe")]]


def similar_groups(
    docs: DataFrame,
    percent: int = 80,
    width: int = 5,
    id_column: str = "doc_id",
    text_column: str = "text",
    spare: float = 0.5,
    star_rounds: int = 2,
) -> DataFrame:
    """One row per document: id, n_shingles, set_id, component_id, n_links.

    Texts are lower-cased (A-Z) and cut into words at white space; a text's set is its
    distinct shingles of ``width`` words, the whole sequence if it has fewer words.  Two
    texts link when 100 times the intersection reaches ``percent`` times the union;
    ``component_id`` is the smallest id that links reach.  Texts with equal sets share a
    ``set_id``; ``n_links`` counts the verified links of the set to other sets (those found
    before the group was known to hang together).  Null, empty and blank texts have no
    shingles, no links, and their own id.  Rows with a null id link like others but never
    name a group that has an id.  Repeated rows are repeated in the result.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    groups = _groups(docs, percent, width, id_column, text_column, spare, star_rounds)
    return groups.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "set_id", "component_id", "n_links"
    )


def _raw(text_column: str):
    return F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit("")))


def _groups(
    docs: DataFrame, percent: int, width: int, id_column: str, text_column: str, spare: float, star_rounds: int = 2
) -> DataFrame:
    """Groups of the rows, with a hash of each row's raw text."""
    divisor = math.gcd(percent, 100)
    narrow = docs.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"),
        _raw(text_column).alias("raw"))
    return _Join(narrow, percent // divisor, 100 // divisor, width, spare, star_rounds).groups()


def one_of_each(
    docs: DataFrame, percent: int = 80, width: int = 5, id_column: str = "doc_id", text_column: str = "text", spare: float = 0.25
) -> DataFrame:
    """The documents whose id names their group, with all their columns.

    Documents with a null id stay only in groups without any id.  Rows are taken out by id
    and text, so other rows without an id, or with the same one, are not hit.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    groups = _groups(docs, percent, width, id_column, text_column, spare)
    gone_id, gone_raw = fresh("gone"), fresh("raw")
    gone = groups.where(~F.col("id").eqNullSafe(F.col("component_id")))
    gone = gone.select(F.col("id").alias(gone_id), F.col("raw").alias(gone_raw)).distinct()
    match = F.col(id_column).cast("long").eqNullSafe(F.col(gone_id)) & (_raw(text_column) == F.col(gone_raw))
    return docs.join(gone, match, "left_anti")
