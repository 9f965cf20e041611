"""k-means on integer vectors, with zone maps over a space-filling curve.

Vectors are put in the order of a Hilbert curve through all their components and cut into
blocks of neighbours; a block keeps the least and largest value of every component, its box.
In each round a block's box bounds the distance to every centroid from below and above, and
only centroids whose lower bound does not pass the least upper bound are candidates of the
block.  The distances to these are then exact.

The blocks are written once.  A round is one pass over them: tasks return the sums of their
clusters, Spark adds them up, and the driver holds nothing but the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import write_through

BLOCK_ROWS = 64
BLOCKS_AT_ONCE = 64
#: Bits of each component that place a vector on the curve.
CURVE_BITS = 5
#: Components up to this size keep sums of squares exact in double precision; beyond it, Python's integers are used.
EXACT = 1 << 21
LONG = 1 << 63


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of each row's place on the Hilbert curve through ``2**bits`` cells a side; they sort as numbers.

    The axes are turned and gray-coded bit by bit for all rows at once, and the bits of all
    axes are then interleaved, the highest first.
    """
    axes = np.ascontiguousarray(cells.T).astype(np.int64)
    d, n = axes.shape
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        low = q - 1
        for i in range(d):
            high = (axes[i] & q) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(high, low, 0) ^ swap
            axes[i] ^= swap
    for i in range(1, d):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(axes[d - 1] & (1 << level), (1 << level) - 1, 0)
    axes ^= turn
    levels = np.arange(bits - 1, -1, -1)
    wide = (axes[None] >> levels[:, None, None]) & 1  # level, axis, row
    return np.packbits(wide.reshape(bits * d, n).astype(np.uint8), axis=0).T


def finite_vectors(column: Column, width: int, scale: int) -> Column:
    """Whether a vector has ``width`` components, none null, NaN or infinite, also when scaled."""
    good = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(column) == width) & good, F.lit(False))


def curve_blocks(vectors: DataFrame, id_column: str, vector_column: str, width: int, scale: int) -> DataFrame:
    """The kept vectors as blocks along the curve: ``ids, data, low, high``.

    Components become floor(scale * x), kept as doubles.  Equal vectors are told apart by id
    in the range shuffle, so a vector that is everywhere does not fill one range.
    """
    kept = vectors.where(finite_vectors(F.col(vector_column), width, scale)).select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")
    )
    low, high = kept.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    low, span = (0.0, 1.0) if low is None else (low, (high - low) or 1.0)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            cells = np.clip((x / span - low / span) * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.int64)
            keys = hilbert_keys(cells, CURVE_BITS)
            data = np.floor(x * scale)
            yield pa.record_batch(
                [batch.column("id"), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([r.tobytes() for r in data], pa.binary())],
                names=["id", "key", "data"],
            )

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("data").to_pylist()), np.float64).reshape(-1, width)
            cuts = range(0, len(x), BLOCK_ROWS)
            some = [x[at : at + BLOCK_ROWS] for at in cuts]
            ids = batch.column("id").to_pylist()
            yield pa.record_batch(
                [
                    pa.array([ids[at : at + BLOCK_ROWS] for at in cuts], pa.list_(pa.int64())),
                    pa.array([b.tobytes() for b in some], pa.binary()),
                    pa.array([b.min(0).tobytes() for b in some], pa.binary()),
                    pa.array([b.max(0).tobytes() for b in some], pa.binary()),
                ],
                names=["ids", "data", "low", "high"],
            )

    places = kept.mapInArrow(keyed, "id long, key binary, data binary")
    ordered = places.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    return write_through(ordered.mapInArrow(blocked, "ids array<long>, data binary, low binary, high binary"), "curve-blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """candidates[block, centroid]: whether the box leaves it possible that the centroid is nearest to a vector of the block."""
    gap = np.maximum(np.maximum(low[:, None] - centroids, centroids - high[:, None]), 0)
    reach = np.maximum(np.abs(centroids - low[:, None]), np.abs(high[:, None] - centroids))
    least, most = np.square(gap).sum(-1), np.square(reach).sum(-1).min(1, keepdims=True)
    return least <= most * (1 + 1e-9)  # the margin covers rounding of very large values


def nearest(x: np.ndarray, allowed: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """Cluster and exact squared distance of each row; of equal distances the smaller cluster."""
    c = np.array(centroids, np.float64)
    cluster = np.zeros(len(x), np.int64)
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) > EXACT:
        distance: list[int] = []
        for i, row in enumerate(x):
            ints = [int(v) for v in row]
            best = min((sum((a - b) ** 2 for a, b in zip(ints, centroids[j])), j) for j in np.flatnonzero(allowed[i]))
            cluster[i] = best[1]
            distance.append(int(best[0]))
        return cluster, distance
    out = np.zeros(len(x), np.int64)
    squares = np.square(x).sum(1)
    patterns, which = np.unique(np.packbits(allowed, axis=1), axis=0, return_inverse=True)
    for p in range(len(patterns)):
        rows = np.flatnonzero(which.reshape(-1) == p)
        some = np.flatnonzero(allowed[rows[0]])
        d = squares[rows, None] - 2 * (x[rows] @ c[some].T) + np.square(c[some]).sum(1)
        best = d.argmin(1)
        cluster[rows] = some[best]
        out[rows] = d[np.arange(len(rows)), best].astype(np.int64)
    return cluster, out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bounded number of blocks at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCKS_AT_ONCE):
            yield batch.slice(at, BLOCKS_AT_ONCE)


def _read(batch: pa.RecordBatch, width: int, centroids: list[list[int]]):
    x, low, high = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.float64).reshape(-1, width) for n in ("data", "low", "high"))
    sizes = [len(ids) for ids in batch.column("ids")]
    allowed = candidates(low, high, np.array(centroids, np.float64))
    return x, *nearest(x, np.repeat(allowed, sizes, axis=0), centroids)


def _limbs(total: int) -> list[int]:
    """The 32-bit digits of an integer, the lowest first; the last one carries the sign."""
    out = []
    while not -(1 << 31) <= total < 1 << 31:
        out.append(total & 0xFFFFFFFF)
        total >>= 32
    return [*out, total]


def cluster_sums(blocks: DataFrame, centroids: list[list[int]], width: int) -> dict[int, list[int]]:
    """Per non-empty cluster: its component sums, then its count, then its summed distance, as exact integers.

    A task returns each sum as 32-bit digits, and Spark adds the digits.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for batch in _slices(batches):
            x, cluster, distance = _read(batch, width, centroids)
            for j in np.unique(cluster):
                rows = np.flatnonzero(cluster == j)
                if isinstance(distance, list):
                    sums = [sum(int(v) for v in column) for column in x[rows].T]
                    cost = sum(distance[i] for i in rows)
                else:
                    sums, cost = x[rows].sum(0).astype(np.int64).tolist(), int(distance[rows].sum())
                mine = totals.setdefault(int(j), [0] * (width + 2))
                for at, value in enumerate([*sums, len(rows), cost]):
                    mine[at] += value
        flat = [(j, at, i, digit) for j, values in totals.items() for at, value in enumerate(values) for i, digit in enumerate(_limbs(value))]
        if flat:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*flat), kinds)], names=["cluster", "at", "place", "digit"])

    parts = blocks.mapInArrow(summed, "cluster int, at int, place int, digit long")
    found: dict[int, list[int]] = {}
    for row in parts.groupBy("cluster", "at", "place").agg(F.sum("digit").alias("digit")).collect():
        found.setdefault(row.cluster, [0] * (width + 2))[row.at] += row.digit << (32 * row.place)
    return found


def first_centroids(vectors: DataFrame, k: int, id_column: str, vector_column: str, width: int, scale: int, salt: str) -> list[list[int]]:
    """The kept vectors whose salted ids have the k smallest hashes, in hash order; ties by components."""
    named = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_column).cast("long").cast("string"), F.lit(""))), 256)
    kept = vectors.where(finite_vectors(F.col(vector_column), width, scale))
    rows = kept.select(named.alias("h"), F.col(vector_column).cast("array<double>").alias("v")).orderBy("h", "v").limit(k).collect()
    return [[int(np.floor(x * scale)) for x in r.v] for r in rows]


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, salt: str = "3:",
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Vectors of another width, null vectors and vectors with a null, NaN or infinite component
    are left out.  The first centroids are the vectors whose salted ids hash smallest (a null
    id counts as empty text; fewer vectors than k give fewer centroids); a round assigns every
    vector to the nearest centroid, the smaller number of equal ones, and moves each non-empty
    centroid to the floor of its vectors' means.  Repeated rows each count.  Distances and
    sums are exact integers of any size; where one does not fit a long it is null.  An empty
    table gives an empty result; other columns are not read.
    """
    start = first_centroids(vectors, k, id_column, vector_column, width, scale, salt)
    blocks = curve_blocks(vectors, id_column, vector_column, width, scale)
    centroids = start
    for _ in range(rounds if start else 0):
        sums = cluster_sums(blocks, centroids, width)
        centroids = [[s // sums[j][width] for s in sums[j][:width]] if j in sums else c for j, c in enumerate(centroids)]
    sums = cluster_sums(blocks, centroids, width) if start else {}
    costs = {j: s[width + 1] for j, s in sums.items()}
    inertia = sum(costs.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def fits(values):
        return pa.array([int(v) if v < LONG else None for v in values], pa.int64())

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            _, number, distance = _read(batch, width, centroids)
            yield pa.record_batch(
                [
                    batch.column("ids").flatten(),
                    pa.array(number.astype(np.int32)),
                    fits(distance),
                    fits([costs[j] for j in number]),
                    fits([inertia] * len(number)),
                    pa.array([digests[j] for j in number], pa.string()),
                ],
                names=[id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return blocks.select("ids", "data", "low", "high").mapInArrow(
        assigned,
        f"`{id_column}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string",
    )
