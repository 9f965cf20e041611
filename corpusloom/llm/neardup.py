"""Near duplicates among vectors: spherical k-means cells, blocked cosine products, one representative a group.

1. Equal vectors become one node with a count.
2. Cells: centroids are fitted by spherical k-means on a bounded sample of a cell (at first all
   vectors of one dimension), and no two centroids stay that nearly agree.  A vector goes into
   the cells of its nearest centroids.  Cells that are still too large are cut again, by
   centroids of their own, so a cell's size does not follow the table's.
3. Vectors within half the linking angle of their centroid are its core.  Any two of them are
   linked, so a group of thousands of near copies is counted, never compared, and its vectors
   go into no other cell.  Whatever links with a core vector lies within one and a half
   linking angles of the centroid and is compared with the core there.
4. All other vectors are compared within their cells, by blocks of a matrix product in double
   precision.  A pair that meets in several places is counted in one of them.
5. Links become components; the smallest id of a component is kept.

No pair is written: a block returns a link count per vector and one edge to hold its links together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import answer_by_runs
from corpusloom.llm.graph import components
from corpusloom.session import discard, write_through

#: Vectors of a cell that are compared in one block; larger cells are cut again.
CELL_ROWS = 2048
#: Mean size of the cells that a cut aims at.
AIM_ROWS = 256
#: Most centroids of one cut, and sampled vectors for each of them.
MAX_CENTROIDS = 1024
SAMPLE_EACH = 8
ROUNDS = 4
#: Cells that a vector outside a core goes into, and how much farther than the nearest they may be.
NEAREST = 6
MARGIN = 0.3
#: Centroids of this cosine or more are one.
SAME_CENTROID = 0.96
#: A cut adds 10 bits to a cell's number; deeper cells are compared block by block.
MAX_DEPTH = 4
#: Rows that one task assigns at a time, and rows of a product at a time.
ASSIGN_ROWS = 8192
PRODUCT_ROWS = 256
_NONE = np.int64(np.iinfo(np.int64).max)


def linkable(vector: Column) -> Column:
    """Whether a vector has only finite components and is not zero."""
    number = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: number(x) != 0), F.lit(False))


def unit(vector: np.ndarray) -> np.ndarray:
    vector = vector / np.abs(vector).max()
    return vector / math.sqrt(vector @ vector)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *kept, vectors = batch.columns
        units = [unit(v.values.to_numpy(zero_copy_only=False)).tobytes() for v in vectors]
        yield pa.record_batch([*kept, pa.array(units, pa.binary())], names=["node", "unit"])


def _matrix(column) -> np.ndarray:
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)


def _apart(centroids: np.ndarray) -> np.ndarray:
    """The centroids, without those that nearly agree with an earlier one."""
    alike = centroids @ centroids.T >= SAME_CENTROID
    kept: list[int] = []
    for i in range(len(centroids)):
        if not alike[i, kept].any():
            kept.append(i)
    return centroids[kept]


def spherical_kmeans(sample: np.ndarray, k: int) -> np.ndarray:
    """At most k unit centroids of unit vectors; the first vectors of the sample are the seeds."""
    centroids = _apart(sample[:k])
    for _ in range(ROUNDS):
        nearest = np.concatenate([(sample[a : a + 4096] @ centroids.T).argmax(1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.sqrt(np.square(sums).sum(1))
        centroids = sums[norms > 1e-9] / norms[norms > 1e-9, None]
    return _apart(centroids)


def _cells_wanted(count: Column) -> Column:
    """How many centroids cut a cell of ``count`` vectors."""
    return F.least(F.lit(MAX_CENTROIDS), F.ceil(count * F.lit(NEAREST / AIM_ROWS))).cast("int")


def _fit_cells(open_rows: DataFrame, large: DataFrame) -> DataFrame:
    """``cell, centroids`` (one binary of all) of the large cells, from samples of bounded expected size."""
    share = F.col("wanted") * SAMPLE_EACH / F.col("count")
    chance = F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sampled = open_rows.join(large, "cell").where(chance < share).select("cell", "wanted", "node", "unit")

    def fit(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cell, wanted = table["cell"][0].as_py(), table["wanted"][0].as_py()
        # hashed node numbers are in no order of the data
        order = np.argsort((table["node"].to_numpy().astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        found = spherical_kmeans(_matrix(table["unit"])[order], wanted)
        return pa.table({"cell": pa.array([cell], pa.int64()), "centroids": pa.array([found.tobytes()], pa.binary())})

    return sampled.groupBy("cell").applyInArrow(fit, "cell long, centroids binary")


def _assign(open_rows: DataFrame, large: DataFrame, centroids: DataFrame, depth: int, core_at: float, near_at: float) -> DataFrame:
    """``node, unit, cell, kind``: the next cells of each vector (leaf), its core cell (core) and others near (near)."""
    slots = F.ceil(F.col("count") / ASSIGN_ROWS).cast("int")
    dealt = open_rows.join(large.select("cell", slots.alias("slots")), "cell").select(
        "cell", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int").alias("slot"), "node", "unit"
    )
    copies = centroids.join(large, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"), "centroids"
    )

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        x = _matrix(left["unit"]) if left.num_rows else np.empty((0, 1))
        # a cell whose sample came out empty is one cell again
        c = np.frombuffer(right["centroids"][0].as_py(), np.float64).reshape(-1, x.shape[1]) if right.num_rows and len(x) else x[:1]
        parent = left["cell"][0].as_py() if left.num_rows else 0
        rows, children, kinds = [], [], []
        for at in range(0, len(x), PRODUCT_ROWS * 4):
            scores = x[at : at + PRODUCT_ROWS * 4] @ c.T
            best = scores.argmax(1)
            top = scores[np.arange(len(best)), best]
            core = top >= core_at if len(c) > 1 else np.zeros(len(best), bool)
            near = scores >= near_at
            near[core, best[core]] = False
            if len(c) == 1:
                near[:] = False
            few = min(NEAREST, len(c))
            bound = np.partition(scores, len(c) - few, axis=1)[:, len(c) - few]
            leaf = (scores >= bound[:, None]) & (scores >= top[:, None] - MARGIN) & ~core[:, None]
            cores = np.zeros_like(leaf)
            cores[core, best[core]] = True
            for kind, flags in enumerate((leaf, near, cores)):
                r, child = np.nonzero(flags)
                rows.append(r + at)
                children.append(child)
                kinds.append(np.full(len(r), kind, np.int8))
        if not rows:
            return pa.table({"node": pa.array([], pa.int64()), "unit": pa.array([], pa.binary()), "cell": pa.array([], pa.int64()), "kind": pa.array([], pa.int8())})
        taken, kind = np.concatenate(rows), np.concatenate(kinds)
        cell = ((((parent >> 3) << 10) | np.concatenate(children).astype(np.int64)) << 3) | (depth + 1)
        units = left["unit"].take(pa.array(np.where(kind == 0, taken, -1), pa.int64(), mask=kind != 0))
        return pa.table({"node": left["node"].take(pa.array(taken)), "unit": units, "cell": pa.array(cell), "kind": pa.array(kind)})

    schema = "node long, unit binary, cell long, kind tinyint"
    return dealt.groupBy("cell", "slot").cogroup(copies.groupBy("cell", "slot")).applyInArrow(assign, schema)


def cells(nodes: DataFrame, core_at: float, near_at: float) -> DataFrame:
    """``node, leaf, near, core`` of every node: arrays of cells, and the core cell or null.

    A cell's number is its path of children, 10 bits each, above 3 bits of depth.
    """
    roots = (F.octet_length("unit").cast("long").bitwiseAND(F.lit((1 << 20) - 1))) * 8
    open_rows, settled = nodes.select("node", "unit", roots.alias("cell")), []
    for depth in range(MAX_DEPTH):
        counts = write_through(open_rows.groupBy("cell").agg(F.count("*").alias("count")), "cell-counts")
        large = counts.where(F.col("count") > CELL_ROWS).withColumn("wanted", _cells_wanted(F.col("count")))
        if large.isEmpty():
            break
        settled.append(open_rows.join(large, "cell", "left_anti").select("node", "cell", F.lit(0).cast("tinyint").alias("kind")))
        centroids = write_through(_fit_cells(open_rows, large), "centroids")
        assigned = write_through(_assign(open_rows, large, centroids, depth, core_at, near_at), "assigned")
        settled.append(assigned.where("kind > 0").select("node", "cell", "kind"))
        open_rows = assigned.where("kind = 0").select("node", "unit", "cell")
        if depth:  # a vector that is core in one cell is compared there, whatever its other cells
            open_rows = open_rows.join(assigned.where("kind = 2").select("node").distinct(), "node", "left_anti")
    facts = open_rows.select("node", "cell", F.lit(0).cast("tinyint").alias("kind"))
    for some in settled:
        facts = facts.unionAll(some)
    of = lambda kind: F.when(F.col("kind") == kind, F.col("cell"))
    lists = facts.groupBy("node").agg(
        F.collect_set(of(0)).alias("leaf"), F.collect_set(of(1)).alias("near"),
        F.collect_set(of(2)).alias("cores"), F.min(of(2)).alias("core"),
    )
    others = F.array_except(F.array_union("near", "cores"), F.array("core"))
    return lists.select(
        "node",
        F.when(F.col("core").isNull(), F.col("leaf")).otherwise(F.array().cast("array<long>")).alias("leaf"),
        F.when(F.col("core").isNull(), F.col("near")).otherwise(others).alias("near"),
        "core",
    )


def _blocks(count: Column) -> Column:
    return F.ceil(count / CELL_ROWS).cast("int")


def _deal(rows: DataFrame) -> DataFrame:
    """Rows of ``node, unit, n, leaf, near, core`` dealt to the blocks that compare them.

    ``core = false``: the pair of blocks (i, j) of a cell, one block for any cell that was
    cut small enough.  ``core = true``: block i of a core against block j of the vectors near it.
    """
    carried = ["node", "unit", "n", "leaf", "near", "core"]
    block = lambda blocks: F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int")
    upto = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))

    leaves = rows.select(*carried, F.explode("leaf").alias("cell"))
    blocks = leaves.groupBy("cell").agg(_blocks(F.count("*")).alias("blocks"))
    inside = leaves.join(blocks, "cell").select(*carried, "cell", block(F.col("blocks")).alias("own"), upto(F.col("blocks")).alias("other"))
    inside = inside.select(
        *carried, "cell", F.lit(False).alias("of_core"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("right"),
    )

    cored = rows.where("core is not null").select(*carried, F.col("core").alias("cell"))
    nearby = rows.select(*carried, F.explode("near").alias("cell"))
    sizes = cored.groupBy("cell").agg(_blocks(F.count("*")).alias("core_blocks")).join(
        nearby.groupBy("cell").agg(_blocks(F.count("*")).alias("near_blocks")), "cell"
    )
    of_core = F.lit(True).alias("of_core")
    left = cored.join(sizes, "cell").select(
        *carried, "cell", of_core, block(F.col("core_blocks")).alias("i"), upto(F.col("near_blocks")).alias("j"), F.lit(False).alias("right")
    )
    right = nearby.join(sizes, "cell").select(
        *carried, "cell", of_core, upto(F.col("core_blocks")).alias("i"), block(F.col("near_blocks")).alias("j"), F.lit(True).alias("right")
    )
    return inside.unionAll(left).unionAll(right)


def _padded(lists) -> np.ndarray:
    """Lists of cells as rows of one width, filled with -1."""
    values = lists.to_pylist()
    out = np.full((len(values), max(map(len, values), default=0)), -1, np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


class _Block:
    """Decides which linked pairs are counted in one block of one cell."""

    def __init__(self, table: pa.Table):
        self.cell, self.of_core = table["cell"][0].as_py(), table["of_core"][0].as_py()
        self.leaf, self.near = _padded(table["leaf"]), _padded(table["near"])
        self.core = table["core"].fill_null(-1).to_numpy()

    def counted(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of linked pairs, those that are counted here: each pair has one place.

        Two vectors of one core are counted by the core's size.  A core vector and one near
        that core meet at the core; if both are core vectors, at the smaller cell.  All
        others meet in the smallest cell that both are in.
        """
        ca, cb = self.core[a], self.core[b]
        at_a = np.where((ca >= 0) & (self.near[b] == ca[:, None]).any(1), ca, _NONE)
        at_b = np.where((cb >= 0) & (self.near[a] == cb[:, None]).any(1), cb, _NONE)
        at_core = np.minimum(at_a, at_b)
        apart = (ca < 0) | (ca != cb)
        if self.of_core:
            return apart & (at_core == self.cell)
        shared = np.full(len(a), _NONE)
        mine, theirs = self.leaf[a], self.leaf[b]
        for column in range(mine.shape[1]):
            one = mine[:, column]
            both = (theirs == one[:, None]).any(1) & (one >= 0)
            shared = np.minimum(shared, np.where(both, one, _NONE))
        return apart & (at_core == _NONE) & (shared == self.cell)


def _compare(cosine: float):
    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x, n, nodes = _matrix(table["unit"]), table["n"].to_numpy(), table["node"].to_numpy()
        block, right = _Block(table), table["right"].to_numpy(zero_copy_only=False)
        whole = not block.of_core and table["i"][0].as_py() == table["j"][0].as_py()
        rows, columns = (np.arange(len(x)),) * 2 if whole else (np.flatnonzero(~right), np.flatnonzero(right))
        firsts, seconds = [], []
        for at in range(0, len(rows), PRODUCT_ROWS):
            some = rows[at : at + PRODUCT_ROWS]
            a, b = np.nonzero(x[some] @ x[columns].T >= cosine)
            a, b = some[a], columns[b]
            if whole:
                a, b = a[a < b], b[a < b]
            good = block.counted(a, b)
            firsts.append(a[good])
            seconds.append(b[good])
        a, b = (np.concatenate(s) if s else np.empty(0, np.int64) for s in (firsts, seconds))
        links = np.zeros(len(x), np.int64)
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        root = np.arange(len(x))
        while len(a):
            before = root.copy()
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            root = root[root]
            if (root == before).all():
                break
        held = np.flatnonzero(links)
        names = np.where(block.core >= 0, -block.core - 1, nodes)
        return pa.table({"node": nodes[held], "links": links[held], "here": names[held], "there": names[root[held]]})

    return compare


def near_groups(vectors: DataFrame, cosine: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Two vectors link when their cosine, in double precision, is ``cosine`` or more; pairs
    below it never link.  ``n_links`` counts the other rows linked directly, ``component_id``
    is the smallest id reachable by links, its own included, and ``kept`` marks the rows
    whose id it is.  Pairs are found within cells, so pairs that share none are missed: a
    core's links within its cell's parent are all found, of other pairs nearly all.

    Null vectors, zero vectors, and vectors with null, NaN or infinite components link with
    nothing; vectors of different lengths are never compared.  Equal vectors, repeated rows
    included, all link with each other.  A null id is never the smallest, unless a component
    has no other; its row is kept only then.  An empty table gives an empty result; other
    columns are not read.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    angle = math.acos(cosine)
    core_at = math.cos(angle / 2) + 1e-9
    near_at = math.cos(min(math.pi, 1.5 * angle)) - 1e-9
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"), F.spark_partition_id().alias("run")
    ).withColumn("run", F.when(linkable(F.col("v")), F.col("run")))
    rows = write_through(rows, "vectors")
    distinct = rows.where("run is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    distinct = distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    distinct = write_through(distinct, "distinct-vectors")
    units = distinct.select("node", F.col("v").cast("array<double>").alias("v")).mapInArrow(_units, "node long, unit binary")
    units = write_through(units, "units")

    places = cells(units, core_at, near_at)
    placed = write_through(units.join(places, "node").join(distinct.select("node", "n", "part"), "node"), "placed")
    found = _deal(placed.drop("part")).groupBy("cell", "of_core", "i", "j").applyInArrow(
        _compare(cosine), "node long, links long, here long, there long"
    )
    found = write_through(found, "found-links")

    # a core is one node of the graph, named by its cell
    groups = components(found.select(F.col("here").alias("u"), F.col("there").alias("v")))
    groups = groups.select(F.col("node").alias("name"), F.col("component").alias("root"))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = placed.select("node", "n", "part", "core", F.coalesce(-F.col("core") - 1, "node").alias("name"))
    known = known.join(distinct.select("node", "least"), "node").join(counted, "node", "left")
    known = answer_by_runs(known, groups, ["name"], "part").withColumn("root", F.coalesce("root", "name"))
    known = write_through(known, "known")
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    totals = known.where("core is not null").groupBy("core").agg(F.sum("n").alias("in_core"))
    known = answer_by_runs(answer_by_runs(known, smallest, ["root"], "part"), totals, ["core"], "part")
    n_links = F.col("n") - 1 + F.coalesce("links", F.lit(0)) + F.coalesce(F.col("in_core") - F.col("n"), F.lit(0))
    answers = known.select("node", n_links.alias("n_links"), "component_id").join(distinct.select("node", "v"), "node").drop("node")
    answered = answer_by_runs(rows, answers, ["v"], "run")
    discard(units)
    component = F.when(F.col("run").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return answered.select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
