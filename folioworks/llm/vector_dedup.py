"""Near-duplicate embeddings by a forest of random projection trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.graph import components, least_member
from folioworks.llm.shared import stage

#: Trees; vectors of a leaf; rows of a block where a leaf can't be split further; levels of a tree.
TREES, LEAF, BLOCK, LEVELS = 6, 512, 2048, 32
#: A vector this near a split goes to both sides. Two vectors of cosine 0.98 are 0.2 apart; in d dimensions their
#: projections differ by about 0.2 / sqrt(d), so the margin is that, once.
MARGIN = 0.2


def near_vectors(vectors: DataFrame, threshold: float = 0.98, trees: int = TREES, seed: int = 11) -> DataFrame:
    """Link vectors of equal label whose cosine is ``threshold`` or more.

    Equal vectors form a class first, so copies cost one row. In every tree, the classes of a label are split again
    and again at the median of a random projection (``percentile_approx`` over all of them, reduced on the tasks),
    until a node holds ``LEAF`` classes; near a split they go to both sides. Each level is one staged step over all
    trees. Classes of a leaf are compared in double precision as blocks of a matrix product; a leaf that can't get
    smaller, because its vectors are alike, is cut into blocks that meet pairwise, so its results are exact, too.
    A pair that several leaves hold counts in the first of them only. Tasks put out sums and spanning links, never
    the pairs.

    Every vector is indexed. Found pairs have cosine ``threshold`` or more; a pair is missed only if a split parts it
    by more than the margin in every tree (the tests measure recall against brute force).

    Returns vec_id, n_links, component_id, kept for every row. NULL labels, NULL or zero vectors and vectors with NULL
    or non-finite components link with nothing; neither do vectors of different lengths. Repeated rows are vectors of
    their own with the same links. An empty table gives an empty table; other columns are not read.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    unit = rows.mapInArrow(_units, "vec_id long, label string, node long, unit binary")
    members = stage(unit.select("vec_id", "node"))
    vectors_of = unit.where(F.col("node").isNotNull())
    sizes = vectors_of.groupBy("node").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"))
    classes = stage(vectors_of.mapInArrow(_once, "node long, label string, unit binary").groupBy("node").agg(
        F.first("label").alias("label"), F.first("unit").alias("unit")).join(sizes, "node"))
    leaves = grow(classes, trees, seed)
    found = stage(compare(classes, leaves, threshold))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_class = classes.select("node", "least", "size")
    per_class = (
        least_member(per_class, labels, "least")
        .join(per_class.select("node", "size"), "node")
        .join(counts, "node", "left")
        .select("node", "component_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    out = members.join(per_class, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes, and the hash of label and vector that names the class; NULL if it links with nothing."""
    for batch in batches:
        nodes: list[int | None] = []
        units: list[bytes | None] = []
        for label, found in zip(batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
            node = unit = None
            values = found.values if label is not None and found.is_valid else None
            if values is not None and len(values) and not values.null_count:
                x = np.asarray(values, np.float64) + 0.0  # no negative zeros
                largest = np.abs(x).max()
                if np.isfinite(largest) and largest > 0:
                    unit = x / largest
                    unit = (unit / np.sqrt(unit @ unit)).tobytes()
                    node = xxhash.xxh3_64_intdigest(x.tobytes(), seed=xxhash.xxh32_intdigest(label)) - (1 << 63)
            nodes.append(node)
            units.append(unit)
        columns = [batch.column("vec_id"), batch.column("label"), pa.array(nodes, pa.int64()), pa.array(units, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "node", "unit"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A class once for each batch."""
    for batch in batches:
        first = {n: i for i, n in enumerate(batch.column("node").to_pylist())}
        yield batch.select(["node", "label", "unit"]).take(pa.array(list(first.values()), pa.int32()))


def grow(classes: DataFrame, trees: int, seed: int) -> DataFrame:
    """node, leaf (long), n (classes in the leaf) for every class and tree."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            nodes, labels, margins, places = [], [], [], []
            for node, label, raw in zip(*(batch.column(c).to_pylist() for c in ("node", "label", "unit")), strict=True):
                x = np.frombuffer(raw, np.float64)
                if len(x) not in planes:
                    g = np.random.default_rng([seed, len(x)]).normal(size=(trees * LEVELS, len(x)))
                    planes[len(x)] = g / np.linalg.norm(g, axis=1, keepdims=True)
                nodes.append(node)
                # Vectors of different lengths never meet.
                labels.append(xxhash.xxh3_64_intdigest(f"{len(x)}/{label}") - (1 << 63))
                margins.append(MARGIN / math.sqrt(len(x)))
                places.append((planes[len(x)] @ x).astype(np.float32).reshape(trees, LEVELS))
            for tree in range(trees):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nodes, pa.int64()),
                        pa.array([tree] * len(nodes), pa.int32()),
                        pa.array(labels, pa.int64()),
                        pa.array(margins, pa.float64()),
                        pa.array([p[tree] for p in places], pa.list_(pa.float32())),
                    ],
                    ["node", "tree", "branch", "margin", "places"],
                )

    schema = "node long, tree int, branch long, margin double, places array<float>"
    open_rows = classes.select("node", "label", "unit").mapInArrow(project, schema).withColumn("tries", F.lit(0))
    done = None
    for level in range(LEVELS):
        open_rows = stage(open_rows.withColumn("place", F.col("places")[level]))
        split = open_rows.groupBy("tree", "branch").agg(
            F.count("*").alias("n"),
            F.max("tries").alias("tried"),
            F.first("margin").alias("spill"),
            F.percentile_approx("place", [k / 20 for k in range(1, 20)], 1000).alias("marks"),
        )
        split = stage(split.mapInArrow(_split_points, "tree int, branch long, n long, middle double, leaf boolean"))
        rows = open_rows.join(split, ["tree", "branch"])
        small = rows if level == LEVELS - 1 else rows.where("leaf")
        small = small.select("node", F.xxhash64("tree", "branch").alias("leaf"), "n")
        done = small if done is None else done.unionByName(small)
        if level == LEVELS - 1 or split.where("not leaf").isEmpty():
            break
        sides = F.array_compact(
            F.array(
                F.when(F.col("place") <= F.col("middle") + F.col("margin"), F.lit(0)),
                F.when(F.col("place") > F.col("middle") - F.col("margin"), F.lit(1)),
            )
        )
        # Without a split point, a node waits for the projection of the next level.
        sides = F.when(F.col("middle").isNull(), F.array(F.lit(2))).otherwise(sides)
        rows = rows.where("not leaf").withColumn("side", F.explode(sides))
        waits = F.col("side") == 2
        open_rows = rows.select(
            "node",
            "tree",
            F.when(waits, F.col("branch")).otherwise(F.xxhash64("branch", "side")).alias("branch"),
            "margin",
            "places",
            F.when(waits, F.col("tries") + 1).otherwise(0).alias("tries"),
        )
    return stage(done)


def _split_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where to split each node: at the mark of its projections that leaves the least to compare.

    Comparisons go with the squares of both sides, spill included. A node whose best split saves less than a quarter
    gets none; after three such projections, or if it is small, it is a leaf.
    """
    for batch in batches:
        middles, leaf = [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("n", "tried", "spill", "marks")), strict=True)
        for n, tried, spill, marks in rows:
            marks = np.array(marks)
            share = np.arange(1, len(marks) + 1) / (len(marks) + 1)
            left = np.interp(marks + spill, marks, share, right=1.0)
            right = 1 - np.interp(marks - spill, marks, share, left=0.0)
            work = left**2 + right**2
            best = int(np.argmin(work))
            good = work[best] < 0.75
            middles.append(float(marks[best]) if good else None)
            leaf.append(n <= LEAF or (not good and tried >= 2))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("tree", "branch", "n")),
                pa.array(middles, pa.float64()),
                pa.array(leaf, pa.bool_()),
            ],
            ["tree", "branch", "n", "middle", "leaf"],
        )


def compare(classes: DataFrame, leaves: DataFrame, threshold: float) -> DataFrame:
    """node, links (rows of other classes linked in this group), root (spanning links) for classes that have links."""
    own = leaves.groupBy("node").agg(F.collect_list(F.struct("leaf", "n")).alias("leaves"))
    rows = classes.select("node", "label", "size", "unit").join(own, "node")
    rows = rows.select(
        "node", "label", "size", "unit", F.col("leaves.leaf").alias("all_leaves"), F.explode("leaves").alias("in")
    )
    blocks = F.ceil(F.col("in.n") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select(
        "node",
        "label",
        "size",
        "unit",
        "all_leaves",
        "block",
        F.col("in.leaf").alias("leaf"),
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
    )

    def group(table: pa.Table) -> pa.Table:
        return _compare_group(table, threshold)

    return rows.groupBy("leaf", "first", "second").applyInArrow(group, "node long, links long, root long")


def _compare_group(table: pa.Table, threshold: float) -> pa.Table:
    columns = {n: table.column(n).to_pylist() for n in ("node", "label", "size", "unit", "block", "all_leaves")}
    names: dict[str, int] = {}
    label = np.array([names.setdefault(x, len(names)) for x in columns["label"]])
    units = np.array([np.frombuffer(u, np.float64) for u in columns["unit"]])
    size, block = np.array(columns["size"], np.int64), np.array(columns["block"])
    leaf, first, second = (table.column(n)[0].as_py() for n in ("leaf", "first", "second"))
    width = max(map(len, columns["all_leaves"]))
    every = np.array([[*x, *[None] * (width - len(x))] for x in columns["all_leaves"]], dtype=object)
    held = np.where(np.equal(every, None), 0, every).astype(np.int64)
    real = ~np.equal(every, None)
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    links, parent = np.zeros(len(units), np.int64), np.arange(len(units))
    for at in range(0, len(left), 512):
        some = left[at : at + 512]
        a, b = np.nonzero((units[some] @ units[right].T >= threshold) & (label[some][:, None] == label[right]))
        a, b = some[a], right[b]
        if first == second:
            a, b = a[a < b], b[a < b]
        for i in range(0, len(a), 50_000):
            x, y = a[i : i + 50_000], b[i : i + 50_000]
            common = (held[x][:, :, None] == held[y][:, None, :]) & real[x][:, :, None] & real[y][:, None, :]
            least = np.where(common.any(axis=2), held[x], np.iinfo(np.int64).max).min(axis=1)
            x, y = x[least == leaf], y[least == leaf]
            np.add.at(links, x, size[y])
            np.add.at(links, y, size[x])
        _unite(parent, a, b)
    linked = np.flatnonzero((links > 0) | (parent != np.arange(len(parent))))
    node = np.array(columns["node"], np.int64)
    return pa.table({"node": node[linked], "links": links[linked], "root": node[parent[linked]]})


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked members one parent: the least place spreads along the links until nothing changes."""
    while len(a):
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent[:] = jumped
        if (before == parent).all() and (parent[a] == parent[b]).all():
            break
