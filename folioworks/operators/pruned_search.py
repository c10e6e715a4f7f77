"""Exact vector search over an index of blocks, of which most are never multiplied.

Vectors that are near each other are put into one block, and a block knows its centre c, its radius r and its largest
norm. For any vector x in it and a question q, q·x = q·c + q·(x - c) <= q·c + |q| r, and q·x <= |q| |x|. So a block whose
bound is below a question's k-th best score so far holds nothing for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from folioworks.functions.vectors import as_doubles
from folioworks.operators.search import (
    MAX_BROADCAST_BYTES,
    MAX_BROADCAST_QUESTIONS,
    SCORE_DIGITS,
    _id_array,
    _Running,
    _record_batch,
    usable,
)
from folioworks.session import cut_lineage

#: Vectors of a block, and bounds of the pivots that draw near vectors together.
ROWS_PER_BLOCK, MOST_PIVOTS, PIVOT_BYTES = 2_000, 4_096, 32 << 20


def build_index(vectors: DataFrame, rows_per_block: int = ROWS_PER_BLOCK, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """Blocks of near vectors with what bounds their scores, written to the shared folder.

    ``vectors`` has (id, bucket, vec). Pivots, a bounded sample by a hash of the id, travel with the tasks; every vector
    goes to the nearest one of its bucket and size, and a pivot's vectors are cut into blocks of about
    ``rows_per_block`` by a hash. The sample decides how near the vectors of a block are, not what is found.

    Returns (bucket, dim, pivot, ids, vecs: doubles in a row, centre, radius, norm), one row for each block. Vectors with
    NULL or NaN elements and empty ones are left out.
    """
    kind = vectors.schema["id"].dataType
    v = vectors.select("id", F.col("bucket").cast("string").alias("bucket"), as_doubles(F.col("vec")).alias("vec"))
    v = v.where(usable("vec") & (F.size("vec") > 0) & F.col("bucket").isNotNull())
    sized = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    wanted = min(most_pivots, PIVOT_BYTES // (8 * (sized["dim"] or 1)), -(-sized["n"] // rows_per_block))
    rows = v.orderBy(F.xxhash64("id", "vec")).limit(max(1, wanted)).collect()
    pivots: dict[tuple[str, int], list] = {}
    for r in rows:
        pivots.setdefault((r["bucket"], len(r["vec"])), []).append(r["vec"])
    shared = v.sparkSession.sparkContext.broadcast({k: np.array(m) for k, m in pivots.items()})
    schema = T.StructType([*v.schema.fields, T.StructField("dim", T.IntegerType()), T.StructField("pivot", T.IntegerType())])
    near = cut_lineage(v.mapInArrow(_to_pivots(shared), schema))
    keys = ["bucket", "dim", "pivot"]
    cells = near.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("parts"))
    cells = cut_lineage(cells)  # a row for each pivot, bucket and size
    placed = near.join(cells, keys).withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.col("parts")).cast("int"))
    out = T.StructType(
        [
            T.StructField("bucket", T.StringType()),
            T.StructField("dim", T.IntegerType()),
            T.StructField("pivot", T.IntegerType()),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("vecs", T.BinaryType()),
            T.StructField("centre", T.BinaryType()),
            T.StructField("radius", T.DoubleType()),
            T.StructField("norm", T.DoubleType()),
        ]
    )
    arrow = to_arrow_schema(out)

    def block(rows: pa.Table) -> pa.Table:
        dim = rows["dim"][0].as_py()
        m = rows["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
        centre = m.mean(axis=0)
        ids = pa.ListArray.from_arrays(pa.array([0, len(m)], pa.int32()), rows["id"].combine_chunks())
        radius, norm = np.sqrt(((m - centre) ** 2).sum(axis=1)).max(), np.sqrt((m**2).sum(axis=1)).max()
        values = [rows["bucket"][0].as_py(), dim, rows["pivot"][0].as_py(), None, m.tobytes(), centre.tobytes()]
        columns = [pa.array([x], f.type) for x, f in zip([*values, float(radius), float(norm)], arrow, strict=True)]
        columns[3] = ids.cast(arrow.field("ids").type)
        return pa.Table.from_arrays(columns, schema=arrow)

    return cut_lineage(placed.groupBy(*keys, "part").applyInArrow(block, out))


def _to_pivots(shared):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, vecs = batch.column("bucket").to_pylist(), batch.column("vec").to_pylist()
            found = np.zeros(len(vecs), np.int32)
            kinds: dict[tuple, list[int]] = {}
            for i, (b, x) in enumerate(zip(buckets, vecs, strict=True)):
                kinds.setdefault((b, len(x)), []).append(i)
            for key, rows in kinds.items():
                own = shared.value.get(key)
                if own is not None:
                    m = np.array([vecs[i] for i in rows])
                    found[rows] = (m @ own.T - (own**2).sum(axis=1) / 2).argmax(axis=1)
            dims = pa.array([len(x) for x in vecs], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, dims, pa.array(found)], [*batch.schema.names, "dim", "pivot"])

    return nearest


class Scan:
    """The k best of every question over the blocks that are handed in."""

    def __init__(self, questions: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, digits: int):
        self.running, self.norms = {}, {}
        for key, (ids, matrix, least) in questions.items():
            self.running[key] = _Running(ids, matrix, k, digits, least)
            self.norms[key] = np.sqrt((matrix**2).sum(axis=1))
        self.met = self.skipped = 0

    def add(self, bucket: str, dim: int, ids: list, vecs: bytes, centre: bytes, radius: float, norm: float) -> None:
        """Multiply the block with all questions at once for which it may hold one of their best."""
        run = self.running.get((bucket, dim))
        if run is None:
            return
        norms = self.norms[bucket, dim]
        bounds = np.minimum(run.matrix @ np.frombuffer(centre) + norms * radius, norms * norm)
        asked = np.flatnonzero(bounds + run.slack(bounds) >= run.least)
        self.met += len(asked)
        self.skipped += len(bounds) - len(asked)
        if len(asked):
            run.add(np.frombuffer(vecs).reshape(-1, dim), _id_array(ids), asked)


def pruned_topk(
    questions: DataFrame,
    index: DataFrame,
    k: int,
    digits: int = SCORE_DIGITS,
    max_questions: int = MAX_BROADCAST_QUESTIONS,
    counts: tuple[Accumulator, Accumulator] | None = None,
) -> DataFrame:
    """What ``search.exact_topk`` returns, (question_id, rank, id, score), from an index of blocks.

    A first job over centres and bounds finds the block that promises most for each question; its k-th best score there
    is what other blocks must reach, and tasks raise it as they go. Questions travel with the tasks, as many at a time
    as the bounds for a broadcast allow, and all of them in as many passes as that takes. ``counts`` add up the
    (question, block) pairs that were multiplied and those that were skipped.
    """
    q = questions.select("question_id", F.col("bucket").cast("string").alias("bucket"), as_doubles(F.col("vec")).alias("vec"))
    q = cut_lineage(q.where(usable("vec") & (F.size("vec") > 0)))
    sized = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    at_once = max(1, min(max_questions, MAX_BROADCAST_BYTES // (8 * (sized["dim"] or 1))))
    passes = max(1, -(-sized["n"] // at_once))
    found = None
    for at in range(passes):
        some = q.where(F.pmod(F.xxhash64("question_id", "vec"), F.lit(passes)) == at) if passes > 1 else q
        part = _search(some, index, k, digits, counts)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.col("id"))
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("question_id", "rank", "id", "score")


def _search(q: DataFrame, index: DataFrame, k: int, digits: int, counts) -> DataFrame:
    spark = q.sparkSession
    groups: dict[tuple, tuple[list, list]] = {}
    for r in q.collect():
        ids, vecs = groups.setdefault((r["bucket"], len(r["vec"])), ([], []))
        ids.append(r["question_id"])
        vecs.append(r["vec"])
    packed = {
        key: (_id_array(ids), np.array(vecs, float), np.full(len(ids), -np.inf)) for key, (ids, vecs) in groups.items()
    }
    buckets = sorted({b for b, _ in packed})
    blocks = index.where(F.col("bucket").isin(buckets)) if buckets else index.where("false")
    for (key, i), least in _first_bounds(blocks, packed, k, digits).items():
        packed[key][2][i] = least
    shared = spark.sparkContext.broadcast(packed)
    schema = T.StructType(
        [
            T.StructField("question_id", q.schema["question_id"].dataType),
            T.StructField("id", index.schema["ids"].dataType.elementType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = Scan(shared.value, k, digits)
        for batch in batches:
            for row in batch.to_pylist():
                running.add(**row)
        for run in running.running.values():
            yield _record_batch(run.columns(), arrow)
        if counts is not None:
            counts[0].add(running.met)
            counts[1].add(running.skipped)

    return blocks.select("bucket", "dim", "ids", "vecs", "centre", "radius", "norm").mapInArrow(scan, schema)


def _first_bounds(blocks: DataFrame, packed: dict, k: int, digits: int) -> dict[tuple, float]:
    """For each question the k-th best score in the block with the highest score of its centre, if that has k vectors.

    Centres only are read for the choice, and of the chosen blocks there are at most as many as questions.
    """
    shared = blocks.sparkSession.sparkContext.broadcast({key: m for key, (_, m, _) in packed.items()})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {key: (np.full(len(m), -np.inf), np.full(len(m), -1)) for key, m in shared.value.items()}
        names: list[str] = []
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["bucket"], row["dim"])
                if key in best and row["n"] >= k:
                    top, which = best[key]
                    scores = shared.value[key] @ np.frombuffer(row["centre"])
                    better = np.flatnonzero(scores > top)
                    top[better], which[better] = scores[better], len(names)
                    names.append(row["block"])
        for (bucket, dim), (top, which) in best.items():
            some = np.flatnonzero(which >= 0)
            arrays = [
                pa.array([bucket] * len(some), pa.string()),
                pa.array([dim] * len(some), pa.int32()),
                pa.array(some, pa.int32()),
                pa.array(top[some], pa.float64()),
                pa.array([names[j] for j in which[some].tolist()], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["bucket", "dim", "i", "score", "block"])

    name = _name().alias("block")
    seen = blocks.select("bucket", "dim", F.size("ids").alias("n"), "centre", name)
    scored = seen.mapInArrow(score, "bucket string, dim int, i int, score double, block string")
    chosen = scored.groupBy("bucket", "dim", "i").agg(F.max_by("block", F.struct("score", "block")).alias("block"))
    asked = chosen.groupBy("bucket", "dim", "block").agg(F.collect_list("i").alias("asked"))
    met = blocks.select("dim", "vecs", "bucket", name).join(F.broadcast(asked), ["bucket", "dim", "block"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                vectors = np.frombuffer(row["vecs"]).reshape(-1, row["dim"])
                own = shared.value[row["bucket"], row["dim"]][row["asked"]]
                scores = np.partition(np.round(own @ vectors.T, digits) + 0.0, -k, axis=1)[:, -k]
                rows += [(row["bucket"], row["dim"], i, s) for i, s in zip(row["asked"], scores.tolist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["bucket", "dim", "i", "least"])

    reached = met.mapInArrow(reach, "bucket string, dim int, i int, least double").collect()  # a row for a question
    return {((r["bucket"], r["dim"]), r["i"]): r["least"] for r in reached}


def _name() -> Column:
    """A block's name: that of its vectors."""
    return F.sha2("vecs", 256)
