"""Exact vector search, routing and context assembly.

Search multiplies blocks of vectors with blocks of questions inside tasks and keeps the best k per
question in each task, so all pairs are scored but only survivors become rows. Scores are rounded
before they are ranked and ties go to the smaller id, hence the result does not depend on how the
work was split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from folioworks import fixed_values as fv
from folioworks.functions.core import bind
from folioworks.functions.text import focus_tokens, mentions_any, name_tokens
from folioworks.functions.vectors import as_doubles, dot
from folioworks.session import cut_lineage

# Questions are broadcast only below these bounds; beyond them both sides are blocked and shuffled.
MAX_BROADCAST_QUESTIONS = 20_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
VECTORS_PER_BLOCK = 50_000
QUESTIONS_PER_BLOCK = 2_000
MAX_SCORE_CELLS, ROWS_PER_SLICE = 1_000_000, 2_000
#: Blocks that a bucket's questions, or its vectors, are cut into at most while blocks stay within the sizes above.
MOST_BLOCKS = 8
MAX_LITERAL_ROUTES = 256
SCORE_DIGITS = 6


# --- block top-k in numpy -----------------------------------------------------------------------


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the expected size as one matrix, and the mask of the rows that have it."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    flat = column.filter(ok).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), ok.to_numpy(zero_copy_only=False)


class _Running:
    """Best k per question over a stream of vector blocks.

    ``least`` is what a question's scores must reach: its k-th best so far, or what the caller knows of it. Only scores
    that do are rounded and kept, so most of a block is multiplied and compared and nothing else. What is kept is
    cut down to k for each question from time to time.
    """

    def __init__(self, qids: np.ndarray, matrix: np.ndarray, k: int, digits: int, least: np.ndarray | None = None):
        self.qids, self.matrix, self.k, self.digits = qids, matrix, k, digits
        self.least = np.full(len(qids), -np.inf) if least is None else least.copy()
        self.full = np.zeros(len(qids), bool)  # questions that have k, the last with the id ``worst``
        self.worst: np.ndarray | None = None
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # question's place, score, id
        self.rows = 0

    def slack(self, scores: np.ndarray) -> np.ndarray:
        """By how much a score may be below what it has to reach, for it is rounded before it is ranked."""
        return 10.0**-self.digits + 1e-9 * np.maximum(1.0, np.abs(scores))

    def add(self, vectors: np.ndarray, ids: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Score a block, for some of the questions. Slices of both keep the score table small."""
        asked = np.arange(len(self.qids)) if asked is None else asked
        width = min(len(vectors), ROWS_PER_SLICE)
        step = max(1, MAX_SCORE_CELLS // max(1, width))
        for at in range(0, len(asked), step):
            some = asked[at : at + step]
            matrix = self.matrix[some]
            for begin in range(0, len(vectors), width):
                self._slice(some, matrix @ vectors[begin : begin + width].T, ids[begin : begin + width])

    def _slice(self, asked: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.least[asked]
        unbound = np.flatnonzero(np.isneginf(least))
        if len(unbound) and scores.shape[1] >= self.k:
            least[unbound] = np.partition(scores[unbound], -self.k, axis=1)[:, -self.k]
        with np.errstate(invalid="ignore"):
            least -= self.slack(least)
            row, column = np.nonzero(~(scores < least[:, None]))
        found, place, names = np.round(scores[row, column], self.digits) + 0.0, asked[row], ids[column]
        if self.worst is not None:
            least = self.least[place]
            good = ~(found < least) & ~((found == least) & self.full[place] & (names > self.worst[place]))
            found, place, names = found[good], place[good], names[good]
        if len(found):
            self.kept.append((place, found, names))
            self.rows += len(found)
        if self.rows > max(MAX_SCORE_CELLS // 4, 2 * self.k * len(self.qids)):
            self._cut()

    def _cut(self) -> None:
        """Keep the best ``k`` of every question by (score descending, id ascending)."""
        if not self.kept:
            return
        place, scores, ids = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((ids, -scores, place))
        place, scores, ids = place[order], scores[order], ids[order]
        begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        rank = np.arange(len(place)) - np.repeat(begins, np.diff(np.append(begins, len(place))))
        best = rank < self.k
        last = rank == self.k - 1
        self.kept, self.rows = [(place[best], scores[best], ids[best])], int(best.sum())
        self.worst = np.zeros(len(self.qids), ids.dtype)
        self.worst[place[last]] = ids[last]
        self.full[place[last]] = scores[last] >= self.least[place[last]]
        self.least[place[last]] = np.maximum(self.least[place[last]], scores[last])

    def columns(self) -> list[np.ndarray]:
        """Question, id and score of what is kept and reaches the least score of its question."""
        self._cut()
        if not self.kept:
            return [self.qids[:0], self.qids[:0], self.least[:0]]
        place, scores, ids = self.kept[0]
        enough = ~(scores < self.least[place])
        return [self.qids[place[enough]], ids[enough], scores[enough]]


def _id_array(values) -> np.ndarray:
    a = np.asarray(list(values))
    return a.astype(str) if a.dtype == object else a


# --- exact search -------------------------------------------------------------------------------


def usable(vec: str) -> Column:
    """Vectors with elements that are all numbers; others would rank by accident."""
    return F.col(vec).isNotNull() & ~F.exists(F.col(vec), lambda x: x.isNull() | F.isnan(x))


def exact_topk(
    questions: DataFrame,
    vectors: DataFrame,
    k: int,
    digits: int = SCORE_DIGITS,
    max_questions: int = MAX_BROADCAST_QUESTIONS,
    strict: bool = False,
    per_block: tuple[int, int] = (QUESTIONS_PER_BLOCK, VECTORS_PER_BLOCK),
) -> DataFrame:
    """(question_id, rank, id, score): the best ``k`` vectors per question by inner product.

    ``questions`` has (question_id, bucket, vec) and ``vectors`` (id, bucket, vec); a question meets the vectors of
    its bucket. Vectors of another size than the question's, and vectors with NULL or NaN elements, are left out;
    ``strict`` fails where a question's bucket has vectors, but none of its size.
    """
    q = questions.select("question_id", F.col("bucket").cast("string").alias("bucket"), as_doubles(F.col("vec")).alias("vec"))
    v = vectors.select("id", F.col("bucket").cast("string").alias("bucket"), "vec")
    q, v = q.where(usable("vec")), v.where(usable("vec"))
    if strict:
        require_sizes(q, v)
    sized = q.limit(max_questions + 1).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    small = sized["n"] <= max_questions and sized["n"] * (sized["dim"] or 0) * 8 <= MAX_BROADCAST_BYTES
    partial = _topk_broadcast(q, v, k, digits) if small else _topk_blocked(q, v, k, digits, per_block)
    w = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.col("id"))
    ranked = partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("question_id", "rank", "id", "score")


def require_sizes(q: DataFrame, v: DataFrame) -> None:
    """Fail where a bucket has vectors, but none of the size of a question that asks it."""
    asked = q.groupBy("bucket", F.size("vec").alias("dim")).agg(F.count("*").alias("_n"))
    stored = v.groupBy("bucket", F.size("vec").alias("dim")).agg(F.count("*").alias("_m"))
    named = asked.join(stored.select("bucket").distinct(), "bucket", "left_semi")
    missing = named.join(stored, ["bucket", "dim"], "left_anti").orderBy("bucket", "dim").first()
    if missing is not None:
        raise ValueError(f"bucket {missing['bucket']} has no vectors of size {missing['dim']}")


def _result_schema(q: DataFrame, v: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("question_id", q.schema["question_id"].dataType),
            T.StructField("id", v.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _record_batch(columns: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(c.tolist(), type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _topk_broadcast(q: DataFrame, v: DataFrame, k: int, digits: int) -> DataFrame:
    """The checked, small question side travels with the tasks; the vectors are scanned once."""
    rows = q.collect()
    groups: dict[tuple, tuple[list, list]] = {}
    for r in rows:
        if r["vec"]:
            ids, vecs = groups.setdefault((r["bucket"], len(r["vec"])), ([], []))
            ids.append(r["question_id"])
            vecs.append(r["vec"])
    packed = {key: (_id_array(ids), np.asarray(vecs, dtype=np.float64)) for key, (ids, vecs) in groups.items()}
    shared = q.sparkSession.sparkContext.broadcast(packed)
    schema = _result_schema(q, v)
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = {key: _Running(ids, matrix, k, digits) for key, (ids, matrix) in shared.value.items()}
        for batch in batches:
            names, ids, vecs = batch.column("bucket"), batch.column("id"), batch.column("vec")
            for (bucket, dim), run in running.items():
                mine = pc.equal(names, bucket)
                m, ok = _matrix(vecs.filter(mine), dim)
                if len(m):
                    run.add(m, _id_array(ids.filter(mine).filter(pa.array(ok)).to_pylist()))
        for run in running.values():
            yield _record_batch(run.columns(), arrow)

    buckets = sorted({b for b, _ in packed if b is not None})
    wanted = v.where(F.col("bucket").isin(buckets)) if buckets else v.limit(0)
    return wanted.mapInArrow(scan, schema)


def block_counts(q: DataFrame, v: DataFrame, per_block: tuple[int, int]) -> DataFrame:
    """(bucket, n_q, n_v): the blocks of each bucket's questions and vectors."""

    def counts(df: DataFrame, name: str, rows: int, most: int) -> DataFrame:
        sizes = df.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
        grown = F.greatest(F.lit(rows), F.least(F.ceil(F.col("_n") / MOST_BLOCKS), F.lit(most)))
        return sizes.select("bucket", F.ceil(F.col("_n") / grown).cast("int").alias(name))

    asked = counts(q, "n_q", per_block[0], QUESTIONS_PER_BLOCK)
    return asked.join(counts(v, "n_v", per_block[1], VECTORS_PER_BLOCK), "bucket")


def _best_of_block(left: pa.Table, right: pa.Table, k: int, digits: int, schema: pa.Schema) -> list[pa.RecordBatch]:
    """The best of one block of vectors for one of questions; only a slice of the vectors is held in double precision."""
    out = []
    asked = left["vec"].combine_chunks()
    for dim in pc.unique(pc.drop_null(pc.list_value_length(asked))).to_pylist():
        matrix, has = _matrix(asked, dim)
        if dim and len(matrix):
            mask = pa.array(has)
            least = left["bound"].filter(mask).to_numpy().astype(np.float64)
            run = _Running(_id_array(left["question_id"].filter(mask).to_pylist()), matrix, k, digits, least)
            for batch in right.to_batches(ROWS_PER_SLICE):
                m, ok = _matrix(batch.column("vec"), dim)
                if len(m):
                    run.add(m, _id_array(batch.column("id").filter(pa.array(ok)).to_pylist()))
            out.append(_record_batch(run.columns(), schema))
    return out


def _topk_blocked(q: DataFrame, v: DataFrame, k: int, digits: int, per_block: tuple[int, int]) -> DataFrame:
    """Both sides cut into blocks, per bucket, by a hash of the id; blocks of one bucket meet in a task.

    Block numbers come from each bucket's own counts, so a small bucket is one block and a question reaches the
    blocks of its bucket only. A row is copied to as many tasks as the other side has blocks, so ``per_block`` holds
    while a bucket has few of them: beyond ``MOST_BLOCKS`` its blocks grow, to ``QUESTIONS_PER_BLOCK`` and
    ``VECTORS_PER_BLOCK`` rows, and only then their number does. Every question meets its first block; its k-th best score there is a lower bound, and
    of the other blocks only what reaches that is put out. So partial rows hardly grow with the number of blocks.
    Questions are written once, for they are counted and may be costly to route.
    """
    q = cut_lineage(q)

    blocks = block_counts(q, v, per_block)
    blocks = cut_lineage(blocks)  # a row per bucket

    def block(ident: str, n: str) -> Column:
        return F.pmod(F.xxhash64(F.col(ident)), F.col(n)).cast("int")

    def each(first: int, n: str) -> Column:
        return F.explode(F.when(F.col(n) > first, F.sequence(F.lit(first), F.col(n) - 1)))

    schema = _result_schema(q, v)
    arrow = to_arrow_schema(schema)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_best_of_block(left, right, k, digits, arrow), schema=arrow)

    keys = ["bucket", "vb", "qb"]
    vb = v.join(blocks, "bucket").select(*v.columns, block("id", "n_v").alias("vb"), each(0, "n_q").alias("qb"))
    qb = q.join(blocks, "bucket").withColumn("qb", block("question_id", "n_q"))

    def met(questions: DataFrame, stored: DataFrame) -> DataFrame:
        return questions.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(meet, schema)

    first = qb.withColumns({"vb": F.lit(0), "bound": F.lit(float("-inf"))})
    first = cut_lineage(met(first, vb.where("vb = 0")))
    reached = first.groupBy("question_id").agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
    bound = F.when(F.col("_n") >= k, F.col("_least")).otherwise(F.lit(float("-inf")))
    others = qb.join(reached, "question_id", "left").withColumn("bound", F.coalesce(bound, F.lit(float("-inf"))))
    others = others.withColumn("vb", each(1, "n_v"))
    return first.unionByName(met(others, vb.where("vb > 0")))


# --- routing ------------------------------------------------------------------------------------


def routes_literal(routes: DataFrame) -> Column | None:
    """The routes (index_type, boosted, vec) as one constant, or None when there are too many."""
    rows = routes.orderBy("index_type").limit(MAX_LITERAL_ROUTES + 1).collect()
    if len(rows) > MAX_LITERAL_ROUTES:
        return None

    def one(r) -> str:
        vec = ", ".join(f"{float(x)!r}D" for x in r["vec"])
        name = str(r["index_type"]).replace("\\", "\\\\").replace("'", "\\'")
        return f"named_struct('index_type', '{name}', 'boosted', {str(bool(r['boosted'])).lower()}, 'vec', array({vec}))"

    return F.expr(f"array({', '.join(one(r) for r in rows)})")


def route_questions(
    questions: DataFrame,
    routes: DataFrame,
    boost_words: tuple[str, ...] = fv.BOOST_WORDS,
    boost: float = fv.BOOST,
    digits: int = SCORE_DIGITS,
) -> DataFrame:
    """Adds ``ranking`` (score, index_type, best first), ``index_type`` and ``route_score``.

    ``questions`` has (question_id, question, vec); ``routes`` has (index_type, boosted, vec). A
    question naming one of the words gets the boost on boosted routes.
    """
    extra = F.when(mentions_any(F.col("question"), boost_words), F.lit(boost)).otherwise(F.lit(0.0))
    asked = questions.withColumn("vec", as_doubles(F.col("vec")))
    table = routes_literal(routes)
    if table is None:
        return _route_many(asked, routes, extra, digits)

    def score(r: Column, x: Column) -> Column:
        s = dot(F.col("vec"), r["vec"]) + F.when(r["boosted"], x).otherwise(0.0)
        return F.struct((-F.round(s, digits)).alias("neg"), r["index_type"].alias("index_type"))

    ranked = bind(extra, lambda x: F.sort_array(F.transform(table, lambda r: score(r, x))))
    out = asked.withColumn(
        "ranking",
        F.transform(ranked, lambda s: F.struct((-s["neg"]).alias("score"), s["index_type"].alias("index_type"))),
    )
    best = F.get(F.col("ranking"), 0)
    return out.withColumn("index_type", best["index_type"]).withColumn("route_score", best["score"])


def _route_many(asked: DataFrame, routes: DataFrame, extra: Column, digits: int) -> DataFrame:
    """Routing as exact search: the boost becomes one more dimension of both vectors."""
    q = asked.select("question_id", F.lit("all").alias("bucket"), F.concat("vec", F.array(extra)).alias("vec"))
    flag = F.when(F.col("boosted"), 1.0).otherwise(0.0)
    v = routes.select(
        F.col("index_type").alias("id"),
        F.lit("all").alias("bucket"),
        F.concat(as_doubles(F.col("vec")), F.array(flag)).alias("vec"),
    )
    found = exact_topk(q, v, routes.count(), digits)
    ranking = F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "score", F.col("id").alias("index_type")))),
        lambda s: F.struct(s["score"].alias("score"), s["index_type"].alias("index_type")),
    )
    ranked = found.groupBy("question_id").agg(ranking.alias("ranking"))
    out = asked.join(ranked, "question_id", "left")
    best = F.get(F.col("ranking"), 0)
    return out.withColumn("index_type", best["index_type"]).withColumn("route_score", best["score"])


def bucket_centroids(vectors: DataFrame, bucket: str = "index_type", vec: str = "vec") -> DataFrame:
    """(bucket, vec): mean vector of every bucket, added up before anything is exchanged."""
    parts = vectors.select(bucket, F.posexplode(as_doubles(F.col(vec))).alias("d", "x"))
    means = parts.groupBy(bucket, "d").agg(F.avg("x").alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("d", "x")))
    return means.groupBy(bucket).agg(F.transform(ordered, lambda s: s["x"]).alias("vec"))


def routed_topk(
    routed: DataFrame, vectors: DataFrame, k_by_bucket: dict[str, int], default_k: int = 3, **options
) -> DataFrame:
    """Search each question in its bucket; every bucket has its own k."""
    largest = max([default_k, *k_by_bucket.values()])
    asked = routed.select("question_id", F.col("index_type").alias("bucket"), "vec")
    found = exact_topk(asked, vectors, largest, **options)
    limit = F.lit(default_k)
    for name, k in k_by_bucket.items():
        limit = F.when(F.col("index_type") == name, k).otherwise(limit)
    named = found.join(routed.select("question_id", "index_type"), "question_id")
    return named.where(F.col("rank") <= limit).select("question_id", "index_type", "rank", "id", "score")


def compatible_buckets(stats: DataFrame, dim: int) -> DataFrame:
    """Buckets whose vectors fit a question of size ``dim``; one without vectors yet stays."""
    return stats.where(F.col("dim").isNull() | (F.col("dim") == dim))


# --- after retrieval ----------------------------------------------------------------------------


def name_match_filter(found: DataFrame, question: str, name: str, rank: str = "rank") -> DataFrame:
    """Keep the chunks whose name tokens all occur in the question, else the best-ranked one.

    ``found`` holds at most k rows per question. A chunk without a name (NULL) never matches.
    """
    names = name_tokens(F.col(name))
    hit = F.coalesce(
        (F.size(names) > 0) & (F.size(F.array_except(names, focus_tokens(F.col(question)))) == 0), F.lit(False)
    )
    w = Window.partitionBy("question_id")
    marked = found.withColumn("_hit", hit)
    marked = marked.withColumn("_any", F.max("_hit").over(w)).withColumn("_first", F.min(rank).over(w))
    return marked.where(F.col("_hit") | (~F.col("_any") & (F.col(rank) == F.col("_first")))).drop("_hit", "_any", "_first")
