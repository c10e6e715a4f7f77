"""Mix sources to target weights: exact block quotas, split over output shards by a hypergeometric tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm.shared import bounded_batches, stage, utf8

#: Words of a block, and about how many blocks there are at most: beyond that, blocks grow with the corpus.
BLOCK_WORDS, MOST_BLOCKS = 50_000, 65_536


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Words wanted of every source: ``share`` of all words by weight, each at most ``most`` times its size.

    What a source can't give is shared by weight among the others, until none is above its limit.
    """
    wanted, left, free = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / weight >= most * sizes[i]}
        if not full:
            for i in free:
                wanted[i] = left * weights[i] / weight
            break
        for i in full:
            wanted[i] = most * float(sizes[i])
        left -= sum(wanted[i] for i in full)
        free -= full
    return wanted


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard: rows sum to near equal numbers, columns to the quotas, exactly.

    The shards are halved again and again, and the blocks of the left half are a multivariate hypergeometric draw
    from those of the whole: the same law as dealing out all blocks at random, without holding them.
    """
    sizes = np.array([(quotas.sum() * (k + 1)) // shards - (quotas.sum() * k) // shards for k in range(shards)])
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(first: int, last: int, rest: np.ndarray) -> None:
        if last - first == 1:
            out[first] = rest
            return
        middle = (first + last) // 2
        rng = np.random.default_rng([seed, first, last])
        left = rng.multivariate_hypergeometric(rest, sizes[first:middle].sum(), method="marginals")
        split(first, middle, left)
        split(middle, last, rest - left)

    split(0, shards, quotas.astype(np.int64))
    return out


def mix(
    docs: DataFrame,
    weight_cycle: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    shards: int = 8,
    seed: int = 7,
) -> DataFrame:
    """Take documents, some of them repeatedly, so that sources come in target proportions.

    The size of a document is its number of words. Sources in code point order (NULL is a source, the last) have the
    weights of ``weight_cycle``, repeating; ``targets`` tells what each is to give. Documents of a source fall into
    blocks by a seeded hash. A source gives as many whole passes over its blocks as its target holds, then whole
    blocks in permuted order, and of one last block single documents: in hash order, each that fits into the rest, the
    last of them chosen so that the rest is used up as nearly as possible. ``split_tree`` parts the exact block quotas
    among the output shards, which then take disjoint stretches of each source's permuted blocks. No document is taken more than ``most`` times.

    One row per source and per block (at most some 65,536 and one for every source) come to the driver; the documents
    never do, and no source is one group: a block is, of some 50,000 words or a 65,536th of the corpus.

    Returns doc_id, size, source_size, target, taken (words, repeats counted) and shards (one number for each time
    that the document is taken) for every row. A NULL text has size 0; sizes of 0 are taken like others. Repeated rows
    are documents of their own; results depend on ids, texts' sizes and the seed only, so reruns agree. NULL ids stay;
    an empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(
        _sizes, f"doc_id {kind}, source string, size long"
    )
    sized = stage(sized.withColumn("key", F.xxhash64(F.lit(seed), "doc_id")))
    sources = [tuple(r) for r in sized.groupBy("source").agg(F.sum("size"), F.count("*")).collect()]
    sources.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [r[1] for r in sources]
    wanted = targets(sizes, [weight_cycle[i % len(weight_cycle)] for i in range(len(sizes))], share, most)
    per_block = max(BLOCK_WORDS, sum(sizes) // MOST_BLOCKS)
    counts = [max(1, -(-n // per_block)) for n in sizes]
    facts = spark.createDataFrame(
        [(r[0], i, n, w, c) for i, (r, n, w, c) in enumerate(zip(sources, sizes, wanted, counts, strict=True))],
        "source string, number int, source_size long, target double, blocks int",
    )
    placed = (
        sized.alias("d")
        .join(F.broadcast(facts).alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")))
        .select("doc_id", "size", "key", "number", "source_size", "target", _block().alias("block"))
    )
    blocks = {}
    for r in placed.groupBy("number", "block").agg(F.sum("size").alias("size")).collect():
        blocks.setdefault(r["number"], {})[r["block"]] = r["size"]
    plan = plan_blocks(blocks, sizes, wanted, shards, seed)
    planned = spark.createDataFrame(plan, "number int, block int, whole array<int>, part long, part_shard int")
    rows = placed.join(F.broadcast(planned), ["number", "block"])
    taken = _with_parts(rows)
    times = F.concat("whole", F.when(F.col("in_part"), F.array("part_shard")).otherwise(F.array().cast("array<int>")))
    return taken.withColumn("shards", F.when(F.col("target") > 0, times).otherwise(F.array().cast("array<int>"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards"
    )


def draw(docs: DataFrame, mixed: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, shuffled within their shard.

    ``mixed`` comes from ``mix`` on the same rows. Rows with equal ids share what one of them is given.
    """
    times = mixed.groupBy(F.col("doc_id").alias("_id")).agg(F.max("shards").alias("_shards"))
    times = times.where(F.size("_shards") > 0).hint("shuffle_hash")
    out = docs.join(times, F.col("doc_id").eqNullSafe(F.col("_id")))
    out = out.select(*docs.columns, F.posexplode("_shards").alias("_time", "_shard"))
    out = out.withColumn("_order", F.xxhash64(F.lit(seed), "_shard", "_time", "doc_id"))
    # A shard may be larger than a task should sort, so it is written in several parts, each shuffled.
    spread = F.pmod("_order", F.lit(1 << 20))
    return out.repartition("_shard", spread).sortWithinPartitions("_shard", "_order").select(*docs.columns)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pa.array([len(raw.split()) if raw else 0 for raw in utf8(batch.column("text"))], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], ["doc_id", "source", "size"])


def _block() -> Column:
    return F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")


def _permuted(blocks: list[int], number: int, epoch: int, seed: int) -> list[int]:
    def rank(b: int) -> bytes:
        return hashlib.blake2b(f"{seed}/{number}/{epoch}/{b}".encode(), digest_size=8).digest()

    return sorted(blocks, key=rank)


def plan_blocks(
    blocks: dict[int, dict[int, int]], sizes: list[int], wanted: list[float], shards: int, seed: int
) -> list[tuple[int, int, list[int], int | None, int | None]]:
    """For every block of every source: the shards that take it whole, and the words that one more takes of it."""
    draws: dict[int, list[int]] = {}
    part: dict[int, tuple[int, int]] = {}  # the block that a source gives a part of, and the words of it
    for number, size in enumerate(sizes):
        own = blocks.get(number, {})
        passes = int(wanted[number] // size) if size else 0
        order = [b for epoch in range(passes) for b in _permuted(list(own), number, epoch, seed)]
        rest = wanted[number] - passes * size
        for b in _permuted(list(own), number, passes, seed):
            if own[b] > rest:
                if rest >= 0.5:
                    part[number] = b, round(rest)
                    order.append(b)
                break
            order.append(b)
            rest -= own[b]
        draws[number] = order
    tree = split_tree(np.array([len(draws[n]) for n in range(len(sizes))], np.int64), shards, seed)
    whole: dict[tuple[int, int], list[int]] = {(n, b): [] for n, own in blocks.items() for b in own}
    part_shard: dict[int, int] = {}
    for number, order in draws.items():
        at = 0
        for shard in range(shards):
            for b in order[at : at + int(tree[shard, number])]:
                whole[number, b].append(shard)
            at += int(tree[shard, number])
        if number in part:
            part_shard[number] = whole[number, part[number][0]].pop()  # the partial block is the last one drawn

    def rest_of(n: int, b: int) -> tuple[int | None, int | None]:
        return (part[n][1], part_shard[n]) if n in part and part[n][0] == b else (None, None)

    return [(n, b, w, *rest_of(n, b)) for (n, b), w in whole.items()]


def _with_parts(rows: DataFrame) -> DataFrame:
    """Tell which documents of the partial blocks are taken once more; there is one such block for a source at most."""
    inside = F.col("part").isNotNull()
    partial = rows.where(inside)
    schema = ", ".join(f"{name} {kind}" for name, kind in partial.dtypes) + ", in_part boolean"
    partial = partial.groupBy("number", "block").applyInArrow(_first_fit, schema)
    whole = rows.where(~inside).withColumn("in_part", F.lit(False))
    return whole.unionByName(partial)


def _first_fit(block: pa.Table) -> pa.Table:
    """Documents of one block in hash order, each taken if it fits into the words that are left.

    What is still missing then is made up for, as nearly as possible, by one more document, or by one instead of
    another.
    """
    block = block.sort_by([("key", "ascending"), ("size", "ascending")])
    left, sizes = block.column("part")[0].as_py(), block.column("size").to_numpy()
    taken = np.zeros(len(sizes), bool)
    for i, size in enumerate(sizes.tolist()):
        if size <= left:
            taken[i] = True
            left -= size
    others = np.flatnonzero(~taken)
    if left and len(others):
        others = others[np.argsort(sizes[others], kind="stable")]
        out = np.concatenate([[-1], np.flatnonzero(taken)])  # -1: none goes
        wanted = np.where(out < 0, 0, sizes[out]) + left
        at = np.searchsorted(sizes[others], wanted)
        at = np.stack([np.maximum(at - 1, 0), np.minimum(at, len(others) - 1)])
        miss = np.abs(sizes[others][at] - wanted)
        row, best = np.unravel_index(np.argmin(miss), miss.shape)
        if miss[row, best] < left:
            taken[others[at[row, best]]] = True
            if out[best] >= 0:
                taken[out[best]] = False
    return block.append_column("in_part", pa.array(taken))
