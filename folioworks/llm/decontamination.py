"""Find benchmark items in documents, also paraphrased, by latent semantic retrieval and exact checks."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from folioworks.llm.shared import bounded_batches, stage

#: A passage is two chunks of so many words; consecutive passages share one.
CHUNK = 32
#: Rank of the decomposition, its oversampling and its passes over all passages of the corpus.
RANK, MORE, PASSES = 256, 16, 2
#: Chunks that are multiplied at once, and words of them that most passages have: their counts are a dense block.
FIT_CHUNKS, FIT_DENSE = 512, 128
#: Up to so many words of the items, the products of all pairs of words are summed once, in blocks of so many bytes, and
#: the passes go over the sums; the words that most passages have are a dense block there, too.
MOST_PAIRED, PAIRED_BYTES, PAIRED_DENSE = 6000, 1 << 20, 64
#: Words in a larger share of the documents and of the items than this carry no weight.
MOST_COMMON = 0.2
#: Passages this near to an item are checked: the lower, the more.
LEAST_COSINE = 0.2
#: Items that keep less of their length than this in the space are found by the words they share instead.
LEAST_KEPT = 0.95
#: Pairs of a word and an item that are held at once.
PAIRS = 1_000_000
#: Shares of an item's words that must follow in order: for itself, and for a paraphrase that has the answer, too.
SAME, PARAPHRASE, ANSWER = 0.6, 0.45, 0.8
#: Items travel with every task and are compared in blocks.
MOST_ITEMS, ITEM_BLOCK = 50_000, 1000

#: Words in a block of the products that tasks add up; one sum of each comes to the driver.
WORD_BLOCK = 4096
#: Words whose counts are kept as a dense block.
FREQUENT = 640
#: Cells of chunks x words that are held at once to count an item's words in windows, and chunks of the longest of them.
PRESENT, LONGEST = 1 << 24, 64

_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split() if text else []


def answer_of(text: str) -> list[bytes]:
    """The words of an item's last sentence, which stand for its answer where it has no other."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if tokens(s)]
    return tokens(sentences[-1]) if sentences else []


def item_passages(item: list[bytes]) -> list[tuple[int, list[bytes]]]:
    """An item cut as documents are, into overlapping passages, each with its first chunk; a short item is one."""
    chunks = -(-len(item) // CHUNK)
    return [(at, item[at * CHUNK : (at + 2) * CHUNK]) for at in range(max(1, chunks - 1))]


def window_chunks(length: int) -> tuple[int, int]:
    """Chunks that a window for an item has before the item's place, and in all: half the item's length on each side."""
    chunks = max(2, -(-length // CHUNK))
    before = -(-chunks // 2)
    return before, chunks + 2 * before


@dataclass(frozen=True)
class Shared:
    """Items of similar length by their rarer words: ``owners[begins[w] : begins[w + 1]]`` have the word ``w``.

    A leak has at least ``least`` of these words of the item in a window, since the words left out are too few.
    """

    items: np.ndarray
    begins: np.ndarray
    owners: np.ndarray
    least: np.ndarray
    #: Chunks of each item's window, and the step from one window to the next.
    sizes: np.ndarray
    steps: np.ndarray


@dataclass(frozen=True)
class Index:
    """Items, the word weights, and the latent space: ``space`` has a row for each word of the items."""

    ids: list
    items: list[list[bytes]]
    answers: list[list[bytes]]
    vocabulary: dict[bytes, int]
    weights: np.ndarray
    unknown: float
    space: np.ndarray
    #: The passages of the items that the space keeps, and for each its item and the chunk of the item that it begins with.
    queries: np.ndarray
    owners: np.ndarray
    offsets: np.ndarray
    #: The other items.
    shared: list[Shared]
    #: Places of the words that most documents have: their counts are multiplied as a block.
    frequent: np.ndarray
    #: For each item, a bit mask of the places of each of its words.
    places: list[dict[bytes, int]]
    #: The words of all items, item by item from ``begins`` on, and how often the item has each.
    begins: np.ndarray
    words: np.ndarray
    times: np.ndarray
    id_type: DataType


def fit(docs: DataFrame, benchmark: DataFrame) -> Index:
    """Weights from all documents, the latent space from all items and all passages.

    Every whole text is cut into words once, and the numbers of those that items have are staged by chunks, two bytes
    or four for each. Document frequencies are counted over them, on the tasks first. The TF-IDF rows of all items and
    of all passages form the matrix; items weigh as much as the passages together. A randomised range finder with power
    passes runs as Spark jobs. Up to ``MOST_PAIRED`` words, tasks sum the products of all pairs of words over the staged
    chunks, these sums are added by blocks on the tasks and staged, and a pass multiplies them with the broadcast basis
    (words of the items x 272). With more words, each pass multiplies the chunks' rows with the basis, and the partial
    products are added by blocks of words on the tasks. Either way one sum comes to the driver, and is made orthonormal.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    columns = ["item_id", "text", *(["answer"] if "answer" in benchmark.columns else [])]
    rows = benchmark.select(columns).where(F.col("text").isNotNull()).orderBy("item_id", "text").take(MOST_ITEMS + 1)
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items: run the benchmark in parts")
    rows = [r for r in rows if tokens(r["text"])]
    items = [tokens(r["text"]) for r in rows]
    answers = [tokens(r["answer"]) if len(columns) > 2 and r["answer"] else answer_of(r["text"]) for r in rows]
    vocabulary = {w: i for i, w in enumerate(sorted({w for item in items for w in item}))}

    chunks = stage(docs.select("text").mapInArrow(_chunk_rows(vocabulary), "words binary, ends binary, lasts binary"))
    counted = chunks.select("words", "ends", "lasts").mapInArrow(_frequencies(len(vocabulary)), "word int, n long")
    counts = {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    number = counts.pop(-1, 0)
    in_docs = np.array([counts.get(i, 0) for i in range(len(vocabulary))], np.float64)
    weights = word_weights(
        in_docs,
        number,
        np.bincount([vocabulary[w] for item in items for w in set(item)], minlength=len(vocabulary)),
        len(items),
    )
    unknown = float(np.median(weights)) if len(weights) else 1.0

    cut = [(i, at, piece) for i, item in enumerate(items) for at, piece in item_passages(item)]
    owners, offsets = np.array([c[0] for c in cut], np.int64), np.array([c[1] for c in cut], np.int64)
    pieces = [c[2] for c in cut]
    space = _decompose(_normed(chunks, weights), _rows_of(pieces, vocabulary), weights)
    space = (weights[:, None] * space).astype(np.float32)
    queries = np.array([space[[vocabulary[w] for w in piece]].sum(axis=0) for piece in pieces], np.float32)
    queries = queries.reshape(len(pieces), space.shape[1])
    kept = np.linalg.norm(queries, axis=1)
    queries /= np.maximum(kept, 1e-12)[:, None]
    kept /= np.array([max(_length([vocabulary[w] for w in piece], weights), 1e-12) for piece in pieces])
    poor = np.unique(owners[kept < LEAST_KEPT])
    rest = ~np.isin(owners, poor)
    queries, owners, offsets = queries[rest], owners[rest], offsets[rest]
    shared = _shared(items, poor.tolist(), vocabulary, in_docs)
    frequent = np.sort(np.argsort(-in_docs, kind="stable")[:FREQUENT])
    ids, places = [r["item_id"] for r in rows], [word_places(item) for item in items]
    begins = np.cumsum([0, *map(len, places)])
    words = np.array([vocabulary[w] for own in places for w in own], np.int64)
    times = np.array([m.bit_count() for own in places for m in own.values()], np.int64)
    return Index(
        ids, items, answers, vocabulary, weights, unknown, space, queries, owners, offsets, shared, frequent, places,
        begins, words, times, benchmark.schema["item_id"].dataType,
    )


def _length(words: list[int], weights: np.ndarray) -> float:
    used, counts = np.unique(np.array(words, np.int64), return_counts=True)
    return float(np.linalg.norm(weights[used] * counts))


def _shared(items: list[list[bytes]], some: list[int], vocabulary: dict[bytes, int], in_docs: np.ndarray) -> list[Shared]:
    """Some items by their words, without the most frequent ones: half of what a leak may do without at most."""
    groups: dict[int, list[int]] = {}
    for i in some:
        groups.setdefault(window_chunks(len(items[i]))[1].bit_length(), []).append(i)
    out = []
    for group in groups.values():
        words, owners, least = [], [], []
        for place, i in enumerate(group):
            needed = math.ceil(PARAPHRASE * len(items[i]) - 1e-9)
            spare = needed - -(-needed // 2)
            counts = Counter(vocabulary[w] for w in items[i])
            for w in sorted(counts, key=lambda w: (-in_docs[w], w)):
                if counts[w] <= spare:
                    spare -= counts[w]
                    needed -= counts[w]
                else:
                    words.append(w)
                    owners.append(place)
            least.append(needed)
        order = np.argsort(words, kind="stable")
        begins = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=len(vocabulary)))])
        sizes = np.array([window_chunks(len(items[i]))[1] for i in group], np.int64)
        steps = np.maximum(1, sizes // 8)
        out.append(
            Shared(np.array(group), begins, np.array(owners, np.int64)[order], np.array(least, np.int64), sizes, steps)
        )
    return out


def word_weights(in_docs: np.ndarray, docs: int, in_items: np.ndarray, items: int) -> np.ndarray:
    """Inverse frequencies: a word is as common as it is among the documents, or among the items where that is less.

    Copies of a contaminated document may fill a third of the corpus; the items tell that its words are no stop words.
    Words that are common in both carry no weight.
    """
    share = np.minimum(np.maximum(in_docs, 1) / (docs + 10), np.maximum(in_items, 1) / (items + 10))
    return np.where(share > MOST_COMMON, 0.0, -np.log(share))


def _kind(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.int32


def _chunk_rows(vocabulary: dict[bytes, int]):
    """The known words of all chunks of a batch, where each chunk ends among them, and each text's chunks up to its end."""
    kind = _kind(len(vocabulary))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [tokens(text.as_py()) for text in batch.column(0)]
            lengths = np.array([len(x) for x in split], np.int64)
            found = map(vocabulary.get, chain.from_iterable(split), repeat(-1))
            word = np.fromiter(found, np.int64, lengths.sum())
            chunks = -(-lengths // CHUNK)
            lasts = np.cumsum(chunks)
            at = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = np.repeat(lasts - chunks, lengths) + at // CHUNK
            ends = np.cumsum(np.bincount(at[word >= 0], minlength=chunks.sum()))
            packed = word[word >= 0].astype(kind).tobytes(), ends.astype(np.int64).tobytes(), lasts.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], ["words", "ends", "lasts"])

    return rows


def _unpacked(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for words, ends, lasts in zip(*(batch.column(c) for c in ("words", "ends", "lasts")), strict=True):
        yield (
            np.frombuffer(words.as_buffer(), _kind(size)),
            np.frombuffer(ends.as_buffer(), np.int64),
            np.frombuffer(lasts.as_buffer(), np.int64),
        )


def _frequencies(size: int):
    """The number of texts with each word, and at -1 that of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, number = np.zeros(size, np.int64), 0
        for batch in batches:
            for words, ends, lasts in _unpacked(batch, size):
                number += len(lasts)
                if len(words):
                    in_text = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], lasts])])
                    pairs = np.unique(np.repeat(np.arange(len(lasts)) * size, in_text) + words)
                    found += np.bincount(pairs % size, minlength=size)
        some = np.flatnonzero(found)
        words = pa.array([*some.tolist(), -1], pa.int32())
        yield pa.RecordBatch.from_arrays([words, pa.array([*found[some].tolist(), number], pa.int64())], ["word", "n"])

    return count


def _normed(chunks: DataFrame, weights: np.ndarray) -> DataFrame:
    """Staged: the words with weight of all chunks, and ``scales``, one over the squared length of each passage."""
    ship = chunks.sparkSession.sparkContext.broadcast(weights)

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = ship.value
        for batch in batches:
            for words, ends, lasts in _unpacked(batch, len(weights)):
                good = weights[words] > 0 if len(words) else np.zeros(0, bool)
                ends = np.concatenate([[0], np.cumsum(good)])[ends]
                words = words[good]
                chunk = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
                joins = _joined(len(ends), lasts)
                before = (chunk > 0) & joins[chunk - 1]  # the passage before has this chunk, too
                keys = np.concatenate([chunk, chunk[before] - 1]) * len(weights) + np.concatenate([words, words[before]])
                keys, times = np.unique(keys, return_counts=True)
                square = (weights[keys % max(1, len(weights))] * times) ** 2
                square = np.bincount(keys // max(1, len(weights)), square, minlength=len(ends))
                scales = np.divide(1.0, square, out=np.zeros(len(ends)), where=square > 0).astype(np.float32)
                packed = words.tobytes(), ends.astype(np.int64).tobytes(), lasts.tobytes(), scales.tobytes()
                names = ["words", "ends", "lasts", "scales"]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], names)

    return stage(chunks.mapInArrow(norm, "words binary, ends binary, lasts binary, scales binary"))


def _joined(chunks: int, lasts: np.ndarray) -> np.ndarray:
    """Whether the passage that begins with a chunk has the next one: all but the last of each text."""
    joins = np.ones(chunks, bool)
    joins[lasts[lasts > 0] - 1] = False
    return joins


def _rows_of(items: list[list[bytes]], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    words = np.array([vocabulary[w] for item in items for w in item], np.int64)
    return words, np.cumsum([len(item) for item in items], dtype=np.int64)


def _product(words: np.ndarray, ends: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A' A basis for the rows of A given by their words: TF-IDF, each of length one."""
    out = np.zeros(basis.shape, np.float32)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    for first in range(0, len(ends), 512):
        a, b = starts[first : first + 512], ends[first : first + 512]
        used, column = np.unique(words[a[0] : b[-1]], return_inverse=True)
        dense = np.zeros((len(a), len(used)), np.float32)
        np.add.at(dense, (np.repeat(np.arange(len(a)), b - a), column), 1)
        dense *= weights[used].astype(np.float32)
        dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
        out[used] += dense.T @ (dense @ basis[used])
    return out


def _passage_product(
    words: np.ndarray, ends: np.ndarray, lasts: np.ndarray, scales: np.ndarray, basis: np.ndarray, dense: np.ndarray,
    out: np.ndarray,
) -> None:
    """Add A' A basis to ``out`` for the rows of all passages; ``basis`` has the weights in it, ``out`` lacks them.

    A passage is two chunks, so chunks are multiplied, and neighbours are added. ``dense`` has the place of each word
    that is counted in a dense block, and -1 for the others, whose rows are gathered.
    """
    joins = _joined(len(ends), lasts)
    wide = int(dense.max(initial=-1)) + 1
    often = np.flatnonzero(dense >= 0)
    often = often[np.argsort(dense[often])]
    for first in range(0, len(ends), FIT_CHUNKS):
        # The chunk before begins a passage that ends here, and the last passage needs the next chunk.
        low, high = max(0, first - 1), min(len(ends), first + FIT_CHUNKS + 1)
        own = min(len(ends), first + FIT_CHUNKS)
        start = ends[low - 1] if low else 0
        word = words[start : ends[high - 1]]
        chunk = np.repeat(np.arange(high - low), np.diff(np.concatenate([[start], ends[low:high]])))
        place = dense[word]
        many = place >= 0
        counts = np.bincount(chunk[many] * wide + place[many], minlength=(high - low) * wide)
        counts = counts.reshape(high - low, wide).astype(np.float32)
        latent = counts @ basis[often]
        rare, at = word[~many], chunk[~many]
        if len(rare):
            begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            latent[at[begins]] += np.add.reduceat(basis[rare], begins, axis=0)
        pair = joins[low:high].copy()
        pair[-1] = False
        nexts = np.flatnonzero(pair)
        added = latent.copy()
        added[nexts] += latent[nexts + 1]
        added *= scales[low:high, None]
        both = added.copy()
        both[nexts + 1] += added[nexts]
        a, b = first - low, own - low
        out[often] += counts[a:b].T @ both[a:b]
        mine = (at >= a) & (at < b)
        rare, at = rare[mine], at[mine]
        if len(rare):
            order = np.argsort(rare, kind="stable")
            rare, at = rare[order], at[order]
            begins = np.flatnonzero(np.concatenate([[True], rare[1:] != rare[:-1]]))
            out[rare[begins]] += np.add.reduceat(both[at], begins, axis=0)


def _paired(
    words: np.ndarray, ends: np.ndarray, lasts: np.ndarray, scales: np.ndarray, wide: int, out: np.ndarray
) -> None:
    """Add the products of all pairs of words in the rows of all passages to ``out``, without the weights.

    The first ``wide`` words are counted in a dense block: their columns get the whole sums. Of other pairs only those
    come that stand in order in a chunk or in it and the next, a word with itself by half: ``out`` there lacks its
    transpose.
    """
    joins = _joined(len(ends), lasts)
    flat = out.reshape(-1)
    for first in range(0, len(ends), FIT_CHUNKS):
        # The chunk before begins a passage that ends here, and the last passage needs the next chunk.
        low, high = max(0, first - 1), min(len(ends), first + FIT_CHUNKS + 1)
        own = min(len(ends), first + FIT_CHUNKS)
        start = ends[low - 1] if low else 0
        word = words[start : ends[high - 1]].astype(np.int64)
        chunk = np.repeat(np.arange(high - low), np.diff(np.concatenate([[start], ends[low:high]])))
        many = word < wide
        counts = np.bincount(chunk[many] * wide + word[many], minlength=(high - low) * wide)
        counts = counts.reshape(high - low, wide).astype(np.float32)
        pair = joins[low:high].copy()
        pair[-1] = False
        nexts = np.flatnonzero(pair)
        added = counts.copy()
        added[nexts] += counts[nexts + 1]
        added *= scales[low:high, None]
        both = added.copy()
        both[nexts + 1] += added[nexts]
        a, b = first - low, own - low
        out[:wide, :wide] += counts[a:b].T @ both[a:b]
        rare, at = word[~many], chunk[~many]
        begin = np.searchsorted(at, np.arange(high - low + 1))
        mine = np.arange(begin[a], begin[b])
        if not len(mine):
            continue
        here = at[mine]
        order = np.argsort(rare[mine], kind="stable")
        ranked = rare[mine][order]
        begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        out[ranked[begins], :wide] += np.add.reduceat(both[here[order]], begins, axis=0)
        same = scales[low:high].copy()
        same[nexts + 1] += scales[low:high][nexts]
        many = begin[here + 1 + pair[here]] - mine  # from the word itself to the end of the next chunk
        one = np.repeat(np.arange(len(mine)), many)
        other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - mine, many)
        value = np.where(at[other] == here[one], same[here[one]], scales[low:high][here[one]])
        value[other == mine[one]] *= 0.5
        np.add.at(flat, rare[mine][one] * len(out) + rare[other], value)


def _pair_sums(passages: DataFrame, order: np.ndarray, tasks: int) -> DataFrame:
    """Staged: the sums of all pairs of words over all passages, by blocks of rows; words come in ``order``."""
    rank = np.empty(len(order), _kind(len(order)))
    rank[order] = np.arange(len(order))
    wide = min(PAIRED_DENSE, len(order))
    step = max(1, PAIRED_BYTES // max(1, 4 * len(order)))
    ship = passages.sparkSession.sparkContext.broadcast(rank)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ship.value
        total, rows = np.zeros((len(rank), len(rank)), np.float32), 0
        for batch in batches:
            scales = (np.frombuffer(x.as_buffer(), np.float32) for x in batch.column("scales"))
            for (words, ends, lasts), scale in zip(_unpacked(batch, len(rank)), scales, strict=True):
                rows += len(scale)
                _paired(rank[words], ends, lasts, scale, wide, total)
        for first in range(0, len(total), step):
            block = total[first : first + step].copy()
            rare = max(first, wide)  # rows from here on are of words outside of the dense block
            block[: rare - first, wide:] = total[wide:, first:rare].T[: len(block)]
            block[rare - first :, wide:] += total[wide:, rare : first + step].T
            columns = [
                pa.array([first // step], pa.int32()),
                pa.array([TaskContext.get().partitionId()], pa.int32()),
                pa.array([rows], pa.int64()),
                pa.array([block.tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "part", "rows", "total"])

    partial = passages.coalesce(tasks).mapInArrow(part, "block int, part int, rows long, total binary")
    return stage(partial.groupBy("block").applyInArrow(_added, "block int, rows long, total binary"))


def _paired_times(sums: DataFrame, order: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, int]:
    """A' A basis for the rows of all passages from the sums of pairs of words, and the number of the rows."""
    step = max(1, PAIRED_BYTES // max(1, 4 * len(order)))
    ship = sums.sparkSession.sparkContext.broadcast((weights[:, None].astype(np.float32) * basis)[order])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ship.value
        for batch in batches:
            found = (np.frombuffer(x.as_buffer(), np.float32).reshape(-1, len(held)) @ held for x in batch.column("total"))
            columns = [batch.column("block"), batch.column("rows"), pa.array([f.tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "rows", "total"])

    total, rows = np.zeros(basis.shape, np.float32), 0
    for r in sums.mapInArrow(multiply, sums.schema).collect():
        words, rows = order[r["block"] * step : (r["block"] + 1) * step], r["rows"]
        total[words] = np.frombuffer(r["total"], np.float32).reshape(-1, basis.shape[1])
    ship.destroy()
    return total * weights[:, None].astype(np.float32), rows


def _added(block: pa.Table) -> pa.Table:
    """The sum of all tasks' products for one block of words, in the order of the tasks."""
    block = block.sort_by("part")
    total = sum(np.frombuffer(t.as_buffer(), np.float32) for t in block.column("total"))
    rows = sum(block.column("rows").to_pylist())
    columns = [pa.array([block.column("block")[0].as_py()], pa.int32()), pa.array([rows], pa.int64())]
    return pa.Table.from_arrays([*columns, pa.array([total.tobytes()], pa.binary())], ["block", "rows", "total"])


def _decompose(passages: DataFrame, items: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of the items' and the passages' rows."""
    context = passages.sparkSession.sparkContext
    tasks = context.defaultParallelism  # each has a product of its own to hand on
    often = np.bincount(items[0], minlength=len(weights)) * (weights > 0)
    order = np.argsort(-often, kind="stable")
    dense = np.full(len(weights), -1)
    dense[order[:FIT_DENSE]] = np.arange(len(order[:FIT_DENSE]))
    width = min(RANK + MORE, len(weights))
    basis = np.linalg.qr(np.random.default_rng(5).normal(size=(len(weights), width)))[0].astype(np.float32)

    sums = _pair_sums(passages, order, tasks) if len(weights) <= MOST_PAIRED else None

    def over_passages(basis: np.ndarray) -> tuple[np.ndarray, int]:
        ship = context.broadcast((weights[:, None].astype(np.float32) * basis, weights, dense))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, word_weights, dense = ship.value
            total, rows = np.zeros(held.shape, np.float32), 0
            for batch in batches:
                scales = (np.frombuffer(x.as_buffer(), np.float32) for x in batch.column("scales"))
                for unpacked, scale in zip(_unpacked(batch, len(word_weights)), scales, strict=True):
                    rows += len(scale)
                    _passage_product(*unpacked, scale, held, dense, total)
            total *= word_weights[:, None].astype(np.float32)
            blocks = range(0, len(total), WORD_BLOCK)
            columns = [
                pa.array([b // WORD_BLOCK for b in blocks], pa.int32()),
                pa.array([TaskContext.get().partitionId()] * len(blocks), pa.int32()),
                pa.array([rows] * len(blocks), pa.int64()),
                pa.array([total[b : b + WORD_BLOCK].tobytes() for b in blocks], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "part", "rows", "total"])

        partial = passages.coalesce(tasks).mapInArrow(part, "block int, part int, rows long, total binary")
        found = partial.groupBy("block").applyInArrow(_added, "block int, rows long, total binary").collect()
        ship.destroy()
        total, rows = np.zeros(basis.shape, np.float32), 0
        for r in found:
            at, rows = r["block"] * WORD_BLOCK, r["rows"]
            total[at : at + WORD_BLOCK] = np.frombuffer(r["total"], np.float32).reshape(-1, basis.shape[1])
        return total, rows

    def times(basis: np.ndarray) -> np.ndarray:
        total, rows = over_passages(basis) if sums is None else _paired_times(sums, order, weights, basis)
        share = max(1, rows) / max(1, len(items[1]))
        return total + share * _product(*items, weights, basis)

    for _ in range(PASSES):
        basis = np.linalg.qr(times(basis).astype(np.float64))[0].astype(np.float32)
    values, turn = np.linalg.eigh((basis.T @ times(basis)).astype(np.float64))
    return basis @ turn[:, np.argsort(-values)[:RANK]]


def word_places(words: list[bytes]) -> dict[bytes, int]:
    places: dict[bytes, int] = {}
    for i, w in enumerate(words):
        places[w] = places.get(w, 0) | (1 << i)
    return places


def common_subsequence(places: dict[bytes, int], length: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence with ``length`` words at ``places``: one big integer, a bit for each."""
    every = (1 << length) - 1
    open_ = every
    for w in words:
        if w in places and (match := open_ & places[w]):
            open_ = ((open_ + match) | (open_ - match)) & every
    return length - open_.bit_count()


def is_leak(item: list[bytes], places: dict[bytes, int], answer: list[bytes], passage: list[bytes]) -> tuple[bool, float]:
    """Whether the passage has the item, or a paraphrase of it with its answer; the share of words in order."""
    here = set(passage)
    if sum(w in here for w in item) < PARAPHRASE * len(item):  # no subsequence is longer
        return False, 0.0
    share = common_subsequence(places, len(item), passage) / len(item)
    if share >= SAME:
        return True, share
    if share >= PARAPHRASE and answer:
        there = sum((Counter(answer) & Counter(passage)).values())
        return there >= ANSWER * len(answer), share
    return False, share


def candidates(split: list[list[bytes]], index: Index) -> Iterator[tuple[int, int, int]]:
    """Document, first chunk of the window and item of all windows that may have the item.

    By the space for the items that it keeps, and by shared words, which misses none, for the others.
    """
    lengths = np.array([len(s) for s in split])
    chunks = -(-lengths // CHUNK)
    if not chunks.sum() or not index.items:
        return
    found = map(index.vocabulary.get, chain.from_iterable(split), repeat(-1))
    word = np.fromiter(found, np.int64, lengths.sum())
    place = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if len(index.queries):
        yield from _near(lengths, word, place // CHUNK, index)
    for shared in index.shared:
        yield from _sharing(lengths, word, place // CHUNK, shared)


def _sharing(
    lengths: np.ndarray, word: np.ndarray, chunk: np.ndarray, shared: Shared
) -> Iterator[tuple[int, int, int]]:
    """All windows with at least as many of an item's words as a leak of it has.

    Windows lie on a grid of chunks, those of long items at steps of an eighth of the window. Words and items that have
    them are paired for stretches of chunks, so no batch holds more than some ``PAIRS`` or three windows at once.
    """
    chunks, widest = -(-lengths // CHUNK), int(shared.sizes.max())
    first = np.cumsum(chunks + widest) - chunks  # documents lie a window apart, so no window has words of two
    at = np.repeat(first, lengths) + chunk
    known = np.flatnonzero(word >= 0)
    known = known[shared.begins[word[known] + 1] > shared.begins[word[known]]]
    at, word = at[known], word[known]
    many = shared.begins[word + 1] - shared.begins[word]
    pairs = np.cumsum(many)
    begin = 0
    while begin < len(at):
        low = int(at[begin])
        full = min(int(np.searchsorted(pairs, pairs[begin] + PAIRS)), len(at) - 1)
        high = max(int(at[full]), low + widest)  # this stretch has the windows whose first word is in low..high-1
        a, b = np.searchsorted(at, [low - widest, high + widest])
        begin = int(np.searchsorted(at, high))
        n = many[a:b]
        pair = np.arange(n.sum()) + np.repeat(shared.begins[word[a:b]] - (np.cumsum(n) - n), n)
        base, span = low - widest, high - low + 3 * widest
        keys, counts = np.unique(shared.owners[pair] * span + np.repeat(at[a:b], n) - base, return_counts=True)
        sums = np.concatenate([[0], np.cumsum(counts)])

        def enough(start: np.ndarray, item: np.ndarray, keys=keys, sums=sums) -> np.ndarray:
            ends = np.searchsorted(keys, start + shared.sizes[item])
            return sums[ends] - sums[np.searchsorted(keys, start)] >= shared.least[item]

        item, place = keys // span, keys % span + base
        ok = (place >= low) & (place < high) & enough(keys, item)
        item, place = item[ok], place[ok]
        doc = np.searchsorted(first, place, side="right") - 1
        place -= first[doc]
        size, step = shared.sizes[item], shared.steps[item]
        back = size // step + 1
        which = np.repeat(np.arange(len(item)), back)
        start = (place // step)[which] - (np.arange(len(which)) - np.repeat(np.cumsum(back) - back, back))
        start *= step[which]
        ok = (start >= 0) & (start > (place - size)[which])
        which, start = which[ok], start[ok]
        ok = enough(item[which] * span + first[doc[which]] + start - base, item[which])
        found = np.stack([doc[which], start, shared.items[item[which]]], axis=1)[ok]
        yield from map(tuple, np.unique(found, axis=0).tolist())


def _near(lengths: np.ndarray, word: np.ndarray, chunk: np.ndarray, index: Index) -> Iterator[tuple[int, int, int]]:
    """The windows of all passages that are near a passage of an item.

    Passages that lie on one diagonal, as those of a copy do, have the same window, which comes once.
    """
    chunks = -(-lengths // CHUNK)
    first = np.cumsum(chunks) - chunks
    chunk = np.repeat(first, lengths) + chunk
    known = chunk[word >= 0], word[word >= 0]
    square = np.bincount(chunk, np.where(word >= 0, index.weights[word], index.unknown) ** 2, minlength=chunks.sum())
    chunk, word = chunk[word >= 0], word[word >= 0]
    # Words that most documents have are counted and multiplied as a block, the others' rows are added up.
    column = np.full(len(index.weights), -1)
    column[index.frequent] = np.arange(len(index.frequent))
    at = column[word]
    dense = np.bincount(chunk[at >= 0] * len(index.frequent) + at[at >= 0], minlength=chunks.sum() * len(index.frequent))
    latent = dense.reshape(-1, len(index.frequent)).astype(np.float32) @ index.space[index.frequent]
    chunk, word = chunk[at < 0], word[at < 0]
    if len(word):
        begins = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        latent[chunk[begins]] += np.add.reduceat(index.space[word], begins, axis=0)
    doc = np.repeat(np.arange(len(lengths)), chunks)
    joins = np.append(doc[1:] == doc[:-1], False)
    latent[joins] += latent[np.flatnonzero(joins) + 1]
    square[joins] += square[np.flatnonzero(joins) + 1]
    latent /= np.maximum(np.sqrt(square), 1e-12)[:, None].astype(np.float32)
    before, size = np.array([window_chunks(len(item)) for item in index.items], np.int64).T
    for block in range(0, len(index.queries), ITEM_BLOCK):
        at, piece = np.nonzero(latent @ index.queries[block : block + ITEM_BLOCK].T >= LEAST_COSINE)
        item = index.owners[block + piece]
        start = at - first[doc[at]] - index.offsets[block + piece] - before[item]
        low, high = np.maximum(start, 0), np.minimum(start + size[item], chunks[doc[at]])
        some = _enough(first[doc[at]] + low, first[doc[at]] + high, item, *known, index)
        found = np.unique(np.stack([doc[at], start, item], axis=1)[some], axis=0)
        yield from map(tuple, found.tolist())


def _enough(
    low: np.ndarray, high: np.ndarray, item: np.ndarray, chunk: np.ndarray, word: np.ndarray, index: Index
) -> np.ndarray:
    """Whether the chunks ``low`` to ``high`` have as many words of the item as a leak must, as ``is_leak`` counts them.

    ``chunk`` and ``word`` are the known words, by chunk. Windows are taken by stretches of ``PRESENT`` cells; those
    that are longer than ``LONGEST`` chunks are not counted.
    """
    needed = PARAPHRASE * np.add.reduceat(index.times, index.begins[:-1])
    out = high - low > LONGEST
    left = np.flatnonzero((high > low) & ~out)
    left = left[np.lexsort((high[left], low[left]))]
    step = max(1, PRESENT // len(index.weights) - LONGEST)
    at = 0
    while at < len(left):
        base = int(low[left[at]])
        end = int(np.searchsorted(low[left], base + step))
        mine, at = left[at:end], end
        a, b = np.searchsorted(chunk, [base, high[mine].max()])
        has = np.zeros((high[mine].max() - base, len(index.weights)), bool)
        has[chunk[a:b] - base, word[a:b]] = True
        length = high[mine] - low[mine]
        for n in np.unique(length).tolist():
            some = mine[length == n]
            starts, row = np.unique(low[some] - base, return_inverse=True)
            window = has[starts]
            for k in range(1, n):
                window |= has[starts + k]
            many = index.begins[item[some] + 1] - index.begins[item[some]]
            pairs = np.cumsum(many)
            cuts = np.searchsorted(pairs, np.arange(PAIRS, pairs[-1] + PAIRS, PAIRS), side="right")
            for i, j in zip([0, *cuts[:-1]], cuts, strict=True):
                if i < j:
                    own, m = some[i:j], many[i:j]
                    pair = np.arange(m.sum()) + np.repeat(index.begins[item[own]] - (np.cumsum(m) - m), m)
                    found = window[np.repeat(row[i:j], m), index.words[pair]] * index.times[pair]
                    out[own] = np.add.reduceat(found, np.cumsum(m) - m) >= needed[item[own]]
    return out


def flag(docs: DataFrame, index: Index) -> DataFrame:
    """``docs`` with contaminated, item_id and overlap: the item that most words of follow in order, and their share.

    Every whole text is cut into overlapping passages of 64 words, and so are items that are longer. A passage is
    folded into the latent space, compared by cosine to all passages of items in blocks, and where it is near one, a
    window is checked that has room for the whole item where the passage puts it and for half its length on either
    side, 128 words at least: the longest common subsequence with the item, and for paraphrases the answer's words.
    Items that the space keeps poorly, as it does when they are many, are found by the words that a leak must share
    with them, which misses no window. Rows stay in their tasks; items and the space (a bounded list) are broadcast. NULL, empty and blank texts are clean, as is everything if there are
    no items; item_id and overlap are NULL for clean rows; equal overlaps give the smallest item. Columns of these
    names are replaced; repeated rows stay; an empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("contaminated", "item_id", "overlap")
    ship = docs.sparkSession.sparkContext.broadcast(index)
    place = docs.columns.index("text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ship.value
        for batch in batches:
            split = [tokens(text.as_py()) for text in batch.column(place)]
            best: list[tuple[float, int] | None] = [None] * len(split)
            for doc, start, item in candidates(split, index):
                end = start + window_chunks(len(index.items[item]))[1]
                passage = split[doc][max(0, start) * CHUNK : end * CHUNK]
                leak, share = is_leak(index.items[item], index.places[item], index.answers[item], passage)
                if leak and (best[doc] is None or (-share, item) < (-best[doc][0], best[doc][1])):
                    best[doc] = share, item
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([b is not None for b in best], pa.bool_()),
                    pa.array([b and index.ids[b[1]] for b in best], to_arrow_type(index.id_type)),
                    pa.array([b and b[0] for b in best], pa.float64()),
                ],
                [*batch.schema.names, "contaminated", "item_id", "overlap"],
            )

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    return docs.mapInArrow(check, f"{kinds}, contaminated boolean, item_id {index.id_type.simpleString()}, overlap double")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_id, overlap for every row of ``docs``, as ``fit`` and ``flag`` say."""
    return flag(docs.select("doc_id", "text"), fit(docs, benchmark)).drop("text")
