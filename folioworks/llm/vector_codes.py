"""Short codes for vectors: codebooks of parts, with nearest entries found along a trie."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.shared import stage

#: Vectors whose parts make up one trie, and parts below which a branch is walked level by level rather than by node.
TRIE_ROWS, BRANCH = 32_768, 4_096
#: Components of this size and more would not leave room for sums of squares in 64 bits.
MOST = 1 << 28


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256
) -> tuple[DataFrame, np.ndarray]:
    """Code every vector by the nearest codebook entry of each of its parts.

    Components become whole numbers, floor(``scale`` * x), and vectors are cut into ``parts`` equal consecutive parts.
    A part position's codebook begins as that part of the ``entries`` vectors with the smallest vec_id (vectors in
    ascending order for equal ids, NULL ids last). Each round gives every part to its nearest entry (squared Euclidean
    distance, the lower index for ties) and replaces entries by the floor of their parts' mean; unused ones stay.

    Nearest entries are found along a lexicographic trie over the distinct parts of some 32,768 vectors at a time: its
    depth-first traversal adds up the squared distances to all entries one dimension after the other, so parts with a
    common beginning share them, and its leaves take the least and weigh sums by the number of copies. A round reads the
    staged numbers once and sends one row for each entry and task; codebooks (parts x entries x dimensions) are all that
    the driver sees, and no vector is ever exchanged.

    Returns the rows (vec_id, label, code: string of two hexadecimal digits a part, error: squared distances summed
    over parts) and the codebooks, an array by part, entry and position. Vectors that are NULL or hold a NULL or
    non-finite component are left out; shorter vectors are filled up with zeros to the longest, and that to a multiple
    of ``parts``. With fewer vectors than entries there are fewer entries. Repeated rows and ids and NULL ids and labels
    stay; an empty table gives an empty table; other columns are not read. A component of 2**28 or more after scaling is
    an error, since squares would leave the range of the results.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index of two hexadecimal digits names at most 256 entries")
    kept = whole_numbers(vectors, scale)
    books = first_entries(kept, parts, entries)
    for _ in range(rounds):
        books = moved(books, entry_sums(kept, books))
    return assign(kept, books), books


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and scaled components of all vectors without gaps, staged in the shared folder."""
    kinds = dict(vectors.dtypes)
    columns = f"vec_id {kinds['vec_id']}, label {kinds['label']}, part array<int>"
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("part"))
    return stage(rows.mapInArrow(_scaler(scale), columns))


def _scaler(scale: int):
    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("part")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # a NULL component is NaN
            rows = np.repeat(np.arange(len(sizes)), sizes)
            odd = ~np.isfinite(values)
            keep = np.asarray(lists.is_valid()) & (np.bincount(rows[odd], minlength=len(sizes)) == 0)
            values = np.floor(scale * values[keep[rows]])
            if len(values) and np.abs(values).max() >= MOST:
                raise ValueError("a component is too large for squared distances in 64 bits")
            ends = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int32)
            numbers = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))
            chosen = pa.array(np.flatnonzero(keep))
            ids, labels = batch.column("vec_id").take(chosen), batch.column("label").take(chosen)
            yield pa.RecordBatch.from_arrays([ids, labels, numbers], ["vec_id", "label", "part"])

    return scaled


def first_entries(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks cut out of the vectors with the smallest ids: parts x entries x dimensions of a part."""
    width = kept.agg(F.max(F.size("part"))).first()[0] or 0
    step = max(1, -(-width // parts))
    order = [F.col("vec_id").asc_nulls_last(), F.col("part").asc()]
    first = [r["part"] for r in kept.select("vec_id", "part").orderBy(*order).limit(entries).collect()]
    rows = np.zeros((len(first), parts * step), np.int64)
    for i, numbers in enumerate(first):
        rows[i, : len(numbers)] = numbers
    return rows.reshape(len(first), parts, step).transpose(1, 0, 2).copy()


def entry_sums(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """Parts of each entry: their sums by position, and behind them their number."""
    parts, entries, step = books.shape
    ship = kept.sparkSession.sparkContext.broadcast(books)
    rows = kept.select("part").mapInArrow(_summer(ship), "part int, entry int, place int, n long")
    out = np.zeros((parts, entries, step + 1), np.int64)
    for r in rows.groupBy("part", "entry", "place").agg(F.sum("n").alias("n")).collect():
        out[r["part"], r["entry"], r["place"]] = r["n"]
    return out


def moved(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries at the floor of their parts' mean; entries without parts stay."""
    number = sums[:, :, -1:]
    return np.where(number > 0, sums[:, :, :-1] // np.maximum(number, 1), books)


def assign(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    ship = kept.sparkSession.sparkContext.broadcast(books)
    kinds = dict(kept.dtypes)
    columns = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    return kept.mapInArrow(_coder(ship), columns)


def with_label_error(coded: DataFrame) -> DataFrame:
    """The rows with label_error, the errors summed over all vectors with the same label (NULLs together).

    Labels are summed on the tasks first, and the staged sums are small beside the rows, so Spark can broadcast them or
    split the rows of a label that a third of them has.
    """
    coded = stage(coded)
    sums = stage(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= TRIE_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    sizes = pc.list_value_length(lists).to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    places = np.arange(len(rows)) - np.repeat(ends - sizes, sizes)
    out[rows, places] = pc.list_flatten(lists).to_numpy()
    return out


def _summer(ship):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = ship.value
        parts, entries, step = books.shape
        sums = np.zeros((parts, entries, step + 1), np.int64)
        for block in _blocks(batches):
            vectors = _matrix(block.column("part"), parts * step)
            for p in range(parts):
                rows, _, copies = distinct(vectors[:, p * step : (p + 1) * step])
                entry, _ = nearest(rows, books[p])
                np.add.at(sums[p], entry, np.column_stack([rows, np.ones(len(rows), np.int64)]) * copies[:, None])
        part, entry = np.nonzero(sums[:, :, -1])
        places = np.arange(step + 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(part, step + 1).astype(np.int32)),
                pa.array(np.repeat(entry, step + 1).astype(np.int32)),
                pa.array(np.tile(places, len(part)).astype(np.int32)),
                pa.array(sums[part, entry].ravel()),
            ],
            ["part", "entry", "place", "n"],
        )

    return summed


def _coder(ship):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = ship.value
        parts, _, step = books.shape
        for block in _blocks(batches):
            vectors = _matrix(block.column("part"), parts * step)
            code, error = np.zeros((len(vectors), parts), np.uint8), np.zeros(len(vectors), np.int64)
            for p in range(parts):
                rows, place, _ = distinct(vectors[:, p * step : (p + 1) * step])
                entry, distance = nearest(rows, books[p])
                code[:, p] = entry[place]
                error += distance[place]
            digits = code.tobytes().hex()
            codes = [digits[at : at + 2 * parts] for at in range(0, len(digits), 2 * parts)]
            table = block.select(["vec_id", "label"]).append_column("code", pa.array(codes, pa.string()))
            yield from table.append_column("error", pa.array(error)).combine_chunks().to_batches()

    return coded


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, the place of each row among them, and the number of copies."""
    order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return ordered[first], place, np.diff(np.append(first, len(rows)))


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance for distinct rows in lexicographic order.

    The rows are the leaves of a trie, a dimension a level. The traversal is depth-first: a node passes its distances to
    all entries, summed up over the dimensions above it, on to its children. A branch of few leaves is walked level by
    level at once, so what is held is one vector of distances for each open node and one small branch.
    """
    entry, distance = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    open_nodes = [(0, len(rows), 0, np.zeros(len(book), np.int64))]
    while open_nodes:
        low, high, depth, summed = open_nodes.pop()
        if high - low <= BRANCH or depth == rows.shape[1]:
            entry[low:high], distance[low:high] = _branch(rows[low:high], depth, summed, book)
            continue
        values = rows[low:high, depth]
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), high - low]
        for start, end in zip(edges[-2::-1], edges[:0:-1], strict=True):  # the first child is on top
            child = summed + (values[start] - book[:, depth]) ** 2
            open_nodes.append((low + start, low + end, depth + 1, child))
    return entry, distance


def _branch(rows: np.ndarray, depth: int, summed: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held = summed[None, :]
    node = np.zeros(len(rows), np.int64)  # of each leaf, at the level reached
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for d in range(depth, rows.shape[1]):
        new[1:] |= rows[1:, d] != rows[:-1, d]
        first = np.flatnonzero(new)
        held = held[node[first]] + (rows[first, d][:, None] - book[:, d][None, :]) ** 2
        node = np.cumsum(new) - 1
    least = held.argmin(axis=1)
    return least[node], held[np.arange(len(held)), least][node]
