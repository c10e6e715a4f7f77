"""Shards of near equal size by a histogram sort."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks.llm.shared import stage, text_bytes

#: A key has 48 hexadecimal digits, and a round of probes resolves so many of them: 256 cells in every open cell.
DIGITS, STEP, TEXT_DIGITS = 48, 2, 16


def sort_key(text: Column, doc_id: Column) -> Column:
    """Hashes of the text, of the row and of its place: copies of a text are neighbours, and the id parts them.

    The place parts rows that are equal in text and id. It is stable only in a staged table.
    """
    place = F.xxhash64(F.monotonically_increasing_id())
    hashes = F.xxhash64(F.coalesce(text, F.lit(""))), F.xxhash64(doc_id, text), place
    return F.concat(*(F.lpad(F.hex(h), 16, "0") for h in hashes))


def shard(
    docs: DataFrame, shards: int, tolerance: float = 0.002, group_tolerance: float = 0.02, slice_rows: int = 4_000_000
) -> DataFrame:
    """Put all rows into ``shards`` ranges of a key whose byte totals are near equal, and number them there.

    Rows are ordered by (hash of the text, hash of the id), so copies of a text are neighbours. Splitters are found by
    counting: each round sums the exact bytes of all rows below the edges of 256 cells, on the tasks first; the cell
    that a splitter falls into is probed more finely in the next round, until an edge is within ``tolerance`` of a
    shard's bytes. Once a cell is down to the copies of one text, its nearer end serves if it is within
    ``group_tolerance``, so copies stay together; a larger group is parted by the second hash, so that a text that
    fills a third of the table is spread over shards, and so are equal rows, which the third hash parts. Each shard is
    cut by further splitters into slices of some ``slice_rows`` rows, at least four, so that the one exchange never
    brings a whole shard to one task. Those splitters count bytes; where rows are counted that are many more (empty
    texts), a second search by rows cuts them.

    Keys and sizes are staged in the shared folder, since every round reads them. The driver sees cell totals only:
    256 for each splitter that is still open.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (from 0, without gaps, in key order) for every
    row. A NULL text has size 1 and checksum 0. Repeated rows and NULL ids stay; an empty table gives an empty table;
    other columns are not read.
    """
    keyed = stage(
        docs.select(
            "doc_id",
            (text_bytes(F.col("text")) + 1).alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            sort_key(F.col("text"), F.col("doc_id")).alias("key"),
        )
    )
    sums = keyed.agg(F.sum("size").alias("n"), F.count("*").alias("rows")).first()
    total, slices = sums["n"] or 0, max(4, -(-sums["rows"] // (shards * slice_rows)))
    ideal = total / shards
    cuts = splitters(keyed, total, shards * slices, ideal * tolerance, ideal * group_tolerance, slices)
    bounds = cuts[slices - 1 :: slices]
    if max(part_rows(keyed, cuts).values(), default=0) > 2 * slice_rows:
        near = slice_rows / 4
        cuts = sorted({*cuts, *splitters(_counted(keyed), sums["rows"], -(-sums["rows"] // slice_rows), near, near, 1)})
    return numbered(keyed, cuts, bounds)


def _counted(keyed: DataFrame) -> DataFrame:
    return keyed.select("key", F.lit(1).cast("long").alias("size"))


def splitters(
    keyed: DataFrame, total: int, parts: int, tolerance: float, group_tolerance: float, slices: int
) -> list[str]:
    """Key prefixes, one between every two parts; a row belongs behind a splitter if its key is not below it."""
    # Open cell (a prefix) -> bytes of all rows below it, and the numbers of the splitters that fall into it.
    open_cells: dict[str, tuple[int, list[int]]] = {"": (0, list(range(1, parts)))} if total else {}
    found = {k: "~" for k in range(1, parts)} if not total else {}
    while open_cells:
        counted = cell_bytes(keyed, list(open_cells))
        following: dict[str, tuple[int, list[int]]] = {}
        for prefix, (below, wanted) in open_cells.items():
            cells, edges = [], [below]
            for cell, n in sorted(counted[prefix].items()):
                cells.append(cell)
                edges.append(edges[-1] + n)
            for k in wanted:
                target = total * k / parts
                at = min(max(bisect_left(edges, target), 1), len(cells)) - 1
                low, high = target - edges[at], edges[at + 1] - target
                # Splitters inside a shard only bound the work of a task, so they need not be as near.
                near = tolerance if k % slices == 0 else 25 * tolerance
                if len(cells[at]) == TEXT_DIGITS:
                    near = max(near, group_tolerance)
                if min(low, high) <= near or len(cells[at]) == DIGITS:
                    found[k] = cells[at] if low <= high else cells[at] + "~"  # "~" is behind all digits
                else:
                    following.setdefault(cells[at], (edges[at], []))[1].append(k)
        open_cells = following
    return [found[k] for k in sorted(found)]


def cell_bytes(keyed: DataFrame, prefixes: list[str]) -> dict[str, dict[str, int]]:
    """Exact bytes of all rows in each cell that is one step finer than the given prefixes of one length."""
    at = len(prefixes[0])
    rows = keyed.where(F.substring("key", 1, at).isin(prefixes)) if at else keyed
    cells = rows.groupBy(F.substring("key", 1, at + STEP).alias("cell")).agg(F.sum("size").alias("n"))
    out: dict[str, dict[str, int]] = defaultdict(dict)
    for r in cells.collect():
        out[r["cell"][:at]][r["cell"]] = r["n"]
    return out


def part_rows(keyed: DataFrame, cuts: list[str]) -> dict[int, int]:
    """Rows between every two cuts."""
    parted = keyed.select("key").mapInArrow(_part(np.array(cuts, _KEY)), "key string, part int")
    return {r["part"]: r["count"] for r in parted.groupBy("part").count().collect()}


def numbered(keyed: DataFrame, cuts: list[str], bounds: list[str]) -> DataFrame:
    """Shard and slot of every row: its slice's first slot plus its rank in the slice.

    ``bounds`` are those of the cuts that part shards.
    """
    kind = dict(keyed.dtypes)["doc_id"]
    parted = keyed.mapInArrow(
        _part(np.array(cuts, _KEY)), f"doc_id {kind}, size long, text_crc32 long, key string, part int"
    )
    counts = part_rows(keyed, cuts)
    shard, first, starts = 0, 0, []
    for part in range(len(cuts) + 1):
        here = bisect_right(bounds, cuts[part - 1]) if part else 0
        first, shard = (first, shard) if here == shard else (0, here)
        starts.append((part, shard, first))
        first += counts.get(part, 0)
    starts = keyed.sparkSession.createDataFrame(starts, "part int, shard int, first long")  # one row per slice
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key", "doc_id"))
    return parted.withColumn("rank", rank).join(F.broadcast(starts), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("first") + F.col("rank") - 1).alias("slot"),
    )


_KEY = f"S{DIGITS + 1}"  # a cut may have a "~" behind its digits


def _part(cuts: np.ndarray):
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column("key").cast(pa.binary()).to_pylist(), _KEY)
            parts = np.searchsorted(cuts, keys, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts)], [*batch.schema.names, "part"])

    return part
