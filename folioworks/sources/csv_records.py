"""CSV files with quoted line ends, read by byte ranges: several tasks share one file.

Spark's text scan cuts a file into blocks at line ends. Whether a line end closes a record depends on the quotes of all
lines before it, so every block is summed up as a map from the state that it begins in (outside or inside a quoted
field) to the state that it ends in, with the records that begin in it in either case. The maps of a file's blocks are
composed in order, one row a block; then every block knows its state and the number of its first record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.session import cut_lineage

#: Blocks up to this many are broadcast with their state (some 100 bytes each); beyond it they join by sorting.
BROADCAST_BLOCKS = 100_000
#: Lines in an output batch.
BATCH = 1000

_FIELD = r'(?:"(?:[^"]|"")*+"(?!")[^,]*+|(?!")[^,]*+)'
_COMPLETE = re.compile(rf"(?:{_FIELD},)*+{_FIELD}")
_CLOSING = re.compile(r'(?:[^"]|"")*+"(?!")[^,]*+')

_READ = {"sep": ",", "quote": '"', "escape": '"', "multiLine": "true"}


def line_end(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that begins outside or inside of one.

    A quote opens a field only as its first character; two quotes in a quoted field are one that is meant.
    """
    if '"' not in line:
        return inside
    at = 0
    if inside:
        closed = _CLOSING.match(line)
        if closed is None:
            return True
        if closed.end() == len(line):
            return False
        at = closed.end() + 1
    return _COMPLETE.fullmatch(line, at) is None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, block and order. The cut into blocks is the same for every scan of the session.

    It depends on the number of cores unless a smallest number of partitions is set, and executors may come and go.
    """
    pinned = "spark.sql.files.minPartitionNum"
    if spark.conf.get(pinned, None) is None:
        spark.conf.set(pinned, str(spark.sparkContext.defaultParallelism))
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
    )


def _text(line: str, block: int, first: bool) -> str:
    return line.lstrip("﻿") if first and block == 0 else line


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every block: the states it ends in, and the records that begin in it, by the state it begins in."""
    names = ["_file", "_block", "ends_outside", "ends_inside", "begins_outside", "begins_inside"]
    here, state, begins = None, [False, True], [0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*here, *state, *begins)], names)

    for batch in batches:
        for file, block, line in zip(*(batch.column(c).to_pylist() for c in ("_file", "_block", "value")), strict=True):
            first = here != (file, block)
            if first:
                if here is not None:
                    yield row()
                here, state, begins = (file, block), [False, True], [0, 0]
            line = _text(line, block, first)
            for case in (0, 1):
                begins[case] += not state[case] and line not in ("", "\r")
                state[case] = line_end(line, state[case])
    if here is not None:
        yield row()


def _carried(blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a file in order: the state each begins and ends in, and the records that begin before it."""
    inside, before, out = False, 0, []
    for b in blocks.sort_values("_block").itertuples(index=False, name=None):
        file, block, ends, begins = b[0], b[1], b[2:4], b[4:6]
        out.append((file, block, inside, ends[inside], before, begins[inside]))
        inside, before = bool(ends[inside]), before + int(begins[inside])
    return pd.DataFrame(out, columns=["_file", "_block", "_inside", "_open", "_before", "_begins"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of every block; ``_part`` where a record began in an earlier block or ends in a later one."""
    names = ["_file", "_block", "_record", "_part", "value"]
    out: list[tuple] = []
    here, inside, number, held, part = None, False, 0, None, False

    def flush(open_: bool) -> None:
        nonlocal held, part
        if held is not None:
            out.append((*here, number, part or open_, "\n".join(held)))
        held, part = None, False

    def rows() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ([] for _ in names)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        out.clear()
        return made

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("_file", "_block", "_inside", "_before", "value"))
        for file, block, begins_inside, before, line in zip(*columns, strict=True):
            first = here != (file, block)
            if first:
                if before is None:
                    raise ValueError("files or the size of their splits changed during the scan")
                if here is not None:
                    flush(inside)
                here, inside, number = (file, block), begins_inside, before - 1
                held, part = ([], True) if inside else (None, False)
            line = _text(line, block, first)
            if not inside:
                flush(False)
                if line in ("", "\r"):
                    continue
                held, number = [], number + 1
            held.append(line)
            inside = line_end(line, inside)
            if len(out) >= BATCH:
                yield rows()
    if here is not None:
        flush(inside)
    yield rows()


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All columns as text with ``_file`` and ``_record`` (from 0 in each file), and (``_file``, ``_n`` records).

    Every file has a header, whose names are those of the first one; blank lines are no records. Lines don't move: a
    record that ends in a later block than it began is put together from its parts, all others come from one scan.
    A short row is filled up with NULL, an empty field is NULL, a quote that never closes takes the rest of its file.
    """
    reader = spark.read.option("header", "true").option("encoding", "UTF-8").options(**_READ)
    header = reader.csv(path).columns
    lines = _lines(spark, path)
    kinds = "_file string, _block long, ends_outside boolean, ends_inside boolean, begins_outside long, begins_inside long"
    carried = "_file string, _block long, _inside boolean, _open boolean, _before long, _begins long"
    blocks = cut_lineage(lines.mapInArrow(_sum_up, kinds).groupBy("_file").applyInPandas(_carried, carried))
    starts = blocks.select("_file", "_block", "_inside", "_open", "_before")

    small = blocks.count() <= BROADCAST_BLOCKS

    def records(some: DataFrame, how: str) -> DataFrame:
        met = lines.join(F.broadcast(some) if small else some.hint("merge"), ["_file", "_block"], how)
        met = met if small else met.sortWithinPartitions("_file", "_block", "_at")
        met = met.select("_file", "_block", "_inside", "_before", "value")
        return met.mapInArrow(_records, "_file string, _block long, _record long, _part boolean, value string")

    whole = records(starts, "left").where(~F.col("_part")).select("_file", "_record", "value")
    cut = starts.where("_inside OR _open")
    if not cut.isEmpty():
        pieces = F.array_sort(F.collect_list(F.struct("_block", "value")))
        joined = F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("value")
        parts = records(cut, "inner").where("_part").groupBy("_file", "_record").agg(joined)
        whole = whole.unionByName(parts)
    row = ", ".join(f"c{i} string" for i in range(len(header)))
    parsed = F.from_csv(F.regexp_replace("value", "\r$", ""), row, _READ)
    out = whole.where("_record > 0").select("_file", (F.col("_record") - 1).alias("_record"), parsed.alias("_row"))
    named = [F.col(f"_row.c{i}").alias(c.lstrip("﻿").strip()) for i, c in enumerate(header)]
    counts = blocks.groupBy("_file").agg(F.greatest(F.sum("_begins") - 1, F.lit(0)).alias("_n"))
    return out.select(*named, "_file", "_record"), counts
