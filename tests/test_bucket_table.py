"""Upserts into a bucketed table: what is moved, what is rewritten, what stays."""

import io
import os
import tempfile
import uuid
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from folioworks.operators.bucket_table import BucketTable
from folioworks.streaming import ingest

ROWS = "index_type string, id long, text string, seq long"


@pytest.fixture
def kept(spark):
    name = uuid.uuid4().hex
    table = BucketTable(f"t_{name}", f"{tempfile.mkdtemp(prefix='run-')}/table", 8, "seq")
    rows = [(f"b{i % 3}", i, f"old {i}", None) for i in range(300)]
    return table.create(spark.createDataFrame(rows, ROWS).repartition(5))


def rows_of(spark, table):
    return {(r["index_type"], r["id"]): (r["text"], r["seq"]) for r in table.read(spark).collect()}


def files(table):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(table.path)
        for f in names
        if f.endswith(".parquet")
    }


def test_upsert_equals_a_loop(spark, kept):
    want = {(f"b{i % 3}", i): (f"old {i}", None) for i in range(300)}
    assert rows_of(spark, kept) == want and len(files(kept)) == 8
    batches = [
        [("b0", 0, "new", 5), ("b0", 0, "newer", 6), ("b9", 1, None, 1), ("b1", 7, "tie", 2)],
        [("b0", 0, "late", 4), ("b1", 7, "other", 2), ("b9", 1, "x", 0)],
        [(f"b{i % 3}", i, f"all {i}", 10) for i in range(0, 400, 7)],
    ]
    for batch in batches:
        df = spark.createDataFrame(batch, ROWS).repartition(3)
        for _ in range(2):  # the second time changes nothing
            kept.upsert(df)
        for b, i, t, s in batch:
            old = want.get((b, i))
            if old is None or old[1] is None or s >= old[1]:
                want[b, i] = (t, s)
        assert rows_of(spark, kept) == want
    assert len(files(kept)) == 8


def test_only_touched_buckets_are_rewritten(spark, kept):
    before = files(kept)
    one = spark.createDataFrame([("b1", 100, "new", 1)], ROWS)
    (bucket,) = kept.upsert(one)
    after = files(kept)
    changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert changed and all(f"_bucket={bucket}/" in f for f in changed)
    assert kept.upsert(one.where("false")) == [] and files(kept) == after


def test_the_stored_side_is_not_exchanged(spark, kept):
    incoming = spark.createDataFrame([("b1", i, "new", 1) for i in range(50)], ROWS)
    plan = kept.merged(incoming, kept.touched(incoming))
    out = io.StringIO()
    with redirect_stdout(out):
        plan.explain("simple")
    lines = out.getvalue().split("\n")
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
    assert "Bucketed: true" in lines[scan] and "PartitionFilters: [_bucket" in lines[scan]
    depth = lines[scan].index("FileScan")
    above, exchanges = depth, [line for line in lines if "Exchange" in line]
    for line in reversed(lines[:scan]):  # the scan's own ancestors: ever less deep
        at = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if at < above:
            above = at
            assert "Exchange" not in line
    assert len(exchanges) == 1


def test_extra_and_missing_columns_and_keys(spark, kept):
    df = spark.createDataFrame([("b0", 3, 7, "x"), ("b8", 9, 7, "x")], "index_type string, id long, seq long, _stored string")
    kept.upsert(df)
    got = rows_of(spark, kept)
    assert got["b0", 3] == ("old 3", 7) and got["b8", 9] == (None, 7) and len(got) == 301
    with pytest.raises(Exception, match="without a key"):
        kept.upsert(spark.createDataFrame([(None, 3, "x", 1)], ROWS))


def test_another_session_opens_the_files(spark, kept):
    want = rows_of(spark, kept)
    again = BucketTable("again_" + uuid.uuid4().hex, kept.path, 8, "seq").open(spark, ROWS)
    assert rows_of(spark, again) == want
    again.upsert(spark.createDataFrame([("b0", 0, "new", 5)], ROWS))
    want["b0", 0] = ("new", 5)
    assert rows_of(spark, again) == want


def test_batches_are_compacted(spark):
    path = tempfile.mkdtemp(prefix="run-")
    table = BucketTable(f"c_{uuid.uuid4().hex}", f"{path}/table", 4, "seq", ("k",))

    def batch(n, rows):
        spark.createDataFrame(rows, "k int, v string, at int").write.parquet(f"{path}/store/batch={n}")

    def now():
        return {r["k"]: r["v"] for r in ingest.read_compacted(spark, f"{path}/store", table, "at").collect()}

    batch(0, [(1, "a", 1), (1, "b", 2), (2, "c", 1)])
    assert now() == {1: "b", 2: "c"}
    assert ingest.compact_batches(spark, f"{path}/store", table, "at") == 0
    batch(1, [(2, "d", 0), (3, "e", 0)])
    assert now() == {1: "b", 2: "d", 3: "e"}
    assert ingest.compact_batches(spark, f"{path}/store", table, "at") == 1
    assert ingest.compact_batches(spark, f"{path}/store", table, "at") == 1
    assert now() == {1: "b", 2: "d", 3: "e"} and table.read(spark).count() == 3
    assert table.read(spark).where(F.col("seq.batch") == 1).count() == 2
