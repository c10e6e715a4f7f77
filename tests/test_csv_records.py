"""CSV files with quoted line ends, cut into blocks."""

import csv
import io
import random
import tempfile
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioworks.session import settings as session_settings
from folioworks.sources import csv_records


def _cells(rng, n):
    parts = ["plain", 'say "x"', "a,b", "two\nlines", "win\r\nend", "\n\n", '"', "é – ü", "x" * 40]
    return [[" ".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(3)] for _ in range(n)]


def _write(path, rows, end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows([["one", "two", "three"], *rows])
    Path(path).write_text(out.getvalue(), newline="")


@pytest.mark.parametrize("bound", [100_000, 0])
def test_one_file_is_read_by_several_tasks(spark, monkeypatch, bound):
    monkeypatch.setattr(csv_records, "BROADCAST_BLOCKS", bound)
    rng, folder = random.Random(3), tempfile.mkdtemp(prefix="run-")
    first, second = _cells(rng, 400), _cells(rng, 30)
    first[200][1] = "long\n" * 3000  # some blocks lie within one field
    _write(f"{folder}/a.csv", first)
    _write(f"{folder}/b.csv", second, "\r\n")
    with session_settings(spark, {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "0"}):
        assert csv_records._lines(spark, folder).rdd.getNumPartitions() > 8
        df, counts = csv_records.read_csv(spark, folder)
        got = sorted((r["_file"][-5:], r["_record"], [r["one"], r["two"], r["three"]]) for r in df.collect())
        sizes = {r["_file"][-5:]: r["_n"] for r in counts.collect()}
    assert sizes == {"a.csv": 400, "b.csv": 30}
    assert got == [(f, i, row) for f, rows in (("a.csv", first), ("b.csv", second)) for i, row in enumerate(rows)]


def test_edges_of_files(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    Path(folder, "a.csv").write_text('﻿"one","two"\n\n1,5" pipe\n\n"",x\n3\n"open,\nrest', encoding="utf-8")
    Path(folder, "b.csv").write_text("one,two\n")
    Path(folder, "c.csv").write_text("")
    df, counts = csv_records.read_csv(spark, folder)
    rows = sorted((r["_record"], r["one"], r["two"]) for r in df.collect())
    assert rows[:3] == [(0, "1", '5" pipe'), (1, None, "x"), (2, "3", None)]
    assert rows[3][0] == 3 and "rest" in rows[3][1] and len(rows) == 4
    assert sorted(r["_n"] for r in counts.collect()) == [0, 4]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='a",\n', max_size=8), min_size=2, max_size=3), min_size=1, max_size=4))
def test_states_of_lines(rows):
    """Line ends are outside of quoted fields just where a record ends."""
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL)
    ends = []
    for row in rows:
        writer.writerow(row)
        ends.append(out.getvalue().count("\n") - 1)
    inside, found = False, []
    for i, line in enumerate(out.getvalue().split("\n")[:-1]):
        inside = csv_records.line_end(line, inside)
        found += [] if inside else [i]
    assert found == ends
