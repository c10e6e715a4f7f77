"""Dense positions, and image bytes that are fetched last."""

import io
import os
import tempfile
from contextlib import redirect_stdout
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioworks.operators import images as im
from folioworks.operators.scan import with_positions
from folioworks.sources import files


def test_positions_are_dense(spark):
    rows = [(f"p{i % 37}" if i % 50 else None, i % 11, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "path string, page int, i int").repartition(6)
    got = sorted((r["position"], r["path"], r["page"]) for r in with_positions(df, ["path", "page"]).collect())
    assert [p for p, _, _ in got] == list(range(2000))
    assert [(x or "", y) for _, x, y in got] == sorted((x or "", y) for x, y, _ in rows)
    assert with_positions(df.where("false"), ["path"]).count() == 0


def test_files_are_numbered_by_path(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    names = ["b/2.md", "a/10.md", "a/9.md", "c.md"]
    for n in names:
        os.makedirs(os.path.dirname(f"{folder}/{n}"), exist_ok=True)
        Path(folder, n).write_text(n)
    got = files.ordered_files(files.read_markdown(spark, folder)).collect()
    assert [r["text"] for r in sorted(got, key=lambda r: r["position"])] == sorted(names)


def answers(spark):
    found = [(q, at, (q * 7 + at) % 40) for q in range(30) for at in range(6)]
    stored = [(i, None if i % 9 == 0 else i * 100, f"{i}.png", bytes([i]) * 50) for i in range(35)]
    return (
        spark.createDataFrame(found, "q int, at int, image int"),
        spark.createDataFrame(stored, "id int, byte_size int, name string, data binary"),
    )


@pytest.mark.parametrize("bound", [200_000, 3])
def test_bytes_are_fetched_last(spark, monkeypatch, bound):
    monkeypatch.setattr(im, "MAX_BROADCAST_SURVIVORS", bound)
    found, stored = answers(spark)
    late = im.answer_images(found, stored, "q", "at", "image", max_images=2, max_bytes=2500)
    plain = stored.withColumn("data", F.hex("data"))
    early = im.answer_images(found, plain, "q", "at", "image", max_images=2, max_bytes=2500)
    assert late.columns == ["id", "q", "byte_size", "name", "data", "rank"] and set(early.columns) == set(late.columns)
    rows = {(r["q"], r["rank"], r["id"], r["byte_size"], r["name"], bytes(r["data"]).hex().upper()) for r in late.collect()}
    assert rows == {(r["q"], r["rank"], r["id"], r["byte_size"], r["name"], r["data"]) for r in early.collect()}
    out = io.StringIO()
    with redirect_stdout(out):
        late.explain("simple")
    plan = out.getvalue()
    assert "Window" not in plan
    if bound > 3:  # the stored bytes are neither sorted nor exchanged
        assert "BroadcastHashJoin" in plan and "Sort" not in plan and "hashpartitioning" not in plan
