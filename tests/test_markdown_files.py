"""Markdown files are bounded runs of documents."""

import hashlib
import os

from folioworks.sources import files, sinks


def test_a_source_is_several_files(spark, tmp_path):
    texts = {i: f"# {i}\n" + "word " * (i % 50) for i in range(400)}
    source = lambda i: "large" if i % 3 else f"s{i % 4}"
    rows = [(i, source(i), t) for i, t in texts.items()] + [(500, "large", "x" * 5000), (501, "large", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    sinks.write_markdown(docs, f"{tmp_path}/out", run_bytes=2000)
    found = [(r["path"], r["text"]) for r in files.read_markdown(spark, f"{tmp_path}/out", "*.txt").collect()]
    got = {}
    for path, text in sorted(found, key=lambda f: int(f[0].split("run=")[1].split("/")[0])):
        got.setdefault(path.split("source=")[1].split("/")[0], []).append(text)
    for name, parts in got.items():
        want = "".join(f"{t}\n" for _, s, t in rows if s == name and t is not None)
        assert "".join(parts) == want
        assert all(len(p) <= 2000 or p == "x" * 5000 + "\n" for p in parts)
    assert set(got) == {r[1] for r in rows} and len(got["large"]) > 10
