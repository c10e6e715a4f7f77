"""Pruned search against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from folioworks.operators import pruned_search


def clustered(n, clusters, dim, seed, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    m = centres[np.arange(n) % clusters] + spread * rng.normal(size=(n, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def every_pair(questions, vectors, k):
    out = {}
    for qid, bucket, q in questions:
        scored = [
            (-round(float(np.dot(q, x)), 6), i) for i, b, x in vectors if b == bucket and x is not None and len(x) == len(q)
        ]
        out[qid] = [(i, -s) for s, i in sorted(scored)[:k]]
    return {q: r for q, r in out.items() if r}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["question_id"], r["rank"])):
        out.setdefault(r["question_id"], []).append((r["id"], r["score"]))
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)


def test_blocks_are_skipped_on_clustered_vectors(spark):
    m = clustered(3000, 40, 16, 3)
    vectors = [(i, "b", x) for i, x in enumerate(m.tolist())]
    questions = [(i, "b", m[i].tolist()) for i in range(0, 3000, 50)]
    index = pruned_search.build_index(spark.createDataFrame(vectors, "id long, bucket string, vec array<double>"), 60)
    assert index.count() >= 40
    counts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    asked = spark.createDataFrame(questions, "question_id long, bucket string, vec array<double>")
    close(found(pruned_search.pruned_topk(asked, index, 5, counts=counts)), every_pair(questions, vectors, 5))
    met, skipped = counts[0].value, counts[1].value
    assert met + skipped == 60 * index.count() and met < 0.2 * skipped


def test_buckets_sizes_ties_and_gaps(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, "xyz"[i % 3], np.round(rng.normal(size=4 + i % 2), 1).tolist()) for i in range(400)]
    vectors += [(1000 + i, "x", vectors[0][2]) for i in range(30)]  # equal scores: the smaller id goes first
    vectors += [(2000, "x", None), (2001, "x", [1.0, None, 0.0, 0.0]), (2002, "y", []), (2003, None, [1.0] * 4)]
    questions = [(i, b, v) for i, b, v in vectors[:40]] + [(5000, "none", [1.0] * 4), (5001, "x", None)]
    df = spark.createDataFrame(vectors, "id long, bucket string, vec array<double>").selectExpr("*", "'p' AS pivot", "1 AS dim")
    index = pruned_search.build_index(df, 25, most_pivots=6)
    asked = spark.createDataFrame(questions, "question_id long, bucket string, vec array<double>")
    sound = [r for r in vectors if r[2] and None not in r[2]]
    want = every_pair([q for q in questions if q[2]], sound, 7)
    close(found(pruned_search.pruned_topk(asked, index, 7)), want)
    close(found(pruned_search.pruned_topk(asked, index, 7, max_questions=9)), want)  # several passes
    assert pruned_search.pruned_topk(asked, index.where("false"), 7).count() == 0
    empty = pruned_search.build_index(df.where("false"))
    assert empty.count() == 0


def test_a_block_meets_all_its_questions_at_once(monkeypatch):
    m = clustered(300, 1, 8, 5)
    calls, add = [], pruned_search._Running.add
    monkeypatch.setattr(pruned_search._Running, "add", lambda self, *a: (calls.append(len(a)), add(self, *a))[1])
    scan = pruned_search.Scan({("b", 8): (np.arange(300), m, np.full(300, -np.inf))}, 5, 6)
    for at in range(0, 300, 100):
        part = m[at : at + 100]
        centre = part.mean(axis=0)
        radius = np.sqrt(((part - centre) ** 2).sum(axis=1)).max()
        scan.add("b", 8, list(range(at, at + 100)), part.tobytes(), centre.tobytes(), radius, 1.0)
    assert len(calls) == 3
    got = {}
    for q, i, s in zip(*(c.tolist() for c in scan.running["b", 8].columns()), strict=True):
        got.setdefault(q, []).append((i, s))
    rows = [(i, "b", x) for i, x in enumerate(m.tolist())]
    close(got, every_pair(rows, rows, 5))


def test_a_block_is_held_in_double_precision_by_slices(monkeypatch):
    from folioworks.operators import search

    rng = np.random.default_rng(2)
    n, kind = 3 * search.ROWS_PER_SLICE + 7, pa.list_(pa.float32())
    stored = rng.integers(-9, 9, (n, 4)).astype(np.float32)
    vectors = [None if i % 50 == 0 else v[: 3 + (i % 30 > 0)] for i, v in enumerate(stored.tolist())]
    asked = rng.integers(-9, 9, (5, 4)).astype(np.float64)
    left = pa.table({"question_id": range(5), "vec": asked.tolist(), "bound": [-np.inf] * 5})
    right = pa.table({"id": pa.array(range(n), pa.int64()), "vec": pa.array(vectors, kind)})
    schema = pa.schema([("question_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    sizes, matrix = [], search._matrix
    monkeypatch.setattr(search, "_matrix", lambda c, dim: (sizes.append(len(c)), matrix(c, dim))[1])
    (got,) = search._best_of_block(left, right, 3, 6, schema)
    ids = [i for i, v in enumerate(vectors) if v is not None and len(v) == 4]
    for q in range(5):
        scores = stored[ids].astype(np.float64) @ asked[q]
        want = sorted(zip((-scores).tolist(), ids, strict=True))[:3]
        assert sorted((-r["score"], r["id"]) for r in got.to_pylist() if r["question_id"] == q) == want
    assert max(sizes) <= search.ROWS_PER_SLICE
