"""Rules over one document take time in proportion to its length."""

import time

import pytest
from pyspark.sql import functions as F

from folioworks.functions import chunks, markdown, text
from folioworks.functions.vectors import hashed_embedding

CASES = {
    "chunk_overlap": (lambda c: chunks.overlapping(c), lambda n: "Some words make a sentence. " * (n // 28)),
    "pack_paragraphs": (lambda c: chunks.packed_paragraphs(c, 2000), lambda n: "a short paragraph\n\n" * (n // 19)),
    "md_blocks": (lambda c: markdown.blocks(c), lambda n: "| a | b |\n|---|---|\n| c | d |\n\ntext\n" * (n // 36)),
    "header_nodes": (lambda c: markdown.header_nodes(c), lambda n: "# head\n## sub\nbody\n```\n# code\n```\n" * (n // 36)),
    "trim_blank_edges": (lambda c: text.trim_blank_edges(c), lambda n: "a\n" + "  \n" * (n // 3)),
    "hash_embed": (lambda c: hashed_embedding(F.split(c, " "), 256), lambda n: " ".join(f"w{i}" for i in range(n // 7))),
}


def seconds(spark, rule, content):
    df = spark.createDataFrame([(content,)], "t string").select(F.hash(rule(F.col("t"))).alias("h"))
    best = float("inf")
    for _ in range(3):
        start = time.time()
        df.collect()
        best = min(best, time.time() - start)
    return best


@pytest.mark.parametrize("name", sorted(CASES))
def test_twice_the_text_takes_about_twice_as_long(spark, name):
    rule, build = CASES[name]
    small, large = (seconds(spark, rule, build(n)) for n in (400_000, 1_600_000))
    assert large <= 8 * small + 1.0, (small, large)  # four times the text; the square would be sixteen times


def test_long_chunks_are_those_of_plain_python(one):
    from folioworks import fixed_values as fv

    content = "".join(f"Word{i} follows {'x' * (i % 37)}{'. ' if i % 5 == 0 else ' '}" for i in range(3000))
    got = [(r["text"], r["position"]) for r in one(chunks.overlapping, content)]
    want, start, n = [], 0, len(content)
    while True:
        end = min(start + fv.CHUNK_SIZE, n)
        if end < n:
            window = content[start:end]
            ends = [at for stop in fv.CHUNK_STOPS if (at := window.rfind(stop)) > fv.CHUNK_MIN]
            end = start + ends[0] + 1 if ends else end
        if len(content[start:end].strip()) >= fv.CHUNK_MIN:
            want.append((content[start:end].strip(), start))
        start = end - fv.CHUNK_OVERLAP
        if start >= n - fv.CHUNK_MIN:
            break
    assert got == want


def test_hashed_embedding_counts_in_batches(spark):
    """Against plain Python, with NULL tokens and lists; tokens are hashed in Arrow batches, not in a fold per token."""
    from hashlib import md5

    lists = [["a", "b", "a", None, "ä"], [], None, [None], [""], [f"w{i}" for i in range(3000)]]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, t array<string>").repartition(3)
    out = df.select("i", hashed_embedding(F.col("t"), 7).alias("v"))
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    for i, got in sorted(map(tuple, out.collect())):
        want = [0.0] * 7
        for w in filter(lambda w: w is not None, lists[i] or []):
            h = md5(w.encode()).hexdigest()
            want[int(h[:8], 16) % 7] += -1.0 if int(h[8], 16) % 2 else 1.0
        norm = sum(x * x for x in want) ** 0.5 or 1.0
        assert got is None if lists[i] is None else all(abs(x / norm - y) < 1e-12 for x, y in zip(want, got, strict=True))
