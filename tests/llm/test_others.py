"""Conversations, pages, embeddings, components and the pipeline against plain Python."""

import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioworks.llm import chat, decontamination, graph, language_id, mixing, url_filter, vector_dedup
from folioworks.llm import queries as q
from test_documents import joined, rows_of

import oracle


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_oracle(spark, sf, name):
    ok, note, _, _ = oracle.compare(spark, oracle.connect(sf), sf, q.QUERIES[name], q.ORACLES[name])
    assert ok, note


# Chat


def rendered(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    import hashlib

    for t in talks.values():
        t.sort(key=lambda x: (x[0], x[1], x[2], hashlib.md5(x[3].encode()).hexdigest()))
    paths = {c: tuple((r, x) for *_, r, x in t) for c, t in talks.items()}
    begins = {p[:k] for p in paths.values() for k in range(1, len(p))}
    equal = defaultdict(list)
    for c, p in paths.items():
        equal[p].append(c)
    return sorted(
        (min(cs), len(p), len(cs), "".join(f"<|{r}|>\n{x}\n" for r, x in p)) for p, cs in equal.items() if p not in begins
    )


def test_snapshots_collapse(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes")]
    talks = {1: a[:2], 2: a, 3: a[:1], 4: a, 5: a[:2] + [("user", "other")], 6: [("assistant", "hi")], 7: [("user", None)]}
    rows = [(c, k, r, t) for c, talk in talks.items() for k, (r, t) in enumerate(talk)]
    rows += [(8, 0, None, ""), (8, 0, None, ""), (9, None, "user", "hi"), (None, 0, "user", "hi"), (10, 5, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 AS position", "'x' AS digest", "2 AS n_turns", "3 AS p1")
    assert sorted(tuple(r) for r in chat.chat_format(df).collect()) == rendered(rows)
    assert chat.chat_format(df.where("false")).count() == 0


def test_chat_runs_in_the_jvm(spark, sf):
    plan = q.op1_chat_formatting(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


# URLs


def test_url_rules(spark):
    urls = [
        "http://www.example.com/en/1", "http://a.www.example.com/en/", "http://example.com/en/x?y", "HTTP://B.Example.COM/en/#z",
        "http://example.com/fr/", "http://example.com", "http://net/es/", "http://x.net/fr/1", "http://xnet/fr/1", "http://x.net/esp/",
        "no scheme", None, "", "://", "a://b://c/en/", "http://cheap-pills.org/a", "http://x.org/cheap-pillsx", "http://x.com/casino",
        "http://x.org?u=http://example.com/en/", "http://example.com:80/en/", "http://exa\nmple.com/en/", "http://" + "a" * 50_000 + ".com/",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, host string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, q.URL_RULES, q.URL_PATTERNS).collect()]
    want = []
    for i, u in [*enumerate(urls), (0, urls[0])]:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in q.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        spam = any(re.search(rf"(?i)(?<![A-Za-z0-9]){p.word}(?![A-Za-z0-9])", host + path) for p in q.URL_PATTERNS)
        want.append((i, host, path, rule and rule.name, rule.verdict if rule else "block" if spam else "allow"))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert url_filter.filter_urls(pages.where("false"), q.URL_RULES, []).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    index = url_filter.indexed(q.URL_RULES, {"com": 90, "example": 50, "en": 70, "www": 60, "net": 20, "es": 5, "fr": 9})
    assert {t: [r.name for r in rs] for t, rs in index.items()} == {
        "com": ["com/"], "example": ["example.com/en/", "www.example.com/en/"], "es": ["net/es/"], "fr": ["net/fr/"]
    }
    assert url_filter.Rule("a.org", "/pre", "block").tokens() == {"a", "org"}  # "pre" may go on in a URL


# Embeddings


def linked(rows, threshold):
    """(id, links, smallest id, kept) of each row, by comparing all pairs."""
    units = []
    for _, x, label in rows:
        ok = label is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)
        x = np.array(x, float) / max(map(abs, x)) if ok else None
        units.append(x / np.linalg.norm(x) if ok else None)
    near = defaultdict(set)
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b >= threshold:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        least = min(rows[k][0] for k in seen)
        out.append((r[0], len(near[i]), least, r[0] == least))
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    rows = []
    for k in range(150):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 5))):
            rows.append((base + rng.normal(size=16) * 0.12, int(k % 2)))
    hot = rng.normal(size=16)
    rows += [(hot + rng.normal(size=16) * 0.15, 1) for _ in range(200)] + [(hot, 1)] * 50
    rows = [(i, [float(v) for v in x], label) for i, (x, label) in enumerate(rows)]
    n = len(rows)
    odd = [[0.0] * 16, None, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] + [0.0] * 15, [], rows[0][1], rows[0][1][:8]]
    rows += [(n + i, x, 0) for i, x in enumerate(odd)] + [(n + 50, rows[0][1], None), (n + 51, [v * 1e200 for v in rows[0][1]], 0)]
    return rows + [(n + 52, rows[0][1], 1), (n + 6, rows[0][1], 0)]


def test_vectors_against_all_pairs(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector_dedup, "LEAF", 32)
    monkeypatch.setattr(vector_dedup, "BLOCK", 64)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    got = sorted(tuple(r) for r in vector_dedup.near_vectors(df).collect())
    want = linked(vectors, 0.98)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert len(got) == len(want) and 0.9 * there <= found <= there
    assert all(a[0] == b[0] and a[1] <= b[1] and a[2] >= b[2] for a, b in zip(got, want, strict=True))
    assert np.mean([a == b for a, b in zip(got, want, strict=True)]) > 0.9
    assert vector_dedup.near_vectors(df.where("false")).count() == 0


def test_recall_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rng = np.random.default_rng(2)
    more = [(10_000 + i, (np.array(x) + rng.normal(size=len(x)) * 0.015).tolist(), label) for i, x, label in rows]
    rows = [(i, list(map(float, x)), label) for i, x, label in rows + more]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(df).collect()}
    want = {r[0]: r[1] for r in linked(rows, 0.98)}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.9 * sum(want.values()) > 0


# Components


def test_components(spark):
    rng = np.random.default_rng(4)
    ids = rng.integers(-(2**62), 2**62, 300).tolist()
    links = [(ids[k], ids[k + 1]) for k in range(0, 120)]  # a chain
    links += [(ids[150], ids[k]) for k in range(151, 220)] + [(ids[230], ids[231]), (ids[231], ids[230]), (ids[240], ids[240])]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups = defaultdict(set)
    for node, c in got.items():
        groups[c].add(node)
    want = [set(ids[0:121]), set(ids[150:220]), set(ids[230:232])]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))
    assert all(c in g for c, g in groups.items())
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Pipeline


@pytest.fixture(scope="module")
def steps(spark, sf, documents):
    """What each stage returns for the documents and some that stages have to reject."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in documents]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows += [(10**6, None, None, "src0", 0), (10**6 + 1, "12 34 !", "en", None, 7), (10**6 + 2, f"{rows[3][1]} {item}", "en", "src1", 9)]
    rows += [(10**6 + 3, rows[5][1], "en", "src2", 1), rows[5], (None, rows[7][1] + " and more of it", "en", "src2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [docs]
    for _, step in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stage(step(spark, out[-1], sf)))
    return out


def test_stages_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_language_stage(steps):
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    assert ids(steps[0]) - ids(steps[1]) == {10**6, 10**6 + 1}


def test_language_stage_learns_from_all_documents(spark, sf):
    """A language whose documents are all among op2's held-out ids, and one whose documents have no id."""
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1][:4]
    rows = [(i, "это русский текст о погоде и о море", "ru") for i in held]
    rows += [(None, "αυτό είναι ένα κείμενο για τον καιρό", "el"), (1000, "a text about the weather and the sea", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, sf)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows, key=str)


def test_join_stage_keeps_one_of_each_group(steps):
    before = [(r["doc_id"], r["text"]) for r in steps[1].collect()]
    want = sorted({str(i) for i, _, least in joined(before, 5, 80) if i == least})  # NULL only if none has an id
    assert sorted(str(r["doc_id"]) for r in steps[2].collect()) == want


def test_join_stage_judges_rows(spark, sf):
    """One id for two texts, NULL ids in a group, and equal rows: one row of each group stays, and no other goes."""
    base = [f"w{i}" for i in range(200)]
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (3, 190, 197)]
    other = " ".join(f"u{i}" for i in range(50))
    rows = [(1, " ".join(base)), (2, near[0]), (2, other), (None, near[1]), (None, near[2]), (3, other + " more")]
    rows += [(9, "alone and seen three times over")] * 3 + [(None, "no id at all but a text")] * 2 + [(4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("*", "'a' AS key", "'b' AS component_id", "'c' AS row").repartition(4)
    got = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    want = [(1, " ".join(base)), (2, other), (9, rows[6][1]), (None, rows[9][1]), (4, None)]
    assert kept == sorted(want, key=str)


def test_decontamination_stage(steps, sf, spark):
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in steps[2].collect()} - {r["doc_id"] for r in steps[3].collect()}
    assert gone >= {r["doc_id"] for r in steps[2].collect() if any(t in r["text"] for t in items)}
    assert len(gone) <= 0.1 * steps[2].count()


def test_mixing_and_sharding_stages(steps):
    before = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    mixed = [(r["doc_id"], r["text"]) for r in steps[4].collect()]
    assert all(before[i] == t for i, t in mixed)
    words = sum(len(t.encode().split()) for t in before.values())
    assert sum(len(t.encode().split()) for _, t in mixed) == pytest.approx(1.5 * words, rel=0.05)
    placed = rows_of(steps[5])
    assert sorted(str(r["doc_id"]) for r in placed) == sorted(str(i) for i, _ in mixed)
    assert {r["shard"] for r in placed} == set(range(8))


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, sf))
    assert docs.count() == 0


def test_items_may_have_text_ids(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "other words only"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("item-a", " ".join(words[10:50])), (None, "x y z q r s t u")], "item_id string, text string")
    found = decontamination.decontaminate(docs, items)
    assert dict(found.dtypes)["item_id"] == "string"
    assert {r["doc_id"]: (r["contaminated"], r["item_id"]) for r in found.collect()} == {
        1: (True, "item-a"), 2: (False, None), 3: (False, None),
    }


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    texts = spark.createDataFrame([(f"l{i}", f"abc def {i} ghi") for i in range(4)], "lang string, text string")
    with pytest.raises(ValueError, match="more than 3 languages"):
        language_id.train(texts)
    assert len(language_id.train(texts.where("lang <> 'l3'")).languages) == 3


def test_blocks_of_very_many_sources_are_planned_in_step():
    began = time.perf_counter()
    n = 100_000
    plan = mixing.plan_blocks({i: {0: 10} for i in range(n)}, [10] * n, [15.0] * n, 8, 7)
    assert time.perf_counter() - began < 60
    assert len(plan) == n and all(len(w) == 1 and part == 5 and shard is not None for _, _, w, part, shard in plan)
