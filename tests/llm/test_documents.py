"""Operators on documents against plain Python, on real rows, edge cases and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioworks.llm import decontamination, language_id, mixing, ngram_join, sharding, substring_dedup, token_counts
from folioworks.llm import queries as q
from folioworks.llm.packing import unite
from folioworks.llm.shared import staging_folder


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return (text or "").encode().split()


# Language ID


def profiles_of(rows):
    counts = defaultdict(Counter)
    for lang, text in rows:
        s = "".join(c if c.isalpha() else " " for c in text.lower())
        for w in s.split():
            w = f" {w} "
            counts[lang].update(list(w[1:-1]) + [w[i : i + 2] for i in range(len(w) - 1)])
            counts[lang].update(w[i : i + 3] for i in range(len(w) - 2))
    return counts


def test_language_counts_are_those_of_plain_python(documents):
    for r in documents[:30]:
        found = Counter(language_id.grams(r["text"]).tolist())
        assert sorted(found.values()) == sorted(profiles_of([("x", r["text"])])["x"].values())


def test_language_on_held_out_documents(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in rows_of(spark.read.parquet(f"{sf}/documents.parquet"))}
    got = rows_of(q.op2_language_id(spark, sf))
    assert sorted(r["doc_id"] for r in got) == sorted(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_language_edges(edge_docs, no_docs):
    got = rows_of(language_id.language_id(edge_docs))
    assert len(got) == edge_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (-5, -4, -3, 900003))
    assert by[None]["held_out"] is False
    assert language_id.language_id(no_docs).count() == 0
    assert {r["lang_pred"] for r in rows_of(language_id.language_id(edge_docs.selectExpr("doc_id", "text", "string(null) lang")))} == {"und"}
    columns = language_id.identify(edge_docs, language_id.train(edge_docs)).columns
    assert sorted(columns) == sorted({*edge_docs.columns, "score", "lang_pred"})


def test_language_ignores_labels_and_ids(spark, documents):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.train(df)
    other = spark.createDataFrame([(0, t, "xx") for _, t, _ in rows], df.schema)
    one = [(r["text"], r["lang_pred"]) for r in rows_of(language_id.identify(df, profiles))]
    assert sorted(one) == sorted((r["text"], r["lang_pred"]) for r in rows_of(language_id.identify(other, profiles)))


# N-gram join


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def joined(rows, width, percent):
    """(id, size, smallest id) of each row, by comparing all pairs."""
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[root(i)] = min(least.get(root(i), ident), ident)
    return sorted(
        ((r[0], len(s), least.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str
    )


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (2, 60)])
def test_join_equals_all_pairs(spark, documents, width, percent):
    rows = [(r["doc_id"], r["text"]) for r in documents]
    rng = np.random.default_rng(width)
    base = words(documents[0]["text"])[:120]
    for k in range(60):  # a group of near copies that are near to some of one another only
        w = list(base)
        for at in rng.choice(len(w), size=int(rng.integers(0, 9)), replace=False):
            w[at] = b"changed%d" % rng.integers(0, 1000)
        rows.append((500_000 + k, b" ".join(w).decode()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.similar_groups(df, width, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == joined(rows, width, percent)


def test_join_edges(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = ngram_join.similar_groups(edge_docs, 3, 90)
    assert sorted((tuple(r) for r in got.collect()), key=str) == joined(rows, 3, 90)
    assert ngram_join.similar_groups(no_docs, 3, 90).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_similar_sets_share_a_key(percent):
    segments = ngram_join.Segments(percent, 400)
    rng = np.random.default_rng(percent)
    for _ in range(400):
        size = int(rng.integers(2, 300))
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        b = a.copy()
        for at in rng.choice(size, int(rng.integers(0, size // 2 + 1)), replace=False):
            b[at] = rng.integers(0, 2**63, dtype=np.uint64)
        b = np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, size // 4 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if len(a) == len(b) == both or 100 * both < percent * (len(a) + len(b) - both):
            continue
        keys = [np.concatenate([segments.keys(x, k) for k in segments.bands(len(x))]) for x in (a, b)]
        assert len(np.intersect1d(*keys))
        for band in set(segments.bands(len(a))) & set(segments.bands(len(b))):
            own = [segments.keys(x, band) for x in (a, b)]
            if min(len(a), len(b)) >= segments.edges[band]:  # the band of the smaller one
                edges = [segments.cut(x, band)[1] for x in (a, b)]
                need = [segments.need(len(x), band, (e[1:] > e[:-1]).sum()) for x, e in zip((a, b), edges, strict=True)]
                assert len(np.intersect1d(*own)) >= max(need)
        # With some segments left out and as many matched within one deletion, too.
        dropped, raised = set(), set()
        for k in range(len(segments.errors)):
            slots = segments.slots(k).tolist()
            dropped |= set(slots[: len(slots) // 2])
            raised |= set(slots[len(slots) // 2 : 2 * (len(slots) // 2)])
        found = []
        for x, exact in zip((a, b), keys, strict=True):
            slot = exact >> np.uint64(ngram_join.HASH_BITS)
            kept = exact[~np.isin(slot, np.array(sorted(dropped | raised), np.uint64))]
            found.append(np.concatenate([kept, *(segments.deletions(x, k, raised) for k in segments.bands(len(x)))]))
        assert len(np.intersect1d(*found))


def test_allocation_swaps_only_what_pays():
    segments = ngram_join.Segments(90, 100)
    band = next(k for k, e in enumerate(segments.errors) if e >= 3)
    slots = segments.slots(band).tolist()
    assert ngram_join.allocate(segments, dict.fromkeys(slots, 100), {band: 50}) == (set(), set())
    dropped, raised = ngram_join.allocate(segments, {slots[1]: 10**6}, {band: 50})
    assert dropped == {slots[1]} and len(raised) == 1 and not raised & dropped


def test_join_with_raised_segments(spark, documents, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in documents[:80]]
    rows += [(i + 1000, " ".join((t or "").split()[:-2])) for i, t in rows]

    def always(segments, pairs, per_band):
        dropped, raised = set(), set()
        for band in per_band:
            slots = segments.slots(band).tolist()
            dropped |= set(slots[: len(slots) // 2])
            raised |= set(slots[len(slots) // 2 : 2 * (len(slots) // 2)])
        return dropped, raised

    monkeypatch.setattr(ngram_join, "allocate", always)
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert sorted((tuple(r) for r in got.collect()), key=str) == joined(rows, 3, 90)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19)), max_size=40))
def test_unite(links):
    parent = np.arange(20)
    unite(parent, *(np.array([x[k] for x in links], int) for k in (0, 1)))
    group = list(range(20))
    for a, b in links * 20:
        group[a] = group[b] = min(group[a], group[b])
    for _ in range(20):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    assert parent.tolist() == group


# Substring dedup


def without_repeats(rows, window):
    first = {}
    for ident, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), ident)
    out = []
    for ident, text in rows:
        w = words(text)
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if ident is not None and first[tuple(w[k : k + window])] < ident:
                keep[k : k + window] = [False] * window
        kept = [x for x, y in zip(w, keep, strict=True) if y]
        out.append((ident, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [13, 4])
def test_repeats_are_removed(spark, documents, monkeypatch, window):
    monkeypatch.setattr(substring_dedup, "SLICE_WORDS", 5000)
    rows = [(r["doc_id"], r["text"]) for r in documents]
    passage = " ".join(f"p{k}" for k in range(60))
    rng = np.random.default_rng(3)
    for k in range(80):  # a passage that many documents share, at any offset and cut off at either end
        lead = " ".join(f"d{k}w{i}" for i in range(int(rng.integers(0, 9))))
        cut = passage.split()[int(rng.integers(0, 20)) : 60 - int(rng.integers(0, 20))]
        rows.append((70_000 - k, f"{lead} {' '.join(cut)} end{k}"))
    got = substring_dedup.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window
    )
    assert sorted((tuple(r) for r in got.collect()), key=str) == without_repeats(rows, window)


def test_repeats_edges(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = substring_dedup.remove_repeats(edge_docs, 13)
    assert sorted((tuple(r) for r in got.collect()), key=str) == without_repeats(rows, 13)
    assert substring_dedup.remove_repeats(no_docs, 13).count() == 0


# Decontamination


def test_contaminated_documents(spark, sf, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in rows_of(q.op4_benchmark_decontamination(spark, sf))}
    assert sorted(got) == sorted(r["doc_id"] for r in documents)
    split = [(i, decontamination.tokens(t), decontamination.answer_of(t)) for i, t in items]
    wanted = set()
    for r in documents:
        w = decontamination.tokens(r["text"])
        for at in range(0, len(w), decontamination.CHUNK):
            passage = w[max(0, at - decontamination.CHUNK) : at + 3 * decontamination.CHUNK]
            if any(decontamination.is_leak(item, decontamination.word_places(item), answer, passage)[0] for _, item, answer in split):
                wanted.add(r["doc_id"])
    assert {i for i, r in got.items() if r["contaminated"]} == wanted
    assert all(got[r["doc_id"]]["contaminated"] for r in documents if any(t in r["text"] for _, t in items))


def test_paraphrases_and_edges(spark, documents, edge_docs, no_docs):
    text = "The quick engine was built by seven careful people in a small town near the river. Their answer was Ada Lovelace."
    near = "the fast engine was made by seven careful people in one small town beside the river, their answer was Ada Lovelace"
    half = "the fast machine was put up by seven patient persons in some small place near the river, and their reply was someone"
    items = spark.createDataFrame(
        [(1, text), (2, None), (3, "  "), (4, text)], "item_id long, text string"
    )
    lead = " ".join(documents[1]["text"].split()[:300])
    docs = spark.createDataFrame([(1, f"{lead} {near} {lead}"), (2, f"{lead} {half} {lead}"), (3, lead)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(decontamination.decontaminate(docs, items))}
    assert got[1]["contaminated"] and got[1]["item_id"] == 1
    assert not got[2]["contaminated"] and not got[3]["contaminated"] and got[3]["item_id"] is None
    rows = rows_of(decontamination.decontaminate(edge_docs, items))
    assert len(rows) == edge_docs.count() and not any(r["contaminated"] for r in rows)
    assert decontamination.decontaminate(no_docs, items).count() == 0
    assert not any(r["contaminated"] for r in rows_of(decontamination.decontaminate(docs, items.where("false"))))


def test_long_items(spark, documents):
    """Items of 300 and 1,000 words: whole, with every fourth word replaced, longer by a fifth, and only a third of one."""
    pick = random.Random(11)
    made = {i: [f"{pick.choice('bcdfgh')}{pick.randrange(4000)}" for _ in range(n)] for i, n in ((1, 300), (2, 1000))}
    lead = " ".join(documents[1]["text"].split()[:300])
    rows, wanted = [], {}
    for i, w in made.items():
        replaced = ["other" if k % 4 == 3 else x for k, x in enumerate(w)]
        longer = [y for k, x in enumerate(w) for y in ([x, "and"] if k % 5 == 0 else [x])]
        for words_there in (w, replaced, longer, w[: len(w) // 3]):
            rows.append((len(rows), f"{lead} {' '.join(words_there)} {lead}"))
            wanted[len(rows) - 1] = None if len(words_there) < len(w) else i
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in made.items()], "item_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(decontamination.decontaminate(docs, items))}
    assert {i: r["item_id"] for i, r in got.items()} == wanted
    assert got[0]["overlap"] == got[4]["overlap"] == 1.0 and got[1]["overlap"] == 0.75


def test_thousands_of_items(spark):
    """More items than the space has dimensions: copies and paraphrases with 60 % of the words, against brute force."""
    rng = np.random.default_rng(3)
    often = 1 / np.arange(3, 20_003)
    words_of = lambda n: [f"w{k}" for k in rng.choice(20_000, n, p=often / often.sum())]
    items = [words_of(rng.integers(15, 60)) for _ in range(3000)] + [words_of(200) for _ in range(30)]
    rows = []
    for i in range(0, len(items), 15):
        copy = [w if k % 5 < 3 else "other" for k, w in enumerate(items[i])] if i % 2 else items[i]
        rows.append((i, " ".join(words_of(rng.integers(0, 150)) + copy + words_of(rng.integers(0, 150)))))
    rows += [(10_000 + k, " ".join(words_of(300))) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: r["item_id"] for r in rows_of(decontamination.decontaminate(docs, benchmark))}
    assert all(got[i] is not None for i in range(0, len(items), 15))
    split = [[w.encode() for w in item] for item in items[:3000]]
    places = [decontamination.word_places(w) for w in split]
    for i, text in rows[:6] + rows[-2:]:
        w, best = decontamination.tokens(text), None
        for at in range(0, len(w), decontamination.CHUNK):
            passage = w[max(0, at - decontamination.CHUNK) : at + 3 * decontamination.CHUNK]
            for k, item in enumerate(split):
                leak, share = decontamination.is_leak(item, places[k], item, passage)
                best = min(best or (-share, k), (-share, k)) if leak else best
        assert got[i] == (best and best[1])


@settings(max_examples=100, deadline=None)
@given(*[st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=12)] * 2)
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontamination.common_subsequence(decontamination.word_places(a), len(a), b) == table[-1][-1]


# Sharding


def check_shards(rows, texts, shards, near):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(shards))
    for got in by.values():
        assert sorted(r["slot"] for r in got) == list(range(len(got)))
    sizes = [sum(r["size"] for r in by[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= near
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_shards_are_even(spark, sf, documents):
    rows = rows_of(q.op5_sharding(spark, sf))
    total = sum(r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    check_shards(rows, [(r["doc_id"], r["text"]) for r in documents], 8, 0.05 * total / 8 + 2 * largest)
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


def test_a_text_that_fills_a_third_is_parted(spark):
    texts = [(i, "same text") for i in range(400)] + [(1000 + i, f"text number {i}") for i in range(800)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = rows_of(sharding.shard(df, 8))
    check_shards(rows, texts, 8, 60)
    groups = defaultdict(set)
    text_of = dict(texts)
    for r in rows:
        groups[text_of[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for t, s in groups.items() if t != "same text")


def test_equal_rows_are_parted(spark):
    texts = [(7, "same text")] * 400 + [(1000 + i, f"text number {i}") for i in range(800)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = rows_of(sharding.shard(df, 8))
    mean = sum(r["size"] for r in rows) / 8
    check_shards(rows, texts, 8, 0.02 * mean + 20)


def test_slices_are_bounded_by_rows(spark, monkeypatch):
    texts = [(i, None) for i in range(2000)] + [(5000 + i, "x" * 3000 + str(i)) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    asked = []
    plain = sharding.part_rows
    monkeypatch.setattr(sharding, "part_rows", lambda *a: asked.append(plain(*a)) or asked[-1])
    check_shards(rows_of(sharding.shard(df, 4, slice_rows=100)), texts, 4, 2 * 3005)
    assert max(asked[0].values()) > 200 and max(asked[-1].values()) <= 200


def test_small_groups_stay_together(spark):
    texts = [(i, f"text {i % 500}") for i in range(2000)]
    rows = rows_of(sharding.shard(spark.createDataFrame(texts, "doc_id long, text string"), 8))
    groups = defaultdict(set)
    for r in rows:
        groups[r["doc_id"] % 500].add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())


def test_shard_edges(edge_docs, no_docs):
    texts = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    # Two texts of 200,000 and 250,000 bytes are more than a shard each.
    check_shards(rows_of(sharding.shard(edge_docs, 8)), texts, 8, 250_010)
    assert sharding.shard(no_docs, 8).count() == 0


# Mixing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8))
def test_targets(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights, 1.5, 2)
    assert sum(got) == pytest.approx(1.5 * sum(sizes))
    assert all(g <= 2 * s + 1e-6 for g, s in zip(got, sizes, strict=True))
    free = [g / w for g, w, s in zip(got, weights, sizes, strict=True) if g < 2 * s - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))


def test_split_tree_is_exact():
    quotas = np.array([100, 3, 0, 57, 1])
    tree = mixing.split_tree(quotas, 7, 3)
    assert (tree.sum(axis=0) == quotas).all() and (tree >= 0).all()
    assert tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 1
    assert (tree == mixing.split_tree(quotas, 7, 3)).all()


def test_mix_meets_its_targets(spark, sf, documents):
    rows = rows_of(q.op9_source_mixing(spark, sf))
    text = {r["doc_id"]: r for r in documents}
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(words(text[r["doc_id"]]["text"]))
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * len(r["shards"])
        by[text[r["doc_id"]]["source"]].append(r)
    for got in by.values():
        assert {r["source_size"] for r in got} == {sum(r["size"] for r in got)}
        target, taken = got[0]["target"], sum(r["taken"] for r in got)
        assert abs(taken - target) <= max(r["size"] for r in got) / 2  # ten documents come no nearer
    key = lambda r: (r["doc_id"], r["taken"], r["shards"])
    assert sorted(map(key, rows)) == sorted(map(key, rows_of(q.op9_source_mixing(spark, sf))))


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        {"taken": "sum", "target": "max"}
    )
    assert all(r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.005) for r in rows.collect())


def test_mix_edges_and_draw(edge_docs, no_docs):
    mixed = mixing.mix(edge_docs).cache()
    rows = rows_of(mixed)
    assert len(rows) == edge_docs.count()
    assert sum(r["taken"] for r in rows) <= 1.5 * sum(r["size"] for r in rows) + 1
    drawn = mixing.draw(edge_docs, mixed)
    assert drawn.columns == edge_docs.columns
    most = mixed.groupBy("doc_id").agg({"size": "max", "*": "count"}).count()
    assert 0 < drawn.count() <= 2 * edge_docs.count() and drawn.select("doc_id").distinct().count() <= most
    assert mixing.mix(no_docs).count() == 0


# Token counts


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(spark, sf, documents, tokenizer):
    got = {r["doc_id"]: r for r in rows_of(q.op10_token_counts(spark, sf))}
    assert sorted(got) == sorted(r["doc_id"] for r in documents)
    for r in documents:
        n = len(tokenizer.encode(r["text"], add_special_tokens=False))
        found = got[r["doc_id"]]
        assert (found["n_tokens"], found["n_bytes"], found["over_limit"]) == (n, len(r["text"].encode()), n > 512)


def test_only_misses_are_encoded(spark, edge_docs, no_docs, tokenizer, monkeypatch):
    import public_tokenizers

    file, cache = public_tokenizers.path("byte_bpe_50k.json"), staging_folder(spark)
    first = {tuple(r) for r in token_counts.token_counts(edge_docs, file, cache).collect()}
    texts = edge_docs.collect()
    want = {(r["doc_id"], len((r["text"] or "").encode()), len(tokenizer.encode(r["text"] or "", add_special_tokens=False))) for r in texts}
    assert first == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r["text"] or "" for r in texts})
    assert {tuple(r) for r in token_counts.token_counts(edge_docs, file, cache).collect()} == want
    assert spark.read.parquet(cache).count() == stored.count()  # all hits: nothing was appended
    other = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.token_counts(edge_docs, other, cache).count() == len(texts)  # another version misses
    assert token_counts.token_counts(no_docs, file, staging_folder(spark)).count() == 0


ODD = st.lists(
    st.sampled_from(
        [*"ab é'19.!?|<>\t\n\r\x1c\x85\xa0\u2003\u3000\u180e\u200b", "<|endoftext|>", " ", "  ", "'s", "'ll"]
    ),
    max_size=30,
).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=4))
def test_pieces_count_as_the_whole(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    raw = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()
    count = test_pieces_count_as_the_whole.__dict__.setdefault("count", token_counts.counter(".json", raw))
    whole = test_pieces_count_as_the_whole.__dict__.setdefault("whole", Tokenizer.from_str(raw.decode()))
    assert count(texts) == [len(whole.encode(t, add_special_tokens=False)) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    import public_tokenizers

    file = public_tokenizers.path(name)
    count = token_counts.counter("." + name.rpartition(".")[2], open(file, "rb").read())
    assert count(["", "some words", "some words and more"])[0] == 0
    assert count(["some words"])[0] > 0


def test_the_space_is_fitted_on_every_passage(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 60, n)) for n in [0, 5, 32, 33, 64, 65, 700] + [32 * 300] * 30]
    texts += [None, "zz zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    items = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 50, 40))) for i in range(5)]
    seen, decompose = [], decontamination._decompose
    monkeypatch.setattr(
        decontamination, "_decompose", lambda *a: (seen.append((a[0].collect(), a[2])), decompose(*a))[1]
    )
    monkeypatch.setattr(decontamination, "MOST_COMMON", 2)
    index = decontamination.fit(docs, spark.createDataFrame(items, "item_id long, text string"))
    (rows, weights), vocabulary = seen[0], index.vocabulary
    passages = []
    for t in texts:
        split = decontamination.tokens(t)
        passages += [split[at : at + 64] for at in range(0, len(split), 32)]
    assert len(passages) > 9000 and sum(len(r["scales"]) // 4 for r in rows) == len(passages)
    a = np.zeros((len(passages), len(weights)))
    for i, p in enumerate(passages):
        np.add.at(a[i], [vocabulary[w] for w in p if w in vocabulary], 1)
    a *= weights
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    basis = rng.normal(size=(len(weights), 4)).astype(np.float32)
    dense = np.full(len(weights), -1)
    dense[[3, 1, 7]] = [0, 1, 2]
    out = np.zeros(basis.shape, np.float32)
    monkeypatch.setattr(decontamination, "FIT_CHUNKS", 7)
    for r in rows:
        words = np.frombuffer(r["words"], np.uint16), np.frombuffer(r["ends"], np.int64), np.frombuffer(r["lasts"], np.int64)
        weighted = (weights[:, None] * basis).astype(np.float32)
        decontamination._passage_product(*words, np.frombuffer(r["scales"], np.float32), weighted, dense, out)
    want = a.T @ (a @ basis)
    assert np.abs(weights[:, None] * out - want).max() < 1e-3 * np.abs(want).max()


def test_passes_go_over_sums_of_pairs(spark, monkeypatch):
    """Sums of pairs of words, each of them once, against the rows of all passages; and the space is that of the passes."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 90) for n in [0, 5, 31, 32, 33, 64, 65, 700, 9000]]
    docs = spark.createDataFrame(list(enumerate([*texts, None, "zz"])), "doc_id long, text string").repartition(3)
    items = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 80, 40))) for i in range(9)]
    items = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "PAIRED_BYTES", 4 * 70 * 7)
    monkeypatch.setattr(decontamination, "FIT_CHUNKS", 7)
    seen, sums = [], decontamination._pair_sums
    monkeypatch.setattr(decontamination, "_pair_sums", lambda *a: seen.append((*a, sums(*a))) or seen[-1][-1])
    for wide in (0, 5, 1000):
        monkeypatch.setattr(decontamination, "PAIRED_DENSE", wide)
        index = decontamination.fit(docs, items)
        _, order, _, staged = seen.pop()
        a = []
        for t in texts + ["zz"]:
            split = [index.vocabulary.get(w, -1) for w in decontamination.tokens(t)]
            for at in range(0, len(split), 32):
                known = [w for w in split[at : at + 64] if w >= 0]
                a.append(index.weights * np.bincount(known, minlength=len(order)))
        a = np.array(a) / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
        basis = rng.normal(size=(len(order), 4)).astype(np.float32)
        got, rows = decontamination._paired_times(staged, order, index.weights, basis)
        want = a.T @ (a @ basis)
        assert rows == len(a) and np.abs(got - want).max() < 1e-4 * np.abs(want).max()
    monkeypatch.setattr(decontamination, "MOST_PAIRED", 0)
    other = decontamination.fit(docs, items)
    assert not seen and np.abs(other.queries @ other.queries.T - index.queries @ index.queries.T).max() < 1e-3


def test_windows_without_enough_words_are_not_checked(spark, sf, documents, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    index = decontamination.fit(spark.createDataFrame([(1, documents[0]["text"])], "doc_id long, text string"), items)
    split = [decontamination.tokens(r["text"]) for r in documents[:60]]
    split += [split[k] + item + split[k + 1] for k, item in enumerate(index.items[:30])] + [x[:20] for x in index.items[:9]]
    monkeypatch.setattr(decontamination, "PRESENT", 70 * len(index.weights))
    monkeypatch.setattr(decontamination, "PAIRS", 100)
    few = set(decontamination.candidates(split, index))
    monkeypatch.setattr(decontamination, "LONGEST", 0)
    every = set(decontamination.candidates(split, index))

    def enough(doc, start, item):
        end = start + decontamination.window_chunks(len(index.items[item]))[1]
        here = set(split[doc][max(0, start) * 32 : end * 32])
        return sum(w in here for w in index.items[item]) >= decontamination.PARAPHRASE * len(index.items[item])

    assert few == {c for c in every if enough(*c)} and 30 <= len(few) < len(every) / 4
