"""Language ID and source mixing recomputed in plain Python, apart from the operators' own functions."""

import zlib
from collections import Counter, defaultdict

import pytest

from folioworks.llm import language_id, mixing
from folioworks.llm import queries as q

PROFILE = 300


def grams(text):
    """Counts of the one to three letter runs of all words; a space stands for a word's edge."""
    counts = Counter()
    for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        counts.update(w)
        w = f" {w} "
        counts.update(w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1))
    return counts


def by_rank(counts):
    """The most frequent n-grams; ties by their last character first, a missing one and an edge before letters."""

    def place(gram):
        points = [1 if c == " " else ord(c) + 1 for c in gram]
        return tuple(reversed(points + [0] * (3 - len(points))))

    return sorted(counts, key=lambda g: (-counts[g], place(g)))[:PROFILE]


def nearest(text, profiles):
    top = by_rank(grams(text))
    if not top or not profiles:
        return "und", 0.0
    apart = {
        lang: sum(abs(ranks[g] - i) if g in ranks else PROFILE for i, g in enumerate(top))
        for lang, ranks in profiles.items()
    }
    best = min(sorted(apart), key=apart.get)
    return best, 1 - apart[best] / (PROFILE * len(top))


def expected_languages(rows):
    """(doc_id, language, score) of every row; two thirds of the ids are learnt from, a NULL id never is."""
    counts = defaultdict(Counter)
    for r in rows:
        learns = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1
        if learns and r["lang"] is not None and r["text"] is not None:
            counts[r["lang"]].update(grams(r["text"]))
    profiles = {lang: {g: i for i, g in enumerate(by_rank(c))} for lang, c in counts.items() if c}
    return [(r["doc_id"], *nearest(r["text"], profiles)) for r in rows]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def same_languages(got, rows):
    got = by_id((r["doc_id"], r["lang_pred"], r["score"]) for r in got)
    want = by_id(expected_languages(rows))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-9)


def test_languages_and_distances(spark, sf, documents):
    same_languages(q.op2_language_id(spark, sf).collect(), documents)


def test_languages_of_edge_cases(edge_docs):
    same_languages(language_id.language_id(edge_docs).collect(), [r.asDict() for r in edge_docs.collect()])


def expected_mix(rows, cycle=(3, 1, 2), share=1.5, most=2):
    """doc_id, size, size and target of its source: the level at which limited sources give ``share`` of all words."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(sources)}
    low, high = 0.0, most * float(sum(sizes.values())) + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(level * weight[s], most * sizes[s]) for s in sources) < share * sum(sizes.values()):
            low = level
        else:
            high = level
    target = {s: min(high * weight[s], most * sizes[s]) for s in sources}
    return [
        (r["doc_id"], len((r["text"] or "").encode().split()), sizes[r["source"]], target[r["source"]]) for r in rows
    ]


def same_mix(got, rows):
    assert all(r["taken"] % r["size"] == 0 and r["taken"] <= 2 * r["size"] for r in got if r["size"])
    assert all(r["taken"] == 0 for r in got if not r["size"])
    got = by_id((r["doc_id"], r["size"], r["source_size"], r["target"]) for r in got)
    want = by_id(expected_mix(rows))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], rel=1e-9, abs=1e-6)


def test_targets_of_the_mix(spark, sf, documents):
    same_mix(q.op9_source_mixing(spark, sf).collect(), documents)


def test_targets_of_edge_cases(edge_docs):
    same_mix(mixing.mix(edge_docs).collect(), [r.asDict() for r in edge_docs.collect()])


def test_words_taken_of_each_source(spark):
    """Many sources of documents of ten words: what each gives is within a word or half a document of its target."""
    rows = [(i, "w " * 10, f"s{i % 37:02d}" if i % 41 else None) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = Counter(), {}
    source = {r[0]: r[2] for r in rows}
    for r in mixing.mix(docs).collect():
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 6 for s in target)
