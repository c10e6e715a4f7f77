"""Best-fit packing, vector codes and ranked search against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioworks.llm import lexical_search, sequence_packing, vector_codes

BPE = public_tokenizers.path("byte_bpe_50k.json")


# Best-fit packing


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def expected_pieces(text, whole, capacity, end=2):
    ids = [*whole.encode(text or "", add_special_tokens=False).ids, end]
    first = len(ids) % capacity or capacity
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(a, ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_fit_count(lengths, capacity):
    """Best fit, longest first, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def check_packed(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 and 0 < r["length"] <= capacity
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [1024, 100])
def test_packing_of_documents(spark, edge_docs, capacity):
    rows = sequence_packing.pack(edge_docs, BPE, capacity).collect()
    whole = tokenizer()
    wanted = Counter()
    for r in edge_docs.collect():
        for piece, (start, ids) in enumerate(expected_pieces(r["text"], whole, capacity)):
            wanted[r["doc_id"], piece, start, np.array(ids, "<u4").tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in rows) == wanted
    used = check_packed(rows, capacity)
    lengths = [r["length"] for r in rows]
    assert -(-sum(lengths) // capacity) <= used <= best_fit_count(lengths, capacity)


def test_packing_of_nothing_and_assembled_sequences(spark, edge_docs, no_docs):
    assert sequence_packing.pack(no_docs, BPE).count() == 0
    packed = sequence_packing.pack(edge_docs, BPE)
    rows = packed.collect()
    made = {r["sequence_id"]: r for r in sequence_packing.assemble(packed).collect()}
    assert len(made) == len({r["sequence_id"] for r in rows})
    parts = defaultdict(list)
    for r in packed.collect():
        parts[r["sequence_id"]].append((r["offset"], bytes(r["ids"])))
    for number, held in parts.items():
        ids = b"".join(x for _, x in sorted(held))
        assert bytes(made[number]["ids"]) == ids and made[number]["n_tokens"] == len(ids) // 4
        assert made[number]["offsets"] == sorted(o for o, _ in held)


def test_packing_query(spark, sf):
    from folioworks.llm import queries

    rows = queries.QUERIES["op11_best_fit_packing"](spark, sf).collect()
    whole = tokenizer()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    wanted = {
        (r["doc_id"], piece, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        for r in docs
        for piece, (start, ids) in enumerate(expected_pieces(r["text"], whole, 1024))
    }
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows} == wanted


ODD = ["a", "Ab", " ", "  ", "\n", "\t", "é", "ß", "'", "'s", "'ll", "1", "22", ".", ",", "<|endoftext|>", "<|", " ", "᠎", "漢", "ﬁ", "́", "-", "\r\n"]


@pytest.fixture(scope="module")
def encode():
    with open(BPE, "rb") as f:
        return sequence_packing.encoder(f.read()), tokenizer()


def test_ids_of_odd_texts(encode):
    fast, whole = encode

    @settings(max_examples=1500, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(ODD), max_size=25).map("".join), max_size=4))
    def same(texts):
        wanted = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert fast(texts) == wanted

    same()


@settings(max_examples=150, deadline=None)
@given(
    st.integers(5, 64),
    st.lists(st.tuples(st.integers(1, 64), st.integers(1, 60)), max_size=25),
)
def test_plans_place_every_piece_once(capacity, counts):
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts:
        histogram[(length - 1) % capacity + 1] += n
    for part, groups in ((1 / 8, 3), (1 / 4, 5), (1 / 3, 200), (1 / 2, 4)):
        made = sequence_packing._plan(histogram, capacity, int(capacity * part), groups)
        placed = np.zeros(capacity + 1, np.int64)
        for run in made.runs:
            assert run.times > 0 and run.free >= 0
            assert sum(length * n for length, n in run.items) == capacity - run.free
            for length, n in run.items:
                placed[length] += n * run.times
        assert (placed == histogram).all()
    best = sequence_packing.plan(histogram, capacity)
    lengths = [length for length in range(1, capacity + 1) for _ in range(int(histogram[length]))]
    assert best.sequences <= best_fit_count(lengths, capacity)


def test_configurations_beat_best_fit():
    # 7 + 3 + 2 + 2 and 5 + 5 + 4 fill 14; best fit alone puts 7 beside 7 and 5 beside 5.
    histogram = np.zeros(15, np.int64)
    histogram[[7, 5, 4, 3]] = [1000, 2000, 1000, 2333]
    exact = sequence_packing._plan(histogram, 14, 2, 10**6).sequences
    assert sequence_packing.plan(histogram, 14).sequences <= exact
    assert exact <= best_fit_count([7] * 1000 + [5] * 2000 + [4] * 1000 + [3] * 2333, 14)
    big = histogram * 10**9  # the plan doesn't grow with the table
    made = sequence_packing.plan(big, 14)
    assert len(made.runs) < 100 and made.sequences >= -(-int((big * np.arange(15)).sum()) // 14)


# Vector codes


def plain_codes(rows, parts, entries, rounds):
    """rows: (vec_id, label, list of whole numbers), kept and padded already."""
    step = len(rows[0][2]) // parts
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[r[2][p * step : (p + 1) * step] for r in first] for p in range(parts)]

    def near(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for r in rows:
                part = r[2][p * step : (p + 1) * step]
                groups[near(part, books[p])[1]].append(part)
            for i, held in groups.items():
                books[p][i] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    out = []
    for vec_id, label, numbers in rows:
        found = [near(numbers[p * step : (p + 1) * step], books[p]) for p in range(parts)]
        out.append((vec_id, label, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return out, hashlib.sha256(text.encode()).hexdigest()


def vectors_with_edges(spark, sf):
    rows = [
        (r["vec_id"], r["label"], list(r["embedding"]))
        for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(150).collect()
    ]
    rows += [(10_000 + i, None, rows[0][2]) for i in range(80)]  # copies with a NULL label
    rows += [(rows[3][0], 1, rows[4][2]), (None, 2, rows[5][2]), rows[6], rows[6]]
    rows += [(20_000, 1, None), (20_001, 1, [None] + [0.0] * 63), (20_002, None, [math.nan] * 64)]
    rows += [(20_003, 3, [math.inf] + [0.0] * 63), (20_004, 3, []), (20_005, 3, [0.5, -0.3]), (20_006, 4, [0.0] * 64)]
    schema = "vec_id long, label int, embedding array<float>"
    clash = [f"'{n}' AS {n}" for n in ("part", "entry", "place", "n", "code", "error")]
    return spark.createDataFrame(rows, schema).selectExpr("*", *clash).repartition(3)


def scaled(df, width):
    out = []
    for r in df.collect():
        v = r["embedding"]
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        numbers = [math.floor(256 * x) for x in v]
        out.append((r["vec_id"], r["label"], numbers + [0] * (width - len(numbers))))
    return out


@pytest.mark.parametrize(("branch", "rows"), [(4096, 32768), (2, 50)])
def test_codes_equal_plain_ones(spark, sf, monkeypatch, branch, rows):
    df = vectors_with_edges(spark, sf).cache()
    want, digest = plain_codes(scaled(df, 64), 16, 64, 2)
    coded, books = vector_codes.compress(df)
    got = [tuple(r[c] for c in ("vec_id", "label", "code", "error")) for r in coded.collect()]
    assert Counter(got) == Counter(want) and vector_codes.digest(books) == digest
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    assert {r["label"]: r["label_error"] for r in vector_codes.with_label_error(coded).collect()} == dict(sums)
    # Tries of any size, with branches of any size, find the same.
    monkeypatch.setattr(vector_codes, "BRANCH", branch)
    parts = np.array([r[2][:4] for r in scaled(df, 64)])
    leaves, place, copies = vector_codes.distinct(parts)
    entry, distance = vector_codes.nearest(leaves, books[0])
    every = ((parts[:, None, :] - books[0][None]) ** 2).sum(axis=2)
    assert (entry[place] == every.argmin(axis=1)).all() and (distance[place] == every.min(axis=1)).all()
    assert copies.sum() == len(parts)


def test_codes_of_few_and_no_vectors(spark):
    schema = "vec_id long, label int, embedding array<float>"
    coded, books = vector_codes.compress(spark.createDataFrame([], schema))
    assert coded.count() == 0 and books.shape[1] == 0
    two = spark.createDataFrame([(2, 1, [0.5] * 16), (1, None, [-0.1] * 16)], schema)
    coded, books = vector_codes.compress(two)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in coded.collect()) == [
        (1, "00" * 16, 0),
        (2, "01" * 16, 0),
    ]
    assert books[0].tolist() == [[-26], [128]]
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, 1, [1e9] * 16)], schema))[0].collect()


# Ranked search


def plain_search(docs, items, k=10):
    def terms(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)

    held = [(doc_id, Counter(t), len(t)) for doc_id, text in docs if (t := terms(text))]
    n_docs, words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item_id, text in items:
        mine = set(terms(text))
        ranked = []
        for doc_id, c, n in held:
            m = 10 + (90 * n * n_docs) // words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in mine
                if c[t]
            )
            if score > 0:
                ranked.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(ranked, key=lambda r: r[:3])[:k], 1):
            out[item_id, rank, doc_id, -score] += 1
    return out


ITEMS = [
    (1, "long word that and onesen"),
    (2, None),
    (2, "... !?"),
    (3, "LONG long, Word!"),
    (None, "a text without an id"),
    (4, "nowhere_to_be found-xyzzy"),
    (5, "é 0 1 2 3"),
    (5, "é 0 1 2 3"),
    (6, "xxx " + "x" * 200_000),
]


@pytest.fixture(scope="module")
def many_items(spark, documents):
    rows = ITEMS + [(100 + i, r["text"][:400]) for i, r in enumerate(documents[:25])]
    df = spark.createDataFrame(rows, "item_id long, text string")
    return df.selectExpr("*", "'a' AS number", "'b' AS doc_id", "'c' AS score", "'d' AS rank").cache()


def found(df):
    return Counter(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect())


@pytest.mark.parametrize(("block", "pairs", "k"), [(512, 512, 10), (7, 3, 2)])
def test_search_equals_plain_one(spark, edge_docs, many_items, monkeypatch, block, pairs, k):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    items = [(r["item_id"], r["text"]) for r in many_items.collect()]
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "PAIRS", pairs)
    assert found(lexical_search.search(edge_docs, many_items, k)) == plain_search(docs, items, k)


def test_search_in_several_passes(spark, edge_docs, many_items, monkeypatch):
    want = found(lexical_search.search(edge_docs, many_items))
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 100_000)
    assert found(lexical_search.search(edge_docs, many_items)) == want


def test_search_of_nothing(spark, edge_docs, no_docs, many_items):
    assert lexical_search.search(no_docs, many_items).count() == 0
    assert lexical_search.search(edge_docs, many_items.where("false")).count() == 0
    assert lexical_search.search(edge_docs, many_items.where("item_id = 2")).count() == 0


def test_pair_bounds_hold_and_skip_more(spark, sf, monkeypatch):
    """No document scores above a block's bound, pair bounds are below sums of maxima, and so more is skipped."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    items = lexical_search._Items([(r["item_id"], r["text"]) for r in rows])
    counted = lexical_search.count_terms(docs, items.vocabulary)
    sums = counted.agg(F.count("*").alias("d"), F.sum("n").alias("w")).first()
    df = np.zeros(len(items.vocabulary), np.int64)
    for r in lexical_search._holding(counted, len(df)).collect():
        df[r["term"]] = r["df"]
    items.weigh(sums["d"], sums["w"], df)
    monkeypatch.setattr(lexical_search, "BLOCK", 16)
    table = counted.coalesce(1).toArrow()

    class Ship:
        value = items

    blocks = [b for b in lexical_search._indexer(Ship)(iter(table.to_batches()))]
    names = ("terms", "starts", "postings", "impacts", "pairs", "joint")
    kinds = (np.uint32, np.uint32, np.uint16, np.int64, np.uint32, np.int64)

    def run(pairs):
        searcher = lexical_search.Searcher(items, 10)
        for b in blocks:
            packed = [np.frombuffer(b.column(n)[0].as_py(), k) for n, k in zip(names, kinds, strict=True)]
            if not pairs:  # every pair at the sum of both maxima: what independent terms give
                most = np.zeros(len(items.vocabulary), np.int64)
                most[packed[0]] = np.maximum.reduceat(packed[3], packed[1][:-1].astype(int))
                packed[4], packed[5] = np.arange(len(items.pairs)), most[items.pairs].sum(axis=1)
            else:
                present, starts, postings, impacts = packed[0], packed[1].astype(int), packed[2], packed[3]
                bounds = searcher.bounds(present, starts, impacts, *packed[4:])
                dense = np.zeros((len(items.vocabulary), 16), np.int64)
                dense[np.repeat(present, np.diff(starts)), postings] = impacts
                for held, (_, begins), bound in ((items.terms, u, x) for u, x in zip(items.units, bounds, strict=True)):
                    for i, t in enumerate(held):
                        assert bound[begins[i] : begins[i + 1]].sum() >= dense[t].sum(axis=0).max()
            searcher.block(b.column("doc_ids")[0].as_py(), *packed)
        return searcher

    joint, single = run(True), run(False)
    assert [[r[0] for r in t] for t in joint.top] == [[r[0] for r in t] for t in single.top]
    assert joint.met <= single.met and joint.added < single.added
