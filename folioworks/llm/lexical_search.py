"""Ranked lexical search with bounds for terms and for pairs of terms."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks.llm.shared import bounded_batches, stage, text_bytes, utf8

#: Documents of an index block, pairs that are intersected at a time, and bytes of items that are searched together.
BLOCK, PAIRS, ITEM_BYTES = 512, 512, 16 << 20
#: Bytes of terms: digits, letters (A-Z as a-z) and whatever is no ASCII; all others become spaces.
_TERM_BYTES = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def terms(raw: bytes | None) -> list[bytes]:
    """Maximal runs of term characters of a UTF-8 text, A-Z lower-cased."""
    return raw.translate(_TERM_BYTES).split() if raw else []


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents with the highest scores for the text of every item.

    With N documents that hold a term, L terms in them, n in this one, df documents that hold a term and tf occurrences
    of it here: a term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))), a document has m = 10 + (90 n N) div L, and
    each term of the item adds w * ((10**9 tf) div (1000 tf + 8 m)) once.

    One scan counts the items' terms in every whole text and stages what it found. A second job turns that into an
    index of blocks of 512 documents with their postings, the largest impact of every term, and for pairs of terms that
    items have next to each other the largest joint impact in the intersection of their lists (``build_index``). The
    search reads the index once. The score of a document is at most the sum over single terms and disjoint pairs of
    what these can add; a pair adds at most its joint impact, or what one of both adds alone, which is far less than
    both maxima where rare terms seldom meet. Blocks below an item's k-th best score so far are skipped, and in others
    only documents of the essential units are met (``Searcher``). Each task puts out k rows an item, and they are
    ranked in one more exchange.

    Nothing is grouped by term, so frequent terms are no group. Items travel with the tasks, 16 MB at a time: more are
    searched in several passes over the texts, for any number of items.

    Returns item_id, rank (from 1), doc_id, score for scores above 0, the smaller doc_id first for equal scores (NULL
    ids last). Every row of ``docs`` and ``items`` counts as a document or an item of its own, repeated ones included.
    A text that is NULL or has no term is no document and finds nothing. Empty tables give no rows; other columns are
    not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    numbered = items.select("item_id", "text").withColumn("number", F.monotonically_increasing_id())
    numbered = stage(numbered)
    volume = numbered.agg(F.sum(text_bytes(F.col("text")))).first()[0] or 0
    passes = 1 + volume // ITEM_BYTES
    found = None
    for at in range(passes):
        some = numbered.where(F.pmod(F.xxhash64("number"), F.lit(passes)) == at) if passes > 1 else numbered
        top = _top(docs, _Items([(r["number"], r["text"]) for r in some.collect()]), k)
        found = top if found is None else found.unionByName(top)
    ranked = found.join(numbered.select("number", "item_id"), "number")
    return ranked.select("item_id", "rank", "doc_id", "score")


def _top(docs: DataFrame, items: _Items, k: int) -> DataFrame:
    spark = docs.sparkSession
    counted = count_terms(docs, items.vocabulary)
    sums = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    df = np.zeros(len(items.vocabulary), np.int64)
    for r in _holding(counted, len(df)).collect():  # a row for each term of the items
        df[r["term"]] = r["df"]
    items.weigh(sums["docs"], sums["words"] or 0, df)
    ship = spark.sparkContext.broadcast(items)
    index = build_index(counted, ship)
    kind = dict(docs.dtypes)["doc_id"]
    best = index.mapInArrow(_searcher(ship, k), f"number long, doc_id {kind}, score long")
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def count_terms(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, number of terms n, and numbers and occurrences of the vocabulary's terms, of all documents with terms."""
    ship = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", "text").mapInArrow(
        _counter(ship), f"doc_id {kind}, n long, terms binary, times binary"
    )
    return stage(found)


def _counter(ship):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(ship.value)}
        for batch in batches:
            rows, n, held, times = [], [], [], []
            for row, raw in enumerate(utf8(batch.column("text"))):
                split = terms(raw)
                if not split:
                    continue
                found = Counter(map(number.get, split))
                found.pop(None, None)
                rows.append(row)
                n.append(len(split))
                held.append(np.fromiter(found.keys(), np.uint32, len(found)).tobytes())
                times.append(np.fromiter(found.values(), np.uint32, len(found)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(n, pa.int64()),
                    pa.array(held, pa.binary()),
                    pa.array(times, pa.binary()),
                ],
                ["doc_id", "n", "terms", "times"],
            )

    return counted


def _holding(counted: DataFrame, n_terms: int) -> DataFrame:
    """term, df: documents that hold each term."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.uint32)
            df += np.bincount(found, minlength=n_terms)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])

    rows = counted.select("terms").mapInArrow(held, "term long, df long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"))


class _Items:
    """Items as numbers of terms, heaviest first, and the pairs of neighbours that the index knows joint impacts of.

    ``units[0]`` pairs the first with the second term, the third with the fourth and so on; ``units[1]`` leaves the
    first alone and pairs the second with the third. Both are partitions of an item's terms, so either gives a bound.
    """

    def __init__(self, rows: list[tuple[int, str | None]]):
        split = [(number, set(terms(None if text is None else text.encode()))) for number, text in rows]
        self.vocabulary = sorted(set().union(*(t for _, t in split)))
        place = {t: i for i, t in enumerate(self.vocabulary)}
        self.items = [(number, sorted(place[t] for t in held)) for number, held in split if held]

    def weigh(self, docs: int, words: int, df: np.ndarray) -> None:
        self.docs, self.words = docs, words
        self.weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        present = df > 0
        self.numbers, self.terms = [], []
        for number, held in self.items:
            held = sorted((t for t in held if present[t] and self.weights[t] > 0), key=lambda t: (-self.weights[t], t))
            if held:
                self.numbers.append(number)
                self.terms.append(np.array(held))
        n_terms = len(self.vocabulary)
        keys = [np.minimum(t[:-1], t[1:]) * n_terms + np.maximum(t[:-1], t[1:]) for t in self.terms]
        found = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        self.pairs = np.column_stack([found // n_terms, found % n_terms]) if n_terms else np.empty((0, 2), np.int64)
        # Units (first term, second term, pair) of all items in a row; what a unit lacks is one behind the last.
        self.units = [self._units(keys, found, start) for start in (0, 1)]

    def _units(self, keys: list[np.ndarray], found: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        rows, begins = [], [0]
        for held, key in zip(self.terms, keys, strict=True):
            alone = [held[0]] if start else []
            alone += [held[-1]] if (len(held) - start) % 2 else []
            rows += [(t, len(self.vocabulary), len(found)) for t in alone]
            for i in range(start, len(held) - 1, 2):
                rows.append((held[i], held[i + 1], np.searchsorted(found, key[i])))
            begins.append(len(rows))
        return np.array(rows, np.int64).reshape(-1, 3), np.array(begins)

    def impacts(self, term: np.ndarray, times: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What postings add to the score of their documents."""
        m = 10 + (90 * n * self.docs) // self.words
        return self.weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m))


INDEX = "terms binary, starts binary, postings binary, impacts binary, pairs binary, joint binary"


def build_index(counted: DataFrame, ship) -> DataFrame:
    """Blocks of documents in order of doc_id: postings by term, and largest joint impacts of pairs that meet.

    Terms, starts: the block's terms and where their postings begin. Postings, impacts: places of documents in the
    block and what they gain. Pairs, joint: pairs whose lists intersect, and the largest sum of both impacts there.
    """
    kind = dict(counted.dtypes)["doc_id"]
    return stage(counted.mapInArrow(_indexer(ship), f"doc_ids array<{kind}>, {INDEX}"))


def _indexer(ship):
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, BLOCK - rows)
                held.append(some)
                rows, batch = rows + some.num_rows, batch.slice(some.num_rows)
                if rows == BLOCK:
                    yield _block(pa.Table.from_batches(held), ship.value)
                    held, rows = [], 0
        if rows:
            yield _block(pa.Table.from_batches(held), ship.value)

    return indexed


def _block(rows: pa.Table, items: _Items) -> pa.RecordBatch:
    rows = rows.sort_by("doc_id")  # NULL last
    held = [np.frombuffer(x, np.uint32) for x in rows.column("terms").to_pylist()]
    sizes = [len(x) for x in held]
    term = np.concatenate(held).astype(np.int64)
    times = np.frombuffer(b"".join(rows.column("times").to_pylist()), np.uint32).astype(np.int64)
    place = np.repeat(np.arange(len(sizes)), sizes)
    impacts = items.impacts(term, times, rows.column("n").to_numpy()[place])
    keep = np.flatnonzero(impacts > 0)
    keep = keep[np.argsort(term[keep], kind="stable")]
    term, place, impacts = term[keep], place[keep], impacts[keep]
    present, starts = np.unique(term, return_index=True)
    starts = np.append(starts, len(term))
    pairs, joint = _intersections(items.pairs, present, starts, place, impacts, len(sizes), len(items.vocabulary))
    packed = [
        present.astype(np.uint32),
        starts.astype(np.uint32),
        place.astype(np.uint16),
        impacts,
        pairs.astype(np.uint32),
        joint,
    ]
    ids = pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), rows.column("doc_id").combine_chunks())
    columns = [ids, *(pa.array([x.tobytes()], pa.binary()) for x in packed)]
    return pa.RecordBatch.from_arrays(columns, ["doc_ids", *(c.split()[0] for c in INDEX.split(", "))])


def _intersections(pairs, present, starts, place, impacts, n_docs: int, n_terms: int):
    """Pairs of terms that share a document of the block, and their largest joint impact."""
    at = np.full(n_terms, -1)
    at[present] = np.arange(len(present))
    both = np.flatnonzero((at[pairs] >= 0).all(axis=1))
    found, joint = [], []
    for low in range(0, len(both), PAIRS):
        some = both[low : low + PAIRS]
        used, where = np.unique(at[pairs[some]], return_inverse=True)
        rows = np.zeros((len(used), n_docs), np.int64)
        sizes = starts[used + 1] - starts[used]
        posting = np.repeat(starts[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        rows[np.repeat(np.arange(len(used)), sizes), place[posting]] = impacts[posting]
        first, second = rows[where.reshape(-1, 2)[:, 0]], rows[where.reshape(-1, 2)[:, 1]]
        best = np.where((first > 0) & (second > 0), first + second, 0).max(axis=1)
        found.append(some[best > 0])
        joint.append(best[best > 0])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(joint)


def _searcher(ship, k: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(ship.value, k)
        kind = None
        for batch in batches:
            kind = batch.column("doc_ids").type.value_type
            for i in range(batch.num_rows):
                searcher.block(
                    batch.column("doc_ids")[i].as_py(),
                    *(
                        np.frombuffer(batch.column(name)[i].as_py(), dtype)
                        for name, dtype in zip(
                            ("terms", "starts", "postings", "impacts", "pairs", "joint"),
                            (np.uint32, np.uint32, np.uint16, np.int64, np.uint32, np.int64),
                            strict=True,
                        )
                    ),
                )
        rows = [(ship.value.numbers[i], d, s) for i, top in enumerate(searcher.top) for s, _, _, d in top]
        number, doc, score = zip(*rows, strict=True) if rows else [()] * 3
        if kind is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int64()), pa.array(doc, kind), pa.array([-s for s in score], pa.int64())],
                ["number", "doc_id", "score"],
            )

    return searched


class Searcher:
    """The k best documents of every item over the blocks seen so far."""

    def __init__(self, items: _Items, k: int):
        self.items, self.k = items, k
        self.top: list[list[tuple]] = [[] for _ in items.numbers]  # (-score, id is NULL, id or 0, id), best first
        self.least = np.ones(len(items.numbers), np.int64)  # a score below this can't be among the k best
        #: Blocks that an item met, of all; documents that were added to by way of essential terms.
        self.met, self.all, self.added = 0, 0, 0

    def bounds(self, present, starts, impacts, pairs, joint) -> list[np.ndarray]:
        """What every unit of both partitions can add in this block."""
        most = np.zeros(len(self.items.vocabulary) + 1, np.int64)
        most[present] = np.maximum.reduceat(impacts, starts[:-1]) if len(impacts) else 0
        together = np.zeros(len(self.items.pairs) + 1, np.int64)
        together[pairs] = joint
        out = []
        for units, _ in self.items.units:
            a, b, pair = units.T
            out.append(np.maximum(np.maximum(most[a], most[b]), together[pair]))
        return out

    def block(self, doc_ids, present, starts, postings, impacts, pairs, joint) -> None:
        starts = starts.astype(np.int64)
        if not len(self.least) or not len(impacts):
            return
        bounds = self.bounds(present, starts, impacts, pairs, joint)
        sums = [np.add.reduceat(b, begins[:-1]) for b, (_, begins) in zip(bounds, self.items.units, strict=True)]
        at = np.full(len(self.items.vocabulary) + 1, len(present))
        at[present] = np.arange(len(present))
        starts = np.append(starts, starts[-1])  # an absent term has no postings
        self.all += len(self.least)
        for i in np.flatnonzero(np.minimum(*sums) >= self.least).tolist():
            self.met += 1
            way = int(sums[1][i] < sums[0][i])
            units, begins = self.items.units[way]
            mine = slice(begins[i], begins[i + 1])
            self._item(i, doc_ids, at[units[mine, :2]], bounds[way][mine], starts, postings, impacts)

    def _item(self, i: int, doc_ids, units, bounds, starts, postings, impacts) -> None:
        """Units that together can't lift a document to the k best are not essential: others must name it first."""
        order = np.argsort(bounds, kind="stable")
        summed = np.cumsum(bounds[order])
        least = int(self.least[i])
        essential = int(np.searchsorted(summed, least, side="left"))
        score = np.zeros(len(doc_ids), np.int64)
        for unit in order[essential:]:
            for t in units[unit]:
                span = slice(starts[t], starts[t + 1])
                score[postings[span]] += impacts[span]
                self.added += span.stop - span.start
        rest = int(summed[essential - 1]) if essential else 0
        docs = np.flatnonzero((score > 0) & (score + rest >= least))
        for unit in order[:essential][::-1]:
            if not len(docs):
                return
            rest -= int(bounds[unit])
            for t in units[unit]:
                span = slice(starts[t], starts[t + 1])
                if span.stop > span.start:
                    place = np.searchsorted(postings[span], docs)
                    place[place == span.stop - span.start] = 0
                    hit = postings[span][place] == docs
                    score[docs[hit]] += impacts[span][place[hit]]
            docs = docs[score[docs] + rest >= least]
        if not len(docs):
            return
        best = docs[np.lexsort((docs, -score[docs]))[: self.k]]  # places are in order of doc_id
        new = [(-int(score[d]), doc_ids[d] is None, 0 if doc_ids[d] is None else doc_ids[d], doc_ids[d]) for d in best]
        merged = sorted(self.top[i] + new, key=lambda r: r[:2] if r[1] else r[:3])[: self.k]
        self.top[i] = merged
        if len(merged) == self.k:
            self.least[i] = max(1, -merged[-1][0])

