"""Remove passages that an earlier document has, too, found by fixed-block anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.shared import WordHashes, bounded_batches, mixed, runs, utf8, words

#: Words that a task works on at once, and text bytes for each part of the hash space.
SLICE_WORDS, PART_BYTES = 1 << 20, 24 << 20
PACKED = "part int, known boolean, keys binary, counts binary, ids binary, hashes binary, places binary"


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """Remove every word inside a run of ``window`` words that also starts in a document with a smaller doc_id.

    Words are runs of bytes other than space and 0x09 to 0x0D. Three steps, all of them distributed:

    1. Anchors. Non-overlapping blocks of ``(window + 1) // 2`` words of every document are the index, and every
       rolling run of that many words of every document is a probe. A shared run of ``window`` words holds a whole
       block of the one document, and that is a run of the other: so a hash that is an indexed block and occurs in two
       documents is a hit, and whatever is without a hit is done.
    2. Extension. The hits of a document are extended to all runs of ``window`` words around them; neighbouring ones
       make up the maximal exact repeats. The smallest doc_id of every such run is found by its hash: 64 bits, in a
       part chosen by an independent hash.
    3. The words under runs that start in a smaller document are removed.

    Hashes travel packed, one row for a task's slice and part, so an exchange holds four or twelve bytes a word. What a
    task can decide from its own documents (a block that several of them share) it decides there, and sends the hash
    once: a passage that a third of all documents share is a few entries for every slice of a million words, not one
    for every document. No pairs of documents are formed. Parts grow in number with the text, so each stays of a size.

    Returns doc_id, n_words, n_removed, kept_sha256 (the kept words joined by a space) for every row. NULL text has no
    words. A NULL doc_id is no smaller than any and has none smaller: nothing is removed there or on its account.
    Repeated rows (equal id and text) get equal results; rows of one id with other texts don't repeat one another.
    An empty table gives an empty table; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(16, -(-total // PART_BYTES))
    block = (window + 1) // 2
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text"
    )
    named = keyed.where(F.col("doc_id").isNotNull())

    packed = named.mapInArrow(_pack_anchors(block, parts), PACKED)
    hits = packed.groupBy("part").applyInArrow(_anchor_hits, "key long, found binary")
    hits = hits.groupBy("key").agg(F.collect_list("found").alias("found"))
    probed = keyed.join(hits.hint("shuffle_hash"), "key", "left").where(F.col("found").isNotNull())
    packed = probed.mapInArrow(_pack_windows(block, window, parts), PACKED)
    covered = packed.groupBy("part").applyInArrow(_covered, "key long, found binary")
    covered = covered.groupBy("key").agg(F.collect_list("found").alias("found"))
    rows = keyed.join(covered.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "found")
    return rows.mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


class Slice:
    """Some documents' words as one array: hashes, the document of each word, its place there."""

    def __init__(self, rows: list[dict], split: list[list[bytes]], hashes: WordHashes):
        self.rows = rows
        self.keys = np.array([r["key"] for r in rows], np.int64)
        self.ids = np.array([r["doc_id"] for r in rows], np.int64)
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        self.words = np.concatenate([hashes.of(s) for s in split]) if split else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(split)), lengths)
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    def rolling(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words inside a document, and where they start in the slice."""
        hashes = runs(self.words, width)
        start = np.flatnonzero(self.doc[: len(hashes)] == self.doc[width - 1 : width - 1 + len(hashes)])
        return hashes[start], start


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    hashes = WordHashes()
    rows: list[dict] = []
    split: list[list[bytes]] = []
    held = 0
    for batch in batches:
        others = [n for n in batch.schema.names if n != "text"]
        columns = {n: batch.column(n).to_pylist() for n in others}
        for i, raw in enumerate(utf8(batch.column("text"))):
            rows.append({n: columns[n][i] for n in others})
            split.append(words(raw))
            held += len(split[-1])
            if held >= SLICE_WORDS or len(rows) >= 60_000:
                yield Slice(rows, split, hashes)
                rows, split, held = [], [], 0
    if rows:
        yield Slice(rows, split, hashes)


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(hashes) % np.uint64(parts)).astype(np.int32)


def _groups(ordered: np.ndarray) -> np.ndarray:
    """Where groups of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, int)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PACKED.split(", ")]
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _by_part(part, doc, values, slice_, common=None, ids=False, places=None) -> list[tuple]:
    """Rows of packed entries, a row for each part: the documents that have entries there, how many, and the entries."""
    order = np.lexsort((doc, part))
    part, doc, values = part[order], doc[order], values[order]
    places = places[order] if places is not None else None
    shared: dict[int, bytes] = {}
    if common is not None:
        at = np.argsort(common[0], kind="stable")
        own, both = common[0][at], common[1][at]
        begins = np.append(_groups(own), len(own))
        shared = {int(own[a]): both[a:b].tobytes() for a, b in zip(begins, begins[1:], strict=False)}
    begins = np.append(_groups(part), len(part))
    rows = []
    for a, b in zip(begins, begins[1:], strict=False):
        starts = _groups(doc[a:b])
        who = doc[a:b][starts]
        rows.append(
            (
                int(part[a]),
                False,
                slice_.keys[who].tobytes(),
                np.diff(np.append(starts, b - a)).astype(np.uint32).tobytes(),
                # Anchors have no use for ids; their place is taken by hashes that the slice has decided on.
                slice_.ids[who].tobytes() if ids else shared.pop(int(part[a]), b""),
                values[a:b].tobytes(),
                places[a:b].astype(np.uint32).tobytes() if places is not None else None,
            )
        )
    rows += [(p, False, b"", b"", c, b"", None) for p, c in shared.items()]
    return rows


def _known(doc, values, slice_, parts: int) -> list[tuple]:
    """Results that the slice has decided on, a row for some documents, spread over the parts."""
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    starts = np.append(_groups(doc), len(doc))
    rows = []
    for first in range(0, len(starts) - 1, 64):
        edges = starts[first : first + 65]
        a, b = edges[0], edges[-1]
        who = doc[edges[:-1]]
        counts = np.diff(edges).astype(np.uint32)
        part = int(slice_.keys[who[0]] % parts)
        rows.append((part, True, slice_.keys[who].tobytes(), counts.tobytes(), None, values[a:b].tobytes(), None))
    return rows


def _pack_anchors(block: int, parts: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            hashes, start = s.rolling(block)
            order = np.argsort(hashes, kind="stable")
            hashes, start = hashes[order], start[order]
            doc, indexed = s.doc[start], s.place[start] % block == 0
            begins = _groups(hashes)
            if not len(begins):
                continue
            # Once for each hash and document; sorting kept documents in order.
            once = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])
            is_block = np.logical_or.reduceat(indexed, begins)
            many = np.add.reduceat(once.astype(np.int64), begins) > 1
            group = np.cumsum(np.concatenate([[0], hashes[1:] != hashes[:-1]]))
            decided = (is_block & many)[group]
            own = once & ~decided
            part = _part_of(hashes, parts)
            low = (hashes & np.uint64(0x7FFFFFFF)).astype(np.uint32)
            entries = (low << np.uint32(1)) | is_block[group].astype(np.uint32)
            first = np.zeros(len(hashes), bool)
            first[begins] = True
            shared = first & decided
            rows = _by_part(part[own], doc[own], entries[own], s, common=(part[shared], low[shared]))
            yield _packed(rows + _known(doc[once & decided], low[once & decided], s, parts))

    return pack


def _found(key: np.ndarray, values: np.ndarray) -> pa.Table:
    """A row for each key with its values, packed."""
    order = np.argsort(key, kind="stable")
    key, values = key[order], values[order]
    begins = np.append(_groups(key), len(key))
    packed = [values[a:b].tobytes() for a, b in zip(begins, begins[1:], strict=False)]
    return pa.table({"key": pa.array(key[begins[:-1]], pa.int64()), "found": pa.array(packed, pa.binary())})


def _joined(parts: list, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in parts if x), kind)


def _split_known(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows still to decide, and keys and values of those that a slice has decided on."""
    known = table.filter(table.column("known"))
    keys = np.repeat(
        _joined(known.column("keys").to_pylist(), np.int64), _joined(known.column("counts").to_pylist(), np.uint32)
    )
    return table.filter(pa.compute.invert(table.column("known"))), keys, _joined(
        known.column("hashes").to_pylist(), np.uint32
    )


def _anchor_hits(table: pa.Table) -> pa.Table:
    """Hashes of one part that are a block of some document and occur in another, for each document that has them."""
    table, known_key, known = _split_known(table)
    keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
    key = np.repeat(_joined(keys, np.int64), _joined(counts, np.uint32))
    entries = _joined(table.column("hashes").to_pylist(), np.uint32)
    common = _joined(table.column("ids").to_pylist(), np.uint32)
    low, indexed = entries >> np.uint32(1), (entries & np.uint32(1)).astype(bool)
    order = np.lexsort((key, low))
    low, indexed, key = low[order], indexed[order], key[order]
    begins = _groups(low)
    if len(begins):
        once = np.concatenate([[True], (low[1:] != low[:-1]) | (key[1:] != key[:-1])])
        elsewhere = np.isin(low[begins], common)
        is_block = np.logical_or.reduceat(indexed, begins) | elsewhere
        many = (np.add.reduceat(once.astype(np.int64), begins) > 1) | elsewhere
        hit = (is_block & many)[np.cumsum(np.concatenate([[0], low[1:] != low[:-1]]))] & once
        key, low = key[hit], low[hit]
    return _found(np.concatenate([key, known_key]), np.concatenate([low, known]))


def _pack_windows(block: int, window: int, parts: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            anchors, at = s.rolling(block)
            low = (anchors & np.uint64(0x7FFFFFFF)).astype(np.uint32)
            hits = [_joined(r["found"], np.uint32) for r in s.rows]
            # A hit counts for the document that it was found in: compare (document, hash).
            wanted = np.concatenate([h.astype(np.uint64) | np.uint64(i << 32) for i, h in enumerate(hits)])
            hit = np.zeros(len(s.words) + 1, np.int64)
            hit[at[np.isin((s.doc[at].astype(np.uint64) << np.uint64(32)) | low, wanted)]] = 1
            up_to = np.concatenate([[0], np.cumsum(hit)])
            hashes, start = s.rolling(window)
            near = up_to[start + window - block + 1] > up_to[start]
            hashes, start = hashes[near], start[near]
            if not len(hashes):
                continue
            doc, place = s.doc[start], s.place[start]
            order = np.lexsort((place, s.ids[doc], hashes))
            hashes, doc, place = hashes[order], doc[order], place[order]
            begins = _groups(hashes)
            group = np.cumsum(np.concatenate([[0], hashes[1:] != hashes[:-1]]))
            least = s.ids[doc[begins]][group]
            later = s.ids[doc] > least
            rows = _by_part(
                _part_of(hashes[~later], parts), doc[~later], hashes[~later], s, ids=True, places=place[~later]
            )
            yield _packed(rows + _known(doc[later], place[later].astype(np.uint32), s, parts))

    return pack


def _covered(table: pa.Table) -> pa.Table:
    """Starts of the runs of one part that a document with a smaller id has, too."""
    table, known_key, known = _split_known(table)
    counts = _joined(table.column("counts").to_pylist(), np.uint32)
    key = np.repeat(_joined(table.column("keys").to_pylist(), np.int64), counts)
    ids = np.repeat(_joined(table.column("ids").to_pylist(), np.int64), counts)
    hashes = _joined(table.column("hashes").to_pylist(), np.uint64)
    places = _joined(table.column("places").to_pylist(), np.uint32)
    order = np.lexsort((ids, hashes))
    begins = _groups(hashes[order])
    if len(begins):
        group = np.cumsum(np.concatenate([[0], hashes[order][1:] != hashes[order][:-1]]))
        later = order[ids[order] > ids[order][begins][group]]
        key, places = key[later], places[later]
    return _found(np.concatenate([key, known_key]), np.concatenate([places, known]))


def _remove(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, removed, digests = [], [], []
            for raw, found in zip(utf8(batch.column("text")), batch.column("found"), strict=True):
                split = words(raw)
                n = len(split)
                if found.is_valid:
                    starts = _joined(found.as_py(), np.uint32)
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + window, -1)
                    keep = np.cumsum(change[:n]) == 0
                    split = [w for w, k in zip(split, keep.tolist(), strict=True) if k]
                numbers.append(n)
                removed.append(n - len(split))
                digests.append(hashlib.sha256(b" ".join(split)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(numbers), pa.array(removed), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return remove
