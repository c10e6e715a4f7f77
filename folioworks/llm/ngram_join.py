"""Documents whose sets of word n-grams are similar: an exact join by segments of the token universe."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks.llm.graph import components, least_member
from folioworks.llm.packing import batch, groups, joined, part_of, unite
from folioworks.llm.shared import WordHashes, bounded_batches, mixed, runs, stage, utf8

#: Documents of a slice, text bytes for each part of the key space, and members of a block that is verified at once.
SLICE_ROWS, PART_BYTES, BLOCK = 2000, 24 << 20, 512
#: Classes of a key whose pairs are listed; beyond that they meet in blocks.
FEW = 16
#: A key is the number of its segment (so many low bits are left) and a hash of what the document has there.
HASH_BITS = 44
LAST_SLOT = (1 << (63 - HASH_BITS)) - 1
PACKED = "part int, known boolean, members binary, counts binary, keys binary, shared binary"
#: A member: a class in one band, and the keys that it shares at least with any similar set.
MEMBER = np.dtype([("node", np.int64), ("size", np.int32), ("band", np.int32), ("need", np.int32)])
SHARED = "key long, node long, size int, band int, need int"


class Segments:
    """How sets are cut for a threshold of ``percent``.

    Sizes fall into bands. If the smaller of two similar sets is in a band, they differ in at most ``errors`` tokens,
    so of ``errors + 1`` segments of the token universe at least one is equal in both. Segments where a set has
    nothing would be equal in far too many. So there are ``spare`` more segments: with them, at least ``spare + 1`` are
    equal, and a set with no more than ``spare`` empty ones needs no key for those. Only a set with more has them.
    """

    def __init__(self, percent: int, largest: int):
        self.percent, self.edges = percent, [1]
        while self.edges[-1] <= largest:
            self.edges.append(max(self.edges[-1] + 1, -(-self.edges[-1] * 4 // 3)))
        tops = [e - 1 for e in self.edges[1:]]
        self.errors = [top * (100 - percent) // percent for top in tops]
        self.spare = [_spare(e + 1, low) if e else 0 for e, low in zip(self.errors, self.edges, strict=False)]
        self.counts = [e + 1 + s for e, s in zip(self.errors, self.spare, strict=True)]
        self.first_slot = np.cumsum([0, *self.counts]).tolist()

    def bands(self, size: int) -> list[int]:
        """The band of a set and those below that may hold a smaller set similar to it."""
        band = bisect_right(self.edges, size) - 1
        out = [band]
        while band and self.percent * size <= 100 * (self.edges[band] - 1):
            band -= 1
            out.append(band)
        # Without room for a difference only equal sets are similar, and those are one class already.
        return [b for b in out if self.errors[b]]

    def need(self, size: int, band: int, filled: int) -> int:
        """Keys that a set shares in a band with any similar one: all segments that it fills but those that may differ."""
        if size >= self.edges[band + 1]:  # it is the larger one
            differ = (100 - self.percent) * (size + self.edges[band + 1] - 1) // (100 + self.percent)
        else:
            differ = (100 - self.percent) * size // self.percent
        return max(1, filled - differ)

    def cut(self, tokens: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens ordered by segment, and where each segment begins and the last one ends."""
        count = self.counts[band]
        segment = (mixed(tokens ^ np.uint64(band + 1)) % np.uint64(count)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        return tokens[order], np.searchsorted(segment[order], np.arange(count + 1))

    def slots(self, band: int) -> np.ndarray:
        return np.minimum(np.arange(self.first_slot[band], self.first_slot[band + 1]), LAST_SLOT)

    def keys(self, tokens: np.ndarray, band: int) -> np.ndarray:
        """One key for each segment that needs one: its slot and the hash of its tokens."""
        tokens, edges = self.cut(tokens, band)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(tokens))])
        keys = slot_keys(self.slots(band), sums[edges[1:]] - sums[edges[:-1]], self.first_slot[band])
        filled = edges[1:] > edges[:-1]
        return keys[filled] if (~filled).sum() <= self.spare[band] else keys

    def deletions(self, tokens: np.ndarray, band: int, raised: set[int]) -> np.ndarray:
        """Keys of the raised segments, whole and with each one of their tokens left out."""
        tokens, edges = self.cut(tokens, band)
        out = []
        for i, slot in enumerate(self.slots(band).tolist()):
            if slot in raised:  # whatever it holds
                part = mixed(tokens[edges[i] : edges[i + 1]])
                sums = part.sum(dtype=np.uint64) - np.concatenate([[np.uint64(0)], part])
                out.append(slot_keys(np.full(len(sums), slot), sums, self.first_slot[band], np.full(len(sums), i)))
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def _spare(segments: int, tokens: int) -> int:
    """So many more segments that a set of so many tokens hardly ever has more empty ones."""
    spare = 0
    for _ in range(6):
        empty = (segments + spare) * math.exp(-tokens / (segments + spare))
        spare = math.ceil(empty + 3.5 * math.sqrt(empty))
    return spare


def slot_keys(slots: np.ndarray, sums: np.ndarray, first: int, index: np.ndarray | None = None) -> np.ndarray:
    index = np.arange(len(slots)) if index is None else index
    salted = mixed(sums + mixed((index + first).astype(np.uint64)))
    return (slots.astype(np.uint64) << np.uint64(HASH_BITS)) | (salted >> np.uint64(64 - HASH_BITS))


def shingles(raw: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Hashes of the distinct word n-grams, ascending; of a shorter text, of the whole of it."""
    split = raw.lower().split() if raw else []  # bytes: A-Z only
    return np.unique(runs(hashes.of(split), min(width, len(split)))) if split else np.empty(0, np.uint64)


def class_of(tokens: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None


def allocate(segments: Segments, pairs: dict[int, int], per_band: dict[int, int]) -> tuple[set[int], set[int]]:
    """Segments to leave out and, one for each, segments to match with one token missing.

    Matching a segment exactly counts one error for the pigeonhole, leaving it out none, and matching it within one
    deletion two; so the two go together. ``pairs`` are the pairs that share a key in a slot. A swap is made where the
    pairs that it saves outweigh the rows of the deletion neighbourhoods and the pairs that they add.
    The pairs of a key are those that a row would be listed with, at most 15. All swaps together must also save more
    than another pass over the texts costs, which is put at a row for every key.
    """
    dropped: set[int] = set()
    raised: set[int] = set()
    saved, again = 0, sum(sets * segments.counts[band] for band, sets in per_band.items())
    for band, sets in per_band.items():
        slots = [s for s in segments.slots(band).tolist() if s < LAST_SLOT]
        if len(slots) < 2:
            continue
        length = segments.edges[band] / segments.counts[band] + 1
        by_cost = sorted(slots, key=lambda s: (pairs.get(s, 0), s))
        while len(by_cost) >= 2:
            cheap, dear = by_cost[0], by_cost[-1]
            if pairs.get(dear, 0) <= (sets + pairs.get(cheap, 0)) * length:
                break
            raised.add(cheap)
            dropped.add(dear)
            saved += pairs.get(dear, 0)
            by_cost = by_cost[1:-1]
    return (dropped, raised) if saved > again else (set(), set())


def similar_groups(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Join documents whose sets of word n-grams have a Jaccard similarity of ``percent`` / 100 or more, exactly.

    Equal sets are one class. Of each class, the tokens of every size band fall into more segments than similar sets
    can have differences; sets that agree in a segment share a key. Where a segment's keys are much more common than
    the others', it is left out, and a cheap one is matched within one deletion instead (``allocate``). Keys travel
    packed; what a slice of documents shares within itself is sent once.

    Similar sets share not one key but all segments that either fills, less the tokens in which they may differ; a
    class with fewer shared keys than that has no partner and is done. The others are candidates, verified by exact
    intersection sizes. First every class meets the
    class that most of its keys point to, the smallest of each key; groups of such are cut into blocks around it.
    Keys whose classes are in one component by then need nothing more. Of the others, those of few classes give their
    remaining pairs, at most 15 for a row; those of many form clusters, cut into blocks that meet pairwise. So every
    pair that shares a key is compared or already connected. Tasks put out
    spanning links, never the pairs. Components are found by contraction over staged tables.

    n-grams are 64-bit hashes of lower-case (A-Z) words, runs of bytes other than space and 0x09 to 0x0D. Returns
    doc_id, n_shingles, component_id for every row: the smallest doc_id reachable by links. A NULL, empty or blank
    text has no n-grams and links with nothing; a shorter one has its whole sequence as its only n-gram. NULL ids
    are never the smallest. Repeated rows stay; an empty table gives an empty table; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(16, -(-total // PART_BYTES))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    base = stage(keyed.mapInArrow(_sets(width), "doc_id long, key long, n_shingles long, node long"))
    sizes = {r[0]: r[1] for r in base.groupBy("n_shingles").agg(F.count("node")).collect()}
    segments = Segments(percent, max(sizes, default=1))

    shared = _shared_keys(keyed, width, parts, segments, None)
    slot = F.shiftrightunsigned("key", HASH_BITS)
    common = shared.groupBy("key").agg(F.count("*").alias("f")).groupBy(slot.alias("slot"))
    listed = F.sum(F.expr(f"f * (least(f, {FEW}) - 1D) / 2")).alias("n")
    pairs = {r["slot"]: int(r["n"]) for r in common.agg(listed).collect()}
    dropped, raised = allocate(segments, pairs, _per_band(segments, sizes))
    if raised:
        shared = stage(
            shared.where(~slot.isin(sorted(dropped | raised))).unionByName(
                _shared_keys(keyed, width, parts, segments, raised)
            )
        )
    # What a raised segment has in common makes up for the one that was left out, too.
    weight = F.when(slot.isin(sorted(raised)), 2).otherwise(1) if raised else F.lit(1)
    shared = _pruned(shared.withColumn("weight", weight))

    involved = shared.select("node").distinct()
    found = base.groupBy("node").agg(F.min("key").alias("key")).join(involved, "node", "left_semi").select("key")
    texts = keyed.join(found.hint("shuffle_hash"), "key", "left_semi").select("text")
    sets = stage(texts.mapInArrow(_tokens(width), "node long, tokens binary"))

    around, chosen = _around_centers(shared, percent)
    links = stage(_verified(around, sets, percent))
    pairs, clusters = _rest(shared, components(links), chosen, percent)
    for groups_left in (_star_groups(pairs), _blocks(clusters)):
        links = links.unionByName(stage(_verified(groups_left, sets, percent)))
    nodes = base.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    ids = least_member(nodes, components(links), "least")
    return base.join(ids, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _per_band(segments: Segments, sizes: dict[int, int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for size, n in sizes.items():
        for band in segments.bands(size) if size else []:
            out[band] = out.get(band, 0) + n
    return out


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            found = [shingles(raw, width, hashes) for raw in utf8(b.column("text"))]
            sizes, nodes = pa.array(map(len, found), pa.int64()), pa.array(map(class_of, found), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), sizes, nodes], ["doc_id", "key", "n_shingles", "node"]
            )

    return sets


def _tokens(width: int):
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for b in batches:
            found = {class_of(t): t for t in (shingles(raw, width, hashes) for raw in utf8(b.column("text")))}
            rows = [(n, t.tobytes()) for n, t in found.items() if n is not None and n not in seen]
            seen.update(found)
            yield batch("node long, tokens binary", rows)

    return tokens


def _shared_keys(keyed: DataFrame, width: int, parts: int, segments: Segments, raised: set[int] | None) -> DataFrame:
    """key, node, size, band, need of all classes that share a key with another, staged."""
    packed = keyed.select("text").mapInArrow(_pack(width, parts, segments, raised), PACKED)
    shared = packed.groupBy("part").applyInArrow(_in_common, SHARED)
    # A class that is in several slices comes once.
    return stage(shared.distinct())


def _pack(width: int, parts: int, segments: Segments, raised: set[int] | None):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: dict[int, list[tuple[tuple, np.ndarray]]] = {}
        rows = 0
        for b in batches:
            for raw in utf8(b.column("text")):
                tokens = shingles(raw, width, hashes)
                node = class_of(tokens)
                if node is not None and node not in held:
                    held[node] = list(_members(node, tokens, segments, raised))
                rows += 1
                if rows % SLICE_ROWS == 0:
                    yield batch(PACKED, _packed(held, parts))
                    held = {}
        yield batch(PACKED, _packed(held, parts))

    return pack


def _members(node: int, tokens: np.ndarray, segments: Segments, raised: set[int] | None) -> Iterator[tuple]:
    size = len(tokens)
    for band in segments.bands(size):
        edges = segments.cut(tokens, band)[1]
        need = segments.need(size, band, int((edges[1:] > edges[:-1]).sum()))
        if raised is None:
            keys = segments.keys(tokens, band)
        else:
            keys = np.unique(segments.deletions(tokens, band, raised))
        yield (node, size, band, need), keys


def _packed(held: dict[int, list[tuple[tuple, np.ndarray]]], parts: int) -> list[tuple]:
    found = [m for of_node in held.values() for m in of_node]
    if not found:
        return []
    members = np.array([m for m, _ in found], MEMBER)
    keys = np.concatenate([k for _, k in found])
    who = np.repeat(np.arange(len(members)), [len(k) for _, k in found])
    order = np.argsort(keys, kind="stable")
    keys, who = keys[order], who[order]
    begins = groups(keys)
    if not len(begins):
        return []
    first = np.zeros(len(keys), bool)
    first[begins] = True
    many = np.diff(np.append(begins, len(keys))) > 1
    part = part_of(keys, parts)
    common = keys[begins][many]
    by_part = _split(part_of(common, parts), common)
    rows = [
        (p, False, members[w].tobytes(), n, k, by_part.pop(p, b""))
        for p, w, n, k in _entries(part[first], who[first], keys[first])
    ]
    rows += [(p, False, b"", b"", b"", c) for p, c in by_part.items()]
    # All others of a key that the slice has several of are known to share it.
    spread = (who[~first] % parts).astype(np.int32)
    rows += [
        (p, True, members[w].tobytes(), n, k, b"") for p, w, n, k in _entries(spread, who[~first], keys[~first])
    ]
    return rows


def _split(part: np.ndarray, values: np.ndarray) -> dict[int, bytes]:
    order = np.argsort(part, kind="stable")
    part, values = part[order], values[order]
    begins = np.append(groups(part), len(part))
    return {int(part[a]): values[a:b].tobytes() for a, b in zip(begins, begins[1:], strict=False)}


def _entries(part: np.ndarray, who: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, bytes, bytes]]:
    """For each part: the members that have keys there, how many each, and the keys."""
    order = np.lexsort((who, part))
    part, who, keys = part[order], who[order], keys[order]
    begins = np.append(groups(part), len(part))
    for a, b in zip(begins, begins[1:], strict=False):
        starts = groups(who[a:b])
        counts = np.diff(np.append(starts, b - a)).astype(np.uint32)
        yield int(part[a]), who[a:b][starts], counts.tobytes(), keys[a:b].tobytes()


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    counts = joined(table.column("counts").to_pylist(), np.uint32)
    members = np.repeat(joined(table.column("members").to_pylist(), MEMBER), counts)
    return joined(table.column("keys").to_pylist(), np.uint64), members


def _in_common(table: pa.Table) -> pa.Table:
    known_key, known = _unpacked(table.filter(table.column("known")))
    key, members = _unpacked(table.filter(pa.compute.invert(table.column("known"))))
    common = joined(table.column("shared").to_pylist(), np.uint64)
    order = np.lexsort((members["node"], key))
    key, members = key[order], members[order]
    begins = groups(key)
    if len(begins):
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        last = np.append(begins[1:], len(key)) - 1
        several = members["node"][begins] != members["node"][last]
        keep = (several | np.isin(key[begins], common))[group]
        key, members = key[keep], members[keep]
    key, members = np.concatenate([key, known_key]), np.concatenate([members, known])
    columns = {name: np.ascontiguousarray(members[name]) for name in MEMBER.names}
    return pa.table({"key": key.view(np.int64), **columns})


def _pruned(shared: DataFrame) -> DataFrame:
    """Without members that share fewer keys than a similar set would need, and then without lone keys."""
    for _ in range(2):
        enough = shared.groupBy("node", "band").agg(F.sum("weight").alias("n"), F.max("need").alias("need"))
        enough = enough.where(F.col("n") >= F.col("need")).select("node", "band")
        shared = stage(shared.join(enough, ["node", "band"], "left_semi").select(*shared.columns))
        several = shared.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
        several = several.where(F.col("low") != F.col("high")).select("key")
        shared = stage(shared.join(several, "key", "left_semi").select(*shared.columns))
    return shared


def _fit(a, b, percent: int):
    """Sizes that a similarity allows."""
    return F.lit(percent) * F.greatest(a, b) <= F.lit(100) * F.least(a, b)


def _around_centers(shared: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Groups (super, group, node, side) of a center and some of its members, and the pairs (center, node) chosen."""
    center = shared.groupBy("key").agg(F.min("node").alias("center"))
    sized = shared.groupBy("node").agg(F.max("size").alias("center_size")).withColumnRenamed("node", "center")
    pairs = shared.join(center, "key").where(F.col("node") != F.col("center"))
    pairs = pairs.groupBy("center", "node", "size").agg(F.count("*").alias("keys")).join(sized, "center")
    pairs = pairs.where(_fit(F.col("size"), F.col("center_size"), percent))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("keys"), "center"))
    chosen = stage(pairs.withColumn("best", best).where(F.col("best") == 1).select("center", "node"))
    return _star_groups(chosen), chosen


def _star_groups(pairs: DataFrame) -> DataFrame:
    """Groups (super, group, node, side) of a center and a block of the members that are to meet it."""
    held = pairs.groupBy("center").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    members = pairs.join(held, "center").select("center", "n", "node", block.cast("int").alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    centers = held.select("center", "n", F.col("center").alias("node"), every)
    rows = members.unionByName(centers)
    return _packed_groups(rows.select(F.xxhash64("center", "block").alias("group"), "n", "node", F.lit(0).alias("side")))


def _packed_groups(rows: DataFrame) -> DataFrame:
    """Some hundred small groups go to one task call; a large one has its own."""
    few = F.greatest(F.lit(1), F.lit(rows.sparkSession.sparkContext.defaultParallelism * 64))
    own = F.when(F.col("n") > 8, F.col("group")).otherwise(F.pmod("group", few.cast("long")))
    return rows.select(own.alias("super"), "group", "node", "side")


def _rest(
    shared: DataFrame, labels: DataFrame, chosen: DataFrame, percent: int
) -> tuple[DataFrame, DataFrame]:
    """What keys still join several components: pairs (center, node) of small keys, clusters (cluster, node) of others."""
    rows = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = rows.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")
    )
    open_keys = open_keys.where(F.col("low") != F.col("high")).select("key", "n")
    rows = rows.join(open_keys, "key")
    # What a member has in keys of many classes is all that pairs without a key of few can share.
    held = rows.groupBy("node", "band").agg(
        F.sum(F.when(F.col("n") > FEW, F.col("weight")).otherwise(0)).alias("in_many")
    )
    rows = stage(rows.join(held, ["node", "band"]))

    few = rows.where(F.col("n") <= FEW)
    other = few.select("key", *[F.col(c).alias(f"_{c}") for c in ("node", "component", "size", "need", "in_many")])
    pairs = few.join(other, "key").where(F.col("_node") < F.col("node")).where(F.col("component") != F.col("_component"))
    pairs = pairs.where(_fit(F.col("size"), F.col("_size"), percent))
    pairs = pairs.groupBy(F.col("_node").alias("center"), "node", "band").agg(
        F.sum("weight").alias("keys"),
        F.max(F.greatest("need", "_need")).alias("need"),
        F.max(F.least("in_many", "_in_many")).alias("more"),
    )
    pairs = pairs.where(F.col("keys") + F.col("more") >= F.col("need")).select("center", "node").distinct()
    done = chosen.select(F.least("center", "node").alias("center"), F.greatest("center", "node").alias("node"))
    pairs = stage(pairs.join(done, ["center", "node"], "left_anti"))

    many = rows.where((F.col("n") > FEW) & (F.col("in_many") >= F.col("need")))
    least = many.groupBy("key").agg(F.min("node").alias("a"))
    many = many.join(least, "key").select("a", F.col("node").alias("b")).distinct()
    clusters = components(many).select("node", F.col("component").alias("cluster"))
    return pairs, clusters


def _blocks(rest: DataFrame) -> DataFrame:
    """Each cluster's blocks, pairwise: every two of its members are in one group."""
    held = rest.groupBy("cluster").agg(F.count("*").alias("n"))
    rows = rest.join(held, "cluster").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first, second = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(first == second, 0).when(F.col("block") == first, 1).otherwise(2)
    return _packed_groups(rows.select(F.xxhash64("cluster", first, second).alias("group"), "n", "node", side.alias("side")))


def _verified(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that span what is linked in each group."""

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("group", "ascending"), ("node", "ascending")])
        group, node = table.column("group").to_numpy(), table.column("node").to_numpy()
        side, tokens = table.column("side").to_numpy(), table.column("tokens").to_pylist()
        begins = np.append(groups(group), len(group))
        a, b = [], []
        for i, j in zip(begins, begins[1:], strict=False):
            sets_here = [np.frombuffer(t, np.uint64) for t in tokens[i:j]]
            x, y = similar_pairs(sets_here, side[i:j], percent)
            parent = np.arange(j - i)
            unite(parent, x, y)
            linked = np.flatnonzero(parent != np.arange(j - i))
            a.append(node[i:j][linked])
            b.append(node[i:j][parent[linked]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return members.join(sets, "node").groupBy("super").applyInArrow(verify, "a long, b long")


def similar_pairs(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of similar sets: of side 0 with each other, of sides 1 and 2 across."""
    sizes = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, who = values[order], who[order]
    begins = groups(values)
    lengths = np.diff(np.append(begins, len(values)))
    several = np.repeat(lengths > 1, lengths)
    column = np.repeat(np.cumsum(lengths > 1) - 1, lengths)[several]
    who = who[several]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    step = max(1, min(width, (1 << 22) // max(1, len(sets))))
    for at in range(0, width, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        dense = np.zeros((len(sets), step), np.float32)
        dense[who[lo:hi], column[lo:hi] - at] = 1
        common += dense @ dense.T
    common = common.astype(np.int64)
    union = sizes[:, None] + sizes - common
    similar = 100 * common >= percent * union
    across = ((side[:, None] == 0) & (side == 0)) | ((side[:, None] == 1) & (side == 2))
    a, b = np.nonzero(similar & across)
    different = a != b
    return a[different], b[different]
