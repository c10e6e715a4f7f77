"""Best-fit packing of token sequences by a linear grouping scheme."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks.llm.shared import bounded_batches, stage
from folioworks.llm.token_counts import pieces, splits_at_spaces, white_edge

#: Ways to group that are tried: a length is large above this part of the capacity; number of groups of large lengths.
GROUPINGS = ((1 / 6, 48), (1 / 4, 100), (1 / 3, 200), (1 / 2, 64))
#: Pieces of text whose ids a worker remembers (some 60 MB), and texts that are joined at a time.
MOST_PIECES, TEXTS = 400_000, 200


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Encode every text, and pack the token ids into few sequences of at most ``capacity`` ids.

    A document is its ids followed by ``end_id``. Longer ones are cut into pieces of ``capacity`` ids, of which the
    first may be shorter; no other document is cut.

    Only the number of pieces of each length decides how they are packed, so the plan is made on the driver from at
    most ``capacity`` counts, whatever the size of the table (``plan``): large lengths are put into groups of equal
    cardinality and rounded up, few-size configurations are optimised, the actual lengths are substituted, and what is
    small fills the room that is left by best fit. A piece then finds its place by its number among the pieces of its
    length. Tasks number their own pieces as they encode them, and the counts of each task and length are summed up, so
    neither a sort nor an exchange of pieces is needed and a length that a third of all pieces has is no group.

    The pieces with their ids are staged in the shared folder. The plan, some thousand rows, travels with the tasks,
    as does ``tokenizer_file`` (``.json``, a few MB).

    Returns doc_id, piece (from 0), start (ids of the document before the piece), length, ids (little-endian unsigned
    32-bit), sequence_id (from 0, without gaps), offset (from 0, without gaps in a sequence). A NULL or empty text is
    ``end_id`` alone. Repeated rows and ids are documents of their own, NULL ids stay, an empty table gives an empty
    table; other columns are not read. Which of several pieces of one length goes where depends on the layout of the
    table; the number of sequences doesn't.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(Path(tokenizer_file).read_bytes())
    kind = dict(docs.dtypes)["doc_id"]
    cut = docs.select("doc_id", "text").mapInArrow(
        _cutter(model, capacity, end_id),
        f"doc_id {kind}, piece int, start long, length long, ids binary, nth long",
    )
    cut = stage(cut.withColumn("part", F.spark_partition_id()))
    counts = stage(cut.groupBy("length", "part").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    place = spark.sparkContext.broadcast(plan(histogram, capacity).places())
    numbered = cut.join(firsts, ["length", "part"]).withColumn("nth", F.col("nth") + F.col("first"))
    columns = f"doc_id {kind}, piece int, start long, length long, ids binary"
    return numbered.select("doc_id", "piece", "start", "length", "ids", "nth").mapInArrow(
        _placer(place), f"{columns}, sequence_id long, offset long"
    )


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids, and doc_ids and starts of their pieces, in order."""
    piece = F.struct("offset", "doc_id", "start", "ids", "length")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return rows.select(
        "sequence_id",
        F.aggregate("p.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"),
        F.unhex(F.array_join(F.transform("p.ids", F.hex), "")).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.offset").alias("offsets"),
    )


def encoder(model: bytes) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids, without added special tokens, truncation or padding."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
    tokenizer = Tokenizer.from_str(model.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def whole(texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    if not splits_at_spaces(tokenizer):
        return whole
    return Pieces(whole, tokenizer).encode


#: Pieces of which every library splits units alike: ASCII but angle brackets, line ends inside, letters of Latin-1.
_PLAIN = re.compile(r"[!-;=?-~À-ÖØ-öø-ÿ]+(?:\n+[!-;=?-~À-ÖØ-öø-ÿ]+)*")


class Pieces:
    """Ids of texts put together from those of their pieces, each encoded once.

    A piece begins at a lone space (``token_counts.pieces``). The pattern of byte-level tokenizers begins a unit there,
    and merges never cross units, so the ids of a text are those of its pieces in a row. New plain pieces are encoded
    as one text with the vocabulary's ranks, if the tokenizer merges in their order (``ranks``), and cut apart by the
    numbers of bytes that ids stand for; all others are left to the tokenizer.
    """

    def __init__(self, whole: Callable[[list[str]], list[bytes]], tokenizer):
        self.whole = whole
        self.known: dict[str, bytes] = {}  # by the characters behind the space
        spec = json.loads(tokenizer.to_str())
        found = ranks(spec)
        # A plain piece has no part of a special string.
        if found is None or any(_PLAIN.search(t["content"][:1] + t["content"][-1:]) for t in spec["added_tokens"]):
            self.row = None
            return
        import public_tokenizers
        import tiktoken

        self.row = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})
        self.n_bytes = np.zeros(max(found.values()) + 1, np.int64)
        for token, number in found.items():
            self.n_bytes[number] = len(token)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [ids for at in range(0, len(texts), TEXTS) for ids in self._some(texts[at : at + TEXTS])]

    def _some(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        cuts = [t.split(" ") for t in texts]
        firsts, cuts = [c[0] for c in cuts], [c[1:] for c in cuts]
        new = set().union(*cuts).difference(self.known)
        if self.row is not None:
            plain = [p for p in new if _PLAIN.fullmatch(p)]
            self.known.update(zip(plain, self._row(plain), strict=True))
            new.difference_update(plain)
        odd = set(filter(white_edge, new))  # never known: a space beside other white space begins no piece
        for i, first in enumerate(firsts):
            if white_edge(first) or not odd.isdisjoint(cuts[i]):
                firsts[i], *others = pieces(texts[i]) or [""]
                cuts[i] = [p[1:] for p in others]
        if odd:
            new = set().union(*cuts).difference(self.known)
        self.known.update(zip(new, self.whole([" " + p for p in new]), strict=True))
        found = zip(self.whole(firsts), cuts, strict=True)
        return [first + b"".join(map(self.known.__getitem__, c)) for first, c in found]

    def _row(self, plain: list[str]) -> list[bytes]:
        """Ids of pieces with a space in front, cut out of those of one text."""
        if not plain:
            return []
        text = " " + " ".join(plain)
        ids = self.row.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        begins = np.flatnonzero(np.frombuffer(text.encode() + b" ", np.uint8) == ord(" "))
        ends = (4 * (np.searchsorted(np.cumsum(self.n_bytes[ids]), begins[1:]) + 1)).tolist()
        joined = ids.tobytes()
        return [joined[start:end] for start, end in zip([0, *ends[:-1]], ends, strict=True)]


def ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes and id of every token of a byte-level BPE vocabulary, or None if it doesn't merge in order of ids."""
    model = spec["model"]
    plain = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")]
    if model.get("type") != "BPE" or any(plain) or model.get("ignore_merges"):
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    others = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(m)) for m in merges]
    if made != list(range(len(byte_of), len(byte_of) + len(merges))):
        return None
    names = [*byte_of, *map("".join, merges)]
    if any(n not in model["vocab"] for n in names):
        return None
    return {bytes(byte_of[c] for c in n): model["vocab"][n] for n in names}


#: A worker process builds the encoder of a tokenizer file once.
_ENCODERS: dict[bytes, Callable[[list[str]], list[bytes]]] = {}


def _cutter(model, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = hashlib.sha256(model.value).digest()
        if version not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[version] = encoder(model.value)
        end = np.array([end_id], "<u4").tobytes()
        counted = [0] * (capacity + 1)
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for row, ids in enumerate(_ENCODERS[version](texts)):
                ids += end
                total, start, piece = len(ids) // 4, 0, 0
                length = total % capacity or capacity
                while start < total:
                    rows.append((row, piece, start, length, ids[4 * start : 4 * (start + length)], counted[length]))
                    counted[length] += 1
                    start, piece, length = start + length, piece + 1, capacity
            row, piece, start, length, ids, nth = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(nth, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids", "nth"],
            )

    return cut


_SHIFT = 46  # places are found by length * 2**46 + number of the piece among those of its length


def _placer(place):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length_of, first, per, sequence, offset = place.value
        keys = (length_of << _SHIFT) + first
        for batch in batches:
            length, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            at = np.searchsorted(keys, (length << _SHIFT) + nth, side="right") - 1
            ahead = nth - first[at]
            found = [sequence[at] + ahead // per[at], offset[at] + ahead % per[at] * length]
            columns = [*batch.columns[:-1], *map(pa.array, found)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    return find


@dataclass
class Run:
    """``times`` sequences alike: how many pieces of which lengths each holds, and the room that is left."""

    times: int
    free: int
    items: list[tuple[int, int]]  # (length, number in each sequence)

    def part(self, times: int) -> Run:
        self.times -= times
        return Run(times, self.free, list(self.items))

    def add(self, length: int, number: int) -> None:
        self.free -= length * number
        self.items.append((length, number))


@dataclass
class Plan:
    runs: list[Run]

    @property
    def sequences(self) -> int:
        return sum(r.times for r in self.runs)

    def places(self) -> tuple[np.ndarray, ...]:
        """For runs of pieces of one length: length, first number, pieces a sequence, first sequence, offset."""
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for run in self.runs:
            offset = 0
            for length, number in run.items:
                rows.append((length, used.get(length, 0), number, sequence, offset))
                used[length] = used.get(length, 0) + number * run.times
                offset += length * number
            sequence += run.times
        return tuple(np.array(sorted(rows), np.int64).reshape(-1, 5).T.copy())


def plan(histogram: np.ndarray, capacity: int) -> Plan:
    """The plan with the fewest sequences among those that the groupings give."""
    plans = [_plan(histogram, capacity, int(capacity * part), groups) for part, groups in GROUPINGS]
    return min(plans, key=lambda p: p.sequences)


def _plan(histogram: np.ndarray, capacity: int, small: int, groups: int) -> Plan:
    left = histogram.copy()
    runs = [Run(int(left[capacity]), 0, [(capacity, 1)])] if left[capacity] else []
    left[capacity] = 0
    stretches = grouped(left, small, groups)
    if stretches:
        sizes = np.array([lengths[0][0] for lengths in stretches])
        demand = np.array([sum(n for _, n in lengths) for lengths in stretches])
        for times, pattern in configurations(sizes, demand, capacity):
            runs.extend(_substituted(times, pattern, stretches, left, capacity))
    best_fit(runs, left, capacity)
    return Plan(runs)


def grouped(histogram: np.ndarray, small: int, groups: int) -> list[list[list[int]]]:
    """Lengths above ``small``, longest first, in stretches of equal cardinality: lists of [length, number].

    The first length of a stretch is what all its pieces are rounded up to; stretches rounded to one size are one. So
    few lengths that each can have a stretch need no rounding.
    """
    lengths = [length for length in range(len(histogram) - 1, small, -1) if histogram[length]]
    pieces = int(sum(histogram[length] for length in lengths))
    groups = min(groups, 1 + pieces // 8)
    if len(lengths) <= groups:
        return [[[length, int(histogram[length])]] for length in lengths]
    share = -(-pieces // groups)
    out: list[list[list[int]]] = []
    room = 0
    for length in lengths:
        number = int(histogram[length])
        while number:
            if not room:
                room = share
                if not out or out[-1][0][0] != length:
                    out.append([])
            taken = min(number, room)
            if out[-1] and out[-1][-1][0] == length:
                out[-1][-1][1] += taken
            else:
                out[-1].append([length, taken])
            number, room = number - taken, room - taken
    return out


def configurations(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, near: float = 1e-5
) -> list[tuple[int, np.ndarray]]:
    """How often to use which configuration (pieces of each size) so that few sequences meet the demand.

    The linear program over all configurations is solved by generating columns: the duals of the present basis price a
    knapsack, whose best filling enters. The least total lies between the present one and that divided by the filling's
    price; the steps end when both are less than half a sequence (or ``near``, as a part) from each other, or after ten
    for each size. Numbers are rounded down; what that leaves is for ``best_fit``.
    """
    basis = np.diag(capacity // sizes).astype(float)
    for step in range(10 * len(sizes)):
        if step % 100 == 0:
            inverse = np.linalg.inv(basis)  # anew, since updates gather errors
        amounts, prices = inverse @ demand, inverse.sum(axis=0)
        entering = _knapsack(sizes, prices, capacity)
        total, price = amounts.sum(), max(prices @ entering, 1.0)
        if total - total / price <= max(0.5, near * total):
            break
        change = inverse @ entering
        ratios = np.where(change > 1e-9, np.maximum(amounts, 0) / np.where(change > 1e-9, change, 1), np.inf)
        leaving = int(np.argmin(ratios))
        if not np.isfinite(ratios[leaving]):
            break
        basis[:, leaving] = entering
        row = inverse[leaving] / change[leaving]
        inverse -= np.outer(change, row)
        inverse[leaving] = row
    amounts = np.floor(np.linalg.solve(basis, demand) + 1e-6).astype(np.int64)
    left, out = demand.copy(), []
    for k in np.argsort(-amounts, kind="stable"):
        pattern = np.rint(basis[:, k]).astype(np.int64)
        used = pattern > 0
        times = min(int(amounts[k]), int((left[used] // pattern[used]).min()))
        if times > 0:
            left -= times * pattern
            out.append((times, pattern))
    return out


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The filling of one sequence with the highest total price: the best for every room, one more piece at a time."""
    room = np.arange(capacity + 1)
    rest = room[:, None] - sizes[None, :]
    best, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        totals = np.where(rest >= 0, best[np.maximum(rest, 0)] + prices[None, :], 0.0)
        choice = totals.argmax(axis=1)
        better = totals[room, choice] > best + 1e-12
        choices.append(np.where(better, choice, -1))
        best = np.where(better, totals[room, choice], best)
    pattern, left = np.zeros(len(sizes)), capacity
    for choice in reversed(choices):
        if choice[left] >= 0:
            pattern[choice[left]] += 1
            left -= int(sizes[choice[left]])
    return pattern


def _substituted(times: int, pattern: np.ndarray, stretches: list, left: np.ndarray, capacity: int) -> Iterator[Run]:
    """Runs of sequences of one configuration, with the actual lengths in place of the rounded ones."""
    slots = []  # for each slot of the configuration: [length, number] over its ``times`` sequences
    for k in np.flatnonzero(pattern):
        for _ in range(int(pattern[k])):
            slot, wanted = [], times
            while wanted:
                length, number = stretches[k][0]
                taken = min(number, wanted)
                slot.append([length, taken])
                wanted -= taken
                if taken == number:
                    stretches[k].pop(0)
                else:
                    stretches[k][0][1] -= taken
            slots.append(slot)
    while slots[0]:
        number = min(slot[0][1] for slot in slots)
        run = Run(number, capacity, [])
        for slot in slots:
            run.add(slot[0][0], 1)
            left[slot[0][0]] -= number
            slot[0][1] -= number
            if not slot[0][1]:
                slot.pop(0)
        yield run


def best_fit(runs: list[Run], left: np.ndarray, capacity: int) -> None:
    """Put what is left, longest first, each piece where the least room stays; open sequences where none has room.

    Pieces of one length go on into the sequence that has just taken one as long as it has room, since it has the least
    room then; so runs of equal sequences are filled at once.
    """
    rooms: dict[int, list[Run]] = {}
    for run in runs:
        rooms.setdefault(run.free, []).append(run)

    def put(run: Run, length: int, number: int) -> None:
        run.add(length, number)
        rooms.setdefault(run.free, []).append(run)

    for length in range(capacity, 0, -1):
        number = int(left[length])
        while number:
            free = min((f for f, held in rooms.items() if f >= length and held), default=0)
            if free:
                run = rooms[free].pop()
            else:
                free = capacity
                run = Run(-(-number // (capacity // length)), capacity, [])
                runs.append(run)
            per = free // length
            full = min(run.times, number // per)
            number -= full * per
            if full == run.times:
                put(run, length, per)
                continue
            if full:
                runs.append(run.part(full))
                put(runs[-1], length, per)
            if number:  # fewer than fill one
                if run.times == 1:
                    put(run, length, number)
                    number = 0
                    continue
                runs.append(run.part(1))
                put(runs[-1], length, number)
                number = 0
            rooms.setdefault(run.free, []).append(run)
        left[length] = 0
