"""Language of texts by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks.llm.shared import bounded_batches

#: Languages whose profiles travel with every task.
MOST_LANGUAGES = 400
#: n-grams of a profile; an n-gram that a profile lacks is this far out of place.
PROFILE = 300
UNKNOWN = "und"
#: Distinct n-grams that a task holds before it passes their counts on.
MOST_CODES = 1_000_000


@dataclass(frozen=True)
class Profiles:
    """Languages in code point order, all n-grams of any profile (ascending), and their ranks (-1: not in it)."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray


@cache
def _letters() -> np.ndarray:
    """For each code point its value plus one if it is a letter, else 1, which stands for a word's edge."""
    return np.array([c + 1 if chr(c).isalpha() else 1 for c in range(0x110000)], np.uint64)


def grams(text: str | None) -> np.ndarray:
    """Codes of all runs of one to three characters of the words, edges included; letters in lower case."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    coded = np.ones(len(points) + 2, np.uint64)
    coded[1:-1] = _letters()[points]
    edge = coded == 1
    keep = np.ones(len(coded), bool)
    keep[1:] = ~(edge[1:] & edge[:-1])
    coded = coded[keep]
    if len(coded) < 2:
        return np.empty(0, np.uint64)
    edge = coded == 1
    one, two, three = coded, coded[1:] << np.uint64(21), coded[2:] << np.uint64(42)
    pairs = one[:-1] | two
    triples = (pairs[:-1] | three)[~edge[1:-1]]
    return np.concatenate([one[~edge], pairs, triples])


def ranked(counted: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, the commonest first, ties by code."""
    return counted[np.argsort(-counts, kind="stable")[:PROFILE]]


def train(labelled: DataFrame) -> Profiles:
    """Profiles of all languages of ``labelled`` (text, lang): the most frequent n-grams of all its texts.

    n-grams are counted on the tasks, summed by (language, n-gram), and ranked; 300 rows for each language come to the
    driver, for ``MOST_LANGUAGES`` languages at most (the table of all ranks is under 200 MB then): beyond that the call
    fails. Rows with NULL in either column are left out.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    found = sorted((r["lang"], r["rank"] - 1, r["gram"]) for r in top.take(PROFILE * MOST_LANGUAGES + 1))
    languages = sorted({f[0] for f in found})
    if len(languages) > MOST_LANGUAGES or len(found) > PROFILE * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the profiles would outgrow the tasks")
    codes = np.unique(np.array([f[2] for f in found], np.int64).view(np.uint64))
    ranks = np.full((len(codes), len(languages)), -1, np.int32)
    for language, rank, gram in found:
        ranks[np.searchsorted(codes, np.uint64(gram)), languages.index(language)] = rank
    return Profiles(languages, codes, ranks)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        by_language: dict[str, list[np.ndarray]] = {}
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            by_language.setdefault(language, []).append(grams(text.as_py()))
        for language, parts in by_language.items():
            totals[language] = _added(totals.get(language), np.concatenate(parts))
        if sum(len(codes) for codes, _ in totals.values()) > MOST_CODES:
            yield from _counted(totals)
            totals = {}
    yield from _counted(totals)


def _added(total: tuple[np.ndarray, np.ndarray] | None, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.unique(codes, return_counts=True)
    if total is None:
        return codes, counts
    both, at = np.unique(np.concatenate([total[0], codes]), return_inverse=True)
    sums = np.zeros(len(both), np.int64)
    np.add.at(sums, at, np.concatenate([total[1], counts]))
    return both, sums


def _counted(totals: dict) -> Iterator[pa.RecordBatch]:
    for language, (codes, counts) in totals.items():
        columns = [pa.array([language] * len(codes)), pa.array(codes.view(np.int64)), pa.array(counts)]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])


def guess(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """The language with the least out-of-place distance (ties: the first), and how near it is, from 0 to 1."""
    found = grams(text)
    if not len(found) or not len(profiles.languages) or not (found < 1 << 21).any():
        return UNKNOWN, 0.0
    top = ranked(*np.unique(found, return_counts=True))
    at = np.minimum(np.searchsorted(profiles.grams, top), len(profiles.grams) - 1)
    theirs = np.where((profiles.grams[at] == top)[:, None], profiles.ranks[at], -1)
    apart = np.abs(theirs - np.arange(len(top), dtype=np.int32)[:, None])
    distance = np.where(theirs < 0, PROFILE, apart).sum(axis=0)
    best = int(np.argmin(distance))
    return profiles.languages[best], 1.0 - float(distance[best]) / (PROFILE * len(top))


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with lang_pred and score from the whole of each text, and from nothing else.

    A document's 300 most frequent n-grams are compared to each profile: the sum of the differences of rank, 300 for an
    n-gram that the profile lacks. The nearest language wins (ties: code point order); the score is one less the
    distance's share of the largest possible. A NULL text, one without a letter, or no profile at all gives ``und``
    and 0. Row by row, no exchange; repeated rows stay; columns named lang_pred or score are replaced; an empty table
    gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes) + ", lang_pred string, score double"
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [guess(text.as_py(), profiles) for text in batch.column(place)]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id):
    """One third of the ids, which no profile learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: profiles learn from the labelled rows that are not held out.

    A NULL id is neither held out nor learnt from. The rest is as ``identify`` says.
    """
    profiles = train(docs.where(~held_out(F.col("doc_id"))))
    flagged = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", flagged, "text"), profiles).drop("text")
