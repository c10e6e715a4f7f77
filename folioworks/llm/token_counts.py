"""Token counts through a cache keyed by content digest and tokenizer digest."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.shared import bounded_batches, folder_rows, stage, text_bytes, utf8

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Digests that a task remembers to have passed on, and pieces of text whose count a worker remembers (some 30 MB).
REMEMBERED, MOST_PIECES = 50_000, 250_000


def token_counts(docs: DataFrame, tokenizer_file: str, cache: str) -> DataFrame:
    """Bytes and tokens of every text, encoding only contents that the cache doesn't know.

    Content is normalised to its UTF-8 bytes, where NULL is the empty text; nothing else is folded, because every
    byte can change a count. Digests of content and of the tokenizer file are joined to the rows stored in the folder
    ``cache``. Of each content that has no row, one copy is encoded, and its count is appended to the folder. Copies
    are dropped in the scanning tasks first, so a text that fills a third of the table reaches the exchange once a
    task. Appended rows of a repeated task or of two writers are equal, and readers take one of each digest.

    ``tokenizer_file``: ``.json`` (tokenizers), ``.model`` (sentencepiece) or ``.tiktoken`` (tiktoken with the
    pattern of ``public_tokenizers``). Its bytes, a few MB, travel with the tasks.

    Returns doc_id, n_bytes, n_tokens for every row of ``docs``, repeated rows and ids included; an empty or NULL
    text has 0 of both; NULL ids stay. Other columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = Path(tokenizer_file).read_bytes()
    version = hashlib.sha256(model).hexdigest()
    content = F.coalesce(F.col("text"), F.lit(""))
    known = stage(docs.select("doc_id", text_bytes(F.col("text")).alias("n_bytes"), _digest(content).alias("digest")))
    stored = folder_rows(spark, cache, CACHE_SCHEMA).where(F.col("tokenizer") == version).select("digest")
    missing = known.select("digest").distinct().join(stored, "digest", "left_anti")
    texts = docs.select(content.alias("text")).mapInArrow(_first_copies, "digest binary, text string")
    # The digests build the hash table: texts are neither sorted nor held.
    misses = texts.join(missing.hint("shuffle_hash"), "digest", "left_semi")
    ship = spark.sparkContext.broadcast((Path(tokenizer_file).suffix, model))
    counted = misses.mapInArrow(_encoder(ship, version), CACHE_SCHEMA)
    counted.write.mode("append").parquet(cache)
    rows = folder_rows(spark, cache, CACHE_SCHEMA).where(F.col("tokenizer") == version)
    # Staged, so that the join below meets plain exchanges and Spark can split the rows of a frequent digest.
    counts = stage(rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    return known.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def _digest(content):
    return F.unhex(F.sha2(content.cast("binary"), 256))


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and text; a content that this task has just passed on is left out."""
    seen: set[bytes] = set()
    for batch in batches:
        digests = [hashlib.sha256(raw).digest() for raw in utf8(batch.column(0))]
        if len(seen) > REMEMBERED:
            seen = set()
        first = []
        for i, d in enumerate(digests):
            if d not in seen:
                seen.add(d)
                first.append(i)
        kept = pa.array(first, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array([digests[i] for i in first], pa.binary()), batch.column(0).take(kept)], ["digest", "text"]
        )


_COUNTERS: dict[str, Callable] = {}


def _encoder(ship, version: str) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version not in _COUNTERS:  # a worker process builds a tokenizer once
            _COUNTERS.clear()
            _COUNTERS[version] = counter(*ship.value)
        count = _COUNTERS[version]
        seen: set[bytes] = set()
        for batch in batches:
            digests, texts = batch.column(0).to_pylist(), batch.column(1)
            fresh = {d: i for i, d in enumerate(digests) if d not in seen}
            if len(seen) > REMEMBERED:
                seen = set()
            seen.update(fresh)
            numbers = count([texts[i].as_py() for i in fresh.values()])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([version] * len(fresh), pa.string()),
                    pa.array(list(fresh), pa.binary()),
                    pa.array(numbers, pa.int64()),
                ],
                ["tokenizer", "digest", "n_tokens"],
            )

    return encode


def counter(kind: str, model: bytes) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens, without added special tokens, truncation or padding."""
    if kind == ".json":
        from tokenizers import Tokenizer

        # Spark runs a task on each core already; the library's threads would only hold more memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(model.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def whole(texts: list[str]) -> list[int]:
            return [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        return by_piece(whole, hashlib.sha256(model).digest()) if splits_at_spaces(tokenizer) else whole
    if kind == ".model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    if kind == ".tiktoken":
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, model.splitlines())}
        encoding = tiktoken.Encoding(
            "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    raise ValueError(f"no tokenizer library for {kind}")


def splits_at_spaces(tokenizer) -> bool:
    """Whether a lone space between other characters always begins a new unit of the tokenizer.

    True for byte-level tokenizers with their usual pattern, no normalizer and added tokens that neither contain nor
    swallow spaces.
    """
    import json

    spec = json.loads(tokenizer.to_str())
    pre = spec["pre_tokenizer"] or {}
    return (
        spec["normalizer"] is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and all(
            " " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"])
            for t in spec["added_tokens"]
        )
    )


#: Counts of pieces by tokenizer; a worker process keeps them from task to task.
_COUNTS: dict[bytes, dict[str, int]] = {}


def by_piece(whole: Callable[[list[str]], list[int]], tokenizer: bytes) -> Callable[[list[str]], list[int]]:
    """Count texts as the sum over their pieces, each encoded once.

    A piece begins at a space that stands alone between two characters that are not white space. The pattern of the
    tokenizer begins a unit there, too, and merges never cross units, so the sum is the count of the whole text.
    """
    known = _COUNTS.setdefault(tokenizer, {})

    def some(texts: list[str]) -> list[int]:
        if len(known) > MOST_PIECES:
            known.clear()
        split = [pieces(t) for t in texts]
        new = list({p for s in split for p in s}.difference(known))
        known.update(zip(new, whole(new), strict=True))
        return [sum(map(known.__getitem__, s)) for s in split]

    def count(texts: list[str]) -> list[int]:
        return [n for at in range(0, len(texts), 100) for n in some(texts[at : at + 100])]

    return count


def pieces(text: str) -> list[str]:
    """The text cut before each lone space; the first piece has none in front."""
    if not text:
        return []
    cut = text.split(" ")
    if not any(white_edge(p) for p in set(cut)):
        return [cut[0], *[" " + p for p in cut[1:]]]
    out, last = [cut[0]], cut[0]
    for p in cut[1:]:
        if white_edge(p) or white_edge(last):
            out[-1] += " " + p
        else:
            out.append(" " + p)
        last = p
    return out


def white_edge(piece: str) -> bool:
    # U+180E was white space in older versions of Unicode.
    return not piece or piece[0].isspace() or piece[-1].isspace() or "᠎" in piece
