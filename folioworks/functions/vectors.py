"""Vector expressions."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.functions.core import bind


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""

    def scaled(d: Column) -> Column:
        norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
        return bind(norm, lambda n: F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d))

    return bind(as_doubles(v), scaled)


def hashed_embedding(tokens: Column, dim: int = 64) -> Column:
    """Deterministic stand-in for a model: signed counts of hashed tokens, unit length.

    Tokens go to Arrow batches, where each different one is hashed once and all are counted in one pass. NULL tokens
    count for nothing; a NULL list has no vector.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def counts(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        heads = np.frombuffer(b"".join(md5(w).digest()[:5] for w in words), np.uint8).reshape(-1, 5).astype(np.int64)
        slots = (heads[:, :4] @ np.array([1 << 24, 1 << 16, 1 << 8, 1])) % dim
        signs = 1.0 - 2.0 * (heads[:, 4] >> 4 & 1)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), lengths)
        known = coded.indices.is_valid().to_numpy(zero_copy_only=False)
        place = coded.indices.drop_null().to_numpy(zero_copy_only=False)
        sums = np.bincount(row[known] * dim + slots[place], signs[place], len(lists) * dim)
        ends = pa.array(np.arange(len(lists) + 1) * dim, pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(sums, pa.float64()), mask=lists.is_null())

    return l2_normalize(counts(tokens))
