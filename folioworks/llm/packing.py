"""Packed rows: what a slice of documents sends to one part of a hash space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from folioworks.llm.shared import mixed


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(hashes) % np.uint64(parts)).astype(np.int32)


def groups(ordered: np.ndarray) -> np.ndarray:
    """Where groups of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, int)


def joined(parts: list, kind) -> np.ndarray:
    """Packed values of several rows as one array."""
    return np.frombuffer(b"".join(x for x in parts if x), kind)


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked members one parent: the least place spreads along the links until nothing changes."""
    while len(a) and (parent[a] != parent[b]).any():
        low = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """A batch of plain Python rows for a schema of int, long, boolean and binary columns."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))
