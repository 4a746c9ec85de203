"""Whole Arrow batches of texts as flat byte arrays: words, hashes and sliding minima without a loop per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: [\x20\x09-\x0D], the only characters that part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A to Z in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text worked on at once; one longer document is worked on by itself.
CHUNK_BYTES = 1 << 20

U = np.uint64
MASK = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], U)
BASE = 0x9E3779B97F4A7C15
LAST_ID = (1 << 63) - 1


def document_key(doc_id: str) -> Column:
    """The id as a long; a missing id counts as the last of all."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The batch cut between documents: number of the first document, bytes, offsets."""
    data, offsets = flat(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), "<u8", padded, strides=(1,))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; a word ends where its document ends."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, 8 bytes a step."""
    length, view = ends - starts, lanes(data)
    h = mix(length.astype(U) * U(BASE))
    more, k = np.flatnonzero(length > 0), 0
    while len(more):
        lane = view[starts[more] + k] & MASK[np.minimum(length[more] - k, 8)]
        h[more] = mix(h[more] ^ lane) * U(BASE)
        k += 8
        more = more[length[more] > k]
    return mix(h)


def _powers(n: int, cache: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(cache.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            cache[name] = np.cumprod(steps)
    return cache["up"][:n], cache["down"][:n]


def rolling(h: np.ndarray, k: int, cache: dict[str, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """A 64-bit hash of every k neighbours, from running sums."""
    if len(h) < k:
        return np.zeros(0, U)
    up, down = _powers(len(h), cache)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(h * up)])
    return mix((sums[k:] - sums[:-k]) * down[: len(h) - k + 1])


def slide(x: np.ndarray, width: int, of: Callable = np.minimum) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    size = 1
    while size * 2 <= width:
        x = of(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return of(x[:-rest], x[rest:]) if rest else x


def starts_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Positions at which any of the columns changes; the first position counts."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def runs_of_positions(row: np.ndarray, position: np.ndarray, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of stretches in which a row's positions go up by at most ``gap``; input sorted by row, position."""
    if not len(row):
        none = np.zeros(0, np.int64)
        return none, none
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (position[1:] > position[:-1] + gap)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(row)) - 1


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Flat bytes cut into binary values of the given sizes."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def binary_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The reverse: flat bytes and sizes; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)
