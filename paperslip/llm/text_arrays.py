"""Arrow text columns as flat numpy arrays, in blocks of bounded size.

Every helper takes whole texts. A block holds whole rows and at most `limit` bytes of text, unless a
single text is longer; nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one block takes at most (a longer text is a block of its own).
BLOCK_BYTES = 4 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i is bytes[offsets[i]:offsets[i + 1]]; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.dtype(np.int64 if wide else np.int32)
    ends = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches`, cut where the text of a block would exceed `limit` bytes."""
    for batch in batches:
        ends = flat(batch.column(batch.schema.get_field_index(column)))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def gathered(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Like `blocks`, but rows of several batches are joined until a block is full."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = flat(batch.column(batch.schema.get_field_index(column)))[1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + limit - size, "right")) - 1
            if to <= at and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
                pa.default_memory_pool().release_unused()
                continue
            to = max(to, at + 1)
            held.append(batch.slice(at, to - at))
            size += int(ends[to] - ends[at])
            at = to
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def split_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, first): byte ranges of the words [^\\x20\\x09-\\x0D]+, and per text the index of its first word.

    `first` has one entry more than there are texts.
    """
    inside = ~_WHITE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edge = ends[:-1][ends[:-1] < len(data)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, ends)


def pack(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow binary array."""
    lengths = stops - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    if len(starts) and np.array_equal(starts[1:], stops[:-1]):
        body = data[starts[0] : stops[-1]]
    else:
        body = data[spread(starts, lengths)]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices start, start + 1, ... of ranges, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    full = lengths > 0
    starts, lengths = starts[full], lengths[full]
    steps = np.ones(total, np.int64)
    at = np.cumsum(lengths)[:-1]
    steps[0] = starts[0]
    steps[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(steps)


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(codes, dictionary) of an Arrow array without nulls."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input touches every bit of the result."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x
