"""Many small entries from blocks of text to the buckets of their hashes, packed in few rows.

An entry is one place of several arrays of the same length: its hash first, then whatever it needs, and some
bytes of text if it has any. The entries that a block sends to one bucket are one row. With more buckets
than FAN_OUT the rows go to FAN_OUT groups of buckets first, where the entries of many blocks are gathered
and dealt out again, so that rows stay large however many buckets there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperslip.llm.text_arrays import mix, spread

#: Buckets that one block deals out to.
FAN_OUT = 1024
#: Unpacked bytes of entries that are gathered before they are dealt out again.
GATHERED = 24 << 20
SCHEMA = "bucket int, items binary, body binary"
ARROW = pa.schema([("bucket", pa.int32()), ("items", pa.binary()), ("body", pa.binary())])


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def opened(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of one length, byte planes apart, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize) for c in columns]
    return squeezed(b"".join(np.ascontiguousarray(p.T).tobytes() for p in planes))


def unpacked(raw: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    body = np.frombuffer(opened(raw), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n = len(body) // sum(widths)
    out, at = [], 0
    for kind, width in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(body[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def short(x: np.ndarray, width: int = 6) -> np.ndarray:
    """The low bytes of 64-bit numbers."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width]).view(f"V{width}").ravel()


def long(x: np.ndarray, width: int = 6) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :width] = np.ascontiguousarray(x).view(np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def read(table: pa.Table | list[dict], kinds: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """All entries of the rows, column by column, and their bytes one after another."""
    rows = table.select(["items", "body"]).to_pylist() if isinstance(table, pa.Table) else table
    parts = [unpacked(r["items"], kinds) for r in rows]
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]
    return columns, np.frombuffer(b"".join(opened(r["body"]) for r in rows if r["body"] is not None), np.uint8)


def dealt(bucket: np.ndarray, columns: list[np.ndarray], body: np.ndarray | None = None, starts: np.ndarray | None = None, lengths: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each bucket that occurs; the bytes of an entry are body[start : start + length]."""
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    heads = np.flatnonzero(np.append(True, sorted_bucket[1:] != sorted_bucket[:-1])) if len(order) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(heads.tolist(), np.append(heads[1:], len(order)).tolist(), strict=True):
        own = order[a:b]
        text = None if body is None else squeezed(body[spread(starts[own], lengths[own])].tobytes())
        rows.append({"bucket": int(sorted_bucket[a]), "items": packed(*(c[own] for c in columns)), "body": text})
    return pa.RecordBatch.from_pylist(rows, ARROW)


def hashes_of(column: np.ndarray) -> np.ndarray:
    return column if column.dtype == np.uint64 else long(column, column.dtype.itemsize)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(n)).astype(np.int32)


def first_level(n: int) -> int:
    """How many buckets the blocks themselves deal out to, for n buckets in the end (rounded up to a multiple)."""
    return n if n <= FAN_OUT else FAN_OUT


def whole(n: int) -> int:
    return n if n <= FAN_OUT else -(-n // FAN_OUT) * FAN_OUT


def routed(rows: DataFrame, n: int, kinds: tuple[str, ...], lengths=None) -> DataFrame:
    """Rows dealt out to first_level(n) buckets, in whole(n) buckets. kinds[0] is a hash (8 bytes, or fewer of its low ones); lengths(columns) are the entries' numbers of bytes."""
    if n <= FAN_OUT:
        return rows
    n = whole(n)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def out() -> pa.RecordBatch:
            columns, body = read(held, kinds)
            bucket = bucket_of(hashes_of(columns[0]), n)
            if lengths is None:
                return dealt(bucket, columns)
            width = lengths(columns)
            return dealt(bucket, columns, body, np.cumsum(width) - width, width)

        for batch in batches:
            for row in batch.to_pylist():
                more = int.from_bytes(row["items"][:8], "little") + (int.from_bytes(row["body"][:8], "little") if row["body"] is not None else 0)
                if held and (held[-1]["bucket"] != row["bucket"] or size + more > GATHERED):
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += more
        if held:
            yield out()

    # the rows of a group of buckets may lie in any number of tasks: they need only meet in pieces of GATHERED bytes
    return rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("items"), F.lit(8))).sortWithinPartitions("bucket").mapInArrow(again, SCHEMA)
