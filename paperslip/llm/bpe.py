"""Byte-level BPE over a whole corpus: each distinct pre-token is encoded once.

1. Blocks of documents are cut into pre-tokens. A block keeps its pre-tokens' positions as codes into its
   own dictionary; only the dictionary is dealt out, by hash bucket of the word.
2. A bucket merges the dictionaries of all blocks and encodes each distinct word once.
3. The ids go back to their block, which reassembles its documents by position.

A word is sent once per block, however often it occurs, so that no word is hot. There are as many buckets
as keep one's dictionaries in memory; beyond MOST_BUCKETS, where a block would send too few words to each,
the blocks are taken in parts, and a word is encoded once per part. Decoding gathers the token-byte table,
which has one row per vocabulary entry and is read by every worker.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperslip.llm import pretokens as P
from paperslip.llm.scratch import written_by
from paperslip.llm.text_arrays import flat, gathered
from paperslip.llm.winnow import Rolling

#: Text bytes per block.
BLOCK = 5 << 20
#: Bytes of text per bucket, about; a tenth of that or less is words that blocks have sent.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 4096


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, first all their lowest bytes, then the next ones: the files compress better so."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _bucketed(n_buckets: int, parts: int, key: str):
    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for block in gathered(batches, "text", BLOCK):
            data, ends = flat(block["text"])
            at, first = P.starts(data, ends)
            codes, words = P.dictionary(data, at)
            body, stops = flat(words)
            bucket = (Rolling(body).ranges(stops[:-1], stops[1:]) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            # positions: the number of a word by frequency, and for each number its place in bucket order
            by_count = np.argsort(-np.bincount(codes, minlength=len(order)), kind="stable")
            number = np.empty(len(order), np.int64)
            number[by_count] = np.arange(len(order))
            codes, places = number[codes], rank[by_count]
            body, stops = flat(words.take(pa.array(order)))
            lengths = np.diff(stops).astype(np.int32)
            share = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            full = np.flatnonzero(np.diff(share))
            name = part << 32 | n
            n += 1
            rows = len(full) + 1
            keys = pa.ListArray.from_arrays(pa.array([0] + [0] * len(full) + [block.num_rows], pa.int32()), block[key].combine_chunks() if isinstance(block[key], pa.ChunkedArray) else block[key])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows, name)),
                    pa.array(np.append(full, -1).astype(np.int32)),
                    pa.array(np.full(rows, name % parts, np.int32)),
                    pa.array([_packed(body[stops[share[b]] : stops[share[b + 1]]].tobytes()) for b in full] + [None], pa.binary()),
                    pa.array([_packed(lengths[share[b] : share[b + 1]].tobytes()) for b in full] + [None], pa.binary()),
                    keys,
                    pa.array([None] * len(full) + [np.diff(first).astype(np.int32).tobytes()], pa.binary()),
                    pa.array([None] * len(full) + [_planes(codes)], pa.binary()),
                    pa.array([None] * len(full) + [_planes(places)], pa.binary()),
                ],
                names=["block", "bucket", "part", "words", "lengths", "keys", "counts", "codes", "places"],
            )

    return run


def _encoded(path: str):
    def run(table: pa.Table) -> pa.Table:
        body = np.frombuffer(b"".join(_unpacked(x) for x in table["words"].to_pylist()), np.uint8)
        sizes = [np.frombuffer(_unpacked(x), np.int32) for x in table["lengths"].to_pylist()]
        lengths = np.concatenate(sizes)
        stops = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=stops[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(stops), pa.py_buffer(np.ascontiguousarray(body))])
        d = words.dictionary_encode()
        ids = P.encode_words(d.dictionary, path, remember=False)  # each word comes once
        own = np.cumsum([0, *map(len, sizes)])
        flat_ids, ends = P.rebuilt(ids, d.indices.to_numpy(), own)
        width = np.diff(ids.offsets.to_numpy())[d.indices.to_numpy()].astype(np.int32)
        return pa.table(
            {
                "block": table["block"],
                "bucket": table["bucket"],
                "ids": pa.array([_packed(_planes(flat_ids[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                "widths": pa.array([_packed(_planes(width[a:b])) for a, b in zip(own[:-1], own[1:], strict=True)], pa.binary()),
            }
        )

    return run


def _joined(key: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.schema.field("keys").type.value_type
        out = []
        right = right.sort_by("bucket")
        joined = lambda name: np.concatenate([_from_planes(_unpacked(x)) for x in right[name].to_pylist()] or [np.zeros(0, np.int64)])
        widths = joined("widths")
        ends = np.zeros(len(widths) + 1, np.int64)
        np.cumsum(widths, out=ends[1:])
        ids = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(joined("ids").astype(np.uint32)))
        for row in range(left.num_rows):
            counts = np.frombuffer(left["counts"][row].as_py(), np.int32)
            codes = _from_planes(left["places"][row].as_py())[_from_planes(left["codes"][row].as_py())]
            first = np.zeros(len(counts) + 1, np.int64)
            np.cumsum(counts, out=first[1:])
            body, stops = P.rebuilt(ids, codes, first)
            offsets = (stops * 4).astype(np.int32)  # a block's own ids
            packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
            out.append(pa.table({key: left["keys"].combine_chunks().slice(row, 1).flatten(), "ids": packed}))
        return pa.concat_tables(out) if out else pa.table({key: pa.array([], kind), "ids": pa.array([], pa.binary())})

    return run


def encode(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """(key, ids): each text's token ids as little-endian unsigned 32-bit integers.

    Null and empty texts give empty ids; a row is returned for every row, whatever its key (null and
    repeated keys too); other columns, of any name, are left out. A text of any length, up to 512 M ids, is
    one block in one task. `vocabulary` is a file of base-64 tokens and ranks that every worker can open.
    """
    spark = docs.sparkSession
    path = vocabulary or default_vocabulary()
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    n_buckets = n_buckets or min(wanted, MOST_BUCKETS)
    parts = -(-size // (n_buckets * BUCKET_BYTES)) or 1
    kind = docs.schema[key].dataType
    schema = T.StructType.fromDDL("block long, bucket int, part int, words binary, lengths binary").add("keys", T.ArrayType(kind)).add("counts", "binary").add("codes", "binary").add("places", "binary")
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    cut = written_by(rows.mapInArrow(_bucketed(n_buckets, parts, "k"), schema), "pretokens", "block")
    words = cut.where("bucket >= 0").select("block", "bucket", "part", "words", "lengths")
    ids = words.groupBy("bucket", "part").applyInArrow(_encoded(path), "block long, bucket int, ids binary, widths binary")
    texts = cut.where("bucket < 0").select("block", "keys", "counts", "codes", "places")
    out = T.StructType().add(key, kind).add("ids", "binary")
    return texts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_joined(key), out)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> pa.Array:
    """The token-byte table: entry i holds the bytes of token i (one row per vocabulary entry)."""
    return pa.array([token for token, _ in sorted(P.ranks(path).items(), key=lambda x: x[1])], pa.binary())


def decode(encoded: DataFrame, *, ids: str = "ids", vocabulary: str | None = None, to: str = "decoded") -> DataFrame:
    """Adds the bytes of the ids; null ids give null. An id outside the vocabulary is an error."""
    path = vocabulary or default_vocabulary()
    names = encoded.columns

    def run(batches):
        for batch in batches:
            column = batch.column(names.index(ids))
            body, ends = flat(column)
            numbers = np.frombuffer(body.tobytes(), np.uint32)
            data, stops = flat(token_bytes(path).take(pa.array(numbers)))
            offsets = stops[ends // 4].astype(np.int32)
            valid = None if not column.null_count else column.is_valid()
            made = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
            if valid is not None:
                made = pa.compute.if_else(valid, made, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*names, to])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(to, T.BinaryType())]))
