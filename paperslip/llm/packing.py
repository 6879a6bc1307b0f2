"""Packing documents into training sequences by patterns and non-negative least squares.

Only the histogram of piece lengths (at most one row per length, 1024 of them) reaches the driver. It
enumerates patterns of up to three lengths that fill a sequence exactly, fits how often to repeat each
(projected gradient on the weighted least-squares problem), rounds within the counts that are there, and
packs what is left with best fit on the histogram. The plan (pattern slots, a bounded table) goes back to
Spark, where every piece finds its sequence and offset by its rank among the pieces of its length. Ranks
are counted within hash buckets and then across them, so that a length that a third of all pieces share
is never in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperslip.llm import pretokens as P
from paperslip.llm.scratch import written
from paperslip.llm.text_arrays import flat, gathered, spread

#: Pieces per rank bucket and length that one sort takes, about.
PER_BUCKET = 20_000
#: Times that the repeat counts are fitted, at most.
REFITS = 8


def default_vocabulary() -> tuple[str, str]:
    """The tokenizer file, which names the added tokens, and the rank file of the same vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def added_tokens(path: str) -> tuple[re.Pattern | None, dict[bytes, int]]:
    """(pattern, ids) of the strings that the tokenizer file takes out of a text before anything else, longer ones first."""
    with open(path, encoding="utf-8") as f:
        listed = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in listed):
        raise ValueError("added tokens that look at their surroundings are not handled")
    ids = {t["content"].encode(): t["id"] for t in listed}
    return (re.compile(b"|".join(re.escape(t) for t in sorted(ids, key=len, reverse=True))) if ids else None), ids


def _ids(data: np.ndarray, ends: np.ndarray, tokenizer: str, ranks: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, stops) of the texts: added tokens as they are, all between them by byte-level BPE."""
    pattern, known = added_tokens(tokenizer)
    raw = data.tobytes()
    found = [(m.start(), m.end(), known[m[0]]) for m in pattern.finditer(raw)] if pattern else []
    if found:
        a, b, token = (np.array(x, np.int64) for x in zip(*found, strict=True))
        own = np.searchsorted(ends, a, "right") == np.searchsorted(ends, b, "left")  # not across two texts
        a, b, token = a[own], b[own], token[own]
        edge = np.unique(np.concatenate([ends, a, b]))
    else:
        a = token = np.zeros(0, np.int64)
        edge = np.unique(ends)
    at, first = P.starts(data, edge)
    codes, words = P.dictionary(data, at)
    ids, stops = P.rebuilt(P.encode_words(words, ranks), codes, first)
    if len(a):
        marked = np.searchsorted(edge, a)
        width = np.diff(stops)
        keep = np.ones(len(ids), bool)
        keep[spread(stops[marked], width[marked])] = False
        width[marked] = 0
        after = np.concatenate(([0], np.cumsum(width)))
        ids = np.insert(ids[keep], after[marked], token.astype(ids.dtype))
        width[marked] = 1
        stops = np.concatenate(([0], np.cumsum(width)))
    return ids, stops[np.searchsorted(edge, ends)]


def pieces(docs: DataFrame, *, size: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document: its ids, then `end_id`, cut where longer than `size`.

    `vocabulary` is a tokenizer file and the rank file of its byte-level vocabulary, which every worker can
    open; the ids are those that the library gives with its defaults, so an added token's string in a text is
    that token. Of a cut document the first piece is the shorter one. A null or empty text is one piece
    with the end id only; repeated rows and null keys give their pieces each, other columns are left out. A text
    of any length is cut in one task, at about 40 bytes of memory a byte. No rows give no pieces.
    """
    tokenizer, ranks = vocabulary or default_vocabulary()
    kind = docs.schema[key].dataType

    def run(batches):
        for block in gathered(batches, "text"):
            ids, stops = _ids(*flat(block["text"]), tokenizer, ranks)
            n = np.diff(stops) + 1
            parts = -(-n // size)
            head = n - (parts - 1) * size
            doc = np.repeat(np.arange(len(n)), parts)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = np.where(number == 0, 0, head[doc] + (number - 1) * size)
            length = np.where(number == 0, head[doc], size)
            tail = np.array([end_id], np.uint32).tobytes()
            body = np.ascontiguousarray(ids, np.uint32).tobytes()
            crc = []
            for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
                a, last = stops[d] + s, s + m == n[d]
                c = zlib.crc32(body[4 * a : 4 * (a + m - last)])
                crc.append(zlib.crc32(tail, c) if last else c)
            yield pa.RecordBatch.from_arrays(
                [block["k"].combine_chunks().take(pa.array(doc)) if isinstance(block["k"], pa.ChunkedArray) else block["k"].take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    schema = T.StructType([T.StructField(key, kind), *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long").fields])
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def patterns(counts: np.ndarray, size: int, step: int = 32) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to `size`, of lengths that occur: all pairs, and triples whose shortest is a multiple of `step` or short."""
    there = counts > 0
    out = []
    a = np.arange(1, size // 2 + 1)
    pair = a[there[a] & there[size - a]]
    out.append(np.stack([np.zeros_like(pair), pair, size - pair], 1))
    for c in [c for c in [*range(1, 9), *range(step, size // 3 + 1, step)] if there[c]]:
        b = np.arange(c, (size - c) // 2 + 1)
        rest = size - c - b
        b = b[there[b] & there[rest]]
        out.append(np.stack([np.full_like(b, c), b, size - c - b], 1))
    return np.concatenate(out)


def fit(table: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts x that minimise the weighted squares of (patterns' use - counts)."""
    if not len(table):
        return np.zeros(0)
    size = len(counts) - 1
    total = max(1.0, float(counts.sum()))
    weight = np.sqrt(np.arange(size + 1) / size)
    weight[0] = 0
    want = weight * counts / total
    w = weight[table]

    def use(x: np.ndarray) -> np.ndarray:
        return np.bincount(table.ravel(), (w * x[:, None]).ravel(), size + 1)

    v = np.ones(len(table))
    for _ in range(30):
        v = (w * use(v)[table]).sum(1)
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(table))
    t = 1.0
    for _ in range(rounds):
        grad = (w * (use(y) - want)[table]).sum(1)
        nxt = np.maximum(0, y - grad / norm)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x * total


def plan(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """(repeats, lengths) groups that use every piece of the histogram once; lengths sum to len(counts) - 1 at most."""
    size = len(counts) - 1
    left = counts.astype(np.int64).copy()
    groups: list[tuple[int, list[int]]] = []
    if left[size]:
        groups.append((int(left[size]), [size]))
        left[size] = 0
    for _ in range(REFITS):  # what rounding leaves is fitted again, while that places pieces
        table = patterns(left, size)
        x = fit(table, left)
        placed = 0
        for i in np.argsort(-x, kind="stable"):
            lengths = [int(v) for v in table[i] if v]
            n = int(x[i] + 0.5)
            for v in set(lengths):
                n = min(n, int(left[v]) // lengths.count(v))
            if n > 0:
                groups.append((n, lengths))
                placed += n
                for v in lengths:
                    left[v] -= n
        if not placed:
            break
    room: dict[int, list[tuple[int, list[int]]]] = {}
    for v in range(size, 0, -1):
        n = int(left[v])
        while n:
            space = min((s for s in room if s >= v), default=None)
            if space is None:
                each = min(n, size // v)
                k = n // each
                room.setdefault(size - each * v, []).append((k, [v] * each))
                n -= k * each
                continue
            k, lengths = room[space].pop()
            take = min(k, n)
            if take < k:
                room[space].append((k - take, lengths))
            if not room[space]:
                del room[space]
            room.setdefault(space - v, []).append((take, [*lengths, v]))
            n -= take
    return groups + [g for some in room.values() for g in some]


def pack(parts: DataFrame, *, size: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` from 1 to `size`; columns of these two names are replaced.

    Rows may repeat; each is placed once. Other columns may have any name and any type that can be
    ordered. The rows are written to the shared folder first, so that the histogram and the ranks are
    those of the same rows. A length that is null or out of range is an error. No rows give no rows.
    """
    spark = parts.sparkSession
    parts = written(parts.drop("sequence_id", "offset"), "pieces")
    names = parts.columns
    hist = parts.groupBy("length").count().collect()  # one row per length, `size` at most
    counts = np.zeros(size + 1, np.int64)
    for length, n in hist:
        if length is None or not 1 <= length <= size:
            raise ValueError(f"a piece of length {length}")
        counts[length] = n
    groups = plan(counts)
    slots = []
    used = np.zeros(size + 1, np.int64)
    sequence = 0
    for n, lengths in groups:
        offset = 0
        for v in lengths:
            slots.append((v << 44 | int(used[v]), int(used[v]), sequence, offset))
            used[v] += n
            offset += v
        sequence += n
    slots.sort()
    table = spark.sparkContext.broadcast(np.array(slots, np.int64).reshape(-1, 4))  # a few rows per pattern: no more than lengths and patterns allow

    salts = max(16, int(counts.sum()) // PER_BUCKET)
    rows = parts.select("length", F.struct(*names).alias("row"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")))
    ranked = ranked.join(before, ["length", "salt"]).select("row.*", (F.col("before") + F.col("rank") - 1).alias("sequence_id"))

    def run(batches):
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(len(names)).to_numpy()
            slot = table.value[np.searchsorted(table.value[:, 0], length << 44 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(slot[:, 2] + rank - slot[:, 1]), pa.array(slot[:, 3])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
