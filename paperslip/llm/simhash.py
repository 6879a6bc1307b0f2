"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is a ring of 8 segments of 8 bits. If two fingerprints differ in at most 4 bits, then from
some segment on every chain of l consecutive segments differs in at most l * 4 / 8 bits. So the first
segment of that chain is equal, and its first three together differ in one bit at most, outside the first:
candidates meet under keys of these 24 bits with one of the last 16 masked. Longer chains must keep their
own budgets before the full Hamming distance is taken. Equal fingerprints are one class from the start, and
a crowded key gives a spanning forest of its links instead of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperslip.llm.components import labelled
from paperslip.llm.scratch import written
from paperslip.llm.text_arrays import LOWER, flat, gathered

SEGMENTS, WIDTH, CHAIN = 8, 8, 3
#: Members of one key up to which its pairs are taken directly; beyond, a spanning forest is searched.
DIRECT = 24
#: Members of one key from which on they are split by further segments.
SPLIT = 1024
_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(words: list[bytes], shingle: int) -> int:
    """64 bits: bit b is set if it is set in over half of the shingles' hashes. No words: zero."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = stops - np.diff(stops, prepend=0)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), (stops[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((ones * 2 > n).astype(np.uint64) << _SHIFTS).sum())


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(key, fingerprint as a signed long) of every row. Null and empty texts have fingerprint 0.

    Repeated rows and null keys give a row each; other columns, of any name, are left out. Texts are taken
    in blocks of a few MB; one of any length is handled in one task, at about 100 bytes of memory a byte.
    """

    def run(batches):
        for block in gathered(batches, "text"):
            data, ends = flat(block["text"])
            raw = data.tobytes().translate(LOWER)
            prints = [fingerprint(raw[a:b].split(), shingle) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield from pa.Table.from_arrays([block["k"], pa.array(np.array(prints, np.uint64).view(np.int64))], names=[key, "fingerprint"]).to_batches()

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("fingerprint", T.LongType())]))


def _segments(x: np.ndarray) -> np.ndarray:
    return (x[:, None] >> (np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(WIDTH))).astype(np.uint8)


def _keys(batches):
    """Each fingerprint under 8 x 16 keys: start of the chain, masked bit, and the chain's 24 bits without it."""
    masks = ~(np.uint64(1) << np.arange(WIDTH, CHAIN * WIDTH, dtype=np.uint64))
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        segments = _segments(prints).astype(np.uint64)
        for start in range(SEGMENTS):
            chain = np.zeros(len(prints), np.uint64)
            for i in range(CHAIN):
                chain |= segments[:, (start + i) % SEGMENTS] << np.uint64(WIDTH * i)
            name = np.uint64(start) << np.uint64(32) | np.arange(len(masks), dtype=np.uint64)[None, :] << np.uint64(24)
            keys = name | chain[:, None] & masks
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(prints, len(masks)).view(np.int64))], names=["key", "print"])


def _near(a: np.ndarray, b: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs meet here first, keep every chain's budget, and differ in `bits` at most."""
    diff = a ^ b
    start = (key >> np.uint64(32)).astype(np.int64)
    masked = (key >> np.uint64(24) & np.uint64(0xFF)).astype(np.int64)
    apart = np.bitwise_count(_segments(diff)).astype(np.int64)
    ring = apart[np.arange(len(diff))[:, None], (start[:, None] + np.arange(SEGMENTS)) % SEGMENTS]
    budget = (np.arange(1, SEGMENTS + 1) * bits) // SEGMENTS
    ok = (np.cumsum(ring, 1) <= budget).all(1)
    # of the keys that a pair shares from this start, only the one that masks the differing bit, or the first
    place = (start + 1 + masked // WIDTH) % SEGMENTS * WIDTH + masked % WIDTH
    own = (diff >> place.astype(np.uint64) & np.uint64(1)).astype(bool)
    return ok & (own | (masked == 0)) & (np.bitwise_count(diff) <= bits)


def _forest(prints: np.ndarray, start: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all of one key's fingerprints that are linked (`bits` apart at most). `start` is the key's first segment.

    More than SPLIT of them are split by each segment outside of the key's chain in turn: these are more
    segments than `bits`, so that two linked fingerprints agree in one of them.
    """
    if len(prints) <= SPLIT:
        return _spanned(prints, bits)
    segments, out = _segments(prints), []
    for i in range(CHAIN, SEGMENTS):
        own = segments[:, (start + i) % SEGMENTS]
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(own[order]) != 0))
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist(), strict=True):
            out += _spanned(prints[order[a:b]], bits) if b - a > 1 else []
    return out


def _spanned(prints: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links, by breadth-first search."""
    out = []
    rest = prints
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            for pivot in queue.pop():
                near = np.bitwise_count(rest ^ pivot) <= bits
                if near.any():
                    found = rest[near]
                    out.append((np.full(len(found), pivot), found))
                    queue.append(found)
                    rest = rest[~near]
                    if not len(rest):
                        break
    return out


def _links(bits: int):
    def pairs(key: np.ndarray, prints: np.ndarray):
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(first, len(key)))
        size = np.repeat(sizes, sizes)
        left, right = [], []
        small = size <= DIRECT
        for apart in range(1, min(DIRECT, int(sizes.max(initial=0)))):
            hit = np.flatnonzero((key[:-apart] == key[apart:]) & small[:-apart])
            hit = hit[_near(prints[hit], prints[hit + apart], key[hit], bits)]
            left.append(prints[hit])
            right.append(prints[hit + apart])
        for i in np.flatnonzero(sizes > DIRECT):
            for a, b in _forest(prints[first[i] : first[i] + sizes[i]], int(key[first[i]] >> np.uint64(32)), bits):
                left.append(a)
                right.append(b)
        if left:
            return np.concatenate(left), np.concatenate(right)
        return prints[:0], prints[:0]

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64)))
            n += batch.num_rows
            if n < 100_000 or held[0][0][0] == held[-1][0][-1]:  # the last key may go on
                continue
            key, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key.view(np.int64), key.view(np.int64)[-1], "left"))
            yield out(*pairs(key[:cut], prints[:cut]))
            held, n = [(key[cut:], prints[cut:])], len(key) - cut
        if held:
            key, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            yield out(*pairs(key, prints))

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

    return run


def links(classes: DataFrame, *, bits: int = 4) -> DataFrame:
    """(src, dst) between distinct fingerprints `bits` (4 at most) apart: enough of them to connect all that are linked."""
    if not 0 <= bits <= SEGMENTS // 2:
        raise ValueError("at most 4 bits")
    keyed = classes.select("fingerprint").mapInArrow(_keys, "key long, print long")
    return keyed.repartition("key").sortWithinPartitions("key", "print").mapInArrow(_links(bits), "src long, dst long").distinct()


def linked_rows(prints: DataFrame, *, key: str, bits: int = 4) -> DataFrame:
    """(src, dst): keys of rows whose fingerprints are `bits` apart at most, enough of them to connect all that are linked.

    Keys are unique; equal fingerprints hang on the smallest of their keys.
    """
    prints = written(prints.select(F.col(key).alias("k"), "fingerprint"), "prints")
    classes = written(prints.groupBy("fingerprint").agg(F.min("k").alias("first")), "classes")
    equal = prints.join(classes, "fingerprint").where("k <> first").select(F.col("first").alias("src"), F.col("k").alias("dst"))
    near = links(classes, bits=bits).toDF("a", "b").join(classes.toDF("a", "src"), "a").join(classes.toDF("b", "dst"), "b").select("src", "dst")
    return equal.unionByName(near)


def components(prints: DataFrame, *, key: str = "doc_id", bits: int = 4) -> DataFrame:
    """(key, fingerprint, component): the smallest key that a row reaches over links of `bits` at most, its own included.

    Equal fingerprints are linked, those of empty texts too. Null keys take part, but never name a
    component; one of null keys only has a null name. Repeated rows stay. No rows give no rows.
    """
    prints = written(prints, "prints")
    classes = written(prints.groupBy("fingerprint").agg(F.min(key).alias("_first")), "classes")
    label = labelled(classes, "fingerprint", links(classes, bits=bits))
    least = label.groupBy("component").agg(F.min("_first").alias("_least"))
    named = written(label.join(least, "component").select(F.col("fingerprint").alias("_print"), F.col("_least").alias("_name")), "names")
    return prints.join(named, F.col("fingerprint") == F.col("_print")).select(key, "fingerprint", F.col("_name").alias("component"))
