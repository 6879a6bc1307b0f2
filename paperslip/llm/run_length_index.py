"""Repeated passages by a run-length compressed index: bytes covered by a long string that also starts earlier.

1. Content-defined anchors (winnow.py) route: equal windows have the same anchor, so that windows with
   different anchors need not meet. A segment is the text under the consecutive windows of one anchor
   occurrence. Of segments of equal bytes in a block all but the first are marked at once.
2. Blocks send the names of their anchors only. The text of a segment is sent on where its anchor occurs again.
3. There, one segment of each kind becomes part of an index: a run-compressed Burrows-Wheeler transform with
   sampled text places at the ends of its runs, and with the earliest place of each window. The segments are
   streamed through it from right to left, those of equal bytes once; where the matching statistics reach a
   window's length, the window occurs in the index, and it is marked wherever that is at an earlier place
   than its own. No byte goes on the word of a hash.
4. An anchor of more than CROWD segments is dealt out by its single windows instead, in two levels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperslip.llm import routing as R
from paperslip.llm.scratch import written, written_by
from paperslip.llm.text_arrays import flat, gathered, mix, spread
from paperslip.llm.winnow import Rolling, anchors

BLOCK = 2 << 20
#: Segments of one anchor from which on its windows are dealt out one by one.
CROWD = 20_000
#: Bytes of different segments that one index takes (a single anchor's stay together).
INDEX_BYTES = 2 << 20
#: Bytes of text per bucket, about.
BUCKET_BYTES = 32 << 20
_GAP = 0xFF  # no byte of UTF-8
_LOW48 = np.uint64((1 << 48) - 1)


# ---- the index ----------------------------------------------------------------------------------


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): suffixes sorted by their first `depth` bytes (8 at least), by prefix doubling, and where those differ from the suffix before."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key)
    size = 8
    while True:
        ordered = key[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        if size >= depth or n == 0 or new.all():
            return order, new[:n]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        by = min(size, depth - size)  # the two parts may overlap
        key = rank << np.uint64(32)
        key[: max(0, n - by)] |= rank[by:]
        order = np.argsort(key)
        size += by


class Marks:
    """Marked rows, a bit each, counted in words of 64."""

    def __init__(self, marked: np.ndarray) -> None:
        self.bits = np.packbits(np.append(marked, np.zeros(-len(marked) % 64, bool)), bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def last(self, row: np.ndarray) -> np.ndarray:
        """Which mark is the last one up to each row, from 0."""
        word = row >> 6
        below = ~np.uint64(0) >> (np.uint64(63) - (row & 63).astype(np.uint64))
        return self.before[word] + np.bitwise_count(self.bits[word] & below).astype(np.int64) - 1


class RunLengthIndex:
    """A run-length Burrows-Wheeler transform of `text` with the text places of both ends of each run.

    Suffixes are sorted by `depth` bytes, and matches are followed up to that length. `owner` gives a
    number for each byte of the text; of the places that share `depth` bytes the smallest one is kept.
    """

    def __init__(self, text: np.ndarray, depth: int, owner: np.ndarray | None = None) -> None:
        order, new = suffix_order(text, depth)
        last = text[order - 1]  # of the first suffix: the text's last byte
        self.depth = depth
        self.text = np.append(text, np.zeros(depth + 8, np.uint8))
        edge = np.append(True, last[1:] != last[:-1])
        self.starts = np.flatnonzero(edge)
        stops = np.append(self.starts[1:], len(text))
        self.heads = last[self.starts].astype(np.int64)
        self.first, self.final = order[self.starts], order[stops - 1]
        by_sign = np.argsort(self.heads, kind="stable")
        sizes = (stops - self.starts)[by_sign]
        # where a run's suffixes, one byte longer, begin in the order
        self.moved = np.empty(len(sizes), np.int64)
        self.moved[by_sign] = np.cumsum(sizes) - sizes
        self.stops = stops
        self.listed = self.heads[by_sign] * len(self.heads) + by_sign
        self.runs = Marks(edge)
        self.owner = owner
        if owner is not None:
            self.strings = Marks(new)
            self.earliest = np.minimum.reduceat(owner[order], np.flatnonzero(new)) if len(order) else owner[:0]

    def matching_statistics(self, texts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(size, owner): per place of the texts, the length of its longest match in the index, `depth` at most, and for those of full length the smallest owner of an occurrence.

        Texts are read from their ends, all of them side by side. A text that continues its match follows
        its row; at a mismatch the nearest runs of the wanted byte above and below are tried, and the
        sampled place that agrees longer with the text goes on.
        """
        cap = self.depth
        out = np.zeros(len(texts), np.int64)
        whose = np.full(len(texts), np.iinfo(np.int64).max)
        n_runs = len(self.heads)
        padded = np.append(texts, np.full(cap + 8, _GAP - 1, np.uint8))
        lengths = np.diff(ends)
        live = np.argsort(-lengths, kind="stable")
        row = np.zeros(len(live), np.int64)
        size = np.zeros(len(live), np.int64)
        sorted_lengths = lengths[live]
        for back in range(1, int(lengths.max(initial=0)) + 1):
            n = int(np.searchsorted(-sorted_lengths, -back, "right"))
            at = ends[1:][live[:n]] - back
            sign = texts[at].astype(np.int64)
            run = self.runs.last(row[:n])
            new_row, new_size = self.moved[run] + row[:n] - self.starts[run], size[:n] + 1
            miss = np.flatnonzero(self.heads[run] != sign)
            if len(miss):
                want = sign[miss]
                below = np.searchsorted(self.listed, want * n_runs + run[miss])
                above = below - 1
                has_below = (below < n_runs) & (self.listed[np.minimum(below, n_runs - 1)] // n_runs == want)
                has_above = (above >= 0) & (self.listed[np.maximum(above, 0)] // n_runs == want)
                down = self.listed[np.minimum(below, n_runs - 1)] % n_runs
                up = self.listed[np.maximum(above, 0)] % n_runs
                far = np.minimum(size[miss], cap)
                agree_down = np.where(has_below, self._agree(padded, at[miss] + 1, self.first[down], far), -1)
                agree_up = np.where(has_above, self._agree(padded, at[miss] + 1, self.final[up], far), -1)
                use_up = agree_up > agree_down
                chosen = np.where(use_up, up, down)
                place = np.where(use_up, self.stops[up] - 1, self.starts[down])
                best = np.maximum(agree_up, agree_down)
                new_row[miss] = np.where(best >= 0, self.moved[chosen] + place - self.starts[chosen], 0)
                new_size[miss] = best + 1
            row[:n], size[:n] = new_row, np.minimum(new_size, cap)
            out[at] = size[:n]
            if self.owner is not None:
                full = np.flatnonzero(size[:n] == cap)
                whose[at[full]] = self.earliest[self.strings.last(row[full])]
        return out, whose

    def _agree(self, texts: np.ndarray, at: np.ndarray, place: np.ndarray, far: np.ndarray) -> np.ndarray:
        """How many bytes of texts from `at` equal the index text from `place`, `far` at most."""
        size = np.zeros(len(at), np.int64)
        open_ = np.flatnonzero(far > 0)
        step = 0
        width = np.arange(8)
        while len(open_):
            a = texts[(at[open_] + step)[:, None] + width]
            b = self.text[(place[open_] + step)[:, None] + width]
            same = np.minimum.accumulate(a == b, axis=1).sum(1)
            size[open_] += same
            step += 8
            open_ = open_[(same == 8) & (size[open_] < far[open_]) & (place[open_] + step < len(self.text) - 8)]
        return np.minimum(size, far)


def first_places(body: np.ndarray, ends: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """Per byte of different segments, the smallest place of a segment that holds the window from there on (the largest number where no window begins)."""
    n = len(ends) - 1
    text = np.full(len(body) + n, _GAP, np.uint8)
    text[np.arange(len(body)) + np.repeat(np.arange(n), np.diff(ends))] = body
    size, earliest = RunLengthIndex(text, window, np.repeat(place, np.diff(ends) + 1)).matching_statistics(body, ends)
    return np.where(size >= window, earliest, np.iinfo(np.int64).max)


# ---- the steps ----------------------------------------------------------------------------------

_SEGMENT = ("V6", "i4", "u1")  # name of the anchor, first window's place in the block, windows
_SPAN = ("i4", "u1")  # first window's place in the block, windows
_NAME = ("V6", "i8", "i4")  # name, block, segments in it
_ASKED = ("V6", "i4")  # name, levels to deal a crowd out by (0: none)
_TEXT = ("V6", "i8", "i8", "i4", "u1", "u1")  # name, block, key, first window's place, windows, whether it is dealt out again


def _window_names(data: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Names of single windows, made of their bytes alone."""
    return Rolling(data).ranges(first, first + window) & _LOW48


def _segments(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> pa.Array:
    """The segments' bytes as an Arrow array, with 64-bit offsets."""
    body = data[spread(first, length)]
    ends = np.zeros(len(first) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))])


def _classes(segments: pa.Array) -> np.ndarray:
    """A number for each segment; equal numbers are equal bytes."""
    return segments.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _first_of(classes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which segments are the first of their class in the given order."""
    out = np.zeros(len(classes), bool)
    out[order[np.unique(classes[order], return_index=True)[1]]] = True
    return out


def _by_block(block: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(block, entries) of entries given by their block."""
    if not len(block):
        return []
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
    return [(int(block[order[a]]), order[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True)]


def _carried(table: pa.Table, names: list[str]) -> bytes:
    sink = pa.BufferOutputStream()
    part = table.select(names).combine_chunks()
    with pa.ipc.new_stream(sink, part.schema) as out:
        out.write_table(part)
    return sink.getvalue().to_pybytes()


_BLOCKS = "block long, n_bytes long, keys binary, valid binary, ends binary, body binary, segments binary, spans binary, carried binary"


def _blocks(window: int, carry: list[str]):
    """Blocks of texts with their segments; of equal segments only the first, the others as spans."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for block in gathered(batches, "text", BLOCK):
            data, ends = flat(block["text"])
            k = block["k"].combine_chunks() if isinstance(block["k"], pa.ChunkedArray) else block["k"]
            valid = k.is_valid().to_numpy(zero_copy_only=False)
            keys = np.where(valid, k.fill_null(0).to_numpy(), np.iinfo(np.int64).min).astype(np.int64)
            text, _, first, last, hashes, _ = anchors(data, ends, window)
            name, count = hashes & _LOW48, last - first + 1
            _, inverse, often = np.unique(name, return_inverse=True, return_counts=True)
            lead = np.ones(len(name), bool)
            some = np.flatnonzero(often[inverse] > 1)
            if len(some):
                order = np.lexsort((first[some], keys[text[some]]))  # a block's rows are in order
                lead[some] = _first_of(_classes(_segments(data, first[some], count[some] + window - 1)), order)
            at = np.flatnonzero(lead)
            at = at[np.argsort(name[at], kind="stable")]
            rest = np.flatnonzero(~lead)
            segments = R.packed(R.short(name[at]), first[at].astype(np.int32), count[at].astype(np.uint8))
            spans = R.packed(first[rest].astype(np.int32), count[rest].astype(np.uint8))
            row = {"block": part << 32 | n, "n_bytes": len(data), "keys": keys.tobytes(), "valid": valid.tobytes(), "ends": ends.tobytes(), "body": data.tobytes(), "segments": segments, "spans": spans, "carried": _carried(block, carry)}
            yield pa.RecordBatch.from_arrays([pa.array([v]) if c in ("block", "n_bytes") else pa.array([v], pa.binary()) for c, v in row.items()], names=list(row))
            n += 1

    return run


def _names(n: int):
    """The names that a block has, once each, to their buckets."""

    def run(batches):
        for batch in batches:
            for block, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, count = np.unique(R.long(R.unpacked(segments, _SEGMENT)[0]), return_counts=True)
                if len(name):
                    yield R.dealt(R.bucket_of(name, n), [R.short(name), np.full(len(name), block), count.astype(np.int32)])

    return run


def _met(crowd: int):
    """The names of a bucket that have several segments, by block."""

    def run(table: pa.Table) -> pa.Table:
        (name, block, count), _ = R.read(table, _NAME)
        _, inverse = np.unique(R.long(name), return_inverse=True)
        total = np.bincount(inverse, count)[inverse]
        levels = np.where(total > crowd, np.ceil(np.sqrt(total)), 0).astype(np.int32)
        some = np.flatnonzero(total > 1)
        out = [{"block": b, "asked": R.packed(name[some[e]], levels[some[e]])} for b, e in _by_block(block[some])]
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("asked", pa.binary())]))

    return run


def _fetched(window: int, n: int):
    """The text of the segments that were asked for, by name; of crowds, each window by its own name."""

    def run(asked: pa.Table, texts: pa.Table) -> pa.Table:
        out = []
        parts = [R.unpacked(x, _ASKED) for x in asked["asked"].to_pylist()]
        if parts:
            wanted, levels = R.long(np.concatenate([p[0] for p in parts])), np.concatenate([p[1] for p in parts])
            order = np.argsort(wanted)
            wanted, levels = wanted[order], levels[order]
        for row in texts.to_pylist() if parts else []:
            data, ends, keys = (np.frombuffer(row[c], k) for c, k in (("body", np.uint8), ("ends", np.int64), ("keys", np.int64)))
            name, first, count = R.unpacked(row["segments"], _SEGMENT)
            name = R.long(name)
            i = np.minimum(np.searchsorted(wanted, name), len(wanted) - 1)
            hit = wanted[i] == name
            level, name, first, count = levels[i[hit]], name[hit], first[hit].astype(np.int64), count[hit].astype(np.int64)
            crowd = np.flatnonzero(level > 0)
            again = np.zeros(len(name), np.uint8)
            if len(crowd):  # first among some of the blocks, then among those that were first there
                own = spread(first[crowd], count[crowd])
                salt = mix(np.array([row["block"]], np.uint64)) % np.repeat(level[crowd], count[crowd]).astype(np.uint64)
                salted = mix(_window_names(data, own, window) * np.uint64(0x9E3779B97F4A7C15) + salt) & _LOW48
                rest = np.flatnonzero(level == 0)
                name, first, count = np.append(name[rest], salted), np.append(first[rest], own), np.append(count[rest], np.ones(len(own), np.int64))
                again = np.append(again[rest], np.ones(len(own), np.uint8))
            key = keys[np.searchsorted(ends, first, "right") - 1]
            columns = [R.short(name), np.full(len(name), row["block"]), key, first.astype(np.int32), count.astype(np.uint8), again]
            if len(name):
                out.append(R.dealt(R.bucket_of(name, n), columns, data, first, count + window - 1))
        return pa.Table.from_batches(out, R.ARROW)

    return run


_MARKED = pa.schema([("block", pa.int64()), ("spans", pa.binary()), *R.ARROW])


def _marked(window: int, n: int):
    """Spans of one bucket, by block: windows that also occur at an earlier place. First segments that meet others in a second level go on, by name."""

    def run(table: pa.Table) -> pa.Table:
        (name, block, key, first, count, again), body = R.read(table, _TEXT)
        name = R.long(name)
        length = count.astype(np.int64) + window - 1
        starts = np.cumsum(length) - length
        order = np.lexsort((first, block, key))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        classes = _classes(_segments(body, starts, length))
        lead = _first_of(classes, order)
        # one segment of each kind, about INDEX_BYTES at a time; those of a name stay together
        one = np.flatnonzero(lead)
        one = one[np.argsort(name[one], kind="stable")]
        head = np.flatnonzero(np.append(True, name[one][1:] != name[one][:-1])) if len(one) else np.zeros(0, np.int64)
        total = np.append(0, np.cumsum(length[one]))
        found = [(block[:0], first[:0], count[:0])]
        known = np.zeros(len(classes), bool)  # classes all of whose windows the index has at the place of their first segment, or before
        at = 0
        while at < len(one):
            stops = np.append(head[head > at], len(one))
            fit = stops[total[stops] - total[at] <= INDEX_BYTES]
            to = int(fit[-1]) if len(fit) else int(stops[0])
            own = one[at:to]
            ends = np.append(0, np.cumsum(length[own]))
            seen = first_places(body[spread(starts[own], length[own])], ends, place[own], window)
            each = np.repeat(place[own], length[own])
            known[classes[own]] = np.add.reduceat(seen <= each, ends[:-1]) == count[own]
            byte = np.flatnonzero(seen < each)
            seg = np.searchsorted(ends, byte, "right") - 1
            new = np.append(True, (seg[1:] != seg[:-1]) | (byte[1:] != byte[:-1] + 1)) if len(byte) else np.zeros(0, bool)
            cut = np.flatnonzero(new)  # consecutive windows of a segment are one span
            found.append((block[own[seg[cut]]], (first[own[seg[cut]]] + byte[cut] - ends[seg[cut]]).astype(np.int32), np.diff(np.append(cut, len(byte))).astype(np.uint8)))
            at = to
        copies = np.flatnonzero(~lead & known[classes])  # the same bytes, so the same statistics, at a later place
        found.append((block[copies], first[copies], count[copies]))
        blocks, firsts, counts = (np.concatenate([f[i] for f in found]) for i in range(3))
        rows = [{"block": b, "spans": R.packed(firsts[e], counts[e])} for b, e in _by_block(blocks)]
        on = np.flatnonzero(lead & (again > 0))
        if len(on):
            whole = _window_names(body, starts[on], window)
            columns = [R.short(whole), block[on], key[on], first[on], count[on], np.zeros(len(on), np.uint8)]
            rows += R.dealt(R.bucket_of(whole, n), columns, body, starts[on], length[on]).to_pylist()
        return pa.Table.from_pylist(rows, _MARKED)

    return run


def _cut(key: str, kind: pa.DataType, window: int, carry: list[str], whole_characters: bool):
    def run(marked: pa.Table, texts: pa.Table) -> pa.Table:
        parts = []
        for row in texts.to_pylist():
            data, ends, keys = (np.frombuffer(row[c], k) for c, k in (("body", np.uint8), ("ends", np.int64), ("keys", np.int64)))
            depth = np.zeros(len(data) + 1, np.int32)
            for spans in [row["spans"], *marked["spans"].to_pylist()]:
                first, count = R.unpacked(spans, _SPAN)
                np.add.at(depth, first, 1)
                np.add.at(depth, first + count.astype(np.int64) + window - 1, -1)
            gone = np.cumsum(depth[:-1]) > 0
            if whole_characters and len(data):
                lead = np.flatnonzero((data & 0xC0) != 0x80)
                gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(data))))
            edge = np.zeros(len(data) + 1, bool)
            edge[ends] = True
            before = np.append(False, gone[:-1]) & ~edge[:-1]
            after = np.append(gone[1:], False) & ~edge[1:]
            a, b = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
            owner = np.searchsorted(ends, a, "right") - 1
            kept_ends = np.concatenate(([0], np.cumsum(~gone)))[ends]
            per = np.searchsorted(owner, np.arange(len(ends)))
            valid = np.frombuffer(row["valid"], bool)
            carried = pa.ipc.open_stream(row["carried"]).read_all()
            struct = pa.StructArray.from_arrays([pa.array(a - ends[owner]), pa.array(b - ends[owner])], names=["start", "end"])
            kept = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(kept_ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
            parts.append(pa.table({key: pa.array(keys, mask=~valid).cast(kind), "n_bytes": pa.array(np.diff(ends)), "spans": pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), struct), "kept": kept, **{c: carried[c] for c in carry}}))
        if parts:
            return pa.concat_tables(parts)
        raise ValueError("spans without their block of texts")

    return run


def repeated_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 100, carry: tuple[str, ...] = (), whole_characters: bool = False, crowd: int = CROWD) -> DataFrame:
    """(key, n_bytes, spans, kept, carried columns) of every row: the removed byte ranges (start, end) and the remaining bytes.

    A byte goes if it lies in a `window`-byte string (all of UTF-8 bytes, never across texts) that also
    starts earlier: at a smaller key, or in the same text before; overlapping occurrences count, and all
    is judged on the input. The key is an integer column; null keys come before all others, and rows of
    equal keys are ordered by their place in the input. Null and empty texts have no spans and nothing
    kept. Columns named in `carry`, of any name, are returned as they are, others are left out. With
    `whole_characters` a character stays unless all of its bytes go, so that `kept` is valid UTF-8.
    `window` is from 64 to 224 bytes. A text of any length is one block in one task, at about 100 bytes of
    memory a byte. `crowd` changes how anchors are dealt out, not the result. No rows give no rows.
    """
    if not 64 <= window <= 224:
        raise ValueError("windows are from 64 to 224 bytes")
    spark = docs.sparkSession
    others = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(o) for c, o in zip(carry, others, strict=True)))
    texts = written_by(rows.mapInArrow(_blocks(window, others), _BLOCKS), "texts", "block")
    n_bytes = texts.agg(F.sum("n_bytes")).first()[0] or 0
    n = R.whole(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET_BYTES))
    level = R.first_level(n)
    names = R.routed(texts.select("block", "segments").mapInArrow(_names(level), R.SCHEMA), n, _NAME)
    asked = names.groupBy("bucket").applyInArrow(_met(crowd), "block long, asked binary")
    source = texts.select("block", "keys", "ends", "body", "segments")
    fetched = asked.groupBy("block").cogroup(source.groupBy("block")).applyInArrow(_fetched(window, level), R.SCHEMA)
    width = lambda columns: columns[4].astype(np.int64) + window - 1
    schema = f"block long, spans binary, {R.SCHEMA}"
    once = written(R.routed(fetched, n, _TEXT, width).groupBy("bucket").applyInArrow(_marked(window, n), schema), "marked")
    twice = once.where("bucket IS NOT NULL").select("bucket", "items", "body").groupBy("bucket").applyInArrow(_marked(window, n), schema)
    spans = once.where("spans IS NOT NULL").select("block", "spans").unionByName(twice.select("block", "spans"))
    kind = docs.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_type

    for c, o in zip(carry, others, strict=True):
        out = out.add(o, docs.schema[c].dataType)
    kept = texts.select("block", "keys", "valid", "ends", "body", "spans", "carried")
    cut = spans.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(_cut(key, to_arrow_type(kind), window, others, whole_characters), out)
    return cut.toDF(key, "n_bytes", "spans", "kept", *carry)
