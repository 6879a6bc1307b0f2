"""Stateful operators of streams: documents gathered from their lines, and a daily quota over shards of a day.

Both keep their state in RocksDB (`use_rocksdb`), a bounded amount per key, and forget what is over by timers or by its day.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_MS = 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these operators need; it also keeps large state out of the executors' heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class DocumentLines(StatefulProcessor):
    """Gathers (line_number, text, at) rows of a document until its last line and all before it are there, or nothing came for `idle_ms`.

    One value per document: what has come so far, until when to wait, and whether it has been given out. The first of two
    rows of one number counts; rows that come after the document was given out are dropped until it is forgotten.
    """

    def __init__(self, last: str, idle_ms: int) -> None:
        self.last, self.idle_ms = last, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.is_last = handle, re.compile(self.last)
        self.state = handle.getValueState("document", "numbers array<bigint>, texts array<string>, last bigint, until bigint, done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        numbers, texts, last, until, done = self.state.get() or ([], [], None, None, False)  # one call to the store
        found, before = dict(zip(numbers or [], texts or [], strict=True)), until
        for r in rows:
            until = max(until or 0, r.at + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
            if not done and r.line_number is not None and r.line_number not in found:
                found[r.line_number] = r.text
                if r.text is not None and self.is_last.search(r.text):
                    last = r.line_number if last is None else min(last, r.line_number)
        whole = not done and last is not None and sum(1 <= n <= last for n in found) == last
        if whole:
            yield from self._out(key, found, True)
            found, done = {}, True
        self.state.update((list(found), list(found.values()), last, until, done))
        if before != until:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.state.exists():
            return
        numbers, texts, _, until, done = self.state.get()
        if expiredTimerInfo.getExpiryTimeInMs() < until:
            return
        if not done:
            yield from self._out(key, dict(zip(numbers or [], texts or [], strict=True)), False)
        self.state.clear()

    def _out(self, key: Any, found: dict, whole: bool) -> Iterator[Row]:
        for n in sorted(found):
            yield Row(doc_id=key[0], line_number=n, text=found[n], whole=whole)


def _packed(**columns: Any) -> bytes:
    """Columns as one value of the state store."""
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(value: bytes) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in pa.ipc.open_stream(value).read_all().columns]


def shard_of_documents(last: str, idle_ms: int) -> Callable[[Any, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What `DocumentLines` does for a document, for all documents of a shard at once.

    One value per shard: of each document until when to wait and whether it has been given out, and the lines that wait.
    """
    is_last, never = re.compile(last).search, np.iinfo(np.int64).max
    long, flag = (lambda: np.empty(0, np.int64)), (lambda: np.empty(0, bool))

    def fold(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        docs, until, done, *held = (x for part in state.get for x in _unpacked(part)) if state.exists else (long(), long(), flag(), long(), long(), np.empty(0, object), flag())
        watermark, new = max(state.getCurrentWatermarkMs(), 0), [] if state.hasTimedOut else list(batches)
        if new:
            rows = pd.concat(new)
            doc, wait = rows["doc_id"].to_numpy(), np.maximum(rows["at"].to_numpy() + idle_ms, watermark + 1)
            before, was_done, (docs, at) = until, done, np.unique(np.concatenate([docs, doc]), return_inverse=True)
            until, done = np.zeros(len(docs), np.int64), np.zeros(len(docs), bool)
            np.maximum.at(until, at, np.concatenate([before, wait]))
            done[at[: len(was_done)]] = was_done
            use = rows["numbered"].to_numpy() & ~done[at[len(was_done) :]]
            text = rows["text"].to_numpy(object)[use]
            ends = np.fromiter((t is not None and is_last(t) is not None for t in text), bool, len(text))
            held = [np.concatenate(pair) for pair in zip(held, (doc[use], rows["line_number"].to_numpy()[use], text, ends), strict=True)]
        order = np.lexsort((held[1], held[0]))  # the first of two rows of one number stays the first
        doc, number = held[0][order], held[1][order]
        order = order[np.concatenate([[True], (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])])[: len(doc)]]
        doc, number, text, ends = (c[order] for c in held)
        some, start, size = np.unique(doc, return_index=True, return_counts=True)
        of = np.searchsorted(docs, doc)  # each line's document
        whole, over = np.zeros(len(docs), bool), until <= watermark
        if len(some):
            end = np.minimum.reduceat(np.where(ends, number, never), start)
            there = np.add.reduceat((number >= 1) & (number <= np.repeat(end, size)), start, dtype=np.int64)
            whole[np.searchsorted(docs, some)] = (end < never) & (there == end)
        out, done, wait = (whole | over)[of], done | whole, ~(whole | over)[of]
        if out.any():
            yield pd.DataFrame({"doc_id": doc[out], "line_number": number[out], "text": text[out], "whole": whole[of][out]})
        if over.all():
            state.remove()
            return
        state.update((_packed(docs=docs[~over], until=until[~over], done=done[~over]), _packed(doc=doc[wait], number=number[wait], text=pa.array(text[wait], pa.string()), end=ends[wait])))
        state.setTimeoutTimestamp(int(max(until[~over].min() - 1, 1)))  # over once the watermark is beyond it

    return fold


def assemble_documents(lines: DataFrame, *, last: str, idle_minutes: int = 10, watermark: str = "10 minutes", shards: int | None = None) -> DataFrame:
    """(doc_id, line_number, text, whole): the lines of each document, all at once, from a stream (doc_id, line_number, text, ts).

    A document ends with a line that matches `last`, once every line number before that is there (`whole`); else `idle_minutes` after
    its latest event time, as the watermark passes it. Each document is given out once, whatever batches its lines came in.
    A document has a state of its own, which suits batches of few documents; with `shards` all those of a shard have one, so that
    many documents of a batch are folded together and a shard's lines must fit in a task's memory.
    """
    use_rocksdb(lines.sparkSession)
    rows = lines.where("doc_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", watermark).select("doc_id", "line_number", "text", "ts", F.unix_millis("ts").alias("at"))
    out, idle_ms = "doc_id long, line_number long, text string, whole boolean", idle_minutes * 60_000
    if shards is None:
        return rows.groupBy("doc_id").transformWithState(DocumentLines(last, idle_ms), out, "Append", "EventTime")
    numbered = {"numbered": F.col("line_number").isNotNull(), "line_number": F.coalesce("line_number", F.lit(0)), "doc_id": F.col("doc_id").cast("long")}
    keyed = rows.withColumns(numbered).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    return keyed.groupBy("shard").applyInPandasWithState(shard_of_documents(last, idle_ms), out, "docs binary, lines binary", "append", GroupStateTimeout.EventTimeTimeout)


class ShardCounter(StatefulProcessor):
    """The requests of one shard (a part of a day and a mode) in order of time, until the watermark has passed the shard.

    A request whose predecessors in the shard alone reach the limit is rejected at once; so the state never holds more
    than `limit` requests (each counts one at least), and a total. When the shard is over, the others leave
    with the sum of those before them, and one more row has the shard's total.
    """

    def __init__(self, limits: dict[str, int], shard_ms: int) -> None:
        self.limits, self.shard_ms = limits, shard_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("shard", "total bigint, ats array<bigint>, ids array<bigint>, ns array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        day, mode, shard = key
        known = self.state.exists()
        total, ats, ids, ns = self.state.get() if known else (0, [], [], [])
        held = list(zip(ats or [], ids or [], ns or [], strict=True))
        for r in rows:
            held.append((r.at, r.id, max(r.n, 1)))
            total += max(r.n, 1)
        held.sort()
        before, kept = 0, []
        for at, request, n in held:
            if before < self.limits.get(mode, 0):
                kept.append((at, request, n))
                before += n
            else:
                yield Row(day=day, mode=mode, shard=shard, id=request, before=None, total=None)
        self.state.update((total, *([list(c) for c in zip(*kept, strict=True)] or [[], [], []])))
        if not known:
            self.handle.registerTimer((day * DAY_MS + (shard + 1) * self.shard_ms))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        day, mode, shard = key
        total, _, ids, ns = self.state.get()
        before = 0
        for request, n in zip(ids or [], ns or [], strict=True):
            yield Row(day=day, mode=mode, shard=shard, id=request, before=before, total=None)
            before += n
        yield Row(day=day, mode=mode, shard=shard, id=None, before=None, total=total)
        self.state.clear()


class DayMerge(StatefulProcessor):
    """Adds the totals of a day's shards up, in their order, and decides about the requests that their own shard has left open.

    Shards end in order of the watermark, so that those before have come by then. Rejected requests pass through under keys
    of their own. A mode's sums are those of its last `keep_days` days with requests.
    """

    def __init__(self, limits: dict[str, int], keep_days: int) -> None:
        self.limits, self.keep_days = limits, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("days", "days array<bigint>, totals array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        mode, part = key
        if part >= 0:
            for r in rows:
                yield Row(id=r.id, mode=mode, admitted=False)
            return
        days, totals = self.state.get() if self.state.exists() else ([], [])
        gone = dict(zip(days or [], totals or [], strict=True))
        shards: dict[tuple[int, int], list[Row]] = {}
        for r in rows:
            shards.setdefault((r.day, r.shard), []).append(r)
        for day, shard in sorted(shards):
            before = gone.get(day, 0)
            for r in shards[day, shard]:
                if r.id is not None:
                    yield Row(id=r.id, mode=mode, admitted=before + r.before < self.limits.get(mode, 0))
            gone[day] = before + sum(r.total or 0 for r in shards[day, shard])
        last = sorted(gone)[-self.keep_days :]
        self.state.update((last, [gone[d] for d in last]))


def sharded_quota(patterns: DataFrame, limits: dict[str, int], *, watermark: str = "10 minutes", shard_minutes: int = 60, keep_days: int = 3) -> DataFrame:
    """(id, mode, admitted) of a stream (id, mode, n, ts): a request is admitted while the counts before it that day, in order of time and id, stay below the mode's limit.

    The result is that of the whole day in order of time, in whatever order and batches requests come: shards of
    `shard_minutes` wait until the watermark has passed them. Requests later than the watermark are dropped. A count below one is one.
    No task ever sees a whole day's requests: shards hold `limit` requests at most, and a mode's merge sees those and their totals.
    """
    use_rocksdb(patterns.sparkSession)
    if 24 * 60 % shard_minutes:
        raise ValueError("shards divide a day")
    shard_ms = shard_minutes * 60_000
    ms = F.unix_millis("ts")
    day = F.floor(ms / DAY_MS).cast("long")
    keyed = patterns.where("ts IS NOT NULL AND mode IS NOT NULL").withWatermark("ts", watermark)
    keyed = keyed.select("id", "mode", F.coalesce("n", F.lit(1)).cast("long").alias("n"), "ts", F.unix_micros("ts").alias("at"), day.alias("day"), F.floor((ms - day * DAY_MS) / shard_ms).cast("long").alias("shard"))
    counted = keyed.groupBy("day", "mode", "shard").transformWithState(ShardCounter(limits, shard_ms), "day long, mode string, shard long, id long, before long, total long", "Append", "EventTime")
    parted = counted.withColumn("part", F.when(F.col("before").isNull() & F.col("total").isNull(), F.col("shard")).otherwise(-1))
    return parted.groupBy("mode", "part").transformWithState(DayMerge(limits, keep_days), "id long, mode string, admitted boolean", "Append", "None")
