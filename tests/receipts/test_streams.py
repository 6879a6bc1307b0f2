"""Streams: the incremental knowledge base, documents gathered from lines, and the quota over shards."""

import collections
import datetime
import random

from pyspark.sql import functions as F

from paperslip.streaming import state as A
from paperslip.streaming import streams as T


def test_incremental_upserts(spark, tmp_path):
    schema = "id string, doc_type string, content string, version int"
    base = f"{tmp_path}/kb"
    spark.createDataFrame([("a", "x", "old", 1), ("b", "x", "stays", 3)], schema).write.parquet(f"{base}/v=0")
    for i, rows in enumerate([[("a", "x", "new", 2), ("a", "x", "newer", 4)], [("b", "x", "too old", 2), ("c", "y", "added", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run has nothing new
        T.stream_upsert_kb(stream, base, f"{tmp_path}/state").awaitTermination()
        assert {tuple(r) for r in T.latest(spark, base).collect()} == {("a", "x", "newer", 4), ("b", "x", "stays", 3), ("c", "y", "added", 1)}
    sizes = spark.read.option("basePath", base).parquet(base).groupBy("v").count().where(F.col("v") > 0).collect()
    assert sorted(r[1] for r in sizes) in ([1, 2], [3])
    T.compact(spark, base, f"{tmp_path}/new")
    assert spark.read.parquet(f"{tmp_path}/new/v=0").count() == 3 and T.latest(spark, f"{tmp_path}/new").count() == 3


class Feed:
    """A folder that rows are written to, file by file, and a query over it that is started anew each time."""

    def __init__(self, spark, path, schema, make):
        self.spark, self.path, self.schema, self.make = spark, path, schema, make

    def add(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        q = self.make(stream).writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return [tuple(r) for r in self.spark.read.parquet(f"{self.path}/out").collect()]


def at(minutes):
    return datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(minutes=minutes)


def test_documents_from_their_lines(spark, tmp_path):
    """Lines in several files and out of order, repeated ones, a document without an end, late lines, and a restart between them."""
    feed = Feed(spark, tmp_path, "doc_id long, line_number long, text string, ts timestamp", lambda s: A.assemble_documents(s, last="^END", idle_minutes=30, watermark="10 minutes"))
    feed.add((1, 3, "END", at(0)), (1, 1, "a", at(0)), (2, 1, "only", at(1)), (3, 1, "x", at(0)), (3, 2, "END", at(0)), (None, 1, "no key", at(0)), (4, 1, "no time", None), (5, None, "no number", at(1)))
    got = feed.run()
    assert sorted(got) == [(3, 1, "x", True), (3, 2, "END", True)]
    feed.add((1, 2, "b", at(5)), (1, 2, "b again", at(5)), (3, 3, "after the end", at(5)))
    got = feed.run()
    assert sorted(got)[:3] == [(1, 1, "a", True), (1, 2, "b", True), (1, 3, "END", True)] and len(got) == 5
    feed.add((6, 1, "later", at(60)))
    got = feed.run()
    assert (2, 1, "only", False) in got and len(got) == 6
    feed.add((2, 2, "too late", at(2)), (6, 2, "END", at(61)))
    got = feed.run()
    assert len(got) == 8 and (6, 2, "END", True) in got and collections.Counter(r[:2] for r in got).most_common(1)[0][1] == 1


def test_documents_gathered_by_shard(spark, tmp_path):
    """A state per shard gives out what a state per document does: early, late, repeated and unnumbered lines, documents without an end, and their expiry while others of the shard wait."""
    rnd = random.Random(3)
    schema = "doc_id long, line_number long, text string, ts timestamp"
    rows = []
    for doc in range(60):
        n, ts = rnd.randint(0, 4), at(doc % 20)
        lines = [(doc, k, rnd.choice(["x", None, ""]), ts) for k in range(n)] + [(doc, n, "END", ts)] * (doc % 5 > 0) + [(doc, n + 2, "END", ts)] * (doc % 4 == 0) + [(doc, None, "no number", ts)] * (doc % 7 == 0)
        rows += [(0, *lines[0])] * 2 + [(rnd.randint(0, 2), *r) for r in lines] if lines else []
    feeds = [Feed(spark, tmp_path / str(n), schema, lambda s, n=n: A.assemble_documents(s, last="^END", idle_minutes=30, watermark="10 minutes", shards=n)) for n in (None, 3)]
    later = {1: [(1000, 1, "x", at(45)), (None, 1, "no key", at(45))], 2: [(1001, 1, "END", at(90)), (1000, 2, "x", at(90))], 3: [(1002, 1, "x", at(300))], 4: [(1000, 3, "END", at(301))]}
    for batch in range(5):
        mine, got = [r[1:] for r in rows if r[0] == batch] + later.get(batch, []), []
        for feed in feeds:
            feed.add(*mine)
            got.append(collections.Counter(feed.run()))
        assert got[0] == got[1] and max(got[1].values()) == 1
    assert {r[3] for r in got[1]} == {True, False} and len({r[0] for r in got[1]}) > 50


def brute_quota(rows, limits):
    """Request by request, in order of time and id within a day and mode."""
    seen, out = collections.Counter(), {}
    for request, mode, n, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        key = (ts.date(), mode)
        out[request] = seen[key] < limits.get(mode, 0)
        seen[key] += max(n if n is not None else 1, 1)
    return out


def test_quota_over_shards_equals_the_day_in_order(spark, tmp_path):
    """Requests out of order over many batches and hours; what is decided early is right, and nothing is decided twice."""
    rnd = random.Random(8)
    limits = {"auto": 40, "review": 12}
    rows = [(i, rnd.choice(["auto", "review", "other"]), rnd.choice([1, 2, 3, 0, None]), at(rnd.randint(-600, 1600))) for i in range(300)]
    feed = Feed(spark, tmp_path, "id long, mode string, n long, ts timestamp", lambda s: A.sharded_quota(s, limits, watermark="3 days", shard_minutes=30))
    for k in range(0, 300, 100):
        feed.add(*rows[k : k + 100])
    early = feed.run()
    want = brute_quota(rows, limits)
    assert early and all(not want[i] for i, _, admitted in early if not admitted) and not any(a for _, _, a in early)
    feed.add((1000, "auto", 1, at(60 * 24 * 9)))
    got = feed.run()
    assert len(got) == 300 and {i: a for i, _, a in got} == want


def test_late_requests_are_dropped(spark, tmp_path):
    feed = Feed(spark, tmp_path, "id long, mode string, n long, ts timestamp", lambda s: A.sharded_quota(s, {"auto": 2}, watermark="10 minutes"))
    feed.add((1, "auto", 1, at(0)), (2, "auto", 1, at(1)))
    feed.run()
    feed.add((3, "auto", 1, at(300)), (4, None, 1, at(300)), (5, "auto", 1, None))
    assert sorted(feed.run()) == [(1, "auto", True), (2, "auto", True)]
    feed.add((6, "auto", 1, at(2)))
    feed.run()
    feed.add((7, "auto", 1, at(3000)))
    assert sorted(feed.run()) == [(1, "auto", True), (2, "auto", True), (3, "auto", False)]
