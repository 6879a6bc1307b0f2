"""Centroid clustering over blocks in Hilbert order, pruned by their boxes.

Vectors of whole numbers are sorted along a Hilbert curve through all components (the widest first) and cut
into blocks; a block keeps the least and greatest value of each component, its box. The distance from a
centroid to a box bounds those to all of the block's vectors from below, and the distance to the box's
farthest corner from above, so a centroid farther than the nearest one's farthest corner is no candidate of
that block. The others are compared with every vector exactly. Ties go to the smaller number; a centroid
whose bound equals the best one stays a candidate.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperslip.llm.routing import opened, squeezed
from paperslip.llm.scratch import written
from paperslip.llm.topk import quantised

#: Vectors of a block.
BLOCK = 512
#: Bits of the curve per component.
BITS = 4
#: Greatest absolute component: squared distances of up to 2^10 components stay below 2^63, those up to SMALL below 2^53.
GREATEST, SMALL = 1 << 25, 1 << 20


def hilbert(levels: np.ndarray, bits: int = BITS) -> list[bytes]:
    """The place of each row of levels (0 to 2^bits - 1) on a Hilbert curve through all columns, as bytes that sort alike.

    The curve in its transposed form: from the highest bit on, a set bit of a column inverts the lower bits of
    the first one and a clear bit exchanges them; then the columns are Gray coded.
    """
    x = np.ascontiguousarray(levels.T.astype(np.int64))
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(len(x)):
            up = (x[i] >> bit & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn
    planes = np.stack([x[i] >> bit & 1 for bit in range(bits - 1, -1, -1) for i in range(len(x))], 1).astype(np.uint8)
    return [row.tobytes() for row in np.packbits(planes, axis=1)]


def box_candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The numbers of the centroids that can be nearest to a vector within the box, in order."""
    c = centroids.astype(np.float64)
    apart = np.maximum(np.maximum(low - c, c - high), 0)
    far = np.maximum(np.abs(c - low), np.abs(c - high))
    least, most = (apart * apart).sum(1), (far * far).sum(1)
    return np.flatnonzero(least <= most.min() * (1 + 1e-9))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each vector, exactly; ties to the smaller number."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= SMALL:
        a, c = x.astype(np.float64), centroids.astype(np.float64)  # every sum below stays a whole number under 2^53
        d = ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    else:
        d = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = np.argmin(d, 1)
    return best, d[np.arange(len(x)), best]


def assign(blocks, centroids: np.ndarray, seen: list | None = None):
    """(ids, vectors, numbers, distances) of each block; `seen` is given its candidates and all centroids."""
    for row in blocks:
        x = np.frombuffer(opened(row["vectors"][2:]), row["vectors"][:2].decode()).astype(np.int64).reshape(-1, centroids.shape[1])
        low, high = np.frombuffer(row["box"], np.int64).reshape(2, -1)
        able = box_candidates(low, high, centroids)
        if seen is not None:
            seen.append((len(able), len(centroids)))
        best, distance = nearest(x, centroids[able])
        yield row["ids"], x, able[best], distance


def _kept(vectors: DataFrame, key: str, embedding: str, dim: int, scale: float) -> DataFrame:
    """(id, x): vectors of `dim` finite components as whole numbers, 8 bytes each."""
    kind = vectors.schema[key].dataType

    def run(batches):
        for batch in batches:
            where, x = quantised(batch.column(1), scale).get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
            if np.abs(x).max(initial=0) > GREATEST:
                raise ValueError(f"a component exceeds {GREATEST} after scaling: its squared distances are no longs")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), pa.array([v.tobytes() for v in x.astype(np.int64)], pa.binary())], names=["id", "x"])

    rows = vectors.select(F.col(key).alias("id"), F.col(embedding).alias("v")).where("v IS NOT NULL")
    return rows.mapInArrow(run, rows.select("id").schema.add("x", "binary"))


def _spread(kept: DataFrame, dim: int) -> np.ndarray:
    """(5, dim): least, greatest, sum of squares, sum and count of every component; one row a task, added up by Spark."""

    def run(batches):
        low, high, square, total, n = np.full(dim, np.inf), np.full(dim, -np.inf), np.zeros(dim), np.zeros(dim), 0
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, dim).astype(np.float64)
            if len(x):
                low, high, square, total, n = np.minimum(low, x.min(0)), np.maximum(high, x.max(0)), square + (x * x).sum(0), total + x.sum(0), n + len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"place": np.arange(dim), "low": low, "high": high, "square": square, "total": total, "n": np.full(dim, float(n))})

    found = kept.select("x").mapInArrow(run, "place long, low double, high double, square double, total double, n double").groupBy("place").agg(F.min("low"), F.max("high"), F.sum("square"), F.sum("total"), F.sum("n")).orderBy("place")
    rows = found.collect()  # a row per component
    return np.array([r[1:] for r in rows]).T.reshape(5, -1)


def blocks(kept: DataFrame, dim: int) -> DataFrame:
    """(ids, vectors, box): rows (id, x) in Hilbert order, BLOCK a row. Ids are an Arrow stream of one column."""
    spread = _spread(kept, dim)
    if not spread.shape[1]:
        return kept.sparkSession.createDataFrame([], "ids binary, vectors binary, box binary")
    low, high, square, total, n = spread
    wide = np.argsort(-(square / n - (total / n) ** 2), kind="stable")  # the curve only decides who shares a block
    step = np.maximum(high - low, 1)

    def placed(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, dim)
            levels = np.clip((x - low) / step * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)[:, wide]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(levels) if len(x) else [], pa.binary())], names=["id", "x", "place"])

    def cut(batches):
        held, size = [], 0

        def out(table):
            x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.int64).reshape(-1, dim)
            kind = next(k for k, most in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1)) if np.abs(x).max(initial=0) <= most)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.select(["id"]).schema) as stream:
                stream.write_table(table.select(["id"]))
            return {"ids": sink.getvalue().to_pybytes(), "vectors": kind.encode() + squeezed(x.astype(kind).tobytes()), "box": np.stack([x.min(0), x.max(0)]).tobytes()}

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(BLOCK - size, batch.num_rows - at)
                held.append(batch.slice(at, take))
                at, size = at + take, size + take
                if size == BLOCK:
                    yield pa.RecordBatch.from_pylist([out(pa.Table.from_batches(held))])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([out(pa.Table.from_batches(held))])

    spots = kept.mapInArrow(placed, kept.select("*").schema.add("place", "binary")).withColumn("h", F.xxhash64("id"))  # equal vectors are dealt out by their ids
    n_parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = spots.repartitionByRange(n_parts, "place", "h").sortWithinPartitions("place", "h").select("id", "x")
    return written(order.mapInArrow(cut, "ids binary, vectors binary, box binary"), "blocks")


def _moved(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the componentwise floor of the mean of their vectors; empty ones stay."""
    dim = centroids.shape[1]

    def run(batches):
        sums, counts = np.zeros((len(centroids), dim), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, x, number, _ in assign(batch.to_pylist(), centroids):
                order = np.argsort(number, kind="stable")
                own = number[order]
                heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                sums[own[heads]] += np.add.reduceat(x[order], heads, axis=0)
                counts += np.bincount(number, minlength=len(centroids))
        some = np.flatnonzero(counts)
        where = (some[:, None] * (dim + 1) + np.arange(dim + 1)).ravel()
        yield pa.RecordBatch.from_pydict({"place": where, "value": np.hstack([sums, counts[:, None]])[some].ravel()})

    rows = stored.select("vectors", "box", F.lit(b"").alias("ids")).mapInArrow(run, "place long, value long").groupBy("place").agg(F.sum("value")).collect()  # centroids x (components + 1) numbers
    flat = np.zeros(len(centroids) * (dim + 1), np.int64)
    for place, value in rows:
        flat[place] = value
    table = flat.reshape(len(centroids), dim + 1)
    out = centroids.copy()
    full = table[:, dim] > 0
    out[full] = table[full, :dim] // table[full, dim:]
    return out


def cluster(vectors: DataFrame, *, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, salt: str = "2:", key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of `dim` finite components.

    Components become floor(scale * x). The first centroids are the k vectors (all, if fewer) with the smallest
    SHA-256 of salt + key, ties of repeated keys by their components, null keys last. A repeated row is a vector
    of its own. Vectors that are null, hold null or non-finite components or have another length are left out,
    as are other columns, of any name. No vectors give no rows. Components beyond 2^25 after scaling raise
    an error, as their distances would be no longs.
    """
    spark = vectors.sparkSession
    kept = written(_kept(vectors, key, embedding, dim, scale), "vectors")
    first = kept.orderBy(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).asc_nulls_last(), "x").limit(k).select("x").collect()  # k rows
    kind = kept.schema["id"].dataType
    if not first:
        return spark.createDataFrame([], f"{key} {kind.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.stack([np.frombuffer(r.x, np.int64) for r in first])
    stored = blocks(kept, dim)
    for _ in range(rounds):
        centroids = _moved(stored, centroids)

    def run(batches):
        for batch in batches:
            for ids, _, number, distance in assign(batch.to_pylist(), centroids):
                column = pa.ipc.open_stream(ids).read_all().column("id").combine_chunks()
                yield pa.RecordBatch.from_arrays([column, pa.array(number.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    found = written(stored.mapInArrow(run, kept.select("id").schema.add("cluster", "integer").add("distance", "long")), "assigned")
    inertia = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    by_number = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)
    return found.select(
        F.col("id").alias(key), "cluster", "distance",
        by_number([inertia.get(i, 0) for i in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        by_number(names, "string").alias("centroid_sha256"),
    )
