"""Exact top-k by inner product, pruned with multi-resolution segment statistics.

Vectors are cut into segments; a segment of n components keeps its mean and deviation. Since
|a - b|^2 = |a|^2 + |b|^2 - 2ab and within a segment the sum of (a - mean)(b - mean) is at most
n * dev(a) * dev(b), the statistics bound the distance from below, that is the product from above.

Vectors are dealt into blocks with their likes (the nearest of a few sampled pivots). In its own block each
query finds a floor for its k-th score. Then pairs of blocks are compared by the ranges of their statistics
before any vector is sent; in the pairs that remain, coarse bounds and then fine ones drop candidates below
the floor, and exact integer products decide among the survivors: one by one where they are few, by one
matrix product where they are many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperslip.llm.routing import opened, squeezed
from paperslip.llm.scratch import written

#: Vectors per block, and bytes that a block of long vectors has at most.
VECTORS, BYTES = 4096, 8 << 20
#: Segments of the coarse and of the fine statistics.
LEVELS = (4, 16)
#: Sampled vectors that the others are dealt out by.
PIVOTS = 64
#: Above this share of survivors a whole matrix product costs less than one product each.
DENSE = 1 / 16


def quantised(column: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (rows, vectors): floor(scale * x) as doubles, without null vectors and those with null or non-finite components."""
    out: dict[int, list] = {}
    if not column.null_count and not column.flatten().null_count and len(lengths := np.unique(np.diff(column.offsets.to_numpy()))) == 1:
        whole = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), int(lengths[0]))
        good = np.flatnonzero(np.isfinite(whole).all(1))
        return {whole.shape[1]: (good, whole[good])}
    for i, v in enumerate(column):
        if v.is_valid and not v.values.null_count:
            x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
            if np.isfinite(x).all():
                out.setdefault(len(x), []).append((i, x))
    return {d: (np.array([i for i, _ in x]), np.stack([v for _, v in x])) for d, x in out.items()}


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as they need."""
    top = float(np.abs(x).max(initial=0))
    kind = next((k for k, most in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1)) if top <= most), "f8")
    return kind.encode() + squeezed(x.astype(kind).tobytes())


def _unpacked(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(opened(raw[2:]), raw[:2].decode()).astype(np.float64).reshape(-1, dim)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per vector and segment: mean and deviation, each times the root of the segment's length, so that a product of statistics bounds the inner product."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            part = x[:, a:b]
            mean = part.mean(1)
            out += [mean * np.sqrt(b - a), np.sqrt(np.maximum(0, (part * part).sum(1) - (b - a) * mean * mean))]
    return np.stack(out, 1) if out else np.zeros((len(x), 1))


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """More than rounding can take from a product of these statistics."""
    return 1e-9 * (1 + float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1])


def best(queries: np.ndarray, query_rows: np.ndarray, floors: np.ndarray, found: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, survived: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate number, score) of the k best candidates of each query by product that are not below its floor, ties to the smaller id; not the query's own row.

    `survived` is given the numbers of pairs in all, after the coarse level and after the fine one.
    """
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    bounds = [(statistics(queries, s), statistics(found, s)) for s in LEVELS]
    for at in range(0, len(queries), 256):
        q, own, floor = queries[at : at + 256], query_rows[at : at + 256], floors[at : at + 256]
        keep = np.ones((len(q), len(found)), bool)
        seen = [keep.size]
        for a, b in bounds:
            keep &= a[at : at + 256] @ b.T >= (floor - _slack(a, b))[:, None]
            seen.append(int(keep.sum()))
            if seen[-1] == 0:
                break
        if survived is not None:
            survived.append([*seen, 0][:3])
        if not seen[-1]:
            continue
        keep &= rows[None, :] != own[:, None]
        if seen[-1] > DENSE * keep.size:
            product = q @ found.T
            keep &= product >= floor[:, None]
            qi, ci = np.nonzero(keep)
            score = product[qi, ci]
        else:
            qi, ci = np.nonzero(keep)
            score = np.concatenate([np.einsum("nd,nd->n", q[qi[i : i + (1 << 16)]], found[ci[i : i + (1 << 16)]]) for i in range(0, len(qi), 1 << 16)] or [np.zeros(0)])
            over = score >= floor[qi]
            qi, ci, score = qi[over], ci[over], score[over]
        order = np.lexsort((ids[ci], -score, qi))
        qi, ci, score = qi[order], ci[order], score[order]
        top = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        parts.append((qi[top] + at, ci[top], score[top]))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


_BLOCK = "block long, dim long, ids binary, rows binary, vectors binary, ranges binary, n_asked long, asked binary, asked_ranges binary, floors binary, least double"


def _ranges(x: np.ndarray) -> bytes:
    """Smallest and largest value of each coarse statistic."""
    s = statistics(x, LEVELS[0])
    return np.stack([s.min(0), s.max(0)]).tobytes() if len(x) else b""


def _blocks(every: int, k: int):
    """Blocks of vectors with their queries, and the floors that these find in the block."""

    def block(name: int, dim: int, ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> dict:
        hit = np.flatnonzero(ids % every == 0)
        floors = np.full(len(hit), -np.inf)
        if len(ids) > k:
            for at in range(0, len(hit), 256):
                own = hit[at : at + 256]
                product = x[own] @ x.T
                product[np.arange(len(own)), own] = -np.inf
                floors[at : at + 256] = -np.partition(-product, k - 1, axis=1)[:, k - 1]
        return {
            "block": name, "dim": dim, "ids": ids.tobytes(), "rows": rows.tobytes(), "vectors": _packed(x), "ranges": _ranges(x),
            "n_asked": len(hit), "asked": hit.astype(np.int64).tobytes(), "asked_ranges": _ranges(x[hit]), "floors": floors.tobytes(), "least": float(floors.min(initial=np.inf)),
        }

    def run(batches):
        part = TaskContext.get().partitionId()
        seen = made = 0
        held: dict[int, list] = {}
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[t]) for n, t in (x.split() for x in _BLOCK.split(", "))])

        def put(dim: int):
            nonlocal made
            group = held.pop(dim)
            ids, rows, x = (np.concatenate([g[i] for g in group]) for i in range(3))
            size = max(1, min(VECTORS, BYTES // (8 * max(dim, 1))))
            for at in range(0, len(ids), size):
                made += 1
                yield pa.RecordBatch.from_pylist([block(part << 32 | made, dim, ids[at : at + size], rows[at : at + size], x[at : at + size])], schema)

        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            dims = batch.column(2).to_numpy()
            numbers = part << 40 | (seen + np.arange(len(ids)))
            seen += len(ids)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(raw[i] for i in own), np.float64).reshape(len(own), dim)
                held.setdefault(dim, []).append((ids[own], numbers[own], x))
                if sum(len(g[0]) for g in held[dim]) >= min(VECTORS, BYTES // (8 * max(dim, 1))):
                    yield from put(dim)
        for dim in list(held):
            yield from put(dim)

    return run


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64), _unpacked(row["vectors"], row["dim"]) if row["dim"] else np.zeros((len(row["ids"]) // 8, 0))


def search(vectors: DataFrame, *, k: int = 20, key: str = "vec_id", embedding: str = "embedding", scale: float = 64.0, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every`, the k highest integer products with all other rows.

    Components become floor(scale * x); their products are exact while sums stay below 2^53. Vectors that
    are null or hold null or non-finite components, and rows with a null key, take no part; vectors of
    different lengths never meet. Ties go to the smaller key. A repeated query row gives its ranks once per
    row; only the row itself is left out of its candidates. Other columns, of any name, are left out. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    pivots: dict[int, list] = {}
    for row in rows.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(4 * PIVOTS).select("v").collect():  # a bounded sample; it decides who is in a block with whom only
        for dim, (_, x) in quantised(pa.array([row[0]], pa.list_(pa.float64())), scale).items():
            if len(x) and len(pivots.setdefault(dim, [])) < PIVOTS:
                pivots[dim].append(x[0])

    def dealt(batches):
        for batch in batches:
            for dim, (where, x) in quantised(batch.column(1), scale).items():
                cell = np.zeros(len(x), np.int32)
                if dim and dim in pivots:
                    p = np.stack(pivots[dim])
                    cell = np.argmin((p * p).sum(1)[None, :] - 2 * x @ p.T, axis=1).astype(np.int32)
                ids = batch.column(0).take(pa.array(where))
                yield pa.RecordBatch.from_arrays([ids, pa.array([v.tobytes() for v in x], pa.binary()), pa.array(np.full(len(x), dim)), pa.array(cell)], names=["id", "x", "dim", "cell"])

    near = rows.mapInArrow(dealt, "id long, x binary, dim long, cell int").withColumn("h", F.xxhash64("id", "x"))
    near = near.repartitionByRange(n, "dim", "cell", "h").sortWithinPartitions("dim", "cell", "h").select("id", "x", "dim")
    kept = written(near.mapInArrow(_blocks(every, k), _BLOCK), "vectors")

    # pairs of blocks, numbers and ranges only; each block of candidates is sent to the numbered blocks of queries
    asked = kept.where("n_asked > 0").select("dim", F.col("block").alias("q_block"), "asked_ranges", "least").withColumn("n", F.row_number().over(Window.partitionBy("dim").orderBy("q_block")) - 1)
    counts = asked.groupBy("dim").agg(F.max("n").alias("most"))
    pairs = kept.select("dim", "block", "ranges").join(F.broadcast(counts), "dim").withColumn("n", F.explode(F.sequence(F.lit(0), "most"))).drop("most").join(asked, ["dim", "n"])  # counts: a row per length of vectors

    def able(batches):
        for batch in batches:
            keep = []
            for r in batch.select(["ranges", "asked_ranges", "least"]).to_pylist():
                a, b = (np.frombuffer(r[c], np.float64).reshape(2, -1) for c in ("ranges", "asked_ranges"))
                most = np.maximum.reduce([a[i] * b[j] for i in range(2) for j in range(2)]).sum()
                keep.append(bool(most >= r["least"] - _slack(a, b)))
            yield batch.select(["block", "q_block"]).filter(pa.array(keep, pa.bool_()))

    pairs = pairs.mapInArrow(able, "block long, q_block long")
    queries = kept.where("n_asked > 0").mapInArrow(_asked, "q_block long, q_ids binary, q_rows binary, q binary, floors binary")
    sent = pairs.join(queries, "q_block").repartition(n, "block")
    grid = kept.select("block", "dim", "ids", "rows", "vectors").repartition(n, "block").join(sent, "block")

    def meet(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, own, found = _read(row)
                q_ids, q_rows, floors = (np.frombuffer(row[c], t) for c, t in (("q_ids", np.int64), ("q_rows", np.int64), ("floors", np.float64)))
                q = _unpacked(row["q"], row["dim"]) if row["dim"] else np.zeros((len(q_ids), 0))
                qi, ci, score = best(q, q_rows, floors, found, own, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_rows[qi]), pa.array(q_ids[qi]), pa.array(ids[ci]), pa.array(score.astype(np.int64))], names=["query_row", "query_id", "vec_id", "score"])

    found = grid.select("dim", "ids", "rows", "vectors", "q_ids", "q_rows", "q", "floors").mapInArrow(meet, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _asked(batches):
    """The queries of each block."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, rows, x = _read(row)
            hit = np.frombuffer(row["asked"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), *(pa.array([v], pa.binary()) for v in (ids[hit].tobytes(), rows[hit].tobytes(), _packed(x[hit]), row["floors"]))], names=["q_block", "q_ids", "q_rows", "q", "floors"])
