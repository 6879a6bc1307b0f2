"""Retrieval: the most similar rows of a knowledge base, by an index of cells or exactly, under equality filters.

Vectors become unit vectors; relevance is their product, rounded to 6 digits so that ties are the same everywhere.
The index has cells around centroids that are fitted on a bounded sample; every row belongs to its nearest
cell, and a query looks into its nearest cells only. Rows and queries that share a cell and the filter values meet in
blocks: a block of rows and a chunk of queries are one small matrix product in a task, which gives the best
rows of each query, so that no pair becomes a row of its own. Without an index all rows that agree on the filters are
one cell, which is exact.

Vectors that are null, of another length than the first one, or hold null or non-finite components take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, queries of a chunk.
BLOCK, CHUNK = 2048, 512
#: Rows that cells are fitted on at most, cells at most, and queries that the number of cells to look into is measured with at most.
SAMPLE, MOST_CELLS, MEASURED = 20_000, 1024, 200


@dataclass(frozen=True)
class Index:
    """Centroids of cells, and the rows (key, filter columns, _cell, _v) that belong to them."""

    centroids: np.ndarray
    rows: DataFrame
    key: str
    filters: tuple[str, ...]


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the vectors of `dim` finite components."""
    keep, out = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == dim and None not in v:
            keep.append(i)
            out.append(v)
    x = np.array(out, np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(1)
    x = x[good]
    norm = np.sqrt((x * x).sum(1))
    return np.array(keep, np.int64)[good], x / np.maximum(norm, 1e-12)[:, None]


def _placed(df: DataFrame, key: str, filters: list[str], embedding: str, dim: int, centroids: np.ndarray | None, probes: int) -> DataFrame:
    """(key, filters, _cell, _v): each vector under its `probes` nearest cells, or under cell 0 without centroids."""
    rows = df.select(key, *filters, F.col(embedding).alias("_v"))
    names = rows.columns[:-1]
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _unit(batch.column(n), dim)
            if centroids is None:
                row, cell = np.arange(len(at)), np.zeros(len(at), np.int32)
            else:
                near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes]
                row, cell = np.repeat(np.arange(len(at)), near.shape[1]), near.ravel().astype(np.int32)
            packed = pa.array([v.tobytes() for v in x], pa.binary())
            taken = pa.array(at[row])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(taken) for i in range(n)), pa.array(cell), packed.take(pa.array(row))], names=[*names, "_cell", "_v"])

    schema = rows.drop("_v").schema.add("_cell", "integer").add("_v", "binary")
    return rows.mapInArrow(run, schema)


def _dim(df: DataFrame, embedding: str) -> int:
    row = df.where(F.col(embedding).isNotNull() & (F.size(embedding) > 0)).select(F.size(embedding)).first()
    return row[0] if row else 1


def build_index(kb: DataFrame, filters: list[str], *, key: str = "vec_id", embedding: str = "embedding", cells: int | None = None, rounds: int = 6) -> Index:
    """Cells fitted by spherical k-means on the SAMPLE rows of the smallest key hashes; as many as the root of the rows, MOST_CELLS at most."""
    dim = _dim(kb, embedding)
    n = kb.count()
    sample = kb.select(F.col(embedding).alias("v"), F.xxhash64(key).alias("h")).where("v IS NOT NULL").orderBy("h").limit(SAMPLE).select("v").toArrow()  # SAMPLE rows
    _, x = _unit(sample["v"].combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.float64())), dim)
    k = max(1, min(cells or int(np.sqrt(n)), MOST_CELLS, len(x)))
    centroids = x[:k] if len(x) else np.zeros((1, dim))
    for _ in range(rounds if len(x) else 0):
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(1))
        centroids = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centroids)
    return Index(centroids, _placed(kb, key, filters, embedding, dim, centroids, 1), key, tuple(filters))


def _met(queries: DataFrame, rows: DataFrame, k: int, key: str, on: list[str], dim: int) -> DataFrame:
    """(query_id, on, key, relevance): the k best rows of each query in every block that it meets."""
    there = rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_parts"))
    asked = queries.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_chunks"))
    sizes = there.join(asked, on)
    part = F.pmod(F.xxhash64(key), F.col("_parts")).cast("int").alias("_part")
    chunk = F.pmod(F.xxhash64("query_id"), F.col("_chunks")).cast("int").alias("_chunk")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.join(sizes, on).select(*on, part, all_of("_chunks").alias("_chunk"), key, "_v")
    right = queries.join(sizes, on).select(*on, all_of("_parts").alias("_part"), chunk, "query_id", "_v")
    keys = [*on, "_part", "_chunk"]

    def meet(base: pa.Table, ask: pa.Table) -> pa.Table:
        names = ["query_id", *on, key, "relevance"]
        vectors = [np.frombuffer(b"".join(t["_v"].to_pylist()), np.float64).reshape(-1, dim) for t in (ask, base)]
        score = np.round(vectors[0] @ vectors[1].T, 6) + 0.0
        ids = base[key].combine_chunks()
        order = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable") if base.num_rows else np.zeros(0, np.int64)
        top = np.lexsort((np.broadcast_to(order, score.shape), -score), axis=1)[:, :k] if score.size else np.zeros((len(score), 0), np.int64)
        q, b = np.repeat(np.arange(len(score)), top.shape[1]), top.ravel()
        first = {c: ask[c].take(pa.array(q)) for c in on}
        return pa.table([ask["query_id"].take(pa.array(q)), *first.values(), ids.take(pa.array(b)), pa.array(score[q, b])], names=names)

    schema = queries.select("query_id", *on).schema
    out = schema.add(rows.schema[key]).add("relevance", "double")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, out)


def search(queries: DataFrame, kb: DataFrame | Index, k: int, equal: list[str], *, key: str = "vec_id", embedding: str = "embedding", probes: int | None = None) -> DataFrame:
    """(query_id, equal, key, relevance): candidates for the k best rows of each query among those that agree on the columns `equal`.

    With an Index only the `probes` nearest cells are looked into; with a table all rows are, which is exact. There are at
    most k rows for each block that a query meets; `best` cuts them down. Rows and queries with a null in `equal` match none.
    """
    if isinstance(kb, Index):
        key, dim, centroids = kb.key, kb.centroids.shape[1], kb.centroids
        if set(equal) - set(kb.filters):
            raise ValueError("the index lacks a filter column")
        rows = kb.rows.select(key, *equal, "_cell", "_v")
    else:
        dim, centroids = _dim(kb, embedding), None
        rows = _placed(kb, key, equal, embedding, dim, None, 1)
    asked = _placed(queries, "query_id", equal, embedding, dim, centroids, probes or (len(centroids) if centroids is not None else 1))
    return _met(asked, rows, k, key, [*equal, "_cell"], dim).drop("_cell")


def best(hits: DataFrame, k: int, by: list[str], key: str = "vec_id") -> DataFrame:
    """The k most relevant hits per group with their rank; ties to the smaller key."""
    w = Window.partitionBy(*by).orderBy(F.desc("relevance"), key)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_retry(queries: DataFrame, kb: DataFrame | Index, k: int, equal: list[str], *, key: str = "vec_id", probes: int | None = None) -> DataFrame:
    """(query_id, key, relevance, rank, filtered): like `search`, and queries whose filters leave no row are asked again without any."""
    hits = best(search(queries, kb, k, equal, key=key, probes=probes), k, ["query_id"], key).select("query_id", key, "relevance", "rank", F.lit(True).alias("filtered"))
    rest = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    again = best(search(rest, kb, k, [], key=key, probes=probes), k, ["query_id"], key).select("query_id", key, "relevance", "rank", F.lit(False).alias("filtered"))
    return hits.unionByName(again)


def probes_for(index: Index, kb: DataFrame, queries: DataFrame, k: int, equal: list[str], *, least: float = 0.95, embedding: str = "embedding") -> int:
    """How many cells to look into so that `least` of the k best rows are found, measured exactly with MEASURED queries at most."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED)
    true = best(search(some, kb, k, equal, key=index.key, embedding=embedding), k, ["query_id"], index.key)
    cells = true.select("query_id", index.key).join(index.rows.select(index.key, "_cell"), index.key).select("query_id", "_cell").toArrow()  # MEASURED * k rows
    asked = _placed(some, "query_id", [], embedding, index.centroids.shape[1], None, 1).toArrow()
    unit = {q: np.frombuffer(v, np.float64) for q, v in zip(asked["query_id"].to_pylist(), asked["_v"].to_pylist(), strict=True)}
    rank = []
    for q, cell in zip(cells["query_id"].to_pylist(), cells["_cell"].to_pylist(), strict=True):
        near = index.centroids @ unit[q]
        rank.append(int((near > near[cell]).sum()))
    return int(np.quantile(rank, least, method="inverted_cdf")) + 1 if rank else 1
