"""Exact top-k search by tiled matrix products, selection inside tiles and a tree of merges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets

FAN_IN = 32
#: Queries and rows of one tile: one matrix product.
TILE = (1024, 8192)


def usable(vector: Column) -> Column:
    """True for vectors that are there and hold finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def _matrix(rows: pa.Table, scale: float) -> np.ndarray:
    """The vectors scaled and floored; what passes a double stands at the largest one, as its scores pass a long anyhow."""
    flat = rows["vector"].combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) and flat.num_chunks else flat
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(values * scale))


def _tile_best(a: np.ndarray, b: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and scores of the best ``k`` rows ``b`` for each query ``a``; the rows stand by id, a query's own are left out.

    Products are exact: in doubles while they fit, else in Python's integers, cut off at the bounds of a long.
    """
    n = min(k, len(b))
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1])
    first, after = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    if (most + 2) * len(b) < 2.0**53:
        # score and place in one number: all differ, the greater score first and then the smaller place
        keys = (a @ b.T) * len(b) + np.arange(len(b) - 1, -1, -1)
        for i in np.flatnonzero(first < after).tolist():
            keys[i, first[i] : after[i]] = -np.inf
        best = -np.sort(-np.partition(keys, len(b) - n, axis=1)[:, len(b) - n :], axis=1)
        found = []
        for row in best:
            row = row[np.isfinite(row)].astype(np.int64)
            found.append((len(b) - 1 - row % len(b), row // len(b)))
        return found
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    scores, found = whole[0].dot(whole[1].T), []
    for i, row in enumerate(scores if a.shape[1] else np.zeros((len(a), len(b)), object)):
        others = [j for j in range(len(b)) if not first[i] <= j < after[i]]
        at = sorted(others, key=lambda j: (-max(-(2**63), min(2**63 - 1, row[j])), j))[:k]
        found.append((np.array(at, np.int64), np.array([max(-(2**63), min(2**63 - 1, row[j])) for j in at], np.int64)))
    return found


def _block(k: int, scale: float, tile: tuple[int, int]):
    """The best ``k`` rows of a shard for each query of a block, tile by tile."""

    def each(queries: pa.Table, rows: pa.Table) -> pa.Table:
        query, vec, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(queries) and len(rows):
            rows = rows.sort_by("vec_id")
            ids, shard = rows["vec_id"].to_numpy(), rows["shard"][0].as_py()
            for q in range(0, len(queries), tile[0]):
                some = queries.slice(q, tile[0])
                own, a = some["vec_id"].to_numpy(), _matrix(some, scale)
                lists = [([], []) for _ in own]
                for r in range(0, len(rows), tile[1]):
                    found = _tile_best(a, _matrix(rows.slice(r, tile[1]), scale), own, ids[r : r + tile[1]], k)
                    for (at, s), mine in zip(found, lists, strict=True):
                        mine[0].append(ids[r + at])
                        mine[1].append(s)
                for i, (at, s) in enumerate(lists):
                    at, s = np.concatenate(at), np.concatenate(s)
                    best = np.lexsort((at, ~s))[:k]  # ~s falls as s grows, and no long overflows
                    query.append(np.full(len(best), own[i]))
                    vec.append(at[best])
                    score.append(s[best])
        n = sum(map(len, query))
        columns = {"query_id": query, "vec_id": vec, "score": score}
        table = {c: pa.array(np.concatenate(v), pa.int64()) for c, v in columns.items()}
        return pa.table(table | {"shard": pa.array(np.full(n, shard if n else 0), pa.int64())})

    return each


def top_k(
    queries: DataFrame,
    rows: DataFrame,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_block: int = 32_768,
    shard_rows: int = 32_768,
    tile: tuple[int, int] = TILE,
) -> DataFrame:
    """For each row of ``queries`` its ``k`` best rows: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Components are scaled and floored to whole numbers; the score is their inner product, ties go to the smaller id,
    and a query never finds its own id. Queries are dealt by hash into blocks and rows into shards, as they are
    stored; each pair of a block and a shard goes to one task, which multiplies it ``tile`` by tile and selects
    from each tile. The lists of the best k of each query meet ``FAN_IN`` shards at a time, level by level, so that no
    task ever holds all lists of a query however many shards there are. The result is exact for any block and shard
    size.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids; vectors of different
    lengths are never compared. Rows that repeat an id are rows of their own: each is a candidate, and the lists of
    queries of one id are one list. Scores beyond a long are cut off at its bounds. Empty tables give an empty result;
    extra columns are ignored.
    """
    def clean(df: DataFrame) -> DataFrame:
        slim = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
        return slim.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))

    rows, queries = clean(rows), clean(queries)
    blocks, shards = buckets(queries.count(), query_block), buckets(rows.count(), shard_rows)
    to_block = F.pmod(F.xxhash64("vec_id", "vector", F.lit("block")), F.lit(blocks).cast("long"))
    to_shard = F.pmod(F.xxhash64("vec_id", "vector", F.lit("shard")), F.lit(shards).cast("long"))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    # a stated query set against all rows, in blocks
    tiled_queries = queries.select("vec_id", "vector", "dim", to_block.alias("block"), every(shards).alias("shard"))
    tiled_rows = rows.select("vec_id", "vector", "dim", to_shard.alias("shard"), every(blocks).alias("block"))
    pair = ["dim", "block", "shard"]
    lists = (
        tiled_queries.groupBy(*pair)
        .cogroup(tiled_rows.groupBy(*pair))
        .applyInArrow(_block(k, scale, tile), "query_id long, vec_id long, score long, shard long")
    )
    best = [F.col("score").desc(), F.col("vec_id")]
    while shards > FAN_IN:
        shards = buckets(shards, FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
        near = Window.partitionBy("query_id", "shard").orderBy(*best)
        lists = lists.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).drop("rank")
    last = Window.partitionBy("query_id").orderBy(*best)
    return (
        lists.withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
