"""Exact top-k inner products by Fagin's threshold algorithm.

Rows are dealt into shards and queries into blocks of bounded size; a task
holds one shard's sorted per-dimension lists and answers one block.  For each
query the lists are read from their better end, each newly seen row is scored
in full, and reading stops when the sum of the list frontiers times the query
can't reach the k-th score.  A last step merges k rows of each shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import in_arrow

SHARD_ROWS, BLOCK_QUERIES = 16_384, 2_048
#: Entries of a list that are read in the first round; rounds double.
FIRST_DEPTH = 32


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & fine


class Lists:
    """Sorted lists of a shard, one per dimension, with the rows behind them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]
        self.order = np.ascontiguousarray(np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.rows.T, self.order, axis=1))

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows whose id isn't ``own``, ties to the smaller id."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        up, down = used[query[used] > 0], used[query[used] < 0]
        weights = np.concatenate((query[up], query[down]))
        seen = np.zeros(n, dtype=bool)
        best, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.rows.dtype)
        depth, step = 0, FIRST_DEPTH
        if not len(used):  # every row scores 0
            best = np.flatnonzero(self.ids != own)[:k]
            return self.ids[best], np.zeros(len(best), dtype=self.rows.dtype)
        while depth < n:
            to = min(n, depth + step)
            fresh = np.zeros(n, dtype=bool)
            fresh[self.order[up, n - to : n - depth].reshape(-1)] = True
            fresh[self.order[down, depth:to].reshape(-1)] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            new = new[self.ids[new] != own]
            best, scores = np.concatenate((best, new)), np.concatenate((scores, self.rows[new] @ query))
            if len(best) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                good = scores >= kth
                best, scores = best[good], scores[good]
                first = np.lexsort((best, -scores))[:k]
                best, scores = best[first], scores[first]
            frontier = np.concatenate((self.sorted[up, n - to], self.sorted[down, to - 1]))
            if len(best) == k and scores.min() > (frontier * weights).sum():
                break
            depth, step = to, step * 2
        first = np.lexsort((best, -scores))
        return self.ids[best[first]], scores[first]


def _matrix(lists: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims), dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _answer(k: int):
    def solve(shard: tuple[list, list], block: tuple[list, list, list]) -> pa.RecordBatch | None:
        if not shard[0] or not block[0]:
            return None
        dims = max(max(map(len, shard[1])), max(map(len, block[2])), 1)
        rows, queries = _matrix(shard[1], dims), _matrix(block[2], dims)
        bound = int(np.abs(rows).max()) * int(np.abs(queries).max()) * dims
        if bound < 2**53:  # sums are whole numbers that doubles hold exactly
            rows, queries = rows.astype(np.float64), queries.astype(np.float64)
        elif bound >= 2**63:
            rows, queries = rows.astype(object), queries.astype(object)
        lists = Lists(np.array(shard[0], dtype=np.int64), rows)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for key, own, query in zip(block[0], block[1], queries, strict=True):
            ids, scores = lists.top(own, query, k)
            out[0].extend([key] * len(ids))
            out[1].extend([own] * len(ids))
            out[2].extend(ids.tolist())
            out[3].extend(min(max(int(s), -(2**63)), 2**63 - 1) for s in scores)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["qkey", "query_id", "vec_id", "score"])

    def stage(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, block = None, ([], []), ([], [], [])
        for part in parts:
            groups = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
            vectors = part.column(5)
            flat, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for i, (role, key, vec_id) in enumerate(zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                if groups[i] != at:
                    if at is not None and (found := solve(shard, block)) is not None:
                        yield found
                    at, shard, block = groups[i], ([], []), ([], [], [])
                vector = flat[offsets[i] : offsets[i + 1]]
                if role == 0:
                    shard[0].append(vec_id)
                    shard[1].append(vector)
                else:
                    block[0].append(key)
                    block[1].append(vec_id)
                    block[2].append(vector)
        if at is not None and (found := solve(shard, block)) is not None:
            yield found

    return stage


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows.

    Scores are inner products of floor(scale * x); ties go to the smaller id; a
    query's own id is no candidate.  Rows with a null id, a null vector or a
    null or non-finite component take no part; shorter vectors count as padded
    with zeros; repeated queries are one, repeated rows are several candidates.
    """

    def rows(df: DataFrame) -> DataFrame:
        kept = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
        return kept.select("vec_id", scaled(F.col("v"), scale).alias("v")).withColumn("key", F.xxhash64("vec_id", "v"))

    base, asked = rows(vectors), rows(queries).dropDuplicates(["vec_id", "v"])
    shards = max(1, -(-base.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = base.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"), F.lit(0).alias("role"), "key", "vec_id", "v")
    sent = asked.select(every(shards).alias("shard"), F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("role"), "key", "vec_id", "v")
    met = dealt.unionByName(sent).repartition("shard", "block").sortWithinPartitions("shard", "block", "role")
    found = met.transform(in_arrow, _answer(k), "qkey long, query_id long, vec_id long, score long")
    best = Window.partitionBy("qkey", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
