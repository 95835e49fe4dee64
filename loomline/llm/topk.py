"""Exact top-k by inner product: every query against every row, a term at a time.

Rows and queries are packed into blocks of a bounded size; each pair of a query block and a row block is a task of its
own, so work spreads over the grid and no task holds more than two blocks. Within it, a row block's postings (the rows
with a non-zero weight, term by term) are weighted by the queries' non-zero weights and scattered into a dense array of
scores; a partition then selects each query's best, and the blocks' selections merge. Sums are of integers and exact.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null id. A missing
component counts as 0. Rows that share a query's id are its own and no candidates; otherwise repeated rows count one by one, ties go to
the smaller id. Without queries or rows the result is empty. Scores that 64 bits might not hold are an error, not wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS, QUERIES, TILE = 8192, 2048, (64, 4096)


def valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def quantise(vector: Column, scale: float = 64.0) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


def pack(df: DataFrame, blocks: int, name: str) -> DataFrame:
    """A row per block: its number, ids in order, and the vectors as a matrix."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        ids = part.column("_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        rows = part.column("_v").to_pylist()
        wide = max(map(len, rows))
        matrix = np.array([r + [0] * (wide - len(r)) for r in rows], np.int64).reshape(len(rows), wide)[order]
        narrow = matrix.astype(np.int32) if matrix.max(initial=0) < 1 << 31 and matrix.min(initial=0) >= -(1 << 31) else matrix
        return pa.table({f"{name}_block": pa.array([key[0].as_py()], pa.int32()), f"{name}_ids": pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()), f"{name}_matrix": pa.array([narrow.tobytes()], pa.binary()), f"{name}_wide": pa.array([wide], pa.int32())})

    dealt = df.withColumn("_block", F.pmod(F.xxhash64("_id", F.lit(name)), F.lit(blocks)).cast("int"))
    return dealt.groupBy("_block").applyInArrow(run, f"{name}_block int, {name}_ids binary, {name}_matrix binary, {name}_wide int")


def unpack(ids: bytes, matrix: bytes, wide: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    narrow = len(matrix) == 4 * len(own) * wide
    return own, np.frombuffer(matrix, np.int32 if narrow else np.int64).reshape(len(own), wide)


def accumulate(queries: np.ndarray, rows: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Scores of tiles of queries and rows, whole numbers held exactly by the narrowest kind that can."""
    terms = min(queries.shape[1], rows.shape[1])
    size = lambda x: np.abs(x[:, :terms].astype(np.float64))
    most = (size(queries) @ size(rows).max(0, initial=0)).max(initial=0) * 1.001 if terms else 0
    if most >= 1 << 63:
        raise OverflowError("scores may need more than 64 bits")
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    weights = np.ascontiguousarray(queries.T.astype(kind))
    columns = np.ascontiguousarray(rows.T.astype(kind))
    for r in range(0, len(rows), TILE[1]):
        tile = columns[:terms, r : r + TILE[1]]
        postings = [np.flatnonzero(c) for c in tile]
        for q in range(0, len(queries), TILE[0]):
            own = weights[:, q : q + TILE[0]]
            scores = np.zeros((own.shape[1], tile.shape[1]), kind)
            spare = np.empty_like(scores)
            for t in range(terms):
                asks = np.flatnonzero(own[t])
                if 2 * len(postings[t]) > tile.shape[1] and 2 * len(asks) > len(own[t]):  # most rows and queries have the term
                    np.multiply.outer(own[t], tile[t], out=spare)
                    scores += spare
                elif len(postings[t]) and len(asks):
                    scores[np.ix_(asks, postings[t])] += np.multiply.outer(own[t, asks], tile[t, postings[t]])
            yield slice(q, q + TILE[0]), slice(r, r + TILE[1]), scores


def select(scores: np.ndarray, query_ids: np.ndarray, row_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, row ids, scores) of each query's k best; of equal scores those with smaller ids, as rows are in order."""
    scores = scores.astype(np.int64)
    own = query_ids[:, None] == row_ids
    for i, line in enumerate(scores):
        places = np.flatnonzero(~own[i])
        line = line[places]
        if len(line) > k:
            edge = np.partition(line, len(line) - k)[len(line) - k]
            above = np.flatnonzero(line > edge)
            level = np.flatnonzero(line == edge)[: k - len(above)]
            pick = np.concatenate((above, level))
        else:
            pick = np.arange(len(line))
        yield np.full(len(pick), query_ids[i]), row_ids[places[pick]], line[pick]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, rows_in_block: int = ROWS, queries_in_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): vectors and queries have columns _id and _v, a list of long."""
    n, m = vectors.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n // rows_in_block)), max(1, -(-m // queries_in_block))
    pair = (F.col("query_block") * row_blocks + F.col("row_block")).cast("long").alias("_pair")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = pack(vectors, row_blocks, "row").withColumn("query_block", every(query_blocks)).select("*", pair).drop("query_block", "row_block")
    right = pack(queries, query_blocks, "query").withColumn("row_block", every(row_blocks)).select("*", pair).drop("query_block", "row_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                query_ids, own = unpack(row["query_ids"], row["query_matrix"], row["query_wide"])
                row_ids, there = unpack(row["row_ids"], row["row_matrix"], row["row_wide"])
                for q, r, scores in accumulate(own, there):
                    found = [np.concatenate(x) for x in zip(*select(scores, query_ids[q], row_ids[r], k))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    each = left.join(right.hint("shuffle_merge"), "_pair").drop("_pair").mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
