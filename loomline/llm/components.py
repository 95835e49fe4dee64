"""Connected components of a graph given as edges, by large stars and forests of whole partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import HOT_SHARE, cut, drop_scratch, give_back, lookup, scratch_path

#: Edges whose forest is made at once, in a task.
AT_ONCE = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it reaches by these edges) of each node but the smallest ones."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    parent = np.arange(len(ids))
    while True:
        at_u, at_v = parent[u], parent[v]
        apart = at_u != at_v
        if not apart.any():
            inner = np.flatnonzero(parent != np.arange(len(ids)))
            return ids[inner], ids[parent[inner]]
        u, v, at_u, at_v = u[apart], v[apart], at_u[apart], at_v[apart]
        np.minimum.at(parent, np.maximum(at_u, at_v), np.minimum(at_u, at_v))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def forest(edges: DataFrame) -> DataFrame:
    """(a, b) with b the smallest node that a reaches by the edges in its partition, AT_ONCE or so at a time.

    The last node of one lot waits for the next with what it reaches, so rows sorted by a keep a node's links together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots, size = [], 0

        def done(more: bool) -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate(x) for x in zip(*lots))
            node, root = stars(a, b)
            if more:
                last = node == a[-1]
                lots[:] = [(node[last], root[last])]
                node, root = node[~last], root[~last]
            rows = pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])
            for start in range(0, rows.num_rows, 1 << 17):
                yield rows.slice(start, 1 << 17)

        for batch in batches:
            if batch.num_rows:
                lots.append((np.asarray(batch.column("a")), np.asarray(batch.column("b"))))
                size += batch.num_rows
            if size >= AT_ONCE:
                yield from done(True)
                size = 0
        if lots:
            yield from done(False)
        lots.clear()
        give_back()

    return edges.mapInArrow(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a, b): the smallest node that each reaches. Loops and nulls are passed over; edges may repeat.

    A large star links a node's larger neighbours to its smallest, and the forest of each partition the smaller ones and
    itself, so distances to the root fall by half or so each time, and most links go before any shuffle. Minima are taken
    map-side first, and nodes that hold a large share of the edges meet theirs by broadcast; a node has a row per forest
    at most. So no task gathers a node's neighbours.
    """
    given = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    spark, path = edges.sparkSession, None

    def by_node(rows: DataFrame) -> DataFrame:
        """The next round's edges; the last round's table is not needed any more."""
        nonlocal path
        old, path = path, scratch_path(spark, "edges")
        done = cut(forest(rows.repartition("a").sortWithinPartitions("a")), "edges", path)
        if old:
            drop_scratch(spark, old)
        return done

    now = by_node(forest(given))
    while True:
        both = now.select("a", "b", F.lit(1).alias("up")).union(now.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0)))
        nodes = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"), F.sum("up").alias("up"))
        # done if every node has one smaller neighbour, and none of these has one itself
        n, open_nodes = nodes.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("_n") > 1)))).first()
        if not open_nodes:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        # only a node that has a smaller neighbour moves its larger ones; hot ones without stay, so that their rows aren't dealt by them
        least = nodes.where((F.col("up") > 0) | (F.col("_n") >= max(2, 2 * n // HOT_SHARE))).select(F.col("a").alias("b"), F.when(F.col("up") > 0, F.col("m")).alias("m"), "_n")
        now = by_node(lookup(now, least, "b", "_n", 2 * n).select("a", F.coalesce("m", "b").alias("b")))
