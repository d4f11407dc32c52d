"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt to shards of about ``SHARD`` rows. A task builds the tree of its
shard and sends all queries down it together: a node's vantage point splits its
vectors at the median distance, each query goes to its own side first, and to the
other one only if the triangle inequality allows something nearer there than the
query's tenth best so far, the best being divided by ``relax``. With ``relax`` 1 no
neighbour is missed; above 1, fewer parts are visited. The tree's own distances only choose
candidates; each reported distance is computed anew, in double precision.

Each vector is shuffled once, whatever the number of queries, and each query once to every shard. A
partition is sorted so that a shard's vectors come before its queries: the task grows
the tree once and then sends the queries down it as they arrive, ``BLOCK`` at a time. It
holds one shard and one block. Each shard gives its nearest few per query, and those are merged.

Vectors that are null, empty, zero, or hold a null or a non-finite component take no
part. Vectors of different lengths are not compared with each other. Repeated rows count
each on its own; they are counted before they are dealt, so that they make no shard large. A query
is not its own neighbour: rows with its id are left out. Equal queries are one; queries of one id with
different vectors share its places.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD = 16_384
BLOCK = 2_048
LEAF = 256
RELAX = 3.0

FOUND = "query_id long, vec_id long, score double, copies long"


class Tree:
    """A vantage-point tree over the rows of ``vectors``."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, seed: int = 5):
        self.vectors, self.leaf, self.draw = vectors, leaf, np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(vectors)))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        at = self.draw.integers(len(rows))
        point, rows = rows[at], np.delete(rows, at)
        apart = distances(self.vectors[point : point + 1], self.vectors[rows])[0]
        order = np.argsort(apart, kind="stable")
        half = len(rows) // 2
        near, far = rows[order[:half]], rows[order[half:]]
        # The bounds of both sides: tighter than the median alone where there is a gap.
        return point, apart[order[half - 1]], apart[order[half]], self._grow(near), self._grow(far)

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, relax: float):
        """(distances, rows) of the k nearest of each query; rows are -1 where there are fewer."""
        best = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1)

        def offer(which: np.ndarray, rows: np.ndarray, apart: np.ndarray) -> None:
            apart = np.where(ids[rows][None] == own[which][:, None], np.inf, apart)
            d = np.concatenate([best[0][which], apart], axis=1)
            r = np.concatenate([best[1][which], np.broadcast_to(rows, apart.shape)], axis=1)
            r = np.where(np.isinf(d), -1, r)
            name = np.where(r >= 0, ids[r], np.iinfo(np.int64).max)
            order = np.lexsort((name, d), axis=1)[:, :k]
            best[0][which], best[1][which] = np.take_along_axis(d, order, 1), np.take_along_axis(r, order, 1)

        def visit(node, which: np.ndarray) -> None:
            if not len(which):
                return
            if isinstance(node, np.ndarray):
                offer(which, node, distances(queries[which], self.vectors[node]))
                return
            point, inner, outer, near, far = node
            apart = distances(queries[which], self.vectors[point : point + 1])
            offer(which, np.array([point]), apart)
            apart = apart[:, 0]
            inside = apart <= (inner + outer) / 2
            visit(near, which[inside])
            visit(far, which[~inside])
            # No vector of the other side can be nearer than this.
            reach = best[0][which, -1] / relax
            visit(far, which[inside & (outer - apart <= reach)])
            visit(near, which[~inside & (apart - inner <= reach)])

        visit(self.root, np.arange(len(queries)))
        return best


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; differences first, so equal vectors are at 0."""
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 64):  # bounds the differences held at once
        out[i : i + 64] = np.sqrt(((a[i : i + 64, None] - b[None]) ** 2).sum(2))
    return out


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _search(k: int, relax: float, block: int):
    """For ``mapInArrow`` over partitions that :func:`dealt` made."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree, ids, copies = None, [], None, None, None
        for batch in batches:
            keys = np.stack([batch.column(name).to_numpy(zero_copy_only=False) for name in ("length", "shard", "asked")])
            starts = [0, *(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1), batch.num_rows]
            for start, end in zip(starts, starts[1:]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if shard != tuple(keys[:2, start]):
                    shard, held, tree = tuple(keys[:2, start]), [], None
                if not keys[2, start]:
                    held.append(part)
                    continue
                if held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    tree = Tree(np.concatenate([_matrix(chunk) for chunk in table.column("vector").chunks]))
                    ids, copies, held = table.column("vec_id").to_numpy(), table.column("copies").to_numpy(), []
                if tree is None:
                    continue
                queries, own = _matrix(part.column("vector")), part.column("vec_id").to_numpy()
                for at in range(0, len(own), block):
                    asked, names = queries[at : at + block], own[at : at + block]
                    _, rows = tree.search(asked, names, ids, k, relax)
                    q, rank = np.nonzero(rows >= 0)
                    hit = rows[q, rank]
                    score = np.sqrt(((asked[q] - tree.vectors[hit]) ** 2).sum(1))
                    columns = [pa.array(c) for c in (names[q], ids[hit], score, copies[hit])]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "copies"])

    return run


def usable(df: DataFrame) -> DataFrame:
    """Each distinct (vec_id, vector) that takes part, with its length and number of copies."""
    rows = df.where("vec_id IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("copies")).withColumn("length", F.size("vector"))


def dealt(vectors: DataFrame, queries: DataFrame, shards: int) -> DataFrame:
    """Vectors each in one shard, queries in all, a shard's vectors first and in order, so that reruns agree."""
    places = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int"))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = places.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)))
    return both.repartition(shards, "length", "shard").sortWithinPartitions("length", "shard", "asked", "vec_id", "vector")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, relax: float = RELAX, shard: int = SHARD, block: int = BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of ``vectors`` (vec_id, embedding) to each of ``queries``."""
    vectors, queries = usable(vectors), usable(queries)
    shards = max(1, -(-vectors.count() // shard))
    found = dealt(vectors, queries, shards).mapInArrow(_search(k, relax, block), FOUND)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
