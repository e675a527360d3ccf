"""Exact top-k by inner product with two cover trees, one over the queries and one over the data.

A cover tree's node has a centre, which is one of its points, and a covering radius; its children's
centres lie more than the halved scale apart, and one of them is the node's own centre. For a query node (centre q,
radius a) and a data node (centre x, radius b) no product of two of their points exceeds
q.x + |q| b + |x| a + a b. Where that is below the worst k-th score of the queries of the node, the
pair is pruned with all below it. A bound equal to that score is kept, since a smaller id may win a tie.

The data is read in blocks of `block` rows, a tree each; queries come in blocks of `query_block` rows, which is what a
broadcast holds at most. Each task keeps k results per query, and the last step ranks those of all tasks.

Defined results: vectors that are null, or hold null or non-finite components, and rows with a null
id take no part; shorter vectors count as padded with zeros; repeated rows of the data are results
of their own, repeated ids among the queries are one query; an empty table gives an empty result.
Products are exact while they and their parts stay below 2 ** 53, else they are computed in
Python's integers and held within 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

EXACT = float(1 << 53)


class CoverTree:
    """Over the rows of x: point, radius, children and point lists by node number; node 0 is the root."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        with np.errstate(over="ignore"):
            self.norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        points, radii, self.children = [], [], []
        waiting = [(0, np.arange(1, len(x)), None, -1)]
        while waiting:
            centre, members, far, parent = waiting.pop()
            if far is None:
                far = self._far(centre, members)
            node = len(points)
            points.append(centre)
            radii.append(float(far.max()) if len(members) else 0.0)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if not len(members):
                continue
            if not 0 < radii[node] < np.inf:  # equal points, or too far apart to be measured: a leaf each
                waiting.extend((int(m), members[:0], far[:0], node) for m in (centre, *members))
                continue
            half = radii[node] / 2
            near = far <= half
            waiting.append((centre, members[near], far[near], node))
            members = members[~near]
            while len(members):  # members of a new centre are those within the halved scale of it
                centre, rest = members[0], members[1:]
                far = self._far(centre, rest)
                near = far <= half
                waiting.append((centre, rest[near], far[near], node))
                members = rest[~near]
        self.point = np.array(points)
        # a little wider than measured: rounding mustn't prune
        self.radius = np.array(radii) * (1 + 1e-9) + 1e-6 * (np.array(radii) > 0)
        self.leaf = np.array([not c for c in self.children])

    def _far(self, centre: int, members: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            gap = self.x[members] - self.x[centre]
            return np.nan_to_num(np.sqrt(np.einsum("ij,ij->i", gap, gap)), nan=np.inf, posinf=np.inf)

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """Leaves among nodes, and the children of the others."""
        kids = [k for n in nodes[~self.leaf[nodes]] for k in self.children[n]]
        return np.concatenate([nodes[self.leaf[nodes]], np.array(kids, dtype=np.int64)])

    def descendants(self) -> list[np.ndarray]:
        """Points of each node."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(self.point)
        for n in range(len(self.point) - 1, -1, -1):
            out[n] = np.array([self.point[n]]) if self.leaf[n] else np.concatenate([out[c] for c in self.children[n]])
        return out


class Search:
    """The k best of all blocks seen so far, for each query."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.tree = CoverTree(queries)
        self.of = self.tree.descendants()
        self.query = np.empty(0, int)
        self.score, self.found = np.empty(0), np.empty(0, dtype=np.int64)
        self.worst = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if len(ids):
            width = max(x.shape[1], self.tree.x.shape[1])
            x, self.tree.x = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, self.tree.x))
            self.data, self.data_ids = CoverTree(x), ids
            self._visit(0, np.array([0]))

    def _visit(self, node: int, nodes: np.ndarray) -> None:
        """A query node against data nodes."""
        q, d = self.tree, self.data
        nodes = self._live(np.array([node]), nodes, self.worst[self.of[node]].min())
        if not len(nodes):
            return
        nodes = d.below(nodes)
        kids = np.array(q.children[node] or [node])
        self._base(q.point[kids[q.leaf[kids]]], nodes)
        for k in kids[~q.leaf[kids]]:
            self._visit(int(k), nodes)

    def _live(self, queries: np.ndarray, nodes: np.ndarray, worst: np.ndarray | float) -> np.ndarray:
        """Data nodes that may hold a result for any of the query nodes."""
        q, d = self.tree, self.data
        a, b = q.point[queries], d.point[nodes]
        with np.errstate(over="ignore", invalid="ignore"):
            bound = q.x[a] @ d.x[b].T + q.norm[a][:, None] * d.radius[nodes] + q.radius[queries][:, None] * (d.norm[b] + d.radius[nodes])
            bound = np.where(np.isnan(bound), np.inf, bound)
        return nodes[(bound * (1 + 1e-12) + 1e-3 >= np.reshape(worst, (-1, 1))).any(axis=0)]

    def _base(self, queries: np.ndarray, nodes: np.ndarray) -> None:
        """Single queries against data nodes, down to the points."""
        q, d = self.tree, self.data
        while len(queries) and len(nodes):
            leaf = d.leaf[nodes]
            if leaf.any():
                self._take(queries, d.point[nodes[leaf]])
            nodes = nodes[~leaf]
            if len(nodes):
                b = d.point[nodes]
                with np.errstate(over="ignore", invalid="ignore"):
                    bound = q.x[queries] @ d.x[b].T + q.norm[queries][:, None] * d.radius[nodes]
                    bound = np.where(np.isnan(bound), np.inf, bound)
                nodes = d.below(nodes[(bound + 1e-3 >= self.worst[queries][:, None]).any(axis=0)])

    def _take(self, queries: np.ndarray, points: np.ndarray) -> None:
        scores = products(self.tree.x[queries], self.data.x[points])
        ids = self.data_ids[points]
        other = ids[None, :] != self.ids[queries][:, None]
        least = self.worst[queries][:, None]
        if scores.shape[1] > self.k:  # however many rows have a query's own id, they take no place
            least = np.maximum(least, np.partition(np.where(other, scores, -np.inf), scores.shape[1] - self.k, axis=1)[:, [-self.k]])
        row, col = np.nonzero((scores >= least) & other)
        query = np.concatenate([self.query, queries[row]])
        score, found = np.concatenate([self.score, scores[row, col]]), np.concatenate([self.found, ids[col]])
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.query, self.score, self.found = query[keep], score[keep], found[keep]
        last = rank == self.k - 1
        self.worst[query[last]] = score[last]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; exact within 64 bits."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < EXACT:
        return a @ b.T
    whole = np.array([[int(v) for v in row] for row in a], dtype=object) @ np.array([[int(v) for v in row] for row in b], dtype=object).T
    return np.clip(whole, -(1 << 63) + 1, (1 << 63) - 1)


def matrix(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, rows padded with zeros."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(scale * column.flatten().to_numpy())
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def top_k(data: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, block: int = 2048, query_block: int = 2048) -> DataFrame:
    """query_id, rank, found id (as vec_id) and score: the k largest inner products of each query with all other rows."""
    spark = data.sparkSession
    broken = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = data.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~F.coalesce(broken, F.lit(True)))
    rows = usable.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    queries = usable.where(is_query).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).dropDuplicates(["id"])
    queries = materialize(queries, "queries")
    blocks = -(-queries.count() // query_block)
    out = None
    for n in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).orderBy("id").toArrow()
        if not own.num_rows:
            continue
        shared = spark.sparkContext.broadcast((own.column("id").to_numpy(), matrix(own.column("v").combine_chunks(), scale)))

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = Search(*shared.value, k)
            held: list[pa.RecordBatch] = []

            def read() -> None:
                table = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                for a in range(0, table.num_rows, block):
                    part = table.slice(a, block)
                    best.add(part.column("id").to_numpy(), matrix(pa.concat_arrays(part.column("v").chunks), scale))

            for batch in batches:
                held.append(batch)
                if sum(x.num_rows for x in held) >= block:
                    read()
            if held:
                read()
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[best.query]), pa.array(best.found), pa.array([int(x) for x in best.score], pa.int64())], names=["query_id", "vec_id", "score"])

        got = rows.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
