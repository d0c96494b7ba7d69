"""Approximate nearest neighbours over a hierarchical k-means tree.

Nearness is the inner product in double precision. The tree is fitted on a
bounded hashed sample (``SAMPLE`` vectors at most) by splitting nodes with
k-means until they hold ``leaf`` sampled vectors; every vector is then indexed in
the leaf it descends to. A query walks the tree best bin first: a priority queue
holds nodes by the query's inner product with their centre, the best is opened,
and leaves are visited in the order they come out, ``visits`` of them. How many
is calibrated: the visits widen until the recall of ``CALIBRATION`` sampled
queries, against an exact search of all rows in blocks, reaches ``RECALL``.

A leaf's vectors are cut into blocks of about ``BLOCK`` rows and the queries that
visit it into slices of about ``SLICE``; each pair of a block and a slice is a
task's group, so neither a popular vector nor a popular leaf is gathered whole.

Defined cases. Vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part, nor do null ids. Of rows that repeat
a query's id one (the smallest vector) is the query; every row with that id is
the query's own and no candidate. Other repeated rows are candidates each, dealt
over blocks like any others. Ties go to the smaller id. No valid vector: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topoprofile.runtime import materialize

TOP = 20
SAMPLE = 20_000
CALIBRATION = 200
RECALL = 0.95
BRANCH = 8
#: Leaves for n vectors: LEAVES * n ** 0.25, so that visits, a share of the leaves, grow slowly.
LEAVES = 4
BLOCK = 4_096
SLICE = 2_048
SEED = 11


def valid_vectors(table: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part."""
    fit = F.expr("""vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0
        AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x != 0)""")
    rows = table.select("vec_id", "embedding").where(F.coalesce(fit, F.lit(False)))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("embedding") == sizes[0].n) if sizes else rows


class Tree:
    """Centres, children and leaf numbers of a hierarchical k-means tree."""

    def __init__(self, sample: np.ndarray, leaf: int):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(sample, leaf, np.random.default_rng(SEED))
        self.matrix = np.array(self.centres)

    def _grow(self, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        node = len(self.centres)
        self.centres.append(rows.mean(axis=0))
        self.children.append([])
        self.leaf.append(-1)
        distinct = np.unique(rows, axis=0) if len(rows) > leaf else rows
        if len(rows) > leaf and len(distinct) > 1:
            parts = _kmeans(rows, distinct, min(BRANCH, len(distinct), -(-len(rows) // leaf)), rng)
            if len(parts) > 1:
                self.children[node] = [self._grow(p, leaf, rng) for p in parts]
        if not self.children[node]:
            self.leaf[node] = self.leaves
            self.leaves += 1
        return node

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child's, level by level."""
        out = np.empty(len(rows), np.int32)
        stack = [(0, np.arange(len(rows)))]
        while stack:
            node, which = stack.pop()
            if not len(which):
                continue
            if not (below := self.children[node]):
                out[which] = self.leaf[node]
                continue
            centres = self.matrix[below]
            near = (rows[which] @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
            stack += [(child, which[near == k]) for k, child in enumerate(below)]
        return out

    def visit(self, query: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order, ``most`` of them at most."""
        products = (self.matrix @ query).tolist()
        queue, out = [(-products[0], 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            for child in self.children[node]:
                heapq.heappush(queue, (-products[child], child))
        return out


def _kmeans(rows: np.ndarray, distinct: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(12):
        near = (rows @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        parts = [rows[near == j] for j in range(k)]
        centres = np.array([p.mean(axis=0) for p in parts if len(p)])
        k = len(centres)
    return [p for p in parts if len(p)]


def _top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, top: int) -> pd.DataFrame:
    """Each query's nearest rows, own id excepted: ``query_id, vec_id, score``.

    A matrix product names all rows within rounding of the ``top``-th; the scores
    themselves are sums taken row by row in one order, so equal vectors tie.
    """
    out = []
    for at in range(0, len(queries), 256):
        near = queries[at : at + 256] @ rows.T
        near[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        scale = np.abs(rows).max() * np.abs(queries[at : at + 256]).max() * rows.shape[1] * 1e-12
        for name, query, product in zip(query_ids[at : at + 256], queries[at : at + 256], near, strict=True):
            least = np.partition(product, -top)[-top] if len(product) > top else -np.inf
            close = np.flatnonzero((product >= least - scale) & (product > -np.inf))
            scores = (rows[close] * query).sum(axis=1)
            best = close[order := np.lexsort((ids[close], -scores))[:top]]
            out.append(pd.DataFrame({"query_id": name, "vec_id": ids[best], "score": scores[order]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


_FOUND = "query_id long, vec_id long, score double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def exact_search(vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, top: int = TOP) -> DataFrame:
    """Nearest rows of a bounded query set against all rows, in blocks, a task's best first."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for frame in frames:
            for at in range(0, len(frame), 16_384):
                part = frame.iloc[at : at + 16_384]
                held.append(_top(query_ids, queries, part["vec_id"].to_numpy(), _matrix(part["embedding"]), top))
                held = [_best(pd.concat(held), top)]
        yield from held

    return _ranked(vectors.mapInPandas(search, _FOUND), top)


def _best(found: pd.DataFrame, top: int) -> pd.DataFrame:
    return found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(top)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def fit(vectors: DataFrame, rows: int) -> tuple[Tree, np.ndarray]:
    """A tree from a hashed sample; and the sample's ids."""
    share = min(1.0, SAMPLE / max(rows, 1) * 0.9)
    hashed = F.pmod(F.xxhash64("vec_id", "embedding", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    sample = vectors.where(hashed).limit(SAMPLE).toPandas()
    if not len(sample):  # few distinct rows, none of them hashed into the sample
        sample = vectors.limit(SAMPLE).toPandas()
    leaf = max(8, round(len(sample) / (LEAVES * max(rows, 1) ** 0.25)))
    return Tree(_matrix(sample["embedding"]), leaf), sample["vec_id"].to_numpy()


def calibrate(vectors: DataFrame, indexed: DataFrame, queries: DataFrame, tree: Tree, top: int = TOP) -> int:
    """Fewest leaf visits at which sampled queries reach ``RECALL``."""
    picked = queries.orderBy(F.xxhash64("query_id", F.lit(SEED + 1)), "query_id").limit(CALIBRATION).toPandas()
    if not len(picked):
        return tree.leaves
    ids, matrix = picked["query_id"].to_numpy(), _matrix(picked["embedding"])
    truth = materialize(exact_search(vectors, ids, matrix, top).select("query_id", "vec_id"), "truth")
    # CALIBRATION * top ids: bounded
    placed = indexed.select("vec_id", "leaf").join(F.broadcast(truth), "vec_id").select("query_id", "leaf").toPandas()
    order = {q: {leaf: n for n, leaf in enumerate(tree.visit(v, tree.leaves))} for q, v in zip(ids.tolist(), matrix, strict=True)}
    needed = np.sort([order[q][leaf] + 1 for q, leaf in zip(placed["query_id"].tolist(), placed["leaf"].tolist(), strict=True)])
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)]) if len(needed) else tree.leaves


def search(vectors: DataFrame, queries: DataFrame, tree: Tree, visits: int, indexed: DataFrame, top: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score`` from the visited leaves."""
    sizes = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                leaves = [tree.visit(q, visits) for q in _matrix(frame["embedding"])]
                yield frame.assign(leaf=leaves).explode("leaf").astype({"leaf": "int32"})[["query_id", "embedding", "leaf"]]

    kind = dict(vectors.dtypes)["embedding"]
    walked = materialize(queries.mapInPandas(walk, f"query_id long, embedding {kind}, leaf int"), "visits")
    asked = walked.groupBy("leaf").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    # one row per leaf of a tree whose sample is bounded
    shape = materialize(sizes.join(asked, "leaf"), "leaves")
    wide = lambda d, own, other: (
        d.join(F.broadcast(shape), "leaf").withColumn(own, F.pmod(F.monotonically_increasing_id(), F.col(f"{own}s")).cast("int")).withColumn(other, F.explode(F.expr(f"sequence(0, {other}s - 1)")))
    )
    keys = ["leaf", "block", "slice"]
    left = wide(indexed, "block", "slice").select("vec_id", "embedding", *keys)
    right = wide(walked, "slice", "block").select("query_id", "embedding", *keys)

    def near(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _top(asked["query_id"].to_numpy(), _matrix(asked["embedding"]), rows["vec_id"].to_numpy(), _matrix(rows["embedding"]), top)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(near, _FOUND)
    return _ranked(found, top).select("query_id", "rank", "vec_id", "score")


def index(vectors: DataFrame, tree: Tree) -> DataFrame:
    """Every vector with its leaf, written in the shared folder."""

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(leaf=tree.assign(_matrix(frame["embedding"])))

    kind = dict(vectors.dtypes)["embedding"]
    return materialize(vectors.mapInPandas(assign, f"vec_id long, embedding {kind}, leaf int"), "ann-index")


def nearest(table: DataFrame, is_query, top: int = TOP) -> DataFrame:
    """The ``top`` nearest of every row that ``is_query`` selects, among all other rows."""
    vectors = materialize(valid_vectors(table), "vectors")
    rows = vectors.count()
    if not rows:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = vectors.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    queries = materialize(queries, "queries")
    tree, _ = fit(vectors, rows)
    indexed = index(vectors, tree)
    visits = calibrate(vectors, indexed, queries, tree, top)
    return search(vectors, queries, tree, visits, indexed, top)


def op7_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th embedding."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
