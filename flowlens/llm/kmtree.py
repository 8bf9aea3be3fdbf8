"""Operator 4, approximate nearest neighbours by a hierarchical k-means tree.

* The tree is fitted on unit vectors: a bounded sample (``SAMPLE`` rows, smallest hash of
  id and vector) is split by k-means with ``BRANCH`` centres until a node holds at most
  ``LEAF`` sample rows. Every row of the table is then routed to a leaf.
* A search goes best-bin-first: a priority queue holds the unexplored branches by their
  distance to the query, each pop descends to a leaf.
* Leaf visits are widened until the recall is calibrated: ``CALIBRATION`` queries are
  compared exactly with every row, the visits each true neighbour needs are read off its
  leaf's rank in that query's visiting order, and every query visits as many leaves as
  reach ``RECALL`` on them. A query whose leaves hold fewer candidates than asked for goes
  on until they do.
* Visited (query, leaf) pairs meet the leaf's vectors in blocks: a leaf with more than
  ``BLOCK`` rows is dealt over several blocks, so a leaf that holds a third of all rows is
  many small groups. Scores are exact cosines of the original vectors in double precision.

Rows with a null, empty, zero or differently long vector, or a null or non-finite
component, take no part (the length is that of most rows), nor do rows with a null id.
Repeated ids: every row is a candidate of its own and is a query once per id and vector;
a query's own id is never its neighbour. Fewer candidates than asked for: all are
returned. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from flowlens.llm import common as C

SAMPLE, BRANCH, LEAF = 20_000, 16, 100
CALIBRATION, RECALL = 64, 0.96
BLOCK, QUERY_BLOCK = 4000, 2000
#: Room for rounding of the matrix product when candidates are taken.
SLACK = 1e-9
VECTOR = T.ArrayType(T.DoubleType())


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows that take part, vectors as doubles."""
    v = F.col("v")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                     F.col(f"`{vec_col}`").cast(VECTOR).alias("v")).where("id is not null and v is not null")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists(v, lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long arrow lists as one matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe against overflow of the squares."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """Inner nodes: centres and child numbers; a child below zero is leaf ``-1 - child``."""

    def __init__(self, nodes: list[tuple[np.ndarray, list[int]]], leaves: int):
        self.nodes, self.leaves = nodes, leaves

    @classmethod
    def fit(cls, x: np.ndarray, branch: int, leaf: int, rounds: int = 8) -> Tree:
        """Split a sample of unit rows until every leaf is small or holds equal rows."""
        rng, nodes, leaves = np.random.default_rng(17), [], 0

        def split(rows: np.ndarray) -> int:
            nonlocal leaves
            parts = cls._kmeans(rows, branch, rounds, rng) if len(rows) > leaf else None
            if parts is None:
                leaves += 1
                return -leaves
            at = len(nodes)
            nodes.append((parts[0], []))
            nodes[at][1].extend(split(rows[parts[1] == k]) for k in range(len(parts[0])))
            return at

        if split(x) < 0:
            nodes.append((np.zeros((1, x.shape[1] if x.ndim == 2 else 0)), [-1]))
        return cls(nodes, leaves)

    @staticmethod
    def _kmeans(rows, branch, rounds, rng):
        distinct = np.unique(rows[rng.permutation(len(rows))[:50 * branch]], axis=0)
        if len(distinct) < 2:
            return None
        centres = distinct[rng.permutation(len(distinct))[:branch]]
        for _ in range(rounds):
            near = Tree._distances(rows, centres).argmin(axis=1)
            used = np.unique(near)
            if len(used) < 2:
                return None
            centres = np.stack([rows[near == k].mean(axis=0) for k in used])
        near = Tree._distances(rows, centres).argmin(axis=1)
        used, near = np.unique(near, return_inverse=True)
        return (centres[used], near) if len(used) > 1 else None

    @staticmethod
    def _distances(rows, centres):
        return (centres * centres).sum(axis=1) - 2 * rows @ centres.T

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit row: the nearest centre at every level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if len(x) else []
        while todo:
            at, rows = todo.pop()
            centres, children = self.nodes[at]
            near = self._distances(x[rows], centres).argmin(axis=1)
            for k, child in enumerate(children):
                mine = rows[near == k]
                if child < 0:
                    out[mine] = -1 - child
                elif len(mine):
                    todo.append((child, mine))
        return out

    def visits(self, q: np.ndarray, most: int, rows: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first ``most`` leaves of one unit query in best-bin-first order, and more of them
        until they hold ``need`` rows (``rows``: rows of each leaf)."""
        queue, order, out, held = [(0.0, 0, 0)], 1, [], 0
        while queue and (len(out) < most or held < need):
            _, _, at = heapq.heappop(queue)
            while at >= 0:
                centres, children = self.nodes[at]
                gap = self._distances(q[None], centres)[0]
                best = int(gap.argmin())
                for k, child in enumerate(children):
                    if k != best:
                        heapq.heappush(queue, (float(gap[k]), order, child))
                        order += 1
                at = children[best]
            out.append(-1 - at)
            held += 0 if rows is None else int(rows[-1 - at])
        return out


def fit_tree(rows: DataFrame, sample: int = SAMPLE, branch: int = BRANCH, leaf: int = LEAF) -> Tree:
    """Tree over the ``sample`` rows of smallest hash (the documented bound of the fit)."""
    few = rows.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(sample).select("v")
    x = matrix(few.toArrow()["v"])
    return Tree.fit(unit(x) if len(x) else x, branch, leaf)


def nearest_rows(a: np.ndarray, own: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int):
    """(row of a, row of b, cosine) of each row's ``k`` nearest in b, ties to the smaller id;
    rows of b with the row's own id are left out.

    A matrix product finds the candidates; their cosines are then summed row by row, so that
    equal vectors have equal scores wherever they stand.
    """
    ua, ub = unit(a), unit(b)
    scores = np.where(ids[None, :] == own[:, None], -np.inf, ua @ ub.T)
    if scores.shape[1] > 4 * k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
        r, c = np.nonzero((scores >= kth - SLACK) & (scores > -np.inf))
    else:
        r, c = np.nonzero(scores > -np.inf)
    score = (ua[r] * ub[c]).sum(axis=1)
    order = np.lexsort((ids[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[first], c[first], score[first]


def exact_neighbours(rows: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """Brute force of a bounded query set against all rows: (query, id, leaf, score) of each
    task's best ``k`` (merged by the caller)."""
    qid, q = queries["id"].to_numpy(), np.array(queries["v"].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaf = batch["id"].to_numpy(), batch["leaf"].to_numpy()
            for at in range(0, len(ids), BLOCK):
                part = slice(at, at + BLOCK)
                r, c, s = nearest_rows(q, qid, matrix(batch["v"].slice(at, BLOCK)), ids[part], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid[r]), pa.array(ids[part][c]), pa.array(leaf[part][c]), pa.array(s)],
                    names=["query_id", "vec_id", "leaf", "score"])

    return rows.select("id", "v", "leaf").mapInArrow(
        run, "query_id long, vec_id long, leaf long, score double")


def best(pairs: DataFrame, k: int) -> DataFrame:
    """``rank`` 1..k per query by score, ties to the smaller id."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def calibrate(index: DataFrame, queries: DataFrame, tree: Tree, k: int,
              recall: float = RECALL, count: int = CALIBRATION) -> int:
    """Leaf visits that find ``recall`` of the true ``k`` neighbours of ``count`` queries."""
    few = queries.dropDuplicates(["id"]).orderBy(F.xxhash64("id")).limit(count).toPandas()
    if few.empty:
        return tree.leaves
    truth = best(exact_neighbours(index, few, k), k).toPandas()
    if truth.empty:
        return tree.leaves
    rank = {}
    for qid, v in zip(few["id"], unit(np.array(few["v"].tolist())), strict=True):
        rank[qid] = np.zeros(tree.leaves, np.int64)
        rank[qid][tree.visits(v, tree.leaves)] = np.arange(1, tree.leaves + 1)
    need = np.sort([rank[q][leaf] for q, leaf in zip(truth["query_id"], truth["leaf"], strict=True)])
    return int(need[min(len(need), math.ceil(recall * len(need))) - 1])


def neighbours(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
               vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row of ``df`` for which ``is_query`` (over a
    column ``id``) holds, against all rows; see the module's docstring."""
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col)
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == width.n)
    tree = fit_tree(rows)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["v"])
            leaf = tree.route(unit(x)) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(leaf)],
                                             names=["id", "v", "leaf"])

    index = C.staged(rows.mapInArrow(routed, "id long, v array<double>, leaf long"), "kmtree")
    queries = index.where(is_query).select("id", "v").distinct()
    visits = calibrate(index, queries, tree, k, recall)
    return search(index, queries, tree, visits, k)


def search(index: DataFrame, queries: DataFrame, tree: Tree, visits: int, k: int) -> DataFrame:
    """Best ``k`` over the ``visits`` nearest leaves of each query, or over more until they
    hold ``k`` rows besides those of the query's own id.

    A leaf's rows are dealt over blocks of about ``BLOCK`` rows by a hash, its queries over
    blocks of about ``QUERY_BLOCK``; each (leaf, row block, query block) is one group.
    """
    counts = index.groupBy("leaf").agg(F.count("*").alias("n")).toPandas()   # one row per leaf
    held = np.zeros(tree.leaves, np.int64)
    held[counts["leaf"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    copies = (index.join(queries.select("id").distinct(), "id", "left_semi").groupBy("id")
              .agg(F.count("*").alias("copies")))

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["v"])
            lists = [tree.visits(q, visits, held, k + own) for q, own in zip(
                unit(x), batch["copies"].to_pylist(), strict=True)] if len(x) else []
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["v"], pa.array(lists, pa.list_(pa.int64()))],
                names=["id", "v", "leaves"])

    spread = queries.join(copies, "id").repartition(C.tasks_of(index.sparkSession))
    plan = C.staged(spread.mapInArrow(visited, "id long, v array<double>, leaves array<bigint>"),
                    "visits")
    asked = plan.select("id", "v", F.explode("leaves").alias("leaf"))
    sizes = C.staged(index.groupBy("leaf").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(
        asked.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks")),
        "leaf"), "leaves")
    sizes = F.broadcast(sizes)   # one row per leaf of the bounded sample: at most SAMPLE rows
    rows = (index.join(sizes, "leaf")
            .select("id", "v", "leaf", F.pmod(F.xxhash64("id", "v"), "blocks").cast("int").alias("block"),
                    F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block")))
    ask = (asked.join(sizes, "leaf")
           .select("id", "v", "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                   F.pmod(F.xxhash64("id", "v"), "query_blocks").cast("int").alias("query_block")))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        qid, ids = left["id"].to_numpy(), right["id"].to_numpy()
        r, c, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(qid) and len(ids):
            r, c, s = nearest_rows(matrix(left["v"]), qid, matrix(right["v"]), ids, k)
        return pa.table({"query_id": pa.array(qid[r], pa.int64()), "vec_id": pa.array(ids[c], pa.int64()),
                         "score": pa.array(s, pa.float64())})

    keys = ["leaf", "block", "query_block"]
    found = ask.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(
        compare, "query_id long, vec_id long, score double")
    return best(found, k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the 5 nearest of every row whose vec_id is divisible by 50."""
    return neighbours(C.table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
