"""Exact top-k by inner product with ball trees.

Candidates are dealt into shards of bounded size; a shard's vectors become one ball tree (a row of packed arrays).
Queries are packed into blocks, and each block visits every shard by an equi-join on the shard number, so neither
side is ever whole in one task. A query descends a tree best first: a node's inner products are at most
q . centre + |q| * radius, and a node whose bound is below the current k-th score is skipped with all below it.
The k-th scores that the queries reach in their first shard are shared with all other shards, which start
from them instead of from nothing.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage

SCALE, LEAF, SHARD_ROWS, BLOCK_ROWS = 256, 64, 8192, 256


EXACT = float(1 << 53)  # integers below it, and their sums below it, are exact in floating point
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) as doubles, which are integers already from 2**53 on."""

    def one(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | F.abs(x.cast("double")).isin(float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def build_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of rows, node table (first, last, left child or -1), centres, radii); children are left and left + 1."""
    order = np.arange(len(x))
    nodes, centres, radii = [[0, len(x), -1]], [], []
    k = 0
    while k < len(nodes):
        a, b, _ = nodes[k]
        part = x[order[a:b]]
        centre = part.mean(0) if len(part) else np.zeros(x.shape[1])
        gap = np.sqrt(((part - centre) ** 2).sum(1)) if len(part) else np.zeros(1)
        centres.append(centre)
        radii.append(gap.max())
        if b - a > leaf and gap.max() > 0:
            far = part[np.argmax(gap)]
            other = part[np.argmax(((part - far) ** 2).sum(1))]
            side = part @ (other - far)
            order[a:b] = order[a:b][np.argsort(side, kind="stable")]
            nodes[k][2] = len(nodes)
            nodes += [[a, (a + b) // 2, -1], [(a + b) // 2, b, -1]]
        k += 1
    return order, np.array(nodes, np.int64), np.array(centres), np.array(radii)


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of large integers, in the range of a long."""
    y = [int(c) for c in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, y)), LOWEST), HIGHEST) for row in x], object)


def search(tree, ids: np.ndarray, x: np.ndarray, q: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
    """Up to k (score, id), best first, ties to the smaller id, among scores of at least ``floor``."""
    _, nodes, centres, radii = tree
    norm = float(np.sqrt(q @ q))
    reach = norm * (np.sqrt((centres**2).sum(1)) + radii)
    bound = centres @ q + norm * radii + 1e-9 * (1 + reach)  # bounds are in floating point, scores are exact integers
    exact = reach < EXACT / 2
    floor -= 1e-12 * abs(floor) if np.isfinite(floor) else 0
    heap, best = [(-bound[0], 0)], []  # best: min-heap of (score, -id)
    while heap:
        b, node = heapq.heappop(heap)
        least = max(floor, best[0][0] if len(best) >= k else -np.inf)
        if -b < least:
            break
        a, e, child = nodes[node]
        if child >= 0:
            for c in (child, child + 1):
                if bound[c] >= least:
                    heapq.heappush(heap, (-bound[c], int(c)))
            continue
        score = x[a:e] @ q if exact[node] else _exact(x[a:e], q)
        for i in np.flatnonzero(score >= least):
            if ids[a + i] == own:
                continue
            item = (int(score[i]), -int(ids[a + i]))
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
    return [(int(s), -i) for s, i in sorted(best, reverse=True)]


def _pack(rows: DataFrame, tree: bool) -> DataFrame:
    """One row for each (dim, key): ids, vectors and, for shards, the nodes of their tree, as bytes."""

    def run(key, table):
        dim = key[0].as_py()
        table = table.sort_by("vec_id")
        ids = table["vec_id"].to_numpy()
        x = np.array(table["v"].to_pylist(), np.float64).reshape(len(ids), dim)
        order, nodes, centres, radii = build_tree(x) if tree else (np.arange(len(x)), *[np.zeros(0)] * 3)
        blobs = [ids[order].astype("<i8"), x[order], nodes.astype("<i8"), centres, radii]
        return pa.table({"dim": [dim], "key": [key[1].as_py()]} | {f"b{i}": [np.ascontiguousarray(b).tobytes()] for i, b in enumerate(blobs)}, schema)

    schema = pa.schema([("dim", pa.int32()), ("key", pa.int64()), *((f"b{i}", pa.binary()) for i in range(5))])
    return rows.select("dim", "key", "vec_id", "v").groupBy("dim", "key").applyInArrow(run, "dim int, key long, b0 binary, b1 binary, b2 binary, b3 binary, b4 binary")


def _search_shards(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each query in each shard it meets, at or above its floor."""

    def run(batches):
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for r in batch.to_pylist():
                dim = r["dim"]
                ids, nodes, asking = (np.frombuffer(r[c], "<i8") for c in ("b0", "b2", "q0"))
                nodes = nodes.reshape(-1, 3)
                x, centres, queries = (np.frombuffer(r[c]).reshape(n, dim) for c, n in (("b1", len(ids)), ("b3", len(nodes)), ("q1", len(asking))))
                tree = (None, nodes, centres, np.frombuffer(r["b4"]))
                floors = dict(r["floors"] or {})
                for own, q in zip(asking.tolist(), queries):
                    out += [(own, i, s) for s, i in search(tree, ids, x, q, own, k, floors.get(own, -np.inf))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 3)], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query: a handful of rows from each shard, ranked by window."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each query row.

    ``is_query`` is a condition on ``vec_id``. Components are floor(scale * x); scores are exact integer inner
    products, and those beyond a long count as the nearest long. Candidates are all rows but those of the query's own
    id; fewer than k give fewer rows. Vectors that are null or hold null or non-finite components take no part, nor do
    those with a component whose product with ``scale`` is beyond a double (7e305 and more at 256) or rows without an id; rows that repeat an id and vector count once, and several vectors of an id are candidates (and
    queries, whose results count together) each. Vectors of different lengths are searched among their own length, the
    empty ones too, whose scores are 0.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = stage(rows.select("vec_id", scaled(F.col("v"), scale).alias("v")).where(~F.exists("v", lambda x: F.abs(x) == float("inf"))).distinct().withColumn("dim", F.size("v")), "vectors")
    # one row for each length of vector, however many lengths there are
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / shard_rows).alias("shards"), F.ceil(F.col("n") / (block_rows * 50)).alias("blocks"))
    placed = rows.join(sizes, "dim")
    trees = stage(_pack(placed.withColumn("key", F.pmod(F.xxhash64("vec_id", "v"), "shards")), True), "ball-trees")
    asking = placed.where(is_query).withColumn("key", F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks"))
    packed = stage(_pack(asking, False).select("dim", F.col("key").alias("block"), F.col("b0").alias("q0"), F.col("b1").alias("q1")).join(sizes, "dim"), "query-blocks")
    home = F.pmod("block", "shards")
    first = stage(_search_shards(packed.withColumn("key", home).withColumn("floors", F.lit(None).cast("map<long,double>")).join(trees, ["dim", "key"]), k), "first-hits")
    # the k-th score that an id's queries of one length reached; an id with several vectors starts from nothing
    alone = asking.groupBy("vec_id").agg(F.count("*").alias("c"), F.first("dim").alias("dim"), F.first("key").alias("block")).where("c = 1").drop("c").withColumnRenamed("vec_id", "query_id")
    kth = first.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").cast("double").alias("kth")).where(F.col("c") >= k)
    by_block = kth.join(alone, "query_id").groupBy("dim", "block").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "kth"))).alias("floors"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1), lambda s: s != home)
    rest = packed.join(by_block, ["dim", "block"], "left").withColumn("key", F.explode(others))
    found = first.unionByName(_search_shards(rest.join(trees, ["dim", "key"]), k))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
