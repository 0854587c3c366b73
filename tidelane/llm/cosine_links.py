"""Embedding near-duplicates: products of int8 tiles with error bounds, full precision where the bound leaves it open.

Equal vectors are one class and enter once, with the number of ids that have them. Classes are dealt into tiles of
bounded bytes, near ones together (by the nearest of a few pivots; that is only layout). Two tiles meet unless their
centres are further apart than both radii and the threshold's angle together. Where they meet, each vector is its
unit vector u = s * q + e, q of bytes, |e| known. Then

    |u . v  -  s_u * s_v * (q_u . q_v)|  <=  |e_u| + (1 + |e_u|) * |e_v|

and q_u . s_v q_v comes out of one product of the two tiles, in single precision, whose own error is bounded too. Pairs
above or below the threshold by more than the bound are settled by it, those between are computed again in double
precision. Tiles are written once, in partitions of bounded bytes; a task reads two partitions and compares their
tiles, so what is written and shuffled grows with the vectors and never with the pairs of tiles. A task returns how
many links each vector has there and a spanning forest of them, never the pairs; components are joined from the forests.
"""

from __future__ import annotations

from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ball_tree import usable
from .common import prepare, stage
from .components import connected_components

TILE_BYTES, MOST_PIVOTS = 1 << 20, 256
META_TILES, PARTNERS = 48, 64  # tiles of a partition; pairs of tiles whose forests are joined at once
_ROW_BITS = 24  # of a vector's place in its tile
_SLACK = 1e-9  # more than double precision loses in a cosine
_STRIP = 128  # rows of a tile that are multiplied at once
_EXACT_DIMS = 1024  # 127 * 127 * this many is below 2**24, exact in single precision


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows scaled by powers of two so that squares neither overflow nor vanish, their lengths)."""
    _, e = np.frexp(np.abs(x).max(1))
    y = np.ldexp(x, -e[:, None])
    return y, np.sqrt((y * y).sum(1))


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, lengths of what the codes leave out) of the unit vectors."""
    y, n = unit(x)
    u = y / n[:, None]
    scale = np.abs(u).max(1) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((u - scale[:, None] * codes) ** 2).sum(1)) * (1 + 1e-9) + 1e-12


class Tile:
    """Vectors, their int8 codes as singles (for the matrix product), also times their scale, scales and error lengths."""

    def __init__(self, number: int, dim: int, vectors: bytes, counts: bytes, kind: str = "<f8", codes: bytes | None = None, scales: bytes | None = None):
        self.number = number
        self.x = np.frombuffer(vectors, kind).reshape(-1, dim)
        self.counts = np.frombuffer(counts, "<i8")
        if codes is None:
            q, self.scale, self.error = coded(self.x.astype(np.float64))
        else:
            q, (self.scale, self.error) = np.frombuffer(codes, np.int8).reshape(-1, dim), np.frombuffer(scales, "<f8").reshape(2, -1)
        self.codes = q.astype(np.float32)
        self.scaled = self.codes * self.scale[:, None].astype(np.float32)

    @cached_property
    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """As ``unit``; only where the bound leaves a pair open."""
        return unit(self.x.astype(np.float64))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] <= _EXACT_DIMS:
        return a @ b.T
    parts = range(0, a.shape[1], _EXACT_DIMS)
    return sum((a[:, i : i + _EXACT_DIMS] @ b[:, i : i + _EXACT_DIMS].T).astype(np.float64) for i in parts)


def linked(a: Tile, b: Tile, threshold: float):
    """Yields (rows of a, rows of b) of all pairs with a cosine of at least the threshold; within a tile each once."""
    most = b.error.max()
    # singles lose (d + 3) / 2**24 of the lengths of the two at most, in sums of d
    lost = _SLACK + (min(a.codes.shape[1], _EXACT_DIMS) + 8) * 2.0**-23 * (1 + a.error.max()) * (1 + most)
    for at in range(0, len(a.scale), _STRIP):
        s, e = a.scale[at : at + _STRIP], a.error[at : at + _STRIP]
        first = at if a.number == b.number else 0
        products = _product(a.codes[at : at + _STRIP], b.scaled[first:])
        # a coarse cut first, by the tile's largest error and with room for its own rounding; the pair's own bound after
        least = ((threshold - e - (1 + e) * most - 2 * lost) / s).astype(np.float32)
        found = np.flatnonzero(products >= least[:, None])
        i, j = np.divmod(found, products.shape[1])
        about, j = s[i] * products.ravel()[found], j + first
        if a.number == b.number:
            once = i + at < j
            i, j, about = i[once], j[once], about[once]
        bound = e[i] + (1 + e[i]) * b.error[j] + lost
        keep = about - bound >= threshold
        open_ = np.flatnonzero(~keep & (about + bound >= threshold))
        for k in range(0, len(open_), 1 << 14):
            o = open_[k : k + (1 << 14)]
            p, q = i[o] + at, j[o]
            (x, m), (y, n) = a.whole, b.whole
            keep[o] = np.einsum("ij,ij->i", x[p], y[q]) / (m[p] * n[q]) >= threshold
        yield i[keep] + at, j[keep]


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least number of its set) after joining the sets of a[i] and b[i]."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def _kind(rows: DataFrame) -> str:
    """Singles stay singles, all else is doubles."""
    return "<f4" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, components in a row) of a column of lists, each in its own precision."""
    return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)


def _codes(x: np.ndarray) -> np.ndarray:
    """Whole numbers up to 127 as singles, of each row by itself: nothing here depends on the rows beside it."""
    y = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return np.rint(y * (127 / np.abs(y).max(1))[:, None]).astype(np.float32)


def _pivots(own: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """Codes of some vectors by their length."""
    sample = own.select("v").orderBy("h1", "h2").limit(4 * pivots).distinct().limit(pivots).collect()
    return {dim: _codes(np.array([r["v"] for r in sample if len(r["v"]) == dim], np.float64)) for dim in {len(r["v"]) for r in sample}}


def _celled(own: DataFrame, by_dim: dict[int, np.ndarray], whole: bool) -> DataFrame:
    """(vec_id, h1, h2, dim, cell) of ``own`` (vec_id, v, h1, h2), or with ``whole`` (v, h1, h2, dim, cell), where equal
    vectors of a batch are one row. The cell is that of the nearest pivot, the same for equal vectors wherever they are."""
    columns = (["v"] if whole else ["vec_id"]) + ["h1", "h2"]

    def near(batches):
        for batch in batches:
            sizes, flat = _flat(batch.column("v"))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            cell, keep = np.zeros(len(sizes), np.int32), []
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                if whole:
                    rows = rows[np.lexsort((h2[rows], h1[rows]))]
                x = flat[starts[rows][:, None] + np.arange(dim)].astype(np.float64)
                if int(dim) in by_dim:
                    p = by_dim[int(dim)]
                    cell[rows] = (_product(_codes(x), p) * (1 / np.sqrt((p.astype(np.float64) ** 2).sum(1)))).argmax(1)
                if whole:
                    keep.append(rows[np.concatenate([[True], (x[1:] != x[:-1]).any(1)])])
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sizes, pa.int32()), pa.array(cell)], names=[*columns, "dim", "cell"])
            yield out.take(pa.array(np.concatenate(keep))) if keep else out

    kind = own.schema["v"].dataType.simpleString()
    return own.select("vec_id", "v", "h1", "h2").mapInArrow(near, f"{f'v {kind}' if whole else 'vec_id long'}, h1 long, h2 long, dim int, cell int")


def _cells(classes: DataFrame, tile_bytes: int) -> DataFrame:
    """(dim, cell, slots, before): the tiles of a cell are so many, from this number on."""
    most = F.greatest(F.lit(16), F.floor(F.lit(tile_bytes) / (8 * F.col("dim"))))
    sizes = classes.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.first(most)).alias("slots"))
    # as many rows as there are pivots and lengths of vectors
    before = F.sum("slots").over(Window.orderBy("dim", "cell").rowsBetween(Window.unboundedPreceding, -1))
    return stage(sizes.withColumn("before", F.coalesce(before, F.lit(0))), "cells")


def _tiles(rows: DataFrame, classes: DataFrame, cells: DataFrame) -> DataFrame:
    """(tile, dim, angle, centre, vectors, codes, scales, counts, keys) of rows (v, h1, h2, dim, cell) and their classes
    (tile, h1, h2, min_id, count). A tile without keys holds different vectors of one hash."""
    kind = _kind(rows)
    number = F.col("before") + F.pmod("h2", "slots")
    dealt = rows.join(cells, ["dim", "cell"]).select(number.alias("tile"), "dim", "v", "h1", "h2")
    n = cells.agg(F.sum("slots")).first()[0] or 1
    parts = max(-(-n // META_TILES), min(n, rows.sparkSession.sparkContext.defaultParallelism))

    def pack(key, table, known):
        order = [("h1", "ascending"), ("h2", "ascending")]
        table, known = table.sort_by(order).combine_chunks(), known.sort_by(order)
        h = np.stack([table[c].to_numpy() for c in ("h1", "h2")], 1)
        dim = table["dim"][0].as_py()
        x = _flat(table["v"].combine_chunks())[1].reshape(-1, dim)
        as_before, equal = (h[1:] == h[:-1]).all(1), (x[1:] == x[:-1]).all(1)
        new = np.concatenate([[True], ~as_before])
        keys = np.stack([known[c].to_numpy() for c in ("min_id", "h1", "h2")], 1)
        clash = bool((as_before & ~equal).any())
        x, h = x[new].astype(np.float64), h[new]
        if not clash and not np.array_equal(h, keys[:, 1:]):
            raise ValueError("the vectors are not the same when they are read again")
        codes, scale, error = coded(x)
        y, n = unit(x)
        u = y / n[:, None]
        centre = u.mean(0)
        centre = centre / np.sqrt(centre @ centre) if centre @ centre > 1e-12 else u[0]
        angle = float(np.arccos(np.clip(u @ centre, -1, 1)).max())
        blobs = [x.astype(kind), codes, np.stack([scale, error]).astype("<f8"), known["count"].to_numpy().astype("<i8"), keys.astype("<i8")[: 0 if clash else None]]
        columns = [pa.array([key[0].as_py()], pa.int64()), pa.array([dim], pa.int32()), pa.array([angle]), pa.array([centre.tolist()], pa.list_(pa.float64())), *(pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for b in blobs)]
        return pa.table(columns, names=["tile", "dim", "angle", "centre", "vectors", "codes", "scales", "counts", "keys"])

    both = dealt.repartition(parts, "tile").groupBy("tile").cogroup(classes.select("tile", "h1", "h2", "min_id", "count").repartition(parts, "tile").groupBy("tile"))
    return stage(both.applyInArrow(pack, "tile long, dim int, angle double, centre array<double>, vectors binary, codes binary, scales binary, counts binary, keys binary"), "tiles")


def _compare(tiles: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(node, n, least): links of a vector in two partitions of tiles, and the least vector that it reaches there."""
    columns = ["tile", "dim", "vectors", "codes", "scales", "counts"]

    def run(batches):
        found: dict[int, tuple[int, np.ndarray]] = {}  # of each tile, where its vectors are among those of the task, and their links
        labels, pending, a = np.zeros(0, np.int64), [], None

        def read(row: dict) -> Tile:
            t = Tile(row["tile"].as_py(), row["dim"].as_py(), row["vectors"].as_buffer(), row["counts"].as_buffer(), kind, row["codes"].as_buffer(), row["scales"].as_buffer())
            if t.number not in found:
                nonlocal labels
                found[t.number] = len(labels), np.zeros(len(t.scale))
                labels = np.concatenate([labels, len(labels) + np.arange(len(t.scale))])
            return t

        for batch in batches:
            for r in range(batch.num_rows):
                one, two = ({c: batch.column(f"{side}_{c}")[r] for c in columns} for side in "ab")
                a = a if a and a.number == one["tile"].as_py() else read(one)
                b = a if a.number == two["tile"].as_py() else read(two)
                (at, degree), (to, other) = found[a.number], found[b.number]
                place = np.concatenate([at + np.arange(len(degree)), to + np.arange(len(other))])
                near, last = np.arange(len(place)), 0 if a is b else len(degree)
                for p, q in linked(a, b, threshold):
                    if len(p):
                        degree += np.bincount(p, b.counts[q], len(degree))
                        other += np.bincount(q, a.counts[p], len(other))
                        near = join_labels(near, p, q + last)
                moved = np.flatnonzero(near != np.arange(len(near)))
                if len(moved):
                    pending.append((place[moved], place[near[moved]]))
                if len(pending) >= PARTNERS:
                    labels, pending = join_labels(labels, *(np.concatenate(x) for x in zip(*pending))), []
        if pending:
            labels = join_labels(labels, *(np.concatenate(x) for x in zip(*pending)))
        node = np.concatenate([np.zeros(0, np.int64), *((np.int64(t) << _ROW_BITS) + np.arange(len(n)) for t, (_, n) in found.items())])
        degree = np.concatenate([np.zeros(0), *(n for _, n in found.values())])
        some = np.flatnonzero(degree)
        for k in range(0, len(some), 1 << 16):
            o = some[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(node[o]), pa.array(degree[o].astype(np.int64)), pa.array(node[labels[o]])], names=["node", "n", "least"])

    left, right = (tiles.select(*(F.col(c).alias(f"{side}_{c}") for c in [*columns, "angle", "centre"])) for side in "ab")
    # either tile may be the first of a pair, so that both halves of two partitions' work are even
    once = (F.col("a_tile") == F.col("b_tile")) | ((F.col("a_tile") < F.col("b_tile")) == ((F.col("a_tile") + F.col("b_tile")) % 2 == 0))
    cosine = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))) - F.col("a_angle") - F.col("b_angle")
    met = left.join(right.hint("shuffle_replicate_nl"), once & (F.col("a_dim") - F.col("b_dim") == 0) & (apart <= float(np.arccos(threshold)) + 1e-6))
    return met.select(*(f"{side}_{c}" for side in "ab" for c in columns)).mapInArrow(run, "node long, n long, least long")


def _hashes(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed + k), "v").alias(f"h{k + 1}") for k in range(2)]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tile_bytes: int = TILE_BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept: how many other vectors have a cosine of at least ``threshold`` with this
    one, the smallest id reachable over such links (its own included), and whether that is its own.

    ``threshold`` is above 0 and below 1. Cosines are those of double precision. Vectors that are null, empty or zero or
    hold null or non-finite components link with nothing, and vectors link only with those of their own length. A row
    without an id takes no part; rows that repeat an id and vector are one; several vectors of an id have a row each and
    link like those of different ids. Equal vectors link. Different vectors with equal smallest ids are told apart by
    128 bits of hash. At most MOST_PIVOTS vectors reach the driver; they decide which tiles vectors lie in, no result.
    """
    if not 0 < threshold < 1:
        raise ValueError(f"the threshold must lie between 0 and 1, not {threshold}")
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id is not null")
    fit = F.coalesce(usable(F.col("v")) & F.exists("v", lambda x: x != 0), F.lit(False))
    size = rows.where(fit).agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    pivots = max(1, min(MOST_PIVOTS, size * 8 // tile_bytes))
    key = ["h1", "h2", "dim", "cell"]
    for seed in count():  # until no two vectors of a cell have one hash
        own = rows.where(fit).select("vec_id", "v", *_hashes(seed))
        by_dim = _pivots(own, pivots)
        members = stage(_celled(own, by_dim, False).distinct(), "members")
        classes = stage(members.groupBy(*key).agg(F.min("vec_id").alias("min_id"), F.count("*").alias("count")), "classes")
        cells = _cells(classes, tile_bytes)
        classes = classes.join(cells, ["dim", "cell"]).withColumn("tile", F.col("before") + F.pmod("h2", "slots")).drop("slots", "before")
        tiles = _tiles(_celled(own, by_dim, True), classes, cells)
        if tiles.where(F.length("keys") == 0).isEmpty():
            break
    hits = stage(_compare(tiles, _kind(rows), threshold), "hits")

    def nodes(batches):
        for batch in batches:
            for tile, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = np.frombuffer(keys, "<i8").reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(tile) << _ROW_BITS) + np.arange(len(k)), pa.int64()), pa.array(np.full(len(k), tile, np.int64)), *(pa.array(k[:, i]) for i in range(3))], names=["node", "tile", "min_id", "h1", "h2"])

    named = tiles.select("tile", "keys").mapInArrow(nodes, "node long, tile long, min_id long, h1 long, h2 long")
    joined = connected_components(hits.select(F.col("node").alias("u"), F.col("least").alias("v"))).withColumnRenamed("id", "node")
    degrees = hits.groupBy("node").agg(F.sum("n").alias("n"))
    found = stage(joined.join(named, "node").join(degrees, "node"), "linked")
    least = found.groupBy("component").agg(F.min("min_id").alias("least"))
    by_class = found.join(least, "component").select("tile", "h1", "h2", "n", "least")
    told = classes.join(by_class, ["tile", "h1", "h2"], "left").select(*key, (F.col("count") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("least", "min_id").alias("component_id"))
    out = members.join(told, key).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fit).distinct().select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
