"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into m partitions, correlated bits together. If two fingerprints differ in at most tau
bits, then for thresholds t_1..t_m that sum to tau - m + 1 some partition i differs in at most t_i bits. The
thresholds need not be equal: a dynamic program gives each partition the threshold that minimises the estimated
cost of probes and candidates, from counts of the partition's values over all fingerprints; the number of
partitions is chosen the same way, so a larger corpus gets fewer, wider partitions and its candidates do not grow
with the square of its size.

Each distinct fingerprint goes to the bucket of its own value in every partition and, where a threshold is above
zero, to the buckets within that distance. Buckets are verified where they meet, and give a spanning forest of
their true links instead of all pairs; components follow by star contraction.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, texts
from .components import connected_components

BITS, SHINGLE, DISTANCE, SEED = 64, 4, 4, 42
PARTITIONS = (3, 4, 5)
ROW_COST, PAIR_COST = 200.0, 1.0  # a row sent to a bucket against a pair compared there
ONE = np.uint64(1)


def fingerprint(text: str, n: int = SHINGLE) -> int:
    """Unsigned fingerprint of the n-word shingles of a text; 0 if it has no word."""
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(n)))) if len(w) >= n else [b" ".join(w)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, max(1, len(w) - n + 1))
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = bits.sum(0, dtype=np.int64) * 2 > len(h)
    return int(np.packbits(most, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), n) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


@dataclass
class Scheme:
    masks: list[int]  # the bits of each partition
    thresholds: list[int]  # differing bits allowed in it; -1: not probed


def _bit_counts(prints: DataFrame) -> tuple[np.ndarray, int]:
    """How often bits i and j are both set, over all fingerprints."""

    def run(batches):
        total = np.zeros((BITS + 1, BITS), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            x = ((fp[:, None] >> np.arange(BITS, dtype=np.uint64)) & ONE).astype(np.float64)
            total[:BITS] += (x.T @ x).astype(np.int64)
            total[BITS] += len(fp)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "n"])

    total = np.zeros((BITS + 1) * BITS, np.int64)
    for cell, n in prints.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        total[cell] = n
    total = total.reshape(BITS + 1, BITS)
    return total[:BITS], int(total[BITS, 0])


def group_bits(both: np.ndarray, n: int, m: int) -> list[int]:
    """Masks of m partitions of about equal width; each grows by the bit most correlated with its bits."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, masks = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        seed = max(left, key=lambda i: (corr[i, list(left)].sum(), -i))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(left, key=lambda i: (corr[i, group].sum(), -i))
            group.append(best)
            left.remove(best)
        masks.append(sum(1 << i for i in group))
    return masks


def _bits(mask: int) -> list[int]:
    return [i for i in range(BITS) if mask >> i & 1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def allocate(masks: list[int], equal_pairs: list[float], p: np.ndarray, n: int, tau: int) -> tuple[list[int], float]:
    """Thresholds that sum to tau - m + 1 with the least estimated cost, by dynamic programming."""
    cost = np.full((len(masks), tau + 2), np.inf)  # by threshold + 1
    for k, mask in enumerate(masks):
        bits = _bits(mask)
        same = p[bits] ** 2 + (1 - p[bits]) ** 2
        odds = (1 - same) / np.maximum(same, 1e-9)
        grown = np.array([1.0])  # elementary symmetric sums of the odds: pairs at distance d against pairs at 0
        for o in odds:
            grown = np.convolve(grown, [1, o])[: tau + 1]
        cost[k, 0] = 0
        for t in range(min(tau, len(bits)) + 1):
            probes = sum(comb(len(bits), d) for d in range(t + 1))
            cost[k, t + 1] = n * (probes + (t > 0)) * ROW_COST + max(equal_pairs[k], 1) * grown[: t + 1].sum() * PAIR_COST
    best = {0: (0.0, [])}
    for k in range(len(masks)):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for u in range(tau + 2 - used):
                value = c + cost[k, u]
                if np.isfinite(value) and (used + u not in step or value < step[used + u][0]):
                    step[used + u] = (value, [*chosen, u - 1])
        best = step
    total, thresholds = best[tau + 1]
    return thresholds, total


def choose_scheme(prints: DataFrame, tau: int = DISTANCE, partitions: tuple[int, ...] = PARTITIONS) -> Scheme:
    """The partitioning and thresholds of least estimated cost over all distinct fingerprints."""
    both, n = _bit_counts(prints)
    p = np.diag(both) / max(n, 1)
    options = [group_bits(both, n, m) for m in partitions]
    values = [F.struct(F.lit(j).alias("o"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("value")) for j, masks in enumerate(options) for k, mask in enumerate(masks)]
    counts = prints.select(F.inline(F.array(*values))).groupBy("o", "k", "value").agg(F.count("*").alias("c"))
    pairs = {(r["o"], r["k"]): r["pairs"] for r in counts.groupBy("o", "k").agg(F.sum(F.expr("cast(c as double) * (c - 1) / 2")).alias("pairs")).collect()}
    found = []
    for j, masks in enumerate(options):
        thresholds, total = allocate(masks, [pairs.get((j, k), 0.0) for k in range(len(masks))], p, n, tau)
        found.append((total, j, Scheme(masks, thresholds)))
    return min(found, key=lambda x: x[:2])[2]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def bucket_links(key: np.ndarray, own: np.ndarray, fp: np.ndarray, tau: int, large: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within tau bits that connect what is connected in each bucket (rows sorted by bucket, own rows
    first). Small buckets compare all rows at once by offset; in a large one every row reached is compared with
    those not reached yet, so a dense group costs about its size."""
    n = len(key)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(edge, n))
    end = np.repeat(edge + size, size)
    left, right = [], []
    row = np.flatnonzero(own & (np.repeat(size, size) <= large))
    d = 1
    while len(row):
        row = row[row + d < end[row]]
        hit = row[_distance(fp[row], fp[row + d]) <= tau]
        left.append(hit)
        right.append(hit + d)
        d += 1
    for a, s in zip(edge[size > large], size[size > large]):
        todo = np.arange(a, a + s)
        while len(todo):
            queue, todo = [todo[0]], todo[1:]
            while queue and len(todo):
                x = queue.pop()
                near = _distance(fp[todo], fp[x]) <= tau
                reached = todo[near]
                left.append(np.full(len(reached), x))
                right.append(reached)
                queue += reached.tolist()
                todo = todo[~near]
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


def _buckets(k: int, mask: int, t: int) -> list[Column]:
    """Arrays of (part, value, own): the fingerprint's own bucket in partition k, and those within t bits of it."""
    value = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
    flips = [_signed(sum(1 << i for i in c)) for d in range(1, t + 1) for c in combinations(_bits(mask), d)]
    near = F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: F.struct(F.lit(k).alias("part"), value.bitwiseXOR(x).alias("value"), F.lit(False).alias("own")))
    return [F.array(F.struct(F.lit(k).alias("part"), value.alias("value"), F.lit(True).alias("own"))), *([near] if flips else [])]


def fingerprint_links(prints: DataFrame, scheme: Scheme, tau: int = DISTANCE) -> DataFrame:
    """(u, v): links between representatives, from (rep, fp) with distinct fp; connects all that is within tau."""
    buckets = [b for k, (mask, t) in enumerate(zip(scheme.masks, scheme.thresholds)) if t >= 0 for b in _buckets(k, mask, t)]

    def run(batches):
        held = None
        for batch in batches:
            frame = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            frame = frame if held is None else [np.concatenate(x) for x in zip(held, frame)]
            part, value = frame[0], frame[1]
            last = np.flatnonzero((part != part[-1]) | (value != value[-1])) if len(part) else np.zeros(0, int)
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            yield from links([x[:cut] for x in frame])
            held = [x[cut:] for x in frame]
        if held is not None:
            yield from links(held)

    def links(frame):
        part, value, own, rep, fp = frame
        key = np.cumsum(np.concatenate(([0], (part[1:] != part[:-1]) | (value[1:] != value[:-1])))) if len(part) else part
        a, b = bucket_links(key, own.astype(bool), fp.view(np.uint64), tau)
        yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["u", "v"])

    rows = prints.select("rep", "fp", F.inline(F.concat(*buckets))).select("part", "value", "own", "rep", "fp")
    rows = rows.repartition("part", "value").sortWithinPartitions("part", "value", F.desc("own"), "rep")
    return rows.mapInArrow(run, "u long, v long")


def simhash_groups(docs: DataFrame, n: int = SHINGLE, tau: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Texts without words, null ones included, have fingerprint zero and link like any other. Rows that repeat an
    id with one text are one document. An empty table gives no rows.
    """
    prints = stage(fingerprints(docs, n, id_col, text_col).distinct(), "fingerprints")
    reps = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-reps")
    # an id that carries several texts joins their fingerprints
    joined = prints.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    same = prints.join(joined.select("doc_id"), "doc_id").join(reps, "fp").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    links = fingerprint_links(reps, choose_scheme(reps, tau), tau).unionByName(same)
    parts = connected_components(links)
    members = prints.join(reps, "fp").join(parts, F.col("rep") == F.col("id"), "left")
    return members.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component", "rep").alias("component_id"))
