"""Quality classifier: hashed word and character n-gram vectors, averaged per document, with a softmax on top.

Trained by stochastic gradient descent in numpy on a bounded labelled sample. Because the average and the output
layer are linear, a trained model folds into one number for each hash bucket (its vector times the difference of
the two output rows): a document's log-odds are the mean of those numbers over all its features. Scoring is
one pass over whole texts without any shuffle, and the model is bounded by its bucket count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .labels import fold, sample
from .subwords import SPACED, grams, mixed, slices, word_hashes, words

BUCKET_BITS, DIMENSIONS, GRAMS = 18, 8, (3, 4)
EXAMPLES_PER_CLASS, EPOCHS, RATE = 2000, 6, 0.5


def features(sl) -> list[tuple[np.ndarray, np.ndarray]]:
    """(position, bucket) of the words and n-grams of a slice."""
    shift = np.uint64(64 - BUCKET_BITS)
    starts, ends = words(sl.buf)
    hashes = word_hashes(sl.buf, starts, ends)
    # all two-word grams of a word and itself, inside one text, share a bucket
    text = np.searchsorted(sl.starts, starts, side="right")
    again = starts[1:][(hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])]
    out = [(starts, mixed(hashes) >> shift), (again, np.full(len(again), mixed(np.uint64([2]), 1)[0] >> shift))]
    for n in GRAMS:
        keys, usable = grams(sl.buf, n)
        at = np.flatnonzero(usable)
        out.append((at, mixed(keys[at], n) >> shift))
    return out


@dataclass
class Model:
    table: np.ndarray  # log-odds of each bucket
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for sl in slices(column, SPACED):
            total, count = np.zeros(len(sl.starts)), np.zeros(len(sl.starts))
            for at, bucket in features(sl):
                # features come in the order of their position: each text has one stretch of them
                edges = np.searchsorted(at, np.append(sl.starts - 1, len(sl.buf)))
                run = np.concatenate(([0.0], np.cumsum(self.table[bucket], dtype=np.float64)))
                total += run[edges[1:]] - run[edges[:-1]]
                count += np.diff(edges)
            out[sl.lo : sl.hi] += total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(column: pa.Array, y: np.ndarray, sizes: dict[int, int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Gradient descent, one document a step; the bias is then moved from the sample's class shares to the table's."""
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    for sl in slices(column, SPACED):
        at, bucket = (np.concatenate(x) for x in zip(*features(sl)))
        order = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.append(sl.starts - 1, len(sl.buf)))
        for a, b in zip(edges[:-1], edges[1:]):
            ids, n = np.unique(bucket[order[a:b]], return_counts=True)
            bags.append((ids.astype(np.int64), (n / max(b - a, 1)).astype(np.float32)))
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    heads, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in random.permutation(len(bags)):
            ids, share = bags[i]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[ids]
            logits = heads @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            back = p @ heads
            heads -= lr * np.outer(p, hidden)
            bias -= lr * p
            vectors[ids] -= (lr * len(ids) ** 0.5) * share[:, None] * back
    seen = {c: max(int((y == c).sum()), 1) for c in (0, 1)}
    prior = np.log((sizes[1] + 1) / (sizes[0] + 1)) - np.log(seen[1] / seen[0]) if len(y) else 0.0
    return Model(vectors @ (heads[1] - heads[0]), float(bias[1] - bias[0] + prior))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, per_class: int = EXAMPLES_PER_CLASS, label: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from labelled rows whose crc32(id) modulo ``folds`` is not ``held_out``, at most ``per_class`` of each
    class, whole texts. Empty and null texts have no features: their score comes from the bias alone. Without
    labels every score is 0.5.
    """
    rows = texts(docs)
    table, sizes = sample(rows, labels, label, fold("doc_id", folds) != held_out, per_class)
    model = train(table["text"].combine_chunks(), table["label"].to_numpy(), sizes)

    def score(batches):
        for batch in batches:
            s = model.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = rows.mapInArrow(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", "predicted")
