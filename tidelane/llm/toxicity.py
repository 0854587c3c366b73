"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all 5-byte grams of folded words, edges of words included, that the labelled sample ties to one class
(a z-test and a ratio of shares; there is no limit on their number). Their document frequencies are counted over
all documents. Labelled examples that hold any term form the index: for each term, postings in blocks of examples
with the largest weight in each block. A document visits blocks in the order of their upper bound and stops when no
block can reach its k-th best cosine, so the neighbours are exact. Votes are weighted by squared cosine and
calibrated on the sample itself, each example scored without its own vote.

The index is bounded by what the labelled sample may hold (examples and bytes a class), so it goes to every task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from .common import texts, told_apart
from .labels import fold, sample
from .subwords import FOLDED, grams, mixed, slices

GRAM = 5
EXAMPLES_PER_CLASS, NEIGHBOURS, BLOCK = 3000, 15, 64
TOGETHER = 4  # blocks visited at once
MIN_Z, MIN_RATIO, MIN_EXAMPLES = 6.0, 3.0, 3
PRIOR_MASS = 3.0  # close neighbours that the prior counts as


def _doc_of(sl, at: np.ndarray) -> np.ndarray:
    """Which text of the slice each position (of a gram, which may begin with the space before it) is in."""
    return np.searchsorted(sl.starts, at + 1, side="right") - 1


def term_counts(column: pa.Array, terms: np.ndarray):
    """For each slice of the column: (rows lo, doc, term number, count) over the sorted ``terms``."""
    seen = np.zeros(1 << 16, bool)
    seen[mixed(terms) >> np.uint64(48)] = True
    for sl in slices(column, FOLDED):
        keys, usable = grams(sl.buf, GRAM)
        at = np.flatnonzero(usable)
        at = at[seen[mixed(keys[at]) >> np.uint64(48)]]
        place = np.minimum(np.searchsorted(terms, keys[at]), max(len(terms) - 1, 0))
        hit = terms[place] == keys[at] if len(terms) else np.zeros(len(at), bool)
        pairs, n = np.unique(_doc_of(sl, at[hit]) * np.int64(len(terms)) + place[hit], return_counts=True)
        yield sl.lo, pairs // max(len(terms), 1), pairs % max(len(terms), 1), n


def choose_terms(column: pa.Array, y: np.ndarray) -> np.ndarray:
    """All grams whose share of examples differs between the classes, sorted."""
    terms, a, b = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)  # examples of either class that hold each gram
    for sl in slices(column, FOLDED):
        keys, usable = grams(sl.buf, GRAM)
        at = np.flatnonzero(usable)
        doc = _doc_of(sl, at)
        order = np.lexsort((keys[at], doc))
        k, d = keys[at][order], doc[order]
        first = np.ones(len(k), bool)
        first[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        toxic = y[sl.lo + d[first]] == 1
        terms, where = np.unique(np.concatenate((terms, k[first])), return_inverse=True)
        a = np.bincount(where, np.concatenate((a, toxic)), len(terms))
        b = np.bincount(where, np.concatenate((b, ~toxic)), len(terms))
    n1, n0 = max(int((y == 1).sum()), 1), max(int((y == 0).sum()), 1)
    p1, p0, p = a / n1, b / n0, (a + b) / (n1 + n0)
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    ratio = np.maximum((p1 + 0.5 / n1) / (p0 + 0.5 / n0), (p0 + 0.5 / n0) / (p1 + 0.5 / n1))
    return terms[(z >= MIN_Z) & (ratio >= MIN_RATIO) & (np.maximum(a, b) >= MIN_EXAMPLES)]


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges, one after the other."""
    n = end - start
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


@dataclass
class Index:
    """Examples in blocks, their weights by term, and the calibration of votes."""

    terms: np.ndarray
    idf: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    y: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))  # rows of the table that an example stands for
    # a cell is a term in a block that has it: cells by term (from cell_of[t] to cell_of[t + 1]), postings by cell
    cell_of: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of a cell
    cell_max: np.ndarray = field(default_factory=lambda: np.zeros(0))
    posting_of: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of a cell, and the end
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of a posting
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.5
    empty: float = 0.5  # score of a text without any term
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, term: np.ndarray, n: np.ndarray) -> np.ndarray:
        q = (1 + np.log(n)) * self.idf[term]
        return q / max(np.sqrt(q @ q), 1e-12)

    def post(self, term: np.ndarray, example: np.ndarray, value: np.ndarray) -> None:
        """Builds the postings from (term, example, weight)."""
        order = np.lexsort((example, term))
        term, self.example, self.value = term[order], example[order], value[order]
        block = self.example // BLOCK
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.zeros(0, np.int64)
        self.block, self.posting_of = block[first], np.append(first, len(term))
        self.cell_max = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0)
        self.cell_of = np.searchsorted(term[first], np.arange(len(self.terms) + 1))

    def nearest(self, term: np.ndarray, q: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example rows, cosines) of the k nearest, ties to the smaller id; exact."""
        start, end = self.cell_of[term], self.cell_of[term + 1]
        cell, weight = _ranges(start, end), np.repeat(q, end - start)
        block = self.block[cell]
        bound = np.bincount(block, weight * self.cell_max[cell])
        order = np.argsort(-bound, kind="stable")
        best = np.zeros(0, np.int64)
        score = np.zeros(0)
        for at in range(0, len(order), TOGETHER):
            if bound[order[at]] <= 0 or (len(best) >= k and bound[order[at]] < score[-1] - 1e-9):
                break
            now = np.zeros(len(bound), bool)
            now[order[at : at + TOGETHER]] = True
            use = now[block]
            a, b = self.posting_of[cell[use]], self.posting_of[cell[use] + 1]
            posting = _ranges(a, b)
            s = np.bincount(self.example[posting], self.value[posting] * np.repeat(weight[use], b - a))
            rows = np.flatnonzero(s)
            rows = rows[rows != without]
            best, score = np.concatenate((best, rows)), np.concatenate((score, s[rows]))
            top = np.lexsort((self.ids[best], -score))[:k]
            best, score = best[top], score[top]
        return best, score

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """Toxic share of the neighbours, weighted by squared cosine; far neighbours leave the prior in place."""
        w = cosines**2 * self.weight[rows]
        return float((w @ self.y[rows] + PRIOR_MASS * self.prior) / (w.sum() + PRIOR_MASS))

    def calibrated(self, raw: float) -> float:
        raw = min(max(raw, 1e-4), 1 - 1e-4)
        return float(1 / (1 + np.exp(-(self.slope * np.log(raw / (1 - raw)) + self.shift))))


def _platt(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit on the log-odds of the votes, with a mild pull to (1, 0)."""
    raw = np.clip(raw, 1e-4, 1 - 1e-4)
    x = np.stack((np.log(raw / (1 - raw)), np.ones(len(raw))), 1)
    theta, pull = np.array([1.0, 0.0]), 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + pull * (theta - [1.0, 0.0])
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - np.clip(step, -2, 2)
    return max(float(theta[0]), 0.05), float(theta[1])


def build_index(table: pa.Table, sizes: dict[int, int], terms: np.ndarray, idf: np.ndarray, k: int = NEIGHBOURS) -> Index:
    y = np.asarray(table["label"].to_numpy(), float)
    ids = table["doc_id"].to_numpy()
    column = table["text"].combine_chunks()
    held = {c: max(int((y == c).sum()), 1) for c in (0, 1)}
    total = sum(sizes.values())
    weight = np.where(y == 1, sizes[1] / held[1], sizes[0] / held[0])
    out = Index(terms, idf, prior=(sizes[1] + 0.5) / (total + 1))
    vectors: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for lo, doc, term, n in term_counts(column, terms):
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for d, t, c in zip(np.split(doc, cuts), np.split(term, cuts), np.split(n, cuts)):
            if len(d):
                vectors[lo + int(d[0])] = (t, out.vector(t, c))
    # neighbours in the order of their heaviest terms share blocks, which keeps block maxima tight
    rows = sorted(vectors, key=lambda r: (int(vectors[r][0][np.argmax(vectors[r][1])]), int(ids[r])))
    out.ids, out.y, out.weight = ids[rows], y[rows], weight[rows]
    if rows:
        at = np.repeat(np.arange(len(rows)), [len(vectors[r][0]) for r in rows])
        out.post(np.concatenate([vectors[r][0] for r in rows]), at, np.concatenate([vectors[r][1] for r in rows]))
    bare = np.ones(len(y), bool)
    bare[rows] = False
    out.empty = float((weight[bare] @ y[bare] + 0.5 * out.prior) / (weight[bare].sum() + 0.5))
    raw = np.array([out.vote(*out.nearest(*vectors[r], k, without=at)) for at, r in enumerate(rows)])
    if len(rows):
        out.slope, out.shift = _platt(raw, out.y, out.weight / out.weight.mean())
    return out


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many documents there are."""

    def count(batches):
        df, rows = np.zeros(len(terms) + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, term, _ in term_counts(batch.column(0), terms):
                df += np.bincount(term, minlength=len(df))
        df[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], names=["term", "n"])

    out = np.zeros(len(terms) + 1, np.int64)
    for term, n in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out[:-1], int(out[-1])


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = EXAMPLES_PER_CLASS, k: int = NEIGHBOURS,
    label: str = "toxic", label_docs: DataFrame | None = None, row: bool = False,
) -> DataFrame:
    """One row for each row with an id: doc_id, held_out, score, predicted, evidence (ids of the nearest examples),
    and with ``row`` the row itself, all its columns in one struct.

    Learns from labelled rows whose crc32(id) modulo ``folds`` is not ``held_out``, at most ``per_class`` of each
    class; ``label_docs`` (``docs`` by default) holds their texts. Each row is scored by its own text, so rows that
    repeat an id get one score for each text. Empty and null texts, and texts without any term, get the rate of
    toxic ones among such examples. Without labels every score is the prior 0.5 of no evidence.
    """
    rows = told_apart(docs, row=row)
    table, sizes = sample(texts(docs if label_docs is None else label_docs), labels, label, fold("doc_id", folds) != held_out, per_class)
    terms = choose_terms(table["text"].combine_chunks(), table["label"].to_numpy())
    df, n_docs = document_frequencies(texts(docs), terms)
    index = build_index(table, sizes, terms, np.log((n_docs + 1) / (df + 1)) + 1, k)

    def score(batches):
        for batch in batches:
            text = batch.column(1).field("text") if row else batch.column(1)
            scores = np.full(batch.num_rows, index.empty)
            evidence: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for lo, doc, term, n in term_counts(text, terms):
                cuts = np.flatnonzero(np.diff(doc)) + 1
                for d, t, c in zip(np.split(doc, cuts), np.split(term, cuts), np.split(n, cuts)):
                    if len(d):
                        near, cosines = index.nearest(t, index.vector(t, c), k)
                        if len(near):
                            scores[lo + int(d[0])] = index.calibrated(index.vote(near, cosines))
                            evidence[lo + int(d[0])] = index.ids[near].tolist()
            columns = [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *([batch.column(1)] if row else [])], names=schema.names)

    schema = StructType().add("doc_id", LongType()).add("score", DoubleType()).add("predicted", IntegerType()).add("evidence", ArrayType(LongType()))
    schema = schema.add(rows.schema["row"]) if row else schema
    out = rows.select("doc_id", "row" if row else "text").mapInArrow(score, schema)
    return out.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", "predicted", "evidence", *(["row"] if row else []))
