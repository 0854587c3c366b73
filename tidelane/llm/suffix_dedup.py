"""Repeated byte strings by a sampled suffix array.

Of all suffixes only those at anchors take part (see ``anchors``): every string of the given length holds one. The
suffixes that are still open after equal runs are settled are range-partitioned by their leading bytes with
splitters sampled from them; each bucket sorts the window-length suffixes of its runs by multikey quicksort on
8-byte keys, level by level, and equal neighbours in that order are repeats. Splitters fall between leading
strings, so a window has all its equals in its own bucket, with one exception: a leading string with more runs than
a task should take is dealt over several parts. The distinct windows of its parts are then compared across their
boundaries by an aggregation on digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import RUN_RECORD, by_sorted_key, check_window, covered, digests, mask, records, runs, settled_and_open, unpack_span
from .common import several_texts, stage, told_apart
from .subwords import slices

LENGTH, GRAM = 100, 32
_SAME = np.arange(256, dtype=np.uint8)
SORTED_WINDOWS = 100_000  # windows sorted at once
SPLIT_RUNS = 20_000  # runs of one leading string that a task takes; more are dealt to several


def byte_runs(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Run records of (doc_id, v, text)."""

    def run(batches):
        for batch in batches:
            ids, v = (batch.column(i).to_numpy() for i in range(2))
            for sl in slices(batch.column(2), _SAME):
                r = runs(sl.buf.astype(np.uint64), sl.starts, sl.lengths, length, gram)
                content = digests(sl.buf, r.first, r.first + r.n - 1 + length)
                yield records(r, content, ids[sl.lo : sl.hi], v[sl.lo : sl.hi], by_place=True)

    return rows.mapInArrow(run, RUN_RECORD)


def _segments(rows: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(lead, part, doc_id, v, lo, off, n, seg): the bytes of open runs; lead are the bytes at their anchor."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, v, text, spans in zip(*(batch.column(i) for i in range(4))):
                raw = text.as_py().encode()
                for s in spans.as_py():
                    lo, off, n, _ = unpack_span(s["span"])
                    out.append((raw[lo + off : lo + off + gram], s["part"], doc.as_py(), v.as_py(), lo, off, n, raw[lo : lo + n - 1 + length]))
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 8, types)]
            yield pa.RecordBatch.from_arrays(columns, names=["lead", "part", "doc_id", "v", "lo", "off", "n", "seg"])

    found = rows.join(wanted, ["doc_id", "v"]).select("doc_id", "v", "text", "spans")
    return found.mapInArrow(run, "lead binary, part long, doc_id long, v long, lo long, off int, n int, seg binary")


def equal_groups(matrix: np.ndarray) -> np.ndarray:
    """A group number for each row of a byte matrix, equal for equal rows and -1 for rows without an equal.

    Multikey quicksort, breadth first: all groups of rows that agree so far are sorted by their next 8 bytes at
    once, and rows that agree with no other leave.
    """
    n, width = matrix.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = matrix
    keys = padded.view(">u8").astype(np.uint64)
    row, group = np.arange(n), np.zeros(n, np.int64)
    for level in range(keys.shape[1]):
        key = keys[row, level]
        order = np.lexsort((key, group))
        row, group, key = row[order], group[order], key[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))[: len(row)]
        number = np.cumsum(new) - 1
        alone = np.bincount(number, minlength=1)[number] < 2
        row, group = row[~alone], number[~alone]
        if not len(row):
            break
    out = np.full(n, -1)
    out[row] = group
    return out


def _windows(seg: list[bytes], off: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, run, start in run) of all windows of the runs."""
    buf = np.frombuffer(b"".join(seg), np.uint8)
    sizes = np.array([len(s) for s in seg], np.int64)
    begin = np.cumsum(sizes) - sizes
    run = np.repeat(np.arange(len(seg)), n)
    at = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    view = np.lib.stride_tricks.sliding_window_view(buf, length) if len(buf) >= length else np.zeros((0, length), np.uint8)
    return view[begin[run] + at], run, at


def _repeated(doc, v, lo, off, n, seg, length: int):
    """(run, start) of the windows that also stand earlier, in a smaller document or before in the same text, among
    these runs."""
    matrix, run, at = _windows(seg, off, n, length)
    group = equal_groups(matrix)
    use = np.flatnonzero(group >= 0)
    order = use[np.lexsort((lo[run[use]] + at[use], v[run[use]], doc[run[use]], group[use]))]
    if not len(order):
        return order, order
    g, d, w, p = group[order], doc[run[order]], v[run[order]], lo[run[order]] + at[order]
    new = np.concatenate(([True], g[1:] != g[:-1]))
    text = new | np.concatenate(([True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])))
    later = (d > d[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))]) | (p > p[np.maximum.accumulate(np.where(text, np.arange(len(g)), 0))])
    return run[order][later], at[order][later]


def dealt(open_: DataFrame) -> DataFrame:
    """Open runs, and the part of their leading string that they go to: -1 if it is not dealt over several."""
    part = F.pmod(F.xxhash64("doc_id", "v", "span"), F.ceil(F.col("runs") / SPLIT_RUNS))
    return open_.select("doc_id", "v", "span", F.when(F.col("runs") > SPLIT_RUNS, part).otherwise(F.lit(-1)).cast("long").alias("part"))


def _compared(segments: DataFrame, length: int) -> DataFrame:
    """(doc_id, v, start, n): stretches of windows that repeat."""

    def rows(doc, v, start, n=None, digest=None):
        k = len(doc)
        n = np.ones(k, np.int64) if n is None else n
        columns = [*(pa.array(np.asarray(c, np.int64)) for c in (doc, v, start, n)), pa.array(digest or [None] * k, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "v", "start", "n", "digest"])

    def stretches(doc, v, lo, run, start):
        """Windows of runs that follow each other become one row."""
        order = np.lexsort((start, run))
        run, start = run[order], start[order]
        first = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (start[1:] != start[:-1] + 1)))) if len(run) else run
        return rows(doc[run[first]], v[run[first]], lo[run[first]] + start[first], np.diff(np.append(first, len(run))))

    def sort_runs(columns):
        key, doc, v, lo, off, n, seg, split = columns
        doc, v, lo, off, n = (c.to_numpy().astype(np.int64) for c in (doc, v, lo, off, n))
        seg = seg.to_pylist()
        # whole keys, in chunks of bounded size; a larger one goes by the anchor's place in the window
        marks = key.to_pylist()
        edge = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
        total = np.concatenate(([0], np.cumsum(n)))
        k = 0
        while k < len(edge) - 1:
            j = k + 1
            while j + 1 < len(edge) and total[edge[j + 1]] - total[edge[k]] <= SORTED_WINDOWS:
                j += 1
            a, b = edge[k], edge[j]
            if total[b] - total[a] <= SORTED_WINDOWS:
                parts = [(np.arange(a, b), None)]
            else:
                parts = [(a + np.flatnonzero((off[a:b] - o >= 0) & (off[a:b] - o < n[a:b])), o) for o in range(int(off[a:b].max()) + 1)]
            for at, o in parts:
                if len(at) < 2:
                    continue
                if o is None:
                    run, start = _repeated(doc[at], v[at], lo[at], off[at], n[at], seg[a:b], length)
                    yield stretches(doc[at], v[at], lo[at], run, start)
                else:
                    first = off[at] - o
                    run, _ = _repeated(doc[at], v[at], lo[at] + first, off[at], np.ones(len(at), np.int64), [seg[i][f : f + length] for i, f in zip(at, first)], length)
                    yield rows(doc[at[run]], v[at[run]], (lo[at] + first)[run])
            k = j
        over = np.flatnonzero(split.to_numpy(zero_copy_only=False))
        if len(over):
            yield from at_boundary(doc[over], v[over], lo[over], n[over], [seg[i] for i in over])

    def at_boundary(doc, v, lo, n, seg):
        """For each distinct window the places in its least document that this part has not settled: the first in
        each text."""
        names = b"".join(b"".join(hashlib.blake2b(s[i : i + length], digest_size=16).digest() for i in range(count)) for count, s in zip(n.tolist(), seg))
        digest = np.frombuffer(names, "<u8").reshape(-1, 2)
        run = np.repeat(np.arange(len(n)), n)
        start = lo[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        doc, v = doc[run], v[run]
        order = np.lexsort((start, v, doc, digest[:, 1], digest[:, 0]))
        digest, doc, v, start = digest[order], doc[order], v[order], start[order]
        new = np.concatenate([[True], (digest[1:] != digest[:-1]).any(1)])
        owner = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        first = new | np.concatenate([[True], (doc[1:] != doc[:-1]) | (v[1:] != v[:-1])])
        keep = np.flatnonzero(first & (doc == owner))
        for k in range(0, len(keep), 50_000):
            at = keep[k : k + 50_000]
            yield rows(doc[at], v[at], start[at], digest=[x.tobytes() for x in digest[at]])

    def run(batches):
        yield from by_sorted_key(batches, 8, sort_runs)

    split = F.col("part") >= 0
    key = F.when(split, F.concat("lead", F.unhex(F.lpad(F.hex("part"), 16, "0")))).otherwise(F.col("lead"))
    parts = segments.select(key.alias("key"), "doc_id", "v", "lo", "off", "n", "seg", split.alias("split"))
    ranged = parts.repartitionByRange("key").sortWithinPartitions("key", "doc_id", "v", "lo")
    out = stage(ranged.mapInArrow(run, "doc_id long, v long, start long, n long, digest binary"), "windows")
    # a distinct window of a dealt leading string has a few rows for each part
    same = Window.partitionBy("digest")
    edges = out.where("digest is not null").select("*", F.min("doc_id").over(same).alias("_doc"), F.min("start").over(Window.partitionBy("digest", "doc_id", "v")).alias("_start"))
    across = edges.where((F.col("doc_id") > F.col("_doc")) | (F.col("start") > F.col("_start")))
    return out.where("digest is null").select("doc_id", "v", "start", "n").unionByName(across.select("doc_id", "v", "start", "n"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row with an id: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    Removed is each byte covered by a ``length``-byte string that also starts earlier: in a document with a smaller
    id, or before it in the same text. Strings never cross documents, may overlap, and are judged on the input.
    Empty and null texts have no bytes. Rows that repeat an id are one document, and not earlier than each other;
    several texts of an id are each judged by themselves. An empty table gives no rows.
    """
    check_window(length, gram)
    apart = several_texts(docs, id_col, text_col)
    rows = told_apart(docs, id_col, text_col, apart=apart)
    settled, open_ = settled_and_open(byte_runs(rows, length, gram), by_place=True)
    wanted = dealt(open_).groupBy("doc_id", "v").agg(F.collect_set(F.struct("part", "span")).alias("spans"))
    found = _compared(stage(_segments(rows, wanted, length, gram), "segments"), length)
    hits = covered(settled, found)

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, hit in zip(*(batch.column(i) for i in range(3))):
                raw = np.frombuffer(text.as_py().encode(), np.uint8)
                gone = mask(hit.as_py() or [], len(raw), length)
                spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
                out.append((doc.as_py(), len(raw), int(gone.sum()), spans, raw[~gone].tobytes()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(hits, ["doc_id", "v"], "left").select("doc_id", "text", "hits")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
