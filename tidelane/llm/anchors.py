"""Sampled positions that any two equal windows share, and the runs of windows around them.

Every window of ``window`` tokens has an anchor: its leftmost ``gram``-token substring of least hash. Equal windows
have equal anchors at the same place, so windows need to be compared only where their anchors' grams are equal.
Consecutive windows with one anchor form a run; about two runs start in each (window - gram + 1) tokens, so what
moves is a small share of the text. Runs with the same tokens are of one class, named by a 128-bit cryptographic
digest (BLAKE2b) of those tokens: all windows of a later one repeat windows of the earlier one, and nothing else
about them needs comparing. Hashes of grams only deal runs out; a collision there costs a comparison, not a result.

``settled_and_open`` deals run records out by anchor and folds them as they stream by, sorted by class: slices send
one row of a class each, and a task holds one class, however many rows its anchor has. The first runs of classes that
share their anchor with another class are left open for a comparison of their tokens, which differs by operator; an
anchor with very many of them is dealt over several tasks there. Runs whose anchor has one class leave.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .subwords import mixed

_BASE = 0x9E3779B97F4A7C15 | 1
_POSITION_BITS = np.uint64(32)  # of a token in a slice; one text has less than 2**31 bytes
_FIELD = 15  # bits of the anchor's place in a run and of the number of its windows
RUN_RECORD = "key long, c1 long, c2 long, doc_id long, v long, span long"

# span packs a run: first window start << 31 | anchor's place in the run << 16 | windows << 1 | settled


def pack_span(lo, off, n, settled):
    return lo << 2 * _FIELD + 1 | off << _FIELD + 1 | n << 1 | settled


def unpack_span(span):
    low = (1 << _FIELD) - 1
    return span >> 2 * _FIELD + 1, span >> _FIELD + 1 & low, span >> 1 & low, span & 1


def span_start(span: str) -> Column:
    return F.shiftright(span, 2 * _FIELD + 1)


def span_windows(span: str) -> Column:
    return F.shiftright(span, 1).bitwiseAND(F.lit((1 << _FIELD) - 1))


def check_window(window: int, gram: int) -> None:
    """Windows and grams that the run records can hold; others are an error."""
    if gram < 1 or gram & (gram - 1) or gram > window:
        raise ValueError(f"gram must be a power of two of at most window, not {gram} of {window}")
    if window - gram + 1 >= 1 << _FIELD:
        raise ValueError(f"window - gram must be below {(1 << _FIELD) - 1}, not {window - gram}")


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k tokens from each position, k a power of two."""
    h = mixed(tokens, 11)
    n = 1
    while n < k:
        h = h[:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + h[n:] if len(h) > n else h[:0]
        n *= 2
    return mixed(h)


@dataclass
class Runs:
    doc: np.ndarray  # number of the text
    first: np.ndarray  # first token, counted in the array
    lo: np.ndarray  # first window start, counted from the text's start
    off: np.ndarray  # place of the anchor after lo
    n: np.ndarray  # windows
    key: np.ndarray


def runs(tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> Runs:
    """The runs of several texts whose tokens lie in one array; windows never cross texts."""
    has = lengths >= window
    if not has.any():
        empty = np.zeros(0, np.int64)
        return Runs(empty, empty, empty, empty, empty, empty.astype(np.uint64))
    h = gram_hashes(tokens, gram)
    low = (np.uint64(1) << _POSITION_BITS) - np.uint64(1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, n = window - gram + 1, 1
    while n * 2 <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if width > n:
        least = np.minimum(least[: len(least) - (width - n)], least[width - n :])
    mark = np.zeros(len(tokens) + 1, np.int8)
    mark[starts[has]] += 1
    mark[starts[has] + lengths[has] - window + 1] -= 1
    at = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8))
    anchor = (least[at] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.append(first[1:], len(at)) - 1
    lo, hi, anchor = at[first], at[last], anchor[first]
    doc = np.searchsorted(starts, lo, side="right") - 1
    # texts without tokens share their start with the next text: the last of them owns the position
    return Runs(doc, lo, lo - starts[doc], anchor - lo, hi - lo + 1, h[anchor])


def digests(buf, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b of the bytes from begin to end, as two integers."""
    view, digest = memoryview(buf), hashlib.blake2b
    out = b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist())])
    pairs = np.frombuffer(out, "<i8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _heads(new: np.ndarray) -> np.ndarray:
    """The row of the last change at or before each row, -1 before the first."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))


def records(r: Runs, content: tuple[np.ndarray, np.ndarray], ids: np.ndarray, v: np.ndarray, by_place: bool) -> pa.RecordBatch:
    """Run records of one slice. Of the runs of one class in it only the first goes on to be compared; later ones
    are settled on the spot, so a class found everywhere leaves each slice as one row to compare. Settled rows are
    dealt by a hash of their place, which no class shares."""
    doc, v = ids[r.doc], v[r.doc]
    order = np.lexsort((r.lo, v, doc, content[1], content[0], r.key))
    doc, v, key, c1, c2, lo, off, n = (x[order] for x in (doc, v, r.key, *content, r.lo, r.off, r.n))
    new = _changes(key, c1, c2)
    settled = doc > doc[_heads(new)]
    if by_place:
        settled |= lo > lo[_heads(new | _changes(doc, v))]
    key = np.where(settled, mixed(doc.astype(np.uint64) * np.uint64(0x100000001B3) + lo.astype(np.uint64)), key)
    c1, c2 = np.where(settled, 0, c1), np.where(settled, 0, c2)  # nothing asks for them any more
    columns = [key.view(np.int64), c1, c2, doc, v, pack_span(lo, off, n, settled.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "c1", "c2", "doc_id", "v", "span"])


def by_sorted_key(batches, columns: int, handle: Callable):
    """Cuts batches sorted by their first column between its values: ``handle`` gets the columns of whole keys only."""
    held: list[list[pa.Array]] = []

    def whole(*more):
        return [pa.concat_arrays(list(c)) for c in zip(*held, *more)]

    for batch in batches:
        now = [batch.column(i) for i in range(columns)]
        if not len(now[0]):
            continue
        cut = last_key_start(now[0])
        if cut:
            yield from handle(whole([c.slice(0, cut) for c in now]))
            held = []
        elif held and held[-1][0][-1] != now[0][0]:
            yield from handle(whole())
            held = []
        held.append([c.slice(cut) for c in now])
    if held:
        yield from handle(whole())


def last_key_start(column: pa.Array) -> int:
    """Where the last key of a sorted column begins."""
    if pa.types.is_integer(column.type):
        other = np.flatnonzero(column.to_numpy() != column[len(column) - 1].as_py())
        return int(other[-1]) + 1 if len(other) else 0
    last, at = column[len(column) - 1], len(column) - 1
    while at and column[at - 1] == last:
        at -= 1
    return at


def settled_and_open(run_records: DataFrame, by_place: bool) -> tuple[DataFrame, DataFrame]:
    """(settled (doc_id, v, span), open (key, doc_id, v, span, runs)): runs whose windows all stand earlier, and the
    first runs of anchors that have several classes, with how many of them the anchor has."""

    def rows(columns, kind):
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(kind.astype(np.int8))], names=["key", "doc_id", "v", "span", "kind"])

    def fold(batches):
        # the last row's class, document and text, the first document of the class and the first place in the text
        before = None
        classes, held = 0, []  # of the key that may go on: its classes so far, and open rows while there is only one
        for batch in batches:
            key, c1, c2, doc, v, span = (c.to_numpy() for c in batch.columns)
            if not len(key):
                continue
            new, other, new_key = _changes(key, c1, c2), _changes(doc, v), _changes(key)
            if before is not None:
                new[0] = (key[0], c1[0], c2[0]) != before[:3]
                other[0] = (doc[0], v[0]) != before[3:5]
                new_key[0] = key[0] != before[0]
            head = _heads(new)
            least = np.where(head >= 0, doc[head], before[5] if before is not None else 0)
            settled = (unpack_span(span)[3] == 1) | (doc > least)
            text, lo = _heads(new | other), unpack_span(span)[0]
            first = np.where(text >= 0, lo[text], before[6] if before is not None else 0)
            if by_place:
                settled |= lo > first
            before = (key[-1], c1[-1], c2[-1], doc[-1], v[-1], least[-1], first[-1])
            group = np.cumsum(new_key)  # 0 is the key of the batch before
            count = np.bincount(group, new)
            count[0] += classes
            if held and count[0] > 1:
                yield rows([np.concatenate(c) for c in zip(*held)], np.ones(sum(len(h[0]) for h in held)))
            if count[0] > 1 or group[-1] > 0:
                held = []
            several = count[group] > 1
            use = settled | several
            yield rows([c[use] for c in (key, doc, v, span)], ~settled[use])
            wait = ~settled & ~several & (group == group[-1])
            if wait.any():
                held.append([c[wait] for c in (key, doc, v, span)])
            classes = int(count[group[-1]])

    dealt = run_records.repartition("key").sortWithinPartitions("key", "c1", "c2", "doc_id", "v", "span")
    folded = stage(dealt.mapInArrow(fold, "key long, doc_id long, v long, span long, kind byte"), "runs")
    open_ = folded.where("kind = 1").select("key", "doc_id", "v", "span")
    return folded.where("kind = 0").select("doc_id", "v", "span"), open_.join(open_.groupBy("key").agg(F.count("*").alias("runs")), "key")


def covered(settled: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, v, hits): all stretches (first window start, windows) of a text that are repeats."""
    whole = settled.select("doc_id", "v", span_start("span").alias("start"), span_windows("span").alias("n"))
    return whole.unionByName(found).groupBy("doc_id", "v").agg(F.collect_list(F.struct("start", "n")).alias("hits"))


def mask(hits, length: int, window: int) -> np.ndarray:
    """Which of ``length`` tokens a repeated window covers."""
    edge = np.zeros(length + 1, np.int64)
    if len(hits):
        start, n = (np.asarray([h[k] for h in hits], np.int64) for k in ("start", "n"))
        np.add.at(edge, np.minimum(start, length), 1)
        np.add.at(edge, np.minimum(start + n - 1 + window, length), -1)
    return np.cumsum(edge[:-1]) > 0
