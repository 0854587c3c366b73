"""Repeated passages of words by suffix automata.

The reference is what earlier documents (smaller ids) hold, sharded by anchor (see ``anchors``): a shard has the
runs of words around one anchor, one run for each distinct content. An anchor with more runs than a task should
take (a line that stands in many documents, each time between other words) is dealt over several shards, whose
distinct windows are then compared by an aggregation on digests.

Where runs meet in their shard, documents are streamed in order of their ids through the shard's suffix automaton:
its matching statistics give, at each word, the longest string ending there that an earlier document has; windows
that reach the threshold are repeats, and their union are the maximal spans to remove. Then the document's own
runs are added to the automaton.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .anchors import RUN_RECORD, by_sorted_key, check_window, covered, digests, mask, records, runs, settled_and_open, unpack_span
from .common import several_texts, stage, told_apart
from .subwords import SPACE, slices, word_hashes, words

WINDOW, GRAM = 50, 16
SPLIT_RUNS = 2000  # runs of one anchor that a shard takes; more are dealt to several


class SuffixAutomaton:
    """Suffix automaton of several sequences, each added by ``extend`` token by token after ``begin``."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0

    def begin(self) -> None:
        self.last = 0

    def extend(self, token: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        p = self.last
        known = nxt[p].get(token)
        if known is not None and length[known] == length[p] + 1:
            self.last = known
            return
        if known is not None:
            self.last = self._split(p, known, token)
            return
        cur = len(nxt)
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p != -1 and token not in nxt[p]:
            nxt[p][token] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][token]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, token)
        self.last = cur

    def _split(self, p: int, q: int, token: int) -> int:
        """A copy of state q for the strings that end after p and the token."""
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(token) == q:
            nxt[p][token] = copy
            p = link[p]
        return copy

    def matching(self, tokens) -> list[int]:
        """Matching statistics: for each position, the longest string ending there that the automaton knows."""
        nxt, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for token in tokens:
            while state and token not in nxt[state]:
                state = link[state]
                n = length[state]
            if token in nxt[state]:
                state, n = nxt[state][token], n + 1
            else:
                n = 0
            out.append(n)
        return out


def _packed(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buffer with single spaces between words, and where words begin and end in it."""
    gap = buf == SPACE
    buf = buf[~(gap & np.concatenate(([False], gap[:-1])))]
    return buf, *words(buf)


def word_runs(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Run records of (doc_id, v, text)."""

    def run(batches):
        for batch in batches:
            ids, v = (batch.column(i).to_numpy() for i in range(2))
            for sl in slices(batch.column(2)):
                starts, ends = words(sl.buf)
                first = np.searchsorted(starts, sl.starts)
                count = np.diff(np.append(first, len(starts)))
                buf, starts, ends = _packed(sl.buf)
                r = runs(word_hashes(buf, starts, ends), first, count, window, gram)
                content = digests(buf, starts[r.first], ends[r.first + r.n + window - 2])
                yield records(r, content, ids[sl.lo : sl.hi], v[sl.lo : sl.hi], by_place=False)

    return rows.mapInArrow(run, RUN_RECORD)


def _segments(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(key, split, doc_id, v, lo, seg): the words of open runs, space-joined."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, v, text, spans in zip(*(batch.column(i) for i in range(4))):
                w = text.as_py().encode().split()
                for s in spans.as_py():
                    lo, _, n, _ = unpack_span(s["span"])
                    out.append((s["key"], s["split"], doc.as_py(), v.as_py(), lo, b" ".join(w[lo : lo + n - 1 + window])))
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, types)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "split", "doc_id", "v", "lo", "seg"])

    found = rows.join(wanted, ["doc_id", "v"]).select("doc_id", "v", "text", "spans")
    return found.mapInArrow(run, "key long, split boolean, doc_id long, v long, lo long, seg binary")


Run = tuple[int, int, int, bytes]  # document, text of it, first word, words


def shard_repeats(runs_: list[Run], window: int) -> list[tuple[int, int, int, int]]:
    """(doc, v, start, n): stretches of windows that an earlier document of the shard has; runs sorted by document."""
    reference, names, out = SuffixAutomaton(), {}, []
    k = 0
    while k < len(runs_):
        j = k
        own = []
        while j < len(runs_) and runs_[j][0] == runs_[k][0]:
            doc, v, lo, seg = runs_[j]
            own.append([names.setdefault(w, len(names)) for w in seg.split(b" ")])
            if k:
                begin = -1
                for at, n in enumerate(reference.matching(own[-1])):
                    if n >= window and begin < 0:
                        begin = at
                    if begin >= 0 and n < window:
                        out.append((doc, v, lo + begin - window + 1, at - begin))
                        begin = -1
                if begin >= 0:
                    out.append((doc, v, lo + begin - window + 1, len(own[-1]) - begin))
            j += 1
        for tokens in own if j < len(runs_) else ():
            reference.begin()
            for token in tokens:
                reference.extend(token)
        k = j
    return out


def least_windows(runs_: list[Run], window: int) -> list[tuple[int, int, int, int, bytes]]:
    """(doc, v, start, 1, digest): each distinct window of a shard where its least document has it, at every place."""
    least: dict[bytes, tuple[int, set[tuple[int, int]]]] = {}
    for doc, v, lo, seg in runs_:
        w = seg.split(b" ")
        for i in range(len(w) - window + 1):
            digest = hashlib.blake2b(b" ".join(w[i : i + window]), digest_size=16).digest()
            known = least.get(digest)
            if known is None or doc < known[0]:
                least[digest] = doc, {(v, lo + i)}
            elif doc == known[0]:
                known[1].add((v, lo + i))
    return [(doc, v, start, 1, digest) for digest, (doc, places) in least.items() for v, start in places]


def dealt(open_: DataFrame) -> DataFrame:
    """Open runs with the key of their shard, and whether their anchor is dealt over several shards."""
    split = F.col("runs") > SPLIT_RUNS
    part = F.pmod(F.xxhash64("doc_id", "v", "span"), F.ceil(F.col("runs") / SPLIT_RUNS))
    return open_.select("doc_id", "v", "span", F.when(split, F.xxhash64("key", part)).otherwise(F.col("key")).alias("key"), split.alias("split"))


def _streamed(segments: DataFrame, window: int) -> DataFrame:
    """(doc_id, v, start, n): stretches of windows that an earlier document has."""
    types = (*[pa.int64()] * 4, pa.binary())

    def handle(columns):
        key = columns[0].to_numpy()
        doc, v, lo, seg, split = (c.to_pylist() for c in columns[1:])
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        for a, b in zip(edge[:-1], edge[1:]):
            own = list(zip(doc[a:b], v[a:b], lo[a:b], seg[a:b]))
            out = [(*x, None) for x in shard_repeats(own, window)]
            out += least_windows([x for x, s in zip(own, split[a:b]) if s], window)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "v", "start", "n", "digest"])

    def run(batches):
        yield from by_sorted_key(batches, 6, handle)

    rows = segments.select("key", "doc_id", "v", "lo", "seg", "split").repartition("key").sortWithinPartitions("key", "doc_id", "v", "lo")
    out = stage(rows.mapInArrow(run, "doc_id long, v long, start long, n long, digest binary"), "word-windows")
    # a shard has settled all places of a window but those of its least document
    edges = out.where("digest is not null")
    least = edges.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    across = edges.join(least, "digest").where("doc_id > least")
    return out.where("digest is null").select("doc_id", "v", "start", "n").unionByName(across.select("doc_id", "v", "start", "n"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """One row for each row with an id: doc_id, n_words, n_removed, kept (the words that stay, joined by one space),
    and with ``row`` the row itself, all its columns in one struct.

    Removed is each word covered by ``window`` consecutive words whose sequence also starts in a document with a
    smaller id; windows are judged on the input. Empty and null texts have no words. Rows that repeat an id are one
    document, and not earlier than each other; several texts of an id are each judged by themselves. An empty table
    gives no rows.
    """
    check_window(window, gram)
    apart = several_texts(docs, id_col, text_col)
    rows = told_apart(docs, id_col, text_col, apart=apart)
    settled, open_ = settled_and_open(word_runs(rows, window, gram), by_place=False)
    wanted = dealt(open_).groupBy("doc_id", "v").agg(F.collect_set(F.struct("key", "split", "span")).alias("spans"))
    found = _streamed(_segments(rows, wanted, window), window)
    hits = covered(settled, found)

    def run(batches):
        for batch in batches:
            out = []
            texts = batch.column(1).field(text_col) if row else batch.column(1)
            for doc, text, hit in zip(batch.column(0), texts, batch.column(2)):
                w = (text.as_py() or "").encode().split()
                gone = mask(hit.as_py() or [], len(w), window)
                kept = [w[i] for i in np.flatnonzero(~gone)] if gone.any() else w
                out.append((doc.as_py(), len(w), int(gone.sum()), b" ".join(kept).decode()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *([batch.column(1)] if row else [])], names=schema.names)

    whole = told_apart(docs, id_col, text_col, row=True, apart=apart) if row else rows
    schema = StructType().add("doc_id", LongType()).add("n_words", LongType()).add("n_removed", LongType()).add("kept", StringType())
    schema = schema.add(whole.schema["row"]) if row else schema
    return whole.join(hits, ["doc_id", "v"], "left").select("doc_id", "row" if row else "text", "hits").mapInArrow(run, schema)
