"""SentencePiece encoding and decoding, with giant texts split by a max-plus scan.

Pieces in a row are the encoding of a text if and only if each two neighbours are the encoding of theirs
(``Model.stands``). So the encoding is the one best path over pieces where allowed neighbours score 0 and others
minus infinity, and a giant text can be cut anywhere, inside words too, and worked on in chunks:

* the state at a boundary is the piece that covers the character before it: how much of it lies before and after;
* a chunk yields the matrix of best scores from every entry state to every exit state. Only the stretches before
  its first and after its last place that no piece crosses need a search; without such a place the whole chunk does;
* max-plus products are associative: matrices are combined by a tree over (text, chunk), a bounded number at a time,
  and the states at all boundaries come back down the same tree;
* each chunk then gives the ids between its two states, alone.

Text is first normalised as the model says for identity normalisation: a dummy space in front, spaces as U+2581.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, told_apart
from .sentencepiece_bpe import Model, model
from .subwords import row_ranges

CHUNK = 1 << 16
TOGETHER = 64  # matrices that are combined at once
TEXT_AT_ONCE = 1 << 19  # bytes of short texts whose new words are segmented together
START = 0  # the state before a text
MATRIX = "doc_id long, v long, k long, e array<int>, x array<int>, t array<float>"

# a state is (characters of the piece before the boundary) << 8 | (after it)


def boundaries(n: int, chunk: int) -> list[int]:
    """Where chunks of a text of n characters begin, and its end; the last chunk takes the remainder."""
    return [*range(0, max(1, n // chunk) * chunk, chunk), n]


def pieces_at(m: Model, s: str, i: int, longest: int | None = None) -> Iterator[int]:
    """Ends of the pieces that begin at i (a character that is no piece stands for itself)."""
    for j in range(i + 1, min(len(s), i + (longest or m.longest)) + 1):
        if (s[i:j] in m.ids or j == i + 1) and m.stands(s[i:j], ""):
            yield j


def states_at(m: Model, s: str, p: int) -> list[int]:
    """The pieces that can cover the character before position p of a string."""
    if p == 0:
        return [START]
    return sorted((p - i) << 8 | (j - p) for i in range(max(0, p - m.longest), p) for j in pieces_at(m, s, i) if j >= p)


def _search(m: Model, s: str, begin: dict[tuple[int, int], int], a: int, b: int) -> dict[tuple[int, int], int]:
    """Pieces (first, end) that cover position b - 1 or end at b, reachable from ``begin``, pieces of s that cover
    position a - 1; the values are bit sets of what each is reached from."""
    reached = dict(begin)
    ending: dict[int, list[tuple[int, int]]] = {}
    for piece in begin:
        ending.setdefault(piece[1], []).append(piece)
    for i in range(a, b):
        before = ending.pop(i, ())
        if not before:
            continue
        for j in pieces_at(m, s, i):
            bits = 0
            for piece in before:
                if piece[0] == piece[1] or m.stands(s[piece[0] : piece[1]], s[i:j]):
                    bits |= reached[piece]
            if bits:
                reached[i, j] = bits
                ending.setdefault(j, []).append((i, j))
    return {(i, j): bits for (i, j), bits in reached.items() if i < b <= j}


def transfer(m: Model, s: str, before: int, n: int) -> tuple[list[int], list[int], np.ndarray]:
    """(entry states, exit states, scores) of the n characters from ``before`` of s, which goes on behind them as far
    as a piece can."""
    p0, p1 = before, before + n
    entry = states_at(m, s, p0)
    if p0:
        begin = {(p0 - (e >> 8), p0 + (e & 255)): 1 << k for k, e in enumerate(entry)}
    else:
        begin = {(0, 0): 1}  # nothing stands before the text
    free = [w.end() + p0 for w in m.words.finditer(s[p0:]) if w.end() + p0 < p1]
    first, last = (free[0], free[-1]) if free else (p1, p1)
    head = _search(m, s, begin, p0, first)
    if free:
        # every path passes here: what reaches it, times what is reached from it
        bits = 0
        for (_, j), x in head.items():
            bits |= x if j == first else 0
        exits = {piece: bits for piece in _search(m, s, {(last, last): 1}, last, p1)}
    else:
        exits = head
    states = sorted(exits, reverse=True)
    t = np.full((len(entry), len(states)), -np.inf, np.float32)
    for col, piece in enumerate(states):
        for row in range(len(entry)):
            if exits[piece] >> row & 1:
                t[row, col] = 0
    return entry, [(p1 - i) << 8 | (j - p1) for i, j in states], t


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), -np.inf, np.float32)


Matrix = tuple[list[int], list[int], np.ndarray]


def product(a: Matrix, b: Matrix) -> Matrix:
    """The matrix of two neighbouring stretches; states of their common boundary are matched by name."""
    place = {state: k for k, state in enumerate(b[0])}
    inner = np.full((len(a[1]), len(b[1])), -np.inf, np.float32)
    for row, state in enumerate(a[1]):
        if state in place:
            inner[row] = b[2][place[state]]
    return a[0], b[1], times(a[2], inner)


def between(parts: list[Matrix], entry: int, out: int) -> list[int]:
    """The states at all boundaries of neighbouring stretches on the best path from entry to out."""
    best = [np.where(np.array(parts[0][0]) == entry, 0.0, -np.inf)]
    names = [parts[0][0]]
    for e, x, t in parts:
        place = {state: k for k, state in enumerate(names[-1])}
        score = np.array([best[-1][place[state]] if state in place else -np.inf for state in e])
        best.append((score[:, None] + t).max(0))
        names.append(x)
    states = [out]
    for k in range(len(parts) - 1, -1, -1):
        e, x, t = parts[k]
        place = {state: i for i, state in enumerate(names[k])}
        score = np.array([best[k][place[state]] if state in place else -np.inf for state in e]) + t[:, x.index(states[-1])]
        states.append(e[int(np.argmax(score))])
    return states[::-1]


def _matrices(frame: pd.DataFrame) -> list[Matrix]:
    return [(list(e), list(x), np.asarray(t, np.float32).reshape(len(e), len(x))) for e, x, t in zip(frame["e"], frame["x"], frame["t"])]


def combined(level: DataFrame, together: int = TOGETHER) -> DataFrame:
    """One level up the tree: the products of up to ``together`` neighbouring matrices of a text."""

    def run(key, frame):
        parts = _matrices(frame.sort_values("k"))
        out = parts[0]
        for part in parts[1:]:
            out = product(out, part)
        return pd.DataFrame({"doc_id": [key[0]], "v": [key[1]], "k": [key[2]], "e": [out[0]], "x": [out[1]], "t": [out[2].ravel()]})

    return level.withColumn("block", F.floor(F.col("k") / together)).groupBy("doc_id", "v", "block").applyInPandas(run, MATRIX)


def spread(level: DataFrame, above: DataFrame | None, together: int = TOGETHER) -> DataFrame:
    """(doc_id, v, k, a, b): entry and exit state of each stretch of a level, from those of the blocks above it (at
    the top: from the start to the one way to end)."""
    rows = level.withColumn("block", F.floor(F.col("k") / together))
    if above is None:
        rows = rows.withColumns({"a": F.lit(START), "b": F.lit(-1)})
    else:
        rows = rows.join(above.withColumnRenamed("k", "block"), ["doc_id", "v", "block"])

    def run(frame):
        frame = frame.sort_values("k")
        parts = _matrices(frame)
        entry, out = int(frame["a"].iloc[0]), int(frame["b"].iloc[0])
        if out < 0:
            whole = parts[0]
            for part in parts[1:]:
                whole = product(whole, part)
            out = whole[1][int(np.argmax(whole[2][whole[0].index(entry)]))]
        states = between(parts, entry, out)
        return frame[["doc_id", "v", "k"]].assign(a=np.array(states[:-1], np.int32), b=np.array(states[1:], np.int32))

    return rows.groupBy("doc_id", "v", "block").applyInPandas(run, "doc_id long, v long, k long, a int, b int")


def scanned(matrices: DataFrame, chunks_of_longest: int, together: int = TOGETHER) -> DataFrame:
    """(doc_id, v, k, a, b): the state before and behind every chunk."""
    levels, n = [matrices], chunks_of_longest
    while n > together:
        levels.append(stage(combined(levels[-1], together), "matrices"))
        n = -(-n // together)
    out = None
    for level in reversed(levels):
        out = spread(level, out, together)
    return out


def _ids_batch(keys: dict[str, pa.Array], ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*keys.values(), pa.array(ids, pa.list_(pa.int32()))], names=[*keys, "ids"])


def sentencepiece_encode(docs: DataFrame, model_path: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER) -> DataFrame:
    """(doc_id, ids array<int>) of each row with an id, as SentencePiece gives them; empty and null texts have no ids.

    Texts of ``chunk`` characters and more are cut and take the scan, the others are encoded where they are. Rows
    that repeat an id get the ids of their own text each; a giant text that repeats is worked on once. ``chunk`` is
    at least four times the longest piece.
    """
    rows = told_apart(docs, id_col, text_col)
    chunk = max(chunk, 4 * model(model_path).longest)

    def short(batches):
        m = model(model_path)
        for batch in batches:
            for lo, hi in row_ranges(batch.column(1), TEXT_AT_ONCE):
                part = batch.slice(lo, hi - lo)
                yield _ids_batch({"doc_id": part.column(0)}, [np.array(x, np.int32) for x in m.encode_many([m.normal(t) for t in part.column(1).to_pylist()])])

    def cut(batches):
        m = model(model_path)
        around = 2 * m.longest
        for batch in batches:
            for doc, v, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = m.normal(text)
                at = boundaries(len(s), chunk)
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    low = max(0, a - around)
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "v": v, "k": k, "before": a - low, "n": b - a, "s": s[low : b + around]}], schema=pa.schema([("doc_id", pa.int64()), ("v", pa.int64()), ("k", pa.int64()), ("before", pa.int32()), ("n", pa.int32()), ("s", pa.string())]))

    def matrices(batches):
        m = model(model_path)
        for batch in batches:
            for r in batch.to_pylist():
                e, x, t = transfer(m, r["s"], r["before"], r["n"])
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"]]), pa.array([r["v"]]), pa.array([r["k"]]), pa.array([e], pa.list_(pa.int32())), pa.array([x], pa.list_(pa.int32())), pa.array([t.ravel()], pa.list_(pa.float32()))], names=["doc_id", "v", "k", "e", "x", "t"])

    def traced(batches):
        m = model(model_path)
        for batch in batches:
            for i, r in enumerate(batch.to_pylist()):
                p0, p1 = r["before"], r["before"] + r["n"]
                first, last = p0 + (r["a"] & 255), p1 - (r["b"] >> 8)
                ids = m.encode(r["s"][first:last]) + m.ids_of([r["s"][last : p1 + (r["b"] & 255)]])
                yield _ids_batch({c: batch.column(c).slice(i, 1) for c in ("doc_id", "v", "k")}, [np.array(ids, np.int32)])

    small = rows.where(F.length("text") < chunk).select("doc_id", "text").mapInArrow(short, "doc_id long, ids array<int>")
    giant = rows.where(F.length("text") >= chunk)
    cut_up = giant.select("doc_id", "v", "text").dropDuplicates(["doc_id", "v"]).mapInArrow(cut, "doc_id long, v long, k long, before int, n int, s string")
    # a staged file holds the chunks of whole texts: they are dealt out one by one
    chunks = stage(cut_up.repartition("doc_id", "v", "k"), "chunks")
    level = stage(chunks.mapInArrow(matrices, MATRIX), "matrices")
    most = level.agg(F.max("k")).first()[0]
    states = scanned(level, 1 if most is None else most + 1, together)
    parts = chunks.join(states, ["doc_id", "v", "k"]).mapInArrow(traced, "doc_id long, v long, k long, ids array<int>")
    whole = parts.groupBy("doc_id", "v").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda p: p["ids"])).alias("ids"))
    return small.unionByName(giant.select("doc_id", "v").join(whole, ["doc_id", "v"]).select("doc_id", "ids"))


def sentencepiece_decode(encoded: DataFrame, model_path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, text): the texts of id arrays; no ids and null give the empty text."""

    def run(batches):
        m = model(model_path)
        for batch in batches:
            names = ["doc_id", *keep]
            ids = batch.column("ids")
            text = pa.array([m.decode(x.values.to_numpy().tolist() if x.is_valid else ()) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), text], names=[*names, "text"])

    schema = encoded.select("doc_id", *keep, F.lit("").alias("text")).schema
    return encoded.mapInArrow(run, schema)
