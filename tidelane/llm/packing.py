"""Best-fit packing of tokenized documents into sequences of a fixed length.

Documents longer than a sequence are cut into full pieces behind a shorter first one. Pieces over half a sequence get
a sequence each, whose gap goes into the table of gaps. The other pieces follow in bands, from a longest length down to
half of it or on to what still fits one range of rows, each in bulk-synchronous rounds over tables:

1. the band's pieces and the gaps that could hold one are range-sorted together by falling size, gaps before pieces;
2. every task sweeps its range: a piece goes into the tightest gap that holds it (its successor in the sort), and
   what that gap has left is at once a gap again;
3. pieces and gaps that a range could not match are numbered. Any gap kept from an earlier range holds any piece of a
   later one, so ranges are matched from their counts alone, the nearest earlier range first; conflicts go by rank:
   the k-th piece takes the k-th gap, and where all fit, several pieces share one;
4. gaps shrink and the round is repeated with what is left, until no gap is found for it; then a sweep may also open
   sequences.

A round moves the pieces of its band and the gaps, nothing else; the driver sees two rows of counts for each range. A
range has a fixed number of rows, in whatever sizes they are. With one range the outcome is exactly best-fit decreasing.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import stage, texts

SEQUENCE_LENGTH, END_ID = 1024, 2
ROWS_PER_RANGE = 1 << 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_symbols() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def byte_bpe(path: str):
    """An encoder text -> ids for a byte-level BPE tokenizer file, special strings read as ordinary text.

    The file's ids are the ranks of its merges, so tiktoken gives the same ids as the tokenizers library,
    several times as fast.
    """
    import public_tokenizers
    import tiktoken

    symbol = _byte_symbols()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    ranks = {bytes(symbol[c] for c in word): i for word, i in vocab.items() if all(c in symbol for c in word) and not word.startswith("<|")}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones behind a first that may be shorter."""
    first = n % limit or min(n, limit)
    return [(0, first), *((s, limit) for s in range(first, n, limit))]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, limit: int = SEQUENCE_LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document; an empty text is the end id alone."""

    def pieces(batches):
        encode = byte_bpe(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(encode(text.as_py()) + [end_id], dtype="<u4")
                rows += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), limit))]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs, id_col, text_col).mapInArrow(pieces, PIECES)


def sweep(lengths: np.ndarray, gaps: np.ndarray, limit: int, opening: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of pieces (from long to short) into sequences with the given gaps (ascending), and into new sequences
    if ``opening``: each piece's sequence (its place in ``gaps``, new ones behind; -1: none), its offset, and the gap
    that each sequence has left. Works on runs of equal lengths and gaps, so its steps depend on ``limit`` only.
    """
    runs: list[tuple[int, int, int, int]] = []  # first piece, count, first sequence, offset
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, count)
    sizes: list[int] = []  # the gaps that have sequences, ascending

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if not free[gap]:
                bisect.insort(sizes, gap)
            free[gap].append((first, count))

    for gap, first, count in zip(*(a.tolist() for a in np.unique(gaps, return_index=True, return_counts=True))):
        leave(gap, first, count)
    opened = len(gaps)
    for size, at, left in zip(*(a.tolist() for a in np.unique(-lengths, return_index=True, return_counts=True))):
        length = -size
        while left and (k := bisect.bisect_left(sizes, length)) < len(sizes):
            gap = sizes[k]
            first, count = free[gap].pop()
            if not free[gap]:
                sizes.pop(k)
            used = min(left, count)
            runs.append((at, used, first, limit - gap))
            leave(gap, first + used, count - used)
            leave(gap - length, first, used)
            at, left = at + used, left - used
        if not opening:
            continue
        each = limit // length
        whole, rest = divmod(left, each)
        for j in range(each if whole else 0):
            runs.append((at, whole, opened, j * length))
            at += whole
        leave(limit - each * length, opened, whole)
        opened += whole
        for j in range(rest):
            runs.append((at, 1, opened, j * length))
            at += 1
        if rest:
            leave(limit - rest * length, opened, 1)
            opened += 1
    sequence, offset = np.full(len(lengths), -1), np.zeros(len(lengths), np.int64)
    left_over = np.concatenate((gaps, np.full(opened - len(gaps), limit)))
    for at, n, first, start in runs:
        sequence[at : at + n], offset[at : at + n] = np.arange(first, first + n), start
        left_over[first : first + n] -= lengths[at]
    return sequence, offset, left_over


def _swept(table: pa.Table, part: int, limit: int, opening: bool) -> pa.Table:
    """A range of gaps (kind 0) and pieces (kind 1) after its sweep. ``nth`` numbers what other ranges may match: pieces
    without a sequence from the longest, gaps that hold whatever follows the range from the tightest (-1: none)."""
    kind, size, ids = (table[c].to_numpy().astype(np.int64) for c in ("kind", "size", "id"))
    gap, piece = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    gap, piece = gap[np.argsort(size[gap], kind="stable")], piece[np.argsort(-size[piece], kind="stable")]
    to, offset, left = sweep(size[piece], size[gap], limit, opening)
    # a new sequence is named by the piece that it begins with
    names = np.concatenate((ids[gap], np.zeros(len(left) - len(gap), np.int64)))
    first = (to >= len(gap)) & (offset == 0)
    names[to[first]] = ids[piece[first]]
    sequence, place, nth, now = np.full(len(kind), -1), np.zeros(len(kind), np.int64), np.full(len(kind), -1), size.copy()
    sequence[piece] = np.where(to >= 0, np.append(names, -1)[to], -1)
    place[piece], now[gap] = offset, left[: len(gap)]
    nth[piece[to < 0]] = np.arange((to < 0).sum())
    usable = gap[now[gap] >= size.min()]
    nth[usable[np.argsort(now[usable], kind="stable")]] = np.arange(len(usable))
    old = {"kind": kind, "size": now, "id": ids, "sequence_id": sequence, "offset": place, "range": np.full(len(kind), part), "nth": nth}
    n = len(left) - len(gap)
    new = {"kind": np.zeros(n, int), "size": left[len(gap) :], "id": names[len(gap) :], "sequence_id": np.full(n, -1), "offset": np.zeros(n, int), "range": np.full(n, part), "nth": np.full(n, -1)}
    columns = [pa.array(np.concatenate((old[c], new[c])), pa.int32() if c in ("kind", "size", "range") else pa.int64()) for c in old]
    row = pa.chunked_array([*table["row"].chunks, pa.nulls(n, table["row"].type)], table["row"].type)
    return pa.table([*columns, row], names=[*old, "row"])


def sweep_ranges(items: DataFrame, ranges: int, limit: int, opening: bool) -> DataFrame:
    """Sweeps (kind, size, id, row) in ranges of falling size."""
    keys = [F.desc("size"), "kind", "id"]
    schema = StructType().add("kind", IntegerType()).add("size", IntegerType()).add("id", LongType()).add("sequence_id", LongType())
    schema = schema.add("offset", LongType()).add("range", IntegerType()).add("nth", LongType()).add("row", items.schema["row"].dataType)

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _swept(pa.Table.from_batches(held), TaskContext.get().partitionId(), limit, opening).to_batches(max_chunksize=10000)

    return items.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def match_ranges(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """From (range, kind, count, least, largest) of what ranges have left: links (range, its first piece, pieces, range of
    the gaps, first gap, pieces a gap). Pieces take the gaps of the nearest earlier range that has any, tightest first."""
    links, free = [], []
    for part, kind, count, least, largest in sorted(found, key=lambda f: (f[0], -f[1])):  # pieces, then gaps
        if kind == 0:
            free.append((part, 0, count, least))
            continue
        at = 0
        while at < count and free:
            other, first, n, gap = free.pop()
            each = gap // largest
            used = min(n, -(-(count - at) // each))
            took = min(count - at, used * each)
            links.append((part, at, took, other, first, each))
            at += took
            if used < n:
                free.append((other, first + used, n - used, gap))
    return links


def _across(swept: DataFrame, links: list[tuple], limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed rows, gaps left, pieces left) once the links between ranges are followed."""
    spark = swept.sparkSession
    table = spark.createDataFrame(links, "range int, at long, took long, other int, first long, each long")
    pieces = swept.where("kind = 1 AND sequence_id < 0").select("size", "id", "row", "range", "nth")
    linked = F.expr("nth >= at AND nth < at + took")
    met = stage(pieces.join(table, (pieces["range"] == table["range"]) & linked, "left").select("size", "id", "row", "nth", "other", F.expr("first + (nth - at) DIV each").alias("slot")), "met-pieces")
    before = F.sum("size").over(Window.partitionBy("other", "slot").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    hit = met.where("other IS NOT NULL").withColumn("before", F.coalesce(before, F.lit(0)))
    gaps = swept.where("kind = 0")
    to = gaps.where("nth >= 0").select(F.col("id").alias("sequence_id"), F.col("size").alias("gap"), F.col("range").alias("other"), F.col("nth").alias("slot"))
    placed = stage(hit.join(to, ["other", "slot"]).select("row", "sequence_id", (F.lit(limit) - F.col("gap") + F.col("before")).alias("offset"), "size"), "placed-across")
    used = placed.groupBy(F.col("sequence_id").alias("id")).agg(F.sum("size").alias("used"))
    left = gaps.join(used, "id", "left").select("id", (F.col("size") - F.coalesce("used", F.lit(0))).cast("int").alias("size"))
    return placed.select("row", "sequence_id", "offset"), left, met.where("other IS NULL").select("id", "size", "row")


def pack(pieces: DataFrame, limit: int = SEQUENCE_LENGTH, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length (1 to limit); sequences are named by numbers of pieces."""
    numbered = stage(pieces.select(F.col("length").cast("int").alias("size"), F.monotonically_increasing_id().alias("id"), F.struct("*").alias("row")), "numbered-pieces")
    counts = {r["size"]: r["count"] for r in numbered.groupBy("size").count().collect()}  # at most ``limit`` rows
    alone = numbered.where(F.col("size") > limit // 2)
    placed = [alone.select("row", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    gaps = alone.where(F.col("size") < limit).select("id", (F.lit(limit) - F.col("size")).alias("size"))
    longest = limit // 2
    while longest:
        least = longest // 2 + 1
        left = sum(n for size, n in counts.items() if least <= size <= longest)
        while least > 1 and left + counts.get(least - 1, 0) <= rows_per_range:
            least -= 1
            left += counts.get(least, 0)
        waiting, opening = numbered.where(F.col("size").between(least, longest)), False
        while left:
            usable = gaps.where(F.col("size") >= least)
            held = usable.count()
            ranges = max(1, -(-(left + held) // rows_per_range))
            opening = opening or ranges == 1 or not held
            none = F.lit(None).cast(numbered.schema["row"].dataType).alias("row")
            items = waiting.select(F.lit(1).alias("kind"), "size", "id", "row").unionByName(usable.select(F.lit(0).alias("kind"), "size", "id", none))
            swept = stage(sweep_ranges(items, ranges, limit, opening), "swept-ranges")
            placed.append(swept.where("kind = 1 AND sequence_id >= 0").select("row", "sequence_id", "offset"))
            found = swept.where("nth >= 0").groupBy("range", "kind").agg(F.count("*"), F.min("size"), F.max("size"))
            found = [] if opening else list(map(tuple, found.collect()))
            links = match_ranges(found)
            left = sum(n for _, kind, n, _, _ in found if kind == 1) - sum(link[2] for link in links)
            if links:
                across, now, waiting = _across(swept, links, limit)
                placed.append(across)
            else:
                now, waiting, opening = swept.where("kind = 0"), swept.where("kind = 1 AND sequence_id < 0").select("id", "size", "row"), True
            gaps = gaps.where(F.col("size") < least).unionByName(now.where("size > 0").select("id", "size"))
            gaps = stage(gaps, "gaps") if links else gaps
        longest = least - 1
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.select("row.*", "sequence_id", "offset")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, limit: int = SEQUENCE_LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece with the end id alone. An empty table gives no rows. Rows that repeat an
    id are packed each.
    """
    return pack(tokenized_pieces(docs, tokenizer_path, limit, end_id, id_col, text_col), limit)
