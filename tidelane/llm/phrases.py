"""Phrase collocations: Misra-Gries summaries find which n-grams can be frequent, a second pass counts those exactly.

1. Words are counted exactly. A phrase cannot be more frequent than its rarest word.
2. Every task summarises the bigrams of its texts whose words are frequent, cut by the hash of the bigram into
   partitions; one partition's summaries are merged into one of more counters than the partition's mass (occurrences)
   divided by the threshold. Such a summary underestimates by less than the threshold, so no frequent bigram is lost.
3. Longer phrases follow in the same way, those only whose bigrams all survived.
4. One more pass over the texts counts what survived by its words, not by hashes.

What survived reaches the tasks as a bitmap of hashes, of a size that is bounded by a parameter: hashes that share a
bit let a rare phrase through to the exact count, and never keep a frequent one out. Counts, cuts and comparisons of
phrases are joins of the tables of frequent phrases.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, prepare, stage

SEPARATORS = ".,;:!?\n\x0b\x0c\r"
SLICE_BYTES = 1 << 18
PART_MASS = 1 << 21  # occurrences that one summary stands for
HELD = 1 << 19  # hashes that a task holds before it passes them on
HELD_BYTES = 1 << 24  # of words or phrases with their counts, likewise
FILTER_BITS = 1 << 28  # at most; 32 bits for each survivor otherwise
SEGMENTS = 64

_SPACED = bytes.maketrans((UPPER + "\t" + SEPARATORS).encode(), (LOWER + " " + "\n" * len(SEPARATORS)).encode())
_GAP = re.compile(rb"[ \n]")
_U = np.uint64
_BASE, _STEP, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES * 2, 1 << ceil(log2(n + 1)))
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size - 1, b, _U)])) for b in (_BASE, _INVERSE))
    return tuple(p[:n] for p in _powers[size])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(30)) * _MIX1
    h = (h ^ h >> _U(27)) * _MIX2
    return h ^ h >> _U(31)


class Words:
    """The words of one slice of text: bytes, where they start and end, pieces they are in, hashes. The first ``old``
    of them belong to the slice before and are there for the phrases that go across."""

    def __init__(self, text: bytes, lang: str, old: int, chunk: np.ndarray | None = None):
        self.text, self.lang, self.old = text, lang, old
        b = np.frombuffer(text, np.uint8)
        sep = b == 10
        word = ~(sep | (b == 32))
        before = np.concatenate([[False], word[:-1]])
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(before & ~word)
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(b))
        self.piece = np.cumsum(sep, dtype=np.int64)[self.start]
        up, down = _power(len(b))
        sums = np.concatenate([[_U(0)], np.cumsum((b.astype(_U) + _U(1)) * up, dtype=_U)])
        self.hash = mixed((sums[self.end] - sums[self.start]) * down[self.start])
        self.seed = _U(xxhash.xxh64_intdigest(lang))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, whether the k words from each word on lie in one piece and end in this slice's own part)."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, _U), np.zeros(0, bool)
        g = self.hash[:n]
        for i in range(1, k):
            g = g * _STEP + self.hash[i : n + i]
        inside = self.piece[k - 1 :] == self.piece[:n]
        inside[: max(0, self.old - k + 1)] = False
        return mixed(g ^ self.seed + _U(k)), inside


def slices(text: bytes, lang: str, overlap: int) -> Iterator[Words]:
    """A text of any length as slices that end between words, each with the last ``overlap`` words of the one before."""
    at, own = 0, 0
    old = 0
    while own < len(text):
        gap = _GAP.search(text, own + SLICE_BYTES) if own + SLICE_BYTES < len(text) else None
        cut = gap.start() if gap else len(text)
        words = Words(text[at:cut], lang, old)
        yield words
        keep = min(overlap, len(words.start))
        at, old, own = (at + int(words.start[-keep]) if keep else cut), keep, cut


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(lang, texts of the batch in that language, about a slice of them at a time, separated as pieces are)."""
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        text = text.as_py()
        if text:
            held.setdefault(lang, []).append(text)
            sizes[lang] += len(text)
            if sizes[lang] >= SLICE_BYTES:
                yield lang, b"\n".join(held.pop(lang))
                del sizes[lang]
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def _sliced(batches: Iterable[pa.RecordBatch], overlap: int) -> Iterator[Words]:
    for batch in batches:
        for lang, text in _texts(batch):
            yield from slices(text.translate(_SPACED), lang, overlap)


# --- bitmaps of hashes -------------------------------------------------------------------------------------------


class Bits:
    """A bitmap that says which hashes may be among those it was made of."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, _U(64 - int(log2(len(bits) * 8)))

    def __contains__(self, h):
        raise TypeError("ask with has()")

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)


def _bitmap(survivors: DataFrame, n: int, most: int) -> np.ndarray:
    """Bitmap of the hashes in the blobs of (h binary); made segment by segment on executors, of ``most`` bits at most."""
    size = min(most, max(1 << 16, 1 << ceil(log2(32 * n + 1))))
    shift, part = _U(64 - int(log2(size))), size // SEGMENTS

    def cut(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                h = np.sort(np.frombuffer(blob, "<u8"))
                ends = np.searchsorted(h >> _U(64 - int(log2(SEGMENTS))), np.arange(SEGMENTS + 1, dtype=_U))
                some = np.flatnonzero(np.diff(ends))
                yield pa.RecordBatch.from_pydict({"segment": pa.array(some, pa.int32()), "h": pa.array([h[ends[s] : ends[s + 1]].tobytes() for s in some], pa.binary())})

    def fill(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(part, np.uint8)
        for batch in batches:
            for blob in batch.column("h").to_pylist():
                bits[(np.frombuffer(blob, "<u8") >> shift).astype(np.int64) - key[0].as_py() * part] = 1
        yield pa.RecordBatch.from_pydict({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    fill.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    out = np.zeros((SEGMENTS, part // 8), np.uint8)
    for r in survivors.mapInArrow(cut, "segment int, h binary").groupBy("segment").applyInArrow(fill, "segment int, bits binary").toLocalIterator():
        out[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


# --- Misra-Gries summaries -----------------------------------------------------------------------------------------


def combine(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal hashes added up, in order."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


class Summary:
    """A Misra-Gries summary of a stated capacity. ``lost`` is the most that any count in it falls short by."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.h, self.n, self.waiting, self.size = np.zeros(0, _U), np.zeros(0, np.int64), [], 0

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((h, n))
        self.size += len(h)
        if self.size >= 4 * self.capacity:
            self.settle()

    def settle(self) -> None:
        h, n = combine(np.concatenate([self.h, *(x for x, _ in self.waiting)]), np.concatenate([self.n, *(x for _, x in self.waiting)]))
        self.waiting, self.size = [], 0
        if len(h) > self.capacity:
            off = int(np.partition(n, len(n) - self.capacity - 1)[len(n) - self.capacity - 1])
            self.lost += off
            h, n = h[n > off], n[n > off] - off
        self.h, self.n = h, n


def _summaries(docs: DataFrame, ks: tuple[int, ...], words, pairs, partitions: int) -> DataFrame:
    """(part, mass, h, n): what each task has of each hash partition. ``words`` and ``pairs`` are broadcast bitmaps of
    frequent words and surviving bigrams; only phrases all of whose words, or bigrams, are among them count."""
    bits = _U(64 - int(log2(partitions)))

    def out(h, n):
        ends = np.searchsorted(h >> bits, np.arange(partitions + 1, dtype=_U)) if partitions > 1 else np.array([0, len(h)])
        some = np.flatnonzero(np.diff(ends))
        return pa.RecordBatch.from_pydict({
            "part": pa.array(some, pa.int64()), "mass": pa.array([int(n[ends[p] : ends[p + 1]].sum()) for p in some], pa.int64()),
            "h": pa.array([h[ends[p] : ends[p + 1]].tobytes() for p in some], pa.binary()), "n": pa.array([n[ends[p] : ends[p + 1]].astype("<u4").tobytes() for p in some], pa.binary()),
        })

    def run(batches):
        word_bits, pair_bits = Bits(words.value), Bits(pairs.value) if pairs else None
        held, size = [], 0
        h, n = np.zeros(0, _U), np.zeros(0, np.int64)
        for w in _sliced(batches, max(ks) - 1):
            g, ok = w.grams(1)
            fit = word_bits.has(g) if not pair_bits else None
            if pair_bits:
                g, ok = w.grams(2)
                fit = pair_bits.has(g)
            span = 2 if pair_bits else 1
            for k in ks:
                g, ok = w.grams(k)
                for i in range(k - span + 1):
                    ok = ok & fit[i : i + len(ok)]
                held.append(g[ok])
                size += len(held[-1])
            if size >= HELD:
                h, n = combine(np.concatenate([h, *held]), np.concatenate([n, np.ones(size, np.int64)]))
                held, size = [], 0
                if len(h) >= HELD:
                    yield out(h, n)
                    h, n = h[:0], n[:0]
        h, n = combine(np.concatenate([h, *held]), np.concatenate([n, np.ones(size, np.int64)]))
        if len(h):
            yield out(h, n)

    return docs.mapInArrow(run, "part long, mass long, h binary, n binary")


def _survivors(summaries: DataFrame, threshold: int) -> DataFrame:
    """(n, h): for each hash partition the hashes that may occur ``threshold`` times, all that do among them."""

    def merge(key, table):
        mass = int(np.sum(table["mass"].to_numpy()))
        summary = Summary(mass // threshold + 1)
        for h, n in zip(table["h"], table["n"]):
            summary.add(np.frombuffer(h.as_py(), "<u8"), np.frombuffer(n.as_py(), "<u4").astype(np.int64))
        summary.settle()
        h = summary.h[summary.n + summary.lost >= threshold]
        return pa.table({"n": pa.array([len(h)], pa.int64()), "h": pa.array([h.tobytes()], pa.binary())})

    return summaries.groupBy("part").applyInArrow(merge, "n long, h binary")


# --- exact counts --------------------------------------------------------------------------------------------------


def _rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    """One batch for each language; the counts are given up as they go."""
    while counts:
        lang, c = counts.popitem()
        columns = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(c), np.int8)), pa.array([lang])).dictionary_decode(), pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "f"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f) of every word, phrase null: of all words of a language."""
    table = bytes.maketrans((UPPER + "\t" + SEPARATORS).encode(), (LOWER + " " * (len(SEPARATORS) + 1)).encode())

    def run(batches):
        counts: dict[str, Counter] = {}
        held = 0
        for batch in batches:
            for lang, text in _texts(batch):
                text = text.translate(table)
                mine, at = counts.setdefault(lang, Counter()), 0
                while at < len(text):
                    gap = _GAP.search(text, at + SLICE_BYTES) if at + SLICE_BYTES < len(text) else None
                    cut = gap.start() if gap else len(text)
                    words, before = text[at:cut].split(), len(mine)
                    mine.update(words)
                    mine[None] += len(words)
                    held, at = held + (len(mine) - before) * (120 + (cut - at) // max(1, len(words))), cut
                if held >= HELD_BYTES:
                    yield from _rows(counts)
                    held = 0
        yield from _rows(counts)

    return docs.mapInArrow(run, "lang string, phrase binary, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _phrase_counts(docs: DataFrame, most: int, pairs, longer) -> DataFrame:
    """(lang, phrase, f): exact counts of all phrases whose hashes are in the bitmaps."""

    def run(batches):
        has = {k: Bits((pairs if k == 2 else longer).value) for k in range(2, most + 1)}
        counts: dict[str, Counter] = {}
        held = 0
        for w in _sliced(batches, most - 1):
            mine = counts.setdefault(w.lang, Counter())
            before, n = len(mine), 0
            for k in range(2, most + 1):
                g, ok = w.grams(k)
                at = np.flatnonzero(ok & has[k].has(g)) if len(g) else g.astype(np.int64)
                a, e = w.start[at].tolist(), w.end[at + k - 1].tolist()
                mine.update([b" ".join(w.text[x:y].split(b" ")) if b"  " not in w.text[x:y] else b" ".join(filter(None, w.text[x:y].split(b" "))) for x, y in zip(a, e)])
                n = max(n, sum(e) - sum(a)) if a else n
            held += (len(mine) - before) * 200
            if held >= HELD_BYTES or n > HELD_BYTES:
                yield from _rows(counts)
                held = 0
        yield from _rows(counts)

    return docs.mapInArrow(run, "lang string, phrase binary, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, most: int = 5, threshold: int = 100, lang_col: str = "lang", text_col: str = "text", filter_bits: int = FILTER_BITS, part_mass: int = PART_MASS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of every phrase of 1 to ``most`` words that occurs ``threshold`` times in a language,
    (lang, n) of all words of a language), both exact."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    counted = stage(word_counts(docs).where((F.col("f") >= threshold) | F.col("phrase").isNull()), "words")
    totals = counted.where("phrase is null").select("lang", F.col("f").alias("n"))
    words = counted.where("phrase is not null")
    mass, distinct = counted.agg(F.sum(F.when(F.col("phrase").isNull(), F.col("f"))), F.count("phrase")).first()

    def hashed(batches):
        for batch in batches:
            found = [Words(phrase, lang, 0).grams(1)[0] for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pydict({"h": pa.array([np.concatenate([np.zeros(0, _U), *found]).tobytes()], pa.binary())})

    sent = []

    def send(survivors, n):
        sent.append(spark.sparkContext.broadcast(_bitmap(survivors, n, filter_bits)))
        return sent[-1]

    def summarised(ks, words, pairs):
        parts = 1 << max(3, ceil(log2((mass or 0) * len(ks) / part_mass + 1)))
        found = stage(_survivors(_summaries(docs, ks, words, pairs, parts), threshold), "survivors")
        return send(found.select("h"), found.agg(F.sum("n")).first()[0] or 0)

    word_bits = send(words.select("lang", "phrase").mapInArrow(hashed, "h binary"), distinct)
    pairs = summarised((2,), word_bits, None)
    longer = summarised(tuple(range(3, most + 1)), word_bits, pairs)
    phrases = _phrase_counts(docs, most, pairs, longer).where(F.col("f") >= threshold)
    size = F.size(F.split("phrase", " "))
    both = words.unionByName(phrases).select("lang", F.col("phrase").cast("string").alias("phrase"), "f")
    out = stage(both.withColumn("words", size), "phrases")
    for b in sent:
        b.unpersist()
    return out, totals


def collocations(
    docs: DataFrame, most: int = 5, threshold: int = 100, top: int = 2000, scale: int = 1000, lang_col: str = "lang", text_col: str = "text",
    filter_bits: int = FILTER_BITS, part_mass: int = PART_MASS,
) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score of each language's ``top`` phrases.

    A-Z are lower-cased; texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words at spaces and tabs. n
    counts the words of a language, a the occurrences of a phrase of 2 to ``most`` words within pieces, overlaps
    included; phrases of at least ``threshold`` are candidates. A cut after the first k words has the score
    floor(scale * a * n / (l * r)), l and r the counts of its two sides; the lowest counts, ties to the smallest k.
    Candidates whose words lie inside a longer candidate that is as frequent are dropped. Order: score and a falling, then
    the phrase by bytes.

    A null language is ``und``, a null text empty. Every row counts, also one that repeats another or has no id. Long
    texts are read in slices that overlap; empty tables give no rows. Arithmetic is exact for a below 10**15 and n
    below 10**17 and an error beyond.
    """
    found, totals = frequent_phrases(docs, most, threshold, lang_col, text_col, filter_bits, part_mass)
    candidates = found.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    part = lambda a, b: F.array_join(F.slice("p", a, b), " ")
    words = candidates.withColumn("p", F.split("phrase", " "))
    # a candidate that is as frequent as one around it always stands in it, so it goes
    within = F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(p, i, k), ' '))))")
    around = words.where("words >= 3").select("lang", F.explode(within).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(around, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    cuts = kept.withColumn("p", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    left = found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    score = F.expr(f"(cast(a as decimal(15, 0)) * cast({scale} as decimal(4, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    best = scored.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
