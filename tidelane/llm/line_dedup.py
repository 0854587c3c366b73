"""Lines that many documents share, found and dropped with DataFrame operations only.

A line's key is the line with the six ASCII spaces stripped at both ends and A-Z lower-cased. Keys travel as two
64-bit hashes. Occurrences are pre-aggregated before any shuffle, the partial counts are range-partitioned by
hash and sorted by (hash, first document, position), and each range is folded in order into the document count
and first occurrence of its keys. Documents get back a sparse bitmap (64-line word -> dropped lines), not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACES, UPPER, stage, told_apart

MIN_DOCS, MIN_CHARS = 10, 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, v, pos, h1, h2): the keyed lines of each document."""
    folded = F.transform(_lines(F.translate("text", UPPER, LOWER)), lambda x: F.btrim(x, F.lit(SPACES)))
    return (
        docs.select("doc_id", "v", F.posexplode(folded).alias("pos", "key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "v", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )


def line_keys(occ: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, first): in how many documents each key stands, and its first (document, position).

    The first aggregation keeps one row of a key and document; the second folds documents into shards, so that a
    key found everywhere arrives at its range as a handful of rows. Ranges are sorted by hash, document and position,
    and the first row of each key is taken as they stream by.
    """
    per_doc = occ.groupBy("doc_id", "h1", "h2").agg(F.min("pos").alias("pos"))
    shards = per_doc.groupBy("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(8)).alias("shard")).agg(
        F.count("*").alias("n"), F.min("doc_id").alias("doc"), F.min_by("pos", "doc_id").alias("pos")
    )
    ranged = shards.drop("shard").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc", "pos")
    same = Window.partitionBy("h1", "h2")
    streamed = ranged.withColumns({"n_docs": F.sum("n").over(same), "at": F.row_number().over(same.orderBy("doc", "pos"))})
    return streamed.where("at = 1").select("h1", "h2", "n_docs", F.col("doc").alias("first_doc"), F.col("pos").alias("first_pos"))


def dropped_bitmaps(occ: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """(doc_id, v, dropped map<int, long>): bit p % 64 of word p / 64 is set where line p goes; missing words keep all.

    ``keep_first`` leaves the first occurrence of a key (smallest document, then position) in place.
    """
    frequent = line_keys(occ).where(F.col("n_docs") >= min_docs)
    hits = occ.join(frequent, ["h1", "h2"])
    if keep_first:
        hits = hits.where((F.col("doc_id") != F.col("first_doc")) | (F.col("pos") != F.col("first_pos")))
    word, bit = F.shiftright("pos", 6), F.expr("shiftleft(1L, pos & 63)")
    words = hits.groupBy("doc_id", "v", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "v").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def line_dedup(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, dropped): text holds the lines that stay, joined by \\n.

    A null or empty text is one empty line, which has no key and stays. A document can lose all its lines; its
    text is then empty. Rows that repeat an id count as one document and get one row each; several texts of an id
    each lose their own lines.
    """
    rows = told_apart(docs, id_col, text_col)
    bitmaps = dropped_bitmaps(stage(occurrences(rows, min_chars), "lines"), min_docs, keep_first)
    lines = _lines(F.col("text"))
    word = lambda i: F.coalesce(F.try_element_at("dropped", F.shiftright(i, 6)), F.lit(0).cast("long"))
    stays = F.filter(lines, lambda _, i: F.call_function("getbit", word(i), i.bitwiseAND(F.lit(63))) == 0)
    kept = F.when(F.col("dropped").isNull(), lines).otherwise(stays)
    return (
        rows.join(bitmaps, ["doc_id", "v"], "left")
        .select("doc_id", kept.alias("kept"), F.size(lines).alias("n_lines"), "dropped")
        .select("doc_id", F.array_join("kept", "\n").alias("text"), F.col("n_lines").cast("long"), (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), "dropped")
    )
