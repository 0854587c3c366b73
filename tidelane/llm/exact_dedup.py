"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size. The distinct blocks, sorted, are given integer names; then adjacent
names are paired, the distinct pairs are sorted and named again, and so on until one name is left for each
document. Two documents of one length have the same last name if and only if their texts are equal: names
stand for contents, never for hashes, so there are no collisions.

Names come from a sampled range partitioning and a sort inside each range (the position in the sorted order is
the name), so no task holds more than its range, and each round is written to the shared folder before use.
A document whose (length, 64-bit hash) no other document has cannot equal any other; it is its own group and
stays out of the naming. That keeps the blocks that move to those of likely copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, texts

BLOCK_BYTES = 8192


def _named(parts: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Distinct ``keys`` with ``name``: their place in a range-partitioned sort by (hash, content). The hash comes
    first so that the splitters, which the driver samples, are numbers and not blocks."""
    distinct = parts.select(*keys).distinct().withColumn("_h", F.xxhash64(*keys))
    ranged = distinct.repartitionByRange("_h").sortWithinPartitions("_h", *keys)
    return stage(ranged.drop("_h").withColumn("name", F.monotonically_increasing_id()), label)


def _gathered(rows: DataFrame) -> DataFrame:
    """Names of each document in order, as an array (as long as the document has blocks)."""
    pairs = F.array_sort(F.collect_list(F.struct("idx", "name")))
    return rows.groupBy("doc_id", "n_bytes", "h").agg(F.transform(pairs, lambda p: p["name"]).alias("names"))


def block_names(candidates: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, h, text) -> (doc_id, n_bytes, h, name): equal texts, and only they, share n_bytes and name."""
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / block_bytes)).cast("int")
    blocks = (
        candidates.withColumn("idx", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        .withColumn("block", F.substring(F.col("text").cast("binary"), F.col("idx") * block_bytes + 1, F.lit(block_bytes)))
        .select("doc_id", "n_bytes", "h", "idx", "block")
    )
    blocks = stage(blocks, "blocks")
    named = blocks.join(_named(blocks, ["block"], "block-names"), "block").drop("block")
    level = stage(_gathered(named), "names-0")
    done = [level.where("size(names) = 1")]
    longest = level.agg(F.max(F.size("names"))).first()[0] or 0
    k = 0
    while longest > 1:
        k, longest = k + 1, (longest + 1) // 2
        half = F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int"))
        pairs = (
            level.where("size(names) > 1")
            .select("doc_id", "n_bytes", "h", "names", F.explode(half).alias("idx"))
            .select(
                "doc_id", "n_bytes", "h", "idx",
                F.get("names", F.col("idx") * 2).alias("left"),
                F.coalesce(F.get("names", F.col("idx") * 2 + 1), F.lit(-1)).alias("right"),
            )
        )
        named = pairs.join(_named(pairs, ["left", "right"], f"pair-names-{k}"), ["left", "right"])
        level = stage(_gathered(named), f"names-{k}")
        done.append(level.where("size(names) = 1"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "n_bytes", "h", F.get("names", F.lit(0)).alias("name"))


def exact_groups(docs: DataFrame, keep: str = "max", block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest (``keep="max"``) or smallest id stays. Null texts equal the empty
    text. Identical repeated rows are one document; an id that carries several texts is one document for each.
    An empty table gives no rows; rows with a null id take no part.
    """
    texts_ = texts(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text")).withColumn("h", F.xxhash64("text"))
    prints = stage(texts_.select("doc_id", "n_bytes", "h", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")).distinct(), "prints")
    shared = prints.groupBy("n_bytes", "h").count().where("count > 1").drop("count")
    likely = prints.join(shared, ["n_bytes", "h"], "left_semi").select("doc_id", "n_bytes", "h")
    candidates = texts_.join(likely, ["doc_id", "n_bytes", "h"], "left_semi").select("doc_id", "n_bytes", "h", "text").dropDuplicates(["doc_id", "n_bytes", "h"])
    names = stage(block_names(candidates, block_bytes), "identities")
    best = F.max("doc_id") if keep == "max" else F.min("doc_id")
    groups = names.groupBy("n_bytes", "name").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    members = names.join(groups, ["n_bytes", "name"]).select("doc_id", "n_bytes", "h", "keep_id", "group_size")
    return (
        prints.join(members, ["doc_id", "n_bytes", "h"], "left")
        .withColumn("keep_id", F.coalesce("keep_id", "doc_id"))
        .select("doc_id", "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("keep_id") == F.col("doc_id")).alias("kept"), "text_sha256")
    )
