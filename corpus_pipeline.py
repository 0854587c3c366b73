"""Corpus pipeline: toxicity, exact duplicates, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), judges all of what the one before it kept, and returns a DataFrame that
is written as Parquet and read back as the next stage's documents. All but the last return the columns of
``documents`` (and any further columns that came in, whatever their names), with every surviving row whole.

Rows without a doc_id are no documents and leave with the first stage. Null texts count as empty: no stage rejects
a text for being empty, but all empty texts are equal to each other. Rows that repeat an id: the first stage judges
each by its own text; the exact stage leaves one row for each text of an id; the near-duplicate stage leaves one
row for each id. The later stages judge each row they get, and give one row for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.common import stage
from tidelane.llm.exact_dedup import exact_groups
from tidelane.llm.packing import best_fit_pack
from tidelane.llm.queries import tokenizer_file
from tidelane.llm.simhash import simhash_groups
from tidelane.llm.substring_dedup import substring_dedup
from tidelane.llm.toxicity import toxicity_scores


def _digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def _row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity operator does not call toxic; they pass through it, so nothing is joined."""
    scores = toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), row=True)
    return scores.where("predicted = 0").select("row.*")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id, and of rows that repeat id and text one: that whose other
    columns hash lowest."""
    kept = exact_groups(docs).where("kept").select("doc_id", F.col("text_sha256").alias("digest"))
    rest = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])))
    one = docs.where("doc_id is not null").groupBy(F.col("doc_id"), _digest().alias("digest")).agg(F.min_by(_row(docs), rest).alias("row"))
    return one.join(kept, ["doc_id", "digest"], "left_semi").select("row.*")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; of several texts of it the one with the
    smallest digest."""
    kept = simhash_groups(docs).where("component_id = doc_id").select("doc_id").distinct()
    rows = docs.select("doc_id", _digest().alias("digest"), _row(docs).alias("row")).join(kept, "doc_id", "left_semi")
    return rows.groupBy("doc_id").agg(F.min_by("row", "digest").alias("row")).select("row.*")


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents with smaller ids hold; n_chars follows the text.

    A text that loses nothing stays as it is, white space included.
    """
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept"), "n_chars": F.length("kept")}
    own = lambda c: F.col("row").getField(c)
    columns = [F.when(changed, new[c].cast(docs.schema[c].dataType)).otherwise(own(c)) if c in new else own(c) for c in docs.columns]
    return substring_dedup(docs, row=True).select(*[x.alias(c) for x, c in zip(columns, docs.columns)])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024."""
    return best_fit_pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("simhash near-dedup", drop_near),
    ("substring dedup", drop_passages),
    ("best-fit packing", pack),
]

#: Classifier scores, fingerprints and tokenizers are beyond SQL; tests/llm compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
