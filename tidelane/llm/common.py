"""What the corpus operators share: intermediate tables, text handling and paths.

Conventions of every operator in this subpackage:

* a row whose id is null takes no part (results are keyed by the id);
* a null text counts as the empty text unless the operator says otherwise;
* rows that repeat an id are each judged by the same rule, so identical rows get identical results;
* columns beyond those named in a call are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage  # noqa: F401 - intermediate tables, for all operators

#: The characters of ``[\x20\x09-\x0D]``; ``bytes.split()`` splits on the same six.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the session was made."""
    env = spark.sparkContext.environment
    if _REPO not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [_REPO, env.get("PYTHONPATH", "")]))


def several_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> bool:
    """Whether any id has several texts."""
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    found = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b")
    return not found.isEmpty()


def told_apart(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: bool = False, apart: bool = True) -> DataFrame:
    """(doc_id, v, text): as ``texts``, where v, a hash of the text, tells several texts of one id apart; it may be 0
    throughout (``apart`` false) where no id has several. With ``row``, (doc_id, v, row) instead: row is a struct of
    all columns of the input, the text as it is among them."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    what = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if row else text.alias("text")
    v = F.xxhash64(text) if apart else F.lit(0).cast("long")
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), v.alias("v"), what)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): ids not null, null texts empty."""
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
