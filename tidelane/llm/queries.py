"""The registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ball_tree import top_k
from .common import documents
from .cosine_links import near_duplicates
from .exact_dedup import exact_groups
from .line_dedup import line_dedup
from .packing import best_fit_pack
from .phrases import collocations
from .quality import quality_scores
from .sentencepiece_scan import sentencepiece_decode, sentencepiece_encode
from .simhash import simhash_groups
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity_scores
from .whitening import whiten


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sha256(text) -> F.Column:
    return F.sha2(F.col(text).cast("binary"), 256)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", sha256("kept").alias("kept_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text they decode to, as digests."""
    path = tokenizer_file("piece_bpe_32k.model")
    encoded = sentencepiece_encode(documents(spark, sf_dir), path)
    encoded = encoded.withColumns({"n_ids": F.size("ids").cast("long"), "ids_xxh64": F.xxhash64("ids")})
    out = sentencepiece_decode(encoded, path, keep=("n_ids", "ids_xxh64"))
    return out.select("doc_id", "n_ids", "ids_xxh64", sha256("text").alias("decoded_sha256"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", sha256("kept").alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", sha256("text").alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_sentencepiece, op3_suffix_array_dedup, op4_best_fit_packing, op5_simhash_near_dedup, op6_line_dedup, op7_exact_dedup, op8_toxicity, op9_quality_classifier, op10_exact_top_k, op11_embedding_near_dedup, op12_embedding_whitening, op13_phrase_collocations)
}

ORACLE_SQL: dict[str, str] = {
    "op10_exact_top_k": """
        WITH x AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
            FROM x q JOIN x c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 5""",
    "op11_embedding_near_dedup": """
        WITH RECURSIVE x AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL),
        fit AS (
            SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS length FROM x
            WHERE v IS NOT NULL AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0
              AND len(list_filter(v, lambda c: c <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_dot_product(a.v, b.v) / (a.length * b.length) >= 0.9),
        reached AS (SELECT vec_id, vec_id AS other FROM x UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other),
        least AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
        degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM x JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)""",
    "op6_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos
            FROM documents WHERE doc_id IS NOT NULL),
        keyed AS (
            SELECT doc_id, pos, line,
                   trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
        frequent AS (
            SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN frequent f USING (key) GROUP BY doc_id""",
    "op7_exact_dedup": """
        WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY text)""",
    "op13_phrase_collocations": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9), 'abcdefghijklmnopqrstuvwxyz ') AS text FROM documents),
        pieces AS (
            SELECT lang, list_filter(string_split(piece, ' '), lambda w: w <> '') AS w
            FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang HAVING sum(len(w)) > 0),
        grams AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
        f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 100),
        inside AS (
            SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer
            FROM (SELECT lang, string_split(phrase, ' ') AS w, k, f FROM f WHERE k > 2),
                 (SELECT unnest(range(2, 5)) AS m), (SELECT unnest(range(1, 5)) AS i)
            WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
        cuts AS (
            SELECT c.lang, c.phrase, c.f AS a, total.n, x.j, l.f AS l, r.f AS r,
                   CAST(CAST(1000 AS HUGEINT) * c.f * total.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
            FROM f c JOIN (SELECT unnest(range(1, 5)) AS j) x ON x.j < c.k JOIN total USING (lang)
            LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
            JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1:x.j], ' ')
            JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[x.j + 1:c.k], ' ')
            WHERE i.longer IS NULL OR i.longer < c.f),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
        FROM best QUALIFY rank <= 2000""",
}
