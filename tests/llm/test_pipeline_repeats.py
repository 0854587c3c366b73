"""Pipeline stages against brute force: repeated ids, several texts of one, nulls, a text of megabytes, clashing names."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelane.llm import packing, simhash, toxicity

from test_dedup import brute_words

#: Names that the stages or their operators use inside.
INSIDE = ["row", "_row", "v", "hits", "key", "digest", "kept", "_kept", "n_removed", "n_words", "fp", "rep", "component_id", "h", "n_bytes", "score", "predicted", "evidence", "held_out", "label"]


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(1, 9))) for _ in range(n))


def documents():
    """(doc_id, text): several kinds of repeat."""
    passage, near = words(1, 60), words(5, 400).split()
    rows = [(1, words(2, 30) + " " + passage), (5, words(3, 30) + " " + passage), (7, words(4, 40)), (9, words(4, 40)), (None, "x"), (11, None), (12, "")]
    rows += [(20 + i, " ".join([*near[: 40 * i], "zz", *near[40 * i :]])) for i in range(9)]
    rows += [(40, "one text"), (40, "another"), (41, "another"), (42, "grobian " * 9 + words(6, 20)), (42, words(7, 20)), (43, words(8, 300000)), (44, words(9, 70) + " " + " ".join(near[:90]))]
    rows += [(100 + i, words(100 + i, 50) + (" schuft grobian" if i % 2 else "")) for i in range(200)]
    return rows + [rows[1]] * 4 + [rows[3]] * 2 + [rows[5]]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    pipeline = pytest.importorskip("corpus_pipeline")
    at = tmp_path_factory.mktemp("pipeline")
    rows = [(d, t, len(t or ""), *[f"{k % 3}"] * len(INSIDE)) for k, (d, t) in enumerate(documents())]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in INSIDE)).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    frames = [spark.read.parquet(f"{at}/documents.parquet")]
    for k, (name, step) in enumerate(pipeline.STAGES):
        out = step(spark, frames[-1], str(at))
        assert out.columns == frames[0].columns or k == len(pipeline.STAGES) - 1, name
        out.write.parquet(f"{at}/stage{k}.parquet")
        frames.append(spark.read.parquet(f"{at}/stage{k}.parquet"))
    return frames, str(at)


def rows_of(frame):
    return frame.select("doc_id", "text").rdd.map(tuple).collect()


def test_toxic_rows_go(spark, stages):
    (before, after, *_), at = stages
    scores = toxicity.toxicity_scores(before, spark.read.parquet(f"{at}/labels.parquet"), row=True).collect()
    assert sorted(map(str, rows_of(after))) == sorted(str((r.doc_id, r.row.text)) for r in scores if not r.predicted)
    toxic = lambda t: "grobian" in (t or "")
    assert Counter(rows_of(after)) == Counter((d, t) for d, t in rows_of(before) if d is not None and not toxic(t))


def test_of_equal_texts_one_row_stays(stages):
    (_, before, after, *_), _ = stages
    last: dict[str, int] = {}
    for d, t in rows_of(before):
        last[t or ""] = max(d, last.get(t or "", d))
    assert Counter((d, t or "") for d, t in rows_of(after)) == Counter((d, t) for t, d in last.items())
    assert (40, "one text") in rows_of(after) and (40, "another") not in rows_of(after)


def test_of_near_texts_one_document_stays(stages):
    (_, _, before, after, *_), _ = stages
    rows = rows_of(before)
    fp = [simhash.fingerprint(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] == rows[j][0] or (fp[i] ^ fp[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    out = rows_of(after)
    assert sorted(d for d, _ in out) == sorted(least.values()) and set(out) <= set(rows)
    assert len(out) < len(rows)


def test_passages_go_and_every_row_stays(stages):
    (_, _, _, before, after, *_), _ = stages
    expected = brute_words(rows_of(before), 50)
    want = Counter((d, expected[d, t][2] if expected[d, t][1] else t) for d, t in rows_of(before))
    assert Counter(rows_of(after)) == want and any(x[1] for x in expected.values())
    assert after.where("n_chars <> length(coalesce(text, ''))").count() == 0
    assert after.select(*INSIDE).distinct().count() <= 3


def test_all_that_is_left_is_packed(stages):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    (*_, before, after), _ = stages
    encode = packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    n: dict[int, int] = {}
    for d, t in rows_of(before):
        n[d] = n.get(d, 0) + len(encode(t or "")) + 1
    out = after.collect()
    got: dict[int, int] = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == n
    gaps: list[int] = []
    for size in sorted((r.length for r in out), reverse=True):
        k = min((i for i, g in enumerate(gaps) if g >= size), key=lambda i: gaps[i], default=None)
        if k is None:
            gaps.append(1024 - size)
        else:
            gaps[k] -= size
    assert len({r.sequence_id for r in out}) <= len(gaps)


def test_repeats_of_a_row_that_loses_a_passage_do_not_multiply(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = documents()
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows if d is not None], "doc_id long, text string, n_chars long")
    cut = pipeline.drop_passages(spark, docs, str(tmp_path)).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_chars").alias("c")).collect()
    assert {r.doc_id: r.n for r in cut} == Counter(d for d, _ in rows if d is not None)
    assert {r.doc_id: r.c for r in cut}[5] == len(words(3, 30))
