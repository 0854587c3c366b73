"""Tokenizing, packing, classifiers, search and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.llm import ball_tree, packing, quality, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("etaoinshrdlué", k=r.randint(1, 9))) for _ in range(n))


# --- packing --------------------------------------------------------------------------------------------------


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    encode = packing.byte_bpe(BYTES)
    for text in (words(5, 80), "a  b\n\n c\t", "É ñ 漢 🙂", "<|endoftext|>", "x" * 500, "It's 1234, don't!"):
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    rows = [(i, words(i, random.Random(i).choice([1, 5, 60, 200, 900]))) for i in range(60)] + [(100, None), (101, ""), (102, words(7, 3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = packing.best_fit_pack(df, BYTES).collect()
    encode = packing.byte_bpe(BYTES)
    ids = {d: encode(t or "") + [2] for d, t in rows}
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == sorted(ids)
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(pieces):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            assert r.length == 1024 or k == 0
            at += r.length
        assert at == len(ids[d])
    for rows_ in by_sequence.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    gaps: list[int] = []
    for n in sorted((r.length for r in out), reverse=True):
        k = min((i for i, g in enumerate(gaps) if g >= n), key=lambda i: gaps[i], default=None)
        if k is None:
            gaps.append(1024 - n)
        else:
            gaps[k] -= n
    assert len(by_sequence) == len(gaps)


def tightest(sizes, limit):
    gaps: list[int] = []
    for s in sizes:
        k = min((i for i, g in enumerate(gaps) if g >= s), key=lambda i: gaps[i], default=None)
        if k is None:
            gaps.append(limit - s)
        else:
            gaps[k] -= s
    return gaps


def check_places(rows, limit):
    """(sequence, offset, length): every sequence is filled from 0 on without a gap. Returns what each has left."""
    fill: dict[int, list[tuple[int, int]]] = {}
    for sequence, offset, length in rows:
        fill.setdefault(sequence, []).append((offset, length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return {k: limit - sum(n for _, n in v) for k, v in fill.items()}


@pytest.mark.parametrize("seed", range(4))
def test_sweep_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    limit = 50
    sizes = np.array(sorted((r.randint(1, limit) for _ in range(r.randint(1, 400))), reverse=True))
    to, offset, left = packing.sweep(sizes, np.zeros(0, np.int64), limit, True)
    assert sorted(left) == sorted(tightest(sizes.tolist(), limit))
    assert check_places(zip(to.tolist(), offset.tolist(), sizes.tolist()), limit) == dict(enumerate(left))
    # into given gaps, without new sequences: a piece is left only when no gap holds it
    gaps = np.sort(np.array([r.randint(1, limit) for _ in range(30)]))
    to, offset, left = packing.sweep(sizes, gaps, limit, False)
    brute, placed = gaps.tolist(), []
    for s in sizes.tolist():
        k = min((i for i, g in enumerate(brute) if g >= s), key=lambda i: brute[i], default=None)
        placed.append(k is not None)
        if k is not None:
            brute[k] -= s
    assert (to >= 0).tolist() == placed and sorted(left) == sorted(brute)
    assert all(gaps[t] >= s and o >= limit - gaps[t] for t, s, o in zip(to, sizes, offset) if t >= 0)


def test_match_ranges():
    # range 0 keeps 3 gaps of 10 or more; range 1 wants 5 pieces of at most 5, keeps 1 gap of 4; range 2 wants 4 of 4
    found = [(0, 0, 3, 10, 12), (1, 1, 5, 3, 5), (1, 0, 1, 4, 4), (2, 1, 4, 2, 4)]
    assert packing.match_ranges(found) == [(1, 0, 5, 0, 0, 2), (2, 0, 1, 1, 0, 1)]
    assert packing.match_ranges([(0, 1, 2, 5, 5), (0, 0, 9, 4, 4)]) == []  # gaps of the same range hold none of its pieces


@pytest.mark.parametrize("case", ["mixed", "tiny beside large", "one length", "no small"])
def test_packing_over_many_ranges(spark, case):
    r = random.Random(7)
    sizes = {
        "mixed": [r.randint(1, 100) for _ in range(1500)],
        "tiny beside large": [52] * 200 + [3] * 2000,
        "one length": [30] * 700,
        "no small": [r.randint(40, 100) for _ in range(300)],
    }[case]
    df = spark.createDataFrame([(i % 7, n, "x") for i, n in enumerate(sizes)], "doc_id long, length long, row string").repartition(3)
    out = packing.pack(df, 100, rows_per_range=150).collect()
    assert sorted(r.length for r in out) == sorted(sizes) and set(out[0].asDict()) == {"doc_id", "length", "row", "sequence_id", "offset"}
    gaps = check_places([(r.sequence_id, r.offset, r.length) for r in out], 100)
    best = len(tightest(sorted(sizes, reverse=True), 100))
    assert best <= len(gaps) + 1 and len(gaps) <= best * 1.02 + 3
    one = packing.pack(df, 100).collect()
    assert len({r.sequence_id for r in one}) == best


def test_empty_packing(spark):
    assert packing.best_fit_pack(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0


# --- classifiers ----------------------------------------------------------------------------------------------


def labelled(spark, n=400, seed=3):
    r = random.Random(seed)
    rude, rows, labels = ["grobian", "schuft", "lowlife"], [], []
    for i in range(n):
        w = words(seed * 1000 + i, r.randint(3, 120)).split()
        toxic, junk = r.random() < 0.25, r.random() < 0.3
        for _ in range(r.randint(1, 3) if toxic else 0):
            w.insert(r.randrange(len(w) + 1), r.choice(rude))
        rows.append((i, " ".join(x + "%%%" for x in w) if junk else " ".join(w), "en", 1.0))
        labels.append((i, int(not junk), int(toxic), "x"))
    rows += [(1000, None, None, None), (1001, "", None, None), (None, "grobian", None, None), (1002, "wort " * 60000, None, None), rows[0]]
    labels += [(1000, None, None, None), (None, 1, 1, None), (5000, 1, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def held_out_accuracy(out, labels, name):
    truth = {r.doc_id: r[name] for r in labels.collect() if r[name] is not None}
    rows = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(rows) > 50
    return np.mean([r.predicted == truth[r.doc_id] for r in rows])


def test_toxicity(spark):
    docs, labels = labelled(spark)
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert len(out) == docs.count() - 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert held_out_accuracy(out, labels, "toxic") > 0.95
    assert all(r.predicted == 0 for r in out if r.doc_id >= 1000)
    assert any(r.evidence for r in out if r.predicted)


def test_nearest_is_exact():
    r = np.random.default_rng(2)
    terms, n = np.arange(30, dtype=np.uint64), 500
    ix = toxicity.Index(terms, np.ones(30), ids=np.arange(n) * 7 % 1001, y=np.zeros(n), weight=np.ones(n))
    dense = np.where(r.random((30, n)) < 0.15, r.random((30, n)), 0)
    dense[:, 100:140] = dense[:, 99:100]  # ties
    ix.post(*np.nonzero(dense), dense[np.nonzero(dense)])
    for _ in range(50):
        term = np.sort(r.choice(30, 4, replace=False))
        q = r.random(4)
        rows, cosines = ix.nearest(term, q, 15)
        s = q @ dense[term, :n]
        best = np.lexsort((ix.ids, -s))[:15]
        assert [int(x) for x in rows] == [int(x) for x in best if s[x] > 0] and np.allclose(cosines, s[best][s[best] > 0])


def test_index_gives_exact_cosines():
    """The index built from texts against cosines of plain dictionaries, each text as a query."""
    import math

    import pyarrow as pa

    r = random.Random(9)
    vocabulary = [words(k, 1) for k in range(60)]
    column = pa.array([" ".join(r.choices(vocabulary, k=r.randint(0, 12))) for _ in range(300)] + ["", None])
    y = np.array([i % 2 for i in range(302)])
    grams = [{} for _ in range(302)]
    for doc, text in zip(grams, column.to_pylist()):
        for w in (text or "").split():
            padded = (" " + w + " ").encode()
            for i in range(len(padded) - 4):
                g = int.from_bytes(padded[i : i + 5], "big")
                doc[g] = doc.get(g, 0) + 1
    terms = np.array(sorted({g for d in grams for g in d if g % 3}), np.uint64)
    idf = {int(t): 1 + (i % 7) / 3 for i, t in enumerate(terms)}
    table = pa.table({"doc_id": [(i * 37) % 1000 for i in range(302)], "label": y, "text": column})
    ix = toxicity.build_index(table, {0: 151, 1: 151}, terms, np.array(list(idf.values())))
    vec = [{g: (1 + math.log(c)) * idf[g] for g, c in d.items() if g in idf} for d in grams]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vec]
    ids = table["doc_id"].to_pylist()
    seen = 0
    for _, doc, term, n in toxicity.term_counts(column, terms):
        for d in np.unique(doc):
            q = vec[d]
            near, cosines = ix.nearest(term[doc == d], ix.vector(term[doc == d], n[doc == d]), 10)
            full = sorted(((round(-sum(x * v.get(g, 0) for g, x in q.items()) / norm[d] / m, 9), i) for v, m, i in zip(vec, norm, ids) if m and any(g in v for g in q)))[:10]
            assert [round(-c, 9) for c in cosines] == pytest.approx([s for s, _ in full], abs=1e-8)
            assert len({int(ix.ids[i]) for i in near} & {i for _, i in full}) >= len(full) - sum(abs(s - full[-1][0]) < 1e-8 for s, _ in full)
            seen += 1
    assert seen > 250


def test_scores_do_not_depend_on_the_neighbouring_row():
    import pyarrow as pa

    model = quality.train(pa.array(["good text here", "bad bad bad"] * 10), np.array([1, 0] * 10), {0: 10, 1: 10})
    apart = [model.scores(pa.array([t], pa.string()))[0] for t in ("word", "word", "other", None, "other word")]
    assert np.allclose(model.scores(pa.array(["word", "word", "other", None, "other word"])), apart)


def test_quality(spark):
    docs, labels = labelled(spark)
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == docs.count() - 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert held_out_accuracy(out, labels, "quality") > 0.95


@pytest.mark.parametrize("operator", [toxicity.toxicity_scores, quality.quality_scores])
def test_no_labels_and_no_documents(spark, operator):
    docs, labels = labelled(spark, 20)
    assert {round(r.score, 9) for r in operator(docs, labels.limit(0)).collect()} == {0.5}
    assert operator(docs.limit(0), labels).count() == 0


# --- search ---------------------------------------------------------------------------------------------------


def test_top_k(spark):
    r = np.random.default_rng(4)
    x = r.normal(0, 0.1, (700, 16))
    x[200:230] = x[199]
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)] + [(700, None), (750, [None] * 16), (800, [float("nan")] * 16), (850, [float("inf")] + [0.0] * 15), (None, [0.0] * 16), (900, [0.5, 0.5]), (902, [0.1, -0.5]), (950, []), (951, []), (949, [])]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    out = ball_tree.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=90, block_rows=1).collect()
    v = np.floor(256 * x).astype(np.int64)
    got: dict[int, list] = {}
    for q in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(q.query_id, []).append((q["rank"], q.vec_id, q.score))
    for q in range(0, 700, 50):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:5]
        assert got[q] == [(k + 1, int(i), int(s[i])) for k, i in enumerate(order)]
    assert got[900] == [(1, 902, int(np.floor(12.8 * 2) * 128 + 128 * -128))] and set(got) == {*range(0, 700, 50), 900, 950}
    assert got[950] == [(1, 949, 0), (2, 951, 0)]


def test_top_k_of_large_components(spark):
    """Scores beyond the exact range of floating point, and beyond a long; many lengths at once."""
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.integers(-4, 5, 3) * 2.0**22 + r.integers(0, 3, 3)]) for i in range(120)]
    rows += [(200 + i, [1e18 * (i % 7 - 3), 1.0]) for i in range(60)] + [(400 + 10 * d + j, [float(j + 1)] * d) for d in range(4, 24) for j in range(3)]
    out = ball_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 10 == 0, shard_rows=20, block_rows=1).collect()
    got: dict[int, list] = {}
    for q in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(q.query_id, []).append((q.vec_id, q.score))
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    clamp = lambda s: min(max(s, ball_tree.LOWEST), ball_tree.HIGHEST)
    for q in (i for i in ints if i % 10 == 0):
        full = [(i, clamp(sum(a * b for a, b in zip(v, ints[q])))) for i, v in ints.items() if i != q and len(v) == len(ints[q])]
        assert got.get(q, []) == sorted(full, key=lambda x: (-x[1], x[0]))[:5], q


def test_an_id_with_two_vectors(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (51, [3.0, 0.0]), (52, [0.0, 2.0]), (52, [1.0, 0.0])]
    out = ball_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50, k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score // 65536) for r in out] == [(51, 3), (52, 2), (52, 1)]


def test_search_of_nothing(spark):
    assert ball_tree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_bounds_hold():
    r = np.random.default_rng(5)
    x = np.floor(r.normal(0, 40, (300, 8)))
    order, nodes, centres, radii = ball_tree.build_tree(x, 16)
    assert sorted(order) == list(range(300))
    q = r.normal(0, 40, 8)
    for (a, b, _), c, rad in zip(nodes, centres, radii):
        assert (x[order[a:b]] @ q).max() <= c @ q + np.sqrt(q @ q) * rad + 1e-6


# --- pipeline -------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = labelled(spark, 200, 6)
    passage = words(77, 60)
    more = [(2000, words(80, 30) + " " + passage, "en", 0.0), (2001, words(81, 30) + " " + passage, "en", 0.0), (2002, words(82, 300), "en", 0.0), (2003, words(82, 300), "en", 0.0)]
    docs = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(more, docs.schema)).withColumn("n_chars", F.length("text").cast("long")).withColumn("component_id", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    held = [{r.doc_id: r for r in frame.collect()}]
    for name, step in pipeline.STAGES[:-1]:
        out = step(spark, frame, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}.parquet")
        frame = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}.parquet")
        held.append({r.doc_id: r for r in frame.collect()})
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    start, clean, exact, near, cut = held
    gone = set(start) - set(clean)
    assert gone and np.mean([truth.get(d) == 1 for d in gone]) > 0.95
    assert set(clean) - set(exact) == {d for d, r in clean.items() if any((o.text or "") == (r.text or "") and o.doc_id > d for o in clean.values())}
    assert 2003 in exact and 2002 not in exact
    assert set(near) <= set(exact) and all(near[d].text == exact[d].text for d in near)
    assert set(cut) == set(near) and cut[2000].text == near[2000].text
    assert passage not in cut[2001].text and cut[2001].n_chars == len(cut[2001].text)
    packed = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(cut)
    assert pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
