"""Embedding near-duplicates, whitening and phrase collocations against plain loops."""

from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.llm import cosine_links, phrases, whitening

# --- embedding near-duplicates ----------------------------------------------------------------------------------


def links_by_hand(rows, threshold):
    """{(id, vector): (links, smallest id reached)} over all pairs."""
    keys = sorted({(i, None if v is None else tuple(v)) for i, v in rows if i is not None}, key=str)
    fit = [k for k in keys if k[1] and None not in k[1] and np.isfinite(k[1]).all() and any(k[1])]

    def cosine(a, b):
        a, b = (np.array(x) / max(map(abs, x)) for x in (a, b))
        return a @ b / np.sqrt((a @ a) * (b @ b))

    near = {k: [o for o in fit if o != k and len(o[1]) == len(k[1]) and (o[1] == k[1] or cosine(k[1], o[1]) >= threshold)] for k in fit}
    out = {}
    for k in keys:
        seen, todo = {k}, [k]
        while todo:
            for o in near.get(todo.pop(), []):
                if o not in seen:
                    seen.add(o), todo.append(o)
        out[k] = (len(near.get(k, [])), min(i for i, _ in seen))
    return out


def vectors(seed=3, n=260, dim=12):
    r = np.random.default_rng(seed)
    base = r.standard_normal((12, dim))
    rows = [(i, [float(c) for c in base[i % 12] + r.standard_normal(dim) * (0.02 + 0.2 * r.random())]) for i in range(n)]
    rows += [(1000 + i, [float(c) for c in r.standard_normal(dim)]) for i in range(60)]
    rows += [(2000 + i, rows[0][1]) for i in range(70)] + [(5, rows[5][1]), (5, rows[6][1]), (-7, rows[3][1])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * dim), (3003, [1.0, None] + [0.0] * (dim - 2)), (3004, [float("nan")] * dim), (3005, [float("inf")] * dim), (None, rows[0][1])]
    rows += [(3006, [1e308] * dim), (3007, [1e-308] * dim), (3008, [1.0, 2.0]), (3009, [2.0, 4.0]), (3010, [-1.0, -2.0])]
    return rows


@pytest.mark.parametrize("tile_bytes", [1 << 20, 2000])
def test_links_are_those_of_all_pairs(spark, monkeypatch, tile_bytes):
    monkeypatch.setattr(cosine_links, "PARTNERS", 3)
    monkeypatch.setattr(cosine_links, "META_TILES", 4)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, v string, h1 int")
    found = cosine_links.near_duplicates(df, 0.9, tile_bytes=tile_bytes).collect()
    want = links_by_hand(rows, 0.9)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == sorted((k[0], n, c, k[0] == c) for k, (n, c) in want.items())


def test_nothing_is_shuffled_for_pairs_of_tiles(spark, monkeypatch):
    plans, stage = {}, cosine_links.stage
    monkeypatch.setattr(cosine_links, "stage", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), stage(df, name))[1])
    rows = [(i, v) for i, v in vectors(n=120) if i is not None]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert cosine_links.near_duplicates(df, 0.9, tile_bytes=2000).count() == len({(i, None if v is None else str(v)) for i, v in rows})
    assert "Exchange" not in plans["hits"] and "vectors" in plans["hits"]


def test_links_of_singles_and_of_vectors_with_one_hash(spark, monkeypatch):
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in vectors(5, 90) if not v or abs(v[0] or 0) < 1e38 and abs(v[0] or 1) > 1e-38]
    rows += [(4000, [0.0] + rows[0][1][1:]), (4001, [-0.0] + rows[0][1][1:]), (4001, [0.0] + rows[0][1][1:])]
    seeds, hashes = [], cosine_links._hashes
    same = lambda: [(F.size("v") * 0).cast("long").alias(f"h{k}") for k in (1, 2)]
    monkeypatch.setattr(cosine_links, "_hashes", lambda seed: (seeds.append(seed), same() if seed == 0 else hashes(seed))[1])
    found = cosine_links.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), 0.9, tile_bytes=2000).collect()
    want = links_by_hand([(i, None if v is None else [c if c is None else c + 0.0 for c in v]) for i, v in rows], 0.9)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == sorted((k[0], n, c, k[0] == c) for k, (n, c) in want.items())
    assert seeds == [0, 1]


def test_links_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cosine_links.near_duplicates(empty).collect() == []
    with pytest.raises(ValueError):
        cosine_links.near_duplicates(empty, 1.0)


def test_error_bound_holds_and_decides_most_pairs():
    r = np.random.default_rng(1)
    x = np.concatenate([r.standard_normal((300, 33)), np.eye(33), r.standard_normal((50, 33)) ** 9])
    a = cosine_links.Tile(1, 33, x.tobytes(), np.ones(len(x), "<i8").tobytes())
    u = x / np.sqrt((x * x).sum(1))[:, None]
    about = np.outer(a.scale, a.scale) * (a.codes.astype(np.float64) @ a.codes.T.astype(np.float64))
    bound = a.error[:, None] + (1 + a.error[:, None]) * a.error
    assert (np.abs(u @ u.T - about) <= bound + 1e-12).all() and np.abs(a.codes).max() <= 127
    for t in (0.3, 0.55, 0.9):
        got = {(int(p), int(q)) for i, j in cosine_links.linked(a, a, t) for p, q in zip(i, j)}
        p, q = np.nonzero(np.triu(u @ u.T >= t, 1))
        assert got == set(zip(p.tolist(), q.tolist()))


def test_products_of_many_dimensions_are_exact():
    r = np.random.default_rng(2)
    a = r.integers(-127, 128, (5, 2500)).astype(np.float32)
    assert (cosine_links._product(a, a) == a.astype(np.int64) @ a.T.astype(np.int64)).all()


# --- whitening ----------------------------------------------------------------------------------------------------


def whitened_by_hand(x, k):
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return y @ v / np.sqrt(e), e / np.trace(y.T @ y / n), ((n * x - s) ** 2).sum(1)


def test_whitening(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((150, 7)) @ r.standard_normal((7, 7))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, [1.0, None] + [0.0] * 5), (902, [float("nan")] * 7), (903, [float("-inf")] * 7), (None, [1.0] * 7), (904, []), (905, [1e300] * 7)]
    df = spark.createDataFrame([(*r, 0, "b") for r in rows + bad + rows[:1]], "vec_id long, embedding array<double>, n int, x string").repartition(3)
    out = whitening.whiten(df, 5, block_rows=16).toPandas().sort_values(["vec_id", "component"], kind="stable")
    whole = np.floor(64 * np.concatenate([x, x[:1]])).astype(np.int64) + 1_000_000
    w, e, dev = whitened_by_hand(whole, 5)
    assert len(out) == 151 * 5 and (out.n == 151).all() and (out.identity_error < 1e-10).all()
    got = out[out.vec_id > 0].whitened.to_numpy().reshape(-1, 5)
    assert np.allclose(got * np.sign((got * w[1:150]).sum(0)), w[1:150], atol=1e-9)
    assert np.allclose(out[out.vec_id == 1].explained, e, rtol=1e-10)
    assert out[(out.component == 1) & (out.vec_id > 0)].deviation.tolist() == dev[1:150].tolist()


def test_whitening_of_repeated_and_missing_variance(spark):
    # variances 4, 4, 1 and two dimensions that do not vary: equal eigenvalues need a second start, zero ones give no rows
    signs = [(a, b, c) for a in (-2, 2) for b in (-2, 2) for c in (-1, 1)]
    df = spark.createDataFrame([(i, [float(a), float(b), float(c), 3.0, 0.0]) for i, (a, b, c) in enumerate(signs)], "vec_id long, embedding array<float>")
    out = whitening.whiten(df).toPandas()
    assert sorted(out.component.unique()) == [1, 2, 3] and out.identity_error.max() < 1e-10
    assert np.allclose(sorted(out[out.vec_id == 0].explained), [1 / 9, 4 / 9, 4 / 9])
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.where("false")).count() == 0


def test_deviations_beyond_64_bits():
    centre = whitening.Centre(10**6, [1_000_000 * 10**6 + 1, 7 * 10**6])
    x = np.array([1_000_000, 7, 1_000_000 + 2**40, 7], np.int64)
    assert centre.deviation(x) == [1, None]
    assert np.allclose(centre(x), [[-1e-6, 0], [2**40, 0]])


# --- phrases ------------------------------------------------------------------------------------------------------


def phrases_by_hand(rows, threshold, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    frequent = {k: c for k, c in f.items() if c >= threshold}
    inside = {}
    for (lang, p), c in frequent.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside.get((lang, p[i : i + k]), 0), c)
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) > 1 and inside.get((lang, p), 0) < a:
            score, k = min((Fraction(1000 * a * n[lang], f[lang, p[:k]] * f[lang, p[k:]]).__floor__(), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, c in out.items() for i, x in enumerate(sorted(c)[:top]))


def texts(seed=5):
    r = random.Random(seed)
    vocabulary = ["new", "York", "NEW", "york", "é", "漢字", "a", "of", "the", "state", "x\x00y", " ", "Ä"]
    rows = []
    for i in range(60):
        text = "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r", " - "]) for _ in range(r.choice([1, 5, 40, 200])))
        rows.append((r.choice(["en", "en", "en", None, "und", "fr"]), text))
    rows += [("en", None), ("en", ""), ("fr", " \t "), (None, "..."), ("en", "the state of new york " * 400), ("de", "la " * 300 + "lang" * 500)]
    return rows + rows[:2]


@pytest.mark.parametrize("size", [7, 100, 1 << 20])
def test_phrases_are_those_of_a_plain_count(spark, monkeypatch, size):
    monkeypatch.setattr(phrases, "SLICE_BYTES", size)
    monkeypatch.setattr(phrases, "HELD", 50 if size < 1000 else 1 << 20)
    monkeypatch.setattr(phrases, "HELD_BYTES", 3000 if size < 1000 else 1 << 25)
    monkeypatch.setattr(phrases, "_powers", {})
    rows = texts()
    df = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, n int").repartition(3)
    out = phrases.collocations(df, threshold=12, top=40, part_mass=500 if size < 1000 else 1 << 23)
    assert sorted(tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == phrases_by_hand(rows, 12, 40)


def test_phrases_whatever_the_bitmap_lets_through(spark):
    rows = texts(6)
    df = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.collocations(df, threshold=20, filter_bits=1 << 9).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == phrases_by_hand(rows, 20, 2000) and len(got) > 5
    assert phrases.collocations(df.where("false")).collect() == []


def test_summaries_keep_all_that_is_frequent():
    r = np.random.default_rng(9)
    for trial in range(20):
        stream = np.concatenate([r.integers(0, 5000, 20000), np.repeat(r.integers(10**6, 10**6 + 9, 9), 300)]).astype(np.uint64)
        r.shuffle(stream)
        threshold = 250
        parts, mass = np.array_split(stream, 13), len(stream)
        summary = phrases.Summary(mass // threshold + 1)
        for p in parts:
            summary.add(*phrases.combine(p, np.ones(len(p), np.int64)))
        summary.settle()
        h, n = np.unique(stream, return_counts=True)
        true, held = dict(zip(h.tolist(), n.tolist())), dict(zip(summary.h.tolist(), summary.n.tolist()))
        assert len(held) <= summary.capacity and 0 < summary.lost < threshold
        assert all(k in held for k, c in true.items() if c >= threshold)
        assert all(c <= true[k] <= c + summary.lost for k, c in held.items())


# --- quality classifier: training and scoring by plain loops ------------------------------------------------------


def test_quality_model_is_that_of_plain_loops(monkeypatch):
    """Each document alone, feature by feature, in double precision, against batches, bags and the folded table."""
    import pyarrow as pa

    from tidelane.llm import quality
    from tidelane.llm.subwords import SPACED, slices

    monkeypatch.setattr(quality, "BUCKET_BITS", 10)
    r = random.Random(12)
    good, bad = ["river", "the", "of", "calm"], ["buy", "buy", "now", "!!!"]
    docs = [" ".join(r.choice(good if i % 2 else bad) for _ in range(r.randint(1, 12))) for i in range(40)] + ["", "é", "a a"]
    y = np.array([i % 2 for i in range(43)])
    model = quality.train(pa.array(docs), y, {0: 300, 1: 100}, epochs=2, rate=0.5, seed=3)

    def buckets(text):
        return [int(b) for sl in slices(pa.array([text]), SPACED) for _, found in quality.features(sl) for b in found]

    bags = [buckets(d) for d in docs]
    rng, dims = np.random.default_rng(3), quality.DIMENSIONS
    vectors = rng.uniform(-1 / dims, 1 / dims, (1 << 10, dims))
    heads, bias, done = [[0.0] * dims, [0.0] * dims], [0.0, 0.0], 0
    for _ in range(2):
        for i in rng.permutation(len(bags)):
            bag, lr = bags[i], 0.5 * (1 - done / (2 * len(bags)))
            done += 1
            hidden = [sum(vectors[b][d] for b in bag) / max(len(bag), 1) for d in range(dims)]
            logits = [sum(h * x for h, x in zip(heads[c], hidden)) + bias[c] for c in (0, 1)]
            e = [np.exp(x - max(logits)) for x in logits]
            error = [x / sum(e) - (c == y[i]) for c, x in enumerate(e)]
            back = [sum(error[c] * heads[c][d] for c in (0, 1)) for d in range(dims)]
            for c in (0, 1):
                heads[c] = [h - lr * error[c] * x for h, x in zip(heads[c], hidden)]
                bias[c] -= lr * error[c]
            for b, n in Counter(bag).items():
                for d in range(dims):
                    vectors[b][d] -= lr * len(set(bag)) ** 0.5 * n / len(bag) * back[d]
    prior = np.log(101 / 301) - np.log((y == 1).sum() / (y == 0).sum())
    odds = [sum(vectors[b] @ (np.array(heads[1]) - heads[0]) for b in bag) / max(len(bag), 1) + bias[1] - bias[0] + prior for bag in bags]
    assert np.allclose(model.scores(pa.array(docs)), 1 / (1 + np.exp(-np.array(odds))), atol=2e-4)
    assert np.ptp(odds) > 0.5
