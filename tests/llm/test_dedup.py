"""Deduplication operators against brute force, on texts with nulls, empties, repeats, ties and long documents."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.llm import exact_dedup, line_dedup, simhash, substring_dedup, suffix_dedup
from tidelane.llm.components import connected_components

#: Columns whose names the operators also use inside.
CLASH = "key string, cls int, span int, name string, h int, idx int, n_bytes int, hits int, kept int"


def docs(spark, rows):
    extra = ("k", 1, 1, "n", 1, 1, 1, 1, 1)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {CLASH}").repartition(3)


def sample(seed=1, n=70):
    """Invented words; passages and whole texts that repeat; empties, nulls, one long text, repeated rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéß", k=r.randint(1, 7))) for _ in range(300)]
    passages = [" ".join(r.choices(vocabulary, k=k)) for k in (20, 60, 75, 130)]
    out = []
    for i in range(n):
        parts = [" ".join(r.choices(vocabulary, k=r.randint(0, 80))) for _ in range(r.randint(1, 3))]
        if r.random() < 0.5:
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
        out.append((i * 3 % 211, r.choice([" ", "\n", "\t "]).join(parts)))
    out += [(500, out[3][1]), (501, out[3][1]), (502, out[5][1].upper()), (503, ""), (504, None), (505, "   \n\t"), (506, "x" * 400), (507, "x" * 99), (508, "x" * 100)]
    out += [(509, " ".join(r.choices(vocabulary, k=6000))), (510, " ".join([passages[1]] * 9)), (511, out[3][1][:150] + "!" + out[3][1][150:])]
    return out + [out[0], (511, out[-1][1])]


def test_exact(spark):
    rows = sample() + [(9000, None), (None, "a"), (9001, "b" * 20000), (9002, "b" * 20000), (9003, "b" * 19999 + "c"), (9004, "c" + "b" * 19999)]
    out = exact_dedup.exact_groups(docs(spark, rows), block_bytes=64).collect()
    texts = {d: t or "" for d, t in rows if d is not None}
    assert sorted(r.doc_id for r in out) == sorted(texts)
    groups: dict[str, list[int]] = {}
    for d, t in texts.items():
        groups.setdefault(t, []).append(d)
    for r in out:
        same = groups[texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
        assert r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    first = exact_dedup.exact_groups(docs(spark, rows), keep="min").where("NOT kept").collect()
    assert all(r.keep_id == min(groups[texts[r.doc_id]]) for r in first)


def test_names_do_not_trust_hashes(spark):
    """Texts that share (length, hash) by force still get names by content."""
    rows = [(1, "a" * 100), (2, "b" * 100), (3, "a" * 100), (4, "a" * 99 + "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_bytes": F.lit(100), "h": F.lit(0).cast("long")})
    names = {r.doc_id: r.name for r in exact_dedup.block_names(df, block_bytes=16).collect()}
    assert names[1] == names[3] and len(set(names.values())) == 3


def test_lines(spark):
    r = random.Random(2)
    lines = ["Licence A", "  licence a\t", "LICENCE A", "é", "É", "", "  ", "rare", "x" * 3000]
    rows = [(i, "\n".join(r.choices(lines, k=r.randint(1, 90)))) for i in range(40)] + [(100, None), (101, ""), (102, "\n"), (103, "a\r\nb"), (3, None)][:-1]
    rows.append(rows[0])

    def key(x):
        return re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))

    texts = {d: t or "" for d, t in rows}
    counts: dict[str, int] = {}
    for t in texts.values():
        for k in {key(x) for x in t.split("\n")}:
            counts[k] = counts.get(k, 0) + 1
    for least in (10, 30):
        out = line_dedup.line_dedup(docs(spark, rows), min_docs=least).collect()
        assert len(out) == len(rows)
        for x in out:
            parts = texts[x.doc_id].split("\n")
            keep = [p for p in parts if not (len(key(p)) >= 1 and counts[key(p)] >= least)]
            assert (x.text, x.n_lines, x.n_dropped) == ("\n".join(keep), len(parts), len(parts) - len(keep))
    two = [(i, "shared\nown") for i in range(12)] + [(0, "x\nshared\ny"), (0, "shared")]
    out = line_dedup.line_dedup(docs(spark, two), min_docs=10).collect()
    assert sorted((x.doc_id, x.text, x.n_dropped) for x in out) == sorted([(i, "", 2) for i in range(12)] + [(0, "x\ny", 1), (0, "", 1)])
    kept_once = line_dedup.line_dedup(docs(spark, rows), min_docs=2, keep_first=True).collect()
    assert sum(t.text.split("\n").count("rare") for t in kept_once if t.doc_id) + sum("rare" in t.text.split("\n") for t in kept_once[:0]) <= 2


def brute_words(rows, window):
    """Results by (id, text)."""
    texts = {(d, t): (t or "").encode().split() for d, t in rows if d is not None}
    least: dict[tuple, int] = {}
    for (d, _), w in texts.items():
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(d, least.get(k, d))
    out = {}
    for (d, t), w in texts.items():
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone[i : i + window] = True
        out[d, t] = (len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def awkward(step):
    """Words and texts that weak hashes confuse, periodic texts, and ids with several texts."""
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    a, b = "a" + "x" * (step - 1) + "b", "b" + "x" * (step - 1) + "a"
    thue = ["p", "q"]
    while len(thue) < 4096:
        thue += ["q" if x == "p" else "p" for x in thue]
    swap = {"p": "q", "q": "p"}
    passage = " ".join(word() for _ in range(70))
    rows = [(1, " ".join([a] * 50)), (2, " ".join([b] * 50)), (3, " ".join([a] * 49 + [b]))]
    rows += [(10, " ".join(thue)), (11, " ".join(swap[x] for x in thue)), (12, "ab" * 300), (13, "ba" * 260 + "c"), (14, " ".join("xyz" * 60))]
    rows += [(20, f"{word()} {passage} {word()}"), (20, f"{word()} {word()}"), (20, f"{passage} {passage}"), (21, f"{word()} {passage}"), (21, passage), (20, None), (22, passage)]
    return [*rows, rows[8], rows[-1]]


@pytest.mark.parametrize("window, gram", [(50, 16), (20, 4)])
def test_substrings(spark, window, gram):
    rows = sample(3) + [(None, "a")]
    expected = brute_words(rows, window)
    out = substring_dedup.substring_dedup(docs(spark, rows), window, gram).collect()
    assert len(out) == len(rows) - 1
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == sorted((d, *expected[d, t]) for d, t in rows if d is not None)
    assert sum(r.n_removed for r in out) > 0


@pytest.mark.parametrize("step", [1, 8, 64, 4096])
def test_contents_decide_and_texts_of_an_id_stay_apart(spark, step):
    rows = awkward(step)
    expected = brute_words(rows, 50)
    out = substring_dedup.substring_dedup(docs(spark, rows), row=True).collect()
    assert sorted((r.doc_id, r.row.text or "", r.n_words, r.n_removed, r.kept) for r in out) == sorted((d, t or "", *expected[d, t]) for d, t in rows)
    assert all(r.row.doc_id == r.doc_id and r.row.hits == 1 for r in out)
    expected = brute_bytes(rows, 100)
    out = suffix_dedup.suffix_dedup(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == sorted((d, *expected[d, t]) for d, t in rows)


@pytest.mark.parametrize("size", ["1", "7"])
def test_classes_are_folded_across_batches(spark, size):
    """Arrow batches of a few rows: anchors and classes go on from one to the next."""
    rows = awkward(8) + sample(3, 20)
    rows = [(d, t) for d, t in rows if len(t or "") < 5000 and d is not None]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        out = substring_dedup.substring_dedup(docs(spark, rows)).collect()
        out_bytes = suffix_dedup.suffix_dedup(docs(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = brute_words(rows, 50)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == sorted((d, *expected[d, t]) for d, t in rows)
    expected = brute_bytes(rows, 100)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out_bytes) == sorted((d, *expected[d, t]) for d, t in rows)


@pytest.mark.parametrize("operator", [substring_dedup.substring_dedup, suffix_dedup.suffix_dedup])
def test_windows_that_records_cannot_hold_are_refused(spark, operator):
    for window, gram in ((50, 12), (50, 64), (40000, 16)):
        with pytest.raises(ValueError):
            operator(docs(spark, [(1, "a")]), window, gram)


def test_automaton_matching_statistics():
    r = random.Random(4)
    for _ in range(30):
        known = [[r.randrange(3) for _ in range(r.randrange(1, 25))] for _ in range(3)]
        automaton = substring_dedup.SuffixAutomaton()
        for s in known:
            automaton.begin()
            for t in s:
                automaton.extend(t)
        text = [r.randrange(3) for _ in range(40)]
        subs = {tuple(s[i:j]) for s in known for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        best = [max(n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in subs) for i in range(len(text))]
        assert automaton.matching(text) == best


def brute_bytes(rows, length):
    """Results by (id, text)."""
    seen: set[bytes] = set()
    out = {}
    texts = {(d, t): (t or "").encode() for d, t in rows if d is not None}
    for d in sorted({d for d, _ in texts}):
        here: set[bytes] = set()
        for (e, t), b in texts.items():
            if e != d:
                continue
            own: set[bytes] = set()
            gone = np.zeros(len(b), bool)
            for i in range(len(b) - length + 1):
                k = b[i : i + length]
                if k in seen or k in own:
                    gone[i : i + length] = True
                own.add(k)
            here |= own
            spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
            out[d, t] = (len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes())
        seen |= here
    return out


@pytest.mark.parametrize("length, gram, windows", [(100, 32, 100_000), (40, 8, 200), (300, 16, 100_000)])
def test_suffixes(spark, monkeypatch, length, gram, windows):
    monkeypatch.setattr(suffix_dedup, "SORTED_WINDOWS", windows)
    rows = sample(5)
    expected = brute_bytes(rows, length)
    out = suffix_dedup.suffix_dedup(docs(spark, rows), length, gram).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == sorted((d, *expected[d, t]) for d, t in rows)


@pytest.mark.parametrize("most", [7, 100_000])
def test_one_leading_string_over_many_parts(spark, monkeypatch, most):
    """A passage in every document, with other words around it: its runs are dealt over several parts."""
    monkeypatch.setattr(suffix_dedup, "SPLIT_RUNS", most)
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefgh", k=9))
    line = " ".join(word() for _ in range(9))
    rows = [(i, " ".join([*(word() for _ in range(r.randint(0, 6))), line, *(word() for _ in range(r.randint(0, 6)))])) for i in range(120)]
    rows += [(200 + i, rows[i][1][: r.randint(60, 140)] + rows[i][1][-60:]) for i in range(40)]
    rows += [(5, " ".join([line] * 3)), (5, f"{line} {word()} {line} {line}")]
    expected = brute_bytes(rows, 100)
    out = suffix_dedup.suffix_dedup(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == sorted((d, *expected[d, t]) for d, t in rows)


def test_equal_groups():
    r = np.random.default_rng(1)
    m = r.integers(0, 2, (500, 11)).astype(np.uint8)
    g = suffix_dedup.equal_groups(m)
    seen: dict[bytes, list[int]] = {}
    for i, row in enumerate(m):
        seen.setdefault(row.tobytes(), []).append(i)
    for rows in seen.values():
        assert len({int(g[i]) for i in rows}) == 1 and (g[rows[0]] >= 0) == (len(rows) > 1)
    assert len(set(g[g >= 0].tolist())) == sum(len(x) > 1 for x in seen.values())


def test_simhash(spark):
    r = random.Random(7)
    base = [" ".join("".join(r.choices("abcdef", k=4)) for _ in range(300)) for _ in range(12)]
    rows = [(i * 10, t) for i, t in enumerate(base)]
    for i in range(60):
        w = base[i % 4].split(" ")
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "zz"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000, ""), (2001, None), (2002, " \t"), (2003, "one two"), (2004, "ONE TWO"), (None, "x"), rows[0], (2005, base[0].upper())]
    out = simhash.simhash_groups(docs(spark, rows)).collect()
    texts = {d: t or "" for d, t in rows if d is not None}
    assert sorted(x.doc_id for x in out) == sorted(texts)
    fp = {d: simhash.fingerprint(t) for d, t in texts.items()}
    assert all(x.fingerprint == f"{fp[x.doc_id]:016x}" for x in out)
    parent = {d: d for d in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {x.doc_id: x.component_id for x in out} == {d: find(d) for d in fp}


def test_pigeonhole_schemes_lose_no_link(spark):
    """Every scheme that sums right finds the links, whatever its partitions and thresholds."""
    r = random.Random(8)
    centres = [r.getrandbits(64) for _ in range(15)]
    prints = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(20)} | {r.getrandbits(64) for _ in range(100)}
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(signed, "rep long, fp long")
    bits = list(range(64))
    r.shuffle(bits)
    masks = lambda m: [sum(1 << b for b in bits[k::m]) for k in range(m)]
    values = sorted(prints)
    expected = {frozenset((i, j)) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4}
    parts = {}
    for scheme in (simhash.Scheme(masks(5), [0] * 5), simhash.Scheme(masks(4), [1, 0, 0, 0]), simhash.Scheme(masks(3), [1, 1, 0]), simhash.Scheme(masks(3), [3, 0, -1])):
        links = {frozenset((x.u, x.v)) for x in simhash.fingerprint_links(df, scheme).collect()}
        assert links <= expected
        comp = {x.id: x.component for x in connected_components(spark.createDataFrame([tuple(sorted(p)) for p in links], "u long, v long")).collect()}
        parts[str(scheme.thresholds)] = comp
    assert len({str(sorted(c.items())) for c in parts.values()}) == 1
    chosen = simhash.choose_scheme(df)
    assert sum(chosen.thresholds) == 4 - len(chosen.masks) + 1 and sum(chosen.masks) == (1 << 64) - 1


def test_large_buckets_link_like_small_ones():
    r = np.random.default_rng(3)
    fp = (np.uint64(0xF0F0) ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64))) | np.uint64(0)
    fp = np.concatenate((fp, r.integers(0, 1 << 62, 200).astype(np.uint64)))
    key, own = np.zeros(600, np.int64), np.ones(600, bool)
    groups = []
    for large in (10, 1000):
        parent = list(range(600))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in zip(*simhash.bucket_links(key, own, fp, 4, large)):
            x, y = sorted((find(int(a)), find(int(b))))
            parent[y] = x
        groups.append([find(i) for i in range(600)])
    assert groups[0] == groups[1]


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7)]
    out = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("operator", [exact_dedup.exact_groups, line_dedup.line_dedup, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, simhash.simhash_groups])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = operator(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert len(only) == 1
