"""Runs of one anchor that are dealt over several shards."""

from __future__ import annotations

import random

import pytest

from tidelane.llm import substring_dedup

from test_dedup import brute_words, docs


@pytest.mark.parametrize("most", [7, 2000])
def test_one_line_in_many_documents(spark, monkeypatch, most):
    """A line of 30 words in every document, between other words: no shard gets more runs than it should."""
    monkeypatch.setattr(substring_dedup, "SPLIT_RUNS", most)
    sizes = []
    real = substring_dedup.dealt

    def seen(open_):
        out = real(open_)
        sizes.extend(r["count"] for r in out.groupBy("key").count().collect())
        return out

    monkeypatch.setattr(substring_dedup, "dealt", seen)
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    line = " ".join(word() for _ in range(30))
    around = lambda: " ".join(word() for _ in range(r.randint(20, 40)))
    rows = [(i, f"{around()} {line} {around()}") for i in range(150)]
    rows += [(300 + i, " ".join([*rows[i][1].split()[r.randint(0, 9) :], word(), *rows[i][1].split()[-60:]])) for i in range(60)]
    rows += [(500, f"{line} " * 5), (501, f"{line} " * 4), rows[0]]
    expected = brute_words(rows, 50)
    out = substring_dedup.substring_dedup(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept) for x in out) == sorted((d, *expected[d, t]) for d, t in rows)
    assert sum(x.n_removed for x in out) > 0
    assert max(sizes) < 40 if most == 7 else max(sizes) > 100


def test_a_shard_keeps_every_place_of_the_least_document():
    a, b = b"a b c d", b"x a b c"
    found = substring_dedup.least_windows([(5, 8, 0, a), (5, 8, 9, b), (5, 9, 3, a), (7, 8, 0, a)], 3)
    places: dict[bytes, set] = {}
    for doc, v, start, n, digest in found:
        places.setdefault(digest, set()).add((doc, v, start, n))
    assert sorted(map(sorted, places.values())) == [[(5, 8, 0, 1), (5, 8, 10, 1), (5, 9, 3, 1)], [(5, 8, 1, 1), (5, 9, 4, 1)], [(5, 8, 9, 1)]]
