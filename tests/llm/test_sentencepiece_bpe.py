"""The ids of the BPE model file against the library's own."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def sample():
    r = random.Random(1)
    odd = "etaoinshr ▁ \n\t é漢0123456789_.,!²½☃🙂ABC"
    texts = ["the quality of the data", "", None, " ", "  two  spaces ", "a" * 300, "é" * 700, "ehtn" * 300, "<s> </s> <unk> <0x41>", "漢字仮名 and ☃ 🙂"]
    texts += ["".join(r.choices(odd, k=r.randint(1, 200))) for _ in range(150)]
    texts += ["".join(r.choices("ehtna", k=r.randint(1, 90))) for _ in range(100)]
    texts += [" ".join("".join(r.choices("etaoinshrdlué", k=r.randint(1, 9))) for _ in range(600))]
    return list(enumerate(texts, 1))


def test_registered_query_gives_the_ids_of_the_library(spark, tmp_path):
    from tidelane.llm.queries import op2_sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = sample()
    spark.createDataFrame([*rows, (None, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = spark.createDataFrame([(d, library.encode(t or ""), (t or "").replace("▁", " ")) for d, t in rows], "doc_id long, ids array<int>, text string")
    want = ids.select("doc_id", F.size("ids").cast("long"), F.xxhash64("ids"), F.sha2(F.col("text").cast("binary"), 256)).collect()
    assert sorted(map(tuple, op2_sentencepiece(spark, str(tmp_path)).collect())) == sorted(map(tuple, want))


def giants():
    """Texts that are cut inside words: no place to cut, few, or many, with characters that are no pieces."""
    r = random.Random(5)
    rows = [(100, "a" * 5000), (101, "".join(r.choices("ehtnaiou", k=4000))), (102, " " * 900), (103, "é漢☃" * 400), (104, "".join(r.choices("ab \n☃ ▁é0", k=3000)))]
    rows += [(105, " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(1, 90))) for _ in range(200))), (106, "=" * 1000 + "-" * 700), (105, "x" * 2000), (107, "the quality of the data " * 150)]
    return rows + [rows[0], rows[-1]]


@pytest.mark.parametrize("chunk, together", [(1, 3), (150, 2), (1000, 64)])
def test_giant_texts_take_the_scan(spark, monkeypatch, chunk, together):
    """Cut anywhere, combined by a tree of several levels, ids as the library gives them; matrices are built."""
    from tidelane.llm import sentencepiece_scan as scan

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    built = []
    real = scan.scanned
    monkeypatch.setattr(scan, "scanned", lambda level, n, together: built.append((level.count(), level.where("size(e) > 1").count(), n)) or real(level, n, together))
    rows = sample() + giants()
    out = scan.sentencepiece_encode(spark.createDataFrame(rows, "doc_id long, text string"), PIECES, chunk, together=together).collect()
    assert sorted((r.doc_id, r.ids) for r in out) == sorted((d, library.encode(t or "")) for d, t in rows)
    assert built[0][0] > 20 and built[0][1] > 10 and (chunk == 1000 or built[0][2] > together)


def test_matrices_hold_the_way_of_the_library():
    """Whatever the cut, the pieces across it are states and lead from one end to the other."""
    from tidelane.llm import sentencepiece_scan as scan
    from tidelane.llm.sentencepiece_bpe import model

    m, library = model(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(6)
    for _, text in giants()[:6]:
        s = m.normal(text)
        at = scan.boundaries(len(s), 4 * m.longest)
        parts = [scan.transfer(m, s, a, b - a) for a, b in zip(at, at[1:])]
        left = scan.product(scan.product(parts[0], parts[1]), parts[2])
        right = scan.product(parts[0], scan.product(parts[1], parts[2]))
        assert left[:2] == right[:2] and (left[2] == right[2]).all()
        whole = parts[0]
        for part in parts[1:]:
            whole = scan.product(whole, part)
        ends = [x for x, t in zip(whole[1], whole[2][0]) if t == 0]
        assert len(ends) == 1
        states = scan.between(parts, scan.START, ends[0])
        ids = []
        for (a, b), e, x in zip(zip(at, at[1:]), states, states[1:]):
            ids += m.encode(s[a + (e & 255) : b - (x >> 8)]) + m.ids_of([s[b - (x >> 8) : b + (x & 255)]])
        assert ids == library.encode(text)
        for _ in range(50):
            a, b = sorted(r.sample(range(len(s)), 2))
            b = min(b, a + 12)
            p, q = s[a : (a + b) // 2], s[(a + b) // 2 : b]
            if p in m.ids and q in m.ids:
                assert m.stands(p, q) == (m.merged(p + q) == [p, q])


def test_decoding_of_nothing_and_of_unknown_characters(spark):
    from tidelane.llm import sentencepiece_scan as scan

    rows = [(1, None), (2, ""), (3, " a ☃ é "), (4, "z" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "v": F.lit(2), "k": F.lit(3), "s": F.lit("x")})
    back = scan.sentencepiece_decode(scan.sentencepiece_encode(df, PIECES, 600), PIECES).collect()
    assert {r.doc_id: r.text for r in back} == {d: t or "" for d, t in rows}
    assert scan.sentencepiece_encode(df.limit(0), PIECES).count() == 0
