import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline as c
from sparrowmill.llm import quality_rules
from test_ngram_join import UPPER, brute


def test_stages_equal_brute_force(spark):
    d = "/root/testdata/sf0.001"
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    kept = {r.doc_id for r in quality_rules.query(spark, d).where("kept").collect()}
    last = {}
    for i in sorted(kept):
        last[(docs[i].text or "").translate(UPPER)] = i
    unique = sorted(last.values())
    near = [i for i, _, k in brute([(i, docs[i].text) for i in unique]) if k == i]
    out = c.run(spark, d).collect()
    assert {r.doc_id for r in out} == set(near)
    assert max(Counter(r.doc_id for r in out).values()) <= 2
    for r in out:
        text = docs[r.doc_id].text or ""
        assert np.frombuffer(r.ids, "<u2").tolist() == model.encode(text) and r.n_ids == len(r.ids) // 2
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows_and_empty(spark, odd_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd_docs, odd_docs.limit(0)):
        for name, stage in c.STAGES[1:]:
            before = docs.columns
            docs = c.materialize(stage(spark, docs, str(tmp_path)), "t")
            assert name == "SentencePiece" or docs.columns == before
        ids = Counter(r.doc_id for r in docs.collect())
        assert not ids or set(ids) == {2, 4, 5, 7, 8, 9, 10, None, 11}
    # The odd rows are short or repeat their words; two documents that pass stay.
    passing = [(i, " ".join(f"{w}{n}" for n in range(25)), "en") for i, w in ((20, "alpha"), (21, "beta"))]
    both = odd_docs.unionByName(spark.createDataFrame(passing, "doc_id long, text string, lang string"), allowMissingColumns=True)
    assert sorted(r.doc_id for r in c.drop_low_quality(spark, both, str(tmp_path)).collect()) == [20, 21]


def test_rows_that_share_an_id_or_have_none_are_told_apart(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    text = lambda word, n=40: " ".join(f"{word}{i}" for i in range(n))
    rows = [(None, text("a")), (None, "short"), (None, text("b")), (5, text("c")), (5, "brief"), (6, text("d")), (6, text("d")), (None, text("d")), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    content = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    long = [r for r in rows if len(r[1] or "") > 10]
    assert content(c.drop_low_quality(spark, docs, str(tmp_path))) == sorted(long, key=str)
    once = [(None, text("a")), (None, text("b")), (5, text("c")), (5, "brief"), (6, text("d")), (None, "short")]
    left = content(c.drop_exact_copies(spark, docs, str(tmp_path)))
    assert [r for r in left if r[1]] == sorted(once, key=str) and len(left) == len(once) + 1

    near = lambda word, end: f"{text(word)} {end}"
    groups = [[(None, near("e", "x")), (None, near("e", "y"))], [(7, near("f", "x")), (7, near("f", "y")), (None, near("f", "z"))], [(9, near("g", "x")), (8, near("g", "y")), (None, near("g", "z"))], [(7, text("h"))], [(None, text("i"))], [(4, text("j")), (4, text("j"))]]
    alone = [(None, ""), (None, ""), (3, "word")]
    docs = spark.createDataFrame([r for g in groups for r in g] + alone, "doc_id long, text string")
    first = lambda g: min(g, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    assert content(c.drop_near_copies(spark, docs, str(tmp_path))) == sorted([first(g) for g in groups] + alone, key=str)
