import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparrowmill.llm import quality_rules as q
from sparrowmill.llm.words import Texts

DATA = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    marked = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(marked), "n_lines": len(lines), "n_capitals": len(re.findall("[A-Z]", text)), "n_shouts": text.count("!")}


def test_counts_equal_brute_force(spark, odd_docs):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [r.text for r in odd_docs.collect()]
    texts += ["a b c d e f g h\n" * 3 + "z", "\n\n", "x", " x", "x ", "a\r\na\r\na", "\x1c \x85  ", "🙂 é\n🙂 é"]
    found = q.count_all(Texts.of(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert {c: int(found[c][i]) for c in q.COUNTS} == brute(t), t


def test_query_keeps_all_rows_and_base_rules(spark):
    rows = {r.doc_id: r for r in q.query(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        b, r = brute(d.text), rows[d.doc_id]
        assert all(r[c] == b[c] for c in q.COUNTS)
        assert r.base_failed == (b["n_words"] < 20 or 100 * b["n_repeat_words"] > 30 * b["n_words"])
        assert not (r.kept and r.base_failed)


def test_odd_rows_and_empty_tables(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert q.judge_quality(odd_docs, labels).count() == odd_docs.count()
    assert q.judge_quality(odd_docs.limit(0), labels.limit(0)).count() == 0
    assert q.judge_quality(odd_docs, labels.limit(0)).where("kept and base_failed").count() == 0


def test_tail_is_the_exact_binomial():
    n, p = 60, 0.07
    exact = [sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1)) for x in range(10)]
    assert np.allclose(q.binomial_tail(np.arange(10), n, p), exact)


def test_cutoff_is_certified_and_no_tighter():
    rng = np.random.default_rng(1)
    good, bad = np.bincount(rng.integers(0, 300, 4000), minlength=q.TOP + 1), np.bincount(rng.integers(250, 900, 1000), minlength=q.TOP + 1)
    cut = q.certified_cutoff(good, bad, good, 0.02, 0.001, 0.9)
    assert 200 < cut < 320
    assert good[cut + 1 :].sum() <= 0.02 * good.sum()
    assert q.certified_cutoff(good, bad, good // 4000, 0.02, 0.001, 0.9) == q.TOP  # too few to certify


def test_bad_documents_go_when_labels_suffice(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 30), i -> concat(if(id % 5 = 0, '##$$', 'word'), id, 'x', i)))").alias("text"), F.lit("en").alias("lang"))
    labels = docs.where("doc_id % 2 = 0").selectExpr("doc_id", "int(doc_id % 5 != 0) AS quality")
    kept = q.judge_quality(docs, labels).where("kept").select("doc_id").collect()
    assert {r.doc_id for r in kept} == {i for i in range(6000) if i % 5}


def brute_kept(rows, risk=0.04, error=0.05, purity=0.9):
    """doc_ids kept, from rows (doc_id, text, lang, label or None, holdout), cutoff by cutoff with plain sums."""
    judged, cuts = [], {}
    for doc_id, text, lang, label, holdout in rows:
        b = brute(text)
        ratios = [10 * 1000 * b["n_symbols"] / max(b["word_chars"], 1), 2 * 1000 * b["n_dup_lines"] / max(b["n_lines"], 1), 3 * 1000 * b["n_repeat_words"] / max(b["n_words"], 1)]
        ratios += [4 * 1000 * b["n_capitals"] / max(b["word_chars"], 1), 5 * 1000 * b["n_shouts"] / max(b["n_words"], 1)]
        base = b["n_words"] < 20 or 100 * b["n_repeat_words"] > 30 * b["n_words"]
        judged.append((doc_id, max(map(math.floor, ratios)), lang or "", label, holdout, base))
    strata = {r[2] for r in judged if r[3] == 1 and r[4]}
    for stratum in strata:
        own = [r for r in judged if r[2] == stratum]
        held = [r[1] for r in own if r[4] and r[3] == 1]
        cuts[stratum] = q.TOP
        scores = sorted({0, *(r[1] for r in own if r[3] is not None)})  # nothing changes between them
        for c in scores[::-1]:
            x, n = sum(s > c for s in held), len(held)
            if sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(x + 1)) > error / len(strata):
                break
            cuts[stratum] = c
        pure = [c for c in scores if (bad := sum(r[1] > c and r[3] == 0 and not r[4] for r in own)) and bad >= purity * (bad + sum(r[1] > c and r[3] == 1 and not r[4] for r in own))]
        cuts[stratum] = max(cuts[stratum], pure[0]) if pure else q.TOP
    return sorted(r[0] for r in judged if not r[5] and r[1] <= cuts.get(r[2], q.TOP)), cuts


def test_kept_equals_brute_force_cutoffs(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1600):
        bad = rng.random() < 0.25
        body = [f"w{i}x{j}" for j in range(30)]
        for j in range(rng.integers(0, 12) if bad else rng.integers(0, 3)):
            body[j] = ("#$" if rng.random() < 0.5 else "AB!") + body[j]
        rows.append((i, " ".join(body), ["en", "de", None][i % 3], None if i % 4 == 0 else int(not bad)))
    rows += [(5000 + i, " ".join(f"z{i}y{j}" for j in range(25)), "fr", 1) for i in range(20)]  # too few to certify
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[3] is not None], "doc_id long, quality int")
    held = {r.doc_id: r.holdout for r in q.labelled(docs.select("doc_id"), labels).collect()}
    want, cuts = brute_kept([(*r, held.get(r[0])) for r in rows])
    assert {s for s, c in cuts.items() if c < q.TOP} == {"en", "de", ""}
    assert sorted(r.doc_id for r in q.judge_quality(docs, labels).where("kept").collect()) == want


def test_columns_of_the_contract_come_first(spark, odd_docs):
    found = q.judge_quality(odd_docs, spark.createDataFrame([], "doc_id long, quality int"), carry=["source"])
    assert found.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"] and found.columns[-1] == "source"


def test_scores_are_not_clipped(spark):
    """Texts full of symbols score far above one that has a few, so a cutoff between them can be certified."""
    text = "concat_ws(' ', transform(sequence(1, 30), i -> concat(case when id % 6 = 0 then '########' when id % 6 = 1 then '##' else '' end, 'w', lpad(id, 5, '0'), 'x', i)))"
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr(text).alias("text"), F.lit("es").alias("lang"))
    labels = docs.selectExpr("doc_id", "int(doc_id % 6 != 0) AS quality")
    kept = q.judge_quality(docs, labels).where("kept").select("doc_id").collect()
    assert {r.doc_id for r in kept} == {i for i in range(4000) if i % 6}
