import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sparrowmill.llm import token_store as t
from sparrowmill.llm.storage import new_folder
from sparrowmill.llm.word_codec import WordCodec, codec

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    """Sorted rows of the contract from encoding whole texts."""
    own, out, start = codec(PATH), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = own.ids(text or "") + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_encoding_whole_texts(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, t.query(spark, d, 40_000).collect())) == brute(rows)


def test_odd_rows_and_empty_table(spark, odd_docs):
    docs = odd_docs.repartition(3)
    manifest, ranges = t.write_store(docs, new_folder(spark, "t"), PATH, 1, shard_bytes=50_000)
    out = [tuple(r) for r in t.checksums(t.read_records(docs.select("doc_id"), manifest, ranges, "<u2"), "<u2").collect()]
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sorted((r[0], r[2], r[3]) for r in out if r[0] is not None) == sorted((r[0], r[2], r[3]) for r in want if r[0] is not None)
    assert len(out) == len(want)
    assert sorted(r[1] for r in out) == np.cumsum([0] + [r[2] for r in sorted(out, key=lambda r: r[1])])[:-1].tolist()
    manifest, ranges = t.write_store(docs.limit(0), new_folder(spark, "t"), PATH, 1)
    assert t.read_records(docs.select("doc_id"), manifest, ranges, "<u2").count() == 0


def test_absent_keys_are_turned_away(spark, odd_docs):
    manifest, ranges = t.write_store(odd_docs, new_folder(spark, "t"), PATH, 1)
    keys = spark.range(100_000).selectExpr("id * 7 + 1000 AS doc_id").unionByName(odd_docs.select("doc_id").where("doc_id = 9"))
    assert [r.doc_id for r in t.read_records(keys, manifest, ranges, "<u2").collect()] == [9, 9]


def test_rows_of_one_id_or_of_none_spread_over_shards(spark):
    rows = [(None, f"none {i} " + "word " * 40) for i in range(300)] + [(50, f"fifty {i} " + "word " * 40) for i in range(200)]
    rows += [(i, f"own {i} " + "word " * 40) for i in range(100)] + [(None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest, ranges = t.write_store(docs, new_folder(spark, "t"), PATH, 1, shard_bytes=10_000)
    assert ranges.null_pieces >= 6 and ranges.ids == [50] and ranges.own[0] >= 4
    assert manifest.where("n_docs > 120").count() == 0 and manifest.count() > 12
    out = [tuple(r) for r in t.checksums(t.read_records(docs.select("doc_id"), manifest, ranges, "<u2"), "<u2").collect()]
    want = brute(rows)
    assert sorted(((r[0], r[2], r[3]) for r in out), key=repr) == sorted(((r[0], r[2], r[3]) for r in want), key=repr)
    in_order = sorted(out, key=lambda r: r[1])
    assert [r[1] for r in in_order] == np.cumsum([0] + [r[2] for r in in_order])[:-1].tolist()
    assert [r[0] is not None for r in in_order] == sorted(r[0] is not None for r in out)
    assert [r[0] for r in in_order if r[0] is not None] == sorted(r[0] for r in out if r[0] is not None)


@pytest.mark.parametrize("n", [0, 1, 2, 50, 20_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.uint64)
    index = t.ShardIndex.from_bytes(t.ShardIndex.build(np.sort(keys), np.arange(1, n + 1), 0).to_bytes())
    assert sorted(index.hashing.slots(keys)) == list(range(n))
    first, number = index.find(np.sort(keys))
    assert (number == 1).all() and (first == np.arange(n)).all()
    few = t.PerfectHash.build(keys, most_levels=1)  # the rest is kept as sorted keys
    assert sorted(few.slots(keys)) == list(range(n))


def test_words_give_the_ids_of_whole_texts(odd_docs):
    own = WordCodec(PATH)
    texts = ["Σ ΑΣ İ x don't DON'T ı ǅ. A. 9, b., c.. d.\n,e", "a\x1cB \x85 c D", "é ́ É", "", "x.", ".", " ,", "日本語 テスト。a, 🙂"]
    texts += ["<|ENDOFTEXT|> <|endoftext|>Y a<b", "<A <|startoftext|>Q."] + [r.text or "" for r in odd_docs.collect()]
    for group in (texts[:8], texts[8:10], texts, texts):
        ids, cuts = own.encode(pa.array(group))
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [own.ids(x) for x in group]
        assert own.count(pa.array(group)).tolist() == np.diff(cuts).tolist()


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        WordCodec(public_tokenizers.path("byte_bpe_50k.json"))
