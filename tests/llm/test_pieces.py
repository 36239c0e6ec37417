import cProfile
import hashlib
import pstats
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowmill.llm import pieces as p

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = p.piece_codec(PATH)


def both(texts):
    ids, cuts = CODEC.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])], [b.decode() for b in CODEC.decode(ids, cuts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aehtionrsABué ßñ.,\n\r\t-=#{}();日本🙂\x00", max_size=60), max_size=4))
def test_ids_equal_the_library(texts):
    ids, back = both(texts)
    assert ids == [MODEL.encode(t) for t in texts]
    assert back == texts


def test_words_texts_and_marks(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", " ", "   ", "\n", " \n ", "a  b   c" + " " * 50, "public static void main(String[] args) {\r\n    return x;\r\n}", "################ ----------", "x" * 500, "ab" * 3000, "é" * 400]
    ids, back = both(texts)
    assert ids == [MODEL.encode(t) for t in texts]
    assert back == texts
    assert both(["a▁b ▁ ▁▁"])[1] == ["a▁b ▁ ▁▁"]


def test_units_go_side_by_side_whatever_the_block_and_the_places_for_answers(monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "th", "ing", "E", " ", "  ", "é", "日", "🙂", "\n", "\t", "\x00", "12", "####", "z" * 300]) for _ in range(rng.randrange(60))) for _ in range(300)]
    want = [MODEL.encode(t) for t in texts]
    monkeypatch.setattr(p, "ANSWER_BITS", 3)
    for block in (1, 40, 1 << 16):
        monkeypatch.setattr(p, "SIDE_BY_SIDE", block)
        own = p.PieceCodec(PATH)
        ids, cuts = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == want
        assert len(own.asked) == 8
    marks = [b"a\xe2\x96\x81", "\x00é".encode(), b"\n", b"", b" x"]
    assert own._windows(marks) == [list(own.stream([m.decode().replace(p.SPACE, p.LITERAL).replace(" ", p.SPACE)])) for m in marks]


def test_calls_for_a_new_unit_do_not_grow_with_its_characters():
    rng, own = random.Random(3), p.PieceCodec(PATH)
    words = lambda n: pa.array([" ".join("".join(rng.choice(["ka", "lor", "min", "tes", "ou", "re", "sta", "vin"]) for _ in range(5)) for _ in range(n))])
    own.encode(words(20_000))
    new, known = words(5_000), own.cache.n
    profile = cProfile.Profile()
    profile.runcall(own.encode, new)
    assert pstats.Stats(profile).total_calls < 40 * (own.cache.n - known)


def test_stream_commits_in_a_bounded_window():
    text = "▁" + "".join(f"word{i}internationalisation" for i in range(3000))
    want = MODEL.encode(text[1:])
    assert list(CODEC.stream([text])) == want
    assert list(CODEC.stream(text)) == want  # one character at a time
    first = next(CODEC.stream(iter(text[:400]), every=16))
    assert first == want[0]
    read = []

    def source():
        for c in text:
            read.append(c)
            yield c

    stream = CODEC.stream(source(), every=32)
    got = [next(stream) for _ in range(200)]
    assert got == want[:200] and len(read) < sum(len(MODEL.id_to_piece(i)) for i in got) + 300


def test_query_and_odd_rows(spark, odd_docs):
    for docs, rows in ((odd_docs, p.digests(p.encode_pieces(odd_docs, PATH), PATH, "<u2").collect()), (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), p.query(spark, "/root/testdata/sf0.001").collect())):
        want = []
        for r in docs.select("doc_id", "text").collect():
            t = r.text or ""
            ids = [i for i in MODEL.encode(t)] if "▁" not in t else None
            want.append((str(r.doc_id), len(ids) if ids is not None else None, zlib.crc32(np.array(ids, "<u4").tobytes()) if ids is not None else None, len(t), hashlib.sha256(t.encode()).hexdigest()))
        got = {(str(r.doc_id), r.text_sha256): (r.n_ids, r.ids_crc32, r.n_chars) for r in rows}
        assert len(rows) == len(want)
        for doc_id, n, crc, chars, sha in want:
            assert got[doc_id, sha][2] == chars
            if n is not None:
                assert got[doc_id, sha][:2] == (n, crc)
    coded = p.encode_pieces(odd_docs, PATH)
    assert set(coded.columns) == set(odd_docs.columns) - {"text"} | {"ids", "n_ids"}
    assert p.decode_pieces(p.encode_pieces(odd_docs.limit(0), PATH), PATH).count() == 0
