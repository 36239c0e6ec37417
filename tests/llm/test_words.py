import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sparrowmill.llm import pieces, quality_rules, word_codec, words

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def twins(length):
    """Two different words that polynomial hashes modulo 2^64 cannot tell apart."""
    s, t = "a", "b"
    while len(s) < length:
        s, t = s + t, t + s
    return s, t


@pytest.mark.parametrize("length", [1024, 2048])
def test_constructed_words_keep_their_own_results(length):
    s, t = twins(length)
    column = pa.array([s, t, f"{t} {s}", f"{s}\n{t}"])
    own = word_codec.WordCodec(WORD)
    ids, cuts = own.encode(column)
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [own.ids(x.as_py()) for x in column]
    assert own.count(column).tolist() == np.diff(cuts).tolist()
    coder = pieces.PieceCodec(PIECE)
    assert [x.decode() for x in coder.decode(*coder.encode(column))] == column.to_pylist()
    assert quality_rules.count_all(words.Texts.of(column))["n_dup_lines"].tolist() == [0, 0, 0, 0]
    a, b = words.shingle_sets(words.Texts.of(pa.array([f"one two three {s}", f"one two three {t}"])), 5, words.new_key())
    assert a.tolist() != b.tolist()


def test_equal_bytes_have_equal_hashes_and_others_do_not():
    rng = np.random.default_rng(5)
    raw = [bytes(rng.integers(97, 99, n).tolist()) for n in [*range(1, 40), 255, 256, 257, 600] for _ in range(4)]
    places = np.cumsum([0] + [len(x) for x in raw + raw])
    data = words.padded(np.frombuffer(b"".join(raw + raw), np.uint8))
    found = words.range_hashes(data, places[:-1], places[1:])
    assert found[: len(raw)].tolist() == found[len(raw) :].tolist()
    assert len(set(found.tolist())) == len(set(raw))
    sizes = np.diff(places)
    i, j = np.meshgrid(np.arange(len(sizes)), np.arange(len(sizes)))
    i, j = i[sizes[i] == sizes[j]], j[sizes[i] == sizes[j]]
    both = raw + raw
    assert words.equal_ranges(data, places[i], data, places[j], sizes[i]).tolist() == [both[a] == both[b] for a, b in zip(i, j)]


def test_weak_hashes_change_nothing(monkeypatch):
    """With hashes that often meet, bytes decide."""
    weak = lambda data, starts, ends, key=b"": (data[starts] % 3).astype(np.uint64)
    texts = ["the cat sat on the mat " * 3, "a cat\nthe cat\na cat\nan owl", "", None, "one two three four five six seven eight nine " * 2, "tea toe tip tap " * 8]
    own, coder = word_codec.WordCodec(WORD), pieces.PieceCodec(PIECE)
    want = quality_rules.count_all(words.Texts.of(pa.array(texts)))
    for module in (word_codec, pieces, quality_rules):
        monkeypatch.setattr(module, "range_hashes", weak)
    for _ in range(2):
        ids, cuts = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [own.ids(x or "") for x in texts]
        assert [x.decode() for x in coder.decode(*coder.encode(pa.array(texts)))] == [x or "" for x in texts]
    found = quality_rules.count_all(words.Texts.of(pa.array(texts)))
    assert {k: v.tolist() for k, v in found.items()} == {k: v.tolist() for k, v in want.items()}


def test_small_cache_forgets_the_rare_and_stays_right(monkeypatch):
    rng = np.random.default_rng(3)
    own = word_codec.WordCodec(WORD)
    own.folded = word_codec.UnitCache(own._encode, own.dtype, most=50)
    for _ in range(30):
        text = " ".join(f"w{n}" for n in rng.zipf(1.3, 200) % 5000)
        ids, _ = own.encode(pa.array([text, "again " + text]))
        assert ids.tolist() == own.ids(text) + own.ids("again " + text)
    assert own.folded.n < 500
