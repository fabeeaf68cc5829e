import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegrid.llm import bpe
from tidegrid.llm.tokens import WordIds

RNG = random.Random(4)


def odd_texts(count):
    pick = lambda: chr(RNG.choice([
        RNG.randrange(32, 127), RNG.randrange(0xA0, 0x3000), RNG.randrange(0x10000, 0x20000),
        32, 10, 9, 0x1C, 0x85, RNG.randrange(0, 0x250),
    ]))
    return ["".join(pick() for _ in range(RNG.randrange(80))) for _ in range(count)]


TEXTS = [
    None, "", " ", "a", "aaaa aaaaaaaa", "  x  \n\n y ", "<|endoftext|>", "a <|endoftext|> b  <|endoftext|>c",
    "a\x1cb \x1c c\x85d\xa0e\u3000f\u180eg\u200bh\ufeff", "don't we'll I'M", "\x00\x01", "é 123 ½ ²３ ੧",
    "new letters \u0558 \u0c5c \U00010940 x", "İstanbul ΣΑΣ ΟΔΟΣ", "x\u0338 ȺB", "w " * 5000, "z" * 3000,
    *odd_texts(400),
]


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("byte_bpe_50k.json")


def test_ids_and_texts_are_the_librarys(path):
    library, own = Tokenizer.from_file(path), bpe.ByteBPE(path)
    for text, ids in zip(TEXTS, own.encode(TEXTS), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_small_caches_and_chunks_change_nothing(path, monkeypatch):
    own = bpe.ByteBPE(path)
    want = own.encode(TEXTS)
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 7)
    own.table = bpe.WordTable(own._learn, most=5)
    assert all(np.array_equal(a, b) for a, b in zip(want, own.encode(TEXTS), strict=True))


def test_broken_bytes_decode_like_the_library(path):
    library, own = Tokenizer.from_file(path), bpe.ByteBPE(path)
    ids = np.array([RNG.randrange(50257) for _ in range(3000)], np.uint32)
    for part in np.split(ids, 100):
        assert own.decode(part) == library.decode(part.tolist(), skip_special_tokens=False)


def test_merges_take_overlapping_pairs_from_the_left():
    vocab = {"a": 0, "b": 1, "aa": 2, "aab": 3}
    merges = bpe.Merges(vocab, [["a", "a"], ["aa", "b"]])
    ids, sizes = merges.encode(np.array([0, 0, 0, 0, 0, 1, 0, 0, 1, 1]), np.array([6, 3, 1, 0]))
    assert ids.tolist() == [2, 2, 0, 1, 3, 1] and sizes.tolist() == [4, 1, 1, 0]


def test_tables_round_trip(spark, path):
    rows = [(k % 3, t, "old") for k, t in enumerate(TEXTS[:40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted(r.decoded for r in back) == sorted(t or "" for t in TEXTS[:40])
    assert all(len(r.ids) == 4 * r.n_tokens for r in back)
    assert bpe.decode(bpe.encode(docs.where("false"), path), path).count() == 0


def test_word_ids_are_the_librarys():
    word = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(word), WordIds(word)
    for text, ids in zip(TEXTS, own.encode_all(TEXTS), strict=False):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_short_pieces_are_merged_together():
    own = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    library, texts = own.library, [t or "" for t in TEXTS] + ["naïve Straße über", "q" * 64 + " " + "xyz" * 400]

    class Long:
        def tokenize(self, piece):
            assert len(piece) > 64  # the library's model is for long pieces only
            return library.model.tokenize(piece)

    own.model = Long()
    for text, ids in zip(texts, own.encode_all(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_a_failed_lookup_leaves_no_words():
    def learn(words):
        if "bad" in words:
            raise ValueError
        return np.arange(len(words), dtype=np.uint32), np.ones(len(words), np.int64)

    table = bpe.WordTable(learn)
    with pytest.raises(ValueError):
        table.look_up(["a", "bad"])
    assert table.look_up(["a", "b", "a"])[0].tolist() == [0, 1, 0]


def test_decoding_loads_no_encoder(path, monkeypatch):
    monkeypatch.setattr(bpe, "_DECODERS", {})
    monkeypatch.setattr(bpe, "Merges", None)
    monkeypatch.setattr(bpe, "Tokenizer", None)
    decoder, library = bpe.load_decoder(path), Tokenizer.from_file(path)
    for text in TEXTS[:60]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want = library.decode(ids, skip_special_tokens=False)
        assert decoder.decode(np.array(ids, np.uint32)) == want
