import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidegrid.llm import token_alignment as ta
from tidegrid.llm.bpe import byte_symbols
from tidegrid.llm.common import staged
from tidegrid.llm.queries_token_alignment import op13_interval_alignment

SF = "/root/testdata/sf0.001"
RNG = random.Random(13)
TEXTS = [
    None, "", " ", "a", "  x  \n\n y ", "<|endoftext|> <s> </s> <unk>", "▁x", "a\x00b \x01", "<0x41>",
    "é é 中文字符 \U0001f600\U0001f601", "tabs\t\tand\r\nlines", "a " * 3000, "z" * 3000,
    "new ՘ \U00010940", "don't we'll I'M  12345", "　 \xa0 \x85 \x1c",
    *("".join(chr(RNG.choice([32, 32, 10, RNG.randrange(33, 127), RNG.randrange(0xA0, 0x3000), RNG.randrange(0x1F300, 0x1F700)]))
              for _ in range(RNG.randrange(60))) for _ in range(150)),
]


@pytest.fixture(scope="module")
def paths():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows, paths):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) by comparing all tokens."""
    library = Tokenizer.from_file(paths[0])
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    back = {c: b for b, c in byte_symbols().items()}
    found, counts = [], Counter()
    for doc_id, text in rows:
        a = b = ([], [])
        if text:
            ids = library.encode(" " + text, add_special_tokens=False).ids
            a = (ids, [bytes(back[c] for c in library.id_to_token(i)) for i in ids])
            ids = pieces.encode(text)
            names = [pieces.id_to_piece(i) for i in ids]
            b = (ids, [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in zip(ids, names)])
            want = b" " + text.encode()
            if b"".join(a[1]) != want or b"".join(b[1]) != want:
                a = b = ([], [])
        spans = []
        for ids, raw in (a, b):
            at, out = 0, []
            for i, x in zip(ids, raw):
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, last = [], 0
        for end in ends:
            parts = [",".join(str(i) for s, e, i in side if last <= s and e <= end) for side in spans]
            groups.append("|".join(parts))
            last = end
        links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
        counts.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        found.append((doc_id, len(spans[0]), len(spans[1]), len(groups), links, digest))
    top = defaultdict(int)
    for (_, j), c in counts.items():
        top[j] = max(top[j], c)
    return [
        (d, na, nb, g, len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), digest)
        for d, na, nb, g, ls, digest in found
    ]


def test_query_matches_brute_force(spark, paths, tmp_path):
    rows = pq.read_table(f"{SF}/documents.parquet").slice(0, 60).to_pylist()
    rows = [(r["doc_id"], r["text"][:1500] if r["text"] else r["text"]) for r in rows]
    rows += [(10_000 + k, t if t is None else t[:800]) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_interval_alignment(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, paths))


def test_whole_texts_and_small_groups(paths, monkeypatch):
    a, b, digits = ta._load(*paths)
    want = ta.align_texts(TEXTS, a, b, digits)
    library = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    for text, n_b, names in zip(TEXTS, want[1], want[4], strict=True):
        ids = library.encode(text or "")
        if n_b:
            assert [int(x) for g in names.split(";") for x in g.split("|")[1].split(",")] == ids
    each = [ta.align_texts([t], a, b, digits) for t in TEXTS]
    for k, column in enumerate(want):
        assert list(column) == [x[k][0] for x in each]


def test_clashing_columns_chunks_and_empty_tables(spark, paths, monkeypatch):
    rows = [(k % 5 or None, t, "old", "part", 1.5) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string, part string, n_best double")
    monkeypatch.setattr(ta, "CHUNK_PAIRS", 40)
    rows_ = staged(ta.align(docs, *paths), "t")
    assert rows_.select("chunk").distinct().count() > 5
    got = ta.with_link_counts(rows_).drop("groups")
    assert got.columns == ["doc_id", "text", "part", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    want = [(x[1], *x[1:7]) for x in brute([(None, t) for t in TEXTS], paths)]
    keys = lambda r: tuple(r[3:9])
    assert sorted(keys(r) for r in got.collect()) == sorted(w[1:] for w in want)
    nothing = staged(ta.align(docs.where("false"), *paths), "t")
    assert ta.with_link_counts(nothing).count() == 0
