import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegrid.llm import sos_packing, token_output

WORD = public_tokenizers.path("word_bpe_49k.json")
ROWS = [
    (None, "no id"), (1, None), (2, ""), (3, "one two three"), (3, "one two three"),
    (4, "A longer text, with Marks! " * 20), (5, "word " * 100), (6, "x " * 15), (7, "y " * 16),
    *[(8, "copy of a text")] * 30, *[(k, "t " * (k % 13)) for k in range(20, 90)],
]


def want(width):
    library, out = Tokenizer.from_file(WORD), []
    for i, t in ROWS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for j, a in enumerate(range(0, len(ids), width)):
            part = ids[a : a + width]
            out.append((i or -1, j, a, len(part), zlib.crc32(part.tobytes())))
    return sorted(out)


def docs(spark):
    rows = [(*r, 1, "x") for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, piece int, sequence_id string")


def check_sequences(rows, width):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
    return len(by)


@pytest.mark.parametrize("group", [7, 10_000])
def test_sum_of_squares_packs_every_piece(spark, group):
    rows = sos_packing.pack_documents(docs(spark), WORD, 16, 1, group_pieces=group).collect()
    got = sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == want(16)
    used = check_sequences(rows, 16)
    if group > len(rows):
        assert used <= -(-sum(r.length for r in rows) // 16) + 1


def test_written_sequences_read_back(spark):
    frame = docs(spark)
    sequences = token_output.packed_sequences(frame, WORD, 16, 1, pad_id=9, group_bytes=800)
    rows = token_output.segments(sequences).collect()
    got = sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == want(16)
    check_sequences(rows, 16)
    for r in sequences.collect():
        ids = np.frombuffer(r.ids, f"<u{r.id_bytes}")
        assert len(ids) == 16 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids
        assert set(ids[r.n_ids :].tolist()) <= {9}
        assert r.position_resets == r.cu_seqlens[:-1] + ([r.n_ids] if r.n_ids < 16 else [])


def test_no_documents(spark):
    empty = docs(spark).where("false")
    assert sos_packing.pack_documents(empty, WORD).count() == 0
    assert token_output.packed_sequences(empty, WORD).count() == 0


@pytest.mark.parametrize("place", [sos_packing.place, token_output.best_fit])
def test_places_fit_and_waste_little(place):
    rng = np.random.default_rng(3)
    lengths = np.sort(np.minimum(rng.lognormal(5.5, 1.2, 5000).astype(int) + 1, 4096))[::-1]
    sequence, offset = place(lengths, 4096)
    for k in np.unique(sequence):
        mine = np.flatnonzero(sequence == k)
        order = mine[np.argsort(offset[mine])]
        assert (offset[order] == np.cumsum(lengths[order]) - lengths[order]).all()
        assert lengths[order].sum() <= 4096
    assert sequence.max() + 1 <= -(-lengths.sum() // 4096) * 1.01 + 1


def test_room_tree_takes_the_tightest():
    tree, rng = token_output.RoomTree(50), np.random.default_rng(1)
    rooms = []
    for k in range(400):
        if rng.random() < 0.5:
            room = int(rng.integers(1, 51))
            rooms.append(room)
            tree.add(room, k)
        else:
            least = int(rng.integers(1, 51))
            fitting = [r for r in rooms if r >= least]
            found = tree.take(least)
            assert (found[0] if found else None) == (min(fitting) if fitting else None)
            if found:
                rooms.remove(found[0])
