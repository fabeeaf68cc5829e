"""Documents as pieces of token ids, for the operators that pack them.

Ids are those of the tokenizers library for a word-level vocabulary file that drops white space. A
worker cuts texts at white space, remembers the ids of words it has seen and finds those of the rest.
Words of plain Latin letters are lower-cased and cut by the file's own pattern first, so that each
piece is merged once: short ones together (``bpe.Merges``), long ones by the library's model. All
other words go through the whole library.
"""

from __future__ import annotations

import json
import re
import zlib
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegrid.llm.bpe import Merges, WordTable, byte_symbols

#: The pattern of the vocabulary file (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words handled together, and pieces a worker remembers.
CHUNK_WORDS, CACHE_PIECES = 200_000, 500_000
#: Bytes up to which pieces are merged together; rounds over a longer one would each pass all of it.
SHORT_PIECE = 64
#: Unicode white space; str.split() would also cut at U+001C to U+001F.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of whole texts by a word-level vocabulary file."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.symbols = {b: ord(c) for b, c in byte_symbols().items()}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        vocab, end = spec["vocab"], spec["end_of_word_suffix"] or ""
        self.merges = Merges(vocab, spec["merges"])
        self.inner, self.last = (
            np.array([vocab[c + x] for _, c in sorted(byte_symbols().items())], np.int64) for x in ("", end)
        )
        # Latin letters that lower-case one by one and have no other composed form
        self.plain = re.compile("[\x00-įı-ɏ]+")
        self.words = re.compile(f"[^{_SPACE}]+")
        self.lines = regex.compile("\n|" + PATTERN.replace("[^\\s", "[^\n\\s"))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = WordTable(self._learn_pieces, CACHE_PIECES)
        self.table = WordTable(self._learn)

    def _learn_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [b"" if p == "\n" else p.encode() for p in new]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        if (long := np.flatnonzero(size > SHORT_PIECE)).size:
            for k in long.tolist():
                raw[k] = b""
        short = np.where(size > SHORT_PIECE, 0, size)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols, ends = self.inner[flat], np.cumsum(short)[short > 0] - 1
        symbols[ends] = self.last[flat[ends]]
        ids, size = self.merges.encode(symbols, short)
        if not long.size:
            return ids, size
        parts = np.split(ids, np.cumsum(size)[:-1])
        for k in long.tolist():
            mapped = new[k].encode().decode("latin-1").translate(self.symbols)
            parts[k] = np.array([t.id for t in self.model.tokenize(mapped)], np.uint32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words: plain words in one go, a word with other characters by itself."""
        joined = "\n".join(words)
        if not self.plain.fullmatch(joined) or any(s in joined for s in self.special):
            odd = [
                not self.plain.fullmatch(w) or "\n" in w or any(s in w for s in self.special)
                for w in words
            ]
            if all(odd):
                found = [self.library.encode(w, add_special_tokens=False).ids for w in words]
                flat = np.fromiter(chain.from_iterable(found), np.uint32)
                return flat, np.fromiter(map(len, found), np.int64, len(found))
            out = [np.zeros(0, np.uint32)] * len(words)
            for value in (False, True):
                chosen = [k for k, x in enumerate(odd) if x == value]
                ids, sizes = self._learn([words[k] for k in chosen])
                for k, part in zip(chosen, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    out[k] = part
            return np.concatenate(out), np.array([len(x) for x in out], np.int64)
        found = self.lines.findall(joined.lower())
        ids, sizes = self.pieces.look_up(found)
        # the end of a word is a piece without ids
        breaks = np.r_[np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found))), len(found)]
        ends = np.r_[0, np.cumsum(sizes)][breaks]
        return ids, np.diff(np.r_[0, ends])

    def _cut(self, text: str) -> list[str]:
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return self.words.findall(text)
        return text.split()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text; null is the empty text."""
        words = self._cut(text or "")
        out = [np.zeros(0, np.uint32)]
        for at in range(0, len(words), CHUNK_WORDS):
            part = words[at : at + CHUNK_WORDS]
            out.append(self.table.look_up(part)[0])
        return np.concatenate(out)

    def encode_all(self, texts: list[str | None]):
        """Ids of each text in turn; words of several texts are looked up together."""
        group, gathered = [], 0
        for text in [*texts, None]:
            words = self._cut(text) if text and len(text) < CHUNK_WORDS else None
            if words is not None:
                group.append(words)
                gathered += len(words)
                if gathered < CHUNK_WORDS:
                    continue
            if group:
                flat = [w for ws in group for w in ws]
                ids, sizes = self.table.look_up(flat)
                ends, at = np.r_[0, np.cumsum(sizes)], 0
                for ws in group:
                    yield ids[ends[at] : ends[at + len(ws)]]
                    at += len(ws)
                group, gathered = [], 0
            if words is None:
                yield self.encode(text)


_LOADED: dict[str, WordIds] = {}


def load(path: str) -> WordIds:
    """The worker's encoder for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def pieces(
    docs: DataFrame, path: str, width: int, end_id: int, keep_ids: bool, text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Rows (row, doc_id, piece, start, length, ids_crc32[, ids]) of all documents.

    A document is its ids and ``end_id``; only longer ones are cut, every ``width`` ids. A null or
    empty text is ``end_id`` alone. ``row`` is unique, so rows that repeat a document stay apart. It
    follows the order of rows in ``docs``: with a table in files a task that runs again gives the
    same numbers. ``ids`` are little-endian unsigned 16-bit integers where the
    vocabulary allows it, else 32-bit. Other columns are dropped.
    """
    import pyarrow as pa

    kind = F.col(f"`{doc_id}`").alias("doc_id")
    source = docs.select(kind, F.col(f"`{text}`").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {PIECE_SCHEMA}" + (", ids binary" if keep_ids else "")

    def run(batches):
        words = load(path)
        store = "<u2" if max(words.library.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, ids in enumerate(words.encode_all(batch.column(1).to_pylist())):
                if k == batch.num_rows:
                    break
                ids = np.concatenate([ids, end])
                for j, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append(k)
                    piece.append(j)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                    if keep_ids:
                        kept.append(part.astype(store).tobytes())
            out = [
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
