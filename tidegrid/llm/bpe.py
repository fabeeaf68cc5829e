"""Byte-level BPE from a vocabulary file: batched merge rounds in numpy, and the way back.

A worker splits a batch of texts into words, looks them up in a bounded cache and encodes those it
doesn't know together: their symbols stand in one flat array. In a round every word merges its pair
of lowest rank, wherever it occurs; ranks come from hash tables of the pair keys. Words without a
known pair leave the array. Spark carries batches of rows; nothing is shuffled.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections import defaultdict
from itertools import count, islice

import numpy as np
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidegrid.llm.common import with_columns

#: The pattern that cuts a text into words (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a worker remembers; it forgets all of them when there are more.
CACHE_WORDS = 1_000_000
#: Words of one text handled at a time.
CHUNK_WORDS = 200_000
_NONE = np.int64(1) << 62
#: Bits of a slot number in the tables of pair keys.
SLOT_BITS = 20


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(0x100 + k)
    return out


def unassigned() -> np.ndarray:
    """True at the code points that Python's Unicode tables don't know.

    Libraries differ in what they know of the latest letters, so parts with one of these are cut by
    the tokenizers library itself.
    """
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


class Merges:
    """Pair keys of a merge list, with each pair's rank and merged id."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        _, first = np.unique(keys, return_index=True)  # a pair listed twice keeps its first rank
        self.keys, self.rank = keys[first], first.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[first]
        # a key has a slot of its own in the first table or, where another took it, in a later one
        places = np.arange(len(self.keys), dtype=np.int32)
        self.factors, self.slots = [], []
        odd = 0x9E3779B97F4A7C15
        while len(places):
            factor = np.uint64(odd)
            slots = np.zeros(1 << SLOT_BITS, np.int32)
            at = self._slot(self.keys[places], factor)
            slots[at] = places
            places = places[slots[at] != places]
            self.factors.append(factor)
            self.slots.append(slots)
            odd = odd * 0xBF58476D1CE4E5B9 % (1 << 64)

    @staticmethod
    def _slot(key: np.ndarray, factor: np.uint64) -> np.ndarray:
        return (key.astype(np.uint64) * factor) >> np.uint64(64 - SLOT_BITS)

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key in ``keys``, and whether it has one."""
        at, known = np.zeros(len(key), np.int32), np.zeros(len(key), bool)
        left = np.arange(len(key))
        for factor, slots in zip(self.factors, self.slots, strict=True):
            found = slots[self._slot(key[left], factor)]
            at[left] = found
            hit = self.keys[found] == key[left]
            known[left] = hit
            left = left[~hit]
        return at, known

    def encode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of many words in a row -> their merged ids and lengths, word by word."""
        done_ids, done_words = [], []
        word = np.repeat(np.arange(len(lengths)), lengths)
        ids = ids.astype(np.int64)
        while len(ids):
            rank, place = np.full(len(ids), _NONE), np.zeros(len(ids), np.int64)
            near = np.flatnonzero(word[:-1] == word[1:])
            key = ids[near] << 32 | ids[near + 1]
            at, known = self._find(key)
            rank[near[known]], place[near[known]] = self.rank[at[known]], at[known]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[starts, len(ids)])
            least = np.repeat(np.minimum.reduceat(rank, starts), size)
            over = least == _NONE
            done_ids.append(ids[over])
            done_words.append(word[over])
            merge = (rank == least) & ~over
            run = np.flatnonzero(merge)
            if len(run):  # of pairs that overlap (aaa) every second one merges
                fresh = np.r_[True, np.diff(run) > 1]
                begin = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
                odd = (np.arange(len(run)) - begin) % 2 == 1
                run = run[~odd]
            ids[run] = self.merged[place[run]]
            keep = ~over
            keep[run + 1] = False
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate([*done_ids, ids]), np.concatenate([*done_words, word])
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(word, minlength=len(lengths))


def spread(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` of the given starts and sizes, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - ends + size, size) + np.arange(total)]


class WordTable:
    """Ids of known words in flat arrays; ``learn`` gives those of many new words at once."""

    def __init__(self, learn, most: int = CACHE_WORDS):
        self.learn, self.most = learn, most
        self.clear()

    def clear(self):
        self.place: dict = defaultdict(count().__next__)  # a word not seen yet gets the next number
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def _add(self, words: list, n: int) -> None:
        """Learn ``words``, which have the numbers from ``n`` on."""
        ids, sizes = self.learn(words)
        m = len(words)
        while n + m > len(self.start):
            self.start, self.size = (np.r_[a, np.zeros_like(a)] for a in (self.start, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        self.size[n : n + m] = sizes
        self.start[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def look_up(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a list of words, one after the other, and each word's number of ids.

        New words are learned together; if they are too many the others are forgotten first.
        """
        n = len(self.place)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        new = len(self.place) - n
        if new:
            if n and n + new > self.most:
                self.clear()
                return self.look_up(words)
            try:
                self._add(list(islice(reversed(self.place), new))[::-1], n)
            except BaseException:
                self.clear()  # numbers without ids must not stay
                raise
        return spread(self.flat, self.start[at], self.size[at]), self.size[at]


class TokenBytes:
    """Decoder of a byte-level vocabulary file (tokenizer.json); holds nothing but tokens' bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self._read(json.load(f))

    def _read(self, spec: dict) -> None:
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in byte_symbols().items()}
        texts = {i: bytes(back[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        texts |= {i: t.encode() for t, i in self.special.items()}
        size = np.zeros(max(texts) + 1, np.int64)
        for i, t in texts.items():
            size[i] = len(t)
        self.size, self.start = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(texts.get(i, b"") for i in range(len(size))), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens as their names; broken UTF-8 becomes U+FFFD."""
        raw = spread(self.bytes, self.start[ids], self.size[ids])
        return raw.tobytes().decode("utf-8", "replace")


class ByteBPE(TokenBytes):
    """Encoder and decoder of a byte-level vocabulary file (tokenizer.json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._read(spec)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.first = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.merges = Merges(vocab, spec["model"]["merges"])
        self.pattern = regex.compile(PATTERN)
        self.unassigned = unassigned()
        self.library = Tokenizer.from_file(path).pre_tokenizer
        by_length = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, by_length))) if by_length else None
        self.table = WordTable(self._learn)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        return self.merges.encode(self.first[flat], np.fromiter(map(len, raw), np.int64, len(raw)))

    def _pieces(self, text: str):
        """Parts of a text with the special token that follows each, or None."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield text[at : m.start()], self.special[m.group()]
            at = m.end()
        yield text[at:], None

    def _words(self, part: str):
        """The words of a part in lists of at most CHUNK_WORDS."""
        if not part.isascii() and self.unassigned[np.frombuffer(part.encode("utf-32-le"), "<u4")].any():
            found = (part[i:j] for _, (i, j) in self.library.pre_tokenize_str(part))
        elif len(part) < CHUNK_WORDS:
            yield self.pattern.findall(part)
            return
        else:
            found = (m.group() for m in self.pattern.finditer(part))
        while words := list(islice(found, CHUNK_WORDS)):
            yield words

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text as unsigned 32-bit integers; null is the empty text.

        Words are looked up together once CHUNK_WORDS have gathered, so that a round works on many.
        """
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []

        def look_up():
            words = [w for _, ws in waiting for w in ws]
            ids, sizes = self.table.look_up(words)
            ends, at = np.r_[0, np.cumsum(sizes)], 0
            for k, ws in waiting:
                out[k].append(ids[ends[at] : ends[at + len(ws)]])
                at += len(ws)
            waiting.clear()

        gathered = 0
        for k, text in enumerate(texts):
            for part, special in self._pieces(text or ""):
                for words in self._words(part):
                    waiting.append((k, words))
                    gathered += len(words)
                    if gathered >= CHUNK_WORDS:
                        look_up()
                        gathered = 0
                if special is not None:
                    look_up()
                    gathered = 0
                    out[k].append(np.array([special], np.uint32))
        look_up()
        return [np.concatenate([np.zeros(0, np.uint32), *x]) for x in out]


_LOADED: dict[str, ByteBPE] = {}
_DECODERS: dict[str, TokenBytes] = {}


def load(path: str) -> ByteBPE:
    """The worker's encoder for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def load_decoder(path: str) -> TokenBytes:
    """The worker's decoder for a vocabulary file; a worker that only decodes holds no encoder."""
    if path not in _DECODERS:
        _DECODERS[path] = TokenBytes(path)
    return _DECODERS[path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers).

    A null or empty text has no ids. Every row is encoded by itself, so ties and repeated rows need
    no rule; columns of ``docs`` with one of the new names are replaced.
    """
    import pyarrow as pa

    def run(batch):
        bpe = load(path)
        ids = bpe.encode(batch.column(batch.schema.get_field_index(text)).to_pylist())
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
        ]

    return with_columns(docs, "n_tokens long, ids binary", run)


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text of the column ``ids``; null ids give an empty text."""
    import pyarrow as pa

    def run(batch):
        bpe = load_decoder(path)
        column = batch.column(batch.schema.get_field_index(ids))
        texts = [bpe.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in column]
        return [pa.array(texts, pa.string())]

    return with_columns(tokens, "decoded string", run)
