"""Alignment of two tokenizers' tokens over the bytes of the same texts.

The tokens of both sides are byte intervals. A worker sorts those of many documents together by
start and takes the running maximum of their ends: a group breaks where a start reaches it, so both
sides end there. Inside the groups every distinct start opens the stretch of bytes that one token of
each side shares, which is one link. How often an id pair is linked in the whole corpus is counted
by Spark over tables of distinct pairs of many documents (a chunk), and comes back to the documents
by the chunk, so that neither a frequent pair nor a long document gathers rows in one place.
"""

from __future__ import annotations

import re

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegrid.llm.bpe import ByteBPE, WordTable
from tidegrid.llm.common import staged

#: Bytes of the documents that are aligned together, and distinct pairs of documents in one chunk.
GROUP_BYTES, CHUNK_PAIRS = 2_000_000, 1_000_000
#: Pieces of text a worker remembers the ids of.
CACHE_PIECES = 500_000
SCHEMA = (
    "n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, pair_links binary, chunk long"
)
_ID = np.int64(1) << 32


class ByteLevel(ByteBPE):
    """Byte-level ids and their bytes; names of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.cut = None


class Pieces:
    """Ids and bytes of a sentencepiece model that puts a space before the text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        texts = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i)
            else b"" if self.model.is_control(i) or self.model.is_unknown(i)
            else p.replace("▁", " ").encode()
            for i, p in enumerate(names)
        ]
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        # no piece goes on after a space that follows something else: words can be cut by themselves
        self.by_word = not any("▁" in p.lstrip("▁") for p in names)
        self.cut = re.compile(" +[^ ]*")
        self.space = [self.model.piece_to_id("▁")]  # the model gives no ids for an empty text
        self.table = WordTable(self._learn, CACHE_PIECES)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x or self.space for x in self.model.encode([w[1:] for w in words], num_threads=1)]
        flat = np.array([i for x in ids for i in x], np.uint32)
        return flat, np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that begin with the space."""
        words = [self.cut.findall(t) if self.by_word else [t] for t in texts]
        ids, sizes = self.table.look_up([w for ws in words for w in ws])
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum([0, *map(len, words)])]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Digits:
    """The decimal text of ids with each separator behind it, in one array of bytes."""

    def __init__(self, most: int):
        texts = [b"%d%c" % (i, c) for i in range(most) for c in b",|;"]
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)


_LOADED: dict = {}


def _load(path_a: str, path_b: str):
    if (path_a, path_b) not in _LOADED:
        a, b = ByteLevel(path_a), Pieces(path_b)
        _LOADED[path_a, path_b] = a, b, Digits(max(len(a.size), len(b.size)))
    return _LOADED[path_a, path_b]


def spread(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` of the given starts and sizes, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((start - ends + size).astype(kind), size) + np.arange(total, dtype=kind)]


def _sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def coalesce(a_start, a_end, b_start, b_end):
    """(order, src, group, fresh) of the tokens of both sides that cover the same bytes.

    ``order`` sorts A's tokens and then B's by start, A first; ``src`` is 1 for B; ``group`` numbers
    the groups along that order; ``fresh`` marks the last token of each distinct start, where a
    stretch shared by one token of each side begins.
    """
    start, end = np.r_[a_start, b_start], np.r_[a_end, b_end]
    src = np.r_[np.zeros(len(a_start), np.int8), np.ones(len(b_start), np.int8)]
    order = np.lexsort((src, start))
    begin, reach = start[order], np.maximum.accumulate(end[order])
    breaks = np.r_[True, begin[1:] >= reach[:-1]] if len(order) else np.zeros(0, bool)
    fresh = np.r_[begin[1:] != begin[:-1], True] if len(order) else np.zeros(0, bool)
    return order, src[order], np.cumsum(breaks) - 1, fresh


def align_texts(texts: list[str | None], a: ByteLevel, b: Pieces, digits: Digits):
    """Columns n_a, n_b, n_groups, n_links, groups, pairs and pair_links of whole texts."""
    n = len(texts)
    raw = [b" " + t.encode() if t else b"" for t in texts]
    spaced = [" " + t if t else "" for t in texts]
    ids = [side.encode(spaced) for side in (a, b)]
    whole = b"".join(raw)
    for side, found in zip((a, b), ids, strict=True):
        joined = np.concatenate([np.zeros(0, np.uint32), *found])
        if spread(side.bytes, side.start[joined], side.size[joined]).tobytes() == whole:
            continue
        for k, want in enumerate(raw):
            if spread(side.bytes, side.start[found[k]], side.size[found[k]]).tobytes() != want:
                ids[0][k] = ids[1][k] = np.zeros(0, np.uint32)
                raw[k] = b""
        whole = b"".join(raw)
    flat = [np.concatenate([np.zeros(0, np.uint32), *x]).astype(np.int64) for x in ids]
    count = [np.fromiter(map(len, x), np.int64, n) for x in ids]
    ends = [np.cumsum(side.size[x]) for side, x in zip((a, b), flat, strict=True)]
    starts = [e - side.size[x] for side, e, x in zip((a, b), ends, flat, strict=True)]
    order, src, group, fresh = coalesce(starts[0], ends[0], starts[1], ends[1])
    both = np.r_[flat[0], flat[1]][order]
    doc = np.r_[np.repeat(np.arange(n), count[0]), np.repeat(np.arange(n), count[1])][order]
    n_groups = np.bincount(doc[np.r_[True, group[1:] != group[:-1]]], minlength=n) if len(order) else np.zeros(n, np.int64)
    # the tokens of either side that are open at each distinct start
    place = np.arange(len(order))
    open_a = np.maximum.accumulate(np.where(src == 0, place, 0))[fresh]
    open_b = np.maximum.accumulate(np.where(src == 1, place, 0))[fresh]
    at = doc[fresh]
    # document, A's id and B's id in one number, which sorts faster than three
    bits = max(len(a.size), len(b.size)).bit_length()
    if 2 * bits + n.bit_length() < 64:
        packed = np.sort((at << 2 * bits) + (both[open_a] << bits) + both[open_b])
        at, key = packed >> 2 * bits, packed & ((1 << 2 * bits) - 1)
        key = (key >> bits) * _ID + (key & ((1 << bits) - 1))
    else:
        key = both[open_a] * _ID + both[open_b]
        by = np.lexsort((key, at))
        key, at = key[by], at[by]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (at[1:] != at[:-1])]) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(key)])
    cut = np.r_[0, np.cumsum(np.bincount(at[first], minlength=n))]
    # A's ids, then B's, group by group
    by = np.argsort(group * 2 + src, kind="stable")
    g, s, text_ids, text_doc = group[by], src[by], both[by], doc[by]
    sep = np.full(len(by), 2)
    sep[:-1] = np.where(g[1:] != g[:-1], 2, np.where(s[1:] != s[:-1], 1, 0))
    index = text_ids * 3 + sep
    stream = spread(digits.bytes, digits.start[index], digits.size[index]).tobytes()
    edge = np.r_[0, np.cumsum(_sums(digits.size[index], text_doc, n))].tolist()
    names = [stream[x : max(x, y - 1)].decode() for x, y in zip(edge[:-1], edge[1:], strict=True)]
    keys, times = key[first].astype("<i8"), times.astype("<u4")
    pairs = [keys[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
    links = [times[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
    return count[0], count[1], n_groups, np.bincount(at, minlength=n), names, pairs, links


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """``docs`` with the alignment of A's tokens (byte-level BPE) and B's (sentencepiece).

    Both sides encode a space and the whole text without special tokens. New columns: ``n_a``,
    ``n_b``, ``n_groups``, ``n_links``, ``groups`` (A's ids, a bar, B's ids; groups parted by
    semicolons), ``pairs`` (the distinct linked id pairs, a << 32 | b, as little-endian 64-bit
    integers), ``pair_links`` (how many links hold each, unsigned 32-bit) and ``chunk``, a number
    that rows share whose pairs are counted together. Write the result before it is used twice:
    chunks are numbered as rows are read.

    A null or empty text, and one that either side can't give back byte by byte, has no tokens,
    groups or links. Very long texts are aligned whole. Every row stands for itself, so ties and
    repeated rows need no rule; an empty table gives an empty table. Other columns are kept, those
    with one of the new names replaced.
    """
    import pyarrow as pa

    names = StructType.fromDDL(SCHEMA).names
    # drawn against the columns of the table, not to clash with one of them
    part = next(c for c in ("part", *(f"part{k}" for k in range(len(docs.columns) + 1))) if c not in docs.columns)
    kept = [c for c in docs.columns if c not in names]
    source = docs.withColumn(part, F.spark_partition_id().cast("long"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name in kept)

    def run(batches):
        a, b, digits = _load(path_a, path_b)
        chunk = gathered = 0
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            columns, at = [[] for _ in range(7)], 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size < GROUP_BYTES):
                    size += len(texts[end] or "")
                    end += 1
                for column, values in zip(columns, align_texts(texts[at:end], a, b, digits), strict=True):
                    column.extend(values)
                at = end
            chunks = []
            for pairs in columns[5]:
                chunks.append(chunk)
                gathered += len(pairs) // 8
                if gathered >= CHUNK_PAIRS:
                    chunk, gathered = chunk + 1, 0
            base = batch.column(batch.schema.get_field_index(part))
            numbered = [p * (1 << 32) + c for p, c in zip(base.to_pylist(), chunks, strict=True)]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            new = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            old = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*old, *new, pa.array(numbered, pa.int64())], names=[*kept, *names]
            )

    return source.mapInArrow(run, fields + SCHEMA)


def chunk_pairs(aligned: DataFrame) -> DataFrame:
    """(chunk, a, b, links): the distinct pairs of each chunk, few rows for many documents."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            chunk = np.array(batch.column(0).to_pylist(), np.int64)
            sizes = np.array([len(x) // 8 for x in batch.column(1).to_pylist()], np.int64)
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")
            links = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4")
            chunk = np.repeat(chunk, sizes)
            for one in np.unique(chunk):
                mine = chunk == one
                found, index = np.unique(keys[mine], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(found), one)), pa.array(found >> 32),
                        pa.array(found & (_ID - 1)), pa.array(_sums(links[mine], index, len(found))),
                    ],
                    names=["chunk", "a", "b", "links"],
                )

    return aligned.select("chunk", "pairs", "pair_links").mapInArrow(
        run, "chunk long, a long, b long, links long"
    )


def link_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, total, best): links of each id pair in the corpus, and whether no A id has more with b."""
    total = staged(pairs.groupBy("a", "b").agg(F.sum("links").alias("total")), "link-totals")
    top = total.groupBy("b").agg(F.max("total").alias("most"))
    return total.join(top, "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))


def with_link_counts(aligned: DataFrame) -> DataFrame:
    """``aligned`` (as written) with ``n_best`` and ``count_sum``, without ``pairs`` and ``chunk``.

    ``count_sum`` adds the corpus-wide count of the pair over a row's links; ``n_best`` counts the
    links whose pair has the highest count of its B id, ties included. Rows without links have
    zeros. Columns with the new names are replaced.
    """
    import pyarrow as pa

    names = ("n_best", "count_sum")
    used = ("pairs", "pair_links", "chunk")
    kept = [c for c in aligned.columns if c not in (*names, *used)]
    aligned = aligned.select(*[f"`{c}`" for c in kept], *used)
    pairs = staged(chunk_pairs(aligned), "chunk-pairs")
    counts = link_counts(pairs)
    back = pairs.join(counts, ["a", "b"]).select("chunk", "a", "b", "total", "best")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in aligned.schema.fields if f.name in kept)

    def run(rows, counted):
        none = np.zeros(0, np.int64)  # a side without rows comes without columns
        column = lambda c: counted.column(c).to_numpy(zero_copy_only=False) if counted.num_rows else none
        keys = column("a") * _ID + column("b")
        by = np.argsort(keys, kind="stable")
        keys, total, best = keys[by], column("total")[by], column("best")[by]
        raw = rows.column("pairs").to_pylist()
        at = np.searchsorted(keys, np.frombuffer(b"".join(raw), "<i8"))
        links = np.frombuffer(b"".join(rows.column("pair_links").to_pylist()), "<u4").astype(np.int64)
        cut = np.cumsum([0, *(len(x) // 8 for x in raw)])
        sums = []
        for values in (links * best[at], links * total[at]) if len(at) else (links, links):
            run_ = np.r_[0, np.cumsum(values.astype(np.int64))]
            sums.append(pa.array(run_[cut[1:]] - run_[cut[:-1]], pa.int64()))
        return pa.Table.from_arrays([*(rows.column(c) for c in kept), *sums], names=[*kept, *names])

    return (
        aligned.groupBy("chunk").cogroup(back.groupBy("chunk"))
        .applyInArrow(run, fields + ", ".join(f"{c} long" for c in names))
    )
