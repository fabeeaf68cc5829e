"""Packed token-id output: best-fit-decreasing with a segment tree over free room.

Pieces are dealt into groups of a bounded number of ids; a group is one task's work. Longest first, a
piece goes into the open sequence with the least room that holds it, found by descending a segment
tree whose leaves count open sequences per free room. Sequences are rows of an id matrix of fixed
width, padded at the end, with the cumulative lengths of their segments and the offsets at which
positions start again at 0. Overlong documents are cut and nothing is dropped, so the pieces of a
document put in order give back its ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import staged
from tidegrid.llm.tokens import pieces

#: UTF-8 bytes of text in a group, on average; about 4 million ids.
GROUP_BYTES = 12_000_000


class RoomTree:
    """Counts of open sequences by free room; a node is the number below it."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, sequence: int, sign: int = 1) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += sign
            node >>= 1
        if sign > 0:
            self.open[room].append(sequence)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, sequence) of the tightest sequence with at least this room."""
        node = self.leaves + least
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        sequence = self.open[room].pop()
        self.add(room, sequence, -1)
        return room, sequence


def best_fit(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, for pieces in the order they are placed."""
    tree = RoomTree(width)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0
    for k, n in enumerate(lengths.tolist()):
        found = tree.take(n)
        if found is None:
            found = (width, opened)
            opened += 1
        room, sequence[k] = found
        offset[k] = width - room
        if room > n:
            tree.add(room - n, found[1])
    return sequence, offset


def packed_sequences(
    docs: DataFrame, path: str, width: int = 4096, end_id: int = 1, pad_id: int = 0,
    group_bytes: int = GROUP_BYTES, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """The written sequences, one row each.

    sequence_id; doc_id, piece and start of each segment; ``cu_seqlens`` (0, the ends of the
    segments); ``position_resets`` (offsets where positions are 0 again: the starts of segments and
    of the padding); ``n_ids`` without padding; ``ids`` (``width`` little-endian unsigned integers
    of ``id_bytes`` bytes). A document is its ids and ``end_id``; a null or empty text is ``end_id``
    alone. Repeated rows are packed as often as they occur; null ids stay null. An empty table gives
    no sequence. Ids go from the scan straight to their group, so ``docs`` should be a table in files.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long") + 1)).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    rows = pieces(docs, path, width, end_id, True, text, doc_id)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"sequence_id long, doc_ids array<{id_type}>, pieces array<int>, starts array<long>,"
        " cu_seqlens array<int>, position_resets array<int>, n_ids int, id_bytes int, ids binary"
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        size = len(pdf["ids"][0]) // int(pdf["length"][0])
        sequence, offset = best_fit(pdf["length"].to_numpy(), width)
        order = np.lexsort((offset, sequence))
        pdf, sequence, offset = pdf.iloc[order], sequence[order], offset[order]
        cuts = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1], True])
        ids, lengths = pdf["ids"].tolist(), pdf["length"].to_numpy()
        doc, piece, start = pdf["doc_id"].tolist(), pdf["piece"].tolist(), pdf["start"].tolist()
        pad = int(pad_id).to_bytes(size, "little")
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            used = int(offset[b - 1] + lengths[b - 1])
            resets = offset[a:b].tolist() + ([used] if used < width else [])
            known = [None if pd.isna(x) else x for x in doc[a:b]]
            out.append((
                int(sequence[a]) * groups + int(pdf["group"].iloc[0]), known, piece[a:b], start[a:b],
                [*offset[a:b].tolist(), used], resets, used, size,
                b"".join(ids[a:b]) + pad * (width - used),
            ))
        names = [x.split()[0] for x in schema.split(", ")]
        return pd.DataFrame(out, columns=names)

    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return staged(dealt.groupBy("group").applyInPandas(run, schema), "sequences")


def segments(sequences: DataFrame) -> DataFrame:
    """The pieces read back from written sequences: doc_id, piece, start, length, ids_crc32 (of the
    ids as unsigned 32-bit integers), sequence_id and offset."""
    id_type = sequences.schema["doc_ids"].dataType.elementType.simpleString()
    schema = (
        f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long,"
        " sequence_id long, offset long"
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{r['id_bytes']}").astype("<u4")
                ends = r["cu_seqlens"]
                for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    rows.append((
                        r["doc_ids"][k], r["pieces"][k], r["starts"][k], b - a,
                        zlib.crc32(ids[a:b].tobytes()), r["sequence_id"], a,
                    ))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [batch.schema.field("doc_ids").type.value_type, pa.int32(), *[pa.int64()] * 5]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names
            )

    return sequences.mapInArrow(run, schema)
