"""Packing documents into sequences by the sum-of-squares rule.

Pieces are dealt at random into groups of bounded size, and each group is packed by itself in one
task that holds lengths only. A group takes its pieces longest first. With N(g) open sequences whose
free room is g, a piece goes where the sum of N(g)^2 becomes smallest; of equal places it takes the
tightest. Only a piece that no open sequence has room for opens a new one: longest first, this needs
fewer sequences than weighing a new one against the open ones each time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import staged
from tidegrid.llm.tokens import pieces

#: Pieces of a group, on average.
GROUP_PIECES = 16_384


def place(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, for pieces in the order they are placed."""
    free = np.zeros(width + 1, np.int64)  # free[g]: open sequences with g left
    waiting: list[list[int]] = [[] for _ in range(width + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened, never = 0, np.int64(1) << 60
    for k, s in enumerate(lengths.tolist()):
        gap = -1
        if s < width:
            now = free[s:width]
            change = 2 * (free[: width - s] - now) + 2
            change[0] = 1 - 2 * now[0]  # a full sequence counts no more
            change[now == 0] = never
            at = int(change.argmin())
            gap = s + at if now[at] else -1
        if gap < 0:
            sequence[k], left = opened, width - s
            opened += 1
        else:
            sequence[k], left = waiting[gap].pop(), gap - s
            free[gap] -= 1
            offset[k] = width - gap
        if left:
            waiting[left].append(int(sequence[k]))
            free[left] += 1
    return sequence, offset


def pack(rows: DataFrame, width: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Staged pieces (row, length, …) with sequence_id and offset; an empty table stays empty."""
    groups = max(1, -(-rows.count() // group_pieces))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields
    ) + ", sequence_id long, offset long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        sequence, offset = place(pdf["length"].to_numpy(), width)
        return pdf.assign(sequence_id=sequence * groups + pdf["group"], offset=offset)

    return dealt.groupBy("group").applyInPandas(run, schema).drop("group")


def pack_documents(
    docs: DataFrame, path: str, width: int = 4096, end_id: int = 1, keep_ids: bool = False,
    group_pieces: int = GROUP_PIECES, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    Nulls, empty texts, cutting and repeated rows are as in ``tokens.pieces``; null ids stay null.
    Sequences hold at most ``width`` ids; sequence numbers are unique but not gapless.
    """
    rows = staged(pieces(docs, path, width, end_id, keep_ids, text, doc_id), "pieces")
    packed = pack(rows, width, group_pieces)
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
        *(["ids"] if keep_ids else []),
    )
