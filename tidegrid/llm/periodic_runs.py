"""Periodic runs inside documents: stretches of words that repeat themselves several times over.

A worker sorts the suffixes of many documents together (prefix doubling in numpy, the ranks of every
round kept), takes the common prefixes of neighbours from those ranks, and then goes through the
neighbours by decreasing common prefix, as Kruskal's method goes through edges: a union-find joins
the two classes of suffixes, each of which holds its positions in order. Two positions that become
neighbours in a class at a distance within the common prefix are a seed of a run. Documents never
meet each other, so Spark only deals rows out; nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import with_columns

#: Words of the documents whose suffixes are sorted together.
GROUP_WORDS = 400_000
RUN_SCHEMA = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def suffix_ranks(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix order of documents in a row, and the rank of every position in each round.

    ``symbols`` are ids from 1, with a 0 after the last word of each document; ``doc`` numbers the
    documents. Positions have equal ranks in round k if their next 2^k symbols are equal and in the
    same document. Only positions that share their rank are sorted further.
    """
    n = len(symbols)
    key = doc.astype(np.int64) * (int(symbols.max(initial=0)) + 1) + symbols
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def regroup(slots: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
        """New ranks, by slot, and the slots that still share theirs."""
        fresh = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))
        rank[order[slots]] = slots[first]
        return slots[~(fresh & np.r_[fresh[1:], True])]

    slots, rounds, width = np.arange(n), [], 1
    if n:
        slots = regroup(slots, key[order])
        rounds.append(rank.copy())
    while len(slots):
        at = order[slots]
        key = rank[at] * n + rank[at + width]
        by = np.argsort(key, kind="stable")
        order[slots] = at[by]
        slots = regroup(slots, key[by])
        width *= 2
        rounds.append(rank.copy())
    return order, rounds


def common_prefixes(a: np.ndarray, b: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
    """Number of symbols that the suffixes at ``a`` and ``b`` share, pair by pair."""
    out = np.zeros(len(a), np.int64)
    last = len(rounds[0]) - 1 if rounds else 0
    for k in range(len(rounds) - 1, -1, -1):
        same = rounds[k][np.minimum(a + out, last)] == rounds[k][np.minimum(b + out, last)]
        out += np.where(same, 1 << k, 0)
    return out


def kruskal_seeds(left: list, right: list, shared: list, min_length: int, min_exponent: int) -> dict:
    """(end, period) -> the smallest start seen, from neighbours by decreasing common prefix.

    Any two positions of different classes that a step joins share exactly ``shared`` symbols, so a
    pair (i, i + q) tells the end of its run; the run's own start is one of the pairs, because no
    third position can lie between it and the start one period on.
    """
    boss: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    found: dict[tuple[int, int], int] = {}

    def find(x: int) -> int:
        root = x
        while (up := boss.setdefault(root, root)) != root:
            root = up
        while boss[x] != root:
            boss[x], x = root, boss[x]
        return root

    for a, b, size in zip(left, right, shared, strict=True):
        a, b = find(a), find(b)
        big, small = members.setdefault(a, [a]), members.setdefault(b, [b])
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        boss[b] = a
        reach = min(size // (min_exponent - 1), size)
        least = min_length - size
        before = -1
        for x in small:
            at = bisect_left(big, x)
            if at and big[at - 1] != before:
                i = big[at - 1]
                if least <= x - i <= reach:
                    mark = (x + size, x - i)
                    if found.get(mark, x) > i:
                        found[mark] = i
            if at < len(big) and least <= big[at] - x <= reach:
                mark = (big[at] + size, big[at] - x)
                if found.get(mark, big[at]) > x:
                    found[mark] = x
            big.insert(at, x)
            before = x
        del members[b]
    return found


def find_runs(words: list[list[bytes]], min_length: int, min_exponent: int) -> list[list[tuple]]:
    """The runs (start, length, period) of each document, by start and then period."""
    out: list[list[tuple]] = [[] for _ in words]
    ids: dict[bytes, int] = {}
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    symbols = np.zeros(int(sizes.sum()), np.int64)
    begin = np.cumsum(sizes) - sizes
    for k, ws in enumerate(words):
        symbols[begin[k] : begin[k] + len(ws)] = [ids.setdefault(w, len(ids) + 1) for w in ws]
    doc = np.repeat(np.arange(len(words)), sizes)
    order, rounds = suffix_ranks(symbols, doc)
    # a run of period q shares length - q >= (1 - 1 / exponent) * length symbols with itself
    least = min_length - min_length // min_exponent
    a, b = order[:-1], order[1:]
    for k in range(len(rounds)):
        if 1 << k <= least:
            near = rounds[k][a] == rounds[k][b]
            a, b = a[near], b[near]
    shared = common_prefixes(a, b, rounds)
    near = np.flatnonzero(shared >= least)
    near = near[np.argsort(-shared[near], kind="stable")]
    found = kruskal_seeds(
        a[near].tolist(), b[near].tolist(), shared[near].tolist(), min_length, min_exponent
    )
    longest: dict[int, int] = {}
    for end, period in sorted(found):  # of the same end: by period
        start = found[end, period]
        # a multiple of a shorter period that reaches as far to the left is no smallest period
        if longest.get(end, start + 1) <= start:
            continue
        longest[end] = start
        if end - start >= max(min_length, min_exponent * period):
            k = int(doc[start])
            out[k].append((int(start - begin[k]), int(end - start), int(period)))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep, at = [], 0
    for start, end in sorted((s + q, s + size) for s, size, q in runs):
        keep += words[at:start]
        at = max(at, end)
    return b" ".join(keep + words[at:])


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are cut at ASCII white space and numbered from 0. A run is a stretch of at least
    ``min_length`` words and ``min_exponent`` (two or more) times its smallest period that neither
    neighbouring word extends. ``collapsed`` keeps each run's first period, words joined by one space.

    A null, empty or blank text has no runs and an empty ``collapsed``. Very long texts are handled
    whole, one at a time; memory is a small multiple of the text. Every row stands for itself, so
    ties and repeated rows need no rule; an empty table gives an empty table. Other columns are kept,
    those named ``runs`` or ``collapsed`` are replaced.
    """
    import pyarrow as pa

    if min_length < 2 or min_exponent < 2:
        raise ValueError("runs have at least two words and two periods")
    fields = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))

    def run(batch):
        words = [(t or "").encode().split() for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        runs, group, gathered = [], [], 0
        for ws in words:
            group.append(ws)
            gathered += len(ws)
            if gathered >= GROUP_WORDS:
                runs += find_runs(group, min_length, min_exponent)
                group, gathered = [], 0
        runs += find_runs(group, min_length, min_exponent)
        kept = [collapse(w, r).decode() for w, r in zip(words, runs, strict=True)]
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
        return [pa.array(rows, fields), pa.array(kept, pa.string())]

    return with_columns(docs, RUN_SCHEMA, run)


def longest_run(runs: str = "runs"):
    """The longest of a row's runs (of equal length: smallest start, then period), or null."""
    return F.array_max(
        F.transform(runs, lambda r: F.struct(r.length, -r.start, -r.period))
    )
