"""Repeated passages between and inside documents, found by recompression.

Documents are numbered in chunks of about CHUNK_BYTES. A worker recompresses the words of a chunk
(``recompression``): equal passages get equal symbols except near their ends. Each window of words is
stood for by one symbol that its own words decide, wherever the window occurs, and windows in a row
with the same symbol are a bundle. A first Spark round brings the bundles of a symbol together:
symbols that occur once reveal windows that can't be repeated, and a bundle with the words of an
earlier one is repeated as a whole. Only where bundles of a symbol differ, at the ends of repeats,
a second round compares single windows. Both rounds send a bundle or window once for each chunk that
holds it, so that thousands of copies of a passage cost a row per chunk and no pairs are formed.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import fresh_names, staged
from tidegrid.llm.recompression import levels, mix

#: Bytes of text in one chunk; a longer text is a chunk by itself.
CHUNK_BYTES = 4_000_000
#: Odd bases of the two polynomial hashes.
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_EMPTY = hashlib.sha256(b"").hexdigest()


class Hashes:
    """Hashes of stretches of a word sequence, from running sums modulo 2^64."""

    def __init__(self, names: np.ndarray, base: int):
        n = len(names)
        power = np.full(n + 1, base, np.uint64)
        back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        power[0] = back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(names * np.cumprod(power)[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


class Chunk:
    """The words of several texts in a row, with a gap after each text."""

    def __init__(self, texts: list[bytes], window: int):
        self.words = [t.split() for t in texts]
        self.window = window
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.begin = np.cumsum(self.size + 1) - self.size - 1
        total = int((self.size + 1).sum())
        ids: dict[bytes, int] = {b"": 0}  # no word is empty: 0 is the gap
        flat = np.zeros(total, np.int64)
        for at, ws in zip(self.begin.tolist(), self.words, strict=True):
            flat[at : at + len(ws)] = [ids.setdefault(w, len(ids)) for w in ws]
        raw = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in ids)
        names = np.frombuffer(raw, "<u8").reshape(-1, 2)[flat]
        self.wall = flat == 0
        self.names = np.ascontiguousarray(names[:, 0])
        self.hashes = [Hashes(np.ascontiguousarray(names[:, k]), b) for k, b in enumerate(_BASES)]
        doc = np.repeat(np.arange(len(texts)), np.maximum(self.size - window + 1, 0))
        #: Windows by document and place: number of the text, place in it, place in the chunk.
        self.doc = doc
        count = np.maximum(self.size - window + 1, 0)
        self.place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        self.at = self.begin[doc] + self.place if len(doc) else np.zeros(0, np.int64)

    def symbols(self, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, mark) of the symbol that stands for each window; equal marks are one occurrence.

        Of the highest round with a symbol that the window decides, that of the smallest hash. The
        key is a hash of its name and of the words that decide it.
        """
        window, n = self.window, len(self.names)
        key, mark = np.zeros(len(self.at), np.uint64), np.zeros(len(self.at), np.int64)
        todo = np.arange(len(self.at))
        steps = list(levels(self.names, self.wall, rounds))
        for turn in range(rounds, -1, -1):
            s = steps.pop()
            if not len(todo):
                continue
            fits = np.flatnonzero((s.right - s.left <= window) & (s.left >= 0) & (s.right <= n) & ~s.wall)
            fits = fits[np.argsort(-s.right[fits], kind="stable")]
            reach, which = np.full(n + window, n + window + 1), np.zeros(n + window, np.int64)
            reach[s.left[fits]], which[s.left[fits]] = s.right[fits], fits
            order = mix(s.name)
            at = self.at[todo]
            least, best = np.zeros(len(todo), np.uint64), np.full(len(todo), -1)
            for k in range(window):
                symbol = which[at + k]
                value = order[symbol]
                better = (reach[at + k] <= at + window) & ((best < 0) | (value < least))
                least, best = np.where(better, value, least), np.where(better, symbol, best)
            known = best >= 0
            found, chosen = best[known], todo[known]
            key[chosen] = mix(self.hashes[0](s.left[found], s.right[found]) ^ mix(s.name[found]))
            mark[chosen] = found * (rounds + 1) + turn
            todo = todo[~known]
        return key, mark


def rounds_for(window: int) -> int:
    """Rounds after which most windows still decide a symbol (each makes symbols a third longer)."""
    return max(0, int(math.log(max(window, 1) / 6, 4 / 3))) if window > 6 else 0


def _texts(table, text: str) -> list[bytes]:
    return [(t or "").encode() for t in table.column(text).to_pylist()]


def _numbers(table, column: str) -> np.ndarray:
    """A column of one side of a cogroup; a side without rows comes without columns."""
    return table.column(column).to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, np.int64)


def _column(table, name: str) -> list:
    return table.column(name).to_pylist() if table.num_rows else []


def _ranges(parts: list[tuple[int, int]]) -> np.ndarray:
    """All numbers of (start, size) stretches."""
    if not parts:
        return np.zeros(0, np.int64)
    start, size = np.array(parts, np.int64).T
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _by_id(table, doc_id: str, row: str) -> list[int]:
    """Rows of a chunk by id (null last), then as they were read."""
    ids, rows = table.column(doc_id).to_pylist(), table.column(row).to_pylist()
    return sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k], rows[k]))


def _finish(words: list[bytes], starts: np.ndarray, window: int, digest: bool):
    """(removed words, kept text or its digest) when the windows at ``starts`` are repeats."""
    if not len(starts):
        kept, removed = words, 0
    else:
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
        keep = np.cumsum(edge)[:-1] == 0
        kept, removed = [words[k] for k in np.flatnonzero(keep).tolist()], int((~keep).sum())
    text = b" ".join(kept)
    return removed, hashlib.sha256(text).hexdigest() if digest else text.decode()


def numbered(docs: DataFrame, text: str, chunk: str, row: str) -> DataFrame:
    """``docs`` with the number of a chunk and the place in it; the same whenever files are read again."""
    import pyarrow as pa

    names = docs.columns
    source = docs.withColumn(chunk, F.spark_partition_id().cast("long"))

    def run(batches):
        turn = place = gathered = 0
        for batch in batches:
            chunks, rows = [], []
            for t in batch.column(batch.schema.get_field_index(text)):
                if gathered >= CHUNK_BYTES:
                    turn, place, gathered = turn + 1, 0, 0
                chunks.append(turn)
                rows.append(place)
                place += 1
                gathered += len(t.as_py() or "") + 1
            part = batch.column(batch.schema.get_field_index(chunk)).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(c)) for c in names),
                    pa.array([p * (1 << 32) + c for p, c in zip(part, chunks, strict=True)], pa.int64()),
                    pa.array(rows, pa.int64()),
                ],
                names=[*names, chunk, row],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return source.mapInArrow(run, f"{fields}, `{chunk}` long, `{row}` long")


def bundles(rows: DataFrame, text: str, doc_id: str, chunk: str, row: str, window: int, rounds: int) -> DataFrame:
    """(chunk, row, doc_id, place, size, key, words, n, again): the distinct bundles of each chunk.

    ``place`` and ``size`` are the first window and the number of windows of the first occurrence in
    the chunk, ``key`` names the symbol, ``words`` is a hash of all words of the bundle, and
    ``again`` holds (row, place) of the other occurrences in the chunk.
    """
    import pyarrow as pa

    id_type = rows.schema[doc_id].dataType.simpleString()

    def bundle(number: int, parts: list):
        table = pa.Table.from_batches(parts)
        by = _by_id(table, doc_id, row)
        c = Chunk([(t or "").encode() for t in table.column(text).take(pa.array(by, pa.int64())).to_pylist()], window)
        key, mark = c.symbols(rounds)
        m = len(key)
        first = np.flatnonzero(np.r_[True, (mark[1:] != mark[:-1]) | (c.doc[1:] != c.doc[:-1])][:m])
        size = np.diff(np.r_[first, m])
        key, at = key[first], c.at[first]
        words = mix(c.hashes[1](at, at + size - 1 + window) ^ mix(size.astype(np.uint64)))
        order = np.lexsort((words, key))  # stable: equal bundles stay in order
        fresh = np.r_[True, (key[order][1:] != key[order][:-1]) | (words[order][1:] != words[order][:-1])][:len(order)]
        heads = np.flatnonzero(fresh)
        n = np.diff(np.r_[heads, len(order)])
        number_of = np.array(table.column(row).to_pylist(), np.int64)[by] if by else np.zeros(0, np.int64)
        doc, place = c.doc[first], c.place[first]
        spots = np.column_stack([number_of[doc], place])[order].astype("<u4") if m else np.zeros((0, 2), "<u4")
        again = [
            spots[h + 1 : h + k].tobytes() if k > 1 else None for h, k in zip(heads.tolist(), n.tolist(), strict=True)
        ]
        kept = order[heads]
        ids = table.column(doc_id).take(pa.array(by, pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(kept), number, np.int64)), pa.array(number_of[doc[kept]]),
                ids.take(pa.array(doc[kept], pa.int64())), pa.array(place[kept]), pa.array(size[kept]),
                pa.array(key[kept].view(np.int64)), pa.array(words[kept].view(np.int64)),
                pa.array(n.astype(np.int64)), pa.array(again, pa.binary()),
            ],
            names=["chunk", "row", "id", "place", "size", "key", "words", "n", "again"],
        )

    def run(batches):
        now, parts = None, []
        for batch in batches:
            numbers = np.array(batch.column(0).to_pylist(), np.int64)
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if numbers[x] != now and parts:
                    yield bundle(now, parts)
                    parts = []
                now = int(numbers[x])
                parts.append(batch.slice(x, y - x))
        if parts:
            yield bundle(now, parts)

    source = rows.select(*(F.col(f"`{c}`") for c in (chunk, row, doc_id, text)))
    return source.mapInArrow(
        run,
        f"chunk long, row long, id {id_type}, place long, size long, key long, words long, n long, again binary",
    )


def repeated_bundles(found: DataFrame) -> DataFrame:
    """The bundles that say something: repeats of an earlier one, and those to compare by windows.

    ``later`` marks bundles whose words start earlier; ``open`` the first occurrence of bundles whose
    symbol also stands for other windows. Others stay only for their occurrences ``again``.
    """
    of_key = Window.partitionBy("key")
    in_order = Window.partitionBy("key", "words").orderBy(F.col("id").asc_nulls_last(), "chunk", "row", "place")
    counted = found.withColumns({
        "all": F.sum("n").over(of_key), "lo": F.min("words").over(of_key), "hi": F.max("words").over(of_key),
    }).where("all > 1")
    told = counted.withColumn("later", F.row_number().over(in_order) > 1).withColumn(
        "open", ~F.col("later") & (F.col("lo") != F.col("hi"))
    )
    return told.where("later OR open OR again IS NOT NULL").select(
        "chunk", "row", "place", "size", "again", "later", "open"
    )


def drop_repeats(
    docs: DataFrame, window: int = 20, text: str = "text", doc_id: str = "doc_id", digest: bool = False,
    rounds: int | None = None,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``, the text without repeated passages.

    Words are cut at ASCII white space. A word is removed if a window of ``window`` words around it
    also starts earlier: in a document of a smaller id, or earlier in the same one. Windows are
    judged on the input. ``kept`` holds the other words, joined by one space; with ``digest`` it is
    replaced by ``kept_sha256``, so that no second copy of the corpus is written. ``docs`` should be
    a table in files, because it is read twice and rows are numbered as they are read.

    Null, empty and short texts have no windows and lose nothing. Of rows with equal ids, those read
    first come first; ids that are null come last. A text is handled whole, at about 150 bytes of
    memory a word; a text longer than a chunk is one by itself. An empty table gives an empty table.
    Other columns are kept, those with one of the new names replaced.
    """
    import pyarrow as pa

    if window < 1:
        raise ValueError("a window has at least one word")
    rounds = rounds_for(window) if rounds is None else rounds
    last = "kept_sha256" if digest else "kept"
    docs = docs.drop(*(c for c in ("n_words", "n_removed", last) if c != text))
    columns = docs.columns
    chunk, row, local, place, h1, h2 = fresh_names(
        [*columns, "n_words", "n_removed", last], "chunk", "row", "local", "place", "h1", "h2"
    )
    rows = numbered(docs, text, chunk, row)
    told = repeated_bundles(bundles(rows, text, doc_id, chunk, row, window, rounds))
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    new = {
        chunk: "long", row: "long", "n_words": "long", "n_removed": "long", last: "string",
        local: "binary", place: "long", h1: "long", h2: "long",
    }
    both = [c for c in columns if c != last]
    schema = ", ".join(f"`{c}` {t}" for c, t in {**{c: types[c] for c in both}, **new}.items())

    def verify(table, told):
        table = table.take(pa.array(_by_id(table, doc_id, row), pa.int64()))
        where = {r: k for k, r in enumerate(table.column(row).to_pylist())}
        starts: dict[int, list] = {}
        waits: dict[int, list] = {}
        for r, p, size, again, later, open_ in zip(
            *(_column(told, c) for c in ("row", "place", "size", "again", "later", "open")), strict=True
        ):
            if later:
                starts.setdefault(where[r], []).append((p, size))
            if open_:
                waits.setdefault(where[r], []).append((p, size))
            if again:
                for x, y in np.frombuffer(again, "<u4").reshape(-1, 2).tolist():
                    starts.setdefault(where[x], []).append((y, size))
        texts = _texts(table, text)
        chosen = sorted(waits)
        c = Chunk([texts[k] for k in chosen], window)
        parts = [(c.begin[j] + p, size) for j, k in enumerate(chosen) for p, size in sorted(waits[k])]
        at = _ranges(parts)
        doc = np.repeat(np.searchsorted(c.begin, [p for p, _ in parts], "right") - 1, [n for _, n in parts])
        a, b = (h(at, at + window).view(np.int64) for h in c.hashes)
        by = np.lexsort((b, a))  # stable: equal windows stay in order
        fresh = np.r_[True, (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])][:len(by)]
        ahead, again = np.sort(by[fresh]), np.sort(by[~fresh])
        place_ = at - c.begin[doc] if len(at) else at
        for j, p in zip(doc[again].tolist(), place_[again].tolist(), strict=True):
            starts.setdefault(chosen[j], []).append((p, 1))
        sizes, removed, kept, own = [], [], [], []
        for k, raw in enumerate(texts):
            words, mine = raw.split(), _ranges(starts.get(k, []))
            sizes.append(len(words))
            r, text_left = (None, None) if k in waits else _finish(words, mine, window, digest)
            removed.append(r)
            kept.append(text_left)
            own.append(mine.astype("<u4").tobytes() if k in waits else None)
        old = table.column(text).combine_chunks()
        data = {
            **{x: table.column(x).combine_chunks() for x in (*both, chunk, row)},
            "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            last: pa.array(kept, pa.string()), local: pa.array(own, pa.binary()),
            place: pa.nulls(len(texts), pa.int64()), h1: pa.nulls(len(texts), pa.int64()),
            h2: pa.nulls(len(texts), pa.int64()),
        }
        if digest:  # only texts that have to be cut later are carried on
            left = pa.array([k in waits for k in range(len(texts))])
            data[text] = pa.compute.if_else(left, old, pa.nulls(len(old), old.type))
        found = {x: pa.nulls(len(ahead), v.type) for x, v in data.items()}
        taken = pa.array(np.array(chosen, np.int64)[doc[ahead]] if len(ahead) else [], pa.int64())
        found |= {
            doc_id: data[doc_id].take(taken), chunk: data[chunk].take(taken), row: data[row].take(taken),
            place: pa.array(place_[ahead]), h1: pa.array(a[ahead]), h2: pa.array(b[ahead]),
        }
        return pa.concat_tables([pa.table(data), pa.table(found)])

    judged = staged(
        rows.groupBy(f"`{chunk}`").cogroup(told.groupBy("chunk")).applyInArrow(verify, schema), "repeat-windows"
    )
    windows = judged.where(F.col(h1).isNotNull())
    order = Window.partitionBy(h1, h2).orderBy(F.col(f"`{doc_id}`").asc_nulls_last(), chunk, row, place)
    later = (
        windows.select(f"`{doc_id}`", chunk, row, place, h1, h2)
        .withColumn("turn", F.row_number().over(order)).where("turn > 1")
        # columns of their own: a cogroup mixes up sides that share some
        .select(F.col(chunk).alias("its_chunk"), F.col(row).alias("its_row"), F.col(place).alias("its_place"))
    )
    out = [*(c for c in columns if c != last), "n_words", "n_removed", last]
    left = judged.where(F.col(h1).isNull())
    done = left.where(F.col("n_removed").isNotNull())
    open_ = left.where(F.col("n_removed").isNull())
    kinds = ", ".join(f"`{c}` {t}" for c, t in {**{c: types[c] for c in both}, **{c: new[c] for c in out[-3:]}}.items())

    def cut_out(table, found):
        numbers = table.column(row).to_pylist()
        rows_, places = _numbers(found, "its_row"), _numbers(found, "its_place")
        by = np.argsort(rows_, kind="stable")
        rows_, places = rows_[by], places[by]
        removed, kept = [], []
        own = table.column(local).to_pylist()
        for number, t, mine in zip(numbers, _texts(table, text), own, strict=True):
            x, y = np.searchsorted(rows_, [number, number + 1])
            starts = np.r_[places[x:y], np.frombuffer(mine, "<u4")].astype(np.int64)
            r, k = _finish(t.split(), starts, window, digest)
            removed.append(r)
            kept.append(k)
        data = {c: table.column(c) for c in (*both, "n_words")}
        return pa.table({**data, "n_removed": pa.array(removed, pa.int64()), last: pa.array(kept, pa.string())})

    cleaned = open_.groupBy(f"`{chunk}`").cogroup(later.groupBy("its_chunk")).applyInArrow(cut_out, kinds)
    result = done.select([f"`{c}`" for c in out]).unionByName(cleaned)
    return result.drop(text) if digest else result
