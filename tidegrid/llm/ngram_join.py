"""N-gram Jaccard join by vertical partitioning.

A document is its set of word n-grams, as 64-bit hashes; the hash order is the global order of
n-grams, and ranges of it are fragments. Overlaps are counted fragment by fragment and summed:

1. *First fragment.* Of each document's n-grams below a fixed point of the order, those that no other
   document has are counted. A document with more of them than a linked one may miss is out. Only
   here do all documents shuffle n-grams, and only this fragment's. What is left, few but members of
   near-duplicate groups, is counted again over all fragments for as long as a tenth of it goes:
   this drops edited copies too far from every other, which would be compared with each other.
2. *Candidates.* Two linked sets differ in at most H n-grams, a bound that follows from their sizes.
   The order is cut into more than H fragments, so at least one fragment is equal in both; its
   content's hash is the bucket in which they meet. Passages that many documents share fill no
   fragment alone and bring no candidates. What a document has alone bounds what it can share, so
   pairs whose sizes and lone n-grams leave too little for a link aren't compared; nor are those
   whose overlaps with the bucket's hub and n-grams outside of it leave too little.
3. *Partial overlaps.* A candidate pair's overlap is counted separately in each of PARTS fragments
   and summed, and the link is decided on whole numbers.

Documents with equal sets are one class. Candidates of a bucket are compared with a hub, then only
across groups that are still apart (``linked_groups``), so a group of copies makes no all-pairs and
no link between groups is lost. Sets are kept by 64-bit content hash; two different n-grams or sets
fall together with odds of 2^-64.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import components, fresh_names, linked_groups, small_side, staged

#: The first fragment's share of the order: above the share that a linked document may miss.
FIRST = 0.28
#: Fragments in which a pair's overlap is counted.
PARTS = 4
#: Slices in which the pairs inside a bucket are dealt when links are counted.
SALTS = 8
#: Words a worker remembers the hash of.
CACHE_WORDS = 1_000_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of unsigned 64-bit integers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Word -> hash, for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a UTF-8 text.

    A-Z are lower-cased and words end at ASCII white space, which is what bytes do. With fewer words
    than ``words`` the whole sequence is one n-gram; without words the set is empty.
    """
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    grams = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        grams = _mix(grams * _ODD[0] + h[k : len(h) - n + 1 + k])
    return np.unique(grams)


def size_class(n: int, num: int, den: int) -> tuple[int, int]:
    """The class of a set size and the class's largest size; linked sizes are at most one class apart.

    Classes are cut where the size grows by more than den / num.
    """
    k, low = 0, 1
    while (top := low * den // num) < n:
        k, low = k + 1, top + 1
    return k, top


def differing(top: int, num: int, den: int) -> int:
    """The most n-grams in which linked sets differ if the smaller has at most ``top``."""
    return (top + top * den // num) * (den - num) // (den + num)


def buckets(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the fragments of a sorted set, for its own size class and the one below.

    A linked pair meets in the fragments of the smaller one's class. There are a few more fragments
    than H + 1, so that nearly always more than H of them hold something; then the empty ones, which
    are equal in many documents, need no hash. If one of a pair has more than H filled fragments, one
    filled fragment is equal in both.
    """
    out = []
    k, top = size_class(len(grams), num, den)
    classes = [(k, top)]
    if k:
        low = top
        while size_class(low, num, den)[0] == k:
            low = low * num // den
        classes.append(size_class(low, num, den))
    sums = np.r_[np.uint64(0), np.cumsum(_mix(grams), dtype=np.uint64)]
    for k, top in classes:
        most = differing(top, num, den)
        count = most + 2 + most // 20
        place = ((grams >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
        ends = np.searchsorted(place, np.arange(count + 1))
        content = sums[ends[1:]] - sums[ends[:-1]]
        filled = ends[1:] > ends[:-1]
        key = _mix(_mix(content) + (np.uint64(k) << np.uint64(32)) + np.arange(count, dtype=np.uint64))
        out.append(key if filled.sum() <= most else key[filled])
    return np.concatenate(out)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """Staged (doc_id, n, class, first): set size, hash of the set and its first fragment."""
    import pyarrow as pa

    id_type = docs.schema["doc_id"].dataType.simpleString()
    cut = np.uint64(int(FIRST * 2**64))

    def run(batches):
        for batch in batches:
            sizes, classes, firsts = [], [], []
            for text in batch.column(1).to_pylist():
                grams = shingles(text, words)
                sizes.append(len(grams))
                classes.append(xxhash.xxh64_intdigest(grams.tobytes()))
                firsts.append(grams[: np.searchsorted(grams, cut)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()),
                    pa.array(np.array(classes, np.uint64).view(np.int64)),
                    pa.array(firsts, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "class", "first"],
            )

    return staged(
        docs.select("doc_id", F.col("text").cast("binary"))
        .mapInArrow(run, f"doc_id {id_type}, n long, class long, first array<long>")
        .withColumn("row", F.monotonically_increasing_id()),
        "ngram-sets",
    )


def _fragments(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Staged (class, part, n, grams, buckets) of whole texts; buckets stand with part 0."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                grams = shingles(text, words)
                name = np.uint64(xxhash.xxh64_intdigest(grams.tobytes())).view(np.int64).item()
                part = ((grams >> np.uint64(32)) * np.uint64(PARTS) >> np.uint64(32)).astype(np.int64)
                ends = np.searchsorted(part, np.arange(PARTS + 1))
                for p in range(PARTS):
                    rows.append((
                        name, p, len(grams), grams[ends[p] : ends[p + 1]].view(np.int64),
                        buckets(grams, num, den).view(np.int64) if p == 0 else None,
                    ))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [
                pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["class", "part", "n", "grams", "buckets"],
            )

    schema = "class long, part int, n long, grams array<long>, buckets array<long>"
    found = docs.select("text").mapInArrow(run, schema)
    return staged(found.withColumn("row", F.monotonically_increasing_id()), "ngram-fragments")


def _linked_rows(
    members: DataFrame, infos: DataFrame, groups: DataFrame, copies: DataFrame,
    verify: Callable[[DataFrame], DataFrame], meet: F.Column,
) -> DataFrame:
    """(class, others): rows of the other classes that a class is linked to, by all pairs of a bucket
    and group. Buckets are dealt in SALTS slices, so that a hot one is many tasks."""
    rows = members.join(groups, "node").join(infos, "node")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    right = rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    side = lambda x, y: [F.col("node").alias(x), F.col("info").alias(y), "bucket", "component", "salt"]
    pairs = (
        left.select(*side("a", "info_a"))
        .join(right.select(*side("b", "info_b")), ["bucket", "component", "salt"])
        .where(F.col("a") < F.col("b")).where(meet)
        .select("a", "b").distinct()
    )
    links = staged(verify(staged(pairs, "ngram-inside")).where("linked").select("a", "b"), "ngram-linked")
    both = links.union(links.select("b", "a"))
    return both.join(copies.withColumnRenamed("class", "b"), "b").groupBy(F.col("a").alias("class")).agg(
        F.sum("copies").alias("others")
    )


def ngram_components(
    docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, text: str = "text",
    doc_id: str = "doc_id", count_links: bool = True,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs``.

    Two documents link when the Jaccard similarity of their sets is at least num / den. n_links
    counts the other rows that a row is linked to, copies of its own set included: all candidate
    pairs inside a group are verified, which grows with the square of its different sets. Without
    ``count_links`` there is no n_links and only the links that connect groups are looked for.
    component_id is the smallest doc_id reachable, the own
    one where there is no link. A null or empty text has no n-grams and links with nothing. Rows that
    repeat a doc_id are linked as one document would be. A row without an id takes part like any
    other but is never the smallest; alone its component_id is null. Very long texts are handled
    whole. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    source = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text")
    )
    sets = _sets(source, words)
    # 1. n-grams of the first fragment that one row alone has
    alone = (
        sets.select("row", F.explode("first").alias("gram"))
        .groupBy("gram")
        .agg(F.count("*").alias("rows"), F.min("row").alias("row"))
        .where("rows = 1")
        .groupBy("row")
        .agg(F.count("*").alias("alone"))
    )
    may_miss = F.floor(F.col("n") * (den - num) / den)
    left = staged(
        sets.where("n > 0").select("row", "doc_id", "n", "class").join(alone, "row", "left")
        .where(F.coalesce("alone", F.lit(0)) <= may_miss)
        .groupBy("class")
        .agg(F.min("doc_id").alias("doc_id")),
        "ngram-left",
    )
    chosen = left.where("doc_id is not null").select("doc_id").distinct()
    texts = source.join(small_side(chosen, left.count()), "doc_id", "left_semi")
    if not left.where("doc_id is null").isEmpty():  # classes of rows without ids only
        texts = texts.union(source.where("doc_id is null"))
    fragments = _fragments(texts, words, num, den)
    # a repeated doc_id brings texts more than once, or other texts
    fragments = fragments.join(left.select("class"), "class", "left_semi")
    if not fragments.where("part = 0").groupBy("class").count().where("count > 1").isEmpty():
        fragments = staged(fragments.dropDuplicates(["class", "part"]), "ngram-fragments")
    # the same over all fragments, among the classes left: partial counts of a class are summed
    classes, gone, alone_in = fragments.count() // PARTS, None, None
    while classes and (gone is None or gone > classes // 10):
        part_alone = (
            fragments.select("row", F.explode("grams").alias("gram"))
            .groupBy("gram")
            .agg(F.count("*").alias("rows"), F.min("row").alias("row"))
            .where("rows = 1")
            .groupBy("row")
            .agg(F.count("*").alias("alone"))
        )
        alone_in = staged(
            fragments.select("row", "class", "n").join(part_alone, "row")
            .groupBy("class", "n")
            .agg(F.sum("alone").alias("alone")),
            "ngram-alone",
        )
        out = alone_in.where(F.col("alone") > may_miss).select("class")
        gone = out.count()
        if gone:
            fragments = staged(
                fragments.join(small_side(out, gone), "class", "left_anti"), "ngram-fragments"
            )
            classes -= gone
    # 2. and 3.
    heads = fragments.where("part = 0").select("class", "n", "buckets")
    if alone_in is not None:
        heads = heads.join(alone_in.select("class", "alone"), "class", "left")
    else:
        heads = heads.withColumn("alone", F.lit(0))
    # Linked sets have c common n-grams, (num + den) * c >= num * (n + n'). What a set shares with
    # any other is at most ``most``; with the hub it shares ``hub``, and ``rest`` of it with others.
    most = F.col("n") - F.coalesce("alone", F.lit(0))
    info = lambda n, most, hub, rest: F.named_struct(
        F.lit("n"), n, F.lit("most"), most, F.lit("hub"), hub, F.lit("rest"), rest
    ).alias("info")
    members = heads.select(F.explode("buckets").alias("bucket"), F.col("class").alias("node"))
    infos = staged(
        heads.select(F.col("class").alias("node"), info(F.col("n"), most, most, most)), "ngram-infos"
    )

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda x: fragments.select(
            F.col("class").alias(x), "part", F.col("n").alias(f"n_{x}"), F.col("grams").alias(f"g_{x}")
        )
        overlap = pairs.join(side("a"), "a").join(side("b"), ["b", "part"])
        return (
            overlap.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("g_a", "g_b")).alias("c"))
            .groupBy("a", "b", "n_a", "n_b")
            .agg(F.sum("c").alias("common"))
            .withColumn(
                "linked",
                den * F.col("common") >= num * (F.col("n_a") + F.col("n_b") - F.col("common")),
            )
        )

    def fits(a: str, b: str) -> F.Column:
        """Both may share enough: inside the hub, and outside of it."""
        least = lambda part: F.least(f"{a}.{part}", f"{b}.{part}")
        shared = F.least(least("most"), least("hub") + least("rest"))
        return (num + den) * shared >= num * (F.col(f"{a}.n") + F.col(f"{b}.n"))

    def refine(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """Infos with the overlap that each member was found to have with its bucket's hub."""
        known = pairs.select(F.col("a").alias("node"), F.col("b").alias("hub"), "common").union(
            pairs.select("b", "a", "common")
        )
        most, own = F.col("info.most"), F.col("node") == F.col("hub")
        with_hub = F.when(own, most).otherwise(F.coalesce("common", most))
        rest = F.when(own, F.lit(0)).otherwise(F.coalesce(most - F.col("common"), most))
        return rows.join(known, ["node", "hub"], "left").select(
            "bucket", "node", "group", info(F.col("info.n"), most, with_hub, rest.cast("long"))
        )

    top = lambda part: F.max(f"info.{part}")
    links = linked_groups(
        members, infos, verify, "ngram", fits("info_a", "info_b"), 1,
        info(F.min("info.n"), top("most"), top("hub"), top("rest")),
        fits("groups_a", "groups_b"),
        F.xxhash64("info.n", F.floor(32 * F.col("info.hub") / F.col("info.n")),
                   F.floor(32 * F.col("info.rest") / F.col("info.n"))),
        refine,
    )
    links = staged(links.distinct(), "ngram-all-links")
    groups = components(links, "ngram")
    found = groups.select(F.col("node").alias("class"), "component")
    if count_links:
        copies = sets.where("n > 0").groupBy("class").agg(F.count("*").alias("copies"))
        linked = _linked_rows(members, infos, groups, copies, verify, fits("info_a", "info_b"))
        own = copies.join(linked, "class", "left").select(
            "class", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
        )
        found = own.join(found, "class", "left")
    else:
        found = found.withColumn("n_links", F.lit(0).cast("long"))
    found = staged(found, "ngram-groups")
    known = sets.where("n > 0").select("doc_id", "n", "class").join(found, "class", "left").select(
        "doc_id", "n", F.coalesce("component", "class").alias("group"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    smallest = known.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    empty = sets.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
        F.lit(0).cast("long").alias("n_links"),
    )
    rows = known.join(smallest, "group").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links"
    ).union(empty)
    return rows if count_links else rows.drop("n_links")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest doc_id, null ids last.

    A document is an id and a text: rows that share an id but not the text are judged by themselves,
    rows without an id like any other, and of rows that repeat both one stays, the smallest by all
    columns. Null, empty and blank texts link with nothing and stay, repeated or not. Very long texts
    are handled whole; an empty table gives an empty table. All columns are kept as they are.
    """
    its_id, its_hash = fresh_names(docs.columns, "near_id", "near_hash")
    body, key = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    hashed = F.xxhash64(body)
    ident = F.struct(key.isNull().alias("no_id"), key.alias("id"), hashed.alias("hash"))
    found = ngram_components(docs.select(ident.alias("doc_id"), body.alias("text")), count_links=False, **options)
    gone = staged(
        found.where("doc_id != component_id").select(
            F.col("doc_id.id").alias(its_id), F.col("doc_id.hash").alias(its_hash)
        ).distinct(),
        "ngram-gone",
    )
    same = key.eqNullSafe(F.col(its_id)) & (hashed == F.col(its_hash))
    left = docs.join(small_side(gone), same, "left_anti")
    again = staged(
        docs.where(body.rlike("[^\\x20\\x09-\\x0D]"))
        .groupBy(key.alias(its_id), hashed.alias(its_hash)).count().where("count > 1").drop("count"),
        "ngram-again",
    )
    if again.isEmpty():
        return left.select(docs.columns)
    once = (
        left.join(small_side(again), same, "left_semi")
        .groupBy(key.alias(its_id), hashed.alias(its_hash))
        .agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
        .select("row.*")
    )
    return left.join(small_side(again), same, "left_anti").union(once).select(docs.columns)
