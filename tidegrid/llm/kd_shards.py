"""Shards by a k-d tree over document metadata.

A node that still has to become several shards is split along the dimension in which it is widest, at
the weighted median of its bytes, so that each side gets its share of them. Medians are found without
a sort: byte sums of the 2^BITS ranges of the key, then of the ranges inside the one that holds the
median, and so on. A key is the dimension's value and, below it, a hash of the row, so that many rows
of one value are divided too. The texts are read once; all passes run over a written table of sizes
and dimensions, and each returns at most nodes x 2^BITS sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import small_side, staged

#: Bits of the key that one pass resolves; bits of a scaled dimension and of the row's hash.
BITS, HALF = 12, 30
#: Rows of a shard that are numbered together.
SLOT_ROWS = 50_000


def _number(df: DataFrame, name: str) -> F.Column:
    """A column as a double that keeps its order: numbers as they are, other types by their text's
    first six bytes; null comes first."""
    kind = df.schema[name].dataType.simpleString()
    c = F.col(f"`{name}`")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    head = F.rpad(F.substring(F.hex(c.cast("string").cast("binary")), 1, 12), 12, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("double"), F.lit(-1.0))


def _table(docs: DataFrame, dimensions, text: str, doc_id: str) -> tuple[DataFrame, int]:
    """The staged working table (row, doc_id, size, text_crc32, d0, d1, …, tie)."""
    body = F.col(f"`{text}`").cast("binary")
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1
    names = [d for d in dimensions if d in docs.columns]
    raw = staged(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"), size.alias("size"),
            F.crc32(F.coalesce(body, F.expr("X''"))).alias("text_crc32"),
            F.log2(size.cast("double")).alias("d0"),
            *[_number(docs, d).alias(f"d{k}") for k, d in enumerate(names, 1)],
        ).withColumn("row", F.monotonically_increasing_id()),
        "kd-sizes",
    )
    count = len(names) + 1
    ends = raw.agg(*[f(f"d{k}").alias(f"{f.__name__}{k}") for k in range(count) for f in (F.min, F.max)])
    top = float((1 << HALF) - 1)

    def scaled(k: int) -> F.Column:
        wide = F.col(f"max{k}") - F.col(f"min{k}")
        at = F.when(wide > 0, (F.col(f"d{k}") - F.col(f"min{k}")) / wide * top).otherwise(0.0)
        return F.floor(at).cast("long").alias(f"d{k}")

    table = raw.join(F.broadcast(ends)).select(  # one row of extremes
        "row", "doc_id", "size", "text_crc32", *[scaled(k) for k in range(count)],
        F.pmod(F.xxhash64("row"), F.lit(1 << HALF)).alias("tie"),
    )
    return table, count


def _cuts(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, dim, cut): rows of a node with a key below the cut go left.

    ``nodes`` (node, dim, goal): the bytes that should go left.
    """
    key = F.expr("element_at(dims, dim + 1) * " + str(1 << HALF) + "L + tie")
    state = nodes.select(
        "node", "dim", "goal", F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("before"),
    )
    shift = 2 * HALF
    dims = F.array(*[c for c in table.columns if c[0] == "d" and c[1:].isdigit()])
    keyed = table.withColumn("dims", dims).select("node", "size", "tie", "dims")
    while shift > 0:
        step = min(BITS, shift)
        rows = keyed.join(small_side(state), "node").withColumn("key", key)
        rows = rows.where(F.shiftright("key", shift) == F.col("prefix"))
        sums = rows.groupBy(
            "node", "dim", "goal", "before", F.shiftright("key", shift - step).alias("next")
        ).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        order = Window.partitionBy("node").orderBy("next")
        running = sums.withColumn(
            "below", F.col("before") + F.sum("bytes").over(order) - F.col("bytes")
        )
        # the last range that starts at or before the goal holds the cut
        held = running.where("below <= goal").groupBy("node", "dim", "goal").agg(
            F.max(F.struct("next", "below", "bytes", "rows")).alias("at")
        )
        shift -= step
        state = staged(
            held.select(
                "node", "dim", "goal", F.col("at.next").alias("prefix"),
                F.col("at.below").alias("before"), F.col("at.bytes").alias("bytes"),
                F.col("at.rows").alias("rows"),
            ),
            "kd-cuts",
        )
        if state.where("rows > 1").isEmpty():
            break
    # the row or rows in the last range go to the side that misses the goal by less
    left = 2 * (F.col("goal") - F.col("before")) > F.col("bytes")
    cut = F.shiftleft(F.col("prefix") + left.cast("long"), shift)
    return state.select("node", "dim", cut.alias("cut"))


def kd_shards(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
    dimensions=("source", "lang", "doc_id"), text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    Size is the text's UTF-8 bytes (null: none) plus 1. The tree has ``shards`` leaves, or as many as
    bring a leaf to about ``target_bytes``. Dimensions are the log of the size and those of
    ``dimensions`` that ``docs`` has; nulls sort first. Repeated rows and ids are divided like any
    others. Slots number a shard's documents without gaps. An empty table gives no rows.
    """
    table, count = _table(docs, dimensions, text, doc_id)
    total = table.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    table = staged(
        table.withColumn("node", F.lit(0)).withColumn("leaves", F.lit(int(shards))), "kd-level"
    )
    wide = [(F.max(f"d{k}") - F.min(f"d{k}")).alias(f"w{k}") for k in range(count)]
    while True:
        nodes = staged(
            table.where("leaves > 1").groupBy("node", "leaves")
            .agg(F.sum("size").alias("bytes"), *wide),
            "kd-nodes",
        )
        if nodes.isEmpty():
            break
        widest = F.array_position(
            F.array(*[F.col(f"w{k}") for k in range(count)]),
            F.greatest(*[F.col(f"w{k}") for k in range(count)], F.lit(-1)),
        ).cast("int") - 1
        goal = F.floor(F.col("bytes") * F.floor(F.col("leaves") / 2) / F.col("leaves"))
        cuts = _cuts(
            table.where("leaves > 1"),
            nodes.select("node", widest.alias("dim"), goal.cast("long").alias("goal")),
        )
        key = F.expr(
            "element_at(array(" + ", ".join(f"d{k}" for k in range(count)) + "), dim + 1) * "
            + str(1 << HALF) + "L + tie"
        )
        first = F.floor(F.col("leaves") / 2).cast("int")
        goes_left = key < F.col("cut")
        kept = [c for c in table.columns if c not in ("node", "leaves")]
        # a node is named by its first shard
        table = staged(
            table.join(small_side(cuts), "node", "left").select(
                *kept,
                F.when(F.col("cut").isNull() | goes_left, F.col("node"))
                .otherwise(F.col("node") + first).alias("node"),
                F.when(F.col("cut").isNull(), F.col("leaves")).when(goes_left, first)
                .otherwise(F.col("leaves") - first).alias("leaves"),
            ),
            "kd-level",
        )
    chunks = max(1, -(-table.count() // SLOT_ROWS))
    rows = table.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    sizes = staged(rows.groupBy("node", "chunk").agg(F.count("*").alias("n")), "kd-chunks")
    starts = sizes.withColumn(
        "start", F.sum("n").over(Window.partitionBy("node").orderBy("chunk")) - F.col("n")
    )
    within = F.row_number().over(Window.partitionBy("node", "chunk").orderBy("row"))
    return (
        rows.withColumn("at", within)
        .join(small_side(starts.select("node", "chunk", "start"), sizes.count()), ["node", "chunk"])
        .select(
            "doc_id", "size", "text_crc32", F.col("node").alias("shard"),
            (F.col("start") + F.col("at") - 1).cast("long").alias("slot"),
        )
    )
