"""Shared pieces: staged tables, Arrow passes, connected groups, pairs from hot groups."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegrid.session import staged as _staged

#: Rows in one Arrow batch of a text pass; a batch of very long texts stays in a worker's memory.
BATCH_ROWS = 256
#: A side of at most this many (id) rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Plans made inside hand ``rows`` rows at a time to Python."""
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)


def staged(
    df: DataFrame, label: str, batch_rows: int = BATCH_ROWS, compression: str | None = None
) -> DataFrame:
    """``df`` written once below the shared folder and read back."""
    with arrow_rows(df.sparkSession, batch_rows):
        return _staged(df, label, compression)


def with_columns(df: DataFrame, schema: str, fn: Callable) -> DataFrame:
    """``df`` with the columns that ``fn`` makes of each Arrow batch.

    ``fn`` takes a RecordBatch and returns the arrays of ``schema`` in order. Columns of ``df`` with
    one of the new names are replaced.
    """
    import pyarrow as pa

    new = StructType.fromDDL(schema).names
    kept = [c for c in df.columns if c not in new]
    fields = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept]
        + [schema]
    )

    def run(batches):
        for batch in batches:
            old = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*old, *fn(batch)], names=[*kept, *new])

    return df.mapInArrow(run, fields)


def fresh_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, with a number behind those that a table already has."""
    out = []
    for name in wanted:
        free = [name, *(f"{name}{k}" for k in range(len(taken) + 1))]
        out.append(next(c for c in free if c not in taken))
    return out


def small_side(ids: DataFrame, rows: int | None = None) -> DataFrame:
    """``ids`` (a staged table of ids) marked for broadcast if it has few rows, else as it is."""
    rows = ids.count() if rows is None else rows
    return F.broadcast(ids) if rows <= BROADCAST_ROWS else ids


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Each round maps every node to the smallest of its neighbours and itself, then replaces the ends
    of all edges by what they map to. Edges inside a group vanish, so the graph shrinks until none
    is left; the smallest node of a group always maps to itself. Only aggregations and equi-joins.
    Self-loops are ignored; no edges give an empty table.
    """
    both = edges.where("a != b").select("a", "b")
    graph = staged(both.union(both.select("b", "a")).distinct(), f"{label}-edges")
    result = None
    while not graph.isEmpty():
        step = staged(
            graph.groupBy(F.col("a").alias("node")).agg(
                F.least(F.min("b"), F.first("a")).alias("to")
            ),
            f"{label}-step",
        )
        if result is None:
            result = step.withColumnRenamed("to", "component")
        else:
            moved = result.join(
                step.select(F.col("node").alias("component"), "to"), "component", "left"
            )
            result = moved.select("node", F.coalesce("to", "component").alias("component"))
        result = staged(result, f"{label}-map")
        graph = staged(
            graph.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x != y")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
            .distinct(),
            f"{label}-edges",
        )
    if result is None:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return result


def linked_groups(
    members: DataFrame,
    infos: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    label: str,
    meet: Column | None = None,
    star_rounds: int = 1,
    group_info: Column | None = None,
    groups_meet: Column | None = None,
    group_slice: Column | None = None,
    refine: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All links that decide the connected groups, without all pairs of a bucket.

    ``members`` (bucket, node): any two linked nodes share a bucket; ``infos`` (node, info) says
    something about each node, for the conditions. ``verify`` turns distinct
    candidate pairs (a, b), a < b, into the linked ones, or marks them in a column ``linked`` beside
    other columns. ``meet`` is a cheap necessary condition on
    the columns ``info_a`` and ``info_b``; ``groups_meet`` is one on ``groups_a`` and ``groups_b``,
    the aggregate ``group_info`` over the infos of a group's members in a bucket, taken apart by
    ``group_slice`` so that it says more. Before the last
    round ``refine`` may replace the infos by what the first found: it gets the members with their
    bucket's ``hub``, and the measured pairs.

    Buckets of one node are dropped. In each star round a bucket compares its members with one hub:
    first the member that shares most buckets with others, then one by hash. Only buckets that still
    hold several groups go on. The last round compares every two members of a bucket whose groups
    differ, so that no link between groups is lost; members of one group never form pairs. Returns
    (a, b).
    """
    spark = members.sparkSession
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = staged(members.join(sizes, "bucket"), f"{label}-members")
    if rows.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    score = rows.groupBy("node").agg(F.sum(F.col("n") - 1).alias("score"))
    rows = staged(
        rows.join(score, "node").select("bucket", "node", "score"), f"{label}-scored"
    )
    links = groups = first_hubs = first_pairs = None
    for turn in range(star_rounds + 1):
        if groups is None:
            mixed = rows.withColumn("group", F.col("node"))
        else:
            now = rows.join(groups, "node", "left").select(
                "bucket", "node", "score", F.coalesce("component", "node").alias("group")
            )
            open_ = (
                now.groupBy("bucket")
                .agg(F.min("group").alias("lo"), F.max("group").alias("hi"))
                .where("lo < hi")
                .select("bucket")
            )
            mixed = staged(now.join(open_, "bucket"), f"{label}-mixed")
            if mixed.isEmpty():
                break
        if turn < star_rounds:
            rank = F.col("score") if turn == 0 else F.xxhash64("node", F.lit(turn))
            hubs = mixed.groupBy("bucket").agg(
                F.max(F.struct(rank.alias("rank"), "node", "group")).alias("hub")
            )
            if turn == 0 and refine is not None:
                hubs = staged(hubs, f"{label}-hubs")
                first_hubs = hubs.select("bucket", F.col("hub.node").alias("hub"))
            pairs = (
                mixed.join(hubs, "bucket")
                .where("group != hub.group")
                .select("node", F.col("hub.node").alias("other"))
                .distinct()
            )
            if meet is not None:
                second = infos.select(F.col("node").alias("other"), F.col("info").alias("info_b"))
                pairs = pairs.join(infos.withColumnRenamed("info", "info_a"), "node").join(
                    second, "other"
                )
        else:
            mixed = mixed.join(infos, "node")
            if first_hubs is not None:
                mixed = refine(mixed.join(first_hubs, "bucket"), first_pairs)
                mixed = staged(mixed, f"{label}-refined")
            if group_info is None and groups_meet is None and group_slice is None:
                # nothing to tell groups apart by: ``meet`` is asked where two members come together
                left = mixed.select("bucket", "group", "node", F.col("info").alias("info_a"))
                right = mixed.select(
                    "bucket", F.col("group").alias("second"), F.col("node").alias("other"),
                    F.col("info").alias("info_b"),
                )
                pairs = left.join(right, "bucket").where("group < second")
            else:
                about = F.lit(0) if group_info is None else group_info
                part = F.lit(0) if group_slice is None else group_slice
                mixed = mixed.withColumn("part", part)
                present = mixed.groupBy("bucket", "group", "part").agg(about.alias("groups_a"))
                other = present.select(
                    "bucket", F.col("group").alias("second"), F.col("part").alias("second_part"),
                    F.col("groups_a").alias("groups_b"),
                )
                meeting = present.join(other, "bucket").where("group < second")
                if groups_meet is not None:
                    meeting = meeting.where(groups_meet)
                meeting = meeting.drop("groups_a", "groups_b")
                left = mixed.select("bucket", "group", "part", "node", F.col("info").alias("info_a"))
                right = mixed.select(
                    "bucket", F.col("group").alias("second"), F.col("part").alias("second_part"),
                    F.col("node").alias("other"), F.col("info").alias("info_b"),
                )
                pairs = meeting.join(left, ["bucket", "group", "part"]).join(
                    right, ["bucket", "second", "second_part"]
                )
        if meet is not None:
            pairs = pairs.where(meet)
        pairs = staged(
            pairs.select(
                F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")
            ).distinct(),
            f"{label}-pairs",
        )
        if pairs.isEmpty():
            found, first_hubs = pairs, None if turn == 0 else first_hubs
        else:
            measured = staged(verify(pairs), f"{label}-links")
            first_pairs = measured if turn == 0 else first_pairs
            found = measured.where("linked") if "linked" in measured.columns else measured
        found = found.select("a", "b")
        links = found if links is None else links.union(found)
        if turn < star_rounds:
            groups = components(links, label)
    return links
