"""WARC archives written and read by Spark, and their merged capture index.

Records are built by column expressions and written by Spark's text writer, whose line separator is
the blank lines that end a record; archives are gzip files of a bounded number of records. A payload
seen before is a revisit of the capture with the smallest page_id. Reading back, every archive gives
a run of captures sorted by URL key and time. Runs are dealt into key ranges, and each range merges
its parts of the runs with a loser tree, which yields the capture histories in one global order.
"""

from __future__ import annotations

import gzip
import hashlib
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import small_side, staged
from tidegrid.session import staging_path

#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 100
#: Records of an archive, and captures of a range of the merged index, at most or on average.
ARCHIVE_RECORDS, RANGE_CAPTURES = 5_000, 100_000
#: Capture times where a table has none: seconds after this point, one for each page_id.
FIRST_CAPTURE = 1_577_836_800
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = (
    "url_key string, captured string, page_id long, record_type string, payload_bytes long,"
    " payload_digest string, refers_to long, archive string, offset long, length long"
)
_KEY = ("url_key", "captured", "page_id", "archive", "offset")


def _record_id(page_id, digest) -> F.Column:
    h = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    at = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", at(1, 8), at(9, 4), at(13, 4), at(17, 4), at(21, 12))


def write_archives(pages: DataFrame, path: str) -> None:
    """One record for each row of ``pages`` (page_id, url, html), as WARC/1.1 files below ``path``.

    A null html is an empty payload and a null url an empty one; line ends in a url are percent-
    encoded. Of records with equal payloads of at least REVISIT_BYTES those of the smallest page_id
    are responses, the others revisits without a payload; rows that repeat that page_id are all
    responses. Rows without an id are responses only if no row with that payload has one. Other
    columns are not archived; an empty table writes no record.
    """
    crlf = F.lit("\r\n")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).select(
        "*", F.octet_length("html").cast("long").alias("size"), F.sha2("html", 256).alias("digest")
    )
    first = staged(
        rows.where(F.col("size") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
        .select("digest", "first_id"),
        "warc-first",
    )
    joined = rows.join(small_side(first), "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    number = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000))
    when = F.date_format(
        F.timestamp_seconds(number + FIRST_CAPTURE), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    block = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"), crlf, crlf, F.when(again, "").otherwise(F.col("html")),
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, crlf)
    urn = lambda x: F.concat(F.lit("<urn:uuid:"), x, F.lit(">"))
    record = joined.withColumn("block", block).select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(again, "revisit").otherwise("response")),
            line("WARC-Record-ID", urn(_record_id(F.col("page_id"), F.col("digest")))),
            line("WARC-Target-URI", url),
            line("WARC-Date", when),
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            F.when(F.col("page_id").isNull(), "").otherwise(
                line("Page-ID", F.col("page_id").cast("string"))
            ),
            F.when(again, F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", urn(_record_id(F.col("first_id"), F.col("digest")))),
                line("Refers-To-Page-ID", F.col("first_id").cast("string")),
            )).otherwise(""),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length("block").cast("string")),
            crlf,
            F.col("block"),
        ).alias("value")
    )
    (
        record.write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", ARCHIVE_RECORDS)
        .text(path)
    )


def url_key(url: str) -> str:
    """Sort key of a URL: the host's labels in reverse order, then path and query, in lower case."""
    rest = url.split("://", 1)[-1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:].split("#", 1)[0]
    return ",".join(reversed(host.split("."))) + ")" + (path or "/").lower()


def records(content: bytes):
    """(headers, block, offset, length) of each record of a gzip archive, read in order."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content))
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts at {stream.tell() - len(line)}")
        offset, headers = stream.tell() - len(line), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {offset} doesn't end as it says")
        yield headers, block, offset, stream.tell() - offset


def _capture(headers: dict, block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    revisit = headers["WARC-Type"] == "revisit"
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(next(x[16:] for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")))
    if not revisit and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} is not what its headers say")
    number = lambda name: int(headers[name]) if name in headers else None
    return (
        url_key(headers["WARC-Target-URI"]), headers["WARC-Date"], number("Page-ID"),
        headers["WARC-Type"], size, digest, number("Refers-To-Page-ID"),
    )


def _order(row) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Staged index rows of all archives below ``path``; each archive is one sorted run.

    Payloads of responses are checked against their digest and size.
    """
    import pyarrow as pa

    names = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]
    kinds = [pa.int64() if " long" in x else pa.string() for x in INDEX_SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                archive = name.as_py().rsplit("/", 1)[-1]
                rows = [
                    (*_capture(headers, block), archive, offset, length)
                    for headers, block, offset, length in records(content.as_py())
                ]
                columns = list(zip(*sorted(rows, key=_order), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return staged(files.select("path", "content").mapInArrow(run, INDEX_SCHEMA), "warc-runs", 1)


class LoserTree:
    """Merges sorted iterators; every inner node keeps the loser of its last comparison."""

    def __init__(self, runs: list, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.size = max(1, len(runs))
        self.head: list = [None] * self.size
        self.keys: list = [None] * self.size
        for k in range(len(runs)):
            self._next(k)
        self.losers = [-1] * self.size
        winners = [-1] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def _next(self, k: int) -> None:
        self.head[k] = next(self.runs[k], None) if k < len(self.runs) else None
        self.keys[k] = None if self.head[k] is None else self.key(self.head[k])

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None or (self.keys[b] is None and a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def __iter__(self):
        while self.keys[self.winner] is not None:
            k = self.winner
            yield self.head[k]
            self._next(k)
            node = (k + self.size) >> 1
            while node:
                if self._before(self.losers[node], k):
                    self.losers[node], k = k, self.losers[node]
                node >>= 1
            self.winner = k


def merge_runs(runs: DataFrame) -> DataFrame:
    """Staged index in global order: (range, place) counts captures by key, time and page_id.

    Ranges cut through the captures of one URL where those are many.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    ranges = max(1, -(-runs.count() // RANGE_CAPTURES))
    names = [f.name for f in runs.schema.fields]

    def run(batches):
        slices: dict[str, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slices.setdefault(row[7], []).append(row)
        merged = list(LoserTree(list(slices.values()), _order))
        if merged:
            columns = list(zip(*merged, strict=True))
            kinds = [pa.int64() if f.dataType.typeName() == "long" else pa.string() for f in fields]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId()] * len(merged), pa.int32()),
                    pa.array(range(len(merged)), pa.int64()),
                    *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ],
                names=["range", "place", *names],
            )

    fields = list(runs.schema.fields)
    dealt = runs.repartitionByRange(ranges, *_KEY).sortWithinPartitions("archive", *_KEY)
    return staged(dealt.mapInArrow(run, f"range int, place long, {INDEX_SCHEMA}"), "warc-index", 10_000)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder, reads them back and merges their index."""
    spark = pages.sparkSession
    path = staging_path(spark, "warc")
    write_archives(pages, path)
    return merge_runs(read_runs(spark, path))
