"""Operator 4: WARC archives, and capture histories by an external merge of their indexes.

Pages are written as WARC records, copies of a payload as revisits of one response. The archives are read back by
Content-Length; each reading task sorts the index entries of its archives into one capture run, whose entries are
numbered. The runs are cut into ranges of (URL key, timestamp, page); a range puts each run's entries back by their
numbers and merges the runs by a loser tree, which gives one globally ordered index of capture histories.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prefix_sums, read, shared_dir, written

#: Production parameters: payload bytes from which copies become revisits; archive size; index entries of a range.
LEAST_BYTES = 100
ARCHIVE_BYTES = 16 << 20
RANGE_ROWS = 200_000
#: Pages carry no time of capture: page n counts as captured n seconds after this instant.
EPOCH = 1_577_836_800

#: Fixed values of the format, and the days since 1970 between which its dates can lie.
VERSION, END, BLANK = "WARC/1.0", "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
FIRST_DAY, LAST_DAY = -719_162, 2_932_896


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed and joined by commas, then ``)`` and the path and query, in lower case.

    Scheme, port, a leading ``www.`` and the fragment are left out. A null URL has the empty key.
    """
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), r"^www\.|:[0-9]*$", "")
    path = F.regexp_replace(bare, r"^[^/?]*", "")
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path))


def elect(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``pages`` with ``digest``, ``bytes``, ``record_type`` and ``refers_to``.

    Of equal payloads of at least ``least`` bytes the smallest page is the response. Only (page, digest) is shuffled
    to find it; a payload that very many pages share is one row for each task when counted, and Spark splits its
    rows when the response is joined.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    named = pages.withColumns({"digest": F.sha2(payload, 256), "bytes": F.octet_length(payload).cast("long")})
    narrow = named.where(F.col("bytes") >= least).select("page_id", "digest")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    firsts = written(firsts, "warc-firsts").withColumnRenamed("digest", "_digest")
    out = named.join(firsts, (F.col("digest") == F.col("_digest")) & (F.col("bytes") >= least), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.withColumns(
        {"record_type": F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), "refers_to": F.when(revisit, F.col("first"))}
    ).drop("_digest", "first")


def captured(page: Column) -> Column:
    """Seconds since 1970 (UTC) of a page; a null counts as page 0, and ids near the ends of a long as 2^62."""
    most = F.lit(1 << 62)
    return F.lit(EPOCH).cast("long") + F.least(F.greatest(F.coalesce(page.cast("long"), F.lit(0)), -most), most)


def warc_date(seconds: Column) -> Column:
    """The date of a record in UTC, whatever the session's time zone; the format's first or last day where it ends."""
    rest = F.pmod(seconds, F.lit(86_400))
    day = F.least(F.greatest((seconds - rest) / 86_400, F.lit(FIRST_DAY)), F.lit(LAST_DAY)).cast("int")
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), two(rest / 3600), F.lit(":"), two(rest % 3600 / 60), F.lit(":"), two(rest % 60), F.lit("Z"))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(END))


def records(elected: DataFrame) -> DataFrame:
    """One WARC record a page as text, without the blank lines that end it: the writer adds these.

    A revisit has an empty block; it names payload digest, size and the record it refers to in its header. As dates
    of the format end with the year 9999, the second of capture is also given as a number.
    """
    payload = F.coalesce("html", F.lit(""))
    response = F.col("record_type") == "response"
    block = F.when(response, payload).otherwise(F.lit(""))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    header = F.concat(
        F.lit(VERSION + END),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        _field("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")),
        _field("WARC-Date", warc_date(captured(F.col("page_id")))),
        _field("X-Capture-Seconds", captured(F.col("page_id")).cast("string")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(response, F.lit("")).otherwise(_field("WARC-Profile", F.lit(PROFILE))),
        F.when(F.col("refers_to").isNotNull(), _field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        _field("Content-Type", F.lit("text/html")),
        _field("Content-Length", F.octet_length(block).cast("string")),
    )
    return elected.select(F.concat(header, F.lit(END), block).alias("value"), "bytes")


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Gzipped archives of about ``archive_bytes`` of payload each, in a folder that any Spark file system may hold."""
    elected = elect(pages)
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    parts = max(1, -(-total // archive_bytes))
    dealt = records(elected).repartition(parts, F.xxhash64("value")).select("value")
    dealt.write.option("lineSep", BLANK).option("compression", "gzip").text(path)


ENTRY = "url_key string, ts long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
ENTRIES = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in ENTRY.split(", "))])
#: The global order. The last two tell entries of one page apart, so that equal keys can be cut like any others.
ORDER = ["url_key", "ts", "page_id", "archive", "offset"]


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(header fields, block, offset) of each record of a plain archive, by Content-Length."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no WARC record at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        start = head + 4
        end = start + int(fields["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where its length says")
        yield fields, data[start:end], at
        at = end + 4


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives with ``run`` and ``at``: the capture run of the task that read them, and the place in it.

    Payloads are hashed again as they are read; a digest that differs from the header is an error. ``offset`` is the
    record's place in the plain archive.
    """

    def number(urn: str | None) -> int | None:
        return int(urn[10:-1]) if urn and urn[10:-1] else None

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for f, block, at in parse_archive(zlib.decompress(content, wbits=47)):
                    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if f["WARC-Type"] == "response" and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"{name} is damaged at {at}")
                    rows.append((f["WARC-Target-URI"], int(f["X-Capture-Seconds"]), number(f["WARC-Record-ID"]), int(f["X-Payload-Length"]), digest, f["WARC-Type"], number(f.get("WARC-Refers-To")), name, at))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ENTRIES.types, strict=True)], schema=ENTRIES)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    raw = files.mapInArrow(entries, ENTRY).withColumn("url_key", url_key(F.col("url_key")))
    return raw.sortWithinPartitions(*ORDER).withColumns({"run": F.spark_partition_id(), "at": F.monotonically_increasing_id()})


class LoserTree:
    """Merges k sorted runs: each inner node keeps the loser of its match, so a step costs log2(k) comparisons."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _head(self, i: int) -> tuple | None:
        return self.runs[i][self.at[i]] if self.at[i] < len(self.runs[i]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        """Run i climbs from its leaf; an empty place of the tree holds the first that comes."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:
                self.tree[node] = i
                return
            if self._beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (top := self._head(winner := self.tree[0])) is not None:
            yield top
            self.at[winner] += 1
            self._play(winner)


def merge_histories(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All entries in global order with ``position`` (gapless from 0) by (url_key, ts, page_id).

    ``runs`` is written first. Ranges are cut by Spark's range partitioning over the whole order, so the captures of
    one URL or host, or of one page, may lie in several ranges; within a range each run's entries stand in the order
    of their numbers, and the loser tree merges the runs. Positions add the sizes of the ranges before.
    """
    stored = written(runs, "capture-runs")
    spark = stored.sparkSession
    ranges = max(1, -(-stored.count() // range_rows))
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]  # one range: about `range_rows` index entries
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        pages = [(p is not None, p or 0) for p in whole.column("page_id").to_pylist()]
        keys = list(zip(whole.column("url_key").to_pylist(), whole.column("ts").to_pylist(), pages, whole.column("archive").to_pylist(), whole.column("offset").to_pylist(), range(len(pages)), strict=True))
        run = whole.column("run").to_numpy()
        edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
        order = [x[-1] for x in LoserTree([keys[lo:hi] for lo, hi in zip(edges, edges[1:], strict=False)])]
        out = whole.drop_columns(["run", "at"]).take(order).append_column("in_range", pa.array(range(len(order)), pa.int64()))
        yield from out.combine_chunks().to_batches()

    dealt = stored.repartitionByRange(ranges, *ORDER).sortWithinPartitions("run", "at").withColumn("range", F.spark_partition_id())
    merged = dealt.mapInArrow(merge, ENTRY + ", range int, in_range long")
    merged = written(merged, "capture-histories")
    sizes = merged.groupBy("range").count()
    # One entry a range: rows / range_rows at most.
    entries = sizes.agg(F.sort_array(F.collect_list(F.struct("range", "count"))).alias("e"))
    start = F.zip_with("e", prefix_sums(F.transform("e", lambda x: x["count"])), lambda x, s: F.struct(x["range"].alias("range"), s.alias("start")))
    starts = entries.select(F.explode(start).alias("s")).select("s.range", "s.start")
    placed = merged.join(F.broadcast(starts), "range")
    return placed.select(*names, (F.col("start") + F.col("in_range")).alias("position"))


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives, reads them back and returns their merged histories.

    A null html is an empty payload, a null URL the empty key; a null page counts as the earliest and never as the
    response of others unless all copies are null. Repeated rows are each a record; pages that share the smallest id
    of a payload are all responses. Entries alike in URL key and time come in the order of page, archive and offset.
    Any long is a page id, and the session's time zone does not matter. An empty table gives no entries. Further
    columns are not read.
    """
    spark = pages.sparkSession
    path = path or shared_dir(spark, "archives")
    write_archives(pages.select("page_id", "url", "html"), path)
    return merge_histories(read_index(spark, path))


def op4_warc_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_round_trip(read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://|#.*$', '', 'g') AS bare FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest, bare,
    regexp_replace(regexp_extract(bare, '^[^/?]*'), '^www\.|:[0-9]*$', '', 'g') AS host, regexp_replace(bare, '^[^/?]*', '') AS path FROM p),
r AS (SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN bare = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path END AS url_key,
    CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, url_key,
  row_number() OVER (ORDER BY url_key, page_id) - 1 AS position
FROM r
"""
