"""WARC archives of pages, and their index by external merge.

Tasks write gzip archives (one member per record) to the shared folder and leave
a run of index lines sorted by URL key and time.  Runs are dealt by key range, as
many ranges as it takes for each to be small; every range is merged from its sorted
pieces of all runs with a loser tree, which gives a globally ordered index of capture
histories.  Archives are then read back, a task for each.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import string
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votegrid.llm.common import keyed, python_ready
from votegrid.storage import Scratch

#: Captures carry no time of their own here: one second per page id from this on.
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
_READ = 1 << 20
#: Index lines of one range, about: what a task of the merge holds.
RANGE_LINES = 100_000
#: Rows that a task hands on at a time.
_ROWS = 4_096
_INDEX = "archive string, offset long, size long, url_key string, stamp string, page_id {kind}, seq long"
_RECORD = "archive string, offset long, page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}"


#: Parts of a URL; it matches every text, so that no URL is too odd to have a key.
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)(\?[^#]*)?")
_SPACE = " \t\n\v\f\r"
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def url_key(url: str | None) -> str:
    """Sort-friendly form of any text: host labels reversed, without user, port and
    www, then path (at least a slash) and query; A-Z in lower case."""
    place, path, query = _URL.match((url or "").strip(_SPACE).translate(_LOWER)).groups()
    host = re.sub(r":[0-9]*$", "", place.rpartition("@")[2]).removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}){path or '/'}{query or ''}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class LoserTree:
    """K-way merge of sorted iterators: log2(k) comparisons per item.

    Inner nodes hold the loser of their match, node 0 the overall winner; equal
    keys leave in the order of their runs.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self._runs = [iter(r) for r in runs]
        self._k = len(runs)
        self._head = [next(r, None) for r in self._runs]
        self._node = [-1] * max(1, self._k)
        for leaf in range(self._k - 1, -1, -1):
            self._play(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head[a], self._head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, winner: int, building: bool = False) -> None:
        at = (winner + self._k) // 2
        while at:
            other = self._node[at]
            if other < 0 and building:
                self._node[at] = winner
                return
            if self._beats(other, winner):
                self._node[at], winner = winner, other
            at //= 2
        self._node[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self._k and (item := self._head[w := self._node[0]]) is not None:
            yield item
            self._head[w] = next(self._runs[w], None)
            self._play(w)


def record_bytes(kind: str, url: str, page_id, stamp: str, payload: bytes, name: str, refers) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}')}>",
        f"WARC-Date: {stamp}", f"WARC-Target-URI: {' '.join(url.split())}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{name}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers}')}>", f"X-Refers-To-Page-ID: {refers}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_members(source) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a binary stream."""
    offset, data = 0, source.read(_READ)
    while data:
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while True:
            parts.append(unpack.decompress(data))
            used += len(data) - len(unpack.unused_data)
            if unpack.eof:
                data = unpack.unused_data or source.read(_READ)
                break
            data = source.read(_READ)
            if not data:
                raise ValueError("an archive ends inside a record")
        yield offset, b"".join(parts)
        offset += used


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and the payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _stamp(page_id) -> str:
    seconds = page_id if isinstance(page_id, int) else 0
    return (EPOCH + timedelta(seconds=seconds % (20 * 365 * 86400))).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_archives(pages: DataFrame, folder: str, id_col: str, url_col: str, html_col: str, min_bytes: int, scratch: Scratch) -> DataFrame:
    """Write all pages; returns the staged runs of index lines.

    Only archives named in that table count: a task that ran twice leaves an
    archive nobody refers to.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    html = F.coalesce(F.col(html_col), F.lit(""))
    source = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.unhex(F.sha1(html)).alias("sha"),
        F.octet_length(html).alias("bytes"),
    )
    groups = scratch.stage(
        source.where(F.col("bytes") >= min_bytes).groupBy(F.col("sha").alias("g_sha"))
        .agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "groups",
    )
    source = source.join(keyed(groups), (F.col("sha") == F.col("g_sha")) & (F.col("bytes") >= min_bytes), "left")
    source = source.select("page_id", "url", "html", "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        name, offset, lines, sink = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz", 0, [], None
        for batch in batches:
            for page_id, url, text, keep in zip(*(batch.column(k) for k in range(4)), strict=True):
                page_id, url, payload, keep = page_id.as_py(), url.as_py() or "", text.as_py().encode(), keep.as_py()
                sink = sink or store.open_output_stream(f"{top}/{name}", compression=None)
                stamp, again = _stamp(page_id), keep is not None and keep != page_id
                record = record_bytes("revisit" if again else "response", url, page_id, stamp, payload, digest(payload), keep)
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = pack.compress(record) + pack.flush()
                sink.write(packed)
                lines.append((url_key(url), stamp, page_id is not None, page_id or 0, offset, len(packed), page_id))
                offset += len(packed)
        if sink is not None:
            sink.close()
            lines.sort(key=lambda x: x[:5])  # the run of this task
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), batch.schema.field(0).type, pa.int64()]
            rows = [(name, x[4], x[5], x[0], x[1], x[6], k) for k, x in enumerate(lines)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["archive", "offset", "size", "url_key", "stamp", "page_id", "seq"])

    return scratch.stage(source.mapInArrow(run, _INDEX.format(kind=kind)), "runs")


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as they come, some thousands at a time."""
    while some := list(itertools.islice(rows, _ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)


def merge_index(runs: DataFrame, ranges: int) -> DataFrame:
    """The staged runs merged by URL key, time and page id: ``range_no`` and
    ``line_no`` give the global order.  A URL captured very often spans several ranges."""
    kind = runs.schema["page_id"].dataType.simpleString()
    # a range's piece of each run arrives whole and in the order of its run
    dealt = runs.repartitionByRange(ranges, "url_key", "stamp", "page_id", "archive", "offset").sortWithinPartitions("archive", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[tuple]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive, offset, _, key, stamp, page_id, _ = row
                pieces.setdefault(archive, []).append((key, stamp, page_id is not None, page_id or 0, archive, offset, row))
        if schema is None:
            return
        number = TaskContext.get().partitionId()
        merged = ((*x[-1], number, n) for n, x in enumerate(LoserTree([iter(p) for p in pieces.values()])))
        yield from _batches(merged, [*schema.names, "range_no", "line_no"], [*[f.type for f in schema], pa.int32(), pa.int64()])

    return dealt.mapInArrow(run, _INDEX.format(kind=kind) + ", range_no int, line_no long")


def read_archives(runs: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Records of every archive named in ``runs``, a task for each; digests are checked."""
    kind = runs.schema["page_id"].dataType.simpleString()
    number = F.row_number().over(Window.orderBy("archive")) - 1  # a row for each task that wrote
    names = scratch.stage(runs.select("archive").distinct().select("archive", number.alias("number")), "names")

    def records(name: str) -> Iterator[tuple]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{top}/{name}", compression=None) as source:
            for offset, raw in read_members(source):
                fields, http, payload = parse_record(raw)
                found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and (digest(payload) != found or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"{name} is damaged at {offset}")
                page, refers = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID", "")
                yield name, offset, int(page) if page else None, int(http["Content-Length"]), found, fields["WARC-Type"], int(refers) if refers else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        columns = ["archive", "offset", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield from _batches(records(name), columns, types)

    dealt = names.repartitionById(max(1, names.count()), F.col("number")).select("archive")
    return dealt.mapInArrow(run, _RECORD.format(kind="long")).select(
        "archive", "offset", F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind)
    )


def archive_pages(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    ranges: int | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Write, index and read back: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to, url_key, stamp, index_line, archive``; ``index_line``
    numbers the captures from 0 in the global order of the merged index.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with
    the largest page id is the response, the others revisit it.

    * Null html: empty payload.  Null url: the key of an empty one.  Any text is a
      URL with a key.  Null page id: below all others; a group of null ids only is
      all responses.
    * Repeated rows with the largest id of their group are all responses.
    * Empty table: no archive, empty result.  Extra columns are ignored.
    * Page ids are integers.
    """
    spark = pages.sparkSession
    python_ready(spark)
    scratch = scratch or Scratch(spark, "warc")
    folder = scratch.path("archives")
    runs = write_archives(pages, folder, id_col, url_col, html_col, min_bytes, scratch)
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_LINES))
    index = scratch.stage(merge_index(runs, ranges), "index")
    # a row per range
    first = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = index.groupBy(F.col("range_no").alias("range")).agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(first, F.lit(0)).alias("first"))
    lines = index.join(keyed(scratch.stage(starts, "starts")), F.col("range_no") == F.col("range")).select(
        F.col("archive").alias("i_archive"), F.col("offset").alias("i_offset"), "url_key", "stamp", (F.col("first") + F.col("line_no")).alias("index_line")
    )
    # written, so that Spark knows the sizes of both sides before it joins them
    back = scratch.stage(read_archives(runs, folder, scratch), "records")
    scratch.keep("index", "starts", "records")  # and the archives, which are no table
    return back.join(lines, (F.col("archive") == F.col("i_archive")) & (F.col("offset") == F.col("i_offset"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "stamp", "index_line", "archive"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per row of ``pages``, written and read back."""
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_bytes=0).drop("archive")


def _base32_sql(digest: str) -> str:
    """Five hexadecimal digits are four characters of base 32."""
    parts = []
    for k in range(8):
        value = f"CAST('0x' || substr({digest}, {5 * k + 1}, 5) AS BIGINT)"
        parts += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({value} >> {shift}) & 31 AS INTEGER) + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(parts)


_HEAD_SQL = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?"
SQL = f"""
WITH d AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS s,
                  translate(trim(coalesce(url, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM pages),
g AS (SELECT s, max(page_id) AS keep FROM d GROUP BY s),
p AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, '{_HEAD_SQL}([^/?#]*)', 1),
                  '(?s)^.*@', ''), ':[0-9]*$', ''), '^www[.]', '') AS host,
             regexp_extract(u, '{_HEAD_SQL}[^/?#]*([^?#]*)', 1) AS path,
             regexp_extract(u, '{_HEAD_SQL}[^/?#]*[^?#]*([?][^#]*)', 1) AS query,
             strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id % {20 * 365 * 86400}), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM d),
k AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || query AS url_key FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_base32_sql('k.s')} AS payload_digest,
       CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keep <> page_id THEN keep END AS refers_to,
       url_key, stamp, row_number() OVER (ORDER BY url_key, stamp, page_id) - 1 AS index_line
FROM k JOIN g ON g.s = k.s
"""
