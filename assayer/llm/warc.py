"""WARC archives: a writer over Spark's text sink and a reader as a Python data source with pushed filters."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith,
)
from pyspark.sql.types import StructType

from assayer.llm.shared import shared_path, table

#: base32's alphabet, and what ends a header and a record.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BREAK = "\r\n\r\n"
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, headers map<string,string>, payload string"
#: Named fields behind the columns that filters are pushed to.
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "WARC-X-Payload-Length"}
COMPARISONS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
#: Before the name of a header in an option.
HEADER = "header."
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 160 bits are 32 characters, so five hex digits give four."""
    digest = F.sha1(payload.cast("binary"))
    parts = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, record) of each row of (page_id, url, html): the text of a WARC/1.1 record without its closing blank lines.

    Of the records with equal payloads of at least ``least`` bytes that with the smallest page_id is a response and
    the others revisit it, without a payload of their own; smaller ones are all responses. A null html is an empty
    payload; a null page_id sorts after all others; rows that repeat the smallest page_id of their payload are all
    responses. Line breaks in a url are percent-encoded. Extra columns are ignored.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("payload_digest", sha1_base32(F.col("html"))).withColumn("n", F.octet_length("html").cast("long"))
    shared = own.where(F.col("n") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    named = own.join(table(shared.select("payload_digest", "first"), "payloads"), "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    block = F.when(again, F.lit(HTTP + BREAK)).otherwise(F.concat(F.lit(HTTP + BREAK), "html"))
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn("first"))),
        F.when(again, F.lit(f"WARC-Profile: {REVISIT}")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.concat(F.lit("WARC-X-Payload-Length: "), F.col("n").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    return named.withColumn("block", block).select("page_id", F.concat(F.concat_ws("\r\n", *fields), F.lit(BREAK), "block").alias("record"))


def write(pages: DataFrame, path: str, least: int = 0, per_file: int = 20_000) -> None:
    """Write ``pages`` as gzipped WARC files of at most ``per_file`` records. Spark's own text sink commits them, so a
    lost executor leaves no half-written archive and any store Spark writes to will do."""
    found = records(pages, least).select(F.col("record").alias("value"))
    found.write.option("lineSep", BREAK).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _column(fields: dict[str, str], column: str) -> str | int | None:
    value = fields.get(FIELDS[column].lower())
    if column == "payload_length":
        return int(value) if value else None
    return value.removeprefix("sha1:") if column == "payload_digest" and value else value


def _test(f: Filter) -> tuple[str, Callable] | None:
    """(column, what its value must pass) of a filter that headers can answer, with SQL's meaning of null: a null value passes
    nothing but ``<=> null`` and ``is null``, and a null among the operands matches nothing."""
    path = getattr(f, "attribute", ())
    column = path[0] if len(path) == 1 else ""
    if column not in FIELDS:
        return None
    known = lambda test: lambda v: v is not None and test(v)
    if isinstance(f, EqualNullSafe):
        return column, lambda v: v == f.value
    if isinstance(f, In):
        values = {x for x in f.value if x is not None}
        return column, known(lambda v: v in values)
    if isinstance(f, IsNull):
        return column, lambda v: v is None
    if isinstance(f, IsNotNull):
        return column, known(lambda v: True)
    if isinstance(f, StringStartsWith):
        return column, known(lambda v: v.startswith(f.value))
    for kind, compare in COMPARISONS.items():
        if isinstance(f, kind) and (column == "payload_length" or kind is EqualTo):
            return column, known(lambda v: f.value is not None and compare(v, f.value))
    return None


class WarcReader(DataSourceReader):
    """Plans partitions of whole files; reads each header before its block and steps over blocks that aren't wanted."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns, self.path = schema.names, options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.bytes = int(options.get("partitionbytes", 32 << 20))
        self.headers = {k[len(HEADER) :].lower(): v for k, v in options.items() if k.lower().startswith(HEADER)}
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = pa.fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == pa.fs.FileType.File else store.get_file_info(pa.fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == pa.fs.FileType.File and re.search(r"\.(warc|txt)(\.gz)?$", f.path) and f.size)
        out, size = [], self.bytes
        for path, n in files:
            if size + n > self.bytes:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [_Files(x) for x in out] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = pa.fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with store.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None, buffer_size=1 << 20) as stream:
                yield from self._records(_Buffered(stream))

    def _records(self, stream: _Buffered) -> Iterator[tuple]:
        tests, wanted = [_test(f) for f in self.filters], list(self.headers.items())
        while head := stream.until(BREAK.encode()):
            lines = head.decode().lstrip("\r\n").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
            names = [x.partition(":") for x in lines[1:]]
            headers = {k.strip(): v.strip() for k, _, v in names}
            fields = {k.lower(): v for k, v in headers.items()}
            length = int(fields["content-length"])
            if any(fields.get(k) != v for k, v in wanted) or not all(test(_column(fields, c)) for c, test in tests):
                stream.skip(length)
                stream.skip(len(BREAK), whole=False)
                continue
            payload = None
            if self.payload and fields.get("warc-type") == "response":
                payload = stream.take(length).partition(BREAK.encode())[2].decode("utf-8", "replace")
            else:
                stream.skip(length)
            stream.skip(len(BREAK), whole=False)
            yield (*(_column(fields, c) for c in FIELDS), headers, payload)


class _Buffered:
    """Reads up to a mark, takes or steps over a number of bytes; holds about a block at a time."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.held, self.at = stream, b"", 0

    def _more(self, n: int) -> bool:
        got = self.stream.read(max(n, 1 << 18))
        self.held, self.at = self.held[self.at :] + got, 0
        return bool(got)

    def until(self, mark: bytes) -> bytes:
        while (end := self.held.find(mark, self.at)) < 0:
            if not self._more(0):
                rest, self.at = self.held[self.at :], len(self.held)
                if rest.strip():
                    raise ValueError("a WARC header is cut short")
                return b""
        out, self.at = self.held[self.at : end], end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self._more(n - (len(self.held) - self.at)):
                raise ValueError("a WARC block is cut short")
        out, self.at = self.held[self.at : self.at + n], self.at + n
        return out

    def skip(self, n: int, whole: bool = True) -> None:
        have = len(self.held) - self.at
        if n <= have:
            self.at += n
            return
        self.held, self.at, n = b"", 0, n - have
        while n:
            got = self.stream.read(min(n, 1 << 20))
            if not got and whole:
                raise ValueError("a WARC block is cut short")
            if not got:
                return
            n -= len(got)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; path is a URI of a file or folder.

    Options: payload=false leaves payloads undecoded, partitionBytes sizes the partitions, header.NAME=VALUE keeps records whose
    header of that name, whatever its case, has that value. Equality, IN, null tests and prefixes on record_type, record_id,
    target_uri, refers_to and payload_digest, and comparisons of payload_length, are answered from headers; a block that they
    reject is stepped over. Spark offers filters to Python data sources only where
    spark.sql.python.filterPushdown.enabled is true, which ``register`` sets.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archive ``pages`` and read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to, url).

    A response's digest and size are taken anew from the payload read; a revisit's, which has none, from its header.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, least)
    register(spark)
    got = spark.read.format("warc").load(path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1).try_cast("long")
    whole = F.col("record_type") == "response"
    return got.select(
        page("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, sha1_base32(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
        F.col("target_uri").alias("url"),
    )


#: DuckDB SQL for the query over pages.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS n, array_to_string([substr('{BASE32}', ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::INT >> (15 - 5 * (k % 4))) & 31) + 1, 1) for k in range(32)], '') AS digest FROM p),
f AS (SELECT digest, min(page_id) AS lo FROM d GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = lo THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lo THEN lo END AS refers_to FROM d JOIN f USING (digest)
"""
