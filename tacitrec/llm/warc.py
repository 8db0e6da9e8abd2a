"""WARC archives as a Spark data source, and pages archived with revisits of equal payloads.

`register(spark)` makes the format `warc` known. Writing needs columns of `RECORD` by name (all but
`record_id` and `record_type` may be missing or null; others are ignored) and gives gzip files with
one member a record; each member states its length (the `sl` field of the standard's annex), so a
reader can step over it. Tasks write files under names of their own, and a commit file that lists
them makes them visible at once: files of lost or repeated attempts are never read. Foreign `.warc`
and `.warc.gz` files are read as well.

Reading plans its partitions from file sizes: small files share one, and files that hold none of
the wanted record types are left out. Predicates on `record_type` and on header columns are pushed
into the reader. It inflates a record up to the end of its headers, tests the predicates, and only
then decodes the payload; the rest of an unwanted record, and of every record with the option
`payload=false`, is stepped over (inflated without being kept, where a foreign member does not
state its length). Records are streamed, so a task holds one record and one batch of rows.

Payloads are what follows the HTTP headers of `application/http` blocks, else the block; transfer
and content codings are left as they are. Null payloads count as empty; null or odd urls cannot
break a header, as control characters, blanks and letters beyond ASCII are percent-encoded. Empty
tables give archives without records. Paths are opened through Arrow's file systems
(`file`, `hdfs`, `s3`, `gs`).
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from tacitrec.operators.heavy import join_salted
from tacitrec.tables import new_path

RECORD = (
    "record_id string, record_type string, date string, target_uri string, content_type string, payload_digest string, "
    "refers_to string, content_length bigint, payload_length bigint, headers map<string,string>, payload binary, "
    "file string, offset bigint"
)
# Columns that headers give, and so can be tested before the payload is decoded.
HEADER_OF = {
    "record_id": "warc-record-id", "record_type": "warc-type", "date": "warc-date", "target_uri": "warc-target-uri",
    "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
    "content_length": "content-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_BYTES, SPLIT_BYTES = 128 << 20, 64 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
CHUNK = 1 << 16


def register(spark: SparkSession) -> None:
    """Make the format known; Spark wants pushdown to Python sources to be switched on for it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


class WarcSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    scheme, _, rest = path.partition("://")
    if not rest:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }://{rest}")


# --- writing ------------------------------------------------------------------------

@dataclass
class Written(D.WriterCommitMessage):
    files: list[dict]


def _uri(value: str) -> str:
    return quote(value, safe="!#$%&'()*+,/:;=?@[]-._~\"<>\\^`{|}")


def _line(value: str) -> str:
    """A header value without what would end the line."""
    return value.replace("\r", " ").replace("\n", " ").strip()


def encode_record(row: dict) -> bytes:
    """The bytes of one record, not yet compressed."""
    kind, payload = row["record_type"], row.get("payload")
    http = kind in ("response", "revisit")
    body = b"" if payload is None or kind == "revisit" else payload
    length = len(body) if kind != "revisit" or row.get("payload_length") is None else row["payload_length"]
    mime = _line(row.get("content_type") or "application/octet-stream")
    block = body
    if http:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\nContent-Length: {length}\r\n\r\n".encode() + body
    digest = row.get("payload_digest")
    if digest is None and kind != "revisit":
        digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {_line(kind)}", f"WARC-Record-ID: <{_uri(row['record_id'])}>"]
    lines.append(f"WARC-Date: {_line(row.get('date') or '1970-01-01T00:00:00Z')}")
    for name, value in (("WARC-Target-URI", row.get("target_uri")), ("WARC-Refers-To", row.get("refers_to"))):
        if value is not None:
            lines.append(f"{name}: {_uri(value) if name.endswith('URI') else '<' + _uri(value) + '>'}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    if digest is not None:
        lines.append(f"WARC-Payload-Digest: {_line(digest)}")
    lines.append(f"Content-Type: {'application/http; msgtype=response' if http else mime}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """One gzip member that states its own and its content's length in the field `sl`."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    whole = 10 + 2 + 12 + len(body) + 8
    if whole >= 1 << 32 or len(data) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, whole, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H", len(extra)) + extra + body + tail


class WarcWriter(D.DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        files, out = [], None
        try:
            for batch in iterator:
                names = [n for n in batch.schema.names if n in HEADER_OF or n in ("payload", "payload_length")]
                columns = [batch.column(n) for n in names]
                for i in range(batch.num_rows):
                    row = {n: c[i].as_py() for n, c in zip(names, columns)}
                    if out is None:
                        files.append({"name": f"{uuid.uuid4().hex}.warc.gz", "size": 0, "types": {}})
                        out = system.open_output_stream(f"{root}/{files[-1]['name']}", compression=None)
                    member = gzip_member(encode_record(row))
                    out.write(member)
                    now = files[-1]
                    now["size"] += len(member)
                    now["types"][row["record_type"]] = now["types"].get(row["record_type"], 0) + 1
                    if now["size"] >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        content = {"overwrite": self.overwrite, "files": [f for m in messages if m is not None for f in m.files]}
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{root}/_writing-{name}") as out:
            out.write(json.dumps(content).encode())
        system.move(f"{root}/_writing-{name}", f"{root}/_committed-{name}.json")

    def abort(self, messages) -> None:
        system, root = _open(self.path)
        for message in messages:
            for file in message.files if message is not None else ():
                system.delete_file(f"{root}/{file['name']}")


# --- reading ------------------------------------------------------------------------

@dataclass
class Files(D.InputPartition):
    files: list[str] = field(default_factory=list)

    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


def list_files(system: fs.FileSystem, root: str) -> list[dict]:
    """The committed files, or all archives where nothing was committed."""
    if system.get_file_info(root).type == fs.FileType.File:
        return [{"name": root, "size": system.get_file_info(root).size, "types": None}]
    found = {i.path.rsplit("/", 1)[-1]: i for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File}
    files: list[dict] = []
    commits = sorted(n for n in found if n.startswith("_committed-"))
    for name in commits:
        with system.open_input_stream(f"{root}/{name}") as stream:
            content = json.loads(stream.read())
        files = ([] if content["overwrite"] else files) + content["files"]
    if not commits:
        files = [
            {"name": n, "size": i.size, "types": None} for n, i in sorted(found.items()) if n.endswith((".warc", ".warc.gz"))
        ]
    return [{**f, "name": f"{root}/{f['name']}"} for f in files]


def holds(test: D.Filter, record: dict) -> bool | None:
    """What SQL says of a filter on header columns: true, false or unknown."""
    if isinstance(test, D.Not):
        inner = holds(test.child, record)
        return None if inner is None else not inner
    value = record.get(test.attribute[0])
    if isinstance(test, D.IsNull):
        return value is None
    if isinstance(test, D.IsNotNull):
        return value is not None
    if isinstance(test, D.EqualNullSafe):
        return value == test.value
    if value is None or (not isinstance(test, D.In) and test.value is None):
        return None
    if isinstance(test, D.In):
        return True if value in test.value else None if None in test.value else False
    return {
        D.EqualTo: lambda a, b: a == b, D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b,
        D.LessThan: lambda a, b: a < b, D.LessThanOrEqual: lambda a, b: a <= b,
        D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: str.__contains__,
    }[type(test)](value, test.value)


SUPPORTED = (
    D.EqualTo, D.EqualNullSafe, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual, D.In, D.IsNull,
    D.IsNotNull, D.StringStartsWith, D.StringEndsWith, D.StringContains,
)


class WarcReader(D.DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.tests: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for test in filters:
            inner = test.child if isinstance(test, D.Not) else test
            if isinstance(inner, SUPPORTED) and len(inner.attribute) == 1 and inner.attribute[0] in HEADER_OF:
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> Sequence[Files]:
        system, root = _open(self.path)
        tests = [t for t in self.tests if (t.child if isinstance(t, D.Not) else t).attribute[0] == "record_type"]
        plans, size = [], 0
        for file in list_files(system, root):
            kinds = file["types"]
            if kinds is not None and not any(all(holds(t, {"record_type": k}) for t in tests) for k in kinds):
                continue
            if not plans or size + file["size"] > self.split_bytes:
                plans.append([])
                size = 0
            plans[-1].append(file["name"])
            size += file["size"]
        return [Files(plan) for plan in plans or [[]]]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        rows, held = [], 0
        for name in partition.files:
            with system.open_input_file(name) as handle:
                for record in read_records(handle, name, self.tests, self.payload):
                    rows.append(record)
                    held += len(record["payload"] or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([
    *[(n, pa.string()) for n in ("record_id", "record_type", "date", "target_uri", "content_type", "payload_digest", "refers_to")],
    ("content_length", pa.int64()), ("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())),
    ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()),
])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _ARROW)


class _Plain:
    """The bytes of one record that is not compressed."""

    def __init__(self, stream: io.BufferedReader, name: str, start: int):
        self.stream = stream

    def more(self) -> bytes:
        return self.stream.read(CHUNK)


class _Member:
    """The inflated bytes of one gzip member, as far as they are asked for."""

    def __init__(self, stream: io.BufferedReader, name: str, start: int):
        self.stream, self.name, self.start = stream, name, start
        head = stream.read(12)
        self.end = None  # where the member ends, if it says so
        if len(head) == 12 and head[3] & 4:
            extra = stream.read(struct.unpack("<H", head[10:])[0])
            at = 0
            while at + 4 <= len(extra):
                size = struct.unpack("<H", extra[at + 2:at + 4])[0]
                if extra[at:at + 2] == b"sl" and size == 8:
                    self.end = start + struct.unpack("<I", extra[at + 4:at + 8])[0]
                at += 4 + size
        stream.seek(start)
        self.inflate, self.waiting = zlib.decompressobj(31), b""

    def more(self) -> bytes:
        """The next piece, bounded however well the member packs; empty at its end."""
        while not self.inflate.eof:
            data = self.waiting or self.stream.read(CHUNK)
            if not data:
                raise ValueError(f"{self.name}: the record at {self.start} is cut off")
            piece = self.inflate.decompress(data, CHUNK)
            self.waiting = self.inflate.unconsumed_tail
            if piece:
                return piece
        return b""

    def leave(self) -> None:
        """Step over what is left."""
        if self.end is None:
            while self.more():
                pass
            self.stream.seek(self.stream.tell() - len(self.inflate.unused_data))
        else:
            self.stream.seek(self.end)


def _until(source: _Plain | _Member, data: bytearray, mark: bytes, start: int, limit: int) -> int:
    """The place after `mark` at or behind `start`; -1 if `limit` bytes do not hold it."""
    looked = start
    while True:
        at = data.find(mark, max(start, looked - len(mark)), limit)
        if at >= 0:
            return at + len(mark)
        looked = len(data)
        piece = source.more() if looked < limit else b""
        if not piece:
            return -1
        data += piece


def _headers(block: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    last = None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            found[last] = value.strip()
    return found


def read_records(handle, name: str, tests: Sequence[D.Filter] = (), payload: bool = True) -> Iterator[dict]:
    """The records of one file that pass `tests`, their headers parsed before anything else."""
    stream = io.BufferedReader(handle, CHUNK)
    while True:
        start = stream.tell()
        first = stream.read(2)
        if not first:
            return
        if first in (b"\r\n", b"\n\r", b"\n\n"):  # blank lines between records
            continue
        stream.seek(start)
        packed = first == b"\x1f\x8b"
        source = (_Member if packed else _Plain)(stream, name, start)
        data = bytearray()
        body = _until(source, data, b"\r\n\r\n", 0, 1 << 24)
        if body < 0 or not data.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record at {start}")
        headers = _headers(bytes(data[:body - 4]))
        record = {column: headers.get(header) for column, header in HEADER_OF.items()}
        for column in ("record_id", "refers_to"):
            if record[column] is not None:
                record[column] = record[column].removeprefix("<").removesuffix(">")
        length = record["content_length"] = int(record["content_length"])
        if all(holds(test, record) for test in tests):
            yield _finish(source, data, body, length, headers, record, payload) | {"file": name, "offset": start}
        if packed:
            source.leave()
        else:
            stream.seek(start + body + length)


def _finish(source, data: bytearray, body: int, length: int, headers: dict, record: dict, payload: bool) -> dict:
    """The record with its payload's length, and the payload if it is wanted."""
    begin, stop, claimed = body, body + length, None
    if (record["content_type"] or "").startswith("application/http"):
        after = _until(source, data, b"\r\n\r\n", body, stop)
        if after >= 0:
            claimed = _headers(bytes(data[body:after - 4])).get("content-length")
            begin = after
    value = None
    if payload:
        while len(data) < stop:
            piece = source.more()
            if not piece:
                raise ValueError(f"{record['record_id']}: the block is cut off")
            data += piece
        value = bytes(data[begin:stop])
    # A revisit's own payload is left out; its HTTP headers tell how long the full one was.
    own = int(claimed) if record["record_type"] == "revisit" and claimed and claimed.isdigit() else stop - begin
    return {**record, "payload_length": own, "headers": headers, "payload": value}


# --- pages --------------------------------------------------------------------------

def base32_sha1(payload: Column) -> Column:
    """The SHA-1 digest in upper-case base32: five hexadecimal digits are four of its characters."""
    digits, chars = F.sha1(payload), []
    for at in range(0, 40, 5):
        value = F.conv(F.substring(digits, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            chars.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, 1))
    return F.concat(*chars)


def with_revisits(pages: DataFrame, id: str = "page_id", url: str = "url", text: str = "html", least_bytes: int = 0) -> DataFrame:
    """Records of pages: of equal payloads the one with the largest id is kept, others refer to it.

    Rows that share that id are all kept. Payloads under `least_bytes` are kept each. Null ids count
    as smaller than all others. A payload that many pages share is spread over tasks.
    """
    payload = F.coalesce(F.encode(F.col(f"`{text}`"), "utf-8"), F.lit(b""))
    rows = pages.select(
        F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").alias("target_uri"), payload.alias("payload")
    ).withColumns({
        "payload_length": F.octet_length("payload").cast("bigint"), "key": F.sha2("payload", 256),
    })
    groups = rows.groupBy("key").agg(F.max("id").alias("keep"), F.count("*").alias("n"))
    total = rows.count()
    # At most a thousand payloads can have a thousandth of the rows.
    hot = [r["key"] for r in groups.filter(F.col("n") >= max(4096, total // 1000)).select("key").collect()]
    joined = join_salted(rows, groups.select("key", "keep"), "key", hot, spread=F.monotonically_increasing_id())
    kept = (F.col("payload_length") < least_bytes) | F.col("id").eqNullSafe(F.col("keep"))
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    other = F.concat(F.lit("urn:page:"), F.col("keep").cast("string"))
    return joined.select(
        name.alias("record_id"), F.when(kept, "response").otherwise("revisit").alias("record_type"), "target_uri",
        F.lit("text/html; charset=utf-8").alias("content_type"), "payload_length",
        F.concat(F.lit("sha1:"), base32_sha1(F.col("payload"))).alias("payload_digest"),
        F.when(~kept, other).alias("refers_to"), F.when(kept, F.col("payload")).alias("payload"),
    )


def write_archive(records: DataFrame, path: str, **options: object) -> None:
    register(records.sparkSession)
    records.write.format("warc").options(**options).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """`(page_id, payload_bytes, payload_digest, record_type, refers_to)` of an archive.

    Of responses the payload is decoded and measured; revisits are read by their headers alone.
    """
    kept = read_archive(spark, path).filter("record_type = 'response'").select(
        page_of(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to"),
    )
    others = read_archive(spark, path, payload="false").filter("record_type = 'revisit'").select(
        page_of(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )
    return kept.unionByName(others)


def new_archive(spark: SparkSession) -> str:
    return new_path(spark, "archive")
