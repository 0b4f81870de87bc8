"""WARC as a PySpark data source: planned file partitions, filters on record headers, payloads read for kept records only."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

SCHEMA = "warc_type string, record_id string, target_uri string, date string, content_type string, content_length long, headers map<string,string>, file string, offset long, payload binary, error string"
#: Columns that come from a header line, by its name in lower case.
FROM_HEADER = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "content_length": "content-length"}
TARGET_BYTES = 64 << 20
FILE_BYTES = 128 << 20
HEAD = 16 << 10
#: Bytes of gzip's header and trailer around an empty body: no member is shorter.
LEAST_MEMBER = 20
#: Bytes of headers beyond which a record is taken as broken.
MOST_HEADERS = 16 << 20
BATCH_BYTES = 8 << 20
_SUFFIX = re.compile(r"\.warc(\.gz)?$")


def _system(path: str):
    """The file system and the path in it; a path without a scheme is local, as file: is."""
    if not urlsplit(path).scheme:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class Files(InputPartition):
    """Files of one task: (path, size)."""

    files: tuple[tuple[str, int], ...]


def plan(sizes: list[tuple[str, int]], target: int) -> list[Files]:
    """Files in order of path, together up to target bytes a task; a larger file is a task by itself."""
    out: list[list[tuple[str, int]]] = []
    total = 0
    for path, size in sorted(sizes):
        if not out or total + size > target:
            out.append([])
            total = 0
        out[-1].append((path, size))
        total += size
    return [Files(tuple(x)) for x in out]


def parse_headers(head: bytes) -> dict[str, str]:
    """Header lines by name in lower case (values stripped; continued lines joined) after the version line."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record begins with {lines[0][:40]!r}")
    out: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def field(headers: dict[str, str], column: str):
    value = headers.get(FROM_HEADER[column])
    return body_length(headers) if column == "content_length" and value is not None else value


def body_length(headers: dict[str, str]) -> int:
    """Content-Length, 0 if it is missing; anything but digits is no length."""
    value = headers.get("content-length", "0")
    if not (value.isascii() and value.isdigit()):
        raise ValueError(f"{value[:40]!r} is no Content-Length")
    return int(value)


def accepts(f: Filter, headers: dict[str, str]) -> bool:
    """Whether a record's headers pass a filter, by SQL's rules: a comparison with a missing header doesn't."""
    if isinstance(f, Not):
        return field(headers, f.child.attribute[0]) is not None and not accepts(f.child, headers)
    value = field(headers, f.attribute[0])
    if value is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return value.endswith(f.value)
    if isinstance(f, StringContains):
        return f.value in value
    if isinstance(f, GreaterThan):
        return value > f.value
    if isinstance(f, GreaterThanOrEqual):
        return value >= f.value
    return value < f.value if isinstance(f, LessThan) else value <= f.value


def supported(f: Filter) -> bool:
    if isinstance(f, Not):
        return isinstance(f.child, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and supported(f.child)
    kinds = (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
    if not isinstance(f, kinds) or len(f.attribute) != 1 or f.attribute[0] not in FROM_HEADER:
        return False
    values = f.value if isinstance(f, In) else () if isinstance(f, IsNotNull) else (f.value,)
    return all(v is not None for v in values)


def _skip_length(head: bytes) -> int | None:
    """The member's compressed length, as gzip's extra field "sl" tells it, if it does."""
    if len(head) < 12 or not head[3] & 4:
        return None
    extra, at = head[12 : 12 + int.from_bytes(head[10:12], "little")], 0
    while at + 4 <= len(extra):
        size = int.from_bytes(extra[at + 2 : at + 4], "little")
        if extra[at : at + 2] == b"sl" and size >= 4:
            told = int.from_bytes(extra[at + 4 : at + 8], "little")
            return told if told >= LEAST_MEMBER else None
        at += 4 + size
    return None


def _record(f, at: int, size: int, compressed: bool, filters: list[Filter], with_payload: bool) -> tuple[int, dict[str, str] | None, bytes | None]:
    """Where the next record begins, and headers and payload of this one (None: it isn't wanted). ValueError: it is broken."""
    f.seek(at)
    raw = f.read(HEAD)
    if compressed:
        member = _skip_length(raw)
        d = zlib.decompressobj(31)
        head, fed = d.decompress(raw, HEAD), len(raw)
        while b"\r\n\r\n" not in head and not d.eof and len(head) <= MOST_HEADERS:
            more = d.unconsumed_tail or f.read(HEAD)
            if not more:
                raise ValueError(f"the record at {at} ends early")
            fed += 0 if d.unconsumed_tail else len(more)
            head += d.decompress(more, HEAD)
    else:
        head = raw
        while b"\r\n\r\n" not in head and len(head) <= MOST_HEADERS and (more := f.read(HEAD)):
            head += more
    end = head.find(b"\r\n\r\n")
    if end < 0:
        if not head.strip():
            return size, None, None
        if not head.startswith(b"WARC/"):
            parse_headers(head)
        raise ValueError(f"the record at {at} has no end of headers")
    headers = parse_headers(head[:end])
    length = body_length(headers)
    wanted = all(accepts(x, headers) for x in filters)
    payload = None
    if compressed:
        if wanted and with_payload or member is None:
            body, have = [head[end + 4 :]], len(head) - end - 4
            while not d.eof:
                more = d.unconsumed_tail or f.read(1 << 20)
                if not more:
                    raise ValueError(f"the record at {at} ends early")
                fed += 0 if d.unconsumed_tail else len(more)
                piece = d.decompress(more, 1 << 22)
                have += len(piece)
                if wanted and with_payload:
                    body.append(piece)
            if have < length:
                raise ValueError(f"the record at {at} ends early")
            payload = b"".join(body)[:length] if wanted and with_payload else None
        following = at + (member if member is not None else fed - len(d.unused_data))
    else:
        following = at + end + 4 + length + 4
        if at + end + 4 + length > size:
            raise ValueError(f"the record at {at} ends early")
        if wanted and with_payload:
            f.seek(at + end + 4)
            payload = f.read(length)
    if following <= at:
        raise ValueError(f"the record at {at} has no length")
    return following, headers if wanted else None, payload


def _next_start(f, at: int, size: int, compressed: bool) -> int:
    """The first place from at where a record seems to begin; size if there is none. Read in pieces that overlap."""
    mark, step = (b"\x1f\x8b\x08" if compressed else b"WARC/"), 1 << 20
    while at < size:
        f.seek(at)
        piece = f.read(step)
        place = piece.find(mark)
        while place >= 0:
            if not compressed:
                return at + place
            f.seek(at + place)
            try:
                if zlib.decompressobj(31).decompress(f.read(HEAD), 5) == b"WARC/":
                    return at + place
            except zlib.error:
                pass
            place = piece.find(mark, place + 1)
        if len(piece) < step:
            break
        at += step - len(mark) + 1
    return size


def records(f, size: int, compressed: bool, filters: list[Filter], with_payload: bool, permissive: bool = False) -> Iterator[tuple[int, dict[str, str], bytes | None, str | None]]:
    """(offset, headers, payload, error) of the records that pass. Of the others no more than the headers is decoded.

    A broken record raises ValueError or, if permissive, comes without headers and payload but with an error, unless there
    are filters, which it can't pass; reading goes on where the next record begins.
    """
    at = 0
    while at < size:
        try:
            following, headers, payload = _record(f, at, size, compressed, filters, with_payload)
        except (ValueError, zlib.error) as e:
            if not permissive:
                raise ValueError(str(e)) from e
            if not filters:
                yield at, {}, None, str(e)
            at = _next_start(f, at + 1, size, compressed)
            continue
        if headers is not None:
            yield at, headers, payload, None
        at = following


class WarcReader(DataSourceReader):
    def __init__(self, options, path: str):
        self.path = path
        self.target = int(options.get("targetBytes", TARGET_BYTES))
        self.with_payload = str(options.get("payload", "true")).lower() != "false"
        self.permissive = str(options.get("mode", "permissive")).lower() != "failfast"
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if supported(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        system, path = _system(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        return plan([(x.path, x.size) for x in found if x.is_file and _SUFFIX.search(x.path) and x.size], self.target) or [Files(())]

    def read(self, partition):
        system, _ = _system(self.path)
        schema = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("file", pa.string()), ("offset", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
        rows, held = [], 0
        for path, size in partition.files:
            with system.open_input_file(path) as f:
                for at, h, payload, error in records(f, size, path.endswith(".gz"), self.filters, self.with_payload, self.permissive):
                    rows.append((*(field(h, c) for c in FROM_HEADER), list(h.items()), path, at, payload, error))
                    held += len(payload or b"") + 512
                    if held > BATCH_BYTES:
                        yield _record_batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield _record_batch(rows, schema)


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def _line(name: str, value: str) -> bytes:
    return f"{name}: ".encode() + re.sub(r"[\r\n]+", " ", value).encode() + b"\r\n"


def encode(fields: dict, compressed: bool) -> bytes:
    """One record. fields: warc_type, record_id, target_uri, date, content_type, headers (pairs), payload; nulls give no line."""
    payload = fields.get("payload") or b""
    out = [b"WARC/1.1\r\n"]
    for name, key in (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("Content-Type", "content_type")):
        if fields.get(key) is not None:
            out.append(_line(name, fields[key]))
    out += [_line(k, v) for k, v in fields.get("headers") or [] if v is not None]
    record = b"".join([*out, f"Content-Length: {len(payload)}\r\n\r\n".encode(), payload, b"\r\n\r\n"])
    if not compressed:
        return record
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    whole = 24 + len(body) + 8
    extra = b"sl" + (8).to_bytes(2, "little") + whole.to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra
    return head + body + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")


class WarcWriter(DataSourceArrowWriter):
    """Each task attempt writes files of its own; commit gives those of the attempts that counted their names."""

    def __init__(self, options, path: str):
        self.path = path
        self.compressed = str(options.get("compression", "gzip")).lower() == "gzip"
        self.most = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator):
        system, base = _system(self.path)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        files: list[tuple[str, str]] = []
        sink, size = None, 0
        for b in iterator:
            for row in b.to_pylist():
                if sink is None:
                    name = f"{base}/part-{task.partitionId():05d}-{len(files):03d}.warc" + ".gz" * self.compressed
                    files.append((f"{name}.{task.taskAttemptId()}.tmp", name))
                    sink, size = system.open_output_stream(files[-1][0], compression=None), 0
                record = encode(row, self.compressed)
                sink.write(record)
                size += len(record)
                if size >= self.most:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()
        return Written(files)

    def commit(self, messages):
        system, base = _system(self.path)
        system.create_dir(base, recursive=True)
        for m in messages:
            for tmp, name in m.files if m else ():
                system.move(tmp, name)

    def abort(self, messages):
        system, _ = _system(self.path)
        for m in messages:
            for tmp, _name in m.files if m else ():
                if system.get_file_info(tmp).is_file:
                    system.delete_file(tmp)


class WarcSource(DataSource):
    """spark.read.format("warc").load(path): one row a record, columns as in SCHEMA; header names in lower case.

    Options: payload=false leaves payloads unread and null, targetBytes is a task's share of files, mode=failfast makes a
    broken record (cut short, without headers or with a wrong length) fail the read; else it is a row with an error and no
    headers, and reading goes on at the next record. A length in gzip's extra field that is too short is not believed. Filters on warc_type,
    record_id, target_uri, date, content_type and content_length are checked on the headers when
    spark.sql.python.filterPushdown.enabled is on; others, and those on the map of headers, are left to Spark.
    write takes those columns (any subset), with compression (gzip or none) and fileBytes.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, self.options["path"])

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source known and filters pushed to Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


_EMPTY_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A request and a response record for each page. A null url or key gives no such header, a null html an empty body."""
    u, k, body = pages[url].alias("u"), pages[key].cast("string").alias("k"), F.coalesce(pages[html], F.lit("")).alias("b")
    p = pages.select(u, k, body)
    pair = lambda kind, content, payload: F.struct(
        F.lit(kind).alias("warc_type"), F.concat(F.lit("<urn:md5:"), F.md5(F.concat_ws("|", F.lit(kind), "k", "u", payload)), F.lit(">")).alias("record_id"), F.col("u").alias("target_uri"),
        F.lit(content).alias("content_type"), F.create_map(F.lit("X-Page-Id"), F.col("k")).alias("headers"), F.encode(payload, "utf-8").alias("payload"),
    )
    request = pair("request", "application/http; msgtype=request", F.concat(F.lit("GET "), F.coalesce("u", F.lit("")), F.lit(" HTTP/1.1\r\n\r\n")))
    response = pair("response", "application/http; msgtype=response", F.concat(F.lit(_EMPTY_HTTP), F.col("b")))
    return p.select(F.explode(F.array(request, response)).alias("r")).select("r.*")


def http_body(payload: Column) -> Column:
    """The text after an HTTP message's headers: UTF-8 if it is that, else read as ISO-8859-1, which takes any bytes."""
    end = F.instr(F.decode(payload, "ISO-8859-1"), "\r\n\r\n")
    body = F.when(end > 0, F.substring(payload, end + 4, F.octet_length(payload))).otherwise(payload)
    return F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(F.decode(body, "ISO-8859-1"))


def responses(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html of the response records of WARC files written from page_records().

    Request records are passed over by their headers. Missing headers are null. Repeated pages are repeated records;
    very long pages are read whole; a folder without files gives an empty table. Broken records, and page numbers that are none (null), stop nothing.
    """
    r = registered(spark).read.format("warc").load(path).filter("warc_type = 'response'")
    return r.select(F.col("headers")["x-page-id"].try_cast("long").alias("page_id"), F.col("target_uri").alias("url"), http_body(F.col("payload")).alias("html"))


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Pages written as WARC to path and read again."""
    spark = registered(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").save(path)
    return responses(spark, path)
