"""WARC archives: a Python data source that reads and writes them.

Reading: each archive is a partition. Predicates on record_type, target_uri and record_id (equality and lists) are pushed
down: a record's header is parsed first, and the block of a record that doesn't pass, or whose payload isn't asked for, is
skipped. In .warc.gz files each record is a member of its own that states its compressed length in the "sl" field, so
skipping needs no decompression; members without that field are decompressed to their end. Payloads of HTTP responses come
without the HTTP header.

Writing: rows become records of type response or revisit, members of one .warc.gz per task. A folder's `_archives` file
lists what was committed; files of failed or repeated tasks are not in it and are not read.

A null payload is the empty one. A null record_id is written as one made from the URI and the digest. Values with line ends
or other control characters come back as they were. An empty table gives no archive, and reads back as no rows. A broken
archive, or a header of more than 1 MB, fails its task with the file's name.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any, BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .stores import at, files_in, read_file, write_file

SCHEMA = "record_id string, record_type string, target_uri string, record_date string, content_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"
COLUMNS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI"}
END = b"\r\n\r\n"
# The profile that the WARC standard names for revisits of equal payloads, and its version line.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1"
CHUNK = 1 << 16
LONGEST_HEADER = 1 << 20
ESCAPED, SAFE = "X-Escaped-Fields", "/:?#[]@!$&'()*+,;=-._~"


def member(data: bytes, level: int = 2) -> bytes:
    """A gzip member whose extra field "sl" has its own length and that of its content."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 12 + 12 + len(body) + 8
    head = struct.pack("<BBBBIBBH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def header(fields: Sequence[tuple[str, str | None]]) -> bytes:
    """Values with control characters or blanks at their ends are written with percent signs, and named in a field of their
    own, so that they neither end the header nor come back changed."""
    odd = [k for k, v in fields if v is not None and (not v.isprintable() or v != v.strip())]
    lines = [f"{k}: {quote(v, safe=SAFE) if k in odd else v}" for k, v in fields if v is not None]
    lines += [f"{ESCAPED}: {' '.join(odd)}"] if odd else []
    return "\r\n".join([VERSION, *lines]).encode() + END


def digest_text(hexa: str | None) -> str | None:
    return None if hexa is None else "sha1:" + base64.b32encode(bytes.fromhex(hexa)).decode()


def digest_hex(text: str | None) -> str | None:
    """Bare lower-case hex of a labelled digest in base 32 or hex."""
    if text is None:
        return None
    value = text.partition(":")[2] or text
    try:
        return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    except ValueError:  # another archive's own way to write it
        return value


def record(row: dict[str, Any]) -> bytes:
    """The bytes of a record. Response: an HTTP response with the payload. Revisit: only an HTTP header; digest and length
    are those of the payload that isn't repeated."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    size = row.get("payload_bytes")
    size = len(payload) if size is None else size
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {row.get('content_type') or 'text/html; charset=utf-8'}\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = row.get("payload_digest") or hashlib.sha1(payload).hexdigest()
    name = row.get("record_id")
    if name is None:
        name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row.get("target_uri")} {digest}')}"
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", row.get("record_date") or "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", row.get("target_uri")),
        ("WARC-Payload-Digest", digest_text(digest)),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", f"<{row['refers_to']}>" if revisit and row.get("refers_to") is not None else None),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return header(fields) + block + END


class Source:
    """Records of one archive, one at a time: header first, then block() or skip()."""

    def __init__(self, file: BinaryIO, packed: bool) -> None:
        self.file, self.packed, self.held = file, packed, b""

    def _more(self) -> bool:
        data = self.file.read(CHUNK)
        self.held += data
        return bool(data)

    def _need(self, n: int) -> bool:
        if len(self.held) < n:
            self.held += self.file.read(max(n - len(self.held), CHUNK))
        while len(self.held) < n and self._more():
            pass
        return len(self.held) >= n

    def _drop(self, n: int) -> None:
        """Goes n bytes on without keeping them."""
        if n <= len(self.held):
            self.held = self.held[n:]
            return
        n -= len(self.held)
        self.held = b""
        if hasattr(self.file, "seek") and getattr(self.file, "seekable", lambda: False)():
            self.file.seek(n, 1)
            return
        while n:
            n -= len(data := self.file.read(min(n, CHUNK)))
            if not data:
                raise EOFError("the archive ends within a record")

    def headers(self) -> dict[str, str] | None:
        """Of the next record; None at the end."""
        if self.packed:
            if not self._need(18):
                if self.held:
                    raise EOFError("the archive ends within a record")
                return None
            if self.held[:2] != b"\x1f\x8b":
                raise ValueError("no gzip member where a record should begin")
            stated = self.held[3] & 4 and self.held[12:14] == b"sl" and self._need(24)
            self.size = struct.unpack_from("<I", self.held, 16)[0] if stated else 0
            self.unpacker, self.text, self.taken = zlib.decompressobj(31), b"", 0
            while END not in self.text and len(self.text) < LONGEST_HEADER and self._unpack(4096):
                pass
        else:
            while not self.held.strip(b"\r\n") and self._more():
                pass
            self.held = self.held.lstrip(b"\r\n")
            if not self.held:
                return None
            while END not in self.held and len(self.held) < LONGEST_HEADER and self._more():
                pass
            self.text = self.held
        raw, found, _ = self.text.partition(END)
        lines = raw.decode("utf-8", "replace").split("\r\n")
        if not found or not lines[0].startswith("WARC/"):
            raise ValueError("no record header where a record should begin")
        out = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        for name in out.get(ESCAPED.lower(), "").lower().split():
            out[name] = unquote(out.get(name, ""))
        self.start, self.length = len(raw) + 4, int(out.get("content-length", 0))
        return out

    def _unpack(self, limit: int) -> bool:
        """Some more text of the member; False at its end. What the unpacker has taken is no longer held."""
        if self.unpacker.eof:
            return False
        data = self.unpacker.unconsumed_tail
        if not data:
            if not self.held and not self._more():
                raise EOFError("the archive ends within a record")
            data, self.held = self.held, b""
            self.taken += len(data)
        self.text += self.unpacker.decompress(data, limit)
        if self.unpacker.eof:
            self.held = self.unpacker.unused_data + self.held
            self.taken -= len(self.unpacker.unused_data)
        return True

    def block(self) -> bytes:
        if not self.packed:
            if not self._need(self.start + self.length):
                raise EOFError("the archive ends within a record")
            out = self.held[self.start : self.start + self.length]
            self._drop(self.start + self.length)
            return out
        pieces, self.text, total = [self.text], b"", len(self.text)
        while self._unpack(1 << 20):
            pieces.append(self.text)
            total += len(self.text)
            self.text = b""
        return b"".join(pieces)[self.start : self.start + self.length]

    def skip(self) -> None:
        if not self.packed:
            self._drop(self.start + self.length)
        elif self.size and not self.unpacker.eof:
            self.unpacker = None
            self._drop(self.size - self.taken)
        else:
            while self._unpack(1 << 20):
                self.text = b""


def bare(value: str | None) -> str | None:
    return value[1:-1] if value and value.startswith("<") and value.endswith(">") else value


def row_of(head: dict[str, str], block: bytes | None) -> tuple:
    payload = block
    if block is not None and head.get("content-type", "").startswith("application/http"):
        payload = block.partition(END)[2]
    stated = head.get("x-payload-length")
    revisit = head.get("warc-type") == "revisit"
    size = int(stated) if stated is not None else (len(payload) if payload is not None and not revisit else None)
    return (
        bare(head.get("warc-record-id")), head.get("warc-type"), bare(head.get("warc-target-uri")), head.get("warc-date"), head.get("content-type"),
        digest_hex(head.get("warc-payload-digest")), size, bare(head.get("warc-refers-to")), None if revisit else payload,
    )


ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "record_type", "target_uri", "record_date", "content_type", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())]
)


@dataclass
class Archive(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload = path, payload
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            if name in COLUMNS and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Archive]:
        listed = f"{self.path.rstrip('/')}/_archives"
        store, name = at(listed)
        if store.get_file_info(name).is_file:
            return [Archive(f"{self.path.rstrip('/')}/{x}") for x in json.loads(read_file(listed))] or [Archive("")]
        return [Archive(x) for x in files_in(self.path, (".warc", ".warc.gz"))] or [Archive("")]

    def passes(self, head: dict[str, str]) -> bool:
        return all(bare(head.get(COLUMNS[name].lower())) in values for name, values in self.wanted.items())

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, name = at(partition.path)
        rows: list[tuple] = []
        size = 0
        with store.open_input_file(name) as file:
            source = Source(file, name.endswith(".gz"))
            try:
                while (head := source.headers()) is not None:
                    if not self.passes(head):
                        source.skip()
                        continue
                    block = None
                    if self.payload and head.get("warc-type") != "revisit":
                        block = source.block()
                    else:
                        source.skip()
                    rows.append(row_of(head, block))
                    size += len(block or b"")
                    if size > 4 << 20 or len(rows) >= 5000:
                        yield batch_of(rows)
                        rows, size = [], 0
            except (ValueError, EOFError, zlib.error) as e:
                raise ValueError(f"{partition.path}: {e}") from e
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Records are compressed as they come, into one file of the task; it is renamed when whole."""
        name = f"{uuid.uuid4().hex}.warc.gz"
        store, folder = at(self.path)
        store.create_dir(folder, recursive=True)
        n = 0
        with store.open_output_stream(f"{folder}/.{name}.part", compression=None) as out:
            for batch in iterator:
                columns = {k: batch.column(k) for k in batch.schema.names}
                for i in range(batch.num_rows):
                    out.write(member(record({k: c[i].as_py() for k, c in columns.items()})))
                    n += 1
        if not n:
            store.delete_file(f"{folder}/.{name}.part")
            return Written([])
        store.move(f"{folder}/.{name}.part", f"{folder}/{name}")
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        write_file(f"{self.path}/_archives", json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = at(self.path)
        for m in messages:
            for f in m.files if m else []:
                store.delete_file(f"{folder}/{f}")


class WarcSource(DataSource):
    """spark.read.format("warc").load(path), with option payload=false for headers only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: Any, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write(df: DataFrame, path: str) -> None:
    """df: some of SCHEMA's columns, record_id, record_type and payload among them; others are left out. A row in is a
    record in an archive."""
    register(df.sparkSession)
    names = [n.split()[0] for n in SCHEMA.split(", ")]
    df.select(*(n for n in names if n in df.columns)).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def with_revisits(df: DataFrame, least: int = 1000) -> DataFrame:
    """df: record_id, order (sortable), payload. Adds payload_digest, payload_bytes, record_type and refers_to: of records
    with equal payloads of at least so many bytes, the one with the largest order is the response. Repeated payloads are
    found by digests; only those that do repeat are joined back, and a payload that a third of all rows share is split by
    the skew join, as both sides are dealt out for the join alone. Rows that share the largest order and the record_id are
    all responses; null orders are the least. Columns of df that have an output's name are replaced."""
    from .shared import written

    df = df.drop("payload_digest", "payload_bytes", "record_type", "refers_to")
    df = df.withColumn("payload", F.coalesce("payload", F.lit(b"")))
    df = df.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    last = F.max(F.struct("order", "record_id")).alias("last")
    groups = df.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(last, F.count(F.lit(1)).alias("n"))
    repeated = written(groups.where("n > 1").select("payload_digest", F.col("last.record_id").alias("__keeper")), "repeated")
    joined = df.join(repeated, "payload_digest", "left")
    revisit = F.col("__keeper").isNotNull() & ~F.col("__keeper").eqNullSafe(F.col("record_id")) & (F.col("payload_bytes") >= least)
    return joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("__keeper"))}).drop("__keeper")
