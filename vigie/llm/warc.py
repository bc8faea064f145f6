"""WARC archives as a Spark source and sink, one gzip member per record.

``spark.read.format("vigie_warc")`` splits every archive into byte ranges, one
task each, of at most ``split_bytes``. A range owns the records that start in
it. Its task scans the range for gzip's magic bytes and validates a candidate
by decoding its record's header; since compressed or embedded bytes may look
like a member, a candidate only counts if the members after it follow each
other without a gap up to the range's end (or the file's). From there the task
decodes record by record, the last one beyond its range if need be. A task
holds one record and a read buffer, whatever the size of the archive. Record
digests are checked; truncated or damaged archives raise. A record that embeds,
uncompressed, a whole archive longer than a range could mislead a split: read
such files with a ``split_bytes`` beyond their size.

The sink writes one archive per task (a new one after ``file_bytes``) to a
folder of its own, and renames the files when the whole job has succeeded, so
that repeated or lost tasks leave nothing behind. Both ends reach the store
through ``pyarrow.fs``.

``revisits`` marks, of records with equal payloads, the one with the largest id
as ``response`` and the others as its revisits, which store no payload. Groups
are told by SHA-256, combined before the shuffle, and joined back in a join
that adaptive execution can split where one payload holds many rows.

Cases: a NULL payload is empty. NULL ids are the smallest; of rows that repeat
a group's largest id the first of the table is the response, and all of a
group's rows with NULL ids revisit an id of NULL. A NULL address has no field
in the record. Line breaks in addresses are percent-encoded. An empty table
gives an empty folder, which reads as no rows. Only the columns named are used.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shared import run_dir

FORMAT = "vigie_warc"
MAGIC = b"\x1f\x8b\x08"
CHUNK = 64 << 10      # compressed bytes handed to the decoder at once
READ = 1 << 20        # bytes read from the store at once
FILE_BYTES = 1 << 30  # an archive's size, about
BATCH_BYTES = 16 << 20
NAMESPACE = uuid.UUID("6b0c8a52-6f0e-5d0b-9a55-3f7a43c3c1de")
SCHEMA = ("file string, offset long, record_type string, record_id string, target_uri string, date string, page_id string, "
          "payload_digest string, payload_bytes long, refers_to_record string, refers_to_page string, payload binary")
ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
                   ("target_uri", pa.string()), ("date", pa.string()), ("page_id", pa.string()), ("payload_digest", pa.string()),
                   ("payload_bytes", pa.int64()), ("refers_to_record", pa.string()), ("refers_to_page", pa.string()),
                   ("payload", pa.binary())])


# ------------------------------------------------------------------ records

def record_urn(kind: str, page_id: str | None, digest: str, place: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}|{page_id}|{digest}|{place}')}>"


def _one_line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def head_of(data: bytes, what: str) -> tuple[str, dict[str, str], int]:
    """First line, fields by lower-case name, and the place after the blank line."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError(f"{what}: the header does not end")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in " \t" and last:
            fields[last] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip().lower()
        fields[last] = value.strip()
    return lines[0], fields, end + 4


def parse(data: bytes, where: str) -> dict:
    """A record's columns; raises where lengths or digests do not hold."""
    version, fields, at = head_of(data, where)
    if not version.startswith("WARC/1."):
        raise ValueError(f"{where}: not a WARC record")
    size = int(fields["content-length"])
    block = data[at:at + size]
    if len(block) != size or data[at + size:] != b"\r\n\r\n":
        raise ValueError(f"{where}: the record's length is wrong")
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest")
    out = {"record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
           "date": fields.get("warc-date"), "page_id": fields.get("x-page-id"), "refers_to_record": fields.get("warc-refers-to"),
           "refers_to_page": fields.get("x-refers-to-page-id"), "payload": None, "payload_bytes": None,
           "payload_digest": digest.removeprefix("sha1:") if digest else None}
    if kind not in ("response", "revisit"):
        return out
    _, http, body = head_of(block, where)
    if kind == "revisit":
        out["payload_bytes"] = int(http["content-length"]) if "content-length" in http else None
        return out
    payload = block[body:]
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest and digest.startswith("sha1:") and digest != f"sha1:{found}":
        raise ValueError(f"{where}: the payload does not have the digest that its record names")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": found}


# ------------------------------------------------------------------ reading byte ranges

class Archive:
    """Decodes members of one archive; holds one read buffer."""

    def __init__(self, source, size: int, name: str):
        self.source, self.size, self.name = source, size, name
        self.at, self.buffer = 0, b""

    def bytes_at(self, pos: int, n: int) -> bytes:
        """Up to n bytes from pos on; fewer only at the end of the file."""
        n = min(n, self.size - pos)
        if n <= 0:
            return b""
        if not (self.at <= pos and pos + n <= self.at + len(self.buffer)):
            self.source.seek(pos)
            self.at, self.buffer = pos, self.source.read(min(max(n, READ), self.size - pos))
        return self.buffer[pos - self.at:pos - self.at + n]

    def decode(self, pos: int, keep: bool = True) -> tuple[bytes, int]:
        """The member at pos and the place after it; without ``keep`` only its first bytes come back."""
        unpack, parts, first = zlib.decompressobj(31), [], b""
        while not unpack.eof:
            chunk = self.bytes_at(pos, CHUNK)
            if not chunk:
                raise ValueError(f"{self.name}: truncated in the member that ends after byte {pos}")
            pos += len(chunk)
            while chunk and not unpack.eof:
                out = unpack.decompress(chunk, READ)
                if keep:
                    parts.append(out)
                elif len(first) < 7:
                    first = (first + out)[:7]
                chunk = unpack.unconsumed_tail
            pos -= len(unpack.unused_data)
        return (b"".join(parts) if keep else first), pos

    def chained(self, pos: int, end: int) -> bool:
        """Whether records follow each other without a gap from pos up to ``end`` or the end of the file."""
        try:
            while pos < min(end, self.size):
                first, pos = self.decode(pos, keep=False)
                if first and not first.startswith(b"WARC/1."):
                    return False
        except (zlib.error, ValueError):
            return False
        return pos == self.size or self.bytes_at(pos, 3) == MAGIC

    def first(self, start: int, end: int) -> int | None:
        """The first record that starts in the range."""
        if start == 0:
            return 0
        pos = start
        while pos < min(end, self.size):
            window = self.bytes_at(pos, min(READ, end + 2 - pos))
            found = window.find(MAGIC)
            if found < 0:
                pos += max(1, len(window) - 2)
                continue
            pos += found
            if pos >= end:
                return None
            flags = self.bytes_at(pos + 3, 1)
            if flags and not flags[0] & 0xE0 and self.chained(pos, end):
                return pos
            pos += 1
        return None

    def records(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        pos = self.first(start, end)
        while pos is not None and pos < min(end, self.size):
            try:
                data, after = self.decode(pos)
            except zlib.error as bad:
                raise ValueError(f"{self.name}: no gzip member at byte {pos}") from bad
            if data:  # an empty member holds no record
                yield pos, data
            pos = after


@dataclass
class Range(InputPartition):
    """A byte range of one archive."""

    path: str
    size: int
    start: int
    end: int

    def __init__(self, path, size, start, end):
        super().__init__(None)
        self.path, self.size, self.start, self.end = path, size, start, end


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", 128 << 20))
        self.payload = str(options.get("payload", "true")).lower() == "true"
        if self.split < 1:
            raise ValueError("split_bytes must be positive")

    def partitions(self) -> list[Range]:
        store, path = pafs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else store.get_file_info(pafs.FileSelector(path, recursive=False))
        files = sorted((f for f in files if f.is_file and f.size and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        return [Range(f.path, f.size, s, min(s + self.split, f.size)) for f in files for s in range(0, f.size, self.split)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        store, _ = pafs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        with store.open_input_file(partition.path) as source:
            archive = Archive(source, partition.size, partition.path)
            for offset, data in archive.records(partition.start, partition.end):
                row = parse(data, f"{partition.path} at {offset}") | {"file": partition.path, "offset": offset}
                if not self.payload:
                    row["payload"] = None
                rows.append(row)
                held += len(row["payload"] or b"") + 500
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


# ------------------------------------------------------------------ writing

@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceArrowWriter):
    """Takes page_id, url, payload, digest, record_type, refers_to, refers_to_url."""

    def __init__(self, options, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.date = options["date"]
        self.overwrite = overwrite
        self.job = f"_job-{uuid.uuid4().hex}"

    def _store(self):
        return pafs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = self._store()
        store.create_dir(f"{path}/{self.job}", recursive=True)
        names, out, size, count = [], None, 0, 0
        task = uuid.uuid4().hex
        try:
            for batch in iterator:
                for row in self._rows(batch):
                    if out is None:
                        names.append(f"part-{task}-{len(names)}.warc.gz")
                        out = store.open_output_stream(f"{path}/{self.job}/{names[-1]}", compression=None)
                        size = out.write(member(record("warcinfo", [
                            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date),
                            ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                    size += out.write(member(self._record(row, f"{task}/{count}")))
                    count += 1
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def _rows(self, batch: pa.RecordBatch) -> Iterator[dict]:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}

    def _record(self, row: dict, place: str) -> bytes:
        payload = row["payload"] or b""
        digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
        page, url = row["page_id"], row["url"]
        again = row["record_type"] == "revisit"
        fields = [
            ("WARC-Record-ID", record_urn("revisit" if again else "response", page, digest, place if again else "")),
            ("WARC-Target-URI", None if url is None else _one_line(url)),
            ("WARC-Date", self.date),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http;msgtype=response"),
            ("X-Page-ID", page),
        ]
        if again:
            fields += [
                ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("WARC-Refers-To", record_urn("response", row["refers_to"], digest)),
                ("WARC-Refers-To-Target-URI", None if row["refers_to_url"] is None else _one_line(row["refers_to_url"])),
                ("X-Refers-To-Page-ID", row["refers_to"]),
            ]
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
        return record(row["record_type"], fields, http if again else http + payload)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = self._store()
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(pafs.FileSelector(path, recursive=False)):
                if old.is_file and old.base_name.endswith(".warc.gz"):
                    store.delete_file(old.path)
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{path}/{self.job}/{name}", f"{path}/{name}")
        self._clear(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store, path) -> None:
        if store.get_file_info(f"{path}/{self.job}").type == pafs.FileType.Directory:
            store.delete_dir(f"{path}/{self.job}")


class WarcSource(DataSource):
    """``format("vigie_warc")``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


# ------------------------------------------------------------------ frames

def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """The records to write: of equal payloads of at least ``min_bytes`` bytes, the largest id answers for all.

    ``pages`` is read twice and has to give the same rows in the same order,
    as a table of files does.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload.cast("binary")).alias("digest"),
        F.unhex(F.sha2(payload, 256)).alias("key"), F.monotonically_increasing_id().alias("place"))
    # the largest id wins (NULL is the smallest), then the first place
    order = F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("id"), (-F.col("place")).alias("place"), F.col("url").alias("url"))
    groups = (rows.where(F.col("bytes") >= min_bytes).groupBy("key").agg(F.max(order).alias("top"), F.count(F.lit(1)).alias("members"))
              .where("members > 1").select("key", "top"))
    joined = rows.join(groups, "key", "left")
    again = F.col("top").isNotNull() & (F.col("bytes") >= min_bytes) & (F.col("place") != -F.col("top.place"))
    return joined.select(
        F.col("id").cast("string").alias("page_id"), "url", F.when(again, F.lit(None)).otherwise(F.col("payload").cast("binary")).alias("payload"),
        "bytes", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("top.id")).cast("string").alias("refers_to"), F.when(again, F.col("top.url")).alias("refers_to_url"))


def write_warc(records: DataFrame, folder: str, date: str | None = None, file_bytes: int = FILE_BYTES, mode: str = "append") -> None:
    """Records of ``revisits`` as archives in ``folder``; ``date`` is their WARC-Date (now, unless given)."""
    records.sparkSession.dataSource.register(WarcSource)
    date = date or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    records.write.format(FORMAT).mode(mode).option("date", date).option("file_bytes", file_bytes).save(folder)


def read_warc(spark: SparkSession, path: str, split_bytes: int | None = None, payload: bool = True) -> DataFrame:
    """All records of an archive or of a folder's archives.

    ``split_bytes`` is the size of a task's range, by default the session's
    ``spark.sql.files.maxPartitionBytes``. Without ``payload`` the payloads are
    checked but not returned.
    """
    if split_bytes is None:
        split_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    spark.dataSource.register(WarcSource)
    return spark.read.format(FORMAT).option("split_bytes", split_bytes).option("payload", payload).load(path)


def resolved(records: DataFrame) -> DataFrame:
    """Responses and revisits, each with its payload; a revisit whose response is missing has none."""
    own = records.where(F.col("record_type").isin("response", "revisit"))
    answers = own.where("record_type = 'response'").select(F.col("record_id").alias("answer"), F.col("payload").alias("answer_payload"))
    joined = own.join(answers, F.col("refers_to_record") == F.col("answer"), "left")
    return joined.withColumn("payload", F.coalesce("payload", "answer_payload")).select(records.columns)


def warc_report(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages written as archives and read back: size and digest of the payload, record type, and whom a revisit refers to."""
    spark = pages.sparkSession
    folder = folder or f"{run_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(revisits(pages), folder)
    kind = pages.schema["page_id"].dataType
    back = read_warc(spark, folder, payload=False).where(F.col("record_type").isin("response", "revisit"))
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to_page").cast(kind).alias("refers_to"))
