"""WARC archives as a data source of Spark: ``spark.read.format("warc")`` and ``df.write``.

Archives hold one gzip member for each record, as is usual. The reader plans a partition for each
group of files, reads the headers of a record first, and decodes a payload only if it is asked
for and the record passes the filters on record type, address and other headers.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from rinse.llm.shared_files import opened, sized, written

FIELDS = (
    "page_id long, record_type string, url string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary"
)
BYTES_PER_FILE = 64 << 20
BYTES_PER_PARTITION = 64 << 20
_BLOCK = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:x-page:(-?\d+|none)>")
_MANIFEST = "_archives.json"
_OWN = re.compile(r"[0-9a-f]{32}\.warc\.gz")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _number(name: str | None) -> int | None:
    found = _ID.fullmatch(name or "")
    return int(found[1]) if found and found[1] != "none" else None


def _digest(headers: dict[str, str]) -> str | None:
    """The SHA-1 of the payload as its headers say it; other sums count as none."""
    given = headers.get("warc-payload-digest", "")
    return given[5:].upper() if given[:5].lower() == "sha1:" else None


def _url(headers: dict[str, str]) -> str | None:
    """The address as it was given, else as the standard header has it."""
    return json.loads(headers["x-url"]) if "x-url" in headers else headers.get("warc-target-uri")


def record(row, date: str) -> bytes:
    """One record with its headers. A revisit has no payload, its headers tell of it."""
    payload = bytes(row.payload or b"")
    response = row.record_type == "response"
    block = _HTTP + payload if response else _HTTP
    headers = {
        "WARC-Type": row.record_type,
        "WARC-Record-ID": _name(row.page_id),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if row.url is not None:
        headers["WARC-Target-URI"] = quote(row.url, safe="".join(map(chr, range(33, 127))))
        if headers["WARC-Target-URI"] != row.url:
            headers["X-Url"] = json.dumps(row.url)
    if not response:
        headers["WARC-Refers-To"] = _name(row.refers_to)
        headers["WARC-Profile"] = _PROFILE
    head = "".join(f"{name}: {value}\r\n" for name, value in headers.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class Records:
    """The records of an archive, one after another: headers, then the block on demand.

    Archives are plain or gzip, with a member for each record or any other members. Names of headers are in
    lower case. What a caller does not read of a block is passed over and not kept.
    """

    def __init__(self, source) -> None:
        self._source, self._held, self._raw = source, bytearray(), b""
        start = source.read(2)
        self._member = zlib.decompressobj(31) if start == b"\x1f\x8b" else None
        self._raw = start

    def _fill(self) -> bool:
        """Hold a little more of the archive's text; false at its end."""
        while True:
            raw, self._raw = self._raw or self._source.read(_BLOCK), b""
            if not raw:
                return False
            if self._member is None:
                self._held += raw
                return True
            if self._member.eof:
                self._member = zlib.decompressobj(31)
            data = self._member.decompress(raw, _BLOCK)
            self._raw = self._member.unused_data if self._member.eof else self._member.unconsumed_tail
            self._held += data
            if data:
                return True

    def _headers(self) -> dict[str, str] | None:
        """The headers of the next record; None at the end."""
        while True:
            gone = len(self._held) - len(self._held.lstrip(b"\r\n"))
            del self._held[:gone]
            if self._held or not self._fill():
                break
        if not self._held:
            return None
        at = 0
        while (end := self._held.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(self._held) - 3)
            if not self._fill():
                raise ValueError("An archive ends within the headers of a record")
        text = bytes(self._held[:end]).decode("utf-8", "replace")
        del self._held[: end + 4]
        first, *lines = re.sub(r"\r\n[ \t]+", " ", text).split("\r\n")  # a line that goes on begins with a space
        if not first.startswith("WARC/"):
            raise ValueError(f"A record begins with {first[:20]!r}")
        pairs = (line.partition(":") for line in lines)
        return {name.strip().lower(): value.strip() for name, _, value in pairs}

    def __iter__(self) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
        while (headers := self._headers()) is not None:
            left = int(headers.get("content-length", "0"))

            def block() -> Iterator[bytes]:
                nonlocal left
                while left:
                    if not self._held and not self._fill():
                        raise ValueError("An archive ends within the block of a record")
                    part = bytes(self._held[:left])
                    del self._held[: len(part)]
                    left -= len(part)
                    yield part

            yield headers, block()
            for _ in block():  # to the end of the record; nothing is kept
                pass


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcReader(DataSourceReader):
    """Options: ``payload`` (true): decode payloads; ``verify`` (false): compare their digests.

    A folder has a listing of its archives, or all files ending in .warc or .warc.gz are archives. Records may
    be of any type and lack any header: ``page_id`` and ``refers_to`` are null where ids are not those of
    this writer, lengths and digests are computed from the block where headers do not say them (null
    for revisits). Payloads are as they were sent, also if compressed or in chunks.
    """

    _HEADERS = {
        "record_type": lambda headers: headers.get("warc-type"),
        "url": lambda headers: _url(headers),
        "payload_digest": lambda headers: _digest(headers),
        "page_id": lambda headers: _number(headers.get("warc-record-id")),
    }

    def __init__(self, options: dict[str, str]) -> None:
        self._folder = options["path"]
        self._payload = options.get("payload", "true").lower() == "true"
        self._verify = options.get("verify", "false").lower() == "true"
        self._wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Take what can be told from the headers; Spark applies the rest, and those on digests once more."""
        for one in filters:
            column = one.attribute[0] if len(one.attribute) == 1 else None
            if column == "payload_digest":
                yield one
            if column in self._HEADERS and isinstance(one, EqualTo):
                self._wanted.append((column, "in", [one.value]))
            elif column in self._HEADERS and isinstance(one, In):
                self._wanted.append((column, "in", list(one.value)))
            elif column == "url" and isinstance(one, StringStartsWith):
                self._wanted.append((column, "starts", one.value))
            elif column in self._HEADERS and isinstance(one, IsNotNull):
                self._wanted.append((column, "known", None))
            else:
                yield one

    def partitions(self) -> list[Files]:
        try:
            with opened(f"{self._folder}/{_MANIFEST}") as source:
                files = [(f"{self._folder}/{file['name']}", file["bytes"]) for file in json.loads(source.read())]
        except (FileNotFoundError, NotADirectoryError):  # archives from elsewhere
            files = sized(self._folder, (".warc", ".warc.gz"))
        planned: list[Files] = []
        size = 0
        for name, length in files:
            if not planned or size + length > BYTES_PER_PARTITION:
                planned.append(Files([]))
                size = 0
            planned[-1].paths.append(name)
            size += length
        return planned or [Files([])]

    def _passes(self, headers: dict[str, str]) -> bool:
        for column, how, wanted in self._wanted:
            value = self._HEADERS[column](headers)
            if value is None and column == "payload_digest":
                continue  # it may be computed from the block
            if value is None or how == "in" and value not in wanted:
                return False
            if how == "starts" and not value.startswith(wanted):
                return False
        return True

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with opened(path) as source:
                for headers, block in Records(source):
                    if self._passes(headers):
                        yield self._row(headers, block)

    def _row(self, headers: dict[str, str], block: Iterator[bytes]) -> tuple:
        """A record as a row; what its headers do not say is computed from its block."""
        digest, length = _digest(headers), headers.get("x-payload-length")
        length = int(length) if length else None
        kind, payload = headers.get("warc-type"), None
        said = digest is not None and length is not None
        if kind != "revisit" and (self._payload or self._verify or not said):
            payload = b"".join(block)
            if headers.get("content-type", "").startswith("application/http"):
                payload = payload.partition(b"\r\n\r\n")[2]
            found = payload_digest(payload), len(payload)
            if self._verify and (digest not in (None, found[0]) or length not in (None, found[1])):
                raise ValueError(f"The payload of {headers.get('warc-record-id')} is not what its headers say")
            digest, length = digest or found[0], found[1] if length is None else length
        return (
            _number(headers.get("warc-record-id")), kind, _url(headers), length, digest,
            _number(headers.get("warc-refers-to")), payload if self._payload else None,
        )


class WarcWriter(DataSourceWriter):
    """Tasks write files of their own; the commit adds them to the listing of those that count.

    With mode overwrite the listing has the new files only, and the others are not read any more.
    """

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self._folder, self._overwrite = options["path"], overwrite
        self._most = int(options.get("bytes_per_file", BYTES_PER_FILE))
        self._date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, rows: Iterator) -> Written:
        done: list[str] = []
        rows = iter(rows)
        row = next(rows, None)
        while row is not None:
            name, size = f"{uuid.uuid4().hex}.warc.gz", 0
            with written(f"{self._folder}/{name}") as out:
                while row is not None and size < self._most:
                    member = zlib.compressobj(3, zlib.DEFLATED, 31)
                    data = member.compress(record(row, self._date)) + member.flush()
                    out.write(data)
                    size += len(data)
                    row = next(rows, None)
            done.append(json.dumps({"name": name, "bytes": size}))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files = [json.loads(name) for message in messages if message for name in message.names]
        if not self._overwrite:
            try:
                with opened(f"{self._folder}/{_MANIFEST}") as source:
                    files += json.loads(source.read())
            except FileNotFoundError:  # archives from elsewhere stay, those of failed attempts don't
                with contextlib.suppress(FileNotFoundError):  # no folder, as no task had rows
                    there = [(name.rpartition("/")[2], size) for name, size in sized(self._folder, (".warc", ".warc.gz"))]
                    files += [{"name": name, "bytes": size} for name, size in there if not _OWN.fullmatch(name)]
        files.sort(key=lambda file: file["name"])
        with written(f"{self._folder}/{_MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files without a listing are never read."""


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed to it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def as_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages (page_id, url, html) as rows to be written.

    Of pages with one payload of at least ``least`` bytes, that with the smallest page_id is the
    response, the others revisit it. Null html counts as empty. Rows without page_id, and all rows
    that share the smallest one, are responses. Other columns are not read. Payloads are compared
    by length and digest; only those are grouped, so copies of one payload never meet in a task.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    keys = ["digest", "payload_bytes"]
    # only payloads with several pages have revisits, so few rows are joined
    firsts = rows.where(F.col("payload_bytes") >= least).groupBy(*keys).agg(
        F.min("page_id").alias("refers_to"), F.count("page_id").alias("pages")
    ).where("pages > 1").drop("pages")
    rows = rows.join(firsts, keys, "left")
    revisit = F.coalesce(F.col("page_id") > F.col("refers_to"), F.lit(False))
    return rows.select(
        "page_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "url", "payload_bytes",
        F.lit(None).cast("string").alias("payload_digest"), F.when(revisit, F.col("refers_to")).alias("refers_to"),
        "payload",
    )


def write_pages(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Write a record for every page as archives in ``folder``."""
    register(pages.sparkSession)
    as_records(pages, least).write.format("warc").mode("append").option("path", folder).save()


def read_records(spark: SparkSession, folder: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """The records of the archives in ``folder``."""
    register(spark)
    options = {"path": folder, "payload": str(payload).lower(), "verify": str(verify).lower()}
    return spark.read.format("warc").options(**options).load()
