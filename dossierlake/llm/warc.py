"""WARC derivatives: from response records to metadata and conversion records.

Every response yields a ``metadata`` record (title, language, outlinks and the
source's own headers, as warc-fields) and a ``conversion`` record (the plain text
of the page).  Both refer to the response by WARC-Refers-To, keep its target URI,
date and payload digest, and carry a block digest of their own.  Record ids are
name-based UUIDs, so that a task that runs twice writes the same records.

What the response says of itself is kept: ``read_response_records`` gives its record id,
date, payload digest and HTTP headers, and ``derivatives`` takes them from the
columns ``RESPONSE``.  Only where a column or its value is missing is an id, a
date, a digest (of the page as UTF-8) or a content type made up.

The work is one pass over the rows without a shuffle.

Defined results
  * null html: an empty payload; its conversion record has an empty block.
  * codings or charsets that are unknown or broken: the bytes are read as they are.
  * damaged archives: the records before a fault are read, then those from the next
    gzip member (or, uncompressed, the next line that begins a record) on;
    ``archive_faults`` lists the faults.  A file that is no archive is one fault.
  * line breaks and other control characters in header values: blanks.
  * null url: no target URI.  Broken markup: what is no tag counts as text.
  * very long pages: whole.  Repeated rows: each yields its records, with equal ids.
  * empty table: an empty result.  Extra columns but those of ``RESPONSE`` are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import small_batches

DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_MAGIC = b"\x1f\x8b"
_ID = re.compile(r"<[A-Za-z][A-Za-z0-9+.-]*:[^<>\s]+>")
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-derivatives")

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.S | re.I)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", re.I)
_TAG = re.compile(r"</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_REST = re.compile(r"</?[a-zA-Z][^<>]*>")
_CONTROL = re.compile(r"[\x00-\x1f\x7f\x85\u2028\u2029]+")
_BLANKS = re.compile(r"[ \t\r\f\v ]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
#: Bytes of an archive read at once, and of a header line at most.
_PIECE, _LINE = 1 << 16, 1 << 20
#: Characters of pages that one batch of records holds, about.
_HELD = 16_000_000

#: Optional columns of a page, as its response record gives them; headers are "name: value" lines.
RESPONSE = ("record_id", "warc_date", "payload_digest", "http_headers")
FIELDS = ("page_id", "kind", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_digest", "block")


def digest(block: bytes) -> str:
    """The usual WARC form of a SHA-1: base 32 with its algorithm."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    """A record id that depends on ``parts`` alone."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, '|'.join(map(str, parts)))}>"


def plain_text(page: str) -> str:
    """The visible text of a page, a line for each block; hidden elements and tags removed."""
    out = _HIDDEN.sub("\n", page)
    out = _REST.sub("", _TAG.sub("", _BLOCK.sub("\n", out)))
    if "&" in out:
        out = html.unescape(out)
    return _LINES.sub("\n", _BLANKS.sub(" ", out)).strip()


def one_line(value: str) -> str:
    """``value`` as the value of a header field."""
    return " ".join(html.unescape(value).split())


def flat(value: str) -> str:
    """``value`` without control characters, so that it stays within its header field."""
    return _CONTROL.sub(" ", value)


def header_lines(head: str) -> list[tuple[str, str]]:
    """(name, value) of each header line; a folded line belongs to the one before."""
    out: list[tuple[str, str]] = []
    for line in re.split(r"\r?\n", head):
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif colon and name.strip():
            out.append((name.strip(), value.strip()))
    return out


def derive(source_id: str, uri: str | None, source_headers: list[tuple[str, str]], payload: str) -> list[tuple[str, str, str]]:
    """(kind, content type, block) of the records derived from one response."""
    title, language = _TITLE.search(payload), _LANG.search(payload)
    fields = [("title", one_line(title[1]) if title else ""), ("language", language[1] if language else "")]
    fields += [(flat(f"source-{name.lower()}"), flat(value)) for name, value in source_headers]
    fields += [("outlink", one_line(a or b or c)) for a, b, c in _LINK.findall(payload)]
    block = "".join(f"{name}: {value}\r\n" for name, value in fields if value or name.startswith("source-"))
    return [("metadata", "application/warc-fields", block), ("conversion", "text/plain; charset=utf-8", plain_text(payload))]


def derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Two rows per page, with the columns ``FIELDS``; the columns ``RESPONSE`` are used where there are any."""
    small_batches(pages.sparkSession)
    known = [pages[c].cast("string").alias(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in RESPONSE]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in FIELDS]
            at: list[int] = []
            for i, (key, url, page, own, when, payload, http) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True)):
                page = page or ""
                payload = payload or digest(page.encode())
                source = own or (key if isinstance(key, str) and _ID.fullmatch(key) else record_id("response", key, url, payload))
                when = when or date
                headers = header_lines(http) if http is not None else [("Content-Type", "text/html; charset=utf-8")]
                headers += [("WARC-Record-ID", source), ("WARC-Payload-Digest", payload)]
                for kind, content, block in derive(source, url, headers, page):
                    data = block.encode()
                    at.append(i)
                    for column, x in zip(out[1:], (kind, record_id(kind, source), source, url, when, content, len(data), digest(data), payload, block), strict=True):
                        column.append(x)
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64() if name == "content_length" else pa.string()) for name, x in zip(FIELDS[1:], out[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, list(FIELDS))

    kind = pages.schema[id_col].dataType.simpleString()
    rest = ", ".join(f"{f} {'long' if f == 'content_length' else 'string'}" for f in FIELDS[1:])
    return pages.select(pages[id_col], pages[url_col], pages[html_col], *known).mapInArrow(make, f"page_id {kind}, {rest}")


# -- records as bytes ---------------------------------------------------------


def to_bytes(headers: list[tuple[str, str]], block: bytes, compress: bool = True) -> bytes:
    """One WARC/1.0 record; compressed, it is a gzip member of its own."""
    head = "WARC/1.0\r\n" + "".join(f"{flat(k)}: {flat(v)}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    data = head.encode() + block + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compress else data


class Fault(NamedTuple):
    """Where an archive is damaged: the offset in the file of the member or record that could not be read, and why."""

    at: int
    what: str


class _Reader:
    """Records of an archive from an offset on, read no further than each needs."""

    def __init__(self, data: bytes, at: int, packed: bool):
        self.data, self.at, self.packed = memoryview(data), at, packed
        self.held, self.member, self.began = bytearray(), None, at

    def more(self) -> bool:
        if self.member is None and self.at >= len(self.data):
            return False
        if self.packed and self.member is None:
            self.began = self.at
            if self.data[self.at : self.at + 2] != _MAGIC:
                # Files may be filled up with zeros.
                if not bytes(self.data[self.at :]).strip(b"\0"):
                    self.at = len(self.data)
                    return False
                raise ValueError("bytes that are no gzip member")
            self.member = zlib.decompressobj(31)
        piece = self.data[self.at : self.at + _PIECE]
        self.at += len(piece)
        if self.packed:
            if not piece:
                raise ValueError("the file ends inside a gzip member")
            self.held += self.member.decompress(piece)
            if self.member.eof:
                self.at -= len(self.member.unused_data)
                self.member = None
        else:
            self.held += piece
        return True

    def line(self) -> bytes:
        while (end := self.held.find(b"\n")) < 0:
            if len(self.held) > _LINE:
                raise ValueError("no end of a header line")
            if not self.more():
                end = len(self.held) - 1
                break
        out = bytes(self.held[: end + 1])
        del self.held[: end + 1]
        return out

    def record(self) -> tuple[dict[str, str], bytes] | None:
        line = self.line()
        while line and not line.strip():
            line = self.line()
        if not self.packed:
            self.began = self.at - len(self.held) - len(line)
        if not line:
            return None
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := self.line()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = headers.get("content-length", "0")
        if not line or not re.fullmatch("[0-9]{1,18}", length):
            raise ValueError(f"Content-Length {length[:40]!r}" if line else "the file ends inside a header")
        while len(self.held) < int(length):
            if not self.more():
                raise ValueError("the file ends inside a record")
        block = bytes(self.held[: int(length)])
        del self.held[: int(length)]
        return headers, block


def _resumed(data: bytes, at: int, packed: bool) -> int:
    """The offset behind ``at`` where a record begins again; the end if none does."""
    if not packed:
        found = data.find(b"\nWARC/1.", at)
        return found + 1 if found >= 0 else len(data)
    while (at := data.find(_MAGIC + b"\x08", at + 1)) >= 0:
        try:
            # The bytes of a magic number may also stand inside a member.
            if zlib.decompressobj(31).decompress(data[at : at + _PIECE], 5) == b"WARC/":
                return at
        except zlib.error:
            pass
    return len(data)


def archive_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes] | Fault]:
    """(headers, block) of each record of a WARC file, compressed or not, and a ``Fault`` where it is damaged."""
    packed, at = data[:2] == _MAGIC, 0
    while at < len(data):
        reader = _Reader(data, at, packed)
        try:
            while (found := reader.record()) is not None:
                yield found
            return
        except (ValueError, zlib.error) as e:
            yield Fault(reader.began, str(e))
            at = _resumed(data, reader.began, packed)


def from_bytes(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a whole WARC file; a damaged one raises ValueError behind the records before."""
    for found in archive_records(data):
        if isinstance(found, Fault):
            raise ValueError(f"at {found.at}: {found.what}")
        yield found


def record_bytes(records: DataFrame, compress: bool = True) -> DataFrame:
    """``page_id, kind, record``: the derived records as WARC bytes, ready to be concatenated."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                headers = [("WARC-Type", row["kind"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Date", row["warc_date"]), ("WARC-Block-Digest", row["block_digest"]), ("Content-Type", row["content_type"]), ("X-Source-Payload-Digest", row["source_digest"])]
                if row["target_uri"] is not None:
                    headers.insert(3, ("WARC-Target-URI", row["target_uri"]))
                out.append(to_bytes(headers, row["block"].encode(), compress))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["page_id", "kind", "record"])

    kind = records.schema["page_id"].dataType.simpleString()
    return records.select(*FIELDS).mapInArrow(make, f"page_id {kind}, kind string, record binary")


def _unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if it is not chunked as it should be."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _inflated(body: bytes, coding: str) -> bytes | None:
    """The decoded body; None for codings that are not known or bytes that do not fit."""
    try:
        if coding in ("gzip", "x-gzip"):
            return gzip.decompress(body)
        if coding == "deflate":
            # Some servers leave out the zlib header.
            return zlib.decompress(body, 15 if body[:1] == b"\x78" else -15)
    except (OSError, EOFError, zlib.error):
        pass
    return None


def payload_text(http: str | None, body: bytes) -> str:
    """The page in a response: transfer and content codings undone, read in the charset that it names.

    The charset is that of the Content-Type, else of a meta element near the start,
    else UTF-8.  What cannot be decoded stays as it is.
    """
    fields: dict[str, str] = {}
    for name, value in header_lines(http or ""):
        fields.setdefault(name.lower(), value)
    if "chunked" in fields.get("transfer-encoding", "").lower():
        plain = _unchunked(body)
        body = body if plain is None else plain
    for coding in reversed([c.strip().lower() for c in fields.get("content-encoding", "").split(",") if c.strip()]):
        plain = _inflated(body, coding)
        if plain is None:
            break
        body = plain
    named = _CHARSET.search(fields.get("content-type", "")) or _CHARSET.search(body[:1024].decode("latin-1"))
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _read(spark: SparkSession, path: str) -> DataFrame:
    """Responses and faults of WARC files: ``path``, ``at`` and ``fault`` beside the columns of a response."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if n == "at" else pa.string()) for k, n in enumerate(names)], names)

        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for found in archive_records(content.as_py()):
                    if isinstance(found, Fault):
                        rows.append((where, found.at, found.what, *(None,) * (len(names) - 3)))
                        continue
                    headers, block = found
                    if headers.get("warc-type") == "response":
                        http, body = None, block
                        if block.startswith(b"HTTP/"):
                            head, _, body = block.partition(b"\r\n\r\n")
                            http = head.partition(b"\r\n")[2].decode("utf-8", "replace")
                        own, text = headers.get("warc-record-id"), payload_text(http, body)
                        rows.append((where, None, None, own, headers.get("warc-target-uri"), text, own, headers.get("warc-date"), headers.get("warc-payload-digest") or digest(body), http))
                        held += len(text)
                        if held > _HELD:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    names = ["path", "at", "fault", "page_id", "url", "html", *RESPONSE]
    small_batches(spark)
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInArrow(parse, ", ".join(f"{n} {'long' if n == 'at' else 'string'}" for n in names))


def read_response_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of the response records of WARC files, and the columns ``RESPONSE``; page_id is the record id.

    The digest is the record's own, else that of the payload's bytes as they are in
    the record.  A response without a record id has null for it.  A file is read as a
    stream of records and may have 2 GB, as a binary file of Spark.
    """
    return _read(spark, path).where("fault is null").drop("path", "at", "fault")


def archive_faults(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, fault): where WARC files are damaged; ``at`` is the offset of the member or record that could not be read."""
    return _read(spark, path).where("fault is not null").select("path", "at", "fault")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of the response records of WARC files; page_id is the record id."""
    return read_response_records(spark, path).select("page_id", "url", "html")
