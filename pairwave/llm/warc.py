"""WARC derivatives: response records become linked metadata and plain-text conversion records (operator 8).

A record is bytes as in a WARC/1.1 file: version line, named fields, empty line, block, two line ends. Of each
response record two records are made. Both refer to it (WARC-Refers-To) and keep its target URI, date and digests; the
metadata record holds the source's HTTP status and headers and what was found in the page, and names the
conversion record (WARC-Concurrent-To); the conversion record holds the page's plain text in UTF-8. Record ids are
made of the source's id, so a repeated run gives the same ids.

Tags are looked for up to a page's last ">" only, and ends of comments, scripts and titles once: a page takes time in
proportion to its length, whatever it holds.

Null url is the empty URI; null html is an empty body, with an empty text. Records of other types and records that
can't be read have no derivatives; a body's chunks and compression are undone, one that can't be is taken as it is. Repeated rows give repeated
records, rows of one page_id with different pages different ones. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import itertools
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import rows, written

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, from RFC 4122
DATE = "2000-01-01T00:00:00Z"

HIDDEN = re.compile(r"<!--|<(script|style|template|noscript)\b[^>]*>", re.I)
HIDDEN_END = {"": re.compile("-->")} | {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "template", "noscript")}
#: A head as far as a browser takes it: </head> is optional, and text or an element of the body ends it.
HEAD = re.compile(r"<head(?=[\s/>])[^>]*>(?>\s++|<title\b[^>]*>(?:(?!<head[\s/>]).)*?</title\s*>|</?(?:base|basefont|bgsound|link|meta|html|noframes)\b[^>]*>|<[!?][^>]*>)*+(?:</head\s*>)?", re.S | re.I)
BREAKS = re.compile(r"<(?:/?(?:p|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|blockquote|pre|form|title)|br|hr)\b[^>]*>", re.I)
TAGS = re.compile(r"<[!/?]?[A-Za-z][^>]*>")
BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
TITLE, TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
ROOT, LANG = re.compile(r"<html\b[^>]*>", re.I), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
ANCHOR, HREF = re.compile(r"<a\b[^>]*>", re.I), re.compile(r"\bhref\s*=", re.I)
#: Numbers of characters that no character has, and zeros before others.
BEYOND, ZEROS = re.compile(r"&#0*[1-9][0-9]{7,};?"), re.compile(r"&#0+(?=[0-9])")
CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.I)
#: Bytes to which a compressed body may unfold; a longer one is taken as it is.
MOST_BODY = 1 << 30
#: Bytes of a gzip member that are unfolded at once, and bytes that come of them at once; file systems from which workers read streams.
SLICE, UNZIPPED = 1 << 16, 1 << 20
STREAMED = ("file", "hdfs", "s3", "gs", "abfs", "abfss")


def digest_of(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


def field(value: str) -> str:
    """A field's value on one line: control characters and line ends become blanks."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {field(v)}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def decoded(raw: bytes) -> str:
    """UTF-8, or Latin-1 where it isn't."""
    try:
        return raw.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def parse_head(raw: bytes, strict: bool = True) -> tuple[str, list[tuple[str, str]], bytes]:
    """First line, fields and the rest after the empty line; a line that begins with white space continues a field. Lines without colon are errors if strict, else left out."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the header")
    first, *lines = decoded(head).split("\r\n")
    fields: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        else:
            name, colon, value = line.partition(":")
            if colon:
                fields.append((name.strip(), value.strip()))
            elif strict:
                raise ValueError("a header line without colon")
    return first, fields, rest


def unchunked(body: bytes) -> bytes:
    """The data of a body in chunks; the body itself where it isn't one."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return body


def unfolded(body: bytes, coding: str) -> bytes:
    """A body without its compression; the body itself where that isn't known or fails."""
    bits = {"gzip": 31, "x-gzip": 31, "deflate": 47}.get(coding.strip().lower())
    if bits is None:
        return body
    for wbits in (bits, -15):
        try:
            tool = zlib.decompressobj(wbits)
            out = tool.decompress(body, MOST_BODY)
            if tool.eof:
                return out
        except zlib.error:
            continue
    return body


def parse_record(raw: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Fields and block of a record."""
    version, fields, rest = parse_head(raw)
    size = int(dict((k.lower(), v) for k, v in fields)["content-length"])
    if not version.startswith("WARC/") or len(rest) < size:
        raise ValueError("broken record")
    return fields, rest[:size]


def response_record(key: str, url: str | None, page: str | None) -> bytes:
    """A response record of a page that was stored without its HTTP exchange."""
    body = (page or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(f"response {key} {url or ''} {digest_of(body)}")), ("WARC-Target-URI", url or ""), ("WARC-Date", DATE), ("WARC-Payload-Digest", digest_of(body)), ("WARC-Block-Digest", digest_of(http + body)), ("Content-Type", "application/http; msgtype=response")]
    return record(fields, http + body)


def tags_end(page: str) -> int:
    """Where tags can't be any more: after the last ">"."""
    return page.rfind(">") + 1


def shown(page: str) -> str:
    """page without comments, scripts, styles, templates and heads. Only scripts and styles without an end run to the end of the page."""
    out, at, look, endless, last = [], 0, 0, set(), tags_end(page)
    while m := HIDDEN.search(page, look, last):
        name = (m[1] or "").lower()
        end = None if name in endless else HIDDEN_END[name].search(page, m.end(), last)
        if not end and name not in ("script", "style"):
            endless.add(name)
            look = m.end()
            continue
        out.append(page[at : m.start()])
        at = look = end.end() if end else len(page)
    return without(HEAD, " ", " ".join([*out, page[at:]]))


def without(pattern: re.Pattern, new: str, page: str) -> str:
    """page with each match before the end of tags replaced."""
    last = tags_end(page)
    return pattern.sub(new, page[:last]) + page[last:]


def characters(text: str) -> str:
    """text with character references resolved."""
    return html.unescape(BEYOND.sub("\ufffd", ZEROS.sub("&#", text))) if "&" in text else text


def plain_text(page: str) -> str:
    """Visible text: no comments, scripts or heads; a line for each block, blanks pressed together, no empty lines."""
    text = characters(without(TAGS, "", without(BREAKS, "\n", shown(page))))
    return "\n".join(x for x in (BLANKS.sub(" ", line).strip() for line in text.split("\n")) if x)


def title_of(page: str) -> str:
    """The first title's text; an unfinished one is none."""
    last = tags_end(page)
    if not (begin := TITLE.search(page, 0, last)) or not (end := TITLE_END.search(page, begin.end(), last)):
        return ""
    return " ".join(characters(without(TAGS, "", page[begin.end() : end.start()])).split())


def language_of(page: str) -> str:
    """The language that the first html element with one names."""
    for tag in ROOT.finditer(page, 0, tags_end(page)):
        if found := LANG.search(tag[0]):
            return found[1].lower()
    return ""


def derivatives(raw: bytes | None) -> list[dict]:
    """The metadata and the conversion record of a response record; none of anything else."""
    try:
        fields, block = parse_record(raw or b"")
        source = {k.lower(): v for k, v in fields}
        if source["warc-type"] != "response":
            return []
        status, headers, body = parse_head(block, False)
        ref = source["warc-record-id"]
    except (ValueError, KeyError):
        return []
    known = {k.lower(): v for k, v in headers}
    sent = unfolded(unchunked(body) if "chunked" in known.get("transfer-encoding", "").lower() else body, known.get("content-encoding", ""))
    charset = CHARSET.search(known.get("content-type", ""))
    try:
        page = sent.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, ValueError):
        page = sent.decode("utf-8", "replace")
    text = plain_text(page)
    data = text.encode("utf-8", "replace")
    kept = [("WARC-Refers-To", ref), *((k, source[k.lower()]) for k in ("WARC-Target-URI", "WARC-Date") if k.lower() in source)]
    source_digests = [(f"WARC-Source-{k}", source[f"warc-{k.lower()}"]) for k in ("Payload-Digest", "Block-Digest") if f"warc-{k.lower()}" in source]
    ids = {kind: record_id(f"{kind} {ref}") for kind in ("metadata", "conversion")}
    links = sum(1 for tag in ANCHOR.finditer(page, 0, tags_end(page)) if HREF.search(tag[0]))
    notes = [("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in headers), ("source-payload-digest", source.get("warc-payload-digest", digest_of(body))), ("title", title_of(page)), ("language", language_of(page)), ("outlinks", str(links)), ("text-length", str(len(text)))]
    about = "".join(f"{k}: {field(v)}\r\n" for k, v in notes).encode("utf-8", "replace")
    out = []
    for kind, media, content, more in (("metadata", "application/warc-fields", about, [("WARC-Concurrent-To", ids["conversion"])]), ("conversion", "text/plain; charset=utf-8", data, [])):
        digests = [("WARC-Block-Digest", digest_of(content)), *source_digests]
        raw_record = record([("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), *kept, *more, *digests, ("Content-Type", media)], content)
        out.append({"record_type": kind, "record_id": ids[kind], "refers_to": ref, "target_uri": source.get("warc-target-uri"), "date": source.get("warc-date"), "content_type": media, "payload_digest": source.get("warc-payload-digest"), "block_digest": digest_of(content), "content_length": len(content), "content": content.decode("utf-8", "replace"), "record": raw_record})
    return out


def unzipped(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of gzip members one after the other, a part at a time; ends where a member is broken or what follows isn't one."""
    tool, rest = zlib.decompressobj(31), b""
    for piece in pieces:
        view = memoryview(rest + piece if rest else piece)
        rest, at = b"", 0
        while at < len(view):
            if tool.eof:
                if len(view) - at < 2:
                    rest = bytes(view[at:])
                    break
                if view[at : at + 2] != b"\x1f\x8b":
                    return
                tool = zlib.decompressobj(31)
            part = view[at : at + SLICE]
            try:
                out = tool.decompress(part, UNZIPPED)
                yield out
                while tool.unconsumed_tail:
                    yield tool.decompress(tool.unconsumed_tail, UNZIPPED)
            except zlib.error:
                return
            at += len(part) - len(tool.unused_data)


def split_records(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The records in a WARC file's bytes, given in parts, plain or gzipped; what comes after a broken record is left out. Holds one record at a time."""
    pieces = iter(pieces)
    start = b""
    while len(start) < 2 and (piece := next(pieces, None)) is not None:
        start += piece
    pieces = itertools.chain([start], pieces)
    if start[:2] == b"\x1f\x8b":
        pieces = unzipped(pieces)
    held, at, look = bytearray(), 0, 0
    wanted = 0  # bytes that the record at `at` needs; 0: its head isn't known yet
    for piece in pieces:
        if at > SLICE << 2:
            del held[:at]
            look, at = look - at, 0
        held += piece
        while True:
            if not wanted:
                while held[at : at + 2] == b"\r\n":
                    at += 2
                gap = held.find(b"\r\n\r\n", max(at, look))
                if gap < 0:
                    look = max(at, len(held) - 3)
                    break
                head = bytes(held[at:gap])
                length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
                if not length or not head.startswith(b"WARC/"):
                    return
                wanted = gap + 4 - at + int(length[1])
            if len(held) - at < wanted:
                break
            yield bytes(held[at : at + wanted]) + b"\r\n\r\n"
            at += wanted
            wanted, look = 0, at


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id (the record's number in its file), file, record: all records of WARC files, as `build_derivatives` takes them.

    A file is read as a stream, by its task, where pyarrow knows the file system: it may have any size. Elsewhere Spark reads it whole.
    """
    files = spark.read.format("binaryFile").load(path)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() in STREAMED

    def pieces(name: str, content: bytes | None) -> Iterator[bytes]:
        if content is not None:
            view = memoryview(content)
            yield from (bytes(view[at : at + SLICE]) for at in range(0, len(view), SLICE))
            return
        from pyarrow import fs

        local = name.startswith("file:")
        system, there = (fs.LocalFileSystem(), name.removeprefix("file://").removeprefix("file:")) if local else fs.FileSystem.from_uri(name)
        with system.open_input_stream(there, compression=None) as stream:
            while piece := stream.read(SLICE << 4):
                yield piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, contents in rows(batches, 1):
            found, size, first = [], 0, 0
            for record_ in itertools.chain(split_records(pieces(names[0], contents[0])), [None]):
                if record_ is not None:
                    found.append(record_)
                    size += len(record_)
                if found and (record_ is None or size > SLICE << 4):
                    yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(found)), pa.int64()), pa.array(names * len(found)), pa.array(found, pa.binary())], ["page_id", "file", "record"])
                    first, found, size = first + len(found), [], 0

    return files.select("path", F.lit(None).cast("binary").alias("content") if known else "content").mapInArrow(run, "page_id long, file string, record binary")


_NAMES = ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", "content_length", "content", "record")


def build_responses(pages: DataFrame) -> DataFrame:
    """page_id, record: a response record for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, bodies in rows(batches, 128):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([response_record(str(i), u, b) for i, u, b in zip(ids, urls, bodies, strict=True)], pa.binary())], ["page_id", "record"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, record binary")


def build_derivatives(responses: DataFrame) -> DataFrame:
    """page_id and, for each derivative, its type, ids, digests, content and whole record, from a column record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw in rows(batches, 128):
            made = [(i, d) for i, r in zip(ids, raw, strict=True) for d in derivatives(r)]
            kinds = [pa.int64() if n == "content_length" else pa.binary() if n == "record" else pa.string() for n in _NAMES]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in made], pa.int64()), *(pa.array([d[n] for _, d in made], k) for n, k in zip(_NAMES, kinds, strict=True))], ["page_id", *_NAMES])

    schema = "page_id long, " + ", ".join(f"{n} {'long' if n == 'content_length' else 'binary' if n == 'record' else 'string'}" for n in _NAMES)
    return responses.select(F.col("page_id").cast("long"), "record").mapInArrow(run, schema)


def derive(pages: DataFrame) -> DataFrame:
    """Derivatives of response records that are written first and read back."""
    return build_derivatives(written(build_responses(pages), "responses"))
