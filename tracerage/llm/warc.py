"""WARC: responses into linked metadata and plain-text conversion records (operator 4)."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_columns, worker_cache
from .html_text import leaf_blocks

#: Ends of lines: as written (CRLF), or bare line feeds as some tools leave them.
LINE_END, HEAD_END, NEXT = re.compile(rb"\r?\n"), re.compile(rb"\r?\n\r?\n"), re.compile(rb"\r?\n\r?\nWARC/")
#: Content types that are text beside text/*.
TEXTUAL = re.compile(r"text/|application/(?:xhtml\+xml|xml|json|ld\+json|javascript|x-javascript|rss\+xml|atom\+xml)$|image/svg\+xml$")
#: Content codings that entity() undoes; others are told.
CODINGS = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15), "identity": (), "": ()}
SAID = re.compile(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
DATE = "1970-01-01T00:00:00Z"
LINK = re.compile(r"<(a|link|img|script|iframe|form)\b[^>]*?\b(href|src|action)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
META = re.compile(r"<meta\b[^>]*?\b(name|property|charset)\s*=\s*[\"']?([^\"'\s>]+)[\"']?(?:[^>]*?\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)'))?", re.I)
TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.I | re.S)


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """The same parts give the same id, so reruns and retried tasks write the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {clean(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def clean(value: str) -> str:
    """Header values have no line ends."""
    return re.sub(r"[\r\n]+", " ", value).strip()


def members(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """Plain bytes of WARC data, gzip member by member, each with what is wrong with it (None: nothing)."""
    while data[:2] == b"\x1f\x8b":
        stream, part, problem = zlib.decompressobj(31), b"", None
        try:
            part = stream.decompress(data) + stream.flush()
            if not stream.eof:
                problem = "truncated gzip"
        except zlib.error:
            # What a damaged member holds before the damage, in small steps.
            stream, part, problem = zlib.decompressobj(31), b"", "damaged gzip"
            try:
                for i in range(0, len(data), 512):
                    part += stream.decompress(data[i : i + 512])
            except zlib.error:
                pass
        yield part, problem
        if problem == "damaged gzip":  # the next member begins at the next magic bytes
            at = data.find(b"\x1f\x8b\x08", 2)
            data = data[at:] if at >= 0 else b""
        else:
            data = stream.unused_data if stream.eof else b""
    if data:
        yield data, None


Headers = dict[str, str | list[str]]


def one(headers: Headers, name: str) -> str | None:
    """A header's value; of a repeated one the first."""
    value = headers.get(name)
    return value[0] if isinstance(value, list) else value


def grouped(pairs: list[tuple[str, str]]) -> Headers:
    """Headers by name in order; a repeated one is a list of its values."""
    out: dict[str, list[str]] = {}
    for name, value in pairs:
        out.setdefault(name, []).append(value)
    return {k: v if len(v) > 1 else v[0] for k, v in out.items()}


def records(data: bytes) -> Iterator[tuple[Headers, bytes, str | None]]:
    """Headers (names in lower case, lists where repeated) and block of each record, and what is wrong with it.

    Lines may end in bare line feeds.
    Damage is told and stays within its record or gzip member: ``truncated gzip``, ``damaged gzip``,
    ``cut header``, ``bad length`` (the block then goes up to the next record) or ``truncated block``.
    """
    for part, flaw in members(data):
        at, seen = 0, False
        while (at := part.find(b"WARC/", at)) >= 0:
            seen = True
            end = HEAD_END.search(part, at)
            if end is None:
                yield {}, part[at:], flaw or "cut header"
                break
            fields: list[tuple[str, str]] = []
            for line in LINE_END.split(part[at : end.start()])[1:]:
                text = line.decode("utf-8", "replace")
                if text[:1] in (" ", "\t") and fields:  # a folded line goes on
                    fields[-1] = (fields[-1][0], f"{fields[-1][1]} {text.strip()}")
                    continue
                name, _, value = text.partition(":")
                fields.append((name.strip().lower(), value.strip()))
            headers = grouped(fields)
            size, begin, problem = one(headers, "content-length") or "", end.end(), None
            if size.isascii() and size.isdigit():
                stop = begin + int(size)
                if stop > len(part):
                    stop, problem = len(part), flaw or "truncated block"
            else:
                after = NEXT.search(part, begin)
                stop, problem = after.start() if after else len(part), "bad length"
            yield headers, part[begin:stop], problem
            at = stop
        if not seen and (part or flaw):
            yield {}, part, flaw or "no record"


def read_records(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of each record that is whole."""
    return ((headers, block) for headers, block, problem in records(data) if problem is None)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response, as it was sent."""
    end = HEAD_END.search(block)
    if end is None or not block.startswith(b"HTTP/"):
        return "", [], block
    lines = [line.decode("latin-1") for line in LINE_END.split(block[: end.start()])]
    return lines[0], [tuple(x.strip() for x in line.split(":", 1)) for line in lines[1:] if ":" in line], block[end.end() :]


def _header(http: list[tuple[str, str]], name: str) -> str:
    return next((v for k, v in http if k.lower() == name), "").lower()


def joined_chunks(body: bytes) -> bytes:
    """A chunked body put together; from a chunk on that has no size, the rest as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(b"[0-9A-Fa-f]{1,15}", size):
            break
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join([*out, body[at:]])


def codings(http: list[tuple[str, str]]) -> list[str]:
    """Content codings in the order in which they were applied."""
    return [c.strip() for k, v in http if k.lower() == "content-encoding" for c in v.lower().split(",")]


def content_problem(http: list[tuple[str, str]]) -> str | None:
    """Codings that can't be undone, as ``br``: the body is told of but isn't read as text."""
    odd = [c for c in codings(http) if c not in CODINGS]
    return f"unknown content coding {', '.join(odd)}" if odd else None


def is_text(http: list[tuple[str, str]], content: bytes) -> bool:
    """Whether a body is text: by its content type; without one, if it has no zero byte. Odd codings aren't."""
    kind = _header(http, "content-type").split(";")[0].strip()
    return content_problem(http) is None and (bool(TEXTUAL.match(kind)) if kind else b"\0" not in content)


def entity(http: list[tuple[str, str]], body: bytes) -> bytes:
    """The page's bytes: chunks joined, gzip or deflate undone as far as it goes. Other encodings stay."""
    if "chunked" in _header(http, "transfer-encoding"):
        body = joined_chunks(body)
    for coding in reversed(codings(http)):
        for bits in CODINGS.get(coding, ()):
            try:
                body = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:
                continue
    return body


def decoded(http: list[tuple[str, str]], page: bytes) -> str:
    """A page's text in the charset that its headers or else its first such meta element name; UTF-8 without a known one."""
    said = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", _header(http, "content-type"))
    found = None if said else SAID.search(page)
    try:
        return page.decode(said[1] if said else found[1].decode("ascii", "replace") if found else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return page.decode("utf-8", "replace")


def digest_holds(said: str, *contents: bytes) -> bool | None:
    """Whether a digest header is that of one of the contents; null for an algorithm that isn't known."""
    name, _, value = said.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    value = value.strip().rstrip("=")
    made = [hashlib.new(name, c).digest() for c in contents]
    return any(value.upper() == base64.b32encode(d).decode().rstrip("=") or value.lower() == d.hex() or value == base64.b64encode(d).decode().rstrip("=") for d in made)


def response_of(page_id: int | None, url: str | None, source: str | None, date: str = DATE) -> bytes:
    """A response record around a page."""
    body = (source or "").encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url, hashlib.sha1(body).hexdigest())), ("WARC-Date", date), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", sha1_digest(body)), ("WARC-Block-Digest", sha1_digest(http)), ("Content-Type", "application/http; msgtype=response")]
    return write_record(headers, http)


def describe(headers: Headers, status: str, http: list[tuple[str, str]], content: bytes, page: str | None) -> dict:
    """What a metadata record says of a response: its headers, the HTTP headers and, of a text, title, metas and links.

    Repeated headers are lists. A body that isn't text (``page`` is None) has its length and digest only.
    """
    said: dict = {"Response-Message": status, "Headers": grouped(http), "Entity-Length": len(content), "Entity-Digest": sha1_digest(content)}
    if page is not None:
        title = TITLE.search(page)
        links = [{"path": f"{t.lower()}@{a.lower()}", "url": html.unescape(x or y or z)} for t, a, x, y, z in LINK.findall(page)]
        metas = [{"name": n if k.lower() != "charset" else "charset", "content": n if k.lower() == "charset" else html.unescape(x or y)} for k, n, x, y in META.findall(page)]
        said["HTML-Metadata"] = {"Title": " ".join(html.unescape(title[1]).split()) if title else None, "Metas": metas, "Links": links}
    return {"Envelope": {"WARC-Header-Metadata": headers, "Payload-Metadata": {"HTTP-Response-Metadata": said}}}


def plain_text(block: bytes) -> str:
    """Visible text of a response's page, a line for each block."""
    _, http, body = split_http(block)
    return text_of(decoded(http, entity(http, body)))


def text_of(page: str) -> str:
    return "\n".join(b.text for b in leaf_blocks(page))


def source_id(headers: Headers, block: bytes) -> str:
    """A response's id; without one, an id made of its target, date and block, the same in every run."""
    return one(headers, "warc-record-id") or record_id("unnamed response", one(headers, "warc-target-uri"), one(headers, "warc-date"), hashlib.sha1(block).hexdigest())


def derive(headers: Headers, block: bytes) -> list[tuple[str, str, bytes, bytes]]:
    """``(type, id, block, whole record)`` of the metadata and, if its body is text, the conversion record of a response.

    Both refer to the response by id and keep its target, date and payload digest.
    """
    source = source_id(headers, block)
    status, http, body = split_http(block)
    content = entity(http, body)
    page = decoded(http, content) if is_text(http, content) else None
    made = [("metadata", json.dumps(describe(headers, status, http, content, page), ensure_ascii=False, sort_keys=True), "application/json")]
    made += [] if page is None else [("conversion", text_of(page), "text/plain")]
    out = []
    for kind, text, content_type in made:
        data, own = text.encode("utf-8", "replace"), record_id(kind, source)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Target-URI", one(headers, "warc-target-uri")), ("WARC-Date", one(headers, "warc-date") or DATE), ("WARC-Source-Payload-Digest", one(headers, "warc-payload-digest")), ("WARC-Block-Digest", sha1_digest(data)), ("Content-Type", content_type)]
        out.append((kind, own, data, write_record([(k, v) for k, v in fields if v], data)))
    return out


RECORDS = "key {kind}, response_id string, target_uri string, warc_date string, payload_digest string, digest_ok boolean, record_type string, record_id string, refers_to string, block_digest string, content_length long, problem string, record binary"


def build_derivatives(warcs: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Derivative records of all response records in a binary column of WARC data.

    Two rows (metadata, conversion) for each response, with the linking headers as columns and the
    whole record as bytes. digest_ok tells whether the response's payload digest holds (null if it
    has none or of an unknown kind), as sent or with its chunks joined. A body that isn't text (by its
    content type, or coded in a way that isn't known) has a metadata row only. A response without an
    id gets one of its target, date and block. ``problem`` tells both codings and missing ids, and damage: a
    response whose block is cut or has no length still gives both rows of what there is; what can't
    be told to be a response gives one row with its problem and no record. Records of other types
    and null content give nothing. Repeated rows give repeated rows, an empty table none; the key
    must not be named like an output column.
    """
    kind = warcs.schema[key].dataType.simpleString()
    schema = RECORDS.format(kind=kind)
    names = [x.split()[0] for x in schema.split(", ")]
    if key in names[1:]:
        raise ValueError(f"the key column can't be named {key}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for headers, block, problem in records(data.as_py() or b""):
                    if one(headers, "warc-type") != "response":
                        if problem and "warc-type" not in headers:
                            rows.append((k, *[None] * 10, problem, None))
                        continue
                    said = one(headers, "warc-payload-digest")
                    _, http, body = split_http(block)
                    ok = None if not said else digest_holds(said, body, joined_chunks(body)) if "chunked" in _header(http, "transfer-encoding") else digest_holds(said, body)
                    flaws = [problem, None if one(headers, "warc-record-id") else "no record id", content_problem(http)]
                    flaw, source = "; ".join(f for f in flaws if f) or None, source_id(headers, block)
                    for what, own, made, record in derive(headers, block):
                        rows.append((k, source, one(headers, "warc-target-uri"), one(headers, "warc-date"), said, ok, what, own, source, sha1_digest(made), len(made), flaw, record))
            kinds = [batch.column(0).type, *[pa.string()] * 4, pa.bool_(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return warcs.select(F.col(key).cast(kind).alias("key"), F.col(content).alias("content")).mapInArrow(run, schema).withColumnRenamed("key", key)


def pages_as_warc(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``page_id, url, content``: a gzipped response record for each page. Null html is an empty body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in batches:
            made = [gzip.compress(response_of(p, u, h.as_py(), date), 1, mtime=0) for p, u, h in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(made, pa.binary())], ["page_id", "url", "content"])

    return doc_columns(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, content binary")


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of WARC files, for build_derivatives(df, "path"). A file must fit in a task."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
