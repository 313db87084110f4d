"""Media columns: signature sniffing, validation, carving and lossless storage (operator 8)."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, slices, utf8, worker_cache

#: Magic bytes of media formats, and where in the file they stand.
MAGIC = [
    (b"RIFF", 0, "audio/wav"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"P5", 0, "image/x-portable-graymap"),
]

BLOCK = 192
RATE = 8000


def automaton():
    """Aho-Corasick over the magic bytes, each byte taken as the code point of the same number."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, at, kind in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic), at, kind))
    found.make_automaton()
    return found


def wav_length(data: memoryview) -> int:
    """Bytes of the well-formed PCM WAV file at the start of ``data``, or 0."""
    if len(data) < 44 or bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"WAVE":
        return 0
    size, at, seen = struct.unpack_from("<I", data, 4)[0] + 8, 12, set()
    if size > len(data) or size < 44:
        return 0
    while at + 8 <= size:
        name, n = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + n > size:
            return 0
        if name == b"fmt ":
            if n < 16:
                return 0
            kind, channels, rate, per_second, align, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if kind != 1 or not channels or align != channels * bits // 8 or per_second != rate * align:
                return 0
        seen.add(name)
        at += 8 + n + (n & 1)
    return size if {b"fmt ", b"data"} <= seen else 0


def png_length(data: memoryview) -> int:
    """Bytes of the PNG file at the start whose chunks have right lengths and checks, or 0."""
    at, names = 8, []
    while at + 12 <= len(data):
        n, name = struct.unpack_from(">I", data, at)[0], bytes(data[at + 4 : at + 8])
        if at + 12 + n > len(data) or zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            return 0
        names.append(name)
        at += 12 + n
        if name == b"IEND":
            return at if names[0] == b"IHDR" and b"IDAT" in names else 0
    return 0


def gif_length(data: memoryview) -> int:
    """Bytes of the GIF file at the start, walked block by block, or 0."""
    if len(data) < 14:
        return 0
    at = 13 + (3 << (data[10] & 7) + 1 if data[10] & 0x80 else 0)
    images = 0
    while at < len(data):
        mark = data[at]
        if mark == 0x3B:
            return at + 1 if images else 0
        if mark == 0x2C:
            if at + 10 >= len(data):
                return 0
            at += 11 + (3 << (data[at + 9] & 7) + 1 if data[at + 9] & 0x80 else 0)
            images += 1
        elif mark == 0x21:
            at += 2
        else:
            return 0
        while at < len(data) and data[at]:
            at += data[at] + 1
        at += 1
    return 0


def bmp_length(data: memoryview) -> int:
    """Bytes of the uncompressed BMP file at the start, or 0."""
    if len(data) < 54:
        return 0
    size, _, start, header, width, height, planes, bits, packing = struct.unpack_from("<IIIIiiHHI", data, 2)
    if size > len(data) or header < 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or packing or width <= 0 or not height:
        return 0
    return size if start + (width * bits + 31) // 32 * 4 * abs(height) == size and start >= 14 + header else 0


def jpeg_length(data: memoryview) -> int:
    """Bytes of the JPEG file at the start: segments up to a scan, then the end mark, or 0."""
    at, frame = 2, False
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if n < 2:
            return 0
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        at += 2 + n
        if mark == 0xDA:
            # The end mark, looked for piece by piece: no copy of what follows.
            for lo in range(at, len(data) if frame else 0, 1 << 16):
                if (end := bytes(data[lo : lo + (1 << 16) + 1]).find(b"\xff\xd9")) >= 0:
                    return lo + end + 2
            return 0
    return 0


_GAP = rb"(?:[ \t\n\v\f\r]|#[^\r\n]*[\r\n])+"
_GRAYMAP = re.compile(rb"P5" + _GAP + rb"([0-9]{1,9})" + _GAP + rb"([0-9]{1,9})" + _GAP + rb"([0-9]{1,5})[ \t\n\v\f\r]")


def pgm_length(data: memoryview) -> int:
    """Bytes of the graymap at the start, or 0: any white space and comments between numbers, one or two bytes a sample."""
    if not (head := _GRAYMAP.match(data)):
        return 0
    width, height, top = map(int, head.groups())
    size = head.end() + width * height * (1 if top < 256 else 2)
    return size if 0 < top < 65536 and width > 0 and height > 0 and size <= len(data) else 0


VALID = {"audio/wav": wav_length, "image/png": png_length, "image/gif": gif_length, "image/bmp": bmp_length, "image/jpeg": jpeg_length, "image/x-portable-graymap": pgm_length}


def sniff(data: bytes, found=None) -> list[tuple[int, int, str]]:
    """Media in ``data`` as ``(start, length, type)``: the outermost, in order, none inside another."""
    view, end, out = memoryview(data), 0, []
    for last, (n, at, kind) in (found or automaton()).iter(data.decode("latin-1")):
        start = last - n + 1 - at
        if start >= end and (size := VALID[kind](view[start:])):
            out.append((start, size, kind))
            end = start + size
    return out


def to_wav(samples: bytes) -> bytes:
    """One channel of unsigned 8-bit samples as a WAV file; an odd length gets its padding byte."""
    pad = b"\0" * (len(samples) & 1)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples + pad


def from_wav(data: bytes) -> bytes:
    """The samples of a WAV file that wav_length() accepts."""
    at = 12
    while True:
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"data":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)


def features(samples: bytes) -> str:
    """Mean, deviation, mean-crossing rate and peak of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8)
    total, n = int(x.sum(dtype=np.int64)), len(x)
    if not n:
        return "n=0"
    mean = total / n
    squares = int((np.bincount(x, minlength=256).astype(np.int64) * np.arange(256) ** 2).sum())
    above = x > mean
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    return f"n={n};mean={mean:.6f};sd={max(0.0, squares / n - mean * mean) ** 0.5:.6f};crossings={crossings};peak={int(x.max())}"


def preview(samples: bytes) -> bytes:
    """A graymap of 16 by 16 pixels: how often each byte value is among the samples, the commonest white."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    return b"P5\n16 16\n255\n" + (counts * 255 // max(1, counts.max())).astype(np.uint8).tobytes()


def sniff_media(df: DataFrame, key: str, content: str = "content", declared: str = "declared_type") -> DataFrame:
    """One row for each medium carved from a binary column.

    ``key, part, start, length, declared_type, media_type, corrected, media``: part 0, 1, ... in
    order of place; media_type is what the bytes are; corrected if the column's declared type says
    otherwise. Content without a valid medium gives one row with part -1 and type
    ``application/octet-stream`` over all of it; null content is empty. Repeated rows give repeated
    rows, an empty table none; the key must not be named like another output column.
    """
    names = ["key", "part", "start", "length", "declared_type", "media_type", "corrected", "media"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        found = automaton()
        for batch in batches:
            rows = []
            for k, said, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = data or b""
                parts = [(i, *x) for i, x in enumerate(sniff(data, found))] or [(-1, 0, len(data), "application/octet-stream")]
                rows += [(k, i, start, n, said, kind, said != kind, data[start : start + n]) for i, start, n, kind in parts]
            kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    kind = df.schema[key].dataType.simpleString()
    said = F.col(declared).cast("string") if declared in df.columns else F.lit(None).cast("string")
    return df.select(F.col(key).alias("key"), said.alias("said"), F.col(content).alias("content")).mapInArrow(run, f"key {kind}, part int, start long, length long, declared_type string, media_type string, corrected boolean, media binary").withColumnRenamed("key", key)


def payload_of(text: str | None, block: int = BLOCK) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "replace")
    return raw + b" " * (-len(raw) % block if raw else block), len(raw)


def store_texts(docs: DataFrame, block: int = BLOCK, previews: bool = False) -> DataFrame:
    """Every whole text as a WAV column: ``doc_id, n_bytes, declared_type, content``.

    The UTF-8 bytes, with spaces up to a positive multiple of ``block``, are the unsigned 8-bit
    samples. A null text is empty. The declared type is a guess that sniffing has to correct. With
    ``previews`` a small image of the samples stands before the sound in the same column, so that
    readers have to carve both.
    """
    names = ["doc_id", "n_bytes", "declared_type", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            sizes = np.diff(utf8(texts)[1])
            for lo, hi in slices(sizes, 1 << 23):
                made = [payload_of(t, block) for t in texts[lo:hi].to_pylist()]
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array([n for _, n in made], pa.int64()), pa.array(["application/octet-stream"] * len(made)), pa.array([(preview(p) if previews else b"") + to_wav(p) for p, _ in made], pa.binary())], names)

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, declared_type string, content binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Digests and features of stored samples: sniffed, validated, carved, decoded.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, media_type, corrected, media_start, preview``: corrected if the declared type isn't what
    the bytes are, media_start where the sound was found in the content, preview ``ok`` if an image
    before it was found and is that of the samples, ``wrong`` if it isn't, else null. A row whose content is null or holds no valid WAV (anywhere: it is carved) has nulls from payload_bytes
    to feature and in the last two, and the type ``application/octet-stream``. Repeated rows and null ids are kept; an
    empty table gives none.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected", "media_start", "preview"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        found = automaton()
        for batch in batches:
            rows = []
            for doc_id, n_bytes, said, content in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "declared_type", "content")), strict=True):
                data = content.as_py() or b""
                parts = sniff(data, found)
                start, size, kind = next((x for x in parts if x[2] == "audio/wav"), (0, 0, "application/octet-stream"))
                if not size:
                    rows.append((doc_id.as_py(), n_bytes.as_py(), *[None] * 6, kind, said.as_py() != kind, None, None))
                    continue
                media = data[start : start + size]
                samples = from_wav(media)
                image = next((data[lo : lo + n] for lo, n, what in parts if what == "image/x-portable-graymap" and lo < start), None)
                seen = None if image is None else "ok" if image == preview(samples) else "wrong"
                rows.append((doc_id.as_py(), n_bytes.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(samples), kind, said.as_py() != kind, start, seen))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return stored.select("doc_id", "n_bytes", "declared_type", "content").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean, media_start long, preview string")
