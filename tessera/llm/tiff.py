"""Media columns: TIFF images in a binary column, read as one row per page.

The reader walks the chain of image directories in either byte order, decodes strips or tiles that
are stored plainly, by PackBits, LZW or deflate, undoes the horizontal predictor and emits one row
per directory. Samples have 8 or 16 bits, interleaved or in planes. The writer makes such files from
arrays, so that any payload of bytes can be stored as a media column without loss.

Defined results: null or empty media give no rows; a page that is damaged or of a kind that isn't
read gives a row with `error` set and no samples; directories that point back end the walk. Memory
is bounded by one page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .blocks import prepare, slices

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Fixed values of the format: bytes of each field type.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_MOST_SAMPLES = 1 << 28


def unpack_bits(data: bytes, size: int) -> bytes:
    """Decodes PackBits up to size bytes."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def pack_bits(data: bytes) -> bytes:
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    starts = np.flatnonzero(np.diff(x, prepend=x[:1] ^ 1) != 0)
    out, plain = bytearray(), bytearray()

    def flush() -> None:
        for j in range(0, len(plain), 128):
            out.append(len(plain[j : j + 128]) - 1)
            out.extend(plain[j : j + 128])
        plain.clear()

    for a, n in zip(starts.tolist(), np.diff(starts, append=len(x)).tolist(), strict=True):
        if n < 3:
            plain += data[a : a + n]
            continue
        flush()
        while n > 0:
            k = min(n, 128)
            if k == 1:
                out += bytes((0, data[a]))
            else:
                out += bytes((257 - k, data[a]))
            n -= k
    flush()
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early."""
    table: list[bytes] = []
    out, bits, held, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257 or not table:
            break
        if not last:
            if code > 257:
                raise ValueError("LZW code out of range")
            last = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            table.append(last + entry[:1])
            last = entry
        out += last
        if len(out) >= size:
            break
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table, width, now = {bytes((i,)): i for i in range(256)}, 9, b""
    put(256, 9)
    following = 258
    for byte in data:
        more = now + bytes((byte,))
        if more in table:
            now = more
            continue
        put(table[now], width)
        table[more] = following
        following += 1
        if following == 4094:
            put(256, 12)
            table, width, following = {bytes((i,)): i for i in range(256)}, 9, 258
        else:
            width = max(9, following.bit_length())
        now = bytes((byte,))
    if now:
        put(table[now], width)
        following += 1
    put(257, max(9, min(12, following.bit_length())))
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


_ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), OLD_DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits}


def _inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size)


_DECODE = {NONE: lambda x, n: x[:n], LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: unpack_bits}


@dataclass
class Page:
    number: int
    width: int = 0
    height: int = 0
    samples: int = 0
    bits: int = 0
    compression: int = 0
    predictor: int = 1
    tiled: bool = False
    pixels: np.ndarray | None = None
    error: str | None = None


def _fields(data: bytes, at: int, e: str) -> tuple[dict[int, list[int]], int]:
    """The integer fields of the directory at an offset, and the offset of the next."""
    (n,) = struct.unpack_from(e + "H", data, at)
    out: dict[int, list[int]] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
        size = _SIZES.get(kind, 0) * count
        where = at + 10 + 12 * i
        if size > 4:
            (where,) = struct.unpack_from(e + "I", data, where)
        if kind in (1, 3, 4) and where + size <= len(data):
            out[tag] = list(struct.unpack_from(f"{e}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, where))
    (following,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)
    return out, following


def _pixels(data: bytes, f: dict[int, list[int]], e: str, page: Page) -> np.ndarray:
    one = lambda tag, default: (f.get(tag) or [default])[0]
    w, h, s = page.width, page.height, page.samples
    kind = np.dtype(e + ("u1" if page.bits == 8 else "u2"))
    planes = s if one(284, 1) == 2 else 1
    per = s // planes
    if page.tiled:
        tw, th, offsets, sizes = one(322, 0), one(323, 0), f[324], f[325]
    else:
        tw, th, offsets, sizes = w, min(one(278, h), h), f[273], f.get(279) or [len(data)]
    if min(w, h, s, tw, th) < 1 or w * h * s > _MOST_SAMPLES or tw * th * per > _MOST_SAMPLES:
        raise ValueError("size out of range")
    across, down = -(-w // tw), -(-h // th)
    if len(offsets) < across * down * planes or len(sizes) < across * down * planes:
        raise ValueError("too few strips or tiles")
    out = np.empty((h, w, s), kind.newbyteorder("="))
    for plane in range(planes):
        for k in range(across * down):
            y, x = k // across * th, k % across * tw
            rows = th if page.tiled else min(th, h - y)
            at, n = offsets[plane * across * down + k], sizes[plane * across * down + k]
            raw = _DECODE[page.compression](data[at : at + n], rows * tw * per * kind.itemsize)
            if len(raw) != rows * tw * per * kind.itemsize:
                raise ValueError("short strip or tile")
            block = np.frombuffer(raw, kind).astype(kind.newbyteorder("=")).reshape(rows, tw, per)
            if page.predictor == 2:
                block = np.cumsum(block, axis=1, dtype=block.dtype)
            part = block[: h - y, : w - x]
            out[y : y + part.shape[0], x : x + part.shape[1], plane if planes > 1 else slice(None)] = part[:, :, 0] if planes > 1 else part
    return out


def pages(data: bytes | None) -> Iterator[Page]:
    """Each page of a TIFF file, decoded."""
    if not data:
        return
    e = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if e is None or len(data) < 8:
        yield Page(0, error="not a TIFF file")
        return
    (at,) = struct.unpack_from(e + "I", data, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        page = Page(len(seen) - 1)
        try:
            f, at = _fields(data, at, e)
        except struct.error:
            page.error = "directory out of range"
            yield page
            return
        try:
            one = lambda tag, default: (f.get(tag) or [default])[0]  # noqa: E731, B023
            page.width, page.height, page.samples, page.bits = one(256, 0), one(257, 0), one(277, 1), one(258, 1)
            page.compression, page.predictor, page.tiled = one(259, 1), one(317, 1), 324 in f
            if page.bits not in (8, 16) or page.compression not in _DECODE or page.predictor not in (1, 2):
                raise ValueError("bits, compression or predictor not read")
            page.pixels = _pixels(data, f, e, page)
        except (ValueError, KeyError, IndexError, struct.error, zlib.error) as x:
            page.error = str(x) or type(x).__name__
        yield page


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = 1024, tile: tuple[int, int] | None = None, order: str = "<", planar: bool = False) -> bytes:
    """A TIFF file with one page for each array (height, width[, samples]) of uint8 or uint16, in strips of some rows, or in tiles (height, width)."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4
    for image in images:
        image = image if image.ndim == 3 else image[:, :, None]
        h, w, s = image.shape
        th, tw = tile or (min(rows, max(h, 1)), w)
        offsets, sizes = [], []
        for plane in [image[:, :, [i]] for i in range(s)] if planar else [image]:
            for y in range(0, h, th):
                for x in range(0, w, tw):
                    block = plane[y : y + th, x : x + tw]
                    if tile:
                        block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                    if predictor == 2:
                        block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                    packed = _ENCODE[compression](block.astype(image.dtype.newbyteorder(order)).tobytes())
                    offsets.append(len(out))
                    sizes.append(len(packed))
                    out += packed + b"\0" * (len(packed) % 2)
        where = {256: [w], 257: [h], 258: [image.dtype.itemsize * 8] * s, 259: [compression], 262: [2 if s == 3 else 1], 277: [s], 284: [2 if planar else 1], 317: [predictor]}
        where |= {322: [tw], 323: [th], 324: offsets, 325: sizes} if tile else {273: offsets, 278: [th], 279: sizes}
        entries = bytearray()
        for tag in sorted(where):
            kind = 3 if tag in (258, 259, 262, 277, 284, 317) else 4
            packed = struct.pack(f"{order}{len(where[tag])}{'H' if kind == 3 else 'I'}", *where[tag])
            if len(packed) > 4:
                at = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind, len(where[tag])) + packed.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(where)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGES = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def read_pages(df: DataFrame, media: str, key: str) -> DataFrame:
    """One row (key, page, its properties, pixels, error) for each page of each row's media column."""
    prepare(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def read(batches):
        for part, values in slices(batches, media):
            keys = part.column(part.schema.get_field_index(key)).to_pylist()
            for k, data in zip(keys, values, strict=True):
                got = [(k, p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, None if p.pixels is None else p.pixels.tobytes(), p.error) for p in pages(data)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), [part.column(part.schema.get_field_index(key)).type, *[pa.int32()] * 7, pa.bool_(), pa.binary(), pa.string()], strict=True)], names=["key", *[x.split()[0] for x in PAGES.split(", ")]])

    return df.select(key, media).mapInArrow(read, f"key {kind}, {PAGES}").withColumnRenamed("key", key)


#: How the query stores a text: lines of WIDTH samples, and pages of at most PAGE lines.
WIDTH, PAGE = 64, 9 << 10
#: A payload is filled up to a multiple of this.
UNIT = 576


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b"\xff")


@F.pandas_udf(BinaryType())
def stored_as_tiff(text: pd.Series) -> pd.Series:
    """UTF-8 bytes as a deflated TIFF with the horizontal predictor; null as an empty text."""
    out = []
    for x in text:
        image = np.frombuffer(payload(x), np.uint8).reshape(-1, WIDTH)
        out.append(write([image[i : i + PAGE] for i in range(0, len(image), PAGE)], DEFLATE, predictor=2))
    return pd.Series(out, dtype=object)


_DIGEST = {"payload_bytes": LongType(), "payload_sha256": StringType(), "tail_crc32": LongType(), "media_bytes": LongType(), "media_sha256": StringType(), "feature": StringType(), "pages": IntegerType()}


@F.pandas_udf(StructType([StructField(k, t) for k, t in _DIGEST.items()]))
def digested(media: pd.Series) -> pd.DataFrame:
    """What the samples of all pages hold, in their order, after reading the stored bytes back."""
    rows = []
    for data in media:
        sha, size, tail, n, counts = hashlib.sha256(), 0, b"", 0, np.zeros(256, np.int64)
        for p in pages(data):
            if p.error:
                raise ValueError(p.error)
            raw = p.pixels.tobytes()
            sha.update(raw)
            size, tail, n = size + len(raw), (tail + raw[-32:])[-32:], n + 1
            counts += np.bincount(p.pixels.ravel(), minlength=256)
        levels = counts.reshape(16, 16).sum(1)
        mean = int((counts * np.arange(256)).sum()) * 1000 // max(size, 1)
        rows.append((size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), f"pages={n};mean={mean};levels=" + ",".join(map(str, levels.tolist())), n))
    return pd.DataFrame(rows, columns=list(_DIGEST))
