"""TIFF as a media column: image directories are walked, strips and tiles decoded, predictors undone; one row per page.

Reads II and MM files with 8-bit samples: compression none (1), LZW (5), deflate (8, 32946) and PackBits (32773); strips or tiles; predictor none (1) or
horizontal (2); chunky or planar samples. ``encode`` writes the same forms.

Defined results: a null or broken file gives one row with page null and the reason in ``error``; a directory that was visited before or lies outside
ends the walk with such a row after the pages before it; sizes of 0, or larger than the file's strips can fill, are errors; bytes missing at the end of a page are an error, surplus ones are
ignored; repeated rows give repeated pages; an empty table gives an empty result; other columns are ignored. Work is by row: memory is bounded by one file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table

NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
#: Tags of the TIFF 6.0 specification.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_SIZES, PLANAR, PREDICTOR, TILE_W, TILE_H, TILES, TILE_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
_FORMAT = {1: "B", 2: "c", 3: "H", 4: "I"}
PAD, UNIT, PAGE_ROWS, STRIP_ROWS = 255, 576, 256, 64


def unpack_bits(data: bytes, size: int) -> bytes:
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
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
                j += 1
            out.append(j - i - 1)
            out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears, 257 ends; the width grows one code early."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    words, width, last, out = first[:], 9, b"", bytearray()
    held = bits = 0
    for byte in data:
        held, bits = ((held << 8) | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = (held >> bits) & ((1 << width) - 1)
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            words, width, last = first[:], 9, b""
            continue
        if code < len(words):
            word = words[code]
        elif code == len(words) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += word
        if last:
            words.append(last + word[:1])
        last = word
        width = 9 if len(words) < 511 else 10 if len(words) < 1023 else 11 if len(words) < 2047 else 12
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    codes: dict[bytes, int] = {}

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
        held &= (1 << bits) - 1

    def clear(width: int) -> int:
        put(256, width)
        codes.clear()
        codes.update({bytes((i,)): i for i in range(256)})
        return 258

    used, width = clear(9), 9
    word = b""
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in codes:
            word = more
            continue
        put(codes[word], width)
        codes[more] = used
        used += 1
        width = 9 if used < 511 + 1 else 10 if used < 1023 + 1 else 11 if used < 2047 + 1 else 12
        if used > 4094:
            used, width = clear(width), 9
        word = data[i : i + 1]
    if word:
        put(codes[word], width)
        used += 1
        width = 9 if used < 511 + 1 else 10 if used < 1023 + 1 else 11 if used < 2047 + 1 else 12
    put(257, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def _packed(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    return {LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), DEFLATE_OLD: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits}[compression](data)


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, DEFLATE_OLD):
        return zlib.decompressobj().decompress(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"compression {compression} isn't known")


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF file of pages, 8-bit arrays (height, width) or (height, width, samples), in strips of rows or in tiles (height, width)."""
    head = b"II" if order == "<" else b"MM"
    out = bytearray(head + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        h, w, s = page.shape
        th, tw = tile or (rows, w)
        places, sizes = [], []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                piece = page[y : y + th, x : x + tw]
                if tile:
                    piece = np.pad(piece, ((0, th - piece.shape[0]), (0, tw - piece.shape[1]), (0, 0)))
                if predictor == 2:
                    piece = np.concatenate([piece[:, :1], np.diff(piece, axis=1)], axis=1)
                data = _packed(np.ascontiguousarray(piece).tobytes(), compression)
                places.append(len(out))
                sizes.append(len(data))
                out += data + b"\0" * (len(data) % 2)
        entries = [(WIDTH, [w]), (HEIGHT, [h]), (BITS, [8] * s), (COMPRESSION, [compression]), (PHOTOMETRIC, [2 if s == 3 else 1]), (SAMPLES, [s]), (PLANAR, [1]), (PREDICTOR, [predictor])]
        entries += [(TILE_W, [tw]), (TILE_H, [th]), (TILES, places), (TILE_SIZES, sizes)] if tile else [(ROWS, [rows]), (STRIPS, places), (STRIP_SIZES, sizes)]
        ready = []
        for tag, values in sorted(entries):
            kind = 3 if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR) else 4
            body = struct.pack(f"{order}{len(values)}{_FORMAT[kind]}", *values)
            if len(body) > 4:
                at = len(out)
                out += body + b"\0" * (len(body) % 2)
                body = struct.pack(order + "I", at)
            ready.append(struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(ready)) + b"".join(ready)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (count,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in (1, 3, 4):
            continue
        place = at + 10 + 12 * i
        if n * struct.calcsize(_FORMAT[kind]) > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        tags[tag] = list(struct.unpack_from(f"{order}{n}{_FORMAT[kind]}", data, place))
    (after,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
    return tags, after


def _page(data: bytes, tags: dict[int, list[int]]) -> np.ndarray:
    one = lambda tag, default=None: tags[tag][0] if default is None else tags.get(tag, [default])[0]
    w, h, s, compression, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if set(tags.get(BITS, [1])) != {8}:
        raise ValueError("samples aren't of 8 bits")
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} isn't known")
    if min(w, h, s) < 1:
        raise ValueError("width, height or samples are 0")
    tiled, planes = TILES in tags, s if one(PLANAR, 1) == 2 else 1
    tw, th = (one(TILE_W), one(TILE_H)) if tiled else (w, min(one(ROWS, h), h) or 1)
    places, sizes = (tags[TILES], tags[TILE_SIZES]) if tiled else (tags[STRIPS], tags[STRIP_SIZES])
    if min(tw, th) < 1:
        raise ValueError("strips or tiles are empty")
    if len(places) != len(sizes) or len(places) < planes * -(-h // th) * -(-w // tw):
        raise ValueError("strips or tiles are missing")
    deep, pieces, k = s // planes, [], 0
    # All pieces are read before the page is laid out, so a header can't ask for more memory than its file holds bytes for.
    for plane in range(planes):
        for y in range(0, h, th):
            for x in range(0, w, tw):
                high = th if tiled else min(th, h - y)
                size = high * tw * deep
                raw = _unpacked(data[places[k] : places[k] + sizes[k]], compression, size)
                if len(raw) < size:
                    raise ValueError("a strip or tile is too short")
                piece = np.frombuffer(raw, np.uint8, size).reshape(high, tw, deep)
                if predictor == 2:
                    piece = np.cumsum(piece, axis=1, dtype=np.uint8)
                pieces.append((y, x, plane, piece))
                k += 1
    out = np.zeros((h, w, s), np.uint8)
    for y, x, plane, piece in pieces:
        into = out[y : y + piece.shape[0], x : x + tw, plane * deep : (plane + 1) * deep]
        into[:] = piece[: into.shape[0], : into.shape[1]]
    return out


def walk(data: bytes | None) -> Iterator[tuple[int | None, int, np.ndarray | None, str | None]]:
    """(page, compression, samples, error) for each directory in turn; a page that can't be decoded is a row with its number and error, and the walk goes on."""
    errors = (ValueError, LookupError, ArithmeticError, MemoryError, struct.error, zlib.error)
    try:
        if data is None:
            raise ValueError("no file")
        order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]
        magic, at = struct.unpack_from(order + "HI", data, 2)
        if magic != 42:
            raise ValueError("not TIFF")
        seen, page = set(), 0
        while at:
            if at in seen:
                raise ValueError("the directories run in a circle")
            seen.add(at)
            tags, after = _directory(data, at, order)
            x, error = None, None
            try:
                x = _page(data, tags)
            except errors as e:
                error = f"{type(e).__name__}: {e}"
            yield page, tags.get(COMPRESSION, [1])[0], x, error
            at, page = after, page + 1
    except errors as e:
        yield None, 0, None, f"{type(e).__name__}: {e}"


def pages(df: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """One row per page of each file: id, page, height, width, samples, compression, pixels, error."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, data in zip(b.column(0), b.column(1), strict=True):
                for page, compression, x, error in walk(data.as_py()):
                    h, w, s = x.shape if x is not None else (None, None, None)
                    row = {"id": [i.as_py()], "page": [page], "height": [h], "width": [w], "samples": [s], "compression": [compression], "pixels": [None if x is None else x.tobytes()], "error": [error]}
                    yield pa.RecordBatch.from_pydict(row, schema=schema)

    kinds = [("page", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())]
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(df.schema[id_col].dataType)), *kinds])
    out = df.select(F.col(id_col).alias("id"), F.col(bytes_col).cast("binary").alias("data")).mapInArrow(run, f"id {id_type}, page int, height int, width int, samples int, compression int, pixels binary, error string")
    return out.withColumnRenamed("id", id_col)


def padded(text: bytes, unit: int = UNIT) -> bytes:
    return text + bytes((PAD,)) * (max(unit, -(-len(text) // unit) * unit) - len(text))


def stored(payload: bytes, width: int = UNIT, page_rows: int = PAGE_ROWS) -> bytes:
    x = np.frombuffer(payload, np.uint8).reshape(-1, width)
    return encode([x[y : y + page_rows] for y in range(0, len(x), page_rows)])


def feature(payload: bytes, n_pages: int) -> str:
    """Pages, thousandths of the mean and variance, and the share of each 32 values in ten thousandths."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    values, n = np.arange(256), len(payload)
    total, squares = int(counts @ values), int(counts @ values**2)
    shares = counts.reshape(8, 32).sum(1) * 10_000 // n
    return f"pages={n_pages};mean={total * 1000 // n};var={(squares * n - total * total) * 1000 // (n * n)};hist={','.join(map(str, shares))}"


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text as a TIFF file, read back: the digests of what was stored and of what came back, and a feature."""

    def digests(text: bytes | None):
        text = text or b""
        payload = padded(text)
        media = stored(payload)
        found = list(walk(media))
        if any(e for *_, e in found):
            raise ValueError(found[-1][-1])
        back = b"".join(x.tobytes() for _, _, x, _ in found)
        return len(text), len(payload), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, len(found))

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            columns = list(zip(*(digests(x.as_py()) for x in b.column(1)), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", *names])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("t"))
    return slim.mapInArrow(run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return documents(table(spark, sf_dir, "documents"))
