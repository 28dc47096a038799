"""TIFF media columns: a reader of image directories, and a writer for lossless storage of bytes.

The reader takes both byte orders; bilevel to 16-bit samples as they are stored; strips and tiles;
no compression, PackBits, LZW and deflate; the horizontal predictor; one row for each page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: tags, and bytes of each field type.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}

#: Bytes in a row of pixels of a stored payload: 64 pixels of three samples.
ROW = 192
#: Rows of pixels in a strip and in a page.
STRIP_ROWS, PAGE_ROWS = 64, 1024


@dataclass(frozen=True)
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes  # rows from the top, samples of a pixel together


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest first; 256 clears the table, 257 ends; widths grow one code early."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, bits, held, last = [], 9, 0, 0, None
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _unpacked(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return unpack_lzw(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise ValueError(f"compression {compression} is not supported")


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (count,) = struct.unpack_from(f"{order}H", data, at)
    fields = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        size = TYPE_BYTES.get(kind, 0) * n
        place = at + 10 + 12 * i
        if size > 4:
            (place,) = struct.unpack_from(f"{order}I", data, place)
        if kind in TYPE_CODES:
            fields[tag] = struct.unpack_from(f"{order}{n}{TYPE_CODES[kind]}", data, place)
    (following,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * count)
    return fields, following


def _block(raw: bytes, width: int, height: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """Rows of bytes of one strip or tile, predictor undone."""
    row = (width * samples * bits + 7) // 8
    block = np.frombuffer(raw[: row * height], np.uint8).reshape(-1, row)
    if predictor == 2 and bits in (8, 16):
        values = block.reshape(len(block), -1).copy()
        if bits == 16:
            values = values.view(f"{order}u2").astype(np.uint16)
        values = np.cumsum(values.reshape(len(block), width, samples), axis=1, dtype=values.dtype).reshape(len(block), -1)
        block = values.astype(f"{order}u2").view(np.uint8) if bits == 16 else values
    elif predictor not in (1, 2) or predictor == 2:
        raise ValueError(f"predictor {predictor} of {bits}-bit samples is not supported")
    return block


def pages(data: bytes) -> list[Page]:
    """Every page of a file, in the order of its directories; a chain that runs in a circle ends where it meets itself."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        field, at = _directory(data, at, order)
        one = lambda tag, default=None, field=field: field.get(tag, (default,))[0]
        width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
        bits, compression, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
        tiled = TILE_OFFSETS in field
        places = zip(field[TILE_OFFSETS if tiled else STRIP_OFFSETS], field[TILE_COUNTS if tiled else STRIP_COUNTS], strict=True)
        blocks = [_unpacked(data[p : p + n], compression) for p, n in places]
        planes = samples if one(PLANAR, 1) == 2 and samples > 1 else 1
        own = samples // planes
        bw, bh = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height) or 1)
        across, down = -(-width // bw), -(-height // bh)
        row = (width * own * bits + 7) // 8
        image = np.zeros((planes, height, row), np.uint8)
        for k, raw in enumerate(blocks[: planes * across * down]):
            plane, rest = divmod(k, across * down)
            y, x = divmod(rest, across)
            part = _block(raw, bw, bh if tiled else min(bh, height - y * bh), own, bits, predictor, order)[: height - y * bh]
            left = x * bw * own * bits // 8
            part = part[:, : row - left]
            image[plane, y * bh : y * bh + len(part), left : left + part.shape[1]] = part
        if planes > 1:
            unit = bits // 8
            pixels = image.reshape(planes, height, width, unit).transpose(1, 2, 0, 3).tobytes()
        else:
            pixels = image.tobytes()
        out.append(Page(width, height, samples, bits, compression, predictor, tiled, pixels))
    return out


def store(payload: bytes, page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS) -> bytes:
    """A TIFF of 64 pixels a row, three 8-bit samples each, deflated strips with the horizontal predictor.

    The payload is a positive multiple of ROW bytes; every `page_rows` rows are a page.
    """
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    for top in range(0, len(image), page_rows):
        page = image[top : top + page_rows]
        apart = page.copy()
        apart[:, 1:] -= page[:, :-1]
        offsets, counts = [], []
        for y in range(0, len(page), strip_rows):
            data = zlib.compress(apart[y : y + strip_rows].tobytes(), 1)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        extra = {BITS: len(out)}
        out += struct.pack("<3H", 8, 8, 8)
        for tag, values in ((STRIP_OFFSETS, offsets), (STRIP_COUNTS, counts)):
            extra[tag] = len(out) if len(values) > 1 else values[0]
            out += struct.pack(f"<{len(values)}I", *values) if len(values) > 1 else b""
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        fields = [
            (WIDTH, 4, 1, ROW // 3), (LENGTH, 4, 1, len(page)), (BITS, 3, 3, extra[BITS]), (COMPRESSION, 3, 1, DEFLATE),
            (PHOTOMETRIC, 3, 1, 2), (STRIP_OFFSETS, 4, len(offsets), extra[STRIP_OFFSETS]), (SAMPLES, 3, 1, 3),
            (ROWS_PER_STRIP, 4, 1, strip_rows), (STRIP_COUNTS, 4, len(counts), extra[STRIP_COUNTS]), (PLANAR, 3, 1, 1), (PREDICTOR, 3, 1, 2),
        ]
        out += struct.pack("<H", len(fields))
        for field in fields:
            out += struct.pack("<HHII", *field)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def features(read: list[Page]) -> str:
    """Pages, size, and a digest of each sample's histogram of 16 levels: the same for the same pixels."""
    data = np.frombuffer(b"".join(p.pixels for p in read), np.uint8)
    samples = read[0].samples if read and read[0].bits == 8 else 1
    shape = f"{len(read)}p{read[0].width if read else 0}x{sum(p.height for p in read)}"
    levels = [np.bincount(data[k::samples] >> 4, minlength=16) for k in range(samples)]
    means = ",".join(f"{data[k::samples].mean():.3f}" if len(data) else "0" for k in range(samples))
    return f"{shape}:{means}:{hashlib.md5(np.array(levels, '<i8').tobytes()).hexdigest()}"


PAGES = "key long, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def tiff_pages(media: DataFrame) -> DataFrame:
    """One row for each page of each file of media (key, media).

    A file that can't be read, and a null, give one row with page -1 and the error; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PAGES.split(", ")]
        kinds = [pa.int64(), *[pa.int32()] * 7, pa.bool_(), pa.binary(), pa.string()]
        for batch in batches:
            out = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    if not data.is_valid:
                        raise ValueError("null")
                    found = pages(data.as_py())
                    out += [(key, k, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels, None) for k, p in enumerate(found)]
                except (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error) as e:
                    out.append((key, -1, *[None] * 8, str(e) or type(e).__name__))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return media.select(F.col("key").cast("long").alias("key"), "media").mapInArrow(run, PAGES)


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_texts(docs: DataFrame) -> DataFrame:
    """Stores every text of docs (doc_id, text) as a TIFF, reads it back, and describes both. Null is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                media = store(data.ljust(-(-max(len(data), 1) // ROW) * ROW))
                read = pages(media)
                back = b"".join(p.pixels for p in read)
                out.append((key, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(read)))
            names = [x.split()[0] for x in STORED.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORED)
