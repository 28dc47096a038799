import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import tiff


def _pack_bits(data):
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while i + run < len(data) and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[i]])
            i += run
        else:
            j = i
            while j < len(data) and j - i < 128 and (j + 1 >= len(data) or data[j + 1] != data[j]):
                j += 1
            out += bytes([j - i - 1]) + data[i:j]
            i = j
    return bytes(out)


def _lzw(data):
    table, bits, width, out, held = {bytes([i]): i for i in range(256)}, 0, 9, bytearray(), 0
    following, last = 258, b""

    def put(code):
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    for i in range(len(data)):
        now = last + data[i : i + 1]
        if now in table:
            last = now
            continue
        put(table[last])
        table[now] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        last = data[i : i + 1]
        if following == 4094:
            put(256)
            table, following, width = {bytes([i]): i for i in range(256)}, 258, 9
    if last:
        put(table[last])
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _file(order, image, compression, tile=None, rows=5, predictor=1, planar=1, pages=1):
    """A file in the given byte order; image is (height, width, samples) of 8 or 16 bits."""
    pack = {1: lambda d: d, 5: _lzw, 8: zlib.compress, 32773: _pack_bits}[compression]
    bits = image.dtype.itemsize * 8
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4
    for _ in range(pages):
        height, width, samples = image.shape
        planes = [image] if planar == 1 else [image[:, :, k : k + 1] for k in range(samples)]
        offsets, counts = [], []
        for plane in planes:
            if tile:
                tw, th = tile
                parts = []
                for y in range(0, height, th):
                    for x in range(0, width, tw):
                        part = np.zeros((th, tw, plane.shape[2]), image.dtype)
                        cut = plane[y : y + th, x : x + tw]
                        part[: cut.shape[0], : cut.shape[1]] = cut
                        parts.append(part)
            else:
                parts = [plane[y : y + rows] for y in range(0, height, rows)]
            for part in parts:
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                data = pack(part.astype(f"{order}u{bits // 8}").tobytes())
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        fields = [(256, 3, [width]), (257, 3, [height]), (258, 3, [bits] * samples), (259, 3, [compression]), (262, 3, [1]), (277, 3, [samples]), (284, 3, [planar]), (317, 3, [predictor])]
        fields += [(322, 3, [tile[0]]), (323, 3, [tile[1]]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 3, [rows]), (279, 4, counts)]
        entries = []
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                place = struct.pack(f"{order}I", len(out))
                out += raw
            else:
                place = raw.ljust(4, b"\0")
            entries.append(struct.pack(f"{order}HHI", tag, kind, len(values)) + place)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize(("tile", "predictor", "planar", "kind"), [(None, 1, 1, np.uint8), (None, 2, 1, np.uint8), ((16, 16), 2, 1, np.uint8), ((16, 16), 1, 2, np.uint8), (None, 2, 1, np.uint16), (None, 1, 2, np.uint16)])
def test_round_trips(order, compression, tile, predictor, planar, kind):
    r = np.random.default_rng(3)
    image = r.integers(0, 256 if kind == np.uint8 else 65536, (37, 29, 3)).astype(kind)
    image[5:20] = 7
    found = tiff.pages(_file(order, image, compression, tile, 5, predictor, planar, 2))
    assert len(found) == 2
    for page in found:
        unit = page.bits // 8
        assert np.array_equal(np.frombuffer(page.pixels, f"{order}u{unit}").reshape(37, 29, 3), image)


def test_lzw_over_several_tables():
    r = random.Random(1)
    data = bytes(r.choice(b"abcd ") for _ in range(60_000))
    assert tiff.unpack_lzw(_lzw(data)) == data


def test_stored_texts(docs_of):
    texts = [None, "", "short", "é" * 1000, "x" * 192, "long text " * 30_000, "same", "same"]
    rows = {r["doc_id"]: r for r in tiff.stored_texts(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data.ljust(-(-max(len(data), 1) // 192) * 192)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-16:])
        media = tiff.store(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert rows[6]["feature"] == rows[7]["feature"] != rows[2]["feature"]
    assert rows[5]["feature"].startswith("2p64x")
    assert tiff.stored_texts(docs_of(["x"]).where("false")).count() == 0


def test_rows_for_pages_and_broken_files(spark):
    good = tiff.store(b"ab" * 96 * 1100)
    rows = spark.createDataFrame([(1, good), (2, b"no file"), (3, None), (4, good[:200])], "key long, media binary")
    got = sorted((r["key"], r["page"], r["height"], r["error"] is None) for r in tiff.tiff_pages(rows).collect())
    assert got == [(1, 0, 1024, True), (1, 1, 76, True), (2, -1, None, False), (3, -1, None, False), (4, -1, None, False)]
