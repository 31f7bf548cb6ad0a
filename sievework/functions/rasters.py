"""Lossless image files from arrays of pixels, and baseline TIFF and PNG files back to pixels, by numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Tags of a TIFF directory and codes of its compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR, COLOURS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_KINDS = {1: "B", 2: "B", 3: "H", 4: "I"}


# ---------------------------------------------------------------- writing


def bmp(px: np.ndarray) -> bytes:
    """24-bit BMP of (height, width, 3) bytes."""
    h, w, _ = px.shape
    line = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    line[:, : w * 3] = px[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + line.size, 0, 54, 40, w, h, 1, 24, 0, line.size, 2835, 2835, 0, 0) + line.tobytes()


def png(px: np.ndarray, filters: list[int] | None = None) -> bytes:
    """PNG of (height, width, 3) bytes, its rows filtered as asked for."""
    h, w, _ = px.shape
    kinds = np.zeros(h, np.uint8) if filters is None else np.array(filters, np.uint8)
    near = np.pad(px.astype(np.int32), ((1, 0), (1, 0), (0, 0)))
    left, up, corner = near[1:, :-1], near[:-1, 1:], near[:-1, :-1]
    x, y, z = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    guess = [0 * left, left, up, (left + up) >> 1, np.where((x <= y) & (x <= z), left, np.where(y <= z, up, corner))]
    px = ((px - np.choose(kinds[:, None, None], guess)) & 255).astype(np.uint8)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.concatenate([kinds[:, None], px.reshape(h, w * 3)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def packed_bits(data: bytes) -> bytes:
    """PackBits: runs of three or more equal bytes as (1 - n, byte), others as they are."""
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at + 1
        while end < n and end - at < 128 and not (end + 2 < n and data[end] == data[end + 1] == data[end + 2]):
            end += 1
        out += bytes((end - at - 1,)) + data[at:end]
        at = end
    return bytes(out)


def lzw_packed(data: bytes) -> bytes:
    """The LZW of TIFF: codes of 9 to 12 bits, the highest bit first, that grow one code early."""
    out, held, bits, width = bytearray(), 0, 0, 9
    table, last = {}, None

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            out.append(held >> (bits - 8) & 255)
            bits -= 8
        held &= (1 << bits) - 1

    def wide(size: int) -> int:
        return 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12

    put(256)
    for b in data:
        if last is None:
            last = b
        elif (last, b) in table:
            last = table[last, b]
        else:
            put(last)
            table[last, b] = 258 + len(table)
            width = wide(258 + len(table))
            if len(table) == 4095 - 258:
                put(256)
                table, width = {}, 9
            last = b
    if last is not None:
        put(last)
        width = wide(259 + len(table))
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def tiff(px: np.ndarray, compression: int = NONE, rows: int = 5, order: str = "<", predictor: bool = False) -> bytes:
    """TIFF of (height, width, 1 or 3) bytes, in strips of some rows."""
    h, w, c = px.shape
    pack = {NONE: bytes, LZW: lzw_packed, DEFLATE: zlib.compress, PACKBITS: packed_bits}[compression]
    if predictor:
        px = np.concatenate([px[:, :1], np.diff(px, axis=1)], axis=1)
    strips = [px[a : a + rows] for a in range(0, h, rows)]
    # Runs of PackBits end with a row.
    data = [b"".join(pack(r.tobytes()) for r in s) if compression == PACKBITS else pack(s.tobytes()) for s in strips]
    body, at = b"".join(data), np.cumsum([8, *map(len, data)]).tolist()
    start = at[-1] + at[-1] % 2
    tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8] * c), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if c == 3 else 1]), (STRIPS, 4, at[:-1]), (SAMPLES, 3, [c]), (ROWS, 4, [rows]), (STRIP_BYTES, 4, list(map(len, data))), (PREDICTOR, 3, [1 + predictor])]
    entries, extra, far = b"", b"", start + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = struct.pack(f"{order}{len(values)}{_KINDS[kind]}", *values)
        if len(raw) > 4:
            entries += struct.pack(f"{order}HHII", tag, kind, len(values), far + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    head = struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, start)
    return head + body + b"\0" * (start - at[-1]) + struct.pack(f"{order}H", len(tags)) + entries + b"\0" * 4 + extra


# ---------------------------------------------------------------- reading


def unpacked_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def lzw_unpacked(data: bytes, size: int) -> bytes:
    out, first = bytearray(), [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, held, bits, last = list(first), 9, 0, 0, None
    for b in data:
        held, bits = held << 8 | b, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, last = list(first), 9, None
            continue
        if last is None:
            now = table[code]
        else:
            if code > len(table):
                raise ValueError("broken LZW")
            now = table[code] if code < len(table) else last + last[:1]
            table.append(last + now[:1])
        out += now
        last = now
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def read_tiff(content: bytes) -> tuple[np.ndarray, str]:
    """(height, width, 3) bytes and mode of the first image: 8 bits a sample, gray, RGB(A) or palette, in strips; plain, PackBits, LZW or deflate."""
    order = {b"II": "<", b"MM": ">"}[content[:2]]
    magic, at = struct.unpack_from(f"{order}HI", content, 2)
    if magic != 42:
        raise ValueError("not a TIFF of 32 bits")
    tags = {}
    for k in range(struct.unpack_from(f"{order}H", content, at)[0]):
        place = at + 2 + 12 * k
        tag, kind, n = struct.unpack_from(f"{order}HHI", content, place)
        if kind in _KINDS:
            size = n * struct.calcsize(_KINDS[kind])
            where = place + 8 if size <= 4 else struct.unpack_from(f"{order}I", content, place + 8)[0]
            tags[tag] = struct.unpack_from(f"{order}{n}{_KINDS[kind]}", content, where)
    w, h, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    how, kind = tags.get(COMPRESSION, (NONE,))[0], tags.get(PHOTOMETRIC, (1,))[0]
    if set(tags.get(BITS, (1,))) != {8} or STRIPS not in tags or kind > 3 or samples > 1 and tags.get(PLANAR, (1,))[0] != 1:
        raise ValueError("unsupported TIFF")
    unpack = {NONE: lambda b, n: b[:n], PACKBITS: unpacked_bits, LZW: lzw_unpacked, DEFLATE: lambda b, n: zlib.decompress(b)[:n], OLD_DEFLATE: lambda b, n: zlib.decompress(b)[:n]}[how]
    rows = min(tags.get(ROWS, (h,))[0], h)
    parts = [unpack(content[a : a + n], min(rows, h - k * rows) * w * samples) for k, (a, n) in enumerate(zip(tags[STRIPS], tags.get(STRIP_BYTES, (len(content),)), strict=False))]
    px = np.frombuffer(b"".join(parts), np.uint8)[: h * w * samples].reshape(h, w, samples)
    if tags.get(PREDICTOR, (1,))[0] == 2:
        px = np.cumsum(px, axis=1, dtype=np.uint8)
    if kind == 3:
        colours = np.array(tags[COLOURS]).reshape(3, 256).T >> 8
        return colours.astype(np.uint8)[px[:, :, 0]], "P"
    if samples < 3:
        gray = px[:, :, :1] if kind else 255 - px[:, :, :1]
        return np.repeat(gray, 3, axis=2), "L" if samples == 1 else "LA"
    return px[:, :, :3], "RGB" if samples == 3 else "RGBA"


def unfiltered(rows: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """The bytes of (height, width, bytes of a pixel) whose rows were filtered as PNG does.

    A pixel needs the ones to its left, above, and above left, so all pixels of
    an anti-diagonal are done at once.
    """
    h, w, n = rows.shape
    out = np.zeros((h + 1, w + 1, n), np.int32)
    kinds = filters.astype(np.int32)[:, None]
    for d in range(h + w - 1):
        i = np.arange(max(0, d - w + 1), min(h, d + 1))
        j = d - i
        left, up, corner, kind = out[i + 1, j], out[i, j + 1], out[i, j], kinds[i]
        x, y, z = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((x <= y) & (x <= z), left, np.where(y <= z, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)
        out[i + 1, j + 1] = (rows[i, j] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def read_png(content: bytes) -> tuple[np.ndarray, str]:
    """(height, width, 3) bytes and mode: 8 bits a sample, gray, RGB or palette, with or without alpha, not interlaced."""
    at, data, colours, head = 8, [], None, None
    while at + 8 <= len(content):
        n, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            colours = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    w, h, depth, colour, _, _, interlaced = head
    samples, mode = {0: (1, "L"), 2: (3, "RGB"), 3: (1, "P"), 4: (2, "LA"), 6: (4, "RGBA")}[colour]
    if depth != 8 or interlaced:
        raise ValueError("unsupported PNG")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * samples)
    px = lines[:, 1:].reshape(h, w, samples)
    if lines[:, 0].any():
        px = unfiltered(px, lines[:, 0])
    if colour == 3:
        return colours[px[:, :, 0]], mode
    return (np.repeat(px[:, :, :1], 3, axis=2) if samples < 3 else px[:, :, :3]), mode
