"""GeoTIFF rasters of one band: their cells with projected coordinates, and the bytes of a small writer.

Read are strips and tiles, raw or deflated, with or without a predictor, of whole or floating numbers. BigTIFF and
other compressions raise an error that names them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the format: tag numbers, and the kinds of numbers as (code, bytes).
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, BANDS, STRIP_ROWS, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, PIXEL_SCALE, TIE_POINT, NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
KINDS = {1: ("u1", 1), 2: ("S1", 1), 3: ("u2", 2), 4: ("u4", 4), 11: ("f4", 4), 12: ("f8", 8)}
NONE, DEFLATE, OLD_DEFLATE = 1, 8, 32946


def tags(data: bytes) -> tuple[str, dict[int, np.ndarray]]:
    """Byte order and the tags of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF of the classic kind")
    (at,) = struct.unpack(order + "I", data[4:8])
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    found = {}
    for i in range(n):
        tag, kind, count, raw = struct.unpack(order + "HHI4s", data[at + 2 + 12 * i : at + 14 + 12 * i])
        if kind in KINDS:
            code, size = KINDS[kind]
            start = struct.unpack(order + "I", raw)[0]
            body = raw[: size * count] if size * count <= 4 else data[start : start + size * count]
            found[tag] = np.frombuffer(body, code if code == "S1" else order + code)
    return order, found


def block(data: bytes, shape: tuple[int, int], kind: np.dtype, compression: int, predictor: int) -> np.ndarray:
    """Numbers of one strip or tile."""
    if compression not in (NONE, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"compression {compression} is not read")
    data = data if compression == NONE else zlib.decompress(data)
    rows, columns = shape
    if predictor == 3:  # bytes of a row by significance, as differences
        parts = np.frombuffer(data, np.uint8).reshape(rows, -1).cumsum(1, dtype=np.uint8).reshape(rows, kind.itemsize, columns)
        return np.ascontiguousarray(parts.transpose(0, 2, 1)).view(kind.newbyteorder(">"))[..., 0]
    z = np.frombuffer(data, kind)[: rows * columns].reshape(rows, columns)
    return z.cumsum(1, dtype=kind.newbyteorder("=")) if predictor == 2 else z


def decode(data: bytes) -> np.ndarray:
    """(rows, columns, 3): x and y of the middle of each cell and its number, rows from south to north; no data is NaN."""
    order, t = tags(data)
    one = lambda tag, other=None: int(t[tag][0]) if tag in t else other
    width, height = one(WIDTH), one(HEIGHT)
    if one(BANDS, 1) != 1:
        raise ValueError("a raster of one band is expected")
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)] + str(one(BITS) // 8))
    tiled = TILES in t
    wide, tall = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    across = -(-width // wide)
    out = np.full((height, width), np.nan)
    for k, (start, size) in enumerate(zip(t[TILES if tiled else STRIPS], t[TILE_BYTES if tiled else STRIP_BYTES], strict=True)):
        top, left = k // across * tall, k % across * wide
        rows = tall if tiled else min(tall, height - top)
        z = block(data[int(start) : int(start) + int(size)], (rows, wide), kind, one(COMPRESSION, NONE), one(PREDICTOR, 1))
        out[top : top + rows, left : left + wide] = z[: height - top, : width - left]
    if NO_DATA in t:
        out[out == float(t[NO_DATA].tobytes().strip(b"\0 "))] = np.nan
    (dx, dy), tie = t[PIXEL_SCALE][:2], t[TIE_POINT]
    x = tie[3] + (np.arange(width) + 0.5 - tie[0]) * dx
    y = tie[4] - (np.arange(height) + 0.5 - tie[1]) * dy
    return np.stack([np.broadcast_to(x, out.shape), np.broadcast_to(y[:, None], out.shape), out], 2)[::-1]


def encode(z: np.ndarray, west: float, south: float, cell: float, no_data: float = -9999.0, rows: int = 16) -> bytes:
    """A deflated little-endian GeoTIFF of numbers given from south to north; NaN becomes no_data."""
    z = np.where(np.isnan(z), no_data, z)[::-1].astype("<f4") if z.dtype.kind == "f" else z[::-1]
    height, width = z.shape
    strips = [zlib.compress(z[i : i + rows].tobytes()) for i in range(0, height, rows)]
    starts = np.cumsum([8] + [len(s) for s in strips])
    entries = {
        WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [z.itemsize * 8]), COMPRESSION: (3, [DEFLATE]), STRIPS: (4, starts[:-1]), BANDS: (3, [1]), STRIP_ROWS: (4, [rows]),
        STRIP_BYTES: (4, [len(s) for s in strips]), FORMAT: (3, [3 if z.dtype.kind == "f" else 1]), PIXEL_SCALE: (12, [cell, cell, 0.0]),
        TIE_POINT: (12, [0.0, 0.0, 0.0, west, south + cell * height, 0.0]), NO_DATA: (2, list(f"{no_data}\0".encode())),
    }
    at, head, tail = int(starts[-1]), b"", b""
    room = at + 2 + 12 * len(entries) + 4
    for tag, (kind, values) in sorted(entries.items()):
        code, size = KINDS[kind]
        body = bytes(values) if kind == 2 else np.array(values, "<" + code).tobytes()
        if len(body) > 4:
            head, tail = head + struct.pack("<HHII", tag, kind, len(values), room + len(tail)), tail + body
        else:
            head += struct.pack("<HHI4s", tag, kind, len(values), body)
    return b"II*\0" + struct.pack("<I", at) + b"".join(strips) + struct.pack("<H", len(entries)) + head + b"\0\0\0\0" + tail
