"""What a TIFF file holds: its directory, and the coding of one tile."""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

#: Numbers of the tags, of the compressions, and of the sample formats; sizes and codes of field types.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, GEO_KEYS, METADATA, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42112, 42113
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
KINDS = {1: "u", 2: "i", 3: "f"}
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "Q", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
CLEAR, END, FIRST, LAST = 256, 257, 258, 4094
COMPRESSIONS = {"none": NONE, "lzw": LZW, "deflate": DEFLATE}


@dataclass
class Image:
    """Size, coding, place and tiles of a raster file. A strip is a tile as wide as the image."""

    n_rows: int
    n_cols: int
    tile_rows: int
    tile_cols: int
    layers: int
    dtype: np.dtype
    compression: int
    predictor: int
    planar: bool
    left: float = 0.0
    top: float = 0.0
    dx: float = 1.0
    dy: float = 1.0
    srid: int = 0
    nodata: float | None = None
    names: list[str] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)

    @property
    def tiles_across(self) -> int:
        return -(-self.n_cols // self.tile_cols)

    @property
    def tiles_down(self) -> int:
        return -(-self.n_rows // self.tile_rows)


def directory(file) -> Image:
    """Read the first directory of an open file; nothing but header and directory is read."""
    head = file.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise ValueError("not a TIFF file")
    (magic,) = struct.unpack(f"{order}H", head[2:4])
    big = magic == 43
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(f"{order}Q", head[8:16]) if big else struct.unpack(f"{order}I", head[4:8])
    count, entry, word = ("Q", "HHQ", "Q") if big else ("H", "HHI", "I")
    file.seek(at)
    (n,) = struct.unpack(f"{order}{count}", file.read(struct.calcsize(f"<{count}")))
    width = struct.calcsize(f"<{entry}") + struct.calcsize(f"<{word}")
    raw = file.read(n * width)
    tags: dict[int, tuple] = {}
    for i in range(n):
        one = raw[i * width : (i + 1) * width]
        tag, kind, many = struct.unpack(f"{order}{entry}", one[: struct.calcsize(f"<{entry}")])
        if kind not in FIELDS:
            continue
        shape = f"{order}{many}{FIELDS[kind]}"
        held = one[struct.calcsize(f"<{entry}") :]
        if (size := struct.calcsize(shape)) > len(held):
            file.seek(struct.unpack(f"{order}{word}", held)[0])
            held = file.read(size)
        tags[tag] = struct.unpack(shape, held[:size])
    return _image(tags, order)


def _image(tags: dict[int, tuple], order: str) -> Image:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    n_rows, n_cols, layers = one(LENGTH), one(WIDTH), one(SAMPLES, 1)
    if one(COMPRESSION, NONE) not in (NONE, LZW, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"compression {one(COMPRESSION)} is not supported")
    if len(set(tags.get(BITS, (1,)))) > 1 or one(BITS, 1) % 8:
        raise ValueError("samples must be whole bytes of one size")
    kind = KINDS.get(one(FORMAT, 1), "u")
    tiled = TILES in tags
    image = Image(
        n_rows,
        n_cols,
        one(TILE_LENGTH) if tiled else min(one(ROWS_PER_STRIP, n_rows), n_rows),
        one(TILE_WIDTH) if tiled else n_cols,
        layers,
        np.dtype(f"{order}{kind}{one(BITS) // 8}"),
        one(COMPRESSION, NONE),
        one(PREDICTOR, 1),
        one(PLANAR, 1) == 2,
        offsets=list(tags[TILES if tiled else STRIPS]),
        sizes=list(tags[TILE_BYTES if tiled else STRIP_BYTES]),
    )
    if SCALE in tags and TIEPOINT in tags:
        image.dx, image.dy = tags[SCALE][:2]
        col, row, _, x, y = tags[TIEPOINT][:5]
        image.left, image.top = x - col * image.dx, y + row * image.dy
    keys = tags.get(GEO_KEYS, ())
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    image.srid = found.get(3072, found.get(2048, 0))
    text = lambda tag: b"".join(tags.get(tag, ())).split(b"\0")[0].decode("utf-8", "replace").strip()
    if text(NODATA):
        image.nodata = float(text(NODATA))
    named = dict(re.findall(r'<Item name="DESCRIPTION" sample="(\d+)" role="description">([^<]*)</Item>', text(METADATA)))
    image.names = [named.get(str(i), f"b{i + 1}") for i in range(layers)]
    return image


def decoded(image: Image, data: bytes) -> np.ndarray:
    """One tile as (rows, columns, samples); a separate plane has one sample."""
    if image.compression == LZW:
        data = lzw_decoded(data)
    elif image.compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    samples, dtype = 1 if image.planar else image.layers, image.dtype
    line = image.tile_cols * samples * dtype.itemsize
    rows = min(image.tile_rows, len(data) // line)  # the last strip may be shorter
    if image.predictor == 3:  # bytes of all samples of a row, the most significant first, as differences
        planes = np.frombuffer(data, "u1", rows * line).reshape(rows, line // samples, samples).cumsum(axis=1, dtype="u1")
        planes = planes.reshape(rows, dtype.itemsize, image.tile_cols * samples)
        return planes.transpose(0, 2, 1).copy().view(dtype.newbyteorder(">")).reshape(rows, image.tile_cols, samples)
    values = np.frombuffer(data, dtype, rows * image.tile_cols * samples).reshape(rows, image.tile_cols, samples)
    if image.predictor == 2:
        whole = np.dtype(f"u{dtype.itemsize}")
        return values.view(whole.newbyteorder(dtype.byteorder)).astype(whole).cumsum(axis=1, dtype=whole).view(dtype.newbyteorder("="))
    return values


def encoded(values: np.ndarray, compression: int, predictor: int) -> bytes:
    """One plane of a tile (rows, columns), little-endian."""
    values = np.ascontiguousarray(values, values.dtype.newbyteorder("<"))
    if predictor == 3:
        size = values.dtype.itemsize
        planes = values.byteswap().view("u1").reshape(*values.shape, size).transpose(0, 2, 1).reshape(len(values), -1)
        data = np.diff(planes, axis=1, prepend=np.zeros((len(values), 1), "u1")).tobytes()
    elif predictor == 2:
        whole = values.view(f"<u{values.dtype.itemsize}")
        data = np.diff(whole, axis=1, prepend=np.zeros((len(whole), 1), whole.dtype)).tobytes()
    else:
        data = values.tobytes()
    return lzw_encoded(data) if compression == LZW else zlib.compress(data, 6) if compression == DEFLATE else data


def lzw_decoded(data: bytes) -> bytes:
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, before, width, held, bits = [], b"", 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == END:
            break
        if code == CLEAR:
            del table[FIRST:]
            before, width = b"", 9
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + entry[:1])
        out.append(entry)
        before = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def lzw_encoded(data: bytes) -> bytes:
    single = {bytes([i]): i for i in range(256)}
    table, free, width, held, bits, out = dict(single), FIRST, 9, CLEAR, 9, bytearray()
    before = b""
    for i in range(len(data)):
        longer = before + data[i : i + 1]
        if longer in table:
            before = longer
            continue
        held, bits = held << width | table[before], bits + width
        table[longer] = free
        free += 1
        if free == LAST:
            held, bits = held << width | CLEAR, bits + width
            table, free, width = dict(single), FIRST, 9
        elif free == 1 << width:
            width += 1
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1
        before = data[i : i + 1]
    if before:
        held, bits = held << width | table[before], bits + width
        if free + 1 == 1 << width and width < 12:
            width += 1
    held, bits = held << width | END, bits + width
    pad = -bits % 8
    return bytes(out) + (held << pad).to_bytes((bits + pad) // 8, "big")


def written(image: Image, tiles: list[bytes]) -> bytes:
    """A whole file: header, tiles (plane after plane), directory with its place on the ground."""
    at, offsets = 8, []
    for t in tiles:
        offsets.append(at)
        at += len(t)
    geographic = image.srid == 4326
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, image.srid)
    names = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{n}</Item>' for i, n in enumerate(image.names))
    kind = next(k for k, v in KINDS.items() if v == image.dtype.kind)
    fields = {
        WIDTH: ("I", (image.n_cols,)),
        LENGTH: ("I", (image.n_rows,)),
        BITS: ("H", (image.dtype.itemsize * 8,) * image.layers),
        COMPRESSION: ("H", (image.compression,)),
        PHOTOMETRIC: ("H", (1,)),
        SAMPLES: ("H", (image.layers,)),
        PLANAR: ("H", (2,)),
        PREDICTOR: ("H", (image.predictor,)),
        TILE_WIDTH: ("I", (image.tile_cols,)),
        TILE_LENGTH: ("I", (image.tile_rows,)),
        TILES: ("I", tuple(offsets)),
        TILE_BYTES: ("I", tuple(map(len, tiles))),
        FORMAT: ("H", (kind,) * image.layers),
        SCALE: ("d", (image.dx, image.dy, 0.0)),
        TIEPOINT: ("d", (0.0, 0.0, 0.0, image.left, image.top, 0.0)),
        METADATA: ("s", f"<GDALMetadata>{names}</GDALMetadata>\0".encode()),
    }
    if image.srid:
        fields[GEO_KEYS] = ("H", keys)
    if image.nodata is not None:
        fields[NODATA] = ("s", f"{image.nodata!r}\0".encode())
    codes = {"s": 2, "H": 3, "I": 4, "d": 12}
    entries, rest, free = [], b"", at + 2 + 12 * len(fields) + 4
    for tag in sorted(fields):
        shape, values = fields[tag]
        held = values if shape == "s" else struct.pack(f"<{len(values)}{shape}", *values)
        n = len(values)
        if len(held) > 4:
            entries.append(struct.pack("<HHII", tag, codes[shape], n, free + len(rest)))
            rest += held + b"\0" * (len(held) % 2)
        else:
            entries.append(struct.pack("<HHI", tag, codes[shape], n) + held.ljust(4, b"\0"))
    return struct.pack("<2sHI", b"II", 42, at) + b"".join(tiles) + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0" + rest
