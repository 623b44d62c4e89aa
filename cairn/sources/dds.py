"""DDS images: a texture's mip levels in the common container, the largest level first."""

from __future__ import annotations

import struct

#: Fixed values of the container: flags of headers and pixel formats, and channel masks by texture format.
MAGIC, HEADER = b"DDS ", "<7I44x8I5I"
FLAGS, MIP_FLAGS, PIXEL_FOURCC, PIXEL_RGB, PIXEL_ALPHA, PIXEL_GRAY = 0x1007, 0x20000, 0x4, 0x40, 0x1, 0x20000
FOUR_CC = {"DXT1": b"DXT1", "DXT3": b"DXT3", "DXT5": b"DXT5"}
PLAIN = {
    "RawARGB32": (PIXEL_RGB | PIXEL_ALPHA, 32, 0xFF0000, 0xFF00, 0xFF, 0xFF000000),
    "RawRGB24": (PIXEL_RGB, 24, 0xFF0000, 0xFF00, 0xFF, 0),
    "Grayscale": (PIXEL_GRAY, 8, 0xFF, 0, 0, 0),
    "Alpha": (0x2, 8, 0, 0, 0, 0xFF),
}
SAME = {"AltARGB32": "RawARGB32", "AltRGB24": "RawRGB24"}


def level_bytes(name: str, width: int, height: int) -> int:
    if name in FOUR_CC:
        return -(-width // 4) * -(-height // 4) * (8 if name == "DXT1" else 16)
    return width * height * PLAIN[SAME.get(name, name)][1] // 8


def write(name: str, width: int, height: int, levels: list[bytes]) -> bytes:
    """levels: the smallest first, as textures hold them."""
    for i, level in enumerate(reversed(levels)):
        if len(level) != level_bytes(name, max(1, width >> i), max(1, height >> i)):
            raise ValueError("a level has another size than its format takes")
    pixel = (32, PIXEL_FOURCC, int.from_bytes(FOUR_CC[name], "little"), 0, 0, 0, 0, 0) if name in FOUR_CC else (32, PLAIN[SAME.get(name, name)][0], 0, *PLAIN[SAME.get(name, name)][1:])
    many = len(levels) > 1
    head = struct.pack(HEADER, 124, FLAGS | MIP_FLAGS * many, height, width, 0, 0, len(levels), *pixel, 0x1000 | 0x400008 * many, 0, 0, 0, 0)
    return MAGIC + head + b"".join(reversed(levels))


def read(data: bytes) -> tuple[str, int, int, list[bytes]]:
    """Format, width, height and levels, the smallest first; formats without a counterpart are an error."""
    if data[:4] != MAGIC or len(data) < 128:
        raise ValueError("no DDS image")
    size, _, height, width, _, _, levels, _, kind, four, bits, *masks = struct.unpack_from(HEADER, data, 4)[:16]
    if size != 124:
        raise ValueError("the header has another size")
    if kind & PIXEL_FOURCC:
        name = next((n for n, c in FOUR_CC.items() if int.from_bytes(c, "little") == four), None)
    else:
        name = next((n for n, p in PLAIN.items() if p == (kind, bits, *masks[:4])), None)
    if name is None:
        raise ValueError("the pixel format has no counterpart")
    at, out = 128, []
    for i in range(max(1, levels)):
        n = level_bytes(name, max(1, width >> i), max(1, height >> i))
        if at + n > len(data):
            raise ValueError("the data end too early")
        out.insert(0, data[at : at + n])
        at += n
    return name, width, height, out
