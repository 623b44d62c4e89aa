"""Resource compression: raw, zlib and RefPack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.sources.layout import DELETED, RAW, REFPACK, ZLIB


def refpack_body(data: bytes, size: int) -> tuple[int, int]:
    """Where the commands begin and the unpacked size: behind a stored size or not, and with sizes of three or four bytes."""
    for at in (4, 0):
        if len(data) > at + 4 and data[at + 1] == 0xFB and data[at] & 0x3E == 0x10:
            width = 4 if data[at] & 0x80 else 3
            own = int.from_bytes(data[at + 2 : at + 2 + width], "big")
            if at == 0 or not size or own == size:
                # a set low bit announces a packed size in front of the unpacked one
                skip = width if data[at] & 0x01 else 0
                return at + 2 + width + skip, int.from_bytes(data[at + 2 + skip : at + 2 + skip + width], "big")
    raise ValueError("no RefPack header")


def refpack_unpack(data: bytes, size: int = 0) -> bytes:
    """Unpack a stream of commands, each of which copies bytes of the stream and then some from what is unpacked."""
    at, size = refpack_body(data, size)
    out = bytearray()
    while at < len(data):
        first = data[at]
        if first < 0x80:
            plain, n, back, at = first & 3, (first >> 2 & 7) + 3, ((first & 0x60) << 3) + data[at + 1] + 1, at + 2
        elif first < 0xC0:
            plain, n, back, at = data[at + 1] >> 6, (first & 0x3F) + 4, ((data[at + 1] & 0x3F) << 8) + data[at + 2] + 1, at + 3
        elif first < 0xE0:
            plain, n, back, at = first & 3, ((first & 0x0C) << 6) + data[at + 3] + 5, ((first & 0x10) << 12) + (data[at + 1] << 8) + data[at + 2] + 1, at + 4
        elif first < 0xFC:
            plain, n, back, at = ((first & 0x1F) << 2) + 4, 0, 0, at + 1
        else:
            plain, n, back, at = first & 3, 0, 0, at + 1
        out += data[at : at + plain]
        at += plain
        if n:
            if back > len(out):
                raise ValueError("a copy begins before the data")
            start = len(out) - back
            piece = out[start : start + n]
            out += (piece * (n // len(piece) + 1))[:n] if len(piece) < n else piece
        if first >= 0xFC:
            break
    if len(out) != size:
        raise ValueError("the unpacked size is not the stated one")
    return bytes(out)


#: Bytes of a match that are compared for all places of the data at once; longer ones go on by slices.
TOGETHER = 24


def matches(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each place, how far back the last earlier one is where the same bytes begin, and for how many, TOGETHER at most; 0 where no copy is worth its command.

    Places of equal three bytes stand side by side once they are sorted.
    """
    size = len(data)
    b = np.frombuffer(data, np.uint8)
    wide = b.astype(np.int32)
    keys = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    at, before = order[1:][same], order[:-1][same]
    back, length = np.zeros(size, np.int64), np.zeros(size, np.int64)
    back[at], length[at] = at - before, 3
    near = at[back[at] <= 131072]
    for n in range(3, TOGETHER):
        near = near[near + n < size]
        near = near[b[near + n] == b[near + n - back[near]]]
        if not len(near):
            break
        length[near] = n + 1
    poor = (back > 131072) | ((length < 4) & (back > 1024)) | ((length < 5) & (back > 16384))
    length[poor] = 0
    return back, length


def refpack_pack(data: bytes) -> bytes:
    """Pack greedily with the latest earlier place of each three bytes; behind a size and the usual header."""
    size = len(data)
    if size >= 1 << 24:
        raise ValueError("too long for this header")
    out = bytearray()
    back_of, length_of = matches(data) if size > 2 else (np.zeros(size, np.int64), np.zeros(size, np.int64))
    # from each place on the next where a copy may begin
    following = np.minimum.accumulate(np.where(length_of > 0, np.arange(size), size)[::-1])[::-1].tolist() + [size]
    backs, lengths = back_of.tolist(), length_of.tolist()
    plain = 0

    def literals(end: int) -> int:
        """Write whole groups of four bytes up to `end`; what is left goes with the next command."""
        nonlocal plain
        while end - plain > 3:
            n = min(112, (end - plain) // 4 * 4)
            out.append(0xE0 + (n >> 2) - 1)
            out.extend(data[plain : plain + n])
            plain += n
        return end - plain

    while (at := following[plain]) < size:
        back, n = backs[at], lengths[at]
        if n == TOGETHER:
            most = min(1028, size - at)
            while n < most and data[at + n : at + n + 16] == data[at + n - back : at + n + 16 - back]:
                n = min(most, n + 16)
            while n < most and data[at + n] == data[at + n - back]:
                n += 1
        k, d = literals(at), back - 1
        if back <= 1024 and n <= 10:
            out += bytes(((d >> 3 & 0x60) | (n - 3) << 2 | k, d & 255))
        elif back <= 16384 and n <= 67:
            out += bytes((0x80 | n - 4, k << 6 | d >> 8, d & 255))
        else:
            out += bytes((0xC0 | (d >> 12 & 0x10) | (n - 5 >> 6 & 0x0C) | k, d >> 8 & 255, d & 255, n - 5 & 255))
        out += data[plain:at]
        plain = at + n
    k = literals(size)
    out.append(0xFC | k)
    out += data[plain:]
    return (len(out) + 9).to_bytes(4, "little") + b"\x10\xfb" + size.to_bytes(3, "big") + bytes(out)


def unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression in (RAW, DELETED):
        return data
    if compression == REFPACK:
        return refpack_unpack(data, size)
    if compression == ZLIB:
        z = zlib.decompressobj()
        return z.decompress(data, size) if size else b""
    raise ValueError(f"compression {compression:#x} can't be unpacked")


def pack(data: bytes, compression: int) -> bytes:
    if compression == RAW:
        return data
    if compression == REFPACK:
        return refpack_pack(data)
    if compression == ZLIB:
        return zlib.compress(data, 9)
    raise ValueError(f"compression {compression:#x} can't be packed")


def unpacked(data: Column, compression: Column, size: Column) -> Column:
    """Payloads unpacked in Arrow batches; null where that fails."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for d, c, s in parts:
            yield pd.Series([_tried(unpack, x, int(y), int(z)) for x, y, z in zip(d, c, s)], dtype=object)

    return run(data, compression, size)


def packed(data: Column, compression: Column) -> Column:
    """Payloads packed in Arrow batches; null where that fails."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for d, c in parts:
            yield pd.Series([_tried(pack, x, int(y)) for x, y in zip(d, c)], dtype=object)

    return run(data, compression)


def _tried(f, data, *rest):
    try:
        return None if data is None else f(bytes(data), *rest)
    except (ValueError, IndexError, zlib.error):
        return None
