"""Small payload formats, each read into plain values and written back to the same bytes."""

from __future__ import annotations

import struct
from dataclasses import dataclass

#: Fixed values of the formats.
TEXT_FORMATS = (0xFFF6, 0xFFFD, 0xFFFE, 0xFFFF)
OUTFITS_MAGIC, NAME_SIZE, SIGNATURE = 0xDEADBEEF, 64, 0x8000
TEXTURE, VERSIONED = 0x1C4A276C, 0xFFFF0001
TEXTURE_FORMATS = ("RawARGB32", "RawRGB24", "Alpha", "DXT1", "DXT3", "Grayscale", "AltARGB32", "DXT5", "AltRGB24")
TERMINALS = {"error": (0xFD, 0xFFFC), "true": (0xFE, 0xFFFD), "false": (0xFF, 0xFFFE)}


class Reader:
    """Little-endian values one behind the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the data end too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def one(self, kind: str):
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]

    def many(self, kinds: str) -> tuple:
        return struct.unpack("<" + kinds, self.take(struct.calcsize("<" + kinds)))

    def name(self) -> str:
        return self.take(NAME_SIZE).split(b"\0")[0].decode("utf-8", "replace")

    def c_string(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise ValueError("a string has no end")
        out = self.data[self.at : end].decode("utf-8", "replace")
        self.at = end + 1
        return out

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.take(1)[0]
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    def big_string(self) -> str:
        return self.take(self.varint()).decode("utf-8", "replace")


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def name_bytes(name: str) -> bytes:
    b = name.encode()
    if len(b) > NAME_SIZE:
        raise ValueError("the name is too long")
    return b.ljust(NAME_SIZE, b"\0")


@dataclass
class TextList:
    """strings: (language, value, description); a list without a format tag has neither language nor description."""

    name: str
    version: int | None
    strings: list[tuple[int, str, str]]

    @classmethod
    def read(cls, data: bytes) -> TextList:
        r = Reader(data)
        name, tag = r.name(), struct.unpack_from("<H", data, NAME_SIZE)[0] if len(data) >= NAME_SIZE + 2 else None
        if tag in TEXT_FORMATS:
            r.take(2)
            return cls(name, tag, [(r.one("B"), r.c_string(), r.c_string()) for _ in range(r.one("H"))])
        return cls(name, None, [(1, r.big_string(), "") for _ in range(int.from_bytes(r.take(2), "big"))])

    def write(self) -> bytes:
        out = [name_bytes(self.name)]
        if self.version is None:
            out.append(len(self.strings).to_bytes(2, "big"))
            out += [varint(len(b := v.encode())) + b for _, v, _ in self.strings]
        else:
            out.append(struct.pack("<HH", self.version, len(self.strings)))
            out += [bytes([lang]) + v.encode() + b"\0" + d.encode() + b"\0" for lang, v, d in self.strings]
        return b"".join(out)

    def untagged(self) -> TextList:
        return TextList(self.name, None, [(1, v, "") for _, v, _ in self.strings])


@dataclass
class Constants:
    name: str
    flag: int
    values: list[int]

    @classmethod
    def read(cls, data: bytes) -> Constants:
        r = Reader(data)
        name, n, flag = r.name(), r.one("B"), r.one("B")
        return cls(name, flag, list(r.many(f"{n}H")))

    def write(self) -> bytes:
        return name_bytes(self.name) + struct.pack(f"<BB{len(self.values)}H", len(self.values), self.flag, *self.values)


@dataclass
class Outfits:
    """References to resources: (type, group, instance low, instance high); the last is absent below index 2."""

    minor: int
    keys: list[tuple[int, ...]]

    @classmethod
    def read(cls, data: bytes) -> Outfits:
        r = Reader(data)
        magic, minor, n = r.many("III")
        if magic != OUTFITS_MAGIC:
            raise ValueError("no outfits")
        return cls(minor, [r.many("IIII" if minor == 2 else "III") for _ in range(n)])

    def write(self) -> bytes:
        return struct.pack("<III", OUTFITS_MAGIC, self.minor, len(self.keys)) + b"".join(struct.pack(f"<{len(k)}I", *k) for k in self.keys)


@dataclass
class AudioReference:
    name: str
    target: str

    @classmethod
    def read(cls, data: bytes) -> AudioReference:
        r = Reader(data)
        return cls(r.name(), r.c_string())

    def write(self) -> bytes:
        return name_bytes(self.name) + self.target.encode() + b"\0"


@dataclass
class Target:
    """Where control flow goes: an instruction's number, or one of the ends."""

    instruction: int | None
    end: str | None = None

    @classmethod
    def of(cls, code: int, wide: bool) -> Target:
        found = next((k for k, v in TERMINALS.items() if v[wide] == code), None)
        return cls(None, found) if found else cls(code)

    def code(self, wide: bool) -> int:
        return self.instruction if self.end is None else TERMINALS[self.end][wide]


@dataclass
class Function:
    """instructions: (opcode, true target, false target, node version, operands)."""

    name: str
    signature: int
    head: tuple[int, ...]
    cache_flags: int
    instructions: list[tuple[int, Target, Target, int, bytes]]

    @classmethod
    def read(cls, data: bytes) -> Function:
        r = Reader(data)
        name, signature = r.name(), r.one("H") - SIGNATURE
        if not 0 <= signature <= 9:
            raise ValueError("unknown signature")
        n, *head = r.many("HBBBBi")
        flags = r.one("B") if signature == 9 else 0
        wide, size = signature >= 7, 16 if signature >= 3 else 8
        code = "H" if wide else "B"
        out = []
        for _ in range(n):
            opcode, true, false = r.one("H"), r.one(code), r.one(code)
            version = r.one("B") if signature >= 5 else 0
            out.append((opcode, Target.of(true, wide), Target.of(false, wide), version, r.take(size)))
        return cls(name, signature, tuple(head), flags, out)

    def write(self) -> bytes:
        wide = self.signature >= 7
        code = "<H" if wide else "<B"
        out = [name_bytes(self.name), struct.pack("<HHBBBBi", self.signature + SIGNATURE, len(self.instructions), *self.head)]
        out.append(bytes([self.cache_flags]) if self.signature == 9 else b"")
        for opcode, true, false, version, operands in self.instructions:
            out += [struct.pack("<H", opcode), struct.pack(code, true.code(wide)), struct.pack(code, false.code(wide)), bytes([version]) if self.signature >= 5 else b"", operands]
        return b"".join(out)


def traversal(edges: dict[int, tuple[int | None, int | None]]) -> list[tuple[int, int, int]]:
    """(instruction, x, y) in the order of a depth-first walk from the lowest instruction not yet seen, which stands at 0, 0.

    An instruction is seen once another one leads to it, also before its turn comes. Where both branches lead to unseen ones,
    the true one stands to the right below and waits, and the false one, to the left below, is next; a lone one stands right below.
    """
    unseen, out = set(edges), []
    for begin in sorted(edges):
        if begin not in unseen:
            continue
        unseen.discard(begin)
        waiting = [(begin, 0, 0)]
        while waiting:
            node, x, y = waiting.pop()
            out.append((node, x, y))
            new = []
            for target in edges[node]:
                if target in unseen:
                    unseen.discard(target)
                    new.append(target)
            sides = (1, -1) if len(new) == 2 else (0,)
            waiting += [(target, x + side, y + 1) for target, side in zip(new, sides)]
    return out


def texture_facts(data: bytes) -> tuple[int, int, int, int, int]:
    """(width, height, format code, mip levels, textures) of a collection's first entry, which has to be a texture; pixels aren't read.

    The levels are those of the first texture, which has a count of its own from block version 9 on.
    """
    r = Reader(data)
    first = r.one("I")
    versioned = first == VERSIONED
    links = r.one("I") if versioned else first
    r.take(links * (16 if versioned else 12))
    n = r.one("I")
    r.take(4 * n)
    if not n:
        raise ValueError("the collection is empty")
    r.big_string()
    kind, block = r.many("II")
    if kind != TEXTURE:
        raise ValueError("the first entry is no texture")
    if r.big_string() != "cSGResource" or r.many("II") != (0, 2):
        raise ValueError("a file name is missing")
    r.big_string()
    width, height, code, levels, _, textures, _ = r.many("IIIIfII")
    if not 1 <= code <= len(TEXTURE_FORMATS):
        raise ValueError("unknown texture format")
    if block == 9:
        r.big_string()
        levels = r.one("I") if textures else 0
    return width, height, code, levels, textures
