"""Property bags: ordered lists of typed values by key, in their binary and XML forms.

A bag is array<struct<key, dtype, u, i, f, b, s>> with one value set; order and repeats stay. Strings that aren't UTF-8 have
their bytes in `raw` besides, and a text with U+FFFD for what can't be read.
"""

from __future__ import annotations

import base64
import json
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BAG = "array<struct<key:string,dtype:string,u:bigint,i:int,f:float,b:boolean,s:string,raw:binary>>"
#: Fixed values of the formats: the magic number, type codes, elements and their type attributes.
MAGIC = 0xCBE750E0
CODES = {"UInt": 0xEB61E4F7, "String": 0x0B8BEA18, "Float": 0xABC78708, "Bool": 0xCBA908E1, "Int": 0x0C264712}
ELEMENTS = {"UInt": ("AnyUint32", "0xeb61e4f7"), "String": ("AnyString", "0x0b8bea18"), "Float": ("AnyFloat32", "0xabc78708"), "Bool": ("AnyBoolean", "0xcba908e1"), "Int": ("AnySint32", "0x0c264712")}
ROOTS = ("cGZPropertySetString", "cGZPropertySetUint32")
FIELD = {"UInt": "u", "Int": "i", "Float": "f", "Bool": "b", "String": "s"}

_KIND = {code: k for k, code in CODES.items()}
_PLAIN = {"UInt": "<I", "Int": "<i", "Float": "<f", "Bool": "<B"}
_READ = {k: (struct.Struct(f).unpack_from, struct.calcsize(f)) for k, f in _PLAIN.items()}


def item(key: str, dtype: str, value) -> dict:
    """An entry; a string may be bytes."""
    out = {"key": key, "dtype": dtype, "u": None, "i": None, "f": None, "b": None, "s": None, "raw": None}
    if isinstance(value, bytes):
        text = value.decode("utf-8", "replace")
        out["raw"], value = (None if text.encode() == value else value), text
    out[FIELD[dtype]] = value
    return out


def read_binary(data: bytes) -> list[dict]:
    magic, _, n = struct.unpack_from("<IHI", data)
    if magic != MAGIC:
        raise ValueError("no binary bag")
    at, out = 10, []
    number, end = struct.Struct("<I").unpack_from, len(data)
    for _ in range(n):
        kind, (size,) = _KIND[number(data, at)[0]], number(data, at + 4)
        at += 8 + size
        if at > end:
            raise ValueError("a string ends outside the bag")
        key = data[at - size : at].decode("utf-8", "replace")
        if kind == "String":
            size = number(data, at)[0]
            at += 4 + size
            if at > end:
                raise ValueError("a string ends outside the bag")
            value = data[at - size : at]
        else:
            read_one, width = _READ[kind]
            value = read_one(data, at)[0]
            at += width
        out.append(item(key, kind, value > 0 if kind == "Bool" else value))
    return out


def write_binary(items: list[dict], version: int = 2) -> bytes:
    text = lambda s: struct.pack("<I", len(b := s if isinstance(s, bytes) else s.encode())) + b
    out = [struct.pack("<IHI", MAGIC, version, len(items))]
    for e in items:
        kind, value = e["dtype"], e[FIELD[e["dtype"]]]
        value = e["raw"] if e.get("raw") is not None else value
        out += [struct.pack("<I", CODES[kind]), text(e["key"]), text(value) if kind == "String" else struct.pack(_PLAIN[kind], value)]
    return b"".join(out)


def parse_integer(text: str, bits: int = 32) -> int:
    """Hexadecimal behind 0x or decimal; negative numbers are taken as they wrap."""
    n = int(text, 16) if text.lower().startswith("0x") else int(text)
    if not -(1 << bits - 1) <= n < 1 << bits:
        raise ValueError(f"{text} has more than {bits} bits")
    return n % (1 << bits)


def read_xml(data: str) -> list[dict]:
    """Elements with neither a known name nor a type are left out; name and type have to agree, and a key has to be there."""
    root = ET.fromstring(data)
    if root.tag not in ROOTS:
        raise ValueError(f"unknown root {root.tag}")
    by_tag = {tag: k for k, (tag, _) in ELEMENTS.items()}
    out = []
    for e in root:
        given = e.get("type")
        by_type = None if given is None else _KIND.get(parse_integer(given))
        kind = by_tag.get(e.tag) or by_type
        if kind is None:
            continue
        if by_type is not None and e.tag in by_tag and by_type != by_tag[e.tag]:
            raise ValueError(f"{e.tag} says it is {given}")
        if e.get("key") is None:
            raise ValueError("an element has no key")
        text = e.text or ""
        if kind == "UInt":
            value = parse_integer(text)
        elif kind == "Int":
            value = parse_integer(text)
            value -= (value >> 31) << 32
        elif kind == "Float":
            value = float(text)
        elif kind == "Bool":
            value = {"true": True, "false": False}[text.lower()]
        else:
            value = text
        out.append(item(e.get("key"), kind, value))
    return out


def write_xml(items: list[dict], version: int | None = None) -> str:
    root = ET.Element(ROOTS[0], {} if version is None else {"version": str(version)})
    for e in items:
        if any(c < " " for c in e["key"]):
            raise ValueError("keys can't have control characters")
        tag, code = ELEMENTS[e["dtype"]]
        value = e[FIELD[e["dtype"]]]
        child = ET.SubElement(root, tag, {"key": e["key"], "type": code})
        child.text = value if isinstance(value, str) else str(value)
    return ET.tostring(root, encoding="unicode")


def read(data: bytes) -> list[dict]:
    """Either form: bytes without the binary magic are XML."""
    return read_binary(data) if data[:4] == struct.pack("<I", MAGIC) else read_xml(data.decode())


def _applied(f: Callable, kind: str) -> Callable[[Column], Column]:
    """f over a column in Arrow batches; null where it fails."""

    def tried(x):
        try:
            return None if x is None else f(x)
        except (ValueError, KeyError, struct.error, ET.ParseError, OverflowError):
            return None

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([tried(x) for x in p], dtype=object)

    return run


def from_xml(c: Column) -> Column:
    # an array of structs comes back from Python as JSON text, which keeps order and repeats
    return F.from_json(_applied(lambda x: _json(read_xml(x)), "string")(c), BAG)


def from_bytes(c: Column) -> Column:
    return F.from_json(_applied(lambda x: _json(read(bytes(x))), "string")(c), BAG)


def to_xml(c: Column) -> Column:
    return _applied(lambda x: write_xml(_items(x)), "string")(F.to_json(c))


def to_binary(c: Column) -> Column:
    return _applied(lambda x: write_binary(_items(x)), "binary")(F.to_json(c))


def _json(items: list[dict]) -> str:
    """Values that are there, since null ones needn't be written to be read as null."""
    out = []
    for e in items:
        kind = e["dtype"]
        one = {"key": e["key"], "dtype": kind, FIELD[kind]: e[FIELD[kind]]}
        if e["raw"] is not None:
            one["raw"] = base64.b64encode(e["raw"]).decode()
        out.append(one)
    return json.dumps(out)


def _items(text: str) -> list[dict]:
    """Entries with the value that their type has, and raw; to_json leaves nulls out."""
    items = json.loads(text)
    for e in items:
        e.setdefault(FIELD[e["dtype"]], None)
        e["raw"] = base64.b64decode(e["raw"]) if e.get("raw") else None
    return items
