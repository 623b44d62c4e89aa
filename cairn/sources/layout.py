"""The package format: header, index, directory and free space, from bytes and to bytes."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format.
MAGIC, HEADER_SIZE = b"DBPF", 0x60
VERSIONS = frozenset({(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0)})
DIRECTORY = 0xE86B1EEF
DIRECTORY_KEY = (DIRECTORY, 0xE86B1EEF, 0, 0x286B1F03)
RAW, STREAMABLE, REFPACK, DELETED, ZLIB = 0x0000, 0xFFFE, 0xFFFF, 0xFFE0, 0x5A42

HEADER = np.dtype([(n, "<u4") for n in ("magic", "version_major", "version_minor", "user_major", "user_minor", "flags", "created", "modified", "index_version", "n_entries", "index_location", "index_size", "n_holes", "hole_location", "hole_size", "index_minor")] + [("index_offset", "<u8"), ("rest", "V24")])
HOLE = np.dtype([("location", "<u4"), ("size", "<u4")])
COLUMNS = ("type_id", "group_id", "instance_hi", "instance_lo", "location", "stored_size", "compression", "decompressed_size")


class BadPackage(ValueError):
    """Bytes that are no package, or a broken one."""


@dataclass
class Package:
    header: dict[str, int]
    holes: np.ndarray
    #: By column, an array with a value for each resource in index order.
    index: dict[str, np.ndarray] = field(default_factory=dict)


class Ranges:
    """A file's bytes by place and length, read when they are asked for."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        self.file.seek(min(part.start or 0, self.size))
        return self.file.read(max(0, min(part.stop, self.size) - (part.start or 0)))


def _array(data: bytes | Ranges, kind: np.dtype, n: int, at: int) -> np.ndarray:
    if n and (at < 0 or at + n * kind.itemsize > len(data)):
        raise BadPackage("a table lies outside the file")
    return np.frombuffer(data[at : at + n * kind.itemsize], kind, n) if n else np.zeros(0, kind)


def read(data: bytes | Ranges) -> Package:
    """A package's header, holes and index, with the directory joined to it and taken out. Payloads aren't read."""
    first = data[:HEADER_SIZE]
    if len(first) < HEADER_SIZE or first[:4] != MAGIC:
        raise BadPackage("no package")
    head = {k: int(v) for k, v in zip(HEADER.names, np.frombuffer(first, HEADER, 1)[0]) if k not in ("magic", "rest")}
    version = head["version_major"], head["version_minor"]
    if version not in VERSIONS or head["index_version"] not in (0, 7) or head["index_minor"] > 3:
        raise BadPackage(f"version {version} with index {head['index_version']}.{head['index_minor']} is unknown")
    holes = _array(data, HOLE, head["n_holes"], head["hole_location"])
    index = _index_1(data, head) if head["version_major"] == 1 else _index_2(data, head)
    return Package(head, holes, index)


def _keys(long: bool) -> list[tuple[str, str]]:
    return [(n, "<u4") for n in ("type_id", "group_id", "instance_lo")] + [("instance_hi", "<u4")] * long


def _index_1(data: bytes | Ranges, head: dict[str, int]) -> dict[str, np.ndarray]:
    keys = _keys(head["index_minor"] == 2)
    rows = _array(data, np.dtype([*keys, ("location", "<u4"), ("stored_size", "<u4")]), head["n_entries"], head["index_location"])
    if (rows["location"] == 0).any():
        raise BadPackage("a resource lies at 0")
    out = {n: rows[n].astype(np.int64) if n in rows.dtype.names else np.zeros(len(rows), np.int64) for n in COLUMNS[:6]}
    names = [n for n, _ in keys]
    sizes: dict[tuple, int] = {}
    listed = np.dtype([*keys, ("size", "<u4")])
    for i in np.flatnonzero(out["type_id"] == DIRECTORY):
        at, size = int(out["location"][i]), int(out["stored_size"][i])
        if size % listed.itemsize:
            raise BadPackage("a directory ends within an entry")
        for r in _array(data, listed, size // listed.itemsize, at).tolist():
            sizes[r[:-1]] = r[-1]
    found = [sizes.get(k) for k in zip(*(rows[n].tolist() for n in names))]
    out["compression"] = np.array([RAW if s is None else REFPACK for s in found], np.int64)
    out["decompressed_size"] = np.array([n if s is None else s for s, n in zip(found, out["stored_size"].tolist())], np.int64)
    keep = out["type_id"] != DIRECTORY
    return {k: v[keep] for k, v in out.items()}


def _index_2(data: bytes | Ranges, head: dict[str, int]) -> dict[str, np.ndarray]:
    at = head["index_offset"]
    flags = int(_array(data, np.dtype("<u4"), 1, at)[0])
    fixed, at = {}, at + 4
    for i, name in enumerate(("type_id", "group_id", "instance_hi")):
        if flags >> i & 1:
            fixed[name], at = int(_array(data, np.dtype("<u4"), 1, at)[0]), at + 4
    free = [n for n in ("type_id", "group_id", "instance_hi", "instance_lo") if n not in fixed]
    plain = np.dtype([*((n, "<u4") for n in free), ("location", "<u4"), ("stored_size", "<u4"), ("decompressed_size", "<u4")])
    table, at, parts = data[at : at + head["n_entries"] * (plain.itemsize + 4)], 0, []
    left = head["n_entries"]
    while left:
        if at + plain.itemsize > len(table):
            raise BadPackage("the index lies outside the file")
        # entries have one length up to one that says how it is packed, which two more fields do
        run = np.frombuffer(table, plain, min(left, (len(table) - at) // plain.itemsize), at)
        packed = np.flatnonzero(run["stored_size"] >> 31)[:1]
        run = run[: packed[0] + 1] if len(packed) else run
        at += run.nbytes
        compression = np.full(len(run), RAW, np.int64)
        if len(packed):
            if at + 4 > len(table):
                raise BadPackage("the index lies outside the file")
            compression[-1], at = struct.unpack_from("<H", table, at)[0], at + 4
        left -= len(run)
        parts.append({n: run[n].astype(np.int64) for n in plain.names} | {"compression": compression})
    out = {n: np.concatenate([p[n] for p in parts] or [np.zeros(0, np.int64)]) if n not in fixed else np.full(head["n_entries"], fixed[n], np.int64) for n in COLUMNS}
    out["stored_size"] &= 0x7FFFFFFF
    return out


def write(header: dict[str, int], resources: list[dict]) -> bytes:
    """A version 1 package. resources: dicts of the key columns, `data` as stored, `compression` and `decompressed_size`.

    The index is followed by a directory, if a resource is RefPack, and the resources without gaps; free space isn't kept.
    """
    minor = header.get("index_minor", 2)
    if header.get("version_major", 1) != 1 or minor > 2:
        raise ValueError("only version 1 with index 0 to 2 can be written")
    if any(r["compression"] not in (RAW, REFPACK) for r in resources):
        raise ValueError("version 1 has no other compression than RefPack")
    long = minor == 2
    key = lambda r: (r["type_id"], r["group_id"], r["instance_lo"]) + ((r["instance_hi"],) if long else ())
    packed = [r for r in resources if r["compression"] == REFPACK]
    listing = b"".join(struct.pack(f"<{4 + long}I", *key(r), r["decompressed_size"]) for r in packed)
    rows = [(DIRECTORY_KEY[0], DIRECTORY_KEY[1], DIRECTORY_KEY[3], *([DIRECTORY_KEY[2]] if long else []), listing)] if packed else []
    rows += [(*key(r), r["data"]) for r in resources]
    at = HEADER_SIZE + len(rows) * (24 if long else 20)
    index, body, size = [], [], len(rows) * (24 if long else 20)
    for *k, payload in rows:
        index.append(struct.pack(f"<{5 + long}I", *k, at, len(payload)))
        body.append(payload)
        at += len(payload)
    names = ("version_major", "version_minor", "user_major", "user_minor", "flags", "created", "modified")
    first = [header.get(n, 1 if n in ("version_major", "version_minor") else 0) for n in names]
    head = MAGIC + struct.pack("<15IQ24x", *first, header.get("index_version", 7), len(rows), HEADER_SIZE, size, 0, 0, 0, minor, 0)
    return b"".join([head, *index, *body])
