"""Scalar functions over columns; all stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4294967296


# text


def hex_of(c: Column, digits: int = 0) -> Column:
    """Upper-case hexadecimal, filled with zeros to a number of digits; longer numbers keep all of theirs."""
    h = F.hex(c)
    return F.when(F.length(h) >= digits, h).otherwise(F.lpad(h, digits, "0")) if digits else h


def parse_hex(s: Column) -> Column:
    """A number behind any count of 0x; null for anything else."""
    digits = F.regexp_replace(s, "^(0x)+", "")
    return F.when(digits.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(digits, 16, 10).cast("long"))


def parse_u8(s: Column) -> Column:
    n = s.try_cast("int")
    return F.when(s.rlike(r"^\+?[0-9]+$") & n.between(0, 255), n)


def parse_u32(s: Column) -> Column:
    """Hexadecimal behind 0x, else decimal; negative numbers of 32 bits wrap."""
    n = F.when(s.startswith("0x"), parse_hex(s)).otherwise(s.try_cast("long"))
    return F.when((n >= 0) & (n < U32), n).when((n < 0) & (n >= -2147483648), n + U32)


def parse_bool(s: Column) -> Column:
    return F.when(F.lower(s) == "true", True).when(F.lower(s) == "false", False)


def bool_text(b: Column) -> Column:
    return F.when(b, "True").when(~b, "False")


def lossy_utf8(b: Column) -> Column:
    return F.make_valid_utf8(b.cast("string"))


def strict_utf8(b: Column) -> Column:
    return F.try_validate_utf8(b.cast("string"))


def cut_at_nul(s: Column) -> Column:
    return F.substring_index(s, "\0", 1)


def starts_with_control(s: Column) -> Column:
    return s.rlike(r"^[\x00-\x1F]")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name up to its last dot; a dot in front begins a name."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def resource_name(type_id: Column, group: Column, high: Column, low: Column, ext: Column) -> Column:
    """type-instance high-group-instance low, each with eight hexadecimal digits, and the extension."""
    return F.concat(F.concat_ws("-", *(hex_of(c, 8) for c in (type_id, high, group, low))), F.lit("."), ext)


def human_size(n: Column, decimals: int = 2) -> Column:
    """Bytes in decimal units, halves rounded up; whole numbers all the way, so that no binary fraction decides."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    scale = 10**decimals
    for power, unit in ((1, "kB"), (2, "MB"), (3, "GB"), (4, "TB")):
        size = 1000**power
        scaled = F.floor((n.cast("decimal(20,0)") * scale + size // 2) / F.lit(size).cast("decimal(20,0)")).cast("long")
        shown = F.concat(F.floor(scaled / scale).cast("string"), F.lit("."), F.lpad((scaled % scale).cast("string"), decimals, "0"), F.lit(f" {unit}"))
        out = F.when(n >= size, shown).otherwise(out)
    return out


def hex_dump(b: Column, per_row: int = 16) -> Column:
    """Rows of bytes: the place of the first, hexadecimal digits by two bytes, and characters, with the pictures of those that control and U+FFFD beyond ASCII."""
    starts = F.when(F.length(b) > 0, F.sequence(F.lit(0), F.length(b) - 1, F.lit(per_row))).otherwise(F.array().cast("array<int>"))
    row = lambda i: b.substr(i + 1, F.lit(per_row))
    pairs = lambda i: F.regexp_replace(F.lower(F.hex(row(i))), "(.{1,4})", "$1 ")
    control = "".join(map(chr, [*range(32), 127]))
    pictures = "".join(map(chr, [*range(0x2400, 0x2420), 0x2421]))
    shown = lambda i: F.regexp_replace(F.translate(F.decode(row(i), "ISO-8859-1"), control, pictures), r"[\x80-\xFF]", "\ufffd")
    place = lambda i: F.concat(F.lit("0x"), F.when(i < 65536, F.lpad(F.lower(F.hex(i)), 4, "0")).otherwise(F.lower(F.hex(i))), F.lit(":     "))
    return F.array_join(F.transform(starts, lambda i: F.concat(place(i), F.rpad(pairs(i), per_row * 5 // 2, " "), shown(i))), "\n")


# dates


def epoch_time(n: Column) -> Column:
    return F.timestamp_seconds(n)


def time_text(t: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss with four digits of the year or as many as it has, without a plus in front of longer ones; before the year 0 a minus and no zeros."""
    year = F.year(t)
    digits = year.cast("string")
    return F.concat(F.when(year.between(0, 9999), F.lpad(digits, 4, "0")).otherwise(digits), F.date_format(t, "-MM-dd HH:mm:ss"))


def epoch_of_day(t: Column) -> Column:
    """Seconds to the day's beginning; null if they don't fit in 32 bits without a sign."""
    n = F.unix_timestamp(F.date_trunc("DAY", t))
    return F.when((n >= 0) & (n < U32), n)


# bits


def compose_u64(high: Column, low: Column) -> Column:
    """high and low halves as one decimal number, since Spark has no unsigned 64-bit one."""
    return (high.cast("decimal(20,0)") * F.lit(U32) + low).cast("decimal(20,0)")


def split_u64(n: Column) -> tuple[Column, Column]:
    """The halves of a decimal number."""
    d = n.cast("decimal(20,0)")
    high = F.floor(d / F.lit(U32).cast("decimal(20,0)")).cast("long")
    return high, (d - high.cast("decimal(20,0)") * F.lit(U32)).cast("long")


def bit(n: Column, i: int) -> Column:
    return F.bit_get(n, F.lit(i)) == 1


def with_bit(n: Column, i: int, on: Column) -> Column:
    mask = F.lit(1 << i)
    return F.when(on, n.bitwiseOR(mask)).otherwise(n.bitwiseAND(F.bitwise_not(mask)))


def flags(n: Column, names: list[str]) -> Column:
    """A struct of booleans, the lowest bit first."""
    return F.struct(*(bit(n, i).alias(name) for i, name in enumerate(names)))


def pack_flags(struct: Column, names: list[str]) -> Column:
    out = F.lit(0).cast("long")
    for i, name in enumerate(names):
        out = out + F.when(struct[name], F.lit(1 << i)).otherwise(0)
    return out


def varint_length(n: Column) -> Column:
    """Bytes of a number in groups of seven bits."""
    out = F.lit(10)
    for k in range(8, 0, -1):
        out = F.when(n < 1 << (7 * k), k).otherwise(out)
    return out


# vectors


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def negate(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def gather(a: Column, indices: Column) -> Column:
    return F.transform(indices, lambda i: F.element_at(a, i + 1))


def interleave(*arrays: Column) -> Column:
    """Elements in turn, as far as the shortest goes."""
    n = F.least(*(F.size(a) for a in arrays)) if len(arrays) > 1 else F.size(arrays[0])
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(at, lambda i: F.array(*(F.element_at(a, i) for a in arrays))))


def chunks(a: Column, n: int) -> Column:
    """Whole groups of n elements; a rest is dropped."""
    count = F.floor(F.size(a) / n).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.slice(a, i * n + 1, n))


def padded(a: Column, n: int, value: float = 0.0) -> Column:
    return F.concat(a, F.array_repeat(F.lit(value).cast("float"), F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def quaternion_inverse(q: Column) -> Column:
    """x, y, z, w: the conjugate over the squared norm."""
    norm = q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + q["w"] * q["w"]
    return F.struct((-q["x"] / norm).alias("x"), (-q["y"] / norm).alias("y"), (-q["z"] / norm).alias("z"), (q["w"] / norm).alias("w"))


def matrix_product(a: Column, b: Column, n: int = 4) -> Column:
    """Row-major n by n matrices."""
    at = F.array(*(F.lit(i) for i in range(n)))
    rows = F.transform(at, lambda r: F.slice(a, r * n + 1, n))
    columns = F.transform(at, lambda c: F.transform(at, lambda k: F.element_at(b, k * n + c + 1)))
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: dot(r, c))))


def transposed(m: Column, n: int = 4) -> Column:
    return F.array(*(F.element_at(m, c * n + r + 1) for r in range(n) for c in range(n)))


# property bags: arrays of struct<key, ...> that keep order and repeats


def take(entries: Column, key: str) -> tuple[Column, Column]:
    """The first entry of a key, and the bag without any entry of it."""
    return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0)), F.filter(entries, lambda e: e["key"] != key)


def leftover(entries: Column, known: list[str]) -> Column:
    """Keys that a closed schema doesn't know."""
    return F.array_except(F.transform(entries, lambda e: e["key"]), F.array(*map(F.lit, known)))


def mutual_default(a: Column, b: Column, names: str = "neither value") -> tuple[Column, Column]:
    """Each value, or the other one where it is missing; where both are, an error."""
    both = F.coalesce(a, b, F.raise_error(F.lit(f"{names} is there")))
    return F.coalesce(a, both), F.coalesce(b, both)


def typed(entry: Column, dtype: str, field: str) -> Column:
    """An entry's value if it has the type; without the entry or with another type, an error."""
    return F.when(entry["dtype"] == dtype, entry[field]).otherwise(F.raise_error(F.concat(F.lit(f"no {dtype} under "), F.coalesce(entry["key"], F.lit("that key")))))


def optional(entry: Column, dtype: str, field: str) -> Column:
    """An entry's value if it has the type, else null."""
    return F.when(entry["dtype"] == dtype, entry[field])


def indexed(entries: Column, prefix: str, suffix: str, n: Column) -> Column:
    """Entries of prefix0suffix, prefix1suffix and so on, n of them; null where one is missing."""
    at = F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.get(F.filter(entries, lambda e: e["key"] == F.concat(F.lit(prefix), i.cast("string"), F.lit(suffix))), F.lit(0)))


def since(version: Column, first: int, value: Column, default: Column, only: bool = False) -> Column:
    """A block that only versions from the first one on have, or only that one."""
    return F.when((version == first) if only else (version >= first), value).otherwise(default)


def flag_labels(n: Column, labels: list[str]) -> Column:
    """Labels of the bits that are set, the lowest first."""
    return F.filter(F.array(*(F.when(bit(n, i), F.lit(label)) for i, label in enumerate(labels))), lambda x: x.isNotNull())


def element_size(kind: Column) -> Column:
    """Bytes of a vertex element: one to three floats, or four bytes."""
    return F.when(kind == 0, 4).when(kind == 1, 8).when(kind == 2, 12).when(kind == 4, 4)


def can_shrink(width: Column, height: Column, direction: str = "both") -> Column:
    """Unable if a side above 1 that is to be halved is odd, Small if all of these are 1, else Ok. direction: both, horizontal or vertical."""
    sides = {"both": (width, height), "horizontal": (width,), "vertical": (height,)}[direction]
    odd, small = F.lit(False), F.lit(True)
    for s in sides:
        odd, small = odd | ((s != 1) & (s % 2 == 1)), small & (s == 1)
    return F.when(odd, "Unable").when(small, "Small").otherwise("Ok")


def index_set(which: Column, main: Column, normals: Column, uvs: Column) -> Column:
    """A set of indices by its number: 0, 1 or 2, anything else is none; an empty one stands for vertices in order, null."""
    chosen = F.when(which == 0, main).when(which == 1, normals).when(which == 2, uvs)
    return F.when(F.size(chosen) > 0, chosen)
