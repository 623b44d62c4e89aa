"""Property bags of a known kind as structs, and back: property sets and binary indexes.

A bag is an array of entries (cairn.sources.bags.BAG). Reading takes the first entry of each key; what a kind needs and isn't
there or has another type, and keys that the kind doesn't know, are named in `error`, which is null for a good bag. All of it
are column expressions. A bag that is read should be a column of its own, not an expression, which each lookup would make anew; for
the same reason keys are looked up by array_position, which is compiled, and not by filters with a lambda, which aren't.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.scalar import U32
from cairn.sources.bags import BAG, FIELD

#: Keys of a property set that always are there, those that may be, and of a binary index, in the order in which they are written; ids are texts.
SET_NEEDED = {"age": "UInt", "gender": "UInt", "species": "UInt", "flags": "UInt", "name": "String", "creator": "String", "family": "String", "type": "String", "skintone": "String", "hairtone": "String", "category": "UInt", "shoe": "UInt", "fitness": "UInt"}
SET_OPTIONAL = {"version": "UInt", "product": "UInt", "genetic": "Float"}
INDEX_NEEDED = {"creatorid": "String", "stringindex": "UInt"}
INDEX_REFERENCES = ("icon", "stringset", "bin", "object")
REFERENCE = "struct<idx:bigint,type_id:bigint,group_id:bigint,instance:bigint>"
_ENTRY = BAG.removeprefix("array<").removesuffix(">")


def _key(name: str | Column) -> Column:
    return F.lit(name) if isinstance(name, str) else name


def entry(bag: Column, name: str | Column) -> Column:
    """The first entry of a key, or null."""
    return F.get(bag, F.array_position(bag["key"], _key(name)).cast("int") - 1)


def value(bag: Column, name: str | Column, dtype: str) -> Column:
    """A key's value if it has the type, else null."""
    e = entry(bag, name)
    return F.when(e["dtype"] == dtype, e[FIELD[dtype]])


def widened(bag: Column, name: str, unsigned: bool) -> Column:
    """A 32-bit number that may be stored with a sign or without, as one of the two."""
    u, i = value(bag, name, "UInt"), value(bag, name, "Int").cast("long")
    if unsigned:
        return F.coalesce(u, F.when(i < 0, i + U32).otherwise(i))
    return F.coalesce(i, F.when(u >= U32 // 2, u - U32).otherwise(u))


def item(name: str | Column, dtype: str, v: Column) -> Column:
    """An entry, or null for a null value."""
    fields = {c: t for c, t in (x.split(":") for x in _ENTRY.removeprefix("struct<").removesuffix(">").split(","))}
    parts = {"key": _key(name), "dtype": F.lit(dtype), FIELD[dtype]: v}
    return F.when(v.isNotNull(), F.struct(*(parts.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields.items())))


def _named(prefix: str | Column, suffix: str) -> Column:
    return F.concat(_key(prefix), F.lit(suffix))


def reference(bag: Column, prefix: str | Column, by_key: bool) -> Column:
    """A reference by its place in a key list, or else by three numbers; null if neither is whole."""
    idx = value(bag, _named(prefix, "keyidx" if by_key else "idx"), "UInt")
    three = [value(bag, _named(prefix, s), "UInt") for s in ("restypeid", "groupid", "id")]
    none = F.lit(None).cast("long")
    whole = three[0].isNotNull() & three[1].isNotNull() & three[2].isNotNull()
    found = F.when(idx.isNotNull(), F.struct(idx.alias("idx"), none.alias("type_id"), none.alias("group_id"), none.alias("instance")))
    return found.when(whole, F.struct(none.alias("idx"), three[0].alias("type_id"), three[1].alias("group_id"), three[2].alias("instance"))).cast(REFERENCE)


def reference_items(r: Column, prefix: str | Column, by_key: bool) -> list[Column]:
    parts = {"keyidx" if by_key else "idx": "idx", "restypeid": "type_id", "groupid": "group_id", "id": "instance"}
    return [item(_named(prefix, suffix), "UInt", r[field]) for suffix, field in parts.items()]


def _reference_keys(prefix: str, by_key: bool) -> list[str]:
    return [prefix + s for s in ("keyidx" if by_key else "idx", "restypeid", "groupid", "id")]


def _error(bag: Column, needed: dict[str, Column], known: Column) -> Column:
    """What is missing, and what isn't known."""
    missing = F.concat_ws(", ", *(F.when(v.isNull(), F.lit(k)) for k, v in needed.items()))
    rest = F.array_except(bag["key"], known)
    text = F.concat_ws("; ", F.when(missing != "", F.concat(F.lit("missing: "), missing)), F.when(F.size(rest) > 0, F.concat(F.lit("unknown: "), F.array_join(rest, ", "))))
    return F.when(text != "", text)


def _counting(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def property_set(bag: Column) -> Column:
    """A property set's struct: parts and outfit stand for each other where one is missing; overrides are counted by numoverrides."""
    needed = {k: value(bag, k, t) for k, t in SET_NEEDED.items()}
    parts, outfit = value(bag, "parts", "UInt"), value(bag, "outfit", "UInt")
    both = {"parts": F.coalesce(parts, outfit), "outfit": F.coalesce(outfit, parts)}
    links = {k: reference(bag, k, True) for k in ("resource", "shape")}
    n = value(bag, "numoverrides", "UInt")
    at = lambda i: F.concat(F.lit("override"), i.cast("string"))
    each = lambda i: F.struct(value(bag, _named(at(i), "shape"), "UInt").alias("shape"), value(bag, _named(at(i), "subset"), "String").alias("subset"), reference(bag, _named(at(i), "resource"), True).alias("resource"))
    overrides = F.transform(_counting(n), each)
    whole = ~F.exists(overrides, lambda o: o["shape"].isNull() | o["subset"].isNull() | o["resource"].isNull())
    optional = {k: value(bag, k, t) for k, t in SET_OPTIONAL.items()} | {"priority": widened(bag, "priority", True)}
    # a priority of another type is an error, none is not
    priority = F.when(optional["priority"].isNotNull() | entry(bag, "priority").isNull(), F.lit(True))
    names = [*needed, *both, *optional, "numoverrides", *(k for p in links for k in _reference_keys(p, True))]
    suffixes = ("shape", "subset", *_reference_keys("resource", True))
    known = F.concat(F.array(*map(F.lit, names)), F.flatten(F.transform(_counting(n), lambda i: F.array(*(_named(at(i), s) for s in suffixes)))))
    error = _error(bag, needed | both | links | {"numoverrides": n, "overrides": F.when(whole, F.lit(True)), "priority": priority}, known)
    fields = needed | both | optional | links | {"overrides": overrides, "error": error}
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def property_set_bag(p: Column) -> Column:
    """A property set's struct as a bag: keys in one order, those that may be missing behind the others."""
    items = [item(k, "UInt", p[k]) for k in ("parts", "outfit")] + [item(k, t, p[k]) for k, t in SET_NEEDED.items()]
    items += [item(k, t, p[k]) for k, t in {"version": "UInt", "product": "UInt", "priority": "UInt", "genetic": "Float"}.items()]
    for k in ("resource", "shape"):
        items += reference_items(p[k], k, True)
    items.append(item("numoverrides", "UInt", F.size(p["overrides"]).cast("long")))
    at = lambda i: F.concat(F.lit("override"), i.cast("string"))
    each = lambda o, i: F.array(item(_named(at(i), "shape"), "UInt", o["shape"]), item(_named(at(i), "subset"), "String", o["subset"]), *reference_items(o["resource"], _named(at(i), "resource"), True))
    return F.array_compact(F.concat(F.array(*items), F.flatten(F.transform(p["overrides"], each))))


def binary_index(bag: Column) -> Column:
    """A binary index's struct."""
    needed = {k: value(bag, k, t) for k, t in INDEX_NEEDED.items()} | {"sortindex": widened(bag, "sortindex", False)}
    links = {k: reference(bag, k, False) for k in INDEX_REFERENCES}
    known = F.array(*map(F.lit, [*needed, *(k for p in links for k in _reference_keys(p, False))]))
    return F.struct(*(v.alias(k) for k, v in (needed | links | {"error": _error(bag, needed | links, known)}).items()))


def binary_index_bag(b: Column) -> Column:
    """A binary index's struct as a bag."""
    items = [item("creatorid", "String", b["creatorid"]), item("sortindex", "Int", b["sortindex"]), item("stringindex", "UInt", b["stringindex"])]
    for k in INDEX_REFERENCES:
        items += reference_items(b[k], k, False)
    return F.array_compact(F.array(*items))
