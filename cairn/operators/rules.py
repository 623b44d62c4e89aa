"""Filter rules and sort orders kept as JSON, turned into columns that Catalyst pushes down."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Comparisons by their written form, and rules that a new filter starts with.
COMPARISONS = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}
NUMERIC = ("width", "height", "memory_size", "mip_levels")
FORMATS = ("DXT1", "DXT3", "DXT5", "Grayscale", "Alpha", "RawRGB24", "RawARGB32", "AltRGB24", "AltARGB32")
DEFAULTS = {
    "width": {"field": "width", "op": ">", "value": 512},
    "memory_size": {"field": "memory_size", "op": ">", "value": 1_000_000},
    "mip_levels": {"field": "mip_levels", "op": ">", "value": 1},
    "format": {"field": "format", "in": ["RawRGB24", "RawARGB32", "AltRGB24", "AltARGB32"]},
}
#: Sort keys in their first order; those listed as ascending rise by default, the others fall.
SORT_KEYS = ("path", "type_id", "group_id", "instance", "width", "height", "format", "mip_levels", "memory_size")
ASCENDING = frozenset(SORT_KEYS[:4])


def condition(rule: dict) -> Column:
    """One rule: {"field", "op", "value"} compares, {"field", "in"} is membership, and an empty set matches nothing."""
    if "in" in rule:
        return F.col(rule["field"]).isin(list(rule["in"])) if rule["in"] else F.lit(False)
    return COMPARISONS[rule["op"]](F.col(rule["field"]), F.lit(rule["value"]))


def matches(rules: str | Sequence[dict]) -> Column:
    """All of the rules, given as JSON or as a list; no rules match every row."""
    each = json.loads(rules) if isinstance(rules, str) else rules
    return reduce(and_, map(condition, each), F.lit(True))


def equal_if(enabled: bool, field: str, value) -> Column:
    """A filter on one value that can be switched off."""
    return F.col(field) == value if enabled else F.lit(True)


def format_rank(column: Column | str, formats: Sequence[str] = FORMATS) -> Column:
    """A format's place in a custom order; others come last."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(len(formats))
    for i, f in reversed(list(enumerate(formats))):
        out = F.when(c == f, i).otherwise(out)
    return out


class SortSpec:
    """Sort keys by priority, each with a direction."""

    def __init__(self, keys: Sequence[tuple[str, bool]] | None = None):
        self.keys = list(keys) if keys is not None else [(k, k in ASCENDING) for k in SORT_KEYS]

    def front(self, key: str, ascending: bool | None = None) -> SortSpec:
        """The key first with a direction, its own default if none is given; the others keep their order."""
        up = key in ASCENDING if ascending is None else ascending
        return SortSpec([(key, up), *((k, a) for k, a in self.keys if k != key)])

    def clicked(self, key: str) -> SortSpec:
        """The first key clicked again turns round; another one comes to the front with its default."""
        return self.front(key, not self.keys[0][1] if self.keys[0][0] == key else None)

    def columns(self, names: dict[str, Column | str] | None = None) -> list[Column]:
        """Sort columns; names: what stands for a key, if not the column of its name."""
        of = lambda k: c if isinstance(c := (names or {}).get(k, k), Column) else F.col(c)
        return [of(k).asc() if up else of(k).desc() for k, up in self.keys]

    def to_json(self) -> str:
        return json.dumps([[k, up] for k, up in self.keys])

    @classmethod
    def from_json(cls, text: str) -> SortSpec:
        return cls([(k, up) for k, up in json.loads(text)])


def known_to_json(known: DataFrame, columns: Sequence[str]) -> str:
    """A known list, which people keep by hand, as JSON."""
    return json.dumps([[r[c] for c in columns] for r in known.select(*columns).toLocalIterator()])


def known_from_json(spark: SparkSession, text: str, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in json.loads(text)], schema)
