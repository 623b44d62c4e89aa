"""Sets and lists that people edit: enabled types, formats, folders, elements by position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_member(members: Column, one: Column, on: Column) -> Column:
    """A set with a member put in or taken out."""
    return F.when(on, F.array_union(members, F.array(one))).otherwise(F.array_except(members, F.array(one)))


def without_position(elements: Column, position: Column) -> Column:
    """A list without the element at a position from 0; any other position changes nothing."""
    return F.filter(elements, lambda _, i: i != position)


def with_default(elements: Column, default: Column) -> Column:
    """A list with a new last element."""
    return F.array_append(elements, default)


def moved_element(elements: Column, old: Column, new: Column) -> Column:
    """A list whose element at `old` is at `new`, both from 0; the others keep their order. A position outside changes nothing."""
    rest, one = without_position(elements, old), F.get(elements, old)
    there = F.size(elements)
    ok = (old >= 0) & (new >= 0) & (old < there) & (new < there)
    return F.when(ok, F.concat(F.slice(rest, 1, new), F.array(one), F.slice(rest, new + 1, there))).otherwise(elements)


def folders(text: Column) -> Column:
    """The folders of a text with one on each line; empty lines are none."""
    return F.filter(F.split(text, "\n"), lambda x: x != "")


def folder_text(paths: Column) -> Column:
    """Folders on a line each."""
    return F.array_join(paths, "\n")


def static_first(static: Column, dynamic: Column) -> Column:
    """A static element, if there is one, before the dynamic ones."""
    return F.concat(F.array_compact(F.array(static)), F.coalesce(dynamic, F.slice(F.array(static), 1, 0)))
