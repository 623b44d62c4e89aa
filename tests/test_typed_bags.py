"""Bags of a known kind: lookups, errors, and what their plans hold."""

import struct

import pytest
from pyspark.sql import functions as F

from cairn.operators import typed_bags
from cairn.plans import registry
from cairn.sources import bags
from cairn.sources.bags import BAG, item

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_binary_indexes_look_keys_up_without_lambdas(spark):
    """A bag is made once in a column of its own, and no lookup is a filter with a lambda, of which there were hundreds."""
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    try:
        assert plan(registry.QUERIES["v_binary_indexes"](spark, SF)).count("lambda x") <= 8
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")


def test_first_entries_and_errors(spark):
    """The first entry of a repeated key counts, and errors keep their order."""
    three = [item(f"{p}{s}", "UInt", n) for p in ("stringset", "object") for s, n in (("restypeid", 1), ("groupid", 2), ("id", 3))]
    good = [item("creatorid", "String", "c"), item("creatorid", "String", "later"), item("stringindex", "UInt", 0), item("sortindex", "UInt", 2**32 - 5), item("iconidx", "UInt", 7), item("binidx", "UInt", 1), *three]
    bad = [item("x", "Bool", True), item("creatorid", "UInt", 3), item("creatorid", "String", "late"), item("y", "Bool", False), item("x", "Int", 1), *good[2:5]]
    rows = spark.createDataFrame([(0, good), (1, bad), (2, []), (3, None)], f"id int, bag {BAG}")
    found = rows.select("id", typed_bags.binary_index(F.col("bag")).alias("b"), typed_bags.entry(F.col("bag"), "creatorid").alias("e")).orderBy("id").collect()
    assert [r.b.error for r in found] == [None, "missing: creatorid, stringset, bin, object; unknown: x, y", "missing: creatorid, stringindex, sortindex, icon, stringset, bin, object", "missing: creatorid, stringindex, sortindex, icon, stringset, bin, object"]
    assert [(r.b.creatorid, r.b.sortindex) for r in found] == [("c", -5), (None, -5), (None, None), (None, None)]
    assert [r.e and (r.e.dtype, r.e.u, r.e.s) for r in found] == [("String", None, "c"), ("UInt", 3, None), None, None]


def test_property_sets_of_a_small_file_go_to_all_cores(spark):
    """One file of few bytes gives bags for more than one task."""
    shown = plan(registry.QUERIES["v_property_sets"](spark, SF))
    assert "RepartitionByExpression [o_orderkey#" in shown


def test_codec_carries_values_and_no_nulls():
    """Between Spark and Python go the key, the type and the value; broken bags are errors as before."""
    items = [item("n", "UInt", 2**32 - 1), item("i", "Int", -3), item("f", "Float", 0.5), item("b", "Bool", False), item("s", "String", "ü"), item("r", "String", b"a\xff"), item("s", "String", "")]
    text = bags._json(items)
    assert "null" not in text and text.count('"raw"') == 1
    data = bags.write_binary(bags._items(text))
    assert bags.read_binary(data) == items
    for n in range(len(data)):
        with pytest.raises((ValueError, KeyError, struct.error)):
            bags.read_binary(data[:n])
