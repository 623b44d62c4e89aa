"""Payloads cut out of packages: the right bytes, and no file's bytes beside each of its resources."""

import re

from pyspark.sql import functions as F

from cairn.sources import archives, layout, sinks
from cairn.sources.compression import unpacked
from cairn.tables import shared_dir


def test_payloads_are_cut_where_the_file_lies(spark):
    """Over 4 MB of payloads, an empty one, two files, and a folder given twice."""
    rows = spark.range(9).select(
        F.when(F.col("id") < 7, "a/x.package").otherwise("b.package").alias("path"),
        F.col("id").alias("index_pos"),
        F.lit(5).cast("long").alias("type_id"),
        F.lit(1).cast("long").alias("group_id"),
        F.lit(0).cast("long").alias("instance_hi"),
        F.col("id").alias("instance_lo"),
        F.when(F.col("id") == 3, "").otherwise(F.repeat(F.concat(F.lit("r"), F.col("id")), 400_000)).cast("binary").alias("data"),
        F.lit(layout.RAW).alias("compression"),
    )
    rows = rows.withColumn("decompressed_size", F.length("data").cast("long"))
    at = shared_dir(spark)
    sinks.saved(sinks.built(rows), at).count()
    found = archives.files(spark, [at, at])
    cut = archives.payloads(found, archives.resources(archives.scan(found)).where("instance_lo <> 6"))
    assert cut.columns[:2] == ["path", "dir_ord"] and cut.columns[-1] == "data"
    got = sorted((r.dir_ord, r.path.rpartition("/")[2], r.instance_lo, r.stored_size, bytes(r.data)) for r in cut.collect())
    text = lambda i: b"" if i == 3 else f"r{i}".encode() * 400_000
    assert got == sorted((d, "x.package" if i < 7 else "b.package", i, len(text(i)), text(i)) for d in (0, 1) for i in (0, 1, 2, 3, 4, 5, 7, 8))
    used = cut.select(unpacked(F.col("data"), F.col("compression"), F.col("decompressed_size")).alias("plain"))
    shown = spark._jvm.PythonSQLUtils.explainString(used._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"\) ArrowEvalPython\nInput [^\n]*", shown)
    assert inputs and not any("content#" in x for x in inputs)
