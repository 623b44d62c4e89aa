"""Round trips through packages: rows are written as packages and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import facts
from cairn.plans.registry import query, table
from cairn.sources import archives, datasource, layout, sinks
from cairn.sources.compression import packed, unpacked
from cairn.tables import shared_dir


def saved_packages(spark, sf_dir) -> str:
    """A folder of documents in packages of 200 ids; every third one is RefPack."""
    third = F.col("doc_id") % 3 == 0
    body = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        F.format_string("d%02d/%d.package", F.col("doc_id") % 7, F.expr("doc_id div 200")).alias("path"),
        F.col("doc_id").cast("long").alias("index_pos"),
        F.lit(0x53545223).alias("type_id"),
        F.col("n_chars").alias("group_id"),
        F.lit(0).cast("long").alias("instance_hi"),
        F.col("doc_id").alias("instance_lo"),
        F.when(third, packed(body, F.lit(layout.REFPACK))).otherwise(body).alias("data"),
        F.when(third, layout.REFPACK).otherwise(layout.RAW).alias("compression"),
        F.octet_length("text").cast("long").alias("decompressed_size"),
    )
    at = shared_dir(spark)
    sinks.saved(sinks.built(docs), at).count()
    return at


def document_packages(spark, sf_dir):
    return archives.files(spark, [saved_packages(spark, sf_dir)])


@query("x_packages", "SELECT doc_id, n_chars, strlen(text)::BIGINT AS n_bytes, CASE WHEN doc_id % 3 = 0 THEN 65535 ELSE 0 END AS compression, md5(text) AS digest FROM documents")
def packages_round_trip(spark, sf_dir):
    found = document_packages(spark, sf_dir)
    rows = archives.payloads(found, archives.resources(archives.scan(found)))
    data = unpacked(F.col("data"), F.col("compression"), F.col("decompressed_size"))
    return rows.select(F.col("instance_lo").alias("doc_id"), F.col("group_id").alias("n_chars"), F.col("decompressed_size").alias("n_bytes"), "compression", F.md5(data).alias("digest"))


@query("x_package_index", "SELECT count(*) AS n_resources, count(DISTINCT (doc_id % 7, doc_id // 200)) AS n_files, sum(n_chars)::BIGINT AS groups FROM documents")
def package_index(spark, sf_dir):
    # by ranges: payloads aren't read
    datasource.register(spark)
    parsed = spark.read.format("packages").load(saved_packages(spark, sf_dir))
    return archives.resources(parsed).agg(F.count("*").alias("n_resources"), F.countDistinct("path").alias("n_files"), F.sum("group_id").alias("groups"))


@query("x_compression", "SELECT doc_id, md5(text) AS zlib, md5(text) AS refpack FROM documents")
def compression(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    both = rows.select("doc_id", F.length("b").alias("n"), packed(F.col("b"), F.lit(layout.ZLIB)).alias("z"), packed(F.col("b"), F.lit(layout.REFPACK)).alias("r"))
    back = lambda c, kind: F.md5(unpacked(F.col(c), F.lit(kind), F.col("n")))
    return both.select("doc_id", back("z", layout.ZLIB).alias("zlib"), back("r", layout.REFPACK).alias("refpack"))


@query("x_recompress", "SELECT count(*) AS n, sum(strlen(text))::BIGINT AS bytes_before, true AS smaller FROM documents")
def recompress(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("data"), F.lit(layout.RAW).alias("compression"), F.octet_length("text").cast("long").alias("decompressed_size"))
    done = sinks.recompressed(rows)
    sums = facts.before_after(done, F.col("bytes_before"), F.col("bytes_after"), F.col("compression") == layout.REFPACK)
    return sums.select("n", "bytes_before", (F.col("bytes_after") < F.col("bytes_before")).alias("smaller"))


@query("x_bags_xml", "SELECT o_orderkey, o_orderpriority AS name, o_custkey AS id, o_totalprice > 200000 AS flag FROM orders")
def bags_xml(spark, sf_dir):
    from cairn.sources.bags import from_xml, to_xml

    item = lambda k, kind, **v: F.struct(F.lit(k).alias("key"), F.lit(kind).alias("dtype"), *(v.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("u", "long"), ("i", "int"), ("f", "float"), ("b", "boolean"), ("s", "string"))))
    bag = F.array(item("name", "String", s=F.col("o_orderpriority")), item("id", "UInt", u=F.col("o_custkey")), item("flag", "Bool", b=F.col("o_totalprice") > 200000))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", from_xml(to_xml(bag)).alias("bag"))
    at = lambda i, c: F.element_at("bag", i)[c]
    return rows.select("o_orderkey", at(1, "s").alias("name"), at(2, "u").alias("id"), at(3, "b").alias("flag"))
