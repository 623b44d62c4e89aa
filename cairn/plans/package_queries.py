"""The conflict scan from folders of packages to pairs of files, over packages that hold orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import reports
from cairn.operators import conflicts, package_conflicts, package_textures, rules
from cairn.plans.registry import query, table
from cairn.sources import archives, datasource, layout, payloads, resource_types, sinks
from cairn.tables import shared_dir

#: Types of the packages' resources: three that can conflict, one of them hidden at first, and a texture.
TYPES = {0: 0x42484156, 1: 0x42434F4E, 2: 0x43545353, 3: 0x1C4A276C}

PACKAGES = """
WITH r AS (
  SELECT printf('%02d/%d.package', o_custkey % 7, o_custkey % 40) AS path, o_orderkey,
    CASE o_orderkey % 4 WHEN 0 THEN 1112031574 WHEN 1 THEN 1111707470 WHEN 2 THEN 1129599827 ELSE 474621804 END::BIGINT AS type_id,
    CASE WHEN o_orderkey % 11 = 0 THEN 4294967295 ELSE o_custkey % 3 END AS group_id, o_orderkey % 997 AS instance_lo
  FROM orders
), c AS (
  SELECT *, lag(path) OVER (PARTITION BY type_id, group_id, instance_lo ORDER BY string_split(path, '/'), o_orderkey) AS original
  FROM r WHERE type_id <> 474621804 AND group_id <> 4294967295
), p AS (
  SELECT original, path AS "new", count(*) AS n_keys, string_agg(printf('%08X %08X %016X', type_id, group_id, instance_lo), chr(10) ORDER BY o_orderkey) AS keys,
    bool_or(type_id <> 1129599827) AS enabled
  FROM c WHERE original IS NOT NULL GROUP BY original, path
)
"""


def order_packages(spark, sf_dir) -> str:
    """A folder of packages of orders, by customer; a resource's place in the index is its order's."""
    kind = F.lit(TYPES[3])
    for k in (2, 1, 0):
        kind = F.when(F.col("o_orderkey") % 4 == k, TYPES[k]).otherwise(kind)
    rows = table(spark, sf_dir, "orders").select(
        F.format_string("%02d/%d.package", F.col("o_custkey") % 7, F.col("o_custkey") % 40).alias("path"),
        F.col("o_orderkey").cast("long").alias("index_pos"),
        kind.cast("long").alias("type_id"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(conflicts.LOCAL_GROUP)).otherwise(F.col("o_custkey") % 3).cast("long").alias("group_id"),
        F.lit(0).cast("long").alias("instance_hi"),
        (F.col("o_orderkey") % 997).cast("long").alias("instance_lo"),
        F.col("o_orderstatus").cast("binary").alias("data"),
        F.lit(layout.RAW).alias("compression"),
        F.length("o_orderstatus").cast("long").alias("decompressed_size"),
    )
    at = shared_dir(spark)
    sinks.saved(sinks.built(rows), at).count()
    return at


def short(c: str):
    """The last folder and the file of a path."""
    return F.regexp_extract(c, "([^/]+/[^/]+)$", 1).alias(c)


@query("x_find_conflicts", PACKAGES + 'SELECT original, "new", n_keys, "new" || chr(10) || keys AS shown FROM p')
def find_conflicts(spark, sf_dir) -> DataFrame:
    found = package_conflicts.find_conflicts(spark, [order_packages(spark, sf_dir)])
    flat = found.select(short("original"), short("new"), "n_keys", "keys")
    return flat.select("original", "new", "n_keys", reports.conflict_text(F.col("new"), F.col("keys")).alias("shown"))


@query("x_find_visible", PACKAGES + 'SELECT original, "new", n_keys, enabled AND "new" NOT LIKE \'03%\' AS shown, "new" LIKE \'03%\' AS is_known FROM p')
def find_visible(spark, sf_dir) -> DataFrame:
    folder = order_packages(spark, sf_dir)
    known = package_conflicts.find_conflicts(spark, [folder]).where("new like '%/03/%'").select("original", "new")
    found = package_conflicts.find_visible(spark, [folder], known=known)
    return found.select(short("original"), short("new"), "n_keys", "shown", "is_known")


@query("x_type_reader", PACKAGES + "SELECT path, count(*) AS n_entries, count(*) FILTER (type_id <> 474621804 AND group_id <> 4294967295) AS n_listed FROM r GROUP BY path")
def type_reader(spark, sf_dir) -> DataFrame:
    """The data source, which leaves resources out while it reads, and header facts that count all of them."""
    datasource.register(spark)
    reader = spark.read.format("packages").option("types", ",".join(map(str, resource_types.codes(conflicts.CONFLICT_TYPES)))).option("exceptGroup", conflicts.LOCAL_GROUP)
    return reader.load(order_packages(spark, sf_dir)).select(short("path"), "n_entries", F.size("resources").cast("long").alias("n_listed"))


@query("x_relevant", PACKAGES + "SELECT path, type_id, group_id, instance_lo FROM r WHERE type_id <> 474621804 AND group_id <> 4294967295")
def relevant(spark, sf_dir) -> DataFrame:
    """The same filter over rows that were scanned without it."""
    parsed = archives.scan(archives.files(spark, [order_packages(spark, sf_dir)]))
    return conflicts.relevant(archives.resources(parsed)).select(short("path"), "type_id", "group_id", "instance_lo")


def number(c) -> Column:
    """Four bytes of a number, the lowest first."""
    return F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(c, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(4)))


def word(text: str) -> Column:
    return F.unhex(F.lit((bytes([len(text)]) + text.encode()).hex()))


def texture_payload(width, height, code, levels) -> Column:
    """A collection with one texture, without its pixels, as a version 9 block begins."""
    plain = lambda *n: F.concat(*(number(F.lit(x)) for x in n))
    head = F.concat(F.unhex(F.lit(payloads.VERSIONED.to_bytes(4, "little").hex())), plain(0, 1, payloads.TEXTURE), word("e"), plain(payloads.TEXTURE, 9))
    name = F.concat(word("cSGResource"), plain(0, 2), word("n"))
    return F.concat(head, name, number(width), number(height), number(code), plain(0, 0, 1, 0), word("n"), number(levels))


TEXTURES = """
WITH f AS (
  SELECT p_partkey, printf('t%d/%d.package', p_partkey % 3, p_partkey % 20) AS path, p_size * 8 AS width, p_size * 4 AS height, p_partkey % 4 AS mip_levels, ['DXT1', 'RawARGB32', 'Grayscale'][1 + p_size % 3] AS format
  FROM part WHERE p_partkey % 7 <> 0
), levels AS (
  SELECT f.*, greatest(width >> i, 1) AS w, greatest(height >> i, 1) AS h FROM f, (SELECT unnest(range(0, 3))::INT AS i) WHERE i < mip_levels
), t AS (
  SELECT f.*, coalesce(m, 0)::BIGINT AS memory_size FROM f LEFT JOIN (
    SELECT p_partkey, sum(CASE format WHEN 'DXT1' THEN ((w + 3) // 4) * ((h + 3) // 4) * 8 WHEN 'Grayscale' THEN w * h ELSE w * h * 4 END) AS m FROM levels GROUP BY p_partkey) USING (p_partkey)
)
SELECT path, p_partkey AS instance_lo, width, height, format, mip_levels, memory_size,
  row_number() OVER (ORDER BY memory_size DESC, string_split(path, '/'), p_partkey)::BIGINT AS position
FROM t WHERE width > 80 AND mip_levels > 0 AND p_partkey % 5 <> 0
"""


@query("x_find_textures", TEXTURES.replace("string_split(path, '/')", "path"))
def find_textures(spark, sf_dir) -> DataFrame:
    """Textures of parts in packages, wide ones with pixels, without those on a known list, the largest first."""
    key, size = F.col("p_partkey"), F.col("p_size")
    code = F.element_at(F.array(*(F.lit(payloads.TEXTURE_FORMATS.index(f) + 1) for f in ("DXT1", "RawARGB32", "Grayscale"))), 1 + size % 3)
    data = F.when(key % 7 == 0, F.lit("broken").cast("binary")).otherwise(texture_payload(size * 8, size * 4, code, (key % 4).cast("int")))
    rows = table(spark, sf_dir, "part").select(
        F.format_string("t%d/%d.package", key % 3, key % 20).alias("path"),
        key.cast("long").alias("index_pos"),
        F.lit(payloads.TEXTURE).cast("long").alias("type_id"),
        F.lit(1).cast("long").alias("group_id"),
        F.lit(0).cast("long").alias("instance_hi"),
        key.cast("long").alias("instance_lo"),
        data.alias("data"),
        F.lit(layout.RAW).alias("compression"),
        F.length(data).cast("long").alias("decompressed_size"),
    )
    at = shared_dir(spark)
    sinks.saved(sinks.built(rows), at).count()
    known = rows.where("instance_lo % 5 = 0").select("type_id", "instance_lo")
    filters = [{"field": "width", "op": ">", "value": 80}, {"field": "mip_levels", "op": ">", "value": 0}]
    found = package_textures.find_textures(spark, [at], filters, known, rules.SortSpec().front("memory_size"))
    return found.select(short("path"), "instance_lo", "width", "height", "format", "mip_levels", "memory_size", "position")
