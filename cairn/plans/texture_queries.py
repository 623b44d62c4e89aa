"""Texture rules, orders and facts over part: size stands for width, height and mip levels, type for the format."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cairn.functions import pixels as pixels_of
from cairn.operators import facts, rules
from cairn.operators.conflicts import positions
from cairn.plans.registry import query, table

FORMAT_OF = {"ECONOMY": "DXT1", "LARGE": "DXT3", "MEDIUM": "RawARGB32", "PROMO": "Grayscale", "SMALL": "RawRGB24", "STANDARD": "AltARGB32"}

T = """
WITH f AS (
  SELECT p_partkey, p_name AS path, p_size * 8 AS width, p_size * 4 AS height, p_size % 6 AS mip_levels,
    CASE p_type WHEN 'ECONOMY' THEN 'DXT1' WHEN 'LARGE' THEN 'DXT3' WHEN 'MEDIUM' THEN 'RawARGB32' WHEN 'PROMO' THEN 'Grayscale' WHEN 'SMALL' THEN 'RawRGB24' WHEN 'STANDARD' THEN 'AltARGB32' END AS format
  FROM part
), levels AS (
  SELECT f.*, i, greatest(width >> i, 1) AS w, greatest(height >> i, 1) AS h FROM f, (SELECT unnest(range(0, 6))::INT AS i)
), t AS (
  SELECT f.*, coalesce(m, 0)::BIGINT AS memory_size FROM f LEFT JOIN (
    SELECT p_partkey, sum(CASE WHEN format = 'DXT1' THEN ((w + 3) // 4) * ((h + 3) // 4) * 8 WHEN format = 'DXT3' THEN ((w + 3) // 4) * ((h + 3) // 4) * 16
      WHEN format = 'Grayscale' THEN w * h WHEN format = 'RawRGB24' THEN w * h * 3 ELSE w * h * 4 END) AS m
    FROM levels WHERE i < mip_levels GROUP BY p_partkey) USING (p_partkey)
)
"""
RANK = "list_position(['DXT1','DXT3','DXT5','Grayscale','Alpha','RawRGB24','RawARGB32','AltRGB24','AltARGB32'], format)"


def textures(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.lit(None).cast("string")
    for k, v in FORMAT_OF.items():
        name = F.when(F.col("p_type") == k, v).otherwise(name)
    rows = part.select("p_partkey", F.col("p_name").alias("path"), (F.col("p_size") * 8).alias("width"), (F.col("p_size") * 4).alias("height"), (F.col("p_size") % 6).alias("mip_levels"), name.alias("format"))
    return rows.withColumn("memory_size", facts.mip_memory("format", "width", "height", "mip_levels", F.lit(1)))


@query("t_facts", T + "SELECT * FROM t")
def texture_facts(spark, sf_dir):
    return textures(spark, sf_dir)


RULES = json.dumps([{"field": "width", "op": ">", "value": 64}, {"field": "width", "op": "<=", "value": 320}, {"field": "height", "op": ">=", "value": 48}, {"field": "height", "op": "<", "value": 400}, {"field": "mip_levels", "op": "!=", "value": 3}])


@query("t_rules_and", T + "SELECT p_partkey FROM t WHERE width > 64 AND width <= 320 AND height >= 48 AND height < 400 AND mip_levels <> 3")
def rules_and(spark, sf_dir):
    return textures(spark, sf_dir).where(rules.matches(RULES)).select("p_partkey")


@query("t_rules_equal", T + "SELECT p_partkey, memory_size FROM t WHERE mip_levels = 2")
def rules_equal(spark, sf_dir):
    return textures(spark, sf_dir).where(rules.matches([{"field": "mip_levels", "op": "==", "value": 2}])).select("p_partkey", "memory_size")


@query("t_rules_formats", T + "SELECT p_partkey FROM t WHERE format IN ('RawRGB24', 'RawARGB32', 'AltRGB24', 'AltARGB32') AND mip_levels > 1")
def rules_formats(spark, sf_dir):
    return textures(spark, sf_dir).where(rules.matches([rules.DEFAULTS["format"], rules.DEFAULTS["mip_levels"]])).select("p_partkey")


@query("t_rules_empty_set", "SELECT p_partkey FROM part WHERE false")
def rules_empty_set(spark, sf_dir):
    return textures(spark, sf_dir).where(rules.matches([{"field": "format", "in": []}])).select("p_partkey")


@query("t_rules_none", "SELECT p_partkey FROM part")
def rules_none(spark, sf_dir):
    return textures(spark, sf_dir).where(rules.matches("[]")).select("p_partkey")


def ordered(spark, sf_dir, spec):
    names = {"format": rules.format_rank("format"), "type_id": "p_partkey", "group_id": "p_partkey", "instance": "p_partkey"}
    return positions(textures(spark, sf_dir), [*spec.columns(names), F.col("p_partkey")], "position").select("p_partkey", "position")


FIRST = T + "SELECT p_partkey, row_number() OVER (ORDER BY {}) AS position FROM t"


@query("t_sort_default", FIRST.format("path, p_partkey"))
def sort_default(spark, sf_dir):
    return ordered(spark, sf_dir, rules.SortSpec())


@query("t_sort_format", FIRST.format(f"{RANK} DESC, path, p_partkey"))
def sort_format(spark, sf_dir):
    return ordered(spark, sf_dir, rules.SortSpec().front("format"))


@query("t_sort_moved", FIRST.format(f"{RANK}, memory_size DESC, path, p_partkey"))
def sort_moved(spark, sf_dir):
    spec = rules.SortSpec().clicked("memory_size").clicked("format").clicked("format")
    return ordered(spark, sf_dir, rules.SortSpec.from_json(spec.to_json()))


MESH = """
SELECT p_brand, sum(p_size * 12 + p_size * 3 * 2)::BIGINT AS memory,
  sum(CASE p_type WHEN 'SMALL' THEN p_size * 3 * 2 WHEN 'LARGE' THEN p_size * 3 ELSE p_size * 3 // 3 END)::BIGINT AS n_polys,
  count(*) + CASE WHEN bool_or(p_size > 48) THEN 1 ELSE 0 END AS draw_calls
FROM part GROUP BY p_brand
"""


@query("t_mesh_stats", MESH)
def mesh(spark, sf_dir):
    primitive = F.when(F.col("p_type") == "SMALL", "points").when(F.col("p_type") == "LARGE", "lines").otherwise("triangles")
    return facts.mesh_stats(table(spark, sf_dir, "part"), ["p_brand"], primitive, F.col("p_size") * 3, F.col("p_size") * 12, F.col("p_size") > 48)


PX = "SELECT o_orderkey // 400 AS img, (o_orderkey % 400) % 20 AS x, (o_orderkey % 400) // 20 AS y, (o_custkey % 256)::BIGINT AS r, ((o_orderkey * 7) % 5 * 50)::BIGINT AS a FROM orders"

SHRINK = """
WITH px AS (
  {px}
), s AS (
  SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY img
), ways AS (
  SELECT * FROM (VALUES ('both', NULL), ('both', 128), ('horizontal', NULL), ('vertical', NULL)) v(way, t)
), ok AS (
  SELECT *, NOT ((way <> 'vertical' AND w <> 1 AND w % 2 = 1) OR (way <> 'horizontal' AND h <> 1 AND h % 2 = 1))
    AND NOT ((way = 'vertical' OR w = 1) AND (way = 'horizontal' OR h = 1)) AS ok FROM s, ways
), four AS (
  SELECT way, t, img, CASE WHEN ok AND way <> 'vertical' THEN x // 2 ELSE x END AS x, CASE WHEN ok AND way <> 'horizontal' THEN y // 2 ELSE y END AS y,
    sum(a) AS sa, sum(r) AS sr, sum(r * a) AS sw, sum(a * (a * t + (255 - t) * (255 - t))) AS kept, count(*) AS n
  FROM px JOIN ok USING (img) GROUP BY ALL
)
SELECT way, coalesce(t, -1) AS t, img, x, y, (CASE WHEN sa = 0 THEN sr // n ELSE sw // sa END)::BIGINT AS r,
  (CASE WHEN t IS NULL OR n <> 4 THEN sa // n ELSE kept // greatest(sa * t + (255 - t) * (255 - t) * 4, 1) END)::BIGINT AS a FROM four
""".format(px=PX)


def order_pixels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.selectExpr("o_orderkey div 400 AS img", "(o_orderkey % 400) % 20 AS x", "(o_orderkey % 400) div 20 AS y", "o_custkey % 256 AS r", "(o_orderkey * 7) % 5 * 50 AS a")


@query("t_pixel_shrink", SHRINK)
def pixel_shrink(spark, sf_dir):
    px = order_pixels(spark, sf_dir)
    out = None
    for way, t in (("both", None), ("both", 128), ("horizontal", None), ("vertical", None)):
        one = pixels_of.shrink(px, ["img"], ["r"], "a", way, t).select(F.lit(way).alias("way"), F.lit(-1 if t is None else t).alias("t"), "img", "x", "y", "r", "a")
        out = one if out is None else out.unionByName(one)
    return out


HALF = """(
  SELECT img, x // 2 AS x, y // 2 AS y, (CASE WHEN sum(a) = 0 THEN sum(r) // count(*) ELSE sum(r * a) // sum(a) END)::BIGINT AS r, (sum(a) // count(*))::BIGINT AS a
  FROM {of} JOIN (SELECT img FROM {of} GROUP BY img HAVING ((max(x) + 1) % 2 = 0 OR max(x) = 0) AND ((max(y) + 1) % 2 = 0 OR max(y) = 0) AND max(x) + max(y) > 0) USING (img) GROUP BY ALL
)"""
CHAIN = f"WITH l0 AS ({PX}), l1 AS {HALF.format(of='l0')}, l2 AS {HALF.format(of='l1')}, l3 AS {HALF.format(of='l2')}, c AS (SELECT *, 0 AS level FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3)"


@query("t_mip_chain", CHAIN + "SELECT img, x, y, r, a, level FROM c")
def mip_chain(spark, sf_dir):
    return pixels_of.with_smaller_mips(order_pixels(spark, sf_dir), ["img"], ["r"], "a", 3)


ALL_HALVED = CHAIN + """, s AS (
  SELECT img, level, max(x) + 1 AS w, max(y) + 1 AS h FROM c GROUP BY ALL
), ok AS (
  SELECT *, (w = 1 OR w % 2 = 0) AND (h = 1 OR h % 2 = 0) AND w * h > 1 AS ok FROM s
), n AS (
  SELECT img, level, CASE WHEN ok THEN x // 2 ELSE x END AS x, CASE WHEN ok THEN y // 2 ELSE y END AS y,
    (CASE WHEN sum(a) = 0 THEN sum(r) // count(*) ELSE sum(r * a) // sum(a) END)::BIGINT AS r, (sum(a) // count(*))::BIGINT AS a
  FROM c JOIN ok USING (img, level) GROUP BY ALL
), t AS (
  SELECT img, max(level) AS top, max(CASE WHEN level = 0 THEN x + 1 END) AS w, max(CASE WHEN level = 0 THEN y + 1 END) AS h FROM n GROUP BY img
), m AS (
  SELECT *, CASE WHEN (w & (w - 1)) = 0 AND (h & (h - 1)) = 0 THEN greatest(length(bin(w)), length(bin(h))) ELSE 1 END AS most FROM t
)
SELECT img, level, x, y, r, a FROM n JOIN m USING (img) WHERE level < top OR top < most
"""


@query("t_shrunk_chain", ALL_HALVED)
def shrunk_chain(spark, sf_dir):
    return pixels_of.shrunk_chain(mip_chain(spark, sf_dir), ["img"], ["r"], "a").select("img", "level", "x", "y", "r", "a")


PIXELS = """
WITH d AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'RawARGB32' WHEN 1 THEN 'Grayscale' ELSE 'Alpha' END AS format, md5(p_name || p_partkey) AS h FROM part),
px AS (SELECT p_partkey, format, h, unnest(range(0, CASE WHEN format = 'RawARGB32' THEN 4 ELSE 16 END)) AS i FROM d),
v AS (SELECT p_partkey, format, i, CASE format WHEN 'RawARGB32' THEN ('0x' || h[i * 8 + 5:i * 8 + 6])::INT WHEN 'Grayscale' THEN ('0x' || h[i * 2 + 1:i * 2 + 2])::INT ELSE 0 END AS r,
  CASE format WHEN 'RawARGB32' THEN ('0x' || h[i * 8 + 7:i * 8 + 8])::INT WHEN 'Grayscale' THEN 255 ELSE ('0x' || h[i * 2 + 1:i * 2 + 2])::INT END AS a FROM px)
SELECT p_partkey, (i % CASE WHEN format = 'RawARGB32' THEN 2 ELSE 4 END)::INT AS x, (i // CASE WHEN format = 'RawARGB32' THEN 2 ELSE 4 END)::INT AS y, r, a FROM v
"""


def images(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, "RawARGB32").when(F.col("p_partkey") % 3 == 1, "Grayscale").otherwise("Alpha")
    side = F.when(F.col("p_partkey") % 3 == 0, 2).otherwise(4)
    return part.select("p_partkey", name.alias("format"), side.alias("width"), side.alias("height"), F.unhex(F.md5(F.concat("p_name", F.col("p_partkey").cast("string")))).alias("data"))


@query("t_pixels", PIXELS)
def pixels(spark, sf_dir):
    return pixels_of.exploded(images(spark, sf_dir), ["p_partkey"]).select("p_partkey", "x", "y", "r", "a")


@query("t_pixels_back", "SELECT p_partkey, md5(p_name || p_partkey) AS data FROM part")
def pixels_back(spark, sf_dir):
    """Images of three formats as pixels and put together again."""
    each = pixels_of.exploded(images(spark, sf_dir), ["p_partkey", "format"])
    back = None
    for name in ("RawARGB32", "Grayscale", "Alpha"):
        one = pixels_of.imploded(each.where(F.col("format") == name), ["p_partkey"], name)
        back = one if back is None else back.unionByName(one)
    return back.select("p_partkey", F.lower(F.hex("data")).alias("data"))


CONVERTED = """
WITH d AS (SELECT p_partkey, p_partkey % 3 AS k, md5(p_name || p_partkey) AS h FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 10 = 7 THEN 'DXT5' ELSE 'Grayscale' END AS format,
  CASE WHEN k = 1 OR p_partkey % 10 = 7 THEN h WHEN k = 2 THEN repeat('00', 16)
  ELSE array_to_string(list_transform(range(0, 4), lambda i : printf('%02x', (('0x' || h[i * 8 + 1:i * 8 + 2])::INT + ('0x' || h[i * 8 + 3:i * 8 + 4])::INT + ('0x' || h[i * 8 + 5:i * 8 + 6])::INT) // 3)), '') END AS data FROM d
"""


@query("t_converted", CONVERTED)
def converted(spark, sf_dir):
    """To shades of gray; block formats can't be decoded and stay."""
    some = images(spark, sf_dir).withColumn("format", F.when(F.col("p_partkey") % 10 == 7, "DXT5").otherwise(F.col("format")))
    return pixels_of.converted(some, ["p_partkey"], "Grayscale").select("p_partkey", "format", F.lower(F.hex("data")).alias("data"))


@query("t_replaced", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Alpha' ELSE 'Grayscale' END AS format, CASE WHEN p_size % 2 = 0 THEN 1 ELSE p_size END AS width, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 3 END AS n_levels, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS n_textures FROM part")
def replaced(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    level = F.array(*(F.lit(x).cast("binary") for x in "abc"))
    old = part.select("p_partkey", F.lit("Grayscale").alias("format"), F.col("p_size").alias("width"), F.col("p_size").alias("height"), F.array(level, level).alias("mips"))
    new = part.where("p_size % 2 = 0").select("p_partkey", F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit("z").cast("binary").alias("data"))
    done = pixels_of.replaced(old, new, ["p_partkey"], "Alpha")
    return done.select("p_partkey", "format", "width", F.size(F.get("mips", F.lit(0))).alias("n_levels"), F.size("mips").alias("n_textures"))


@query("t_without_mips", "SELECT p_partkey, CASE WHEN p_size % 4 > 2 THEN '' ELSE array_to_string(['a', 'b', 'c', 'd'][2:4 - p_size % 4], '') END AS kept FROM part")
def fewer_mips(spark, sf_dir):
    """A chain without its smallest level and up to three of its largest."""
    chain = F.array(*map(F.lit, "abcd"))
    size = F.col("p_size") % 4
    kept = F.when(size == 0, pixels_of.without_mips(chain, 0, 1)).when(size == 1, pixels_of.without_mips(chain, 1, 1)).when(size == 2, pixels_of.without_mips(chain, 2, 1)).otherwise(pixels_of.without_mips(chain, 3, 1))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(kept, "").alias("kept"))
