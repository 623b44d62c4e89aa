"""Matrices, shrink rules, meshes and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.functions import reports, scalar
from cairn.operators import facts
from cairn.plans.registry import query, table

ROTATED = """
WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS a FROM embeddings)
SELECT vec_id, round(x + 1, 6) AS px, round(y * cos(a) - z * sin(a) + 2, 6) AS py, round(y * sin(a) + z * cos(a) + 3, 6) AS pz, round(x * x + y * y, 6) AS swapped FROM e
"""


@query("m_moved", ROTATED)
def moved(spark, sf_dir):
    at = lambda i: F.element_at("embedding", i).cast("double")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), at(4).alias("a"))
    m = scalar.matrix_product(G.translation(1, 2, 3), G.axis_rotation("x", F.col("a")))
    p = G.moved(m, F.col("x"), F.col("y"), F.col("z"))
    s = G.moved(G.swapped_axes(G.identity(), 0, 1), F.col("x"), F.col("y"), F.col("z"))
    six = lambda c: F.round(c, 6)
    return rows.withColumns({"p": p, "s": s}).select("vec_id", six(F.col("p.x")).alias("px"), six(F.col("p.y")).alias("py"), six(F.col("p.z")).alias("pz"), six(F.col("s.x") * F.col("y") + F.col("s.y") * F.col("x")).alias("swapped"))


QUATERNION = """
WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE + 2 AS w FROM embeddings),
n AS (SELECT *, x * x + y * y + z * z + w * w AS s FROM e)
SELECT vec_id, round(-x / s, 6) AS ix, round(w / s, 6) AS iw, round(1 - 2 * y * y - 2 * z * z, 6) AS m00, round(2 * x * y - 2 * w * z, 6) AS m01 FROM n
"""


@query("m_quaternion", QUATERNION)
def quaternion(spark, sf_dir):
    at = lambda i: F.element_at("embedding", i).cast("double")
    q = F.struct(at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), (at(4) + 2).alias("w"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", q.alias("q"))
    rows = rows.withColumns({"i": scalar.quaternion_inverse(F.col("q")), "m": G.rotation(F.col("q"))})
    return rows.select("vec_id", F.round("i.x", 6).alias("ix"), F.round("i.w", 6).alias("iw"), F.round(F.element_at("m", 1), 6).alias("m00"), F.round(F.element_at("m", 2), 6).alias("m01"))


@query("m_can_shrink", "SELECT p_partkey, CASE WHEN (w <> 1 AND w % 2 = 1) OR (h <> 1 AND h % 2 = 1) THEN 'Unable' WHEN w = 1 AND h = 1 THEN 'Small' ELSE 'Ok' END AS shrink, CASE WHEN w = 1 THEN 'Small' WHEN w % 2 = 1 THEN 'Unable' ELSE 'Ok' END AS wide, CASE WHEN h = 1 THEN 'Small' WHEN h % 2 = 1 THEN 'Unable' ELSE 'Ok' END AS high FROM (SELECT p_partkey, p_size AS w, p_size % 4 + 1 AS h FROM part)")
def can_shrink(spark, sf_dir):
    sides = F.col("p_size"), F.col("p_size") % 4 + 1
    return table(spark, sf_dir, "part").select("p_partkey", scalar.can_shrink(*sides).alias("shrink"), scalar.can_shrink(*sides, "horizontal").alias("wide"), scalar.can_shrink(*sides, "vertical").alias("high"))


MAX_MIPS = """
WITH RECURSIVE s AS (
  SELECT p_partkey, p_size % 20 AS w, p_partkey % 9 AS h, 1 AS n, false AS odd FROM part
  UNION ALL
  SELECT p_partkey, greatest(w // 2, 1), greatest(h // 2, 1), n + 1, (w > 1 AND w % 2 = 1) OR (h > 1 AND h % 2 = 1) FROM s WHERE (w > 1 OR h > 1) AND w > 0 AND h > 0 AND NOT odd
)
SELECT p_partkey, CASE WHEN p_size % 20 = 0 OR p_partkey % 9 = 0 THEN 0 WHEN bad THEN 1 ELSE n END AS levels FROM part JOIN (SELECT p_partkey, max(n) AS n, bool_or(odd) AS bad FROM s GROUP BY p_partkey) USING (p_partkey)
"""


@query("m_max_mips", MAX_MIPS)
def max_mips(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", facts.max_mip_levels(F.col("p_size") % 20, (F.col("p_partkey") % 9).cast("int")).alias("levels"))


@query("m_inverse", """
WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT vec_id, round(-y, 6) AS x, round(x, 6) AS y, round(-z, 6) AS z, round(-sqrt(0.5), 6) AS qz, round(sqrt(0.5), 6) AS qw FROM e
""")
def inverse(spark, sf_dir):
    """A quarter turn about z, undone: x takes the negative y, y the x."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    t = F.struct(at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))
    half = F.sqrt(F.lit(0.5))
    q = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), half.alias("z"), half.alias("w"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", G.inverse_transform(t, q).alias("i"))
    six = lambda c: F.round(c, 6)
    return rows.select("vec_id", *(six(F.col(f"i.translation.{c}")).alias(c) for c in "xyz"), six(F.col("i.rotation.z")).alias("qz"), six(F.col("i.rotation.w")).alias("qw"))


TURNED = """
WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS a, embedding[5]::DOUBLE AS b FROM embeddings),
v AS (SELECT *, x * cos(b) - y * sin(b) AS vx, x * sin(b) + y * cos(b) AS vz FROM e)
SELECT vec_id, round(x * cos(a) - y * sin(a), 6) AS about_z, round(x * sin(a) + z * cos(a), 6) AS about_y, round(2 * x, 6) AS side, 0.5::DOUBLE AS depth,
  round(x * cos(b) - (y + 3) * sin(b), 5) AS seen_x, round(sin(a) * (z + 2) + cos(a) * (x * sin(b) + (y + 3) * cos(b)) + 4, 5) AS seen_z
FROM v
"""


@query("m_matrices", TURNED)
def matrices(spark, sf_dir):
    """Turns about the other two axes, a projection, and what is seen from 4 away after a turn by b about y, by a about x, and a move by (0, 2, 3)."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), at(4).alias("a"), at(5).alias("b"))
    p = [F.col(c) for c in "xyz"]
    six = lambda c, n=6: F.round(c, n)
    made = {"rz": G.moved(G.axis_rotation("z", F.col("a")), *p), "ry": G.moved(G.axis_rotation("y", F.col("a")), *p), "pr": G.moved(G.projection(0.5, F.lit(4.0)), *p)}
    rows = rows.withColumns(made | {"s": G.moved(G.view_matrix(F.col("a"), F.col("b"), (0, 2, 3), 4), *p)})
    return rows.select("vec_id", six(F.col("rz.x")).alias("about_z"), six(F.col("ry.z")).alias("about_y"), six(F.col("pr.x")).alias("side"), F.col("pr.z").alias("depth"), six(F.col("s.x"), 5).alias("seen_x"), six(F.col("s.z"), 5).alias("seen_z"))


@query("m_morph_names", "SELECT p_brand, string_agg(CASE WHEN p_size % 3 = 0 THEN 'group::' || p_size ELSE '' END, ',' ORDER BY p_size) AS names FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY p_brand")
def morph_names(spark, sf_dir):
    ids = G.morph_ids(table(spark, sf_dir, "part"), ["p_brand"], "p_size")
    names = ids.where("morph % 3 = 0").select("p_brand", "morph", F.concat(F.lit("group::"), F.col("morph")).alias("name"))
    return G.morph_names(ids, names, ["p_brand"]).select("p_brand", F.array_join("names", ",").alias("names"))


@query("m_bones", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 10 + p_size % 3 END AS bone, p_size % 3 AS buffer FROM part")
def bones(spark, sf_dir):
    key = F.when(F.col("p_size") % 5 == 0, 255).otherwise(F.col("p_size") % 3)
    bone = G.bone_keys(F.array(key), F.array(F.lit(10), F.lit(11), F.lit(12)))
    data = G.attribute_data(F.array(F.array(F.lit(0)), F.array(F.lit(1)), F.array(F.lit(2))), F.col("p_size") % 3, F.array(F.lit(0), F.lit(1), F.lit(2)))
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(bone, 1).alias("bone"), F.element_at(data, 1).alias("buffer"))


@query("m_morphs", "SELECT p_brand, p_size AS morph, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS target FROM (SELECT DISTINCT p_brand, p_size FROM part)")
def morphs(spark, sf_dir):
    return G.morph_ids(table(spark, sf_dir, "part"), ["p_brand"], "p_size").withColumn("target", F.col("target").cast("long"))


SLOTS = """
WITH k AS (SELECT p_brand, p_size % 4 AS slot, arg_max(p_partkey, p_partkey) AS keys FROM part WHERE p_size <= 20 GROUP BY ALL)
SELECT p_partkey, keys, CASE WHEN keys = p_partkey THEN 1.5 ELSE 0 END::DOUBLE AS delta FROM part JOIN k ON part.p_brand = k.p_brand AND (p_size % 16) // 4 = k.slot
"""


@query("m_morph_deltas", SLOTS)
def morph_deltas(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    keys = part.where("p_size <= 20").select("p_brand", (F.col("p_size") % 4).alias("slot"), F.col("p_partkey").alias("position"), F.col("p_partkey").alias("keys"))
    found = G.slot_keys(part.select("p_partkey", "p_brand", (F.col("p_size") % 16).alias("slot")), keys, ["p_brand"])
    delta = G.scattered(F.array(F.lit(1.5)), F.array("keys"), F.col("p_partkey"), F.array(F.lit(0.0)))
    return found.select("p_partkey", "keys", F.element_at(delta, 1).alias("delta"))


@query("m_flag_labels", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size & 1 = 1 THEN 'door' END, CASE WHEN p_size & 2 = 2 THEN 'window' END, CASE WHEN p_size & 4 = 4 THEN 'stairs' END], lambda x : x IS NOT NULL), ',') AS labels, CASE WHEN p_size >= 30 THEN p_size ELSE -1 END AS gated, CASE p_size % 5 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 12 WHEN 4 THEN 4 END AS element_size FROM part")
def flag_labels(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(scalar.flag_labels(size, ["door", "window", "stairs"]), ",").alias("labels"), scalar.since(size, 30, size, F.lit(-1)).alias("gated"), scalar.element_size(size % 5).alias("element_size"))


@query("m_indexed_keys", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE o_orderstatus || ',' || o_orderpriority END AS overrides, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS maybe FROM orders")
def indexed_keys(spark, sf_dir):
    entry = lambda k, t, v: F.struct(F.lit(k).alias("key"), t.alias("dtype"), v.cast("string").alias("s"))
    kind = F.when(F.col("o_orderkey") % 2 == 0, "UInt").otherwise("String")
    bag = F.array(entry("override1name", F.lit("String"), F.col("o_orderpriority")), entry("override0name", F.lit("String"), F.col("o_orderstatus")), entry("id", kind, F.col("o_custkey")))
    rows = table(spark, sf_dir, "orders").withColumn("bag", bag)
    first, _ = scalar.take(F.col("bag"), "id")
    names = scalar.indexed(F.col("bag"), "override", "name", F.col("o_orderkey") % 3)
    return rows.select("o_orderkey", F.array_join(F.transform(names, lambda e: e["s"]), ",").alias("overrides"), scalar.optional(first, "UInt", "s").cast("long").alias("maybe"))


@query("m_line_changes", "SELECT o_orderkey, '--- old' || chr(10) || '+++ new' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' ' || o_orderstatus || chr(10) || '-' || o_orderpriority || chr(10) || '+' || o_custkey AS changes FROM orders")
def line_changes(spark, sf_dir):
    line = lambda c: F.concat_ws("\n", "o_orderstatus", c)
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.line_changes(line("o_orderpriority"), line(F.col("o_custkey").cast("string"))).alias("changes"))
