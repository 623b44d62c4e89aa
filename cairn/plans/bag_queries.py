"""Typed bags, lists, strings and texts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import fuzzy, geometry, lists, pixels, reports, scalar
from cairn.operators import rules, typed_bags
from cairn.plans.registry import query, table
from cairn.sources import resource_types
from cairn.sources.bags import from_bytes, to_binary

SETS = """
SELECT o_orderkey, o_custkey AS parts, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_custkey END AS outfit,
  CASE o_orderkey % 3 WHEN 0 THEN 4294967295 WHEN 1 THEN o_custkey END AS priority,
  CASE WHEN o_orderkey % 5 = 0 THEN 'idx ' || o_custkey ELSE 'tgi 1-2-' || o_orderkey END AS resource,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS override,
  CASE WHEN o_orderkey % 7 = 0 THEN 'missing: name; unknown: odd' END AS error, true AS same
FROM orders
"""


@query("v_property_sets", SETS)
def property_sets(spark, sf_dir):
    """Bags are read as property sets; the good ones are written, packed, read again and compared."""
    key, cust, item = F.col("o_orderkey"), F.col("o_custkey").cast("long"), typed_bags.item
    on = lambda c, e: F.when(c, e)
    bad = key % 7 == 0
    plain = [item(k, t, F.lit(1) if t == "UInt" else F.lit(k)) for k, t in typed_bags.SET_NEEDED.items() if k != "name"]
    entries = [
        item("parts", "UInt", cust),
        on(key % 2 == 0, item("outfit", "UInt", key)),
        on(~bad, item("name", "String", F.col("o_orderpriority"))),
        on(bad, item("odd", "Bool", F.lit(True))),
        on(key % 3 == 0, item("priority", "Int", F.lit(-1))),
        on(key % 3 == 1, item("priority", "UInt", cust)),
        on(key % 5 == 0, item("resourcekeyidx", "UInt", cust)),
        *(on(key % 5 != 0, item(f"resource{s}", "UInt", v)) for s, v in (("restypeid", F.lit(1)), ("groupid", F.lit(2)), ("id", key))),
        item("shapekeyidx", "UInt", F.lit(3)),
        item("numoverrides", "UInt", F.when(key % 4 == 0, 1).otherwise(0)),
        on(key % 4 == 0, item("override0shape", "UInt", F.lit(9))),
        on(key % 4 == 0, item("override0subset", "String", F.col("o_orderstatus"))),
        on(key % 4 == 0, item("override0resourcekeyidx", "UInt", key)),
        *plain,
    ]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    cores = spark.sparkContext.defaultParallelism
    if orders.rdd.getNumPartitions() < cores:
        # a bag costs far more than the shuffle of its row, so that a small file goes to all cores
        orders = orders.repartition(2 * cores, "o_orderkey")
    rows = orders.select("o_orderkey", F.array_compact(F.array(*entries)).alias("bag"))
    rows = rows.withColumn("p", typed_bags.property_set(F.col("bag")))
    rows = rows.withColumn("again", from_bytes(to_binary(typed_bags.property_set_bag(F.col("p")))))
    rows = rows.withColumn("q", typed_bags.property_set(F.col("again")))
    r = F.col("p.resource")
    shown = F.when(r["idx"].isNotNull(), F.concat(F.lit("idx "), r["idx"])).otherwise(F.concat(F.lit("tgi "), F.concat_ws("-", r["type_id"], r["group_id"], r["instance"])))
    return rows.select("o_orderkey", "p.parts", "p.outfit", "p.priority", shown.alias("resource"), F.get("p.overrides", F.lit(0))["subset"].alias("override"), "p.error", (F.col("p.error").isNotNull() | F.col("p").eqNullSafe(F.col("q"))).alias("same"))


@query("v_binary_indexes", "SELECT p_partkey, p_name AS creatorid, CASE WHEN p_size % 2 = 0 THEN -p_size ELSE p_size END::BIGINT AS sortindex, CASE WHEN p_size % 3 = 0 THEN p_partkey END AS icon, CASE WHEN p_size % 5 = 0 THEN 'missing: bin' END AS error, true AS same FROM part")
def binary_indexes(spark, sf_dir):
    key, size, item = F.col("p_partkey").cast("long"), F.col("p_size"), typed_bags.item
    three = lambda name: [item(f"{name}{s}", "UInt", F.lit(n)) for s, n in (("restypeid", 1), ("groupid", 2), ("id", 3))]
    entries = [
        item("creatorid", "String", F.col("p_name")),
        item("stringindex", "UInt", F.lit(0)),
        F.when(size % 2 == 0, item("sortindex", "UInt", F.lit(4294967296) - size)).otherwise(item("sortindex", "Int", size)),
        F.when(size % 3 == 0, item("iconidx", "UInt", key)),
        *(F.when(size % 3 != 0, e) for e in three("icon")),
        F.when(size % 5 != 0, item("binidx", "UInt", F.lit(1))),
        *three("stringset"),
        *three("object"),
    ]
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array_compact(F.array(*entries)).alias("bag")).withColumn("b", typed_bags.binary_index(F.col("bag")))
    rows = rows.withColumn("again", typed_bags.binary_index_bag(F.col("b"))).withColumn("again", typed_bags.binary_index(F.col("again")))
    return rows.select("p_partkey", "b.creatorid", "b.sortindex", F.col("b.icon.idx").alias("icon"), "b.error", F.col("b").eqNullSafe(F.col("again")).alias("same"))


@query("v_strings", "SELECT p_partkey, p_name || chr(65533) AS lossy, p_name AS strict, NULL::VARCHAR AS broken, p_name AS cut, true AS control, false AS plain FROM part")
def strings(spark, sf_dir):
    name, broken = F.col("p_name"), F.concat(F.col("p_name").cast("binary"), F.unhex(F.lit("FF")))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        scalar.lossy_utf8(broken).alias("lossy"),
        scalar.strict_utf8(name.cast("binary")).alias("strict"),
        scalar.strict_utf8(broken).alias("broken"),
        scalar.cut_at_nul(F.concat(name, F.lit("\0rest"))).alias("cut"),
        scalar.starts_with_control(F.concat(F.lit("\x07"), name)).alias("control"),
        scalar.starts_with_control(name).alias("plain"),
    )


DUMP = """
WITH h AS (
  SELECT doc_id, lower(hex(encode(text))) AS h FROM documents
), r AS (
  SELECT doc_id, i, h[i * 32 + 1:i * 32 + 32] AS row FROM (SELECT doc_id, h, unnest(range(0, (length(h) + 31) // 32)) AS i FROM h)
), b AS (
  SELECT *, list_transform(range(0, length(row) // 2), lambda k : ('0x' || row[k * 2 + 1:k * 2 + 2])::INT) AS bytes FROM r
)
SELECT doc_id, md5(string_agg(printf('0x%04x:     ', i * 16) || rpad(regexp_replace(row, '(.{1,4})', '\\1 ', 'g'), 40, ' ')
  || array_to_string(list_transform(bytes, lambda v : CASE WHEN v < 32 THEN chr((9216 + v)::INT) WHEN v = 127 THEN chr(9249) WHEN v > 127 THEN chr(65533) ELSE chr(v) END), ''), chr(10) ORDER BY i)) AS dump
FROM b GROUP BY doc_id
"""


@query("v_hex_dump", DUMP)
def hex_dump(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.md5(scalar.hex_dump(F.col("text").cast("binary"))).alias("dump"))


LISTS = """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'BHAV,GLOB,' || p_brand ELSE 'BHAV,GLOB' END AS enabled,
  CASE WHEN p_size % 3 = 0 THEN 'b,c' WHEN p_size % 3 = 1 THEN 'a,c' ELSE 'a,b' END AS deleted, 'a,b,c,' || p_type AS appended,
  CASE p_size % 4 WHEN 0 THEN 'a,b,c' WHEN 1 THEN 'b,a,c' WHEN 2 THEN 'b,c,a' ELSE 'a,b,c' END AS moved,
  2 AS n_folders, p_brand || chr(10) || p_type AS folders, CASE WHEN p_size > 20 THEN p_brand || ',x' ELSE 'x' END AS meshes,
  p_size % 2 = 1 AS external, 'Position,Normal' AS drawn
FROM part
"""


@query("v_lists", LISTS)
def edited_lists(spark, sf_dir):
    size, brand, kind = F.col("p_size"), F.col("p_brand"), F.col("p_type")
    abc = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    text = lambda c: F.array_join(c, ",")
    two = lists.folder_text(F.array(brand, kind))
    mips = F.array(F.struct(F.lit(None).cast("string").alias("external")), F.struct(F.when(size % 2 == 1, brand).alias("external")))
    attributes = F.array(*(F.struct(F.lit(b).alias("binding")) for b in ("Position", "BoneValues", "Normal", "RegionMask")))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text(lists.with_member(F.array(F.lit("BHAV"), F.lit("GLOB")), brand, size % 2 == 0)).alias("enabled"),
        text(lists.without_position(abc, size % 3)).alias("deleted"),
        text(lists.with_default(abc, kind)).alias("appended"),
        text(lists.moved_element(abc, F.lit(0), size % 4)).alias("moved"),
        F.size(lists.folders(F.concat(two, F.lit("\n")))).alias("n_folders"),
        lists.folder_text(lists.folders(two)).alias("folders"),
        text(lists.static_first(F.when(size > 20, brand), F.array(F.lit("x")))).alias("meshes"),
        pixels.any_external(mips).alias("external"),
        text(F.transform(geometry.drawn_attributes(attributes), lambda a: a["binding"])).alias("drawn"),
    )


@query("v_versions", "SELECT p_partkey, CASE p_size WHEN 32 THEN 'Base Game' WHEN 34 THEN 'University' WHEN 41 THEN 'Nightlife' WHEN 42 THEN 'Business' WHEN 44 THEN 'Pets' WHEN 45 THEN 'Castaway' WHEN 46 THEN 'Bon Voyage' WHEN 47 THEN 'Bon Voyage (Version 2)' WHEN 24 THEN 'V18' WHEN 25 THEN 'V19' WHEN 26 THEN 'V1a' WHEN 28 THEN 'V1c' WHEN 30 THEN 'V1e' WHEN 31 THEN 'V1f' WHEN 39 THEN 'V27' END AS label, CASE WHEN p_size = 34 THEN p_partkey ELSE 0 END AS gated FROM part")
def versions(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", resource_types.version_label(size).alias("label"), scalar.since(size, 34, F.col("p_partkey"), F.lit(0), only=True).alias("gated"))


SCORES = """
WITH RECURSIVE w AS (
  SELECT '{wanted}' AS w
), s AS (
  SELECT {key}, lower({text}) AS low, 0 AS k, 0 AS pos, 0 AS score FROM {table}
  UNION ALL
  SELECT {key}, low, k + 1, found, score + 16 + CASE WHEN found = 1 OR NOT regexp_matches(low[found - 1:found - 1], '[\\p{{L}}\\p{{N}}]') THEN 8 ELSE 0 END
    + CASE WHEN found = pos + 1 AND pos > 0 THEN 4 ELSE 0 END - least(15, found - pos - 1)
  FROM (SELECT *, CASE WHEN instr(low[pos + 1:], w[k + 1:k + 1]) > 0 THEN pos + instr(low[pos + 1:], w[k + 1:k + 1]) END AS found FROM s, w WHERE k < length(w)) WHERE found IS NOT NULL
)
"""
TOP = SCORES.format(wanted="rd wdg", key="p_partkey", text="p_name", table="part") + "SELECT part.*, score FROM s JOIN part USING (p_partkey) WHERE k = 6 ORDER BY score DESC, p_partkey LIMIT 20"


@query("v_top_search", TOP)
def fuzzy_search(spark, sf_dir):
    return fuzzy.search(table(spark, sf_dir, "part"), "p_name", "rd wdg").orderBy(F.desc("score"), "p_partkey").limit(20)


BEST = SCORES.format(wanted="ar", key="p_partkey, c", text="t", table="(SELECT p_partkey, 1 AS c, p_name AS t FROM part UNION ALL SELECT p_partkey, 2, p_brand FROM part UNION ALL SELECT p_partkey, 3, p_type FROM part)")


@query("v_best_score", BEST + "SELECT p_partkey, best FROM part LEFT JOIN (SELECT p_partkey, max(score) AS best FROM s WHERE k = 2 GROUP BY p_partkey) USING (p_partkey)")
def best_score(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fuzzy.best_score(F.array("p_name", "p_brand", "p_type"), "ar").alias("best"))


@query("m_texts", "SELECT p_partkey, printf('Group: %X%sInstance: %X%sWidth: %d%sHeight: %d%sMemory size (bytes): %d%sFormat: DXT1%sMipmap levels: 1', p_partkey, chr(10), p_size, chr(10), p_size, chr(10), p_size * 2, chr(10), p_size * 8, chr(10), chr(10)) AS texture, p_size || ' B in ' || p_partkey || ' files' AS total FROM part")
def texts(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    shown = reports.texture_text(key, scalar.hex_of(size), size, size * 2, size * 8, F.lit("DXT1"), F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey", shown.alias("texture"), reports.total_text(key, size).alias("total"))


@query("p_columns", "SELECT p_partkey AS path, p_name, p_size FROM part")
def columns(spark, sf_dir):
    """A table with some of its columns switched off; one can't be."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "path")
    hidden = {c for c in part.columns if c not in ("p_name", "p_size")}
    return part.select(*reports.shown_columns(part.columns, hidden))


@query("c_type_filter", "SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def type_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type").where(rules.equal_if(True, "event_type", "click"))


@query("c_type_filter_off", "SELECT event_id, event_type FROM events")
def type_filter_off(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type").where(rules.equal_if(False, "event_type", "click"))


@query("v_vector_shapes", "SELECT vec_id, round(embedding[1]::DOUBLE * 2, 5) AS doubled, 64 + 3 AS padded, round(embedding[5]::DOUBLE, 6) AS turned, CASE vec_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS chosen FROM embeddings")
def vector_shapes(spark, sf_dir):
    e, which = F.col("embedding"), F.col("vec_id") % 4
    sets = [F.array(F.lit(1)), F.array(F.lit(2)), F.array().cast("array<int>")]
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(F.element_at(scalar.add(e, e), 1).cast("double"), 5).alias("doubled"),
        F.size(scalar.padded(e, 67)).alias("padded"),
        F.round(F.element_at(scalar.transposed(F.slice(e, 1, 16)), 2).cast("double"), 6).alias("turned"),
        F.element_at(scalar.index_set(which, *sets), 1).alias("chosen"),
    )


@query("v_typed", "SELECT o_orderkey, o_custkey AS id FROM orders")
def typed(spark, sf_dir):
    bag = F.array(typed_bags.item("id", "UInt", F.col("o_custkey").cast("long")))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.typed(typed_bags.entry(bag, "id"), "UInt", "u").alias("id"))
