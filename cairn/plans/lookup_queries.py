"""Joins, sums, orders and paths over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import scalar as S
from cairn.functions.geometry import running_offsets
from cairn.operators import conflicts, facts, lookups
from cairn.plans.registry import query, table


@query("j_directory", "SELECT d.doc_id, CASE WHEN s IS NOT NULL THEN 'RefPack' ELSE 'Uncompressed' END AS compression, coalesce(s, n_chars) AS size FROM documents d LEFT JOIN (SELECT doc_id, (max(quality) + 2 * max(toxic))::BIGINT AS s FROM labels GROUP BY doc_id) USING (doc_id)")
def directory(spark, sf_dir):
    sizes = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 2 * F.col("toxic")).cast("long").alias("size"))
    rows = lookups.with_directory(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), sizes, ["doc_id"], "size", ["size"])
    return rows.select("doc_id", "compression", F.coalesce("decompressed_size", "n_chars").alias("size"))


@query("j_last_wins", "SELECT l_partkey, l_suppkey, arg_max(l_quantity, (l_orderkey, l_linenumber, l_extendedprice)) AS l_quantity FROM lineitem GROUP BY ALL")
def last_wins(spark, sf_dir):
    return lookups.last_wins(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_quantity", ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query("j_first_match", "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def first_match(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    return lookups.first_match(rows, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"]).drop("l_suppkey")


@query("j_dimension", "SELECT c_custkey, coalesce(n_name, printf('Unknown(%08X)', c_nationkey)) AS n_name, coalesce(r_name, '-') AS r_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dimension(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 20").withColumnRenamed("n_nationkey", "c_nationkey")
    regions = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    unknown = F.concat(F.lit("Unknown("), S.hex_of(F.col("c_nationkey"), 8), F.lit(")"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    named = lookups.with_dimension(rows, nations, "c_nationkey", "n_name", unknown)
    placed = lookups.with_dimension(named, nations, "c_nationkey", "n_regionkey", F.lit(None).cast("int"))
    return lookups.with_dimension(placed, regions, "n_regionkey", "r_name", F.lit("-")).select("c_custkey", "n_name", "r_name")


@query("j_known_bad", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linestatus = 'F') AND NOT (l_returnflag = 'N' AND l_linestatus = 'O')")
def known_bad(spark, sf_dir):
    bad = spark.createDataFrame([("A", "F"), ("N", "O")], "l_returnflag string, l_linestatus string")
    return lookups.without_keys(table(spark, sf_dir, "lineitem"), bad).select("l_orderkey", "l_linenumber", "l_partkey")


@query("j_override", "SELECT doc_id, coalesce(source || ':' || quality, lang) AS lang FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)")
def override(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    new = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    new = docs.select("doc_id", "source").join(new, "doc_id").select("doc_id", F.concat_ws(":", "source", "quality").alias("new"))
    return lookups.with_overrides(docs.select("doc_id", "lang"), new, "doc_id", "lang", "new")


@query("a_hole_totals", "SELECT o_orderkey, count(l_orderkey) AS n_holes, coalesce(sum(l_linenumber), 0)::BIGINT AS hole_bytes FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def hole_totals(spark, sf_dir):
    return _holes(spark, sf_dir)


def _holes(spark, sf_dir):
    holes = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return facts.hole_totals(table(spark, sf_dir, "orders").select("o_orderkey"), holes, "o_orderkey", "l_linenumber")


@query("a_hole_grand_total", "SELECT (SELECT count(*) FROM orders) AS n_files, count(*) AS n_holes, sum(l_linenumber)::BIGINT AS hole_bytes FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def hole_grand_total(spark, sf_dir):
    return facts.grand_total(_holes(spark, sf_dir))


@query("a_before_after", "SELECT count(*) AS n, sum(strlen(text))::BIGINT AS bytes_before, sum(n_chars // 2)::BIGINT AS bytes_after FROM documents WHERE lang <> 'de'")
def before_after(spark, sf_dir):
    return facts.before_after(table(spark, sf_dir, "documents"), F.octet_length("text"), F.expr("n_chars div 2"), F.col("lang") != "de")


@query("a_distinct_rank", "SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS rank FROM (SELECT DISTINCT source FROM documents)")
def distinct_rank(spark, sf_dir):
    distinct = table(spark, sf_dir, "documents").select("source").distinct()
    return conflicts.positions(distinct, ["source"], "rank").select("source", (F.col("rank") - 1).alias("rank"))


@query("w_running_offset", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) - l_quantity::BIGINT)::BIGINT AS off FROM lineitem")
def running_offset(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return running_offsets(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "q", "off").drop("q")


@query("p_path_order", "SELECT page_id, row_number() OVER (ORDER BY string_split(url, '/'), page_id) AS position FROM pages")
def path_order(spark, sf_dir):
    return conflicts.positions(table(spark, sf_dir, "pages").select("page_id", "url"), [F.split("url", "/"), F.col("page_id")], "position").select("page_id", "position")


@query("p_file_parts", r"SELECT page_id, string_split(url, '/')[-1] AS name, CASE WHEN regexp_matches(string_split(url, '/')[-1], '^.+\.[^.]*$') THEN regexp_extract(string_split(url, '/')[-1], '^(.+)\.[^.]*$', 1) ELSE string_split(url, '/')[-1] END AS stem, regexp_extract(string_split(url, '/')[-1], '^.+\.([^.]*)$', 1) AS extension FROM pages")
def file_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", S.file_name(url).alias("name"), S.stem(url).alias("stem"), S.extension(url).alias("extension"))


@query("p_strip_prefix", "SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN url[7:] WHEN starts_with(url, 'https://') THEN url[8:] ELSE url END AS shown FROM pages")
def strip_prefix(spark, sf_dir):
    return lookups.without_folder(table(spark, sf_dir, "pages"), "url", ["http:", "https:"], "shown").select("page_id", "shown")


EDGES = "WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst, true AS on_true FROM nation WHERE n_nationkey % 7 <> 3 UNION ALL SELECT n_nationkey, (n_nationkey + n_regionkey + 3) % 25, false FROM nation WHERE n_nationkey % 5 <> 2)"


def edges(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    true = F.when(F.col("n_nationkey") % 7 != 3, (F.col("n_nationkey") * 2 + 1) % 25)
    false = F.when(F.col("n_nationkey") % 5 != 2, (F.col("n_nationkey") + F.col("n_regionkey") + 3) % 25)
    from cairn.operators.graph import goto_edges

    return goto_edges(nation, "n_nationkey", true, false)


@query("g_edges", EDGES + "SELECT src, dst::INT AS dst, on_true FROM e")
def goto_edges_query(spark, sf_dir):
    return edges(spark, sf_dir)


@query("g_reach", EDGES + ", r AS (SELECT 0 AS node UNION SELECT e.dst FROM e JOIN r ON e.src = r.node) SELECT DISTINCT node::INT AS node FROM r")
def reach(spark, sf_dir):
    from cairn.operators.graph import reachable

    return reachable(edges(spark, sf_dir), spark.createDataFrame([(0,)], "node int"))


@query("s_soft_delete", "SELECT doc_id, n_chars FROM documents WHERE NOT (lang = 'fr' AND n_chars % 2 = 0)")
def soft_delete(spark, sf_dir):
    from cairn.sources.sinks import without_deleted

    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.expr("lang = 'fr' AND n_chars % 2 = 0").alias("deleted"))
    return without_deleted(rows, "deleted")
