"""Conflict detection over events: a user is a file, an event's id its index position, its type and props.k the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import conflicts as C
from cairn.plans.registry import query, table
from cairn.tables import written

EXCLUDED, ENABLED = "error", ["click", "view"]
KEYS = ["event_type", "k"]

PREVIOUS = """
WITH r AS (
  SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'
), c AS (
  SELECT *, lag(user_id) OVER (PARTITION BY event_type, k ORDER BY user_id, event_id) AS original FROM r
), p AS (
  SELECT original, user_id AS "new", count(*) AS n_keys, string_agg(event_type || ':' || k, ',' ORDER BY event_id) AS keys,
    bool_or(event_type IN ('click', 'view')) AS any_enabled
  FROM c WHERE original IS NOT NULL GROUP BY original, user_id
), known AS (
  SELECT original, "new" FROM p WHERE original % 3 = 0
)
"""


def index_rows(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("event_type") != EXCLUDED)
    return rows.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


def pairs(spark, sf_dir) -> DataFrame:
    return C.conflict_groups(index_rows(spark, sf_dir), KEYS, "user_id", ["user_id"], "event_id")


def known(found: DataFrame) -> DataFrame:
    return found.where("original % 3 = 0").select("original", "new")


def shown(spark, sf_dir, show_known=False) -> DataFrame:
    found = written(C.conflict_counts(index_rows(spark, sf_dir), KEYS, "user_id", ["user_id"], "event_id", "event_type"))
    return C.visible(found, F.col("types"), ENABLED, known(found), show_known)


def flat(found: DataFrame) -> DataFrame:
    return found.select("original", "new", "n_keys", F.array_join(F.transform("keys", lambda x: F.concat_ws(":", x["event_type"], x["k"])), ",").alias("keys"))


FLAT = 'SELECT original, "new", n_keys, keys FROM p'


@query("c_conflicts", PREVIOUS + FLAT)
def conflict_pairs(spark, sf_dir):
    return flat(pairs(spark, sf_dir))


@query("c_self", PREVIOUS + FLAT + ' WHERE original = "new"')
def self_conflicts(spark, sf_dir):
    return flat(pairs(spark, sf_dir).where("original = new"))


@query("c_unknown", PREVIOUS + FLAT + " WHERE original % 3 <> 0")
def unknown(spark, sf_dir):
    found = written(pairs(spark, sf_dir))
    return flat(C.only_unknown(found, known(found)))


@query("c_known", PREVIOUS + FLAT + " WHERE original % 3 = 0")
def known_only(spark, sf_dir):
    found = written(pairs(spark, sf_dir))
    return flat(C.only_known(found, known(found)))


@query("c_visible", PREVIOUS + 'SELECT original, "new", original % 3 = 0 AS is_known, any_enabled AND original % 3 <> 0 AS shown FROM p')
def visible(spark, sf_dir):
    return shown(spark, sf_dir).select("original", "new", "is_known", "shown")


@query("c_visible_with_known", PREVIOUS + 'SELECT original, "new", any_enabled AS shown FROM p')
def visible_with_known(spark, sf_dir):
    return shown(spark, sf_dir, show_known=True).select("original", "new", "shown")


STATUS = """, t AS (
  SELECT DISTINCT c.event_type AS type, p.original, p."new", p.any_enabled AND p.original % 3 <> 0 AS shown, p.original % 3 = 0 AS known
  FROM c JOIN p ON c.original = p.original AND c.user_id = p."new"
)
SELECT type, CASE WHEN bool_or(NOT shown AND NOT known) THEN 'NotVisible' WHEN bool_or(shown) THEN 'FoundVisible' ELSE 'NotFound' END AS status FROM t GROUP BY type
"""


@query("c_type_status", PREVIOUS + STATUS)
def type_status(spark, sf_dir):
    return C.type_status(shown(spark, sf_dir), F.col("types"))


@query("c_has_hidden", PREVIOUS + "SELECT coalesce(bool_or(NOT (any_enabled AND original % 3 <> 0) AND original % 3 <> 0), false) AS has_hidden FROM p")
def has_hidden(spark, sf_dir):
    return C.has_hidden(shown(spark, sf_dir))


@query("c_per_type", PREVIOUS + "SELECT event_type, count(*) AS n_keys FROM c WHERE original IS NOT NULL GROUP BY event_type")
def per_type(spark, sf_dir):
    return C.previous_owner(index_rows(spark, sf_dir), KEYS, "user_id", ["user_id", "event_id"]).groupBy("event_type").agg(F.count("*").alias("n_keys"))


@query("c_known_dedup", PREVIOUS + 'SELECT original, "new" FROM known UNION SELECT original, "new" FROM p WHERE "new" % 5 = 0')
def known_dedup(spark, sf_dir):
    found = written(pairs(spark, sf_dir).select("original", "new"))
    return C.add_known(known(found), found.where("new % 5 = 0").select("original", "new"))


@query("c_chain", PREVIOUS + "SELECT event_type, k, user_id, event_id, original FROM c WHERE original IS NOT NULL")
def chain(spark, sf_dir):
    return C.previous_owner(index_rows(spark, sf_dir), KEYS, "user_id", ["user_id", "event_id"]).select("event_type", "k", "user_id", "event_id", "original")


DUPLICATE = """
WITH r AS (
  SELECT d AS dir_ord, event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events, (VALUES (0), (1)) v(d) WHERE event_type <> 'error'
), c AS (
  SELECT *, lag(user_id) OVER (PARTITION BY event_type, k ORDER BY dir_ord, user_id, event_id) AS original FROM r
)
SELECT dir_ord, original, user_id AS "new", count(*) AS n_keys FROM c WHERE original IS NOT NULL GROUP BY ALL
"""


@query("c_duplicate_roots", DUPLICATE)
def duplicate_roots(spark, sf_dir):
    rows = index_rows(spark, sf_dir)
    both = rows.withColumn("dir_ord", F.lit(0)).unionByName(rows.withColumn("dir_ord", F.lit(1)))
    return C.conflict_groups(both, KEYS, "user_id", ["dir_ord", "user_id"], "event_id").drop("keys")


LINEITEM = """
WITH c AS (
  SELECT l_orderkey, lag(l_orderkey) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS original
  FROM lineitem WHERE l_returnflag <> 'R'
)
SELECT original, l_orderkey AS "new", count(*) AS n_keys FROM c WHERE original IS NOT NULL GROUP BY ALL
"""


@query("c_lineitem", LINEITEM)
def lineitem(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return C.conflict_groups(rows, ["l_partkey", "l_suppkey"], "l_orderkey", ["l_orderkey"], "l_linenumber").drop("keys")


@query("c_progress", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position, count(*) OVER () AS total FROM documents")
def progress(spark, sf_dir):
    return C.progress(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"]).select("doc_id", "position", "total")
