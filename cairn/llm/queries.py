"""The registered query of each operator, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, decontamination, html_text, language_id, ngram_join, quality_classifier, quality_rules, token_counts, toxicity, warc
from cairn.llm.common import fold, written

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fold(rows: DataFrame, n: int, out: int) -> DataFrame:
    """rows with held_out (fold n is `out`) behind doc_id."""
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.select("doc_id", (fold(F.col("doc_id"), n) == out).alias("held_out"), *rest)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranker = quality_classifier.fit(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    return with_fold(quality_classifier.score(docs, ranker), 4, 2)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return with_fold(toxicity.score(docs, network), 5, 0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    return with_fold(language_id.predict(docs, profiles), 3, 1)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), WORD_BPE, ids=False)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(stored_ledger(spark, sf_dir))


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' ledger as a table: policies and ablations never read texts again."""
    return written(quality_rules.ledger(table(spark, sf_dir, "documents")))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version does, from one ledger."""
    ledger = stored_ledger(spark, sf_dir)
    each = [quality_rules.ablations(ledger, v).select(F.lit(v).alias("version"), "*") for v in sorted(quality_rules.POLICIES)]
    return each[0].unionByName(each[1])


#: Two words of each language that often stand near each other, in this order.
NEAR = {"en": "the of", "de": "der die", "es": "de la", "fr": "de le"}


def word_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of documents where the words of a phrase stand in order with at most three others between, from a positional index."""
    terms = {w for p in NEAR.values() for w in decontamination.words(p)}
    index = written(decontamination.build_index(table(spark, sf_dir, "documents"), terms))
    return decontamination.phrase_matches(index, NEAR, slop=3)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), PIECE_BPE)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_ngram_join": op2_ngram_join,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_html_text": op5_html_text,
    "op6_decontamination": op6_decontamination,
    "op7_bpe": op7_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "rule_ablations": rule_ablations,
    "word_proximity": word_proximity,
}

LEDGER_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, w[i:i + 4] AS five FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM windows) WHERE c > 1
), inside AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, chr(32))) - greatest(len(w) - 1, 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
    coalesce(inside.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN inside USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 8 ELSE 0 END
  + CASE WHEN 2 * n_symbols > n_words THEN 16 ELSE 0 END + CASE WHEN 20 * n_dup_lines > n_words THEN 32 ELSE 0 END)::INTEGER AS failed FROM b
"""
OP8_SQL = f"SELECT *, failed = 0 AS kept FROM ({LEDGER_SQL})"

ABLATIONS_SQL = f"""
WITH ledger AS (
  {LEDGER_SQL}
), rules AS (
  SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('short_words', 4), ('long_words', 8), ('symbols', 16), ('repeated_lines', 32)) r(rule, bit)
), policies AS (
  SELECT * FROM (VALUES ('2', 63), ('base-1', 3)) p(version, mask)
)
SELECT version, rule, bit, count(*) FILTER (failed & bit > 0) AS n_failed, count(*) FILTER (failed & mask = bit) AS n_failed_alone,
  count(*) FILTER (failed & mask = 0) AS n_kept, count(*) FILTER (failed & mask & ~bit = 0) AS n_kept_without
FROM ledger, rules, policies WHERE bit & mask > 0 GROUP BY ALL
"""

PROXIMITY_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM documents
), places AS (
  SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM w
), phrases AS (
  SELECT * FROM (VALUES ('en', 'the', 'of'), ('de', 'der', 'die'), ('es', 'de', 'la'), ('fr', 'de', 'le')) p(phrase, x, y)
)
SELECT doc_id, phrase, i - 1 AS first, i - 1 + k AS last
FROM (SELECT doc_id, phrase, i, list_position(a[i + 1:i + 4], y) AS k FROM places JOIN phrases ON a[i] = x) WHERE k > 0
"""

OP6_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), w AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM words
), windows AS (
  SELECT id, least(len(a), 10) AS n, unnest(range(1, greatest(len(a) - 9, 1) + 1)) AS i, a FROM w WHERE kind = 'b' AND len(a) > 0
), phrases AS (
  SELECT DISTINCT id AS item_id, n, array_to_string(a[i:i + n - 1], ' ') AS p FROM windows
), sizes AS (
  SELECT DISTINCT n FROM phrases
), spots AS (
  SELECT id, n, unnest(range(1, len(a) - n + 2)) AS i, a FROM w, sizes WHERE kind = 'd' AND len(a) >= n
), found AS (
  SELECT s.id, s.n, s.i, p.item_id FROM (SELECT id, n, i, array_to_string(a[i:i + n - 1], ' ') AS p FROM spots) s JOIN phrases p USING (n, p)
), hit AS (
  SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT id, unnest(range(i, i + n)) AS k FROM found) GROUP BY id
), items AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item_id::VARCHAR AS item FROM found) GROUP BY id
)
SELECT w.id AS doc_id, len(a)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (id) LEFT JOIN items USING (id) WHERE kind = 'd'
"""

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x : x <> '') AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(a[i:i + 4], ' ') AS g FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 4, 1) + 1)) AS i FROM w WHERE len(a) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), near AS (
  SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE c >= 0.8 * (p.n + q.n - c)
), reach AS (
  SELECT a, b FROM near UNION SELECT r.a, near.b FROM reach r JOIN near ON near.a = r.b
)
SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id, coalesce(links, 0)::BIGINT AS n_links
FROM documents LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = doc_id
LEFT JOIN (SELECT a, count(*) AS links FROM near GROUP BY a) l ON l.a = doc_id
"""

OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS k FROM p
), b AS (
  SELECT page_id, string_agg(to_base(('0x' || s[i * 5 + 1:i * 5 + 5])::BIGINT, 32, 4), '' ORDER BY i) AS t FROM d, (SELECT unnest(range(0, 8)) AS i) GROUP BY page_id
)
SELECT page_id, payload_bytes, translate(lower(t), '0123456789abcdefghijklmnopqrstuv', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = k THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> k THEN k END AS refers_to
FROM d JOIN b USING (page_id)
"""

ORACLE_SQL = {
    "op2_ngram_join": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op6_decontamination": OP6_SQL,
    "op8_quality_rules": OP8_SQL,
    "rule_ablations": ABLATIONS_SQL,
    "word_proximity": PROXIMITY_SQL,
}
