"""Every query and stage over empty tables and over tables with odd rows and more columns."""

import pytest

import corpus_pipeline
from cairn.llm import queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, node long, hashes string, shard int"
TABLES = {
    "documents": DOCUMENTS,
    "labels": "doc_id long, quality int, toxic int, text string",
    "pages": "page_id long, url string, html string, digest string, text string",
    "benchmark": "item_id long, text string, doc_id long",
}
LONG = "lorem ipsum dolor sit amet " * 30_000
ROWS = {
    "documents": [
        (1, None, None, None, None, None, None, None, None, None),
        (None, "no id here at all", "en", "s", 1, 0.5, 1, 1, "h", 1),
        (3, "", "en", "s", 0, 0.5, 1, 1, "h", 1),
        (4, LONG, "xx", "s", 1, 0.5, 1, 1, "h", 1),
        (5, "The cat sat on the mat and went away.", "en", "s", 1, 0.5, 1, 1, "h", 1),
        (5, "The cat sat on the mat and went away.", "en", "s", 1, 0.5, 1, 1, "h", 1),
        (6, "the cat sat on  the mat AND went away.", "en", "s", 1, 0.5, 1, 1, "h", 1),
        (7, "%%% $$$ ###\n%%% $$$ ###\n\x00\x1c\x85", "fr", "s", 1, 0.5, 1, 1, "h", 1),
    ],
    "labels": [(5, 1, 0, "t"), (5, 1, 0, "t"), (7, 0, 1, None), (None, 1, 1, "t"), (4, None, None, "t"), (99, 1, 0, "t")],
    "pages": [(1, "u", None, "d", "t"), (1, "u", None, "d", "t"), (None, None, "<p>x", "d", "t"), (4, "v", LONG, "d", "t")],
    "benchmark": [(1, "the cat sat on the mat", 1), (2, None, 2), (None, "went", 3), (2, "!!", 4)],
}


def saved(spark, folder, rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}"


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return saved(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return saved(spark, tmp_path_factory.mktemp("odd"), ROWS)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd(spark, odd, name):
    got = queries.QUERIES[name](spark, odd).collect()
    if not name.startswith("op"):
        return
    assert len(got) == len(ROWS["pages" if name in ("op3_warc", "op5_html_text") else "documents"])


def test_odd_results(spark, odd):
    by = lambda name: {r["doc_id"]: r for r in queries.QUERIES[name](spark, odd).collect()}
    near = by("op2_ngram_join")
    assert (near[6]["class_id"], near[6]["n_links"], near[5]["n_links"], near[None]["class_id"]) == (5, 2, 2, None)
    hit = by("op6_decontamination")
    assert (hit[5]["n_hit"], hit[5]["n_items"], hit[1]["n_words"], hit[4]["contaminated"]) == (7, 1, 0, False)
    langs = by("op10_language_id")
    assert langs[1]["lang_pred"] == langs[3]["lang_pred"] == langs[7]["lang_pred"] == "und"
    assert by("op9_token_counts")[4]["over_limit"] and by("op8_quality_rules")[4]["base_failed"]


@pytest.mark.parametrize("which", ["empty", "odd"])
def test_stages(spark, request, which):
    folder = request.getfixturevalue(which)
    docs = queries.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        assert got.count() <= docs.count()
    assert corpus_pipeline.run(spark, folder).count() <= docs.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    """Rows and types as DuckDB gives them, on the smallest tables."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, folder).toArrow(), duck.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t[c].to_pylist() for c in columns))))
    assert got.num_rows == want.num_rows and rows(got) == rows(want)
