"""Queries on rows as larger tables have them, which the smallest tables lack."""

from __future__ import annotations

import duckdb

from loomline.plans import catalogue, more  # noqa: F401  more adds to the catalogue


def differs(spark, folder, name, **tables):
    """Rows by which a query and its SQL differ, over tables of so many SQL rows."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert want
    return set(map(repr, want)) ^ set(map(repr, got)), len(want) - len(got)


def test_models_with_keys_beyond_a_million(spark, tmp_path):
    part = "SELECT k::BIGINT AS p_partkey, 'hot bolt' AS p_name, 'Brand#' || (k % 30) AS p_brand, 'SMALL' AS p_type, (k % 50 + 1)::INTEGER AS p_size, 900.0::DOUBLE AS p_retailprice FROM range(999000, 1003000) r(k)"
    assert differs(spark, tmp_path, "catalog_validate", part=part) == (set(), 0)


def test_numbers_beyond_ten_thousand_trillions(spark, tmp_path):
    lineitem = "SELECT k::BIGINT AS l_orderkey, (k * 40)::BIGINT AS l_partkey, (k * 2)::BIGINT AS l_suppkey, (k % 7 + 1)::INTEGER AS l_linenumber FROM range(1, 30000, 7) r(k)"
    assert differs(spark, tmp_path, "compact_numbers", lineitem=lineitem) == (set(), 0)


def classifications(df, once=None):
    """How often a plan counts the words of texts, which each classification of a scan does as often."""
    n = df._jdf.queryExecution().optimizedPlan().toString().count("array_remove")
    return n if once is None else n / once


def test_words_without_a_match_for_each(spark):
    """By cutting at blanks: a pattern's matches cost most of a scan."""
    from pyspark.sql import functions as F

    from loomline.functions import tokens

    blanks = " \t\n\x0b\x0c\r\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    texts = ["", " ", "\n", "a", " a", "a ", " a  b\n\nc ", "a\tb", "\xe9 \xfc", "\u6f22\u5b57\u3000\u6f22", "a\u200bb", "\u201ca\u201d \u2013 b\u2014c", "x" * 5000, None] + [f"a{b}b {b}{b}c{b}" for b in blanks] + [f"é{b}b" for b in blanks]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", tokens.estimate(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [tokens.estimate_text(t or "") for t in texts]
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_scans_are_classified_once(spark, monkeypatch):
    from loomline.operators import reports

    made = {q: catalogue.QUERIES[q](spark, "/root/testdata/sf0.001") for q in ("language_breakdown", "batch_files", "batch_budget_fit", "cache_hits", "map_trim_order", "map_display_order")}
    once = classifications(made["language_breakdown"])
    assert once and {q: classifications(df, once) for q, df in made.items()} == dict.fromkeys(made, 1) | {"map_display_order": 0}  # a table when it is sorted
    given = []
    monkeypatch.setattr(reports, "to_markdown", lambda told, scan: given.append(scan) or "")
    catalogue.QUERIES["workspace_report"](spark, "/root/testdata/sf0.001")
    assert classifications(given[0]) == 0


def test_python_sees_few_rows_at_once(spark, monkeypatch):
    """Of a batch of thousands, so that a worker's memory doesn't follow the batch."""
    import pyarrow as pa

    from loomline.functions.batches import ROWS, slices

    parts = list(slices(pa.array(["a", None] * 1000)))
    assert max(map(len, parts)) == ROWS and sum(parts, []) == ["a", None] * 1000
    from loomline.operators import symbols

    odd = [("a.ts", "class A { m() {} }\nimport './b'"), ("b.ts", None), ("c.ts", "")] * 400
    got = symbols.parsed_scripts(spark.createDataFrame(odd, "path string, text string").coalesce(1), [".ts"]).collect()
    assert [r.path for r in got] == [p for p, _ in odd]
    assert [(s.name, s.kind, s.line_start) for s in got[0].symbols] == [("A", "class", 1), ("A.m", "method", 1)] and [i.source for i in got[-3].imports] == ["./b"] and got[1].symbols == [] and got[1].error is None


DRIFTS = ("drift_files", "drift_directories", "drift_largest_directories", "drift_summary", "drift_violations", "drift_top_growing", "drift_top_shrinking")


def test_a_text_is_lowered_once(spark):
    """Neither a generator nor a filter shares what several of its words' searches need."""
    for q in ("language_breakdown", "secret_content"):
        plan = catalogue.QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lower(text") + plan.count("lower(replace(text") == 1, q


def test_secrets_are_found_by_any_anchor(spark):
    import re

    from pyspark.sql import functions as F

    from loomline.functions import files

    long = "Ab1_" * 12
    texts = [f'x {k}{sign}"{long}"' for k in ("API_key", "api-KEY", "apikey", "Access_Token", "access-token", "accesstoken", "PassWord", "passwd", "PWD", "secret", "api", "access", "passw", "ghp") for sign in ("=", " : ", "")]
    texts += [f"ghp_{'a1' * 18}", f"GHP_{'a1' * 18}", f"ghs_{'a1' * 18}", f"sk-live_{'a' * 20}", f"AIza{'0' * 35}", "-----BEGIN EC PRIVATE KEY-----", "", "api access passw", None]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", files.secret_text(F.col("text")).alias("s")).orderBy("i").collect()]
    assert got == [any(re.search(p, t or "") for p in files.SECRET_TEXT) for t in texts] and any(got) and not all(got)


def test_drift_classifies_a_text_of_both_scans_once(spark, monkeypatch):
    from loomline.operators import drift

    sf = "/root/testdata/sf0.001"
    once = classifications(catalogue.QUERIES["language_breakdown"](spark, sf))
    made = {q: catalogue.QUERIES[q](spark, sf) for q in DRIFTS}
    assert {q: classifications(df, once) for q, df in made.items()} == dict.fromkeys(DRIFTS, 1)
    assert {q: df._jdf.queryExecution().optimizedPlan().toString().count("Relation") for q, df in made.items()} == dict.fromkeys(DRIFTS, 1)
    kept = []
    monkeypatch.setattr(drift.scratch, "table", lambda df, name, put=drift.scratch.table: kept.append(df) or put(df, name))
    catalogue.QUERIES["drift_markdown"](spark, sf)
    assert [classifications(df, once) for df in kept] == [1]


def test_versions_drift_as_their_scans_do(spark):
    from pyspark.sql import functions as F

    from loomline.operators import drift

    rows = [
        (0, "a", 10, [], True, True), (1, "b", 5, ["x"], True, False), (1, "b", 7, ["x", "y"], False, True), (2, "a", 20, ["z", "z"], True, False), (3, "gone", 1, [], True, False), (4, "w\\new", 7, ["x"], False, True),
        (5, "w/new", 9, None, False, True), (6, "none", 3, [], False, False), (7, "zero", 0, [], True, True), (8, "c", None, None, True, True), (9, "d", 4, ["x"], None, True), (None, "e", 4, [], True, True),
    ]
    both = spark.createDataFrame(rows, "ord long, path string, estimated_tokens long, risk_flags array<string>, in_base boolean, in_now boolean")
    key = lambda r: r.path
    want = sorted(drift.file_drift(both.where("in_base"), both.where("in_now")).collect(), key=key)
    assert sorted(drift.file_drift(both).collect(), key=key) == want and len(want) == 8
    assert drift.summary(drift.file_drift(both.where(F.lit(False)))).first().asDict() == dict.fromkeys(("added", "removed", "modified", "unchanged", "new_flags", "base_tokens", "current_tokens", "net"), 0) | {"percent": 0.0}
