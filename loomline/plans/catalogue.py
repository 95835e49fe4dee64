"""Queries of the workspace analytics operators over the synthetic tables, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import files as rules
from loomline.functions import paths, tokens
from loomline.operators import compaction, drift, git, repo_map, reports, symbols, workspace
from loomline.operators import models as catalog
from loomline.plans import proxies
from loomline.plans.proxies import BOTH, MODELS, SCAN, change, estimate, fixed
from loomline.sources.rules import with_ignored

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query under its function's name, with its SQL."""

    def put(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def joined(c: str) -> object:
    return F.array_join(c, ",").alias(c)


# Token estimates


@query(f"SELECT doc_id, {estimate('text')}::BIGINT AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.documents(spark, sf).select("doc_id", tokens.estimate(F.col("text")).alias("tokens"))


@query(SCAN + " SELECT path, extension, estimated_tokens FROM scan")
def file_token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.scan(spark, sf).select("path", "extension", "estimated_tokens")


@query("SELECT doc_id, greatest(1, ceil(coalesce(strlen(text), 0) / 4.0::DOUBLE))::BIGINT AS tokens FROM documents")
def token_from_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.documents(spark, sf).select("doc_id", tokens.estimate_bytes(F.coalesce(F.octet_length("text"), F.lit(0))).alias("tokens"))


_COUNT = lambda p: f"len(regexp_extract_all(coalesce(text, ''), '{p}'))"
_DENSITY = f"""
WITH a AS (SELECT doc_id, coalesce(length(text), 0) AS n, {_COUNT('[ \\t\\r\\n]')} AS blank, {_COUNT('[!-/:-@\\[-`{-~]')} AS marks, {_COUNT('[^\\x00-\\x7F]')} AS foreign_, {_COUNT('[A-Za-z0-9_]+')} AS words, {_COUNT('[A-Za-z0-9_]')} AS letters, CASE WHEN n = 0 THEN 0 ELSE {_COUNT('\\n')} + 1 END AS lines FROM documents),
b AS (SELECT *, {fixed('marks / greatest(1, n - blank)::DOUBLE', 4)} AS p, {fixed('blank / greatest(1, n)::DOUBLE', 4)} AS w, {fixed('foreign_ / greatest(1, n)::DOUBLE', 4)} AS o, CASE WHEN words > 0 THEN {fixed('letters / greatest(words, 1)::DOUBLE', 2)} ELSE 0.0::DOUBLE END AS l, CASE WHEN n = 0 THEN 0 ELSE greatest(1, ceil(n / 3.8::DOUBLE)) END AS raw FROM a),
c AS (SELECT *, 1.0::DOUBLE + (CASE WHEN p > 0.28::DOUBLE THEN 0.35::DOUBLE WHEN p > 0.18::DOUBLE THEN 0.18::DOUBLE WHEN p < 0.08::DOUBLE THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END)
  + (CASE WHEN o > 0.15::DOUBLE THEN 0.65::DOUBLE WHEN o > 0.03::DOUBLE THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN w > 0.45::DOUBLE THEN -0.25::DOUBLE WHEN w > 0.32::DOUBLE THEN -0.12::DOUBLE WHEN w < 0.12::DOUBLE THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END)
  + (CASE WHEN l > 0 AND l < 2.5::DOUBLE THEN 0.25::DOUBLE WHEN l > 8 THEN -0.08::DOUBLE ELSE 0.0::DOUBLE END) AS m0 FROM b),
d AS (SELECT *, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE {fixed('greatest(0.65::DOUBLE, least(2.2::DOUBLE, m0))', 3)} END AS multiplier FROM c)
"""


@query(_DENSITY + "SELECT doc_id, n AS chars, lines, words, p AS punctuation_ratio, w AS whitespace_ratio, o AS non_ascii_ratio, l AS average_word, multiplier, raw::BIGINT AS raw_tokens, (CASE WHEN n = 0 THEN 0 ELSE greatest(1, floor(raw * multiplier + 0.5::DOUBLE)) END)::BIGINT AS tokens, CASE WHEN multiplier >= 1.25::DOUBLE THEN 'dense' WHEN multiplier <= 0.85::DOUBLE THEN 'sparse' ELSE 'balanced' END AS density FROM d")
def token_density(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.with_density(proxies.documents(spark, sf).select("doc_id", "text"), out="d").select("doc_id", "d.*")


@query(_DENSITY + "SELECT CASE WHEN multiplier >= 1.25::DOUBLE THEN 'dense' WHEN multiplier <= 0.85::DOUBLE THEN 'sparse' ELSE 'balanced' END AS density, count(*) AS texts FROM d GROUP BY 1")
def density_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_density(spark, sf).groupBy("density").agg(F.count(F.lit(1)).alias("texts"))


@query(f"SELECT role, count(*) AS turns, sum({estimate('text')})::BIGINT AS tokens FROM conversations GROUP BY role")
def conversation_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(tokens.estimate(F.col("text"))).alias("tokens"))


@query(f"SELECT doc_id, (CASE WHEN coalesce(strlen(text), 0) % 7 = 3 THEN {estimate('text')} ELSE coalesce(strlen(text), 0) END)::BIGINT AS tokens FROM documents")
def provider_tokens(spark: SparkSession, sf: str) -> DataFrame:
    own = lambda t: -1 if len(t.encode()) % 7 == 3 else len(t.encode())  # noqa: E731  a provider that fails at times
    return proxies.documents(spark, sf).select("doc_id", tokens.with_provider(F.col("text"), own).alias("tokens"))


# Files


@query(SCAN + " SELECT path, base, folder, extension FROM scan")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return proxies.files(spark, sf).select("path", paths.basename(p).alias("base"), paths.dirname(p).alias("folder"), paths.extension(p).alias("extension"))


@query(SCAN + " SELECT path, language FROM scan")
def language_of_file(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.files(spark, sf).select("path", rules.language(F.col("path")).alias("language"))


@query(SCAN + " SELECT path, array_to_string(risk_flags, ',') AS risk_flags FROM scan")
def risk_flags(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.scan(spark, sf).select("path", joined("risk_flags"))


def _flag(test: object, sf_files: DataFrame) -> DataFrame:
    return sf_files.where(test).select("path")


@query(SCAN + " SELECT path FROM scan WHERE named")
def secret_files(spark: SparkSession, sf: str) -> DataFrame:
    return _flag(rules.secret_name(F.col("path")), proxies.files(spark, sf))


@query(SCAN + " SELECT path FROM scan WHERE list_contains(risk_flags, 'secret') AND NOT named")
def secret_content(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return _flag(~rules.secret_name(p) & ~rules.is_binary(p) & rules.secret_text(F.col("text")), proxies.files(spark, sf))


@query(SCAN + " SELECT path FROM scan WHERE list_contains(risk_flags, 'database-dump')")
def db_dump_flag(spark: SparkSession, sf: str) -> DataFrame:
    return _flag(rules.is_dump(F.col("path")), proxies.files(spark, sf))


@query(SCAN + " SELECT path FROM scan WHERE list_contains(risk_flags, 'generated')")
def generated_flag(spark: SparkSession, sf: str) -> DataFrame:
    return _flag(rules.is_generated(F.col("path")), proxies.files(spark, sf))


@query(SCAN + " SELECT path FROM scan WHERE list_contains(risk_flags, 'build-output')")
def build_output_flag(spark: SparkSession, sf: str) -> DataFrame:
    return _flag(rules.in_build(F.col("path")), proxies.files(spark, sf))


@query(SCAN + " SELECT path, included, excluded_reason FROM scan")
def included_and_reason(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.scan(spark, sf).select("path", "included", "excluded_reason")


_SUMS = "count(*) AS total_files, count_if(included) AS included_files, count_if(NOT included) AS excluded_files, sum(bytes)::BIGINT AS total_bytes"


@query(SCAN + f" SELECT {_SUMS}, sum(CASE WHEN included THEN bytes ELSE 0 END)::BIGINT AS included_bytes, sum(estimated_tokens)::BIGINT AS total_tokens, sum(CASE WHEN included THEN estimated_tokens ELSE 0 END)::BIGINT AS included_tokens FROM scan")
def workspace_stats(spark: SparkSession, sf: str) -> DataFrame:
    return workspace.stats(proxies.scan(spark, sf))


@query(SCAN + f" SELECT folder, {_SUMS}, sum(estimated_tokens)::BIGINT AS total_tokens, min(ord) AS ord FROM scan GROUP BY folder")
def folder_stats(spark: SparkSession, sf: str) -> DataFrame:
    return workspace.folders(proxies.scan(spark, sf))


_RECURSIVE = ", up AS (SELECT s.estimated_tokens, unnest(list_concat(['.'], list_transform(range(1, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[1:n], '/')))) AS folder FROM scan s WHERE included), rec AS (SELECT folder, sum(estimated_tokens)::BIGINT AS tokens, count(*) AS files FROM up GROUP BY folder)"


@query(SCAN + _RECURSIVE + " SELECT * FROM rec")
def folder_recursive_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return workspace.recursive_folders(proxies.scan(spark, sf))


@query(SCAN + " SELECT language, count(*) AS file_count, sum(bytes)::BIGINT AS total_bytes, sum(estimated_tokens)::BIGINT AS total_tokens, min(ord) AS ord, CASE WHEN sum(sum(estimated_tokens)) OVER () > 0 THEN sum(estimated_tokens)::DOUBLE / (sum(sum(estimated_tokens)) OVER ())::DOUBLE ELSE 0.0::DOUBLE END AS percentage FROM scan WHERE included GROUP BY language")
def language_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return workspace.languages(proxies.scan(spark, sf))


@query(SCAN + " SELECT flag, count(*) AS files, sum(estimated_tokens)::BIGINT AS tokens FROM (SELECT unnest(risk_flags) AS flag, estimated_tokens FROM scan) GROUP BY flag")
def risk_flag_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return workspace.flag_counts(proxies.scan(spark, sf))


@query(SCAN + " SELECT path, estimated_tokens FROM scan WHERE included ORDER BY estimated_tokens DESC, ord LIMIT 10")
def top10_files(spark: SparkSession, sf: str) -> DataFrame:
    return workspace.top_files(proxies.scan(spark, sf)).select("path", "estimated_tokens")


@query(SCAN + _RECURSIVE + ", dir AS (SELECT folder, min(ord) AS ord FROM scan GROUP BY folder HAVING count_if(included) > 0) SELECT folder, tokens FROM dir JOIN rec USING (folder) ORDER BY tokens DESC, ord LIMIT 10")
def top10_folders(spark: SparkSession, sf: str) -> DataFrame:
    return workspace.top_folders(proxies.scan(spark, sf)).select("folder", "tokens")


@query(SCAN + " SELECT count(*) AS requested, count(s.bytes) AS readable, coalesce(sum(s.estimated_tokens), 0)::BIGINT AS tokens, coalesce(sum(s.bytes), 0)::BIGINT AS bytes, coalesce(sum(s.estimated_tokens), 0) <= 100000 AS fits, " + fixed("coalesce(sum(s.estimated_tokens), 0) / 100000.0::DOUBLE * 100", 2) + " AS utilisation FROM (SELECT path FROM scan UNION ALL SELECT 'missing') w LEFT JOIN scan s USING (path)")
def batch_budget_fit(spark: SparkSession, sf: str) -> DataFrame:
    scan = proxies.scan(spark, sf)
    wanted = proxies.files(spark, sf).select("path").union(spark.createDataFrame([("missing",)], "path string"))
    return workspace.batch_fit(scan, wanted, 100_000)


@query(SCAN + " SELECT path, ord % 4 <> 1 AND ord % 2 = 0 AS cache_hit, CASE WHEN ord % 4 <> 1 AND ord % 2 = 0 THEN 7 ELSE estimated_tokens END::BIGINT AS estimated_tokens FROM scan")
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    scan = proxies.scan(spark, sf).withColumn("mtime", F.col("ord") * 1000)
    known = proxies.files(spark, sf).where("ord % 2 = 0").withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))  # a cache has its own tokens, so its files aren't classified
    cache = known.select("path", "bytes", (F.col("ord") * 1000 + F.when(F.col("ord") % 4 == 1, 1).otherwise(0)).alias("mtime"), F.lit(7).cast("long").alias("estimated_tokens"))
    return workspace.with_cache(scan, cache).select("path", "cache_hit", "estimated_tokens")


@query(SCAN + r" SELECT path, (regexp_matches(path, '\.log$') AND base <> 'keep.log') OR regexp_matches(path, '(^|/)dist/') OR regexp_matches(path, '^docs/(.*/)?[^/]*\.md$') OR regexp_matches(path, '^packages/(.*/)?src7/') AS ignored FROM scan")
def gitignore_match(spark: SparkSession, sf: str) -> DataFrame:
    files = proxies.files(spark, sf)
    nested = files.sparkSession.createDataFrame([("packages", ["src7/"])], "folder string, lines array<string>")
    return with_ignored(files.select("path"), ["*.log", "dist/", "!keep.log", "/docs/**/*.md"], nested)


# Drift


@query(BOTH + " SELECT path, status, base_tokens, current_tokens, delta, percent, array_to_string(added_flags, ',') AS added_flags, array_to_string(removed_flags, ',') AS removed_flags FROM drift")
def drift_files(spark: SparkSession, sf: str) -> DataFrame:
    return drift.file_drift(proxies.changed(spark, sf)).withColumn("added_flags", joined("added_flags")).withColumn("removed_flags", joined("removed_flags")).drop("base_all", "current_all")


_FOLDERS = ", per AS (SELECT folder, sum(base_tokens)::BIGINT AS base_tokens, sum(current_tokens)::BIGINT AS current_tokens, sum(CASE status WHEN 'added' THEN 1 WHEN 'removed' THEN -1 ELSE 0 END)::BIGINT AS net_files FROM drift GROUP BY folder), dirs AS (SELECT *, current_tokens - base_tokens AS delta, " + change("base_tokens", "current_tokens") + " AS percent FROM per)"


@query(BOTH + _FOLDERS + " SELECT * FROM dirs")
def drift_directories(spark: SparkSession, sf: str) -> DataFrame:
    return drift.folder_drift(drift.file_drift(proxies.changed(spark, sf)))


@query(BOTH + _FOLDERS + " SELECT *, row_number() OVER (ORDER BY abs(delta) DESC, folder)::INTEGER AS rank FROM dirs QUALIFY rank <= 15")
def drift_largest_directories(spark: SparkSession, sf: str) -> DataFrame:
    return drift.largest_folders(drift_directories(spark, sf))


_SUMMARY = ", counts AS (SELECT count_if(status = 'added') AS added, count_if(status = 'removed') AS removed, count_if(status = 'modified') AS modified, count_if(status = 'unchanged') AS unchanged, sum(len(added_flags))::BIGINT AS new_flags FROM drift), tot AS (SELECT counts.*, (SELECT sum(estimated_tokens)::BIGINT FROM base_scan) AS base_tokens, (SELECT sum(estimated_tokens)::BIGINT FROM current_scan) AS current_tokens FROM counts), summ AS (SELECT *, current_tokens - base_tokens AS net, " + change("base_tokens", "current_tokens") + " AS percent FROM tot)"


@query(BOTH + _SUMMARY + " SELECT * FROM summ")
def drift_summary(spark: SparkSession, sf: str) -> DataFrame:
    return drift.summary(drift.file_drift(proxies.changed(spark, sf)))


@query(BOTH + " SELECT path, delta FROM drift WHERE delta > 0 ORDER BY delta DESC, path LIMIT 10")
def drift_top_growing(spark: SparkSession, sf: str) -> DataFrame:
    return drift.top_growing(drift.file_drift(proxies.changed(spark, sf))).select("path", "delta")


@query(BOTH + " SELECT path, delta FROM drift WHERE delta < 0 ORDER BY delta, path LIMIT 10")
def drift_top_shrinking(spark: SparkSession, sf: str) -> DataFrame:
    return drift.top_shrinking(drift.file_drift(proxies.changed(spark, sf))).select("path", "delta")


@query(BOTH + _SUMMARY + " SELECT * FROM (SELECT 'token-increase' AS rule, net::DOUBLE AS value, -1000000000.0::DOUBLE AS bound FROM summ UNION ALL SELECT 'percent', percent, 5.0 FROM summ UNION ALL SELECT 'new-risk-flags', new_flags::DOUBLE, 0.0 FROM summ UNION ALL SELECT 'file-count', (added - removed)::DOUBLE, 3.0 FROM summ) WHERE value > bound")
def drift_violations(spark: SparkSession, sf: str) -> DataFrame:
    return drift.violations(drift_summary(spark, sf), -1_000_000_000, 5.0, True, 3)


# Models

_CACHED = "coalesce(cached_price, input_price)"
_BLENDED = "((3 * input_price + output_price) / 4)"
_COMPOSITE = fixed(f"0.7::DOUBLE * coalesce(coding_score, 50.0) + 0.3::DOUBLE * (CASE WHEN {_BLENDED} = 0 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, 100 - 6 * {_BLENDED}) END)", 2)


@query(MODELS + f" SELECT id, {_COMPOSITE} AS composite FROM models WHERE (contains(lower(id), '1') OR contains(lower(display_name), '1') OR contains(lower(provider), '1')) AND lower(provider) <> 'brand#11' AND supports_tools AND context_window >= 200000 AND input_price <= 10 AND coding_score >= 20 ORDER BY composite DESC, ord LIMIT 20 OFFSET 5")
def catalog_filter_page(spark: SparkSession, sf: str) -> DataFrame:
    kept = catalog.select(proxies.models(spark, sf), search=" 1 ", not_providers=["BRAND#11"], tools=True, min_context=200_000, max_input_price=10, min_coding=20)
    return catalog.page(kept, offset=5, limit=20).select("id", "composite")


@query(MODELS + " SELECT id, input_price FROM models ORDER BY input_price, ord LIMIT 50")
def catalog_sort_cost(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.page(proxies.models(spark, sf), "input_price", descending=False).select("id", "input_price")


@query(MODELS + f" SELECT id, {_COMPOSITE} AS composite FROM models")
def catalog_composite(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.models(spark, sf).select("id", catalog.composite().alias("composite"))


@query(MODELS + f" SELECT count(*) AS models, count(DISTINCT provider) AS providers, {fixed('avg(input_price)', 3)} AS average_input_price, {fixed('avg(output_price)', 3)} AS average_output_price, {fixed('avg(coding_score)', 1)} AS average_coding_score, count_if(supports_local OR privacy_mode = 'local') AS local, count_if(NOT (supports_local OR privacy_mode = 'local')) AS cloud FROM models")
def catalog_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.aggregates(proxies.models(spark, sf))


@query(MODELS + " SELECT provider, count(*) AS models, min(ord) AS first FROM models GROUP BY provider")
def catalog_provider_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.provider_counts(proxies.models(spark, sf))


@query(MODELS + " SELECT id, ord, (row_number() OVER (PARTITION BY ord, id ORDER BY k) - 1)::INTEGER AS n, message FROM (SELECT id, ord, 2 AS k, 'duplicate id' AS message FROM (SELECT id, ord + 1000000 AS ord FROM models WHERE ord % 40 = 0) UNION ALL SELECT id, ord, 17, 'invalid updated_at' FROM models WHERE bad_date UNION ALL SELECT id, ord + 1000000, 17, 'invalid updated_at' FROM models WHERE bad_date AND ord % 40 = 0 UNION ALL SELECT id, ord, 3, 'missing display_name' FROM models WHERE ord % 33 = 0)")
def catalog_validate(spark: SparkSession, sf: str) -> DataFrame:
    own = proxies.models(spark, sf)
    again = own.where("ord % 40 = 0").withColumn("ord", F.col("ord") + 1_000_000)
    return catalog.errors(own.withColumn("display_name", F.when(F.col("ord") % 33 == 0, " ").otherwise(F.col("display_name"))).unionByName(again))


@query(MODELS + " SELECT id, provider IN ('Brand#11', 'Brand#22') AND id IN ('3', '15') AS preferred FROM models WHERE provider IN ('Brand#11', 'Brand#22')")
def catalog_profile(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.profile(proxies.models(spark, sf), providers=["Brand#11", "Brand#22"], preferred=["3", "15"]).select("id", "preferred")


@query(MODELS + " SELECT id FROM models WHERE context_window >= 500000")
def catalog_context_fit(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.select(proxies.models(spark, sf), min_context=500_000).select("id")


def _cost(i: str, c: str, o: str) -> str:
    return f"(({i}) - ({c})) / 1000000.0::DOUBLE * input_price + ({c}) / 1000000.0::DOUBLE * {_CACHED} + ({o}) / 1000000.0::DOUBLE * output_price"


@query(MODELS + f" SELECT id, {_cost('50000', '20000', '3000')} AS total_cost FROM models")
def cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.costs(proxies.models(spark, sf), 50_000, 3_000, 20_000).select("id", "total_cost")


@query(MODELS + f" SELECT id, {_cost('120000', '0', 'max_output_tokens')} AS prompt_cost, ({_cost('96000', '84000', 'floor(max_output_tokens * 0.5::DOUBLE + 0.5)')}) * 10 AS run_cost, ({_cost('96000', '84000', 'floor(max_output_tokens * 0.5::DOUBLE + 0.5)')}) * 50 AS milestone_cost FROM models")
def session_cost(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.session_costs(proxies.models(spark, sf), 120_000).select("id", "prompt_cost", "run_cost", "milestone_cost")


_NEED, _OUT = 180_000, 8000
_SCORED = MODELS + f""", s1 AS (SELECT *, {_cost(str(_NEED), '54000', str(_OUT))} AS cost, context_window >= {_NEED} AS fits, context_window / {_NEED}.0::DOUBLE AS ratio, coalesce(coding_score, 50.0) / 100 AS coding, coalesce(reasoning_score, coding_score, 50.0) / 100 AS reasoning FROM models),
s2 AS (SELECT *, CASE WHEN ratio >= 2 THEN 1.0::DOUBLE WHEN ratio >= 1 THEN 0.8::DOUBLE WHEN ratio >= 0.75 THEN 0.5::DOUBLE ELSE ratio END AS context_fit, least(1.0::DOUBLE, 0.65::DOUBLE * coding + 0.25::DOUBLE * reasoning + CASE WHEN supports_tools THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) AS task_fit,
  CASE WHEN cost <= 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - cost / 0.05::DOUBLE) END AS cost_fit, coalesce(latency_score / 100, 0.5) AS latency_fit, CASE privacy_mode WHEN 'local' THEN 1.0::DOUBLE WHEN 'hybrid' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS privacy_fit FROM s1),
scored AS (SELECT *, 0.35::DOUBLE * task_fit + 0.35::DOUBLE * cost_fit + 0.15::DOUBLE * context_fit + 0.05::DOUBLE * latency_fit + 0.1::DOUBLE * privacy_fit AS total, 0.55::DOUBLE * coding + 0.3::DOUBLE * reasoning + 0.15::DOUBLE * context_fit AS confidence,
  CASE WHEN fits THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, 1 - ratio) END AS overflow_risk, CASE WHEN total >= 0.7::DOUBLE THEN 'high' WHEN total >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS expected_quality FROM s2)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.score(proxies.models(spark, sf), 150_000, "build-mvp")


@query(_SCORED + " SELECT id, cost, fits, context_fit, task_fit, cost_fit, total, confidence, overflow_risk, expected_quality FROM scored")
def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("id", "cost", "fits", "context_fit", "task_fit", "cost_fit", "total", "confidence", "overflow_risk", "expected_quality")


@query(_SCORED + """, pool AS (SELECT * FROM scored WHERE fits OR NOT (SELECT bool_or(fits) FROM scored)),
a AS (SELECT * FROM pool ORDER BY cost, total DESC, id LIMIT 1), b AS (SELECT * FROM pool WHERE id NOT IN (SELECT id FROM a) ORDER BY total DESC, cost, id LIMIT 1),
c AS (SELECT * FROM pool WHERE id NOT IN (SELECT id FROM a UNION SELECT id FROM b) ORDER BY confidence DESC, total DESC, id LIMIT 1)
SELECT 'cheapest' AS tier, id, cost, total, confidence FROM a UNION ALL SELECT 'balanced', id, cost, total, confidence FROM b UNION ALL SELECT 'confidence', id, cost, total, confidence FROM c""")
def recommend_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.recommend(_scored(spark, sf)).select("tier", "id", "cost", "total", "confidence")


@query(_SCORED + " SELECT id, ord FROM scored WHERE NOT fits")
def recommend_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.rejected(_scored(spark, sf))


@query(_SCORED + """ SELECT id, array_to_string(list_filter([CASE WHEN context_fit >= 0.8::DOUBLE THEN 'Adequate context window (' || printf('%.0f', context_window / 1000.0::DOUBLE) || 'K tokens)' END, CASE WHEN cost_fit >= 0.7::DOUBLE THEN 'Cost-efficient for this task' END,
CASE WHEN coding_score >= 70 THEN 'Strong coding benchmarks (' || printf('%.0f', coding_score) || '/100)' END, CASE WHEN privacy_mode = 'local' THEN 'Runs entirely locally — no data leaves your machine' END, CASE WHEN supports_tools THEN 'Tool/function calling support' END, 'Good fit for "build mvp" goal'], lambda x: x IS NOT NULL), '; ') AS reasons FROM scored""")
def recommend_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("id", F.array_join(catalog.reasons("build-mvp"), "; ").alias("reasons"))


@query(_SCORED + """ SELECT id, array_to_string(list_filter([CASE WHEN NOT fits THEN 'Context window insufficient — overflow likely; consider repo-map-first strategy' END, CASE WHEN coding_score < 50 THEN 'Below-average coding benchmark scores' END], lambda x: x IS NOT NULL), '; ') AS warnings,
array_to_string(list_filter([CASE WHEN 150000 > context_window * 0.5::DOUBLE OR NOT fits THEN 'Use a repo map instead of full workspace to reduce context' END, 'Enable prompt caching if supported by your provider'], lambda x: x IS NOT NULL), '; ') AS suggestions FROM scored""")
def recommend_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("id", F.array_join(catalog.warnings(), "; ").alias("warnings"), F.array_join(catalog.suggestions(150_000), "; ").alias("suggestions"))


_PLANS = MODELS + f""", priced AS (SELECT *, (48000.0::DOUBLE - 24000.0::DOUBLE) / 1000000.0::DOUBLE * input_price + 24000.0::DOUBLE / 1000000.0::DOUBLE * {_CACHED} + 2000.0::DOUBLE / 1000000.0::DOUBLE * output_price AS run_cost FROM models),
p2 AS (SELECT *, run_cost * 1650.0::DOUBLE AS spend FROM priced), base AS (SELECT run_cost AS base_run_cost, spend AS base_spend FROM p2 WHERE id = '17'),
p3 AS (SELECT p2.*, base.*, base_spend - spend AS savings FROM p2, base WHERE id <> '17' AND context_window >= 150000),
plans AS (SELECT *, {fixed('savings / base_spend * 100', 1)} AS savings_percent, {fixed('spend / base_spend', 2)} AS cost_multiplier, {fixed('run_cost * 330.0::DOUBLE', 2)} AS cost_per_dev, {fixed('spend', 2)} AS monthly_spend, {fixed('savings', 2)} AS monthly_savings,
  CASE WHEN context_window / 200000.0::DOUBLE >= 1 THEN 1.0::DOUBLE ELSE greatest(0.1::DOUBLE, {fixed('context_window / 200000.0::DOUBLE', 2)}) END AS context_fit FROM p3)"""


def _plans(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.advice(proxies.models(spark, sf), "17", least_context=200_000)


@query(_PLANS + " SELECT id, savings, savings_percent, cost_multiplier, cost_per_dev, monthly_spend, monthly_savings, context_fit FROM plans")
def switch_plans(spark: SparkSession, sf: str) -> DataFrame:
    return _plans(spark, sf).select("id", "savings", "savings_percent", "cost_multiplier", "cost_per_dev", "monthly_spend", "monthly_savings", "context_fit")


@query(_PLANS + " SELECT id, savings FROM ((SELECT id, savings, 0 AS n FROM plans WHERE savings > 0 AND savings_percent >= 20 AND context_fit >= 0.9::DOUBLE ORDER BY savings DESC, ord LIMIT 1) UNION ALL (SELECT id, savings, 1 FROM plans WHERE savings > 0 ORDER BY spend, ord LIMIT 1)) ORDER BY n LIMIT 1")
def recommended_plan(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.recommended_plan(_plans(spark, sf)).select("id", "savings")


@query(_PLANS + f""", fast AS (SELECT * FROM plans WHERE savings > 0 AND savings_percent > 40 ORDER BY savings DESC, ord LIMIT 1), steady AS (SELECT * FROM plans WHERE savings > 0 AND savings_percent BETWEEN 10 AND 40 ORDER BY savings DESC, ord LIMIT 1)
SELECT 'fast_triage' AS tier, 60 AS traffic, id, {fixed('run_cost * 990.0::DOUBLE', 2)} AS monthly_cost FROM fast UNION ALL SELECT 'balanced_editing', 30, id, {fixed('run_cost * 495.0::DOUBLE', 2)} FROM steady UNION ALL SELECT 'complex_reasoning', 10, 'baseline', {fixed('base_run_cost * 165.0::DOUBLE', 2)} FROM fast""")
def hybrid_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.hybrid(_plans(spark, sf), 1650).select("tier", "traffic", "id", "monthly_cost")


@query(_PLANS + """ SELECT id, array_to_string(list_concat(CASE WHEN input_price = 0 AND output_price = 0 THEN ['Local / Offline Development', 'Free CI Automated Linting & Triage'] WHEN input_price <= 0.5 THEN ['High-Frequency Quick Edits', 'Pre-Commit Code Reviews', 'Token-Dense Workspace Summaries']
WHEN input_price <= 3 THEN ['Daily General Agent Programming', 'Test Case Generation', 'Feature Implementation'] ELSE ['Complex Architectural Refactoring', 'High-Stakes Security Audits', 'Deep Multi-File Reasoning'] END,
CASE WHEN context_window >= 1000000 THEN ['Whole-Repository Context Ingestion'] WHEN context_window >= 128000 THEN ['Multi-Module Context Analysis'] ELSE [] END), '; ') AS roles FROM plans""")
def plan_roles(spark: SparkSession, sf: str) -> DataFrame:
    return _plans(spark, sf).select("id", F.array_join(catalog.roles(), "; ").alias("roles"))


# Repository map

_RE = {n: getattr(rules, n) for n in ("SKIPPED", "ENTRY", "CONFIG", "DOCS", "TESTS", "SOURCES")}
_MAP = SCAN + f""", m1 AS (SELECT *, list_contains(risk_flags, 'generated') OR contains(base, '.min.') OR contains(base, '.bundle.') AS generated FROM scan),
m2 AS (SELECT *, CASE WHEN NOT included THEN 0 WHEN regexp_matches(path, '{_RE["SKIPPED"]}') THEN 5 WHEN generated THEN 10 WHEN list_contains(risk_flags, 'secret') THEN 10 WHEN list_contains(risk_flags, 'lockfile') THEN 15 WHEN list_contains(risk_flags, 'database-dump') THEN 10 WHEN list_contains(risk_flags, 'log-file') THEN 5
  WHEN estimated_tokens > 50000 THEN 20 WHEN regexp_matches(path, '{_RE["ENTRY"]}') THEN 100 WHEN regexp_matches(path, '{_RE["CONFIG"]}') THEN 90 WHEN regexp_matches(path, '{_RE["DOCS"]}') THEN 80 WHEN regexp_matches(path, '{_RE["TESTS"]}') THEN 70 WHEN regexp_matches(path, '{_RE["SOURCES"]}') THEN 60 ELSE 40 END AS priority FROM m1),
map AS (SELECT *, CASE WHEN NOT included OR priority <= 10 THEN 'excluded' WHEN priority >= 100 THEN 'entry' WHEN priority >= 90 THEN 'config' WHEN priority >= 80 THEN 'docs' WHEN priority >= 70 THEN 'test' WHEN priority >= 60 THEN 'source' ELSE 'other' END AS bucket,
  included AND estimated_tokens > 50000 AS large, included AND len(risk_flags) > 0 AND NOT list_contains(risk_flags, 'large-file') AS risky FROM m2)"""
_BUCKET = "list_position(['entry', 'config', 'docs', 'test', 'source', 'other', 'excluded'], bucket)"


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    return repo_map.entries(proxies.scan(spark, sf))


@query(_MAP + " SELECT path, priority FROM map")
def file_priority(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf).select("path", "priority")


@query(_MAP + f" SELECT path, bucket FROM map WHERE priority >= 60 ORDER BY {_BUCKET}, ord LIMIT 50")
def important_files(spark: SparkSession, sf: str) -> DataFrame:
    return repo_map.recommended_include(_mapped(spark, sf)).select("path", "bucket")


@query(_MAP + " SELECT path, CASE WHEN large THEN 0 WHEN generated THEN 1 WHEN bucket = 'excluded' THEN 2 ELSE 3 END::INTEGER AS list_no FROM map WHERE (large OR generated OR bucket = 'excluded' OR risky) AND estimated_tokens > 1000")
def recommended_exclude_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return repo_map.recommended_exclude(_mapped(spark, sf)).select("path", "list_no")


@query(SCAN + " SELECT folder, sum(estimated_tokens)::BIGINT AS total_tokens FROM scan WHERE folder <> '.' GROUP BY folder HAVING count_if(included) > 0 ORDER BY sum(estimated_tokens) DESC, min(ord) LIMIT 20")
def repo_map_folders(spark: SparkSession, sf: str) -> DataFrame:
    return repo_map.map_folders(proxies.scan(spark, sf)).select("folder", "total_tokens")


@query(_MAP + ", run AS (SELECT path, bucket, estimated_tokens, sum(estimated_tokens) OVER (ORDER BY priority DESC, ord)::BIGINT AS running FROM map WHERE priority >= 60) SELECT * FROM run WHERE running <= 50000")
def budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return repo_map.budget_prefix(_mapped(spark, sf), 50_000)


@query(_MAP + " SELECT bucket, count(*) AS files, sum(estimated_tokens)::BIGINT AS tokens FROM map GROUP BY bucket")
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return repo_map.bucket_counts(_mapped(spark, sf))


@query()
def repo_map_markdown(spark: SparkSession, sf: str) -> DataFrame:
    made = repo_map.create(proxies.scan(spark, sf), 20_000, generated_at="2026-01-01T00:00:00Z", goal="build-mvp", files=proxies.files(spark, sf).select("path", "text"))
    return spark.createDataFrame([(repo_map.markdown(made), made.estimated_tokens, made.notes)], "markdown string, estimated_tokens long, notes array<string>")


@query()
def workspace_report(spark: SparkSession, sf: str) -> DataFrame:
    scan = workspace.facts(proxies.scan(spark, sf))  # its texts are read and classified once
    told = reports.report(scan, _scored(spark, sf), 150_000, "build-mvp", scanned_at="2026-01-01T00:00:00Z")
    return spark.createDataFrame([(reports.to_json(told), reports.to_markdown(told, scan))], "json string, markdown string")


@query()
def drift_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(reports.drift_markdown(proxies.changed(spark, sf), None, "2026-01-01T00:00:00Z", max_percent=5.0, new_flags=True),)], "markdown string")


# Symbols, imports, routes

_IDS = "d AS (SELECT doc_id AS i, doc_id - doc_id % 16 + 2 AS j, ['src', 'src/lib', 'web'][doc_id % 3 + 1] || '/f' || doc_id || ['.py', '.js', '.go', '.rs', '.kt'][doc_id % 5 + 1] AS path, doc_id % 5 AS kind FROM documents)"


@query(f"WITH {_IDS} SELECT path, 'a' || i AS name, 'function' AS kind, 3 AS line_start, true AS is_async, 6 AS priority FROM d WHERE kind = 0 UNION ALL SELECT path, 'f' || i, 'function', 5, false, 5 FROM d WHERE kind = 0 UNION ALL SELECT path, 'C' || i, 'class', 7, false, 7 FROM d WHERE kind = 0")
def py_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.python_symbols(proxies.code(spark, sf))


@query(f"WITH {_IDS} SELECT path, 'F' || i AS name, 'function' AS kind, 2 AS line_start, true AS exported, 7 AS priority FROM d WHERE kind = 1 UNION ALL SELECT path, 'C' || i, 'class', 3, false, 5 FROM d WHERE kind = 1 UNION ALL SELECT path, 'v' || i, 'variable', 4, false, 2 FROM d WHERE kind = 1 UNION ALL SELECT path, 'W' || i, 'variable', 5, true, 5 FROM d WHERE kind = 1")
def js_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.javascript_symbols(proxies.code(spark, sf)).drop("is_async")


@query(f"""WITH {_IDS}, r(k, prefix, kind, line_start, exported) AS (VALUES (2, 'Get', 'function', 1, true), (2, 'put', 'function', 3, false), (2, 'T', 'type', 4, true), (3, 'go', 'function', 1, true), (3, 'own', 'function', 2, false), (3, 'S', 'type', 3, true), (3, 'R', 'interface', 4, false), (4, 'helper', 'function', 1, false), (4, 'K', 'class', 2, true), (4, 'open', 'function', 3, true), (4, 'I', 'interface', 4, true))
SELECT path, prefix || i AS name, r.kind, line_start, exported, 5 AS priority FROM d JOIN r ON d.kind = r.k""")
def clike_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.c_like_symbols(proxies.code(spark, sf))


@query(f"WITH {_IDS} SELECT path, unnest(['os', 'sys', '.pkg']) AS source FROM d WHERE kind = 0")
def py_imports(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.python_imports(proxies.code(spark, sf))


_FOUND = f"WITH {_IDS}, imp AS (SELECT path, i, j, unnest(['./f' || j, './lib/f' || j]) AS source, regexp_replace(path, '/[^/]*$', '') AS folder FROM d WHERE kind = 1), res AS (SELECT path, source, (SELECT min(e.path) FROM d e WHERE e.path = folder || substr(source, 2) || '.js' OR e.path = folder || substr(source, 2) || '.py' OR e.path = folder || substr(source, 2) || '.kt' OR e.path = folder || substr(source, 2) || '.go' OR e.path = folder || substr(source, 2) || '.rs') AS resolved FROM imp)"


@query(_FOUND + " SELECT * FROM res")
def import_resolution(spark: SparkSession, sf: str) -> DataFrame:
    code = proxies.code(spark, sf)
    return symbols.resolve(symbols.script_imports(code), code).select("path", "source", "resolved")


@query(_FOUND + " SELECT source, count(*) AS imports FROM imp GROUP BY source ORDER BY imports DESC, source LIMIT 15")
def import_popularity(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.popularity(symbols.script_imports(proxies.code(spark, sf)))


@query(f"WITH {_IDS} SELECT path, '/r/' || i AS route, 'express' AS framework, 'GET /r/' || i AS reason FROM d WHERE kind = 1 UNION ALL SELECT path, '/p/' || i, 'express', 'POST /p/' || i FROM d WHERE kind = 1 UNION ALL SELECT path, '/items/' || i, 'fastapi', 'fastapi route: /items/' || i FROM d WHERE kind = 0 UNION ALL SELECT path, '/old/' || i, 'flask', 'flask route: /old/' || i FROM d WHERE kind = 0 UNION ALL SELECT path, '/k/' || i, 'spring', 'spring route: /k/' || i FROM d WHERE kind = 4")
def call_routes(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.call_routes(proxies.code(spark, sf))


@query("WITH d AS (SELECT doc_id AS i, doc_id % 4 AS k FROM documents) SELECT CASE k WHEN 0 THEN 'web/app/(shop)/item' || i || '/[id]/page.tsx' WHEN 1 THEN 'web/src/pages/p' || i || '/index.ts' ELSE 'web/src/pages/[...all' || i || '].js' END AS path, CASE k WHEN 0 THEN '/item' || i || '/:id' WHEN 1 THEN '/p' || i ELSE '/:all' || i || '*' END AS route, CASE k WHEN 0 THEN 'app' ELSE 'pages' END AS router FROM d WHERE k < 3")
def next_routes(spark: SparkSession, sf: str) -> DataFrame:
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    path = F.when(k == 0, F.concat(F.lit("web/app/(shop)/item"), i, F.lit("/[id]/page.tsx"))).when(k == 1, F.concat(F.lit("web/src/pages/p"), i, F.lit("/index.ts"))).when(k == 2, F.concat(F.lit("web/src/pages/[...all"), i, F.lit("].js"))).otherwise(F.concat(F.lit("other/app/x"), i, F.lit("/page.tsx")))
    return symbols.file_routes(proxies.documents(spark, sf).select(path.alias("path")), spark.createDataFrame([("web",)], "root string"))


@query(f"WITH {_IDS} SELECT count(*) AS symbols, count(DISTINCT path) AS files, count_if(n IN (2, 5)) AS exported, count_if(n = 2) AS functions, count_if(n = 3) AS classes, 0::BIGINT AS types, count_if(n > 3) AS variables FROM d, unnest([2, 3, 4, 5]) AS u(n) WHERE kind = 1")
def symbol_summary(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.symbol_summary(symbols.javascript_symbols(proxies.code(spark, sf)))


_TS = "d AS (SELECT doc_id AS i, 'lib/t' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.ts' ELSE '.tsx' END AS path, doc_id % 2 = 1 AS tsx FROM documents)"
_TS_ROWS = """r(name, kind, line_start, exported, is_async, priority) AS (VALUES ('load#', 'function', 4, true, true, 7), ('Store#', 'class', 5, true, false, 7), ('Store#.get', 'method', 7, true, true, 7), ('Store#.of', 'method', 8, true, false, 7),
  ('Shape#', 'interface', 11, false, false, 5), ('Id#', 'type', 12, true, false, 7), ('Kind#', 'enum', 13, false, false, 3), ('Box#', 'variable', 14, true, false, 7), ('low#', 'variable', 14, true, false, 7))"""


@query(f"WITH {_TS}, {_TS_ROWS} SELECT path, replace(name, '#', i::VARCHAR) AS name, CASE WHEN tsx AND name = 'Box#' THEN 'component' ELSE kind END AS kind, line_start::INTEGER AS line_start, exported, is_async, priority::INTEGER AS priority FROM d, r")
def ts_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.typescript_symbols(proxies.typescript(spark, sf))


@query(f"WITH {_TS}, k(source, kind) AS (VALUES ('./a#', 'import'), ('side#', 'import'), ('./b#', 'export-from'), ('./c#', 'dynamic-import'), ('./d#', 'require')) SELECT path, replace(source, '#', i::VARCHAR) AS source, kind FROM d, k")
def ts_imports(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.script_imports(proxies.typescript(spark, sf))


# Git

_GIT = SCAN + """, g AS (SELECT path, ord, ['M ', ' M', '??', 'A ', 'D ', ' D', 'UU', 'AA', 'R ', 'MM'][ord % 10 + 1] AS code FROM scan),
st AS (SELECT path, code[1] AS index_status, code[2] AS worktree_status, CASE WHEN code = 'R ' THEN 'old ' || ord END AS original_path, code = '??' AS untracked, code IN ('UU', 'AA') AS conflicted, code NOT IN ('??', 'UU', 'AA') AND code[1] <> ' ' AS staged, code NOT IN ('??', 'UU', 'AA') AND code[2] <> ' ' AS unstaged, contains(code, 'D') AS deleted FROM g)"""


def _status(spark: SparkSession, sf: str) -> DataFrame:
    return git.parse(proxies.status_lines(spark, sf)).drop("ord")


@query(_GIT + " SELECT * FROM st")
def git_status_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _status(spark, sf)


@query(_GIT + " SELECT count_if(staged) AS staged, count_if(unstaged) AS unstaged, count_if(untracked) AS untracked, count_if(conflicted) AS conflicted, count_if(deleted) AS deleted, count(*) AS dirty FROM st")
def git_status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return git.summary(_status(spark, sf))


@query(_GIT + " SELECT path FROM scan WHERE path IN (SELECT path FROM st WHERE unstaged AND NOT deleted)")
def git_dirty_files(spark: SparkSession, sf: str) -> DataFrame:
    dirty = git.scope(_status(spark, sf), "unstaged").select(F.concat(F.lit("repo/"), "path").alias("path"))
    return git.touched(proxies.files(spark, sf), dirty).select("path")


# Text


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^(import |export |interface |type |declare |enum |from |})') AND (regexp_matches(regexp_replace(x, '^\\s+', ''), '^(import |export |interface |type |declare |enum |from )') OR trim(x) = '}')), chr(10)) AS outline FROM documents")
def export_outline(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.documents(spark, sf).select("doc_id", compaction.outline(F.col("text")).alias("outline"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r|\n', ' ', 'g'), '\\', '\\\\', 'g'), '([`*_\[\]<>#|])', '\\\1', 'g') AS escaped FROM documents")
def markdown_escape(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.documents(spark, sf).select("doc_id", compaction.escape_markdown(F.col("text")).alias("escaped"))


_QUOTES = {3: "repeat(chr(39), 3)", 4: "repeat(chr(34), 3)"}  # three of a kind
_HASH = "regexp_replace(t, '(?m)(^|[^\\\\])#.*$', '\\1', 'g')"
for _q in _QUOTES.values():
    _HASH = f"regexp_replace({_HASH}, '(?s)' || {_q} || '.*?' || {_q}, {_q} || '...' || {_q}, 'g')"
_SLASH = "regexp_replace(regexp_replace(t, '(?s)/\\*.*?\\*/', '', 'g'), '(?m)(^|[^\\\\])//.*$', '\\1', 'g')"


@query(f"""WITH s AS (SELECT doc_id, array_to_string(['/* head', ' of */ a //x  ', '', '', '# y', {_QUOTES[3]} || 'doc', {_QUOTES[3]} || ' b', {_QUOTES[4]} || 'c' || {_QUOTES[4]}, coalesce(text, '')], chr(10)) AS t FROM documents),
l AS (SELECT doc_id, list_transform(string_split(CASE WHEN doc_id % 2 = 0 THEN {_HASH} ELSE {_SLASH} END, chr(10)), lambda x: regexp_replace(x, '\\s+$', '')) AS lines FROM s)
SELECT doc_id, array_to_string(list_filter(lines, lambda x, i: x <> '' OR (i > 1 AND lines[i - 1] <> '')), chr(10)) AS text FROM l""")
def strip_comments(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, behind a head that has every kind of comment."""
    head = F.lit("/* head\n of */ a //x  \n\n\n# y\n'''doc\n''' b\n\"\"\"c\"\"\"\n")
    docs = proxies.documents(spark, sf).select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("t"))
    return docs.select("doc_id", compaction.strip_comments(F.col("t"), F.col("doc_id") % 2 == 0).alias("text"))


@query()
def collapse_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.code(spark, sf).select("path", compaction.collapse_bodies("text").alias("text"))


@query()
def progressive_compact(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.progressive(proxies.code(spark, sf), 40, F.col("path").endswith(".py"))
