"""Further queries of the analytics operators, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import display, paths, tokens
from loomline.operators import compaction, repo_map, symbols, workspace
from loomline.operators import models as catalog
from loomline.plans import proxies
from loomline.plans.catalogue import _CACHED, _IDS, _MAP, _PLANS, _SCORED, _cost, _mapped, _plans, _scored, query
from loomline.plans.proxies import MODELS, SCAN, fixed

# Models


@query(MODELS + " SELECT 'id' AS asked, id FROM (SELECT id FROM models WHERE id = '17' ORDER BY ord LIMIT 1) UNION ALL SELECT 'provider', id FROM models WHERE provider = 'Brand#13'")
def catalog_by_id(spark: SparkSession, sf: str) -> DataFrame:
    own = proxies.models(spark, sf)
    return catalog.by_id(own, "17").select(F.lit("id").alias("asked"), "id").union(catalog.by_provider(own, "Brand#13").select(F.lit("provider"), "id"))


@query(MODELS + " SELECT id FROM models WHERE contains(lower(id || ' ' || display_name || ' ' || provider || ' ' || privacy_mode), 'brand#2') OR contains(lower(privacy_mode), 'brand#2')")
def catalog_matching(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.matching(proxies.models(spark, sf), "Brand#2").select("id")


@query(MODELS + " SELECT DISTINCT provider FROM models WHERE provider NOT IN (SELECT DISTINCT provider FROM models WHERE ord % 10 < 9 AND provider <> 'Brand#11' AND provider NOT LIKE '%#4%')")
def catalog_unknown_providers(spark: SparkSession, sf: str) -> DataFrame:
    own = proxies.models(spark, sf)
    return catalog.unknown_providers(own, own.where("ord % 10 < 9 and provider <> 'Brand#11' and provider not like '%#4%'").select("provider").distinct())


_DATED = "CASE WHEN ord % 11 = 0 THEN '2026-13-01' WHEN ord % 13 = 0 THEN 'soon' ELSE strftime(DATE '2026-01-01' + (ord % 200)::INTEGER, '%Y-%m-%d') END"


@query(MODELS + f", f AS (SELECT id, {_DATED} AS dated, datediff('day', TRY_CAST({_DATED} AS DATE), DATE '2026-05-01') AS days FROM models) SELECT id, days, CASE WHEN days IS NULL THEN 'invalid' WHEN days < 0 THEN 'future' WHEN days > 90 THEN 'stale' ELSE 'fresh' END AS verdict FROM f")
def catalog_freshness(spark: SparkSession, sf: str) -> DataFrame:
    dated = F.when(F.col("ord") % 11 == 0, "2026-13-01").when(F.col("ord") % 13 == 0, "soon").otherwise(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("ord") % 200).cast("int")).cast("string"))
    return proxies.models(spark, sf).select("id", catalog.freshness(dated, F.timestamp_seconds(F.lit(1777637045))).alias("f")).select("id", "f.*")  # 2026-05-01 12:04:05


@query(_SCORED + " SELECT id, total FROM scored ORDER BY total DESC, ord")
def models_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.ranked(_scored(spark, sf)).select("id", "total")


@query(_SCORED + " SELECT id, fits FROM scored ORDER BY fits DESC, ord")
def models_fitting_first(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.fitting_first(_scored(spark, sf)).select("id", "fits")


@query(_SCORED + " SELECT count_if(overflow_risk = 0) AS fitting, count(*) AS models FROM scored")
def context_fit_count(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.context_fits(_scored(spark, sf))


_TIERS = _SCORED + """, pool AS (SELECT * FROM scored WHERE fits OR NOT (SELECT bool_or(fits) FROM scored)),
a AS (SELECT * FROM pool ORDER BY cost, total DESC, id LIMIT 1), b AS (SELECT * FROM pool WHERE id NOT IN (SELECT id FROM a) ORDER BY total DESC, cost, id LIMIT 1),
c AS (SELECT * FROM pool WHERE id NOT IN (SELECT id FROM a UNION SELECT id FROM b) ORDER BY confidence DESC, total DESC, id LIMIT 1)"""


@query(_TIERS + " SELECT id FROM scored WHERE id NOT IN (SELECT id FROM a UNION SELECT id FROM b UNION SELECT id FROM c)")
def models_not_recommended(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf)
    return catalog.others(scored, catalog.recommend(scored)).select("id")


@query(MODELS + f", need AS (SELECT *, {_cost('180000', '54000', '8000')} AS cost FROM models WHERE supports_local) SELECT id, cost FROM need")
def models_local_first(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.score(proxies.models(spark, sf), 150_000, "build-mvp", privacy="local-first").select("id", "cost")


_TURN = _cost("120000", "105000", "floor(max_output_tokens * 0.5::DOUBLE + 0.5)")


@query(_SCORED + f""" SELECT s.id, CASE WHEN s.ord % 5 = 0 THEN '—' ELSE s.display_name END AS display_name, CASE WHEN s.ord % 5 <> 0 THEN {_cost('150000', '0', 'max_output_tokens')} END AS prompt_cost, CASE WHEN s.ord % 5 <> 0 THEN ({_TURN}) * 10 END AS run_cost,
array_to_string(list_filter([CASE WHEN context_fit >= 0.8::DOUBLE THEN 'Adequate context window (' || printf('%.0f', context_window / 1000.0::DOUBLE) || 'K tokens)' END, CASE WHEN cost_fit >= 0.7::DOUBLE THEN 'Cost-efficient for this task' END,
CASE WHEN coding_score >= 70 THEN 'Strong coding benchmarks (' || printf('%.0f', coding_score) || '/100)' END, CASE WHEN privacy_mode = 'local' THEN 'Runs entirely locally — no data leaves your machine' END, CASE WHEN supports_tools THEN 'Tool/function calling support' END, 'Good fit for "build mvp" goal'], lambda x: x IS NOT NULL)[1:2], '; ') AS reasons FROM scored s""")
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Against a catalogue that lacks each fifth model."""
    told = catalog.compared(_scored(spark, sf), proxies.models(spark, sf).where("ord % 5 <> 0"), 150_000, "build-mvp")
    return told.select("id", "display_name", "prompt_cost", "run_cost", F.array_join("reasons", "; ").alias("reasons"))


@query(_PLANS + """, t AS (SELECT id, display_name AS name, spend - base_spend AS diff, floor(abs(spend - base_spend) / base_spend * 100 + 0.5::DOUBLE)::BIGINT AS percent FROM plans)
SELECT id, CASE WHEN diff = 0 THEN 'Cost-neutral alternative to ' || name || ' with identical economic footprint.' WHEN percent = 0 AND diff < 0 THEN 'Costs less than 1% less than the baseline for ' || name || '.' WHEN percent = 0 THEN 'Costs less than 1% more than the baseline for ' || name || '.'
WHEN diff < 0 THEN 'Delivers ' || percent || '% cost reduction. Ideal for offloading standard repetitive development prompts.' ELSE 'Invests ' || percent || '% higher spend for superior frontier reasoning capability on complex edge-cases.' END AS told FROM t""")
def tradeoff_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _plans(spark, sf).select("id", catalog.tradeoff().alias("told"))


_CHEAP = MODELS + f""", priced AS (SELECT *, (48000.0::DOUBLE - 24000.0::DOUBLE) / 1000000.0::DOUBLE * input_price + 24000.0::DOUBLE / 1000000.0::DOUBLE * {_CACHED} + 2000.0::DOUBLE / 1000000.0::DOUBLE * output_price AS run_cost FROM models),
p2 AS (SELECT *, run_cost * 1650.0::DOUBLE AS spend FROM priced), least AS (SELECT * FROM p2 ORDER BY spend, ord LIMIT 1)"""


def _least(spark: SparkSession, sf: str) -> tuple[DataFrame, str, DataFrame]:
    priced = catalog.priced_runs(proxies.models(spark, sf))
    name = priced.orderBy("spend", "ord").first().id
    return priced, name, catalog.advice(proxies.models(spark, sf), name)


@query(_CHEAP + f""", t AS (SELECT p.id, p.display_name AS name, p.spend - l.spend AS diff, l.spend AS base, round(p.spend - l.spend, 2) AS cents FROM p2 p, least l WHERE p.id <> l.id)
SELECT id, CASE WHEN diff = 0 THEN 'Cost-neutral alternative to ' || name || ' with identical economic footprint.' WHEN base <= 0 THEN 'Adds ' || CASE WHEN {fixed('diff', 2)} = 0 THEN 'less than $0.01' ELSE '$' || printf('%.2f', {fixed('diff', 2)}) END || '/mo over the zero-cost baseline to adopt ' || name || ' (percentage uplift undefined).'
ELSE 'Invests ' || floor(diff / base * 100 + 0.5::DOUBLE)::BIGINT || '% higher spend for superior frontier reasoning capability on complex edge-cases.' END AS told FROM t""")
def tradeoff_of_the_cheapest(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences where the baseline is the cheapest model."""
    return _least(spark, sf)[2].select("id", catalog.tradeoff(base_is_free=True).alias("told"))


@query(_CHEAP + f" SELECT 'balanced_editing' AS tier, 100 AS traffic, id, {fixed('spend', 2)} AS monthly_cost, 'All traffic routed to baseline model (no candidate model costs less than the baseline).' AS rationale FROM least")
def hybrid_alone(spark: SparkSession, sf: str) -> DataFrame:
    priced, name, plans = _least(spark, sf)
    return catalog.hybrid(plans, 1650, priced, name).drop("cost")


@query(_PLANS + f""", fast AS (SELECT * FROM plans WHERE savings > 0 AND savings_percent > 40 ORDER BY savings DESC, ord LIMIT 1), steady AS (SELECT * FROM plans WHERE savings > 0 AND savings_percent BETWEEN 10 AND 40 ORDER BY savings DESC, ord LIMIT 1),
s AS (SELECT fast.run_cost * 990.0::DOUBLE + steady.run_cost * 495.0::DOUBLE + fast.base_run_cost * 165.0::DOUBLE AS cost, fast.base_spend AS base FROM fast, steady)
SELECT {fixed('cost', 2)} AS blended_cost, {fixed('base - cost', 2)} AS savings, {fixed('(base - cost) / base * 100', 1)} AS savings_percent,
'Tiered dispatching delivers $' || printf('%.2f', {fixed('base - cost', 2)}) || '/mo (' || regexp_replace(printf('%.1f', {fixed('(base - cost) / base * 100', 1)}), '\\.0$', '') || '%) savings while preserving top-tier model precision for high-complexity prompts.' AS summary FROM s""")
def hybrid_totals(spark: SparkSession, sf: str) -> DataFrame:
    plans = _plans(spark, sf)
    base = catalog.by_id(catalog.priced_runs(proxies.models(spark, sf)), "17").first()
    return catalog.hybrid_summary(catalog.hybrid(plans, 1650), base.spend, base.display_name, plans.count())


@query(MODELS + f" SELECT id FROM models WHERE input_price = 0 AND {_CACHED} = 0 AND output_price = 0 AND id <> '17'")
def models_free(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.advice(proxies.models(spark, sf), "17").where("free").select("id")


@query(MODELS + " SELECT count(*) AS total, 40 < count(*) AS has_more FROM models WHERE supports_tools AND coding_score >= 30")
def catalog_query_call(spark: SparkSession, sf: str) -> DataFrame:
    told = catalog.query(proxies.models(spark, sf), offset=30, limit=10, tools=True, min_coding=30)
    return spark.createDataFrame([(told["total"], told["hasMore"])], "total long, has_more boolean")


# Tokens


@query(SCAN + """ SELECT path, floor(CASE WHEN bytes = 0 THEN 0 ELSE whole END * CASE extension WHEN '.json' THEN 0.9::DOUBLE WHEN '.yaml' THEN 0.85::DOUBLE WHEN '.yml' THEN 0.85::DOUBLE WHEN '.md' THEN 1.1::DOUBLE WHEN '.mdx' THEN 1.1::DOUBLE WHEN '.svg' THEN 1.3::DOUBLE WHEN '.lock' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END + 0.5::DOUBLE)::BIGINT AS tokens,
'heuristic' AS confidence, CASE extension WHEN '.json' THEN 'adjusted by 0.9x for json' WHEN '.yaml' THEN 'adjusted by 0.85x for yaml' WHEN '.md' THEN 'adjusted by 1.1x for md' WHEN '.svg' THEN 'adjusted by 1.3x for svg' WHEN '.lock' THEN 'adjusted by 1.5x for lock' END AS details FROM scan""")
def token_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.files(spark, sf).select("path", tokens.heuristic(F.col("text"), paths.extension(F.col("path"))).alias("h")).select("path", "h.*")


@query(SCAN + " SELECT sum(estimated_tokens)::BIGINT AS total_tokens, coalesce(sum(estimated_tokens) FILTER (included), 0)::BIGINT AS included_tokens, coalesce(sum(estimated_tokens) FILTER (NOT included), 0)::BIGINT AS excluded_tokens, count(*) AS total_files FROM scan")
def workspace_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return workspace.count_tokens(proxies.scan(spark, sf))[0]


# Files and folders


@query(SCAN + " SELECT folder, sum(estimated_tokens)::BIGINT AS tokens FROM scan GROUP BY folder ORDER BY tokens DESC, min(ord) LIMIT 10")
def top10_direct_folders(spark: SparkSession, sf: str) -> DataFrame:
    return workspace.top_direct_folders(proxies.scan(spark, sf)).select("folder", F.col("total_tokens").alias("tokens"))


@query(SCAN + " SELECT path FROM scan ORDER BY translate(lower(path), '_-./', chr(1) || chr(2) || chr(3) || chr(4)), path")
def files_collated(spark: SparkSession, sf: str) -> DataFrame:
    return workspace.ordered(proxies.files(spark, sf)).select("path")


@query(SCAN + " SELECT path, true AS exists, bytes::BIGINT AS bytes, estimated_tokens, NULL::VARCHAR AS error FROM scan UNION ALL SELECT 'src/../missing.ts', false, 0, 0, 'file not found'")
def batch_files(spark: SparkSession, sf: str) -> DataFrame:
    scan, paths_ = proxies.scan(spark, sf), proxies.files(spark, sf).select("path")  # a file's path needs no text read and classified
    return workspace.batch(scan, paths_.union(spark.createDataFrame([("src/../missing.ts",)], "path string")))


@query("SELECT count_if(doc_id % 3 = 0 AND doc_id % 2 = 0) AS cache_hits, count_if(NOT (doc_id % 3 = 0 AND doc_id % 2 = 0)) AS cache_misses FROM documents")
def cache_hit_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A cache that has each third file, half of them at another time."""
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    scan = proxies.scan(spark, sf).withColumn("mtime", now)
    cache = scan.where("ord % 3 = 0").withColumn("mtime", F.when(F.col("ord") % 2 == 0, now).otherwise(F.timestamp_seconds(F.lit(1_700_000_001))))
    return workspace.cache_counts(workspace.with_cache(scan, cache))


@query(SCAN + """, l AS (SELECT language, sum(estimated_tokens)::BIGINT AS t FROM scan WHERE included GROUP BY language)
SELECT * FROM (SELECT 'file' AS part, path AS name, estimated_tokens AS tokens, language AS extra FROM scan WHERE included ORDER BY estimated_tokens DESC, ord LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'folder', folder, sum(estimated_tokens)::BIGINT, count_if(included)::VARCHAR FROM scan GROUP BY folder ORDER BY sum(estimated_tokens) DESC, min(ord) LIMIT 10)
UNION ALL SELECT 'language', language, t, printf('%.4f', t / (sum(t) OVER ())::DOUBLE) FROM l""")
def workspace_compact(spark: SparkSession, sf: str) -> DataFrame:
    return workspace.compact(proxies.scan(spark, sf))


# Repository map


@query(_MAP + """ SELECT path, CASE WHEN NOT included THEN coalesce(excluded_reason, 'Excluded by configuration') WHEN priority >= 100 THEN 'Likely entry point' WHEN priority >= 90 THEN 'Config / tooling file' WHEN priority >= 80 THEN 'Documentation / instructions' WHEN priority >= 70 THEN 'Test file'
WHEN priority >= 60 THEN 'Important source file' WHEN priority >= 30 THEN 'Other source file' WHEN priority >= 10 THEN 'Low-priority' ELSE 'Excluded' END AS reason,
CASE extension WHEN '.ts' THEN 'TypeScript' WHEN '.tsx' THEN 'TypeScript React' WHEN '.js' THEN 'JavaScript' WHEN '.py' THEN 'Python' WHEN '.md' THEN 'Markdown' WHEN '.json' THEN 'JSON' WHEN '.yaml' THEN 'YAML' WHEN '.sql' THEN 'SQL' WHEN '.go' THEN 'Go' WHEN '.kt' THEN 'Kotlin' WHEN '.rs' THEN 'Rust' END AS map_language FROM map""")
def map_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf).select("path", "reason", "map_language")


@query(_MAP + " SELECT path, priority FROM map WHERE priority >= 60 ORDER BY priority DESC, ord")
def map_display_order(spark: SparkSession, sf: str) -> DataFrame:
    return repo_map.display_order(_mapped(spark, sf))


@query(_MAP + """ SELECT path, CASE WHEN large THEN 1 WHEN generated THEN 2 WHEN risky THEN 3 WHEN bucket = 'excluded' THEN 4 WHEN bucket = 'test' THEN 5 ELSE 6 END::INTEGER AS n FROM map
WHERE (large OR generated OR risky OR bucket IN ('excluded', 'test') OR priority >= 60) AND bucket NOT IN ('entry', 'config', 'docs')""")
def map_trim_order(spark: SparkSession, sf: str) -> DataFrame:
    return repo_map.trim_order(_mapped(spark, sf)).select("path", "n")


@query(_MAP + """ SELECT count_if(priority >= 60) AS important, count_if(bucket = 'entry') AS entry, count_if(bucket = 'test') AS test, count_if(bucket = 'config') AS config, count_if(bucket = 'docs') AS docs, count_if(large) AS large, count_if(risky) AS risky, count_if(generated) AS generated,
count_if(bucket = 'excluded') AS excluded, coalesce(sum(estimated_tokens) FILTER (priority >= 60), 0)::BIGINT AS important_tokens, count_if(included) AS included_files, count_if(NOT included) AS excluded_files, count(*) AS total_files, sum(estimated_tokens)::BIGINT AS total_tokens FROM map""")
def map_counts(spark: SparkSession, sf: str) -> DataFrame:
    scan = proxies.scan(spark, sf)
    return repo_map.counts(repo_map.entries(scan))


@query(_MAP + " SELECT path FROM map WHERE priority >= 60 AND excluded_reason IS NULL AND extension IN ('.ts', '.tsx', '.js', '.py', '.go', '.kt', '.rs') AND bytes <= 4000 AND NOT list_has_any(risk_flags, ['generated', 'binary', 'secret', 'lockfile'])")
def symbol_files(spark: SparkSession, sf: str) -> DataFrame:
    scan = proxies.scan(spark, sf)
    return symbols.eligible(scan, repo_map.entries(scan).where("priority >= 60"), most=4000).select("path")


@query(f"""WITH {_IDS}, r(k, prefix, kind, line_start) AS (VALUES (0, 'a', 'function', 3), (0, 'f', 'function', 5), (0, 'C', 'class', 7), (1, 'F', 'function', 2), (1, 'C', 'class', 3), (1, 'v', 'variable', 4), (1, 'W', 'variable', 5),
(2, 'Get', 'function', 1), (2, 'put', 'function', 3), (2, 'T', 'type', 4), (3, 'go', 'function', 1), (3, 'own', 'function', 2), (3, 'S', 'type', 3), (3, 'R', 'interface', 4), (4, 'helper', 'function', 1), (4, 'K', 'class', 2), (4, 'open', 'function', 3), (4, 'I', 'interface', 4))
SELECT path, prefix || i AS name, r.kind, line_start::INTEGER AS line_start FROM d JOIN r ON d.kind = r.k""")
def symbols_of_all(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.all_symbols(proxies.code(spark, sf)).select("path", "name", "kind", "line_start")


@query(f"""WITH {_IDS}, r(prefix, exported, priority, line_start) AS (VALUES ('F', true, 7, 2), ('C', false, 5, 3), ('v', false, 2, 4), ('W', true, 5, 5))
SELECT path, prefix || i AS name FROM d, r WHERE kind = 1 ORDER BY exported DESC, priority DESC, contains(path, 'lib') DESC, lower(prefix || i), path, line_start LIMIT 100""")
def symbols_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked for tests first, of which files in lib are made some."""
    renamed = symbols.javascript_symbols(proxies.code(spark, sf)).withColumn("path", F.replace("path", F.lit("lib"), F.lit("test")))
    return symbols.rank_symbols(renamed, "debug").select(F.replace("path", F.lit("test"), F.lit("lib")).alias("path"), "name")


@query(f"WITH {_IDS}, p AS (SELECT path, i FROM d WHERE kind = 0) SELECT path, s.source, CASE s.n WHEN 0 THEN path WHEN 1 THEN 'f' || i || '.py' WHEN 2 THEN CASE WHEN starts_with(path, 'web/') THEN path ELSE 'web/f' || i || '/__init__.py' END END AS resolved FROM p, (VALUES (0, '.f#'), (1, '......f#'), (2, '...web.f#'), (3, 'os')) s(n, src), LATERAL (SELECT replace(src, '#', i::VARCHAR) AS source) s2 WHERE true".replace("s.source", "s2.source"))
def py_import_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Imports beside a file, far above the root, two folders up and of a library."""
    code = proxies.code(spark, sf).where(F.col("path").endswith(".py"))
    i = F.col("ord").cast("string")
    wanted = code.select("path", F.explode(F.array(F.concat(F.lit(".f"), i), F.concat(F.lit("......f"), i), F.concat(F.lit("...web.f"), i), F.lit("os"))).alias("source"))
    there = code.select("path").union(code.select(F.concat(F.lit("f"), i, F.lit(".py")))).union(code.select(F.concat(F.lit("web/f"), i, F.lit("/__init__.py"))))
    return symbols.resolve(wanted, there)


# Text


@query(r"""WITH f AS (SELECT doc_id, replace(regexp_replace('a`b``' || coalesce(text, ''), '\r\n|\r|\n', ' ', 'g'), '|', '&#124;') AS t FROM documents), n AS (SELECT *, list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))) AS n FROM f)
SELECT doc_id, repeat('`', n + 1) || ' ' || t || ' ' || repeat('`', n + 1) AS code FROM n""")
def markdown_code(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.documents(spark, sf).select("doc_id", compaction.markdown_code(F.concat(F.lit("a`b``"), F.coalesce("text", F.lit("")))).alias("code"))



# Panels


@query(r"""SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS plain, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS quoted FROM documents""")
def html_escaped(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.documents(spark, sf).select("doc_id", display.escape_html(F.col("text")).alias("plain"), display.escape_html(F.col("text"), apostrophes=True).alias("quoted"))


@query("""WITH n AS (SELECT l_orderkey AS k, l_linenumber AS l, l_partkey * l_partkey * l_suppkey * l_linenumber * (CASE WHEN l_linenumber = 3 THEN -1 ELSE 1 END) AS x FROM lineitem),
t AS (SELECT *, abs(x) AS a, CASE WHEN abs(x) < 999950 THEN 1000 WHEN abs(x) < 999950000 THEN 1000000 WHEN abs(x) < 999950000000 THEN 1000000000 ELSE 1000000000000 END AS unit FROM n),
r AS (SELECT *, (a + unit // 20) // (unit // 10) AS tenths FROM t)
SELECT k, l, (CASE WHEN x < 0 THEN '-' ELSE '' END) || CASE WHEN a < 1000 THEN a::VARCHAR ELSE (tenths // 10)::VARCHAR || CASE WHEN tenths % 10 > 0 THEN '.' || (tenths % 10)::VARCHAR ELSE '' END || CASE unit WHEN 1000 THEN 'K' WHEN 1000000 THEN 'M' WHEN 1000000000 THEN 'B' ELSE 'T' END END AS short FROM r""")
def compact_numbers(spark: SparkSession, sf: str) -> DataFrame:
    sign = F.when(F.col("l_linenumber") == 3, -1).otherwise(1)
    number = F.col("l_partkey") * F.col("l_partkey") * F.col("l_suppkey") * F.col("l_linenumber") * sign
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), display.compact(number, grouped=False).alias("short"))


@query("""WITH t AS (SELECT doc_id, doc_id * doc_id * 7 - 50 AS s FROM documents)
SELECT doc_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60)::VARCHAR || 'm ago' WHEN s < 86400 THEN (s // 3600)::VARCHAR || 'h ago' ELSE (s // 86400)::VARCHAR || 'd ago' END AS age FROM t""")
def relative_times(spark: SparkSession, sf: str) -> DataFrame:
    now = 1_777_637_045
    return proxies.documents(spark, sf).select("doc_id", display.age(F.timestamp_seconds(F.lit(now) - (F.col("doc_id") * F.col("doc_id") * 7 - 50)), F.timestamp_seconds(F.lit(now))).alias("age"))


@query(_SCORED + " SELECT s.id, s.display_name FROM scored s WHERE contains(lower(s.display_name || ' ' || s.id || ' ' || CASE WHEN s.ord % 5 = 0 THEN '' ELSE s.provider END), 'brand#2')")
def models_searched(spark: SparkSession, sf: str) -> DataFrame:
    """Against a catalogue that lacks each fifth model."""
    return catalog.recommended_matching(_scored(spark, sf), proxies.models(spark, sf).where("ord % 5 <> 0"), " Brand#2 ").select("id", "display_name")
