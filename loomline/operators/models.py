"""A model catalogue: validation, queries, costs, recommendations and advice on cheaper plans.

Catalogues have a row per model: id, display_name, provider, context_window, max_output_tokens, input_price, output_price,
cached_price (null: the input price), supports_tools, supports_images, supports_local, privacy_mode, coding_score,
reasoning_score, latency_score, updated_at, and ord, the place in the catalogue, which settles ties.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.numbers import round_half_up, to_fixed

#: Fixed values, here and in reasons(), warnings(), suggestions(), assumptions(), roles(), tradeoff() and RATIONALE: weights and sentences.
#: Tokens a goal writes, and how hard it is.
OUTPUT_TOKENS = {"build-mvp": 8000, "add-feature": 4000, "debug": 4000, "refactor": 8000, "migration": 12000, "security-review": 10000, "test-generation": 4000, "documentation": 2000, "architecture-planning": 10000, "cleanup": 4000}
DIFFICULTY = {"build-mvp": 3, "add-feature": 2, "debug": 1, "refactor": 3, "migration": 3, "security-review": 4, "test-generation": 2, "documentation": 1, "architecture-planning": 3, "cleanup": 1}
SORTS = ("composite", "input_price", "output_price", "context_window", "coding_score", "latency_score", "display_name")


def col(name: str) -> Column:
    return F.col(name)


def composite() -> Column:
    blended = (3 * col("input_price") + col("output_price")) / 4
    cost = F.when(blended == 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), 100 - 6 * blended))
    return to_fixed(F.lit(0.7) * F.coalesce(col("coding_score"), F.lit(50.0)) + F.lit(0.3) * cost, 2)


def cached() -> Column:
    return F.coalesce(col("cached_price"), col("input_price"))


def select(
    models: DataFrame, search: str = "", providers: Sequence[str] = (), not_providers: Sequence[str] = (), privacy: Sequence[str] = (), tools: bool | None = None, images: bool | None = None, local: bool | None = None,
    min_context: int | None = None, max_context: int | None = None, max_input_price: float | None = None, max_output_price: float | None = None, min_coding: float | None = None, min_latency: float | None = None,
) -> DataFrame:
    """Models that pass all predicates given; empty lists and None don't filter, null scores fail a least score."""
    out = models
    if term := search.strip().lower():
        out = out.where(F.lower("id").contains(term) | F.lower("display_name").contains(term) | F.lower("provider").contains(term))
    if providers:
        out = out.where(F.lower("provider").isin([p.lower() for p in providers]))
    if not_providers:
        out = out.where(~F.lower("provider").isin([p.lower() for p in not_providers]))
    if privacy:
        out = out.where(col("privacy_mode").isin(list(privacy)))
    for name, value in (("supports_tools", tools), ("supports_images", images), ("supports_local", local)):
        if value is not None:
            out = out.where(col(name) == value)
    for name, value in (("context_window", min_context), ("coding_score", min_coding), ("latency_score", min_latency)):
        if value is not None:
            out = out.where(col(name) >= value)
    for name, value in (("context_window", max_context), ("input_price", max_input_price), ("output_price", max_output_price)):
        if value is not None:
            out = out.where(col(name) <= value)
    return out


def page(models: DataFrame, sort: str = "composite", descending: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    if sort not in SORTS or offset < 0 or limit <= 0:
        raise ValueError("sort, offset or limit out of range")
    ranked = models.withColumn("composite", composite())
    key = F.collate("display_name", "UNICODE") if sort == "display_name" else F.coalesce(col(sort), F.lit(0))
    return ranked.orderBy(key.desc() if descending else key.asc(), "ord").offset(offset).limit(limit)


def query(models: DataFrame, offset: int = 0, limit: int = 50, sort: str = "composite", descending: bool = True, **predicates: object) -> dict:
    """One call: a page of the models that pass, what was found in all, and whether more follow."""
    found = select(models, **predicates)
    told = aggregates(found).first().asDict()
    per = provider_counts(found).orderBy("first").select("provider", "models").collect()
    return {"models": page(found, sort, descending, offset, limit), "total": told["models"], "offset": offset, "limit": limit, "hasMore": offset + limit < told["models"], "aggregates": told, "providers": {r.provider: r.models for r in per}}


def by_id(models: DataFrame, name: str) -> DataFrame:
    """The first model of an id."""
    return models.where(col("id") == name).orderBy("ord").limit(1)


def by_provider(models: DataFrame, name: str) -> DataFrame:
    return models.where(col("provider") == name)


def matching(models: DataFrame, text: str) -> DataFrame:
    """Models of which the id, name, provider or privacy has a text, in any case."""
    return models.where(F.lower(F.concat_ws(" ", "id", "display_name", "provider", "privacy_mode")).contains(text.lower()))


def recommended_matching(recommended: DataFrame, models: DataFrame, text: str) -> DataFrame:
    """Recommended rows (id, display_name) of which the name, id or provider has a text, trimmed and in any case; a model that the catalogue lacks has no provider."""
    provider = models.groupBy("id").agg(F.min_by("provider", "ord").alias("_provider"))
    row = F.lower(F.concat(F.col("display_name"), F.lit(" "), F.col("id"), F.lit(" "), F.coalesce("_provider", F.lit(""))))
    return recommended.join(provider, "id", "left").where(row.contains(text.strip().lower())).drop("_provider")


def unknown_providers(models: DataFrame, providers: DataFrame) -> DataFrame:
    """Providers of a catalogue that a list (provider) lacks."""
    return models.select("provider").distinct().join(providers, "provider", "left_anti")


def freshness(updated_at: Column, now: Column, most: int = 90) -> Column:
    """A struct of a catalogue date's age in days and a verdict: invalid, future, stale or fresh."""
    age = age_in_days(updated_at, now)
    return F.struct(age.alias("days"), F.when(age.isNull(), "invalid").when(age < 0, "future").when(age > most, "stale").otherwise("fresh").alias("verdict"))


def aggregates(models: DataFrame) -> DataFrame:
    is_local = col("supports_local") | (col("privacy_mode") == "local")
    mean = lambda c, n: F.coalesce(to_fixed(F.avg(c), n), F.lit(0.0))
    return models.agg(
        F.count(F.lit(1)).alias("models"), F.count_distinct("provider").alias("providers"), mean("input_price", 3).alias("average_input_price"), mean("output_price", 3).alias("average_output_price"),
        mean("coding_score", 1).alias("average_coding_score"), F.count_if(is_local).alias("local"), F.count_if(~is_local).alias("cloud"),
    )


def provider_counts(models: DataFrame) -> DataFrame:
    return models.groupBy("provider").agg(F.count(F.lit(1)).alias("models"), F.min("ord").alias("first"))


def profile(models: DataFrame, providers: Sequence[str] | None = None, ids: Sequence[str] | None = None, preferred: Sequence[str] = ()) -> DataFrame:
    """Allowed models, preferred ones first; None allows all, an empty list none."""
    out = models
    if providers is not None:
        out = out.where(col("provider").isin(list(providers)))
    if ids is not None:
        out = out.where(col("id").isin(list(ids)))
    return out.withColumn("preferred", col("id").isin(list(preferred))).orderBy(F.desc("preferred"), "ord")


def errors(models: DataFrame) -> DataFrame:
    """(id, ord, n, message) for all that is wrong with a model, in a fixed order; repeated ids count from the second on."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    below = lambda c, least: F.coalesce(col(c) < least, F.lit(True))
    odd = lambda c: F.coalesce((col(c) < 0) | (col(c) > 100) | F.isnan(c), F.lit(False))
    again = F.row_number().over(Window.partitionBy("id").orderBy("ord")) > 1
    date = F.coalesce(col("updated_at").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.expr("try_to_date(updated_at, 'yyyy-MM-dd') is not null"), F.lit(False))
    rules = [
        (blank("id"), "missing id"), (~blank("id") & again, "duplicate id"), (blank("display_name"), "missing display_name"), (blank("provider"), "missing provider"),
        (below("context_window", 1), "invalid context_window"), (below("max_output_tokens", 1), "invalid max_output_tokens"), (below("input_price", 0), "invalid input_price"),
        (F.coalesce(col("cached_price") < 0, F.lit(False)), "invalid cached_price"), (below("output_price", 0), "invalid output_price"), (col("supports_tools").isNull(), "invalid supports_tools"),
        (col("supports_images").isNull(), "invalid supports_images"), (col("supports_local").isNull(), "invalid supports_local"),
        (F.coalesce(~col("privacy_mode").isin("cloud", "local", "hybrid"), F.lit(True)), "invalid privacy_mode"), (odd("coding_score"), "invalid coding_score"), (odd("reasoning_score"), "invalid reasoning_score"),
        (odd("latency_score"), "invalid latency_score"), (~date, "invalid updated_at"), (F.coalesce(col("max_output_tokens") > col("context_window"), F.lit(False)), "max_output_tokens exceeds context_window"),
    ]
    told = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]))
    return models.withColumn("_told", told).select("id", "ord", F.posexplode("_told").alias("n", "message"))


def age_in_days(updated_at: Column, now: Column) -> Column:
    """Whole days since midnight UTC of a date; null if it isn't one."""
    day = F.when(updated_at.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(updated_at, "yyyy-MM-dd"))
    return F.floor((F.unix_millis(now) - F.unix_date(day).cast("long") * 86_400_000) / 86_400_000)


def call_cost(input_tokens: Column, output_tokens: Column, cached_tokens: Column) -> dict[str, Column]:
    million = F.lit(1_000_000.0)
    parts = {"input_cost": (input_tokens - cached_tokens) / million * col("input_price"), "cached_cost": cached_tokens / million * cached(), "output_cost": output_tokens / million * col("output_price")}
    return parts | {"total_cost": parts["input_cost"] + parts["cached_cost"] + parts["output_cost"]}


def costs(models: DataFrame, input_tokens: int, output_tokens: int, cached_tokens: int = 0) -> DataFrame:
    if min(input_tokens, output_tokens, cached_tokens) < 0 or cached_tokens > input_tokens:
        raise ValueError("token counts out of range")
    return models.withColumns(call_cost(F.lit(input_tokens), F.lit(output_tokens), F.lit(cached_tokens)))


def session_costs(models: DataFrame, workspace_tokens: int, turns: int = 10, milestone: int = 50) -> DataFrame:
    """What a prompt, a run of turns and a milestone cost."""
    ws = F.lit(workspace_tokens)
    single = call_cost(ws, col("max_output_tokens"), F.lit(0))["total_cost"]
    turn = call_cost(round_half_up(ws * F.lit(0.8)), round_half_up(col("max_output_tokens") * F.lit(0.5)), round_half_up(ws * F.lit(0.7)))["total_cost"]
    return models.withColumns({"prompt_cost": single, "run_cost": turn * turns, "milestone_cost": turn * milestone})


def score(models: DataFrame, workspace_tokens: int, goal: str, budget: int | None = None, privacy: str = "cloud-ok", preferred: Sequence[str] = ()) -> DataFrame:
    """Eligible models with their scores, cost, and whether the context fits."""
    if workspace_tokens < 0 or (budget is not None and budget < 0):
        raise ValueError("token counts out of range")
    base = min(workspace_tokens, budget) if budget is not None else workspace_tokens
    need, output = int(base * 1.2 + 0.5), OUTPUT_TOKENS[goal]
    kept = models.where("supports_local") if privacy == "local-first" else models
    ratio = col("context_window") / F.lit(float(max(need, 1)))
    fit = F.lit(1.0) if need <= 0 else F.when(ratio >= 2, 1.0).when(ratio >= 1, 0.8).when(ratio >= 0.75, 0.5).otherwise(ratio)
    coding = F.coalesce(col("coding_score"), F.lit(50.0)) / 100
    reasoning = F.coalesce(col("reasoning_score"), col("coding_score"), F.lit(50.0)) / 100
    task = F.least(F.lit(1.0), F.lit(0.65) * coding + F.lit(0.25 if DIFFICULTY[goal] >= 3 else 0.15) * reasoning + F.when(col("supports_tools"), 0.1).otherwise(0.0))
    total = call_cost(F.lit(need), F.lit(output), F.lit(int(need * 0.3 + 0.5)))["total_cost"]
    scored = kept.withColumns({"context_needed": F.lit(need).cast("long"), "cost": total, "fits": col("context_window") >= need, "context_fit": fit, "task_fit": task})
    scored = scored.withColumns({
        "cost_fit": F.when(col("cost") <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - col("cost") / F.lit(0.05))),
        "latency_fit": F.coalesce(col("latency_score") / 100, F.lit(0.5)),
        "privacy_fit": F.when(col("privacy_mode") == "local", 1.0).when(col("privacy_mode") == "hybrid", 0.7).otherwise(0.4),
    })
    whole = F.lit(0.35) * col("task_fit") + F.lit(0.35) * col("cost_fit") + F.lit(0.15) * col("context_fit") + F.lit(0.05) * col("latency_fit") + F.lit(0.1) * col("privacy_fit")
    sure = F.lit(0.55) * coding + F.lit(0.3) * reasoning + F.lit(0.15) * col("context_fit")
    risk = F.when((F.lit(need) <= 0) | col("fits"), 0.0).otherwise(F.least(F.lit(1.0), 1 - ratio))
    quality = F.when(whole >= 0.7, "high").when(whole >= 0.5, "medium").otherwise("low")
    return scored.withColumns({"total": whole, "confidence": sure, "overflow_risk": risk, "expected_quality": quality, "preferred": col("id").isin(list(preferred))})


def recommend(scored: DataFrame) -> DataFrame:
    """Three tiers (cheapest, balanced, confidence), each a model that no tier before has, unless none is left.

    Models that don't fit count only if none does; without any model it is an error. Each tier is a minimum over the models under its order, so no model list is sorted or gathered.
    """
    some = scored.agg(F.max("fits")).first()[0]  # null without models
    if some is None:
        raise ValueError("no models are eligible")
    pool = scored.where("fits") if some else scored
    name = F.collate(F.col("id").cast("string"), "UNICODE")
    late = ~col("preferred")
    orders = {
        "cheapest": [col("cost").asc(), col("total").desc(), late.asc(), name.asc(), col("ord").asc()],
        "balanced": [col("total").desc(), col("cost").asc(), late.asc(), name.asc(), col("ord").asc()],
        "confidence": [col("confidence").desc(), col("total").desc(), late.asc(), name.asc(), col("ord").asc()],
    }
    # the best three of an order hold its pick, whatever the two tiers before took
    best = None
    for n, (tier, order) in enumerate(orders.items()):
        three = pool.orderBy(*order).limit(3).withColumns({"tier": F.lit(tier), "n": F.lit(n), "rank": F.row_number().over(Window.partitionBy(F.lit(n)).orderBy(*order))})
        best = three if best is None else best.unionByName(three)
    picks, taken = None, None
    for n in range(3):
        own = best.where(col("n") == n)
        if taken is not None:
            own = own.join(taken.withColumn("_taken", F.lit(1)), "id", "left").withColumn("_late", F.coalesce("_taken", F.lit(0)))
        else:
            own = own.withColumn("_late", F.lit(0))
        own = own.orderBy("_late", "rank").limit(1).select(*best.columns)
        picks = own if picks is None else picks.unionByName(own)
        taken = picks.select("id").distinct()
    return picks.drop("n", "rank")


def ranked(scored: DataFrame) -> DataFrame:
    """All scored models, the best first."""
    return scored.orderBy(F.desc("total"), "ord")


def fitting_first(scored: DataFrame) -> DataFrame:
    """Models that fit, then those that don't, each in the order of the catalogue."""
    return scored.orderBy(F.desc("fits"), "ord")


def context_fits(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_if(col("overflow_risk") == 0).alias("fitting"), F.count(F.lit(1)).alias("models"))


def others(scored: DataFrame, picks: DataFrame) -> DataFrame:
    """Scored models that no tier names."""
    return scored.join(F.broadcast(picks.select("id").distinct()), "id", "left_anti")  # three ids


def compared(scored: DataFrame, models: DataFrame, workspace_tokens: int, goal: str) -> DataFrame:
    """Of each scored model what a prompt and ten turns cost, and its first two reasons; a dash for what the catalogue lacks."""
    priced = session_costs(models, workspace_tokens)
    first = priced.groupBy("id").agg(F.min_by(F.struct("display_name", "provider", "prompt_cost", "run_cost"), "ord").alias("m"))
    told = scored.withColumn("reasons", F.slice(reasons(goal), 1, 2)).select("id", "total", "reasons", "ord")
    name = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit("—")).alias(c)
    return told.join(first, "id", "left").select("id", name("display_name"), name("provider"), "total", F.col("m.prompt_cost").alias("prompt_cost"), F.col("m.run_cost").alias("run_cost"), "reasons", "ord")


def assumptions(workspace_tokens: int, goal: str, budget: int | None = None, privacy: str = "cloud-ok", any_fits: bool = True) -> list[str]:
    """What a recommendation takes for granted."""
    need = int((min(workspace_tokens, budget) if budget is not None else workspace_tokens) * 1.2 + 0.5)
    told = [
        f'Output tokens estimated for "{goal}" goal: {OUTPUT_TOKENS[goal]}',
        f"20% safety margin added to context ({need} tokens required)",
        f"Using full workspace tokens ({workspace_tokens}) as context" if budget is None else f"Context limited to user-specified budget of {budget} tokens",
        "Local-first privacy mode only considers models with verified local execution support" if privacy == "local-first" else "Cloud-capable models may be considered",
    ]
    return told + ["No model fits the required context; recommend using repo-map-first strategy to reduce context"] * (not any_fits)


def rejected(scored: DataFrame) -> DataFrame:
    return scored.where(~col("fits")).select("id", "ord")


def reasons(goal: str) -> Column:
    told = [
        F.when(col("context_fit") >= 0.8, F.concat(F.lit("Adequate context window ("), F.format_string("%.0f", col("context_window") / 1000), F.lit("K tokens)"))),
        F.when(col("cost_fit") >= 0.7, F.lit("Cost-efficient for this task")),
        F.when(col("coding_score") >= 70, F.concat(F.lit("Strong coding benchmarks ("), F.format_string("%.0f", "coding_score"), F.lit("/100)"))),
        F.when(col("privacy_mode") == "local", F.lit("Runs entirely locally — no data leaves your machine")),
        F.when(col("supports_tools"), F.lit("Tool/function calling support")),
        F.lit(f'Good fit for "{goal.replace("-", " ")}" goal'),
    ]
    return F.array_compact(F.array(*told))


def warnings() -> Column:
    """What speaks against a scored model."""
    overflow = F.when(~col("fits"), F.lit("Context window insufficient — overflow likely; consider repo-map-first strategy"))
    return F.array_compact(F.array(overflow, F.when(col("coding_score") < 50, F.lit("Below-average coding benchmark scores"))))


def suggestions(workspace_tokens: int) -> Column:
    """What would make a scored model cheaper or fit."""
    crowded = (F.lit(float(workspace_tokens)) > col("context_window") * 0.5) | ~col("fits")
    told = [
        F.when(crowded, F.lit("Use a repo map instead of full workspace to reduce context")),
        F.when(F.lit(workspace_tokens > 200_000), F.lit("Exclude build artifacts, lockfiles, and generated files")),
        F.when(F.lit(workspace_tokens > 500_000), F.lit("Use the agent optimizer to generate concise agent rules")),
        F.lit("Enable prompt caching if supported by your provider"),
    ]
    return F.array_compact(F.array(*told))


def advice(models: DataFrame, baseline: str, developers: float = 5, days: float = 22, runs: float = 15, input_tokens: float = 48_000, output_tokens: float = 2_000, cache: float = 0.5, least_context: int = 0) -> DataFrame:
    """Monthly plans of all candidates against a baseline model, unrounded savings beside rounded ones."""
    per_dev = float(runs) * float(days)
    priced = priced_runs(models, developers, days, runs, input_tokens, output_tokens, cache)
    base = priced.where(col("id") == baseline).orderBy("ord").limit(1).select(col("run_cost").alias("base_run_cost"), col("spend").alias("base_spend"))
    ratio = col("context_window") / F.lit(float(max(least_context, 1)))
    fit = F.lit(1.0) if least_context <= 0 else F.when(ratio >= 1, 1.0).otherwise(F.greatest(F.lit(0.1), to_fixed(ratio, 2)))
    plans = priced.where((col("id") != baseline) & (col("context_window") >= int(least_context * 0.75 + 0.5))).crossJoin(F.broadcast(base))  # one row
    free = (col("input_price") == 0) & (cached() == 0) & (col("output_price") == 0)
    savings = col("base_spend") - col("spend")
    percent = F.when(col("base_spend") > 0, to_fixed(savings / F.nullif(col("base_spend"), F.lit(0.0)) * 100, 1)).otherwise(F.lit(0.0))
    times = F.when(col("base_spend") > 0, to_fixed(col("spend") / F.nullif(col("base_spend"), F.lit(0.0)), 2)).otherwise(F.lit(1.0))
    return plans.withColumns({"savings": savings, "savings_percent": percent, "cost_multiplier": times, "cost_per_dev": to_fixed(col("run_cost") * F.lit(per_dev), 2), "monthly_spend": to_fixed(col("spend"), 2), "monthly_savings": to_fixed(savings, 2), "context_fit": fit, "free": free})


def roles() -> Column:
    price, window = col("input_price"), col("context_window")
    band = (
        F.when((price == 0) & (col("output_price") == 0), F.array(F.lit("Local / Offline Development"), F.lit("Free CI Automated Linting & Triage")))
        .when(price <= 0.5, F.array(F.lit("High-Frequency Quick Edits"), F.lit("Pre-Commit Code Reviews"), F.lit("Token-Dense Workspace Summaries")))
        .when(price <= 3, F.array(F.lit("Daily General Agent Programming"), F.lit("Test Case Generation"), F.lit("Feature Implementation")))
        .otherwise(F.array(F.lit("Complex Architectural Refactoring"), F.lit("High-Stakes Security Audits"), F.lit("Deep Multi-File Reasoning")))
    )
    wide = F.when(window >= 1_000_000, F.array(F.lit("Whole-Repository Context Ingestion"))).when(window >= 128_000, F.array(F.lit("Multi-Module Context Analysis"))).otherwise(F.array().cast("array<string>"))
    return F.concat(band, wide)


def recommended_plan(plans: DataFrame) -> DataFrame:
    """The plan that saves most of those with a fifth saved and a context that fits, else the cheapest that saves."""
    saving = plans.where("savings > 0")
    first = saving.where("savings_percent >= 20 and context_fit >= 0.9").orderBy(F.desc("savings"), "ord").limit(1).withColumn("_n", F.lit(0))
    cheapest = saving.orderBy("spend", F.desc("savings"), "ord").limit(1).withColumn("_n", F.lit(1))
    return first.unionByName(cheapest).orderBy("_n").limit(1).drop("_n")


def usd(amount: Column) -> Column:
    """A month's money as text."""
    cents = to_fixed(amount, 2)
    return F.when(cents == 0, "less than $0.01").otherwise(F.concat(F.lit("$"), F.format_string("%.2f", cents)))


def tradeoff(base_is_free: bool = False, runs: bool = True) -> Column:
    """A sentence on what a plan of advice() costs more or less than the baseline."""
    diff, name, base = col("spend") - col("base_spend"), col("display_name"), col("base_spend")
    percent = round_half_up(F.abs(diff) / F.nullif(base, F.lit(0.0)) * 100)
    same = F.concat(F.lit("Cost-neutral alternative to "), name, F.lit(" with identical economic footprint.")) if runs else F.concat(F.lit("No runs are projected for this workload, so switching to "), name, F.lit(" has no cost impact."))
    label = "zero-cost baseline" if base_is_free else "baseline's zero projected spend"
    little = lambda way: F.concat(F.lit(f"Costs less than 1% {way} than the baseline for "), name, F.lit("."))
    return (
        F.when(diff == 0, same).when(base <= 0, F.concat(F.lit("Adds "), usd(diff), F.lit(f"/mo over the {label} to adopt "), name, F.lit(" (percentage uplift undefined).")))
        .when((percent == 0) & (diff < 0), little("less")).when(percent == 0, little("more"))
        .when(diff < 0, F.concat(F.lit("Delivers "), percent.cast("string"), F.lit("% cost reduction. Ideal for offloading standard repetitive development prompts.")))
        .otherwise(F.concat(F.lit("Invests "), percent.cast("string"), F.lit("% higher spend for superior frontier reasoning capability on complex edge-cases.")))
    )


RATIONALE = {
    "fast_triage": "Route file exploration, lint fixes, commit messages, and token scans to high-throughput tier.",
    "balanced_editing": "Route standard feature implementation, unit test generation, and pull request changesets.",
    "complex_reasoning": "Reserve top-tier model for large architectural redesigns, debugging elusive race conditions.",
}


def dealt_runs(team_runs: int) -> tuple[int, int, int]:
    """Runs of a fast, a balanced and the baseline's tier."""
    triage = int(team_runs * 0.6 + 0.5)
    editing = min(int(team_runs * 0.3 + 0.5), team_runs - triage)
    return triage, editing, team_runs - triage - editing


def hybrid(plans: DataFrame, team_runs: int, models: DataFrame | None = None, baseline: str = "baseline") -> DataFrame:
    """Runs dealt to a fast, a balanced and the baseline's tier, with their monthly costs unrounded and rounded.

    If no plan saves, the baseline of models takes all in one row; without models there are no rows then.
    """
    triage, editing, reasoning = dealt_runs(team_runs)
    saving = plans.where("savings > 0")
    pick = lambda some, n: some.limit(1).withColumn("_n", F.lit(n))
    by_savings = [F.desc("savings"), F.col("ord")]
    fast = pick(saving.where("savings_percent > 40").orderBy(*by_savings), 0).unionByName(pick(saving.orderBy("spend", *by_savings), 1)).orderBy("_n").limit(1)
    steady = pick(saving.where("savings_percent between 10 and 40").orderBy(*by_savings), 0).unionByName(pick(saving.orderBy(*by_savings), 1)).orderBy("_n").limit(1)

    def row(some: DataFrame, tier: str, traffic: int, name: Column, run: str, n: int) -> DataFrame:
        cost = F.col(run) * F.lit(float(n))
        return some.select(F.lit(tier).alias("tier"), F.lit(traffic).alias("traffic"), name.cast("string").alias("id"), to_fixed(cost, 2).alias("monthly_cost"), cost.alias("cost"), F.lit(RATIONALE[tier]).alias("rationale"))

    rows = row(fast, "fast_triage", 60, col("id"), "run_cost", triage).union(row(steady, "balanced_editing", 30, col("id"), "run_cost", editing)).union(row(fast, "complex_reasoning", 10, F.lit(baseline), "base_run_cost", reasoning))
    if models is None:
        return rows
    told = plans.agg(F.count(F.lit(1)).alias("_all"), F.count_if(col("savings") > 0).alias("_saving"))
    why = F.when(col("_all") == 0, "All traffic routed to baseline model (no suitable multi-tier alternatives provided).").otherwise("All traffic routed to baseline model (no candidate model costs less than the baseline).")
    alone = by_id(models, baseline).crossJoin(told).where("_saving = 0")  # a row each
    return rows.union(alone.select(F.lit("balanced_editing"), F.lit(100), col("id").cast("string"), to_fixed(col("spend"), 2), col("spend"), why))


def hybrid_summary(rules: DataFrame, base_spend: float, baseline_name: str, plans: int) -> DataFrame:
    """(blended_cost, savings, savings_percent, summary) of the rules of hybrid(), given the baseline's spend and how many plans there were."""
    total = rules.agg(F.count(F.lit(1)).alias("_n"), F.sum("cost").alias("_cost"))
    saved = F.when(col("_n") == 3, F.lit(float(base_spend)) - col("_cost")).otherwise(F.lit(0.0))
    percent = to_fixed(saved / F.lit(float(base_spend)) * 100, 1) if base_spend > 0 else F.lit(0.0)
    shown = F.regexp_replace(F.format_string("%.1f", percent), r"\.0$", "")
    told = F.concat(F.lit("Tiered dispatching delivers "), usd(saved), F.lit("/mo ("), shown, F.lit("%) savings while preserving top-tier model precision for high-complexity prompts."))
    none = f"No alternative models were available, so all traffic stays on {baseline_name} and tiered dispatching adds no savings." if plans == 0 else f"No candidate model costs less than {baseline_name}, so all traffic stays on the baseline and tiered dispatching adds no savings."
    return total.select(to_fixed(col("_cost"), 2).alias("blended_cost"), to_fixed(saved, 2).alias("savings"), percent.alias("savings_percent"), F.when(col("_n") == 3, told).otherwise(F.lit(none)).alias("summary"))


def priced_runs(models: DataFrame, developers: float = 5, days: float = 22, runs: float = 15, input_tokens: float = 48_000, output_tokens: float = 2_000, cache: float = 0.5) -> DataFrame:
    """models with what a run costs, and a team's month. Numbers must be finite and not below zero, a share of 1 at most."""
    for value in (developers, days, runs, input_tokens, output_tokens, cache):
        if not math.isfinite(value) or value < 0:
            raise ValueError("workload out of range")
    if cache > 1 or not math.isfinite(float(runs) * float(days) * float(developers)):
        raise ValueError("workload out of range")
    million, held = F.lit(1_000_000.0), F.lit(float(input_tokens) * float(cache))
    run = (F.lit(float(input_tokens)) - held) / million * col("input_price") + held / million * cached() + F.lit(float(output_tokens)) / million * col("output_price")
    return models.withColumn("run_cost", run).withColumn("spend", col("run_cost") * F.lit(float(runs) * float(days) * float(developers)))
