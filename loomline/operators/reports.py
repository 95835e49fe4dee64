"""Reports of a scan and of drift, as JSON and Markdown.

A report's facts come to the driver, which are bounded: one row of sums, ten files and folders, a row per language and tier. Its
Markdown is a table of lines by section and place, so that lists as long as the scan, of flagged files, are rows that executors
make and write. A scan is read and classified once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from loomline.functions.tokens import estimate_text
from loomline.operators import drift, models, workspace
from loomline.operators.compaction import escape_markdown, markdown_code
from loomline.operators.text import code, plain
from loomline.sources import scratch
from loomline.sources.catalog import REPORT_VERSION

#: A tier's field in a report, and its heading.
TIERS = {"cheapest": ("cheapestSufficient", "cheapest-sufficient", "Cheapest Sufficient"), "balanced": ("balanced", "balanced", "Balanced"), "confidence": ("highConfidence", "high-confidence", "High Confidence")}
WIDE = 1_000_000


def percent(x: float) -> str:
    return f"{x * 100:.1f}%"


def table(head: list[str], rules: str, rows: list[list[object]]) -> list[str]:
    """Lines of a table; rules has a letter per column, r for numbers."""
    marks = [" ---:" if r == "r" else " --- " for r in rules]
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return [line(head), "|" + "|".join(marks) + "|", *map(line, rows), ""]


def report(scan: DataFrame, scored: DataFrame | None = None, workspace_tokens: int = 0, goal: str | None = None, root: str = ".", scanned_at: str = "", warnings: list[str] | None = None, assumptions: list[str] | None = None) -> dict:
    """The report as an object whose json.dumps is the JSON form; scored are a goal's models, None for no recommendation."""
    own = workspace.facts(scan)
    summed = scratch.table(workspace.sums(own), "sums")
    total = workspace.view(summed, "total").first() or Row(files=0, included=0, tokens=0, included_tokens=0, large=0, flagged=0)
    whole, all_tokens = total.included_tokens, total.tokens
    part = lambda n: n / whole if whole > 0 else 0
    top = workspace.top_files(own).select("path", "estimated_tokens").collect()
    folders = workspace.largest_trees(summed).collect()
    per = workspace.view(summed, "language").collect()
    picks = {} if scored is None else {r.tier: r for r in tiers(scored, workspace_tokens, goal).collect()}
    checklist = list(dict.fromkeys(s for t in TIERS if t in picks for s in picks[t].suggestions))
    if total.large:
        checklist.append(f"Review {total.large} file(s) exceeding 50k tokens for splitting or exclusion")
    if all_tokens > WIDE:
        checklist.append("Workspace exceeds 1M total tokens — consider narrowing scope or using a model with larger context")
    if total.flagged:
        checklist.append(f"Address {total.flagged} flagged risk file(s) before processing")
    return {
        "schemaVersion": REPORT_VERSION, "title": "Workspace Model Report", "generatedAt": scanned_at, "workspacePath": root, "goal": goal if picks else None,
        "summary": {"totalFiles": total.files, "includedFiles": total.included, "excludedFiles": total.files - total.included, "totalEstimatedTokens": all_tokens, "includedTokens": whole},
        "topTokenConsumers": [{"path": r.path, "tokens": r.estimated_tokens, "percentage": part(r.estimated_tokens)} for r in top],
        "topFolders": [{"path": r.name, "tokens": r.tokens, "percentage": part(r.tokens)} for r in folders],
        "languages": [{"language": r.name, "fileCount": r.files, "tokens": r.tokens, "percentage": r.percentage} for r in per],
        "recommendations": {TIERS[t][0]: pick(picks[t], TIERS[t][1]) for t in TIERS if t in picks} or None,
        "warnings": warnings or [], "assumptions": (assumptions or []) if picks else [], "optimizationChecklist": checklist,
    }


def tiers(scored: DataFrame, workspace_tokens: int, goal: str) -> DataFrame:
    """The recommended models with what a report tells of them."""
    needed = F.col("context_needed")
    parts = models.call_cost(needed, F.lit(models.OUTPUT_TOKENS[goal]), F.floor(needed * 0.3 + 0.5))
    told = {"reasons": models.reasons(goal), "warnings": models.warnings(), "suggestions": models.suggestions(workspace_tokens)}
    return models.recommend(scored).withColumns(parts | told)


def pick(r: object, tier: str) -> dict:
    return {
        "modelId": r.id, "displayName": r.display_name, "tier": tier,
        "score": {"totalScore": r.total, "contextFit": r.context_fit, "taskQualityFit": r.task_fit, "costEfficiency": r.cost_fit, "latencyFit": r.latency_fit, "privacyFit": r.privacy_fit},
        "costEstimate": {"inputCost": r.input_cost, "outputCost": r.output_cost, "cachedInputCost": r.cached_cost, "totalCost": r.total_cost},
        "reasons": r.reasons, "overflowRisk": r.overflow_risk, "expectedQuality": r.expected_quality, "warnings": r.warnings, "optimizationSuggestions": r.suggestions,
    }


def to_json(told: dict) -> str:
    return json.dumps(told, indent=2, ensure_ascii=False)


def section(title: str, lines: list[str], level: int = 2) -> list[str]:
    return ["#" * level + " " + title, "", *lines] if lines else []


def bullets(items: list[str], mark: str = "- ") -> list[str]:
    return [mark + plain(x) for x in items] + [""] * bool(items)


def to_lines(told: dict, scan: DataFrame) -> DataFrame:
    """(section, place, line) of a report's Markdown; the scan tells how many files lie in its folders and which are flagged."""
    before, after = heads(told, scan)
    spark, kinds = scan.sparkSession, "section int, place long, line string"
    flagged = scan.where(F.size("risk_flags") > 0)
    line = F.concat(F.lit("- "), markdown_code(F.col("path")), F.lit(" — "), escape_markdown(F.array_join("risk_flags", ", ")))
    listed = flagged.select(F.lit(2).alias("section"), F.col("ord").cast("long").alias("place"), line.alias("line"))
    around = [F.struct(F.lit(n).alias("section"), F.lit(i).cast("long").alias("place"), F.lit(x).alias("line")) for n, i, x in ((1, 0, "### Risk Flags"), (1, 1, ""), (3, 0, ""))]
    some = flagged.limit(1).select(F.explode(F.array(*around)).alias("x")).select("x.*")
    fixed = [(n, i, x) for n, some in ((0, before), (4, after)) for i, x in enumerate(some)]
    return spark.createDataFrame(fixed, kinds).unionByName(listed).unionByName(some)


def write_markdown(told: dict, scan: DataFrame, folder: str) -> None:
    """A report's Markdown as a folder of text files, in the order of their names, written by the executors."""
    to_lines(told, scan).orderBy("section", "place").select("line").write.mode("overwrite").text(folder)


def to_markdown(told: dict, scan: DataFrame) -> str:
    """A report's Markdown as one text, which is as long as its list of flagged files; those of a large scan are for write_markdown()."""
    return "\n".join(r.line for r in to_lines(told, scan).orderBy("section", "place").toLocalIterator())


def heads(told: dict, scan: DataFrame) -> tuple[list[str], list[str]]:
    """The lines before and after a report's list of flagged files."""
    s = told["summary"]
    out = ["# Workspace Model Report", "", f"**Scan Date:** {told['generatedAt']}", "", f"**Workspace Root:** {code(told['workspacePath'])}", ""]
    names = {"Total Files": s["totalFiles"], "Included Files": s["includedFiles"], "Excluded Files": s["excludedFiles"], "Total Estimated Tokens": f"{s['totalEstimatedTokens']:,}", "Included Tokens": f"{s['includedTokens']:,}"}
    out += section("Summary", table(["Metric", "Value"], "lr", [list(x) for x in names.items()]))
    top, folders = told["topTokenConsumers"], told["topFolders"]
    if top:
        out += section("Top 10 Files by Token Count", table(["#", "File", "Tokens", "% of Total"], "llrr", [[n, code(r["path"]), f"{r['tokens']:,}", percent(r["percentage"])] for n, r in enumerate(top, 1)]))
    if folders:
        inside = workspace.folders(scan).where(F.col("folder").isin([r["path"] for r in folders]))
        held = {r.folder: r.included_files for r in inside.select("folder", "included_files").collect()}
        out += section("Top 10 Folders by Token Count", table(["#", "Folder", "Files", "Tokens", "% of Total"], "llrrr", [[n, code(r["path"]), held[r["path"]], f"{r['tokens']:,}", percent(r["percentage"])] for n, r in enumerate(folders, 1)]))
    if told["languages"]:
        out += section("Language Breakdown", table(["Language", "Files", "Tokens", "%"], "lrrr", [[plain(r["language"]), r["fileCount"], f"{r['tokens']:,}", percent(r["percentage"])] for r in told["languages"]]))
    out += section("Warnings", bullets(told["warnings"]))
    first, out = out, []
    picks = told["recommendations"] or {}
    out += ["## Recommendations", ""]
    for field, _, title in TIERS.values():
        if field in picks:
            out += recommendation(title, picks[field])
    if not picks:
        out += ["Recommendations unavailable.", ""]
    out += section("Assumptions", bullets(told["assumptions"]) or ["None provided.", ""])
    money = [[plain(p["displayName"]), *[f"${p['costEstimate'][c]:.4f}" for c in ("inputCost", "outputCost", "cachedInputCost", "totalCost")]] for p in picks.values()]
    out += section("Estimated Costs", table(["Model", "Input Cost", "Output Cost", "Cached Input Cost", "Total Cost"], "lrrrr", money) if money else ["No cost estimates available.", ""])
    # without a recommendation the Markdown suggests nothing, though the JSON lists what the scan itself calls for
    todo = bullets(told["optimizationChecklist"], "- [ ] ") if picks else []
    return first, out + section("Optimization Checklist", todo or ["No optimizations suggested.", ""])


def recommendation(title: str, p: dict) -> list[str]:
    score = p["score"]
    names = {"Context Fit": "contextFit", "Task Quality Fit": "taskQualityFit", "Cost Efficiency": "costEfficiency", "Latency Fit": "latencyFit", "Privacy Fit": "privacyFit"}
    out = [f"### {title}", "", f"**Model:** {plain(p['displayName'])} ({code(p['modelId'])})", "", f"**Estimated Cost:** ${p['costEstimate']['totalCost']:.4f}", "", f"**Total Score:** {score['totalScore']:.1f}", ""]
    out += table(["Criterion", "Score"], "lr", [[n, f"{score[f]:.1f}"] for n, f in names.items()])
    out += [f"**Expected Quality:** {plain(p['expectedQuality'])}", "", f"**Overflow Risk:** {p['overflowRisk'] * 100:.0f}%", ""]
    for label, items, mark in (("Reasons", p["reasons"], "- "), ("Warnings", p["warnings"], "- ⚠ "), ("Optimization Suggestions", p["optimizationSuggestions"], "- ")):
        out += [f"**{label}:**", *bullets(items, mark)] if items else []
    return out


def drift_markdown(base: DataFrame, now: DataFrame | None, at: str, **policy: object) -> str:
    """Markdown of the drift between two scans, or in one table of versions of files, under drift.violations' policy."""
    found = drift.analyze(base, now, **policy)
    total, broken = found.summary, found.violations
    signed = lambda n: f"{n:+,}" if n else "0"
    rate = lambda x: f"{'+' * (x > 0)}{x:g}%"
    out = ["# Workspace Token Drift Report", "", f"**Status**: {'❌ POLICY VIOLATION' if broken else '✅ PASSED'} | **Generated**: {at}", ""]
    rows = [["**Total Tokens**", f"{total.base_tokens:,}", f"{total.current_tokens:,}", signed(total.net), rate(total.percent)]]
    rows += [[f"**Files {s.capitalize()}**", "—", "—", f"{mark}{total[s]}", "—"] for s, mark in (("added", "+"), ("removed", "-"), ("modified", ""), ("unchanged", ""))]
    out += section("Summary", table(["Metric", "Baseline", "Current", "Delta", "% Change"], "lllll", rows))
    out += section("Policy Violations", bullets([f"{r.rule}: {r.value:,g} exceeds {r.bound:,g}" for r in broken], "- ⚠️ "))
    head, cells = ["Baseline Tokens", "Current Tokens", "Token Delta", "% Change"], lambda r: [f"{r.base_tokens:,}", f"{r.current_tokens:,}", signed(r.delta), rate(r.percent)]
    up, down, folders = found.growing, found.shrinking, found.folders
    if up:
        flags = lambda r: f"+({plain(', '.join(r.added_flags))})" if r.added_flags else "—"
        out += section("Top Growing Files", table(["File", *head, "Risk Flags"], "llllll", [[code(r.path), *cells(r), flags(r)] for r in up]))
    if down:
        out += section("Top Shrinking Files", table(["File", *head], "lllll", [[code(r.path), *cells(r)] for r in down]))
    if folders:
        out += section("Directory Breakdown", table(["Directory", *head, "File Count Delta"], "llllll", [[code(r.folder), *cells(r), signed(r.net_files)] for r in folders]))
    return "\n".join(out)


def finished_goal(goal: str, outcome: str, changed: Sequence[str] = (), decisions: Sequence[str] = (), next_steps: Sequence[str] = (), source_tokens: int | None = None) -> tuple[str, int, int | None]:
    """What to remember of a finished goal, its estimated tokens, and how many it saves of those it came from."""
    out = ["# Completed Goal Context", "", f"- **Goal:** {code(goal)}", f"- **Outcome:** {plain(outcome)}"]
    for title, items, form in (("Changed Files", changed, code), ("Decisions", decisions, plain), ("Next Steps", next_steps, plain)):
        out += ["", *section(title, [f"- {form(x)}" for x in items])] if items else []
    text = "\n".join(out)
    tokens = estimate_text(text)
    return text, tokens, None if source_tokens is None else max(0, source_tokens - tokens)
