"""Scans and recommendations as text for a terminal, and a scan as Markdown.

Rows that come to the driver: one of sums, ten files, a row per language, and flagged files, which the table lists all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators import workspace
from loomline.operators.text import code, plain


def share(n: float, whole: float) -> str:
    return f"{n / whole * 100 if whole > 0 else 0:.1f}%"


def facts(scan: DataFrame) -> tuple:
    total = workspace.stats(scan).first()
    top = workspace.top_files(scan).select("path", "estimated_tokens").collect()
    per = workspace.languages(scan).orderBy(F.desc("total_tokens"), "ord").select("language", "file_count", "total_tokens", "percentage").collect()
    return total, top, per


def scan_table(scan: DataFrame, root: str, scanned_at: str, warnings: list[str]) -> str:
    total, top, per = facts(scan)
    tokens, kept = total.total_tokens or 0, total.included_tokens or 0
    out = [f"Workspace Root: {root}", f"Scanned At: {scanned_at}", "", f"Total Files:     {total.total_files}", f"Included Files:  {total.included_files}", f"Excluded Files:  {total.excluded_files}", f"Total Tokens:    {tokens:,}", f"Included Tokens: {kept:,}", ""]
    if warnings:
        out += ["Warnings:", *[f"  - {w}" for w in warnings], ""]
    if top:
        out += ["Top 10 Token-Heavy Files:", "  Path                                    Tokens     %", "  " + "-" * 55]
        out += [f"  {r.path[:40]:<40} {r.estimated_tokens:>10,} {share(r.estimated_tokens, kept):>7}" for r in top] + [""]
    if per:
        out += ["Languages:", "  Language         Files     Tokens     %", "  " + "-" * 50]
        out += [f"  {r.language[:18]:<18} {r.file_count:>6} {r.total_tokens:>10,} {share(r.percentage, 1):>7}" for r in per] + [""]
    risky = scan.where(F.size("risk_flags") > 0).orderBy("ord").select("path", "risk_flags").collect()
    if risky:
        out += ["Risk Files:", *[f"  - {r.path} [{', '.join(r.risk_flags)}]" for r in risky], ""]
    return "\n".join(out)


def scan_markdown(scan: DataFrame, root: str, scanned_at: str, warnings: list[str]) -> str:
    total, top, per = facts(scan)
    kept = total.included_tokens or 0
    out = ["# Workspace Scan Report", "", f"**Workspace Root:** {code(root)}", f"**Scanned At:** {scanned_at}", "", "## Summary", "", "| Metric | Value |", "| --- | ---:|"]
    sums = {"Total Files": total.total_files, "Included Files": total.included_files, "Excluded Files": total.excluded_files, "Total Estimated Tokens": f"{total.total_tokens or 0:,}", "Included Tokens": f"{kept:,}"}
    out += [*[f"| {k} | {v} |" for k, v in sums.items()], ""]
    if top:
        out += ["## Top 10 Token-Heavy Files", "", "| Path | Tokens | % |", "| --- | ---:| ---:|", *[f"| {code(r.path)} | {r.estimated_tokens:,} | {share(r.estimated_tokens, kept)} |" for r in top], ""]
    if per:
        out += ["## Languages", "", "| Language | Files | Tokens | % |", "| --- | ---:| ---:| ---:|", *[f"| {plain(r.language)} | {r.file_count} | {r.total_tokens:,} | {share(r.percentage, 1)} |" for r in per], ""]
    if warnings:
        out += ["## Warnings", "", *[f"- {plain(w)}" for w in warnings], ""]
    return "\n".join(out)


def recommendation_table(told: dict) -> str:
    """Text of a recommendation as service.recommend() gives it."""
    out = [f"Recommendations for goal: {told['goal']}", f"Workspace tokens: {told['workspaceTokens']:,}", ""]
    for label, field in (("Cheapest Sufficient", "cheapestSufficient"), ("Balanced", "balanced"), ("High Confidence", "highConfidence")):
        r = told[field]
        out += [f"--- {label} ---", f"Model: {r['displayName']} ({r['modelId']})", f"Score: {r['score']['totalScore'] * 100:.0f}/100", f"Cost:  ${r['costEstimate']['totalCost']:.4f}", f"Quality: {r['expectedQuality']}"]
        out += [f"Reasons: {'; '.join(r['reasons'])}"] * bool(r["reasons"]) + [""]
    for title, some in (("Rejected models:", told["rejected"]), ("Assumptions:", told["assumptions"])):
        if some:
            out += [title, *[f"  - {x}" for x in some], ""]
    return "\n".join(out)
