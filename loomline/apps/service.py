"""The engine's calls as a client makes them: scans, recommendations, maps, rules, reports, within one allowed root.

The latest results stay with the service and are what its resources serve.
"""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import agent_rules, console, models, repo_map, reports, workspace
from loomline.sources import catalog, settings
from loomline.sources.files import scan_folder

SECONDS, MOST_SECONDS = 60, 300
#: What a goal is called, and the steps that a prompt asks for.
GOALS = {
    "build-mvp": "building an MVP", "add-feature": "adding a feature", "debug": "debugging", "refactor": "refactoring", "migration": "a migration", "security-review": "a security review", "test-generation": "generating tests",
    "documentation": "writing documentation", "architecture-planning": "architecture planning", "cleanup": "cleanup",
}
STEPS = [
    "**Scan the workspace first** — Use the scan_workspace tool to understand the codebase size and structure.",
    "**Create a repo map** — Use create_repo_map to identify important files and entry points without reading full file contents.",
    "**Avoid risky/generated/large files** — Focus on source code files. Ask before reading large or sensitive files.",
    "**Prefer targeted reads** — Use the repo map to identify specific files to read rather than scanning entire directories.",
    "**Use patch-only output for code changes** — When making edits, use search/replace or unified diff format to minimize token usage.",
    "**Ask before reading large files** — Files over 50K tokens should be summarized first or confirmed with the user.",
    "**Recommend model tier before long work** — For extended tasks, use recommend_models to check if your context fits within model limits.",
]


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


@contextmanager
def time_limit(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Cancels the Spark jobs that run inside when the time is up, and raises TimeoutError."""
    tag, up, sc = f"limit-{uuid.uuid4().hex}", threading.Event(), spark.sparkContext

    def stop() -> None:
        up.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception:
        if up.is_set():
            raise TimeoutError(f"cancelled after {seconds:g} s") from None
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    if up.is_set():
        raise TimeoutError(f"cancelled after {seconds:g} s")


class Service:
    def __init__(self, spark: SparkSession, allowed_root: str | None = None, catalogue: str | None = None, warn: Callable[[str], None] = lambda w: None) -> None:
        self.spark, self.allowed, self.catalogue, self.warn = spark, os.path.realpath(allowed_root or os.getcwd()), catalogue, warn
        self.latest: dict[str, dict] = {}

    def inside(self, path: str | None) -> str:
        """The real path of one that lies in the allowed root, which is the default."""
        real = os.path.realpath(os.path.join(self.allowed, path or "."))
        if not os.path.exists(real) or os.path.commonpath([self.allowed, real]) != self.allowed:
            raise ValueError(f"Invalid or disallowed workspace path: {path}")
        return real

    def catalogue_path(self, path: str | None = None) -> str:
        """The catalogue that is asked for, else the one of the environment, else the service's own, within the root unless it is that."""
        asked = path or os.environ.get("LOOMLINE_CATALOG_PATH")
        if asked:
            try:
                return self.inside(asked)
            except ValueError:
                raise ValueError(f"Catalog path does not exist or is outside the allowed root: {asked}") from None
        return os.path.realpath(self.catalogue) if self.catalogue else self.inside(os.path.join("catalogs", "models.json"))

    def models(self, path: str | None = None) -> DataFrame:
        return catalog.load_models(self.spark, self.catalogue_path(path), strict=True)

    def scan(self, root: str | None = None, exclude: list[str] | None = None, cache: str | None = None, seconds: float = SECONDS) -> tuple[DataFrame, list[str], str]:
        """(scan, warnings, real root); the scan is cached in the session as its callers read it several times."""
        if not 0 < seconds <= MOST_SECONDS:
            raise ValueError("timeout out of range")
        real = self.inside(root)
        with time_limit(self.spark, seconds):
            found, warnings = scan_folder(self.spark, real, exclude, cache)
            found = found.persist()
            found.count()
        for w in warnings:
            self.warn(w)
        return found, warnings, real

    def scan_summary(self, root: str | None = None, goal: str | None = None, seconds: float = SECONDS) -> dict:
        found, warnings, real = self.scan(root, seconds=seconds)
        total = workspace.stats(found).first()
        rows = workspace.compact(found).collect()
        part = lambda name, key: [{"path" if name != "language" else "language": r.name, "tokens": r.tokens, key: kind(r.extra)} for r in rows if r.part == name for kind in ({"language": str, "files": int, "percentage": float}[key],)]
        told = {
            "rootPath": real, "totalFiles": total.total_files, "includedFiles": total.included_files, "excludedFiles": total.excluded_files, "totalEstimatedTokens": total.total_tokens or 0, "topFiles": part("file", "language"),
            "topFolders": part("folder", "files"), "languages": part("language", "percentage"), "warnings": warnings,
        } | ({"goal": goal} if goal else {})
        self.latest["scan"] = told
        return told

    def recommend(self, tokens: int, goal: str = "build-mvp", privacy: str = "local-first", budget: int | None = None, catalogue: str | None = None) -> dict:
        """Three tiers, the models that don't fit, assumptions, and all scored models."""
        scored = models.score(self.models(catalogue), tokens, goal, budget, privacy)
        picks = {r.tier: r for r in reports.tiers(scored, tokens, goal).collect()}
        twice, taken = "Same model selected for multiple tiers due to limited fitting candidates", []
        told = {"goal": goal, "workspaceTokens": tokens}
        for tier, (field, name, _) in reports.TIERS.items():
            told[field] = reports.pick(picks[tier], name)
            told[field]["reasons"] = [*told[field]["reasons"], *[twice] * (picks[tier].id in taken)]
            taken.append(picks[tier].id)
        fits = models.context_fits(scored).first().fitting > 0
        told["rejected"] = [r.id for r in models.rejected(scored).orderBy("ord").collect()]
        told["assumptions"] = models.assumptions(tokens, goal, budget, privacy, fits)
        told["allScored"] = [r.asDict() for r in models.fitting_first(scored).select("id", "display_name", "total", "cost", "fits").collect()]
        self.latest["recommendation"] = told
        return told

    @staticmethod
    def compact_recommendation(told: dict) -> dict:
        brief = lambda r: {"modelId": r["modelId"], "displayName": r["displayName"], "cost": f"${r['costEstimate']['totalCost']:.4f}", "score": r["score"]["totalScore"], "overflowRisk": r["overflowRisk"], "warnings": r["warnings"], "optimizationSuggestions": r["optimizationSuggestions"]}
        return {k: told[k] for k in ("goal", "workspaceTokens", "rejected", "assumptions")} | {k: brief(told[k]) for k in ("cheapestSufficient", "balanced", "highConfidence")}

    def repo_map(self, root: str | None = None, goal: str | None = None, budget: int = 64_000, with_symbols: bool = True, max_symbols: int = 500) -> repo_map.RepoMap:
        found, _, real = self.scan(root)
        texts = found.select("path", "text") if with_symbols else None
        made = repo_map.create(found, budget, real, now(), goal, texts, max_symbols=max_symbols, parse_limit=200_000)
        self.latest["map"] = made.compact()
        return made

    def rules(self, root: str | None = None, target: str = "generic", mode: str = "normal", goal: str = "build-mvp", privacy: str = "local-first") -> agent_rules.AgentRules:
        tokens = workspace.stats(self.scan(root)[0]).first().included_tokens or 0
        try:
            names = [r["displayName"] for r in (self.recommend(tokens, goal, privacy)[f] for f in ("cheapestSufficient", "balanced", "highConfidence"))]
        except (ValueError, OSError):  # no catalogue, or none of its models is eligible
            names = []
        return agent_rules.generate(target, mode, tokens, list(dict.fromkeys(names)))

    def report(self, root: str | None = None, goal: str = "build-mvp", privacy: str = "local-first", catalogue: str | None = None, form: str = "markdown", with_map: bool = False) -> str:
        found, warnings, real = self.scan(root)
        tokens = workspace.stats(found).first().included_tokens or 0
        scored = models.score(self.models(catalogue), tokens, goal, None, privacy)
        told = reports.report(found, scored, tokens, goal, real, now(), warnings, models.assumptions(tokens, goal, None, privacy))
        if form == "json":
            return reports.to_json(told)
        text = reports.to_markdown(told, found)
        return text + ("\n" + repo_map.markdown(repo_map.create(found, 64_000, real, now(), goal, found.select("path", "text"))) if with_map else "")

    def validate(self, catalogue: str | None = None, most_days: int = 90) -> dict:
        path = self.catalogue_path(catalogue)
        own = catalog.load_models(self.spark, path, strict=True)
        wrong = [f"{r.id}: {r.message}" for r in models.errors(own).orderBy("ord", "n").collect()]
        with open(path if os.path.isfile(path) else os.path.join(path, "models.json"), encoding="utf-8") as f:
            head = catalog.parse_catalogue(json.load(f))
        fresh = self.spark.range(1).select(models.freshness(F.lit(head["updatedAt"]), F.current_timestamp(), most_days).alias("f")).first().f
        per = models.provider_counts(own).orderBy("first").collect()
        told = {"version": head["version"], "updatedAt": head["updatedAt"], "modelCount": sum(r.models for r in per), "providers": [r.provider for r in per]}
        self.latest["catalog"] = told
        return told | {"valid": not wrong, "errors": wrong, "ageDays": fresh.days, "freshness": fresh.verdict}

    def estimate_files(self, paths: list[str], root: str | None = None, budget: int | None = None, model: str | None = None) -> dict:
        """Each path's tokens, their sum, and how it fits a model's context and a budget. One path out of the root fails all."""
        found, _, _ = self.scan(root)
        asked = self.spark.createDataFrame([(p, n) for n, p in enumerate(paths)], "path string, n int")
        rows = workspace.batch(found, asked.select("path")).collect()
        total, told = sum(r.estimated_tokens for r in rows), {}
        if model:
            window = models.by_id(self.models(), model).select("context_window").first()
            told["targetModel"] = {"id": model, "contextWindow": window.context_window, "fits": total <= window.context_window} if window else {"id": model, "error": "unknown model"}
        if budget is not None:
            if budget <= 0:
                raise ValueError("context budget out of range")
            told["budget"] = {"contextBudget": budget, "fits": total <= budget, "utilizationPercent": round(total / budget * 100, 2)}
        return {"files": [r.asDict() for r in sorted(rows, key=lambda r: paths.index(r.path))], "totalTokens": total, "totalBytes": sum(r.bytes for r in rows)} | told

    def prompt(self, goal: str = "build-mvp", budget: int | None = None, privacy: str = "local-first") -> str:
        if goal not in GOALS or not settings.privacy(privacy):
            raise ValueError("invalid goal or privacy mode")
        if budget is not None and not settings.positive(budget):
            raise ValueError("Token budget must be a positive integer")
        out = [f"You are working on {GOALS[goal]} for this workspace.", "", "Follow these optimization steps:", ""]
        for n, step in enumerate(STEPS, 1):
            out += [f"{n}. {step}", ""]
        out += [f"**Token Budget:** Target ~{budget:,} tokens for your context.", ""] if budget else []
        out += ["**Privacy Mode:** Only use locally-running models. Do not send code to cloud APIs.", ""] * (privacy == "local-first")
        return "\n".join(out)

    def scan_text(self, root: str | None = None, form: str = "table", cache: str | None = None, exclude: list[str] | None = None) -> str:
        found, warnings, real = self.scan(root, exclude, cache)
        if form == "json":
            names = ["path", "extension", "language", "bytes", "estimated_tokens", "included", "excluded_reason", "risk_flags"]
            total = workspace.stats(found).first().asDict()
            files = [json.loads(r.j) for r in found.orderBy("ord").select(F.to_json(F.struct(*names)).alias("j")).toLocalIterator()]  # a file's text is as long as its lines
            return json.dumps({"rootPath": real, "scannedAt": now(), **total, "warnings": warnings, "files": files}, indent=2, ensure_ascii=False)
        return (console.scan_markdown if form == "markdown" else console.scan_table)(found, real, now(), warnings)
