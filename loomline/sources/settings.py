"""A workspace's settings, the policy of a team laid over them, and the stack that marker files tell of."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.models import OUTPUT_TOKENS

#: What holds where a file names nothing else.
DEFAULTS = {
    "defaultGoal": "build-mvp", "privacyMode": "local-first", "currency": "USD",
    "tokenBudget": {"defaultContextBudget": 64_000, "maxFullWorkspaceScan": 1_000_000, "warnAt": 200_000},
    "exclude": ["node_modules/**", "dist/**", "build/**", ".next/**", "coverage/**", "package-lock.json", "pnpm-lock.yaml"],
}
#: Privacy settings, and the version of a policy file.
PRIVACY, POLICY_VERSION = ("local-first", "cloud-ok"), "1.0"
#: Patterns to leave out by language.
STACK_EXCLUDES = {
    "rust": ["target"], "go": ["vendor", "bin"], "python": [".venv", "venv", "__pycache__", ".pytest_cache", ".ruff_cache", "*.pyc"],
    "typescript": ["dist", "build", ".next", ".turbo", "coverage", "storybook-static"], "javascript": ["dist", "build", ".next", ".turbo", "coverage", "storybook-static"], "generic": [],
}
#: Frameworks by the packages that tell of them.
FRAMEWORKS = {"Next.js": ("next",), "Vite": ("vite",), "React": ("react",), "Vue": ("vue",), "Testing (Vitest/Jest)": ("vitest", "jest")}


def goal(x: object) -> bool:
    return isinstance(x, str) and x in OUTPUT_TOKENS


def privacy(x: object) -> bool:
    return isinstance(x, str) and x in PRIVACY


def positive(x: object) -> bool:
    whole = isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer()
    return whole and 0 < x < 1 << 53


def names(x: object) -> bool:
    return isinstance(x, list) and all(isinstance(s, str) and s for s in x)


def need(value: dict, field: str, test: Callable[[object], bool], where: str) -> None:
    if field in value and not test(value[field]):
        raise ValueError(f"invalid {field} in {where}")


def parse_settings(value: object) -> dict:
    """Settings with defaults for what they leave out; fields that aren't known stay as they are."""
    if not isinstance(value, dict):
        raise ValueError("settings must be an object")
    for field, test in (("defaultGoal", goal), ("privacyMode", privacy), ("exclude", names), ("tokenBudget", lambda x: isinstance(x, dict))):
        need(value, field, test, "settings")
    budget = value.get("tokenBudget", {})
    for field in DEFAULTS["tokenBudget"]:
        need(budget, field, positive, "tokenBudget")
    return DEFAULTS | value | {"tokenBudget": {f: budget.get(f, default) for f, default in DEFAULTS["tokenBudget"].items()}}


def parse_policy(value: object) -> dict:
    if not isinstance(value, dict) or value.get("schemaVersion") != POLICY_VERSION:
        raise ValueError(f"a policy's schemaVersion must be {POLICY_VERSION}")
    for field, test in (("defaultGoal", goal), ("privacyMode", privacy), ("maxTokenBudget", positive), ("exclude", names), ("modelProfiles", lambda x: isinstance(x, list))):
        need(value, field, test, "policy")
    seen = set()
    for p in value.get("modelProfiles", []):
        if not isinstance(p, dict) or not isinstance(p.get("id"), str) or not p["id"].strip() or p["id"] in seen:
            raise ValueError("every model profile needs an id of its own")
        seen.add(p["id"])
        for field in ("allowedProviders", "allowedModelIds", "preferredModelIds"):
            need(p, field, names, f"profile {p['id']}")
    need(value, "activeProfile", lambda x: isinstance(x, str) and x in seen, "policy")
    return value


def active_profile(policy: dict | None) -> dict | None:
    return next((p for p in (policy or {}).get("modelProfiles", []) if p["id"] == policy.get("activeProfile")), None)


def under_policy(settings: dict, policy: dict | None) -> dict:
    """Settings as a policy changes them: its goal and privacy win, exclusions unite, the smaller budget holds."""
    if not policy:
        return settings
    budget = dict(settings["tokenBudget"])
    budget["defaultContextBudget"] = min(budget["defaultContextBudget"], policy.get("maxTokenBudget", budget["defaultContextBudget"]))
    exclude = list(dict.fromkeys([*settings["exclude"], *policy.get("exclude", [])]))
    won = {f: policy[f] for f in ("defaultGoal", "privacyMode") if f in policy}
    return settings | won | {"exclude": exclude, "tokenBudget": budget, "teamPolicy": policy}


def read(path: str) -> object:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load_settings(settings_path: str, policy_path: str | None = None) -> dict:
    """The settings of a file under a policy file; either may be missing."""
    settings = parse_settings(read(settings_path)) if os.path.exists(settings_path) else parse_settings({})
    return under_policy(settings, parse_policy(read(policy_path)) if policy_path and os.path.exists(policy_path) else None)


def project_stack(files: DataFrame) -> DataFrame:
    """One row from files (path, text): primary_language, is_monorepo, frameworks, excludes, budget. Only files at the root tell."""
    has = lambda *n: F.coalesce(F.bool_or(F.col("path").isin(*n)), F.lit(False))
    package = F.max(F.when(F.col("path") == "package.json", F.col("text")))
    marks = files.agg(
        has("Cargo.toml").alias("rust"), has("go.mod").alias("go"), has("pyproject.toml", "requirements.txt").alias("python"), has("tsconfig.json").alias("typescript"),
        has("package.json").alias("javascript"), has("pnpm-workspace.yaml", "nx.json", "turbo.json").alias("is_monorepo"), package.alias("package"),
    )
    language: Column = F.coalesce(*[F.when(F.col(n), F.lit(n)) for n in ("rust", "go", "python", "typescript", "javascript")], F.lit("generic"))
    parsed = F.from_json("package", "dependencies map<string,string>, devDependencies map<string,string>")
    listed = lambda f: F.coalesce(F.map_keys(parsed[f]), F.array().cast("array<string>"))
    deps = F.concat(listed("dependencies"), listed("devDependencies"))
    script = F.col("primary_language").isin("typescript", "javascript")
    found = F.array(*[F.when(script & F.arrays_overlap(F.col("_deps"), F.array(*map(F.lit, n))), F.lit(name)) for name, n in FRAMEWORKS.items()])
    own = F.element_at(F.create_map(*[x for n, p in STACK_EXCLUDES.items() for x in (F.lit(n), F.array(*map(F.lit, p)).cast("array<string>"))]), F.col("primary_language"))
    told = marks.withColumns({"primary_language": language, "_deps": deps}).withColumns({"frameworks": F.array_compact(found), "excludes": F.array_distinct(F.concat(F.array(*map(F.lit, DEFAULTS["exclude"])), own))})
    return told.select("primary_language", "is_monorepo", "frameworks", "excludes", F.when(F.col("is_monorepo"), 200_000).otherwise(128_000).alias("budget"))


def first_settings(files: DataFrame, goal: str | None = None, privacy: str | None = None) -> tuple[dict, object]:
    """The settings to begin with in a project of these files, and the row of project_stack() that they follow."""
    stack = project_stack(files).first()
    private = privacy or ("local-first" if stack.primary_language == "rust" else DEFAULTS["privacyMode"])
    budget = {"defaultContextBudget": stack.budget, "maxFullWorkspaceScan": 2 * stack.budget, "warnAt": int(stack.budget * 0.8 + 0.5)}
    return {"defaultGoal": goal or DEFAULTS["defaultGoal"], "privacyMode": private, "exclude": list(stack.excludes), "tokenBudget": budget}, stack
