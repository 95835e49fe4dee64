"""Rules that tell a coding agent how to behave in a workspace, in the formats that agents read."""

from __future__ import annotations

from dataclasses import asdict, dataclass

#: File names by agent.
FILES = {
    "cursor": ".cursorrules", "claude-code": "CLAUDE.md", "codex": ".codexrules", "cline": ".clinerules", "roo": ".roorules", "continue": ".continuerules", "aider": ".aiderrules", "generic": "AGENTS.md",
    "windsurf": ".windsurfrules", "copilot": ".github/copilot-instructions.md", "gemini": "GEMINI.md",
}
#: Tokens by mode, for the others DEFAULT_BUDGET.
BUDGETS, DEFAULT_BUDGET = {"concise": 16_000, "patch-only": 32_000, "caveman": 8_000}, 64_000
#: What to leave alone, by mode and by format.
AVOID = {"repo-map-first": ["dist/", "node_modules/", ".git/", "*.min.js", "*.bundle.js"], "patch-only": ["*.lock", "*.log", "dist/", ".env*"]}
DEFAULT_AVOID = ["node_modules/", ".git/", "dist/"]
FORMAT_AVOID = {
    "windsurf": ["dist/", "node_modules/", ".git/", "*.min.js", "*.bundle.js", "*.lock", "*.log", "coverage/"],
    "copilot": ["node_modules/", ".git/", "dist/", "build/", "*.min.js", "*.bundle.js", "coverage/"],
    "gemini": [".git/", "node_modules/", "dist/", "build/", "*.min.js", "*.lock", "*.log", "*.tmp"],
}
#: Behaviour by mode.
BEHAVIOUR = {
    "normal": ["Read and edit files with full context awareness.", "Apply changes incrementally and verify before continuing.", "Respect existing code style, naming conventions, and architecture.", "Ask for clarification when requirements are ambiguous."],
    "concise": ["Minimize output. Do not include plans or reasoning unless asked.", "Prefer single-line edits over multi-line rewrites.", "Omit explanatory commentary. Just produce the code change.", "Use short variable names when appropriate to reduce token use."],
    "caveman": ["Use short, simple words and sentences.", "Avoid abstractions, interfaces, or complex patterns.", "Prefer copy-paste reuse over extraction.", "Do not add type annotations or generics unless necessary."],
    "patch-only": ["Only output file edits in patch format.", "Do not echo back the user's code or describe what you changed.", "Skip any conversational preamble or sign-off.", "Use unified diff or search/replace blocks exclusively."],
    "test-first": ["Before implementing any function, write its test first.", "Cover edge cases, error states, and happy paths.", "Run the test suite after every change.", 'Do not skip tests for "simple" changes.'],
    "plan-then-edit": ["Before editing, output a one-paragraph plan with the files to touch.", "Wait for user confirmation before making edits.", "After edits, summarize what changed and why."],
    "repo-map-first": ["Start by reading the repository map (file tree + file summaries).", "Do not read full file contents unless required for the edit.", "Use directory listings to find relevant files before reading them.", "Prefer targeted reads over scanning entire directories."],
    "ask-before-large-files": ["Before reading files >5 KB, ask the user for permission.", "Use file summaries and head/tail reads to minimize token usage.", "Cache previously read file contents within the session.", "Do not read large binary files or lock files."],
    "no-full-file-dumps": ["Never output the full content of an unmodified file.", "Use search/replace blocks to show only changed regions.", "When reviewing, reference line numbers rather than dumping code."],
    "use-summaries": ["When exploring the codebase, request summaries over full file reads.", "Build a mental model of the codebase using tree views and grep.", "Use file-at-a-time access rather than batch reads."],
}
#: Rules for all.
COMMON = [
    "Stay within the token budget for every response.", "Do not modify files outside the workspace root.", "Respect .gitignore patterns when exploring the file tree.",
    "Confirm before running destructive commands (delete, force-push, etc.).", "When in doubt, ask the user — do not guess.",
]
#: A format's behaviour by mode, the last for all others.
WINDSURF = {
    "concise": ["Be extremely direct. State the change and rationale in 2-3 sentences.", "Omit conversational filler, disclaimers, and pleasantries."],
    "patch-only": ["Output only unified diffs or minimal code replacement chunks.", "Zero conversational explanations unless specifically requested."],
    "caveman": ["Terse bullet points only. Maximum brevity."],
    "": ["Provide balanced explanations with clear code snippets and verification notes."],
}
#: Headings and lines of the formats.
WINDSURF_GUIDE = ["Read workspace architecture before making invasive modifications.", "Use focused edits; prefer targeted replacements over full-file rewrites.", "Never modify or regenerate files matching ignore patterns below.", "Maintain existing code style, documentation comments, and typing annotations."]
COPILOT_STYLE = ["Language: TypeScript strict mode enabled throughout.", "Modularity: Functional programming preferred over deep class inheritance.", "Documentation: Preserve existing TSDoc/JSDoc comments on unchanged code.", "Safety: Zero telemetry, zero external network calls in core packages."]
COPILOT_READY = ["Always verify code with unit tests before declaring completion.", "Ensure changes have zero merge conflicts against upstream branches.", "Avoid introducing new external dependencies without explicit approval."]
GEMINI_PLAN = ["For complex multi-file refactoring, enter Planning Mode and create an implementation plan before edits.", "Verify code behavior using unit tests before concluding tasks.", "Strictly preserve documentation integrity and comment headers."]
GEMINI_TOOLS = ["Prefer precise file replacement chunks over full-file overwrites.", "Do not run destructive git commands or commit directly without verification."]
GENERATOR = "loomline"


@dataclass
class AgentRules:
    target: str
    mode: str
    file_name: str
    content: str
    avoid_files: list[str]
    token_budget: int

    def as_dict(self) -> dict:
        return asdict(self)


def bullets(some: list[str]) -> list[str]:
    return [f"- {x}" for x in some]


def budget_of(mode: str) -> int:
    return BUDGETS.get(mode, DEFAULT_BUDGET)


def general(target: str, mode: str, tokens: int, models: list[str], avoid: list[str]) -> list[str]:
    sections = {
        "Workspace Context": [f"- Estimated workspace tokens: {tokens:,}"] + [f"- Recommended models: {', '.join(models)}"] * bool(models), "Behavior": bullets(BEHAVIOUR[mode]),
        "File Handling": [f"- Avoid reading or editing: `{p}`" for p in avoid], "Token Budget": [f"- Target token limit: {budget_of(mode):,} tokens"], "Rules": [f"{n}. {x}" for n, x in enumerate(COMMON, 1)],
    }
    out = [f"# {target} Agent Rules", f"> Generated by {GENERATOR}", f"> Mode: {mode}"]
    for title, lines in sections.items():
        out += ["", f"## {title}", *lines]
    return out


def windsurf(mode: str, tokens: int, models: list[str], avoid: list[str], test: str, build: str) -> list[str]:
    out = ["# Windsurf Workspace Rules (.windsurfrules)", f"# Generated by {GENERATOR}", "", "## Workspace Context & Token Budget", f"- Estimated Workspace Size: ~{tokens:,} tokens", f"- Optimization Mode: {mode}"]
    out += [f"- Recommended Models: {', '.join(models)}"] * bool(models) + ["", "## Cascade Agent Execution Guidelines", *bullets(WINDSURF_GUIDE), "", "## Verification & Quality Gates", f"- Build Command: `{build}`", f"- Test Command: `{test}`"]
    out += ["- Run tests after every discrete component change to verify no regression.", "", "## File Exclusion Boundaries", *[f"- Avoid reading/indexing: `{p}`" for p in avoid]]
    return [*out, "", "## Behavioral Mode Instructions", *bullets(WINDSURF.get(mode, WINDSURF[""])), ""]


def copilot(mode: str, tokens: int, avoid: list[str], description: str, conventions: list[str]) -> list[str]:
    out = ["# GitHub Copilot Instructions (.github/copilot-instructions.md)", f"# Generated by {GENERATOR}", "", "## Project Overview", f"- Description: {description}", f"- Workspace Token Budget: ~{tokens:,} tokens", f"- Optimization Preference: {mode}"]
    out += ["", "## Coding Conventions & Style", *bullets([*COPILOT_STYLE, *conventions]), "", "## Pull Request Readiness", *bullets(COPILOT_READY)]
    return [*out, "", "## Context Guardrails & Excluded Artifacts", *[f"- Exclude from suggestions: `{p}`" for p in avoid], ""]


def gemini(mode: str, tokens: int, avoid: list[str], role: str, notes: list[str]) -> list[str]:
    out = ["# Gemini System Prompt & Guidelines (GEMINI.md)", f"# Generated by {GENERATOR}", "", "## Persona & Role", f"- Role: {role}", f"- Workspace Token Footprint: ~{tokens:,} tokens", f"- Mode: {mode}"]
    out += ["", "## Reasoning & Planning Policy", *bullets(GEMINI_PLAN), "", "## Tooling & Execution Directives", *bullets(notes or GEMINI_TOOLS)]
    return [*out, "", "## Token Boundaries & Excluded Paths", *[f"- Ignore from workspace search: `{p}`" for p in avoid], ""]


def generate(
    target: str, mode: str = "normal", workspace_tokens: int = 0, models: list[str] | None = None, test_command: str = "pnpm test", build_command: str = "pnpm build",
    description: str = "Local-first token and context optimization workspace", conventions: list[str] | None = None, role: str = "Senior Full-Stack Architect & Optimization Specialist", notes: list[str] | None = None,
) -> AgentRules:
    """The rules of one agent in one mode."""
    if target not in FILES or mode not in BEHAVIOUR:
        raise ValueError(f"unknown agent or mode: {target}, {mode}")
    avoid = FORMAT_AVOID.get(target) or AVOID.get(mode, DEFAULT_AVOID)
    lines = {
        "windsurf": lambda: windsurf(mode, workspace_tokens, models or [], avoid, test_command, build_command), "copilot": lambda: copilot(mode, workspace_tokens, avoid, description, conventions or []),
        "gemini": lambda: gemini(mode, workspace_tokens, avoid, role, notes or []),
    }.get(target, lambda: general(target, mode, workspace_tokens, models or [], avoid))()
    return AgentRules(target, mode, FILES[target], "\n".join(lines), avoid, budget_of(mode))


def generate_all(**options: object) -> dict[str, AgentRules]:
    """The rules of six agents."""
    return {name: generate(target, **options) for name, target in {"cursor": "cursor", "claude": "claude-code", "generic": "generic", "windsurf": "windsurf", "copilot": "copilot", "gemini": "gemini"}.items()}
