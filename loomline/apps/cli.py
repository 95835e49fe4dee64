"""The command line: python -m loomline.apps.cli COMMAND ...

Results go to the terminal or, with --output, to a file that mustn't be there yet unless --force is given.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from loomline.apps import clients
from loomline.apps.service import Service
from loomline.operators import agent_rules, repo_map, reports, workspace
from loomline.operators.console import recommendation_table
from loomline.operators.models import OUTPUT_TOKENS
from loomline.sources import catalog, settings
from loomline.sources.files import read_folder

CONFIG = ".loomline.json"
CACHE = ".loomline/scan-cache"


def positive(text: str) -> int:
    if not text.isascii() or not text.isdigit() or not settings.positive(int(text)):
        raise argparse.ArgumentTypeError("must be a whole number above 0")
    return int(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomline", description="Tokens, models and maps of a workspace.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *options: str, path: bool = True) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=about)
        if path:
            own.add_argument("path", nargs="?", default=".")
        adds = {
            "goal": lambda: own.add_argument("--goal", choices=list(OUTPUT_TOKENS)), "privacy": lambda: own.add_argument("--privacy", choices=settings.PRIVACY), "catalog": lambda: own.add_argument("--catalog"),
            "output": lambda: (own.add_argument("--output"), own.add_argument("--force", action="store_true")),
        }
        for o in options:
            adds[o]()
        return own

    command("init", "write settings that suit a project", "goal", "privacy").add_argument("--dry-run", action="store_true")
    commands.choices["init"].add_argument("--force", action="store_true")
    scan = command("scan", "sums of a workspace", "goal", "privacy", "output")
    scan.add_argument("--format", choices=["table", "json", "markdown"], default="table")
    scan.add_argument("--cache", action="store_true")
    recommend = command("recommend", "models for a workspace", "goal", "privacy", "catalog", "output")
    recommend.add_argument("--format", choices=["table", "json"], default="table")
    recommend.add_argument("--token-budget", type=positive)
    map_ = command("repo-map", "a map of a workspace", "goal", "output")
    map_.add_argument("--budget", type=positive, default=64_000)
    map_.add_argument("--format", choices=["markdown", "json"], default="markdown")
    map_.add_argument("--no-symbols", action="store_true")
    map_.add_argument("--max-symbols", type=positive, default=100)
    rules = command("rules", "rules for an agent", "goal", "privacy", "output")
    rules.add_argument("--target", choices=[*agent_rules.FILES, "all"], default="generic")
    rules.add_argument("--mode", choices=list(agent_rules.BEHAVIOUR), default="normal")
    rules.add_argument("--stdout", action="store_true")
    rules.add_argument("--yes", action="store_true")
    report = command("report", "a report of a workspace", "goal", "privacy", "catalog", "output")
    report.add_argument("--format", choices=["markdown", "json"], default="markdown")
    report.add_argument("--include-repo-map", action="store_true")
    compact = command("compact", "a finished goal as short context", "output", path=False)
    compact.add_argument("--goal", required=True, choices=list(OUTPUT_TOKENS))
    compact.add_argument("--summary", required=True)
    for name in ("changed-file", "decision", "next-step"):
        compact.add_argument(f"--{name}", action="append", default=[])
    compact.add_argument("--source-tokens", type=positive)
    compact.add_argument("--format", choices=["markdown", "json"], default="markdown")
    command("mcp", "serve tools over standard input")
    models = command("catalog", "model catalogues", "output", path=False)
    models.add_argument("action", choices=["validate", "fetch"])
    models.add_argument("place")
    models.add_argument("--max-age-days", type=positive, default=90)
    config = command("mcp-config", "a client's settings", "output", path=False)
    config.add_argument("--target", choices=clients.CLIENTS, default="generic")
    config.add_argument("--command", dest="server", default=f"{sys.executable} -m loomline.apps.tools")
    config.add_argument("--workspace", default=".")
    return top


def run(argv: list[str], spark: object = None, catalogue: str | None = None) -> str:
    """What a command says."""
    a = parser().parse_args(argv)
    if a.command == "mcp-config":
        return clients.client_config(a.target, os.path.realpath(a.workspace), a.server.split())
    if a.command == "compact":
        text, tokens, saved = reports.finished_goal(a.goal, a.summary, a.changed_file, a.decision, a.next_step, a.source_tokens)
        return text if a.format == "markdown" else json.dumps({"content": text, "estimatedTokens": tokens, "savedTokens": saved}, indent=2)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    if a.command == "catalog":
        if a.action == "fetch":
            return catalog.fetch_models(spark, a.place).drop("ord").toPandas().to_json(orient="records", indent=2)  # FEED_LIMIT bytes at most
        told = Service(spark, os.path.dirname(os.path.realpath(a.place)) or ".").validate(os.path.realpath(a.place), a.max_age_days)
        return json.dumps(told, indent=2)
    root = os.path.realpath(a.path)
    own = settings.load_settings(os.path.join(root, CONFIG))
    goal, privacy = getattr(a, "goal", None) or own["defaultGoal"], getattr(a, "privacy", None) or own["privacyMode"]
    service = Service(spark, root, catalogue)
    if a.command == "init":
        return init(spark, root, a)
    if a.command == "mcp":
        from loomline.apps.tools import Tools

        for told in Tools(service).serve(sys.stdin):
            print(told, flush=True)
        return ""
    if a.command == "scan":
        return service.scan_text(None, a.format, CACHE if a.cache else None, own["exclude"])
    if a.command == "recommend":
        tokens = workspace.stats(service.scan(exclude=own["exclude"])[0]).first().included_tokens or 0
        told = service.recommend(tokens, goal, privacy, a.token_budget, a.catalog)
        return json.dumps(told, indent=2, ensure_ascii=False) if a.format == "json" else recommendation_table(told)
    if a.command == "repo-map":
        made = service.repo_map(None, a.goal, a.budget, not a.no_symbols, a.max_symbols)
        return json.dumps(made.__dict__, indent=2, ensure_ascii=False) if a.format == "json" else repo_map.markdown(made)
    if a.command == "rules":
        return rules_files(service, root, a, goal, privacy)
    return service.report(None, goal, privacy, a.catalog, a.format, a.include_repo_map)


def init(spark: object, root: str, a: argparse.Namespace) -> str:
    files = read_folder(spark, root)[0].select("path", "text")
    made, stack = settings.first_settings(files, a.goal, a.privacy)
    text, path = json.dumps(made, indent=2), os.path.join(root, CONFIG)
    if a.dry_run:
        return f"[DRY RUN] Inferred configuration for {stack.primary_language} project ({'Monorepo' if stack.is_monorepo else 'Single Package'}):\n{text}"
    if os.path.exists(path) and not a.force:
        raise FileExistsError(f"{path} is there already; use --force to overwrite it")
    catalog.write_with_backup(text, path)
    out = [f"File written: {path}", f"- Primary Language: {stack.primary_language}", f"- Monorepo: {'Yes' if stack.is_monorepo else 'No'}", *[f"- Frameworks: {', '.join(stack.frameworks)}"] * bool(stack.frameworks)]
    return "\n".join([*out, f"- Calibrated Context Budget: {stack.budget:,} tokens", f"- Default Goal: {made['defaultGoal']}", f"- Privacy Mode: {made['privacyMode']}", f"- Tailored Excludes: {len(made['exclude'])} rules active"])


def rules_files(service: Service, root: str, a: argparse.Namespace, goal: str, privacy: str) -> str:
    """Writes rules beside what they are for; a file that is there already only with --yes, and a copy of it is kept."""
    one = service.rules(None, "generic" if a.target == "all" else a.target, a.mode, goal, privacy)
    tokens = workspace.stats(service.scan()[0]).first().included_tokens or 0
    made = list(agent_rules.generate_all(mode=a.mode, workspace_tokens=tokens).values()) if a.target == "all" else [one]
    if a.stdout or a.output:
        return "\n\n".join(r.content for r in made)
    there = [r.file_name for r in made if os.path.exists(os.path.join(root, r.file_name))]
    if there and not a.yes:
        raise FileExistsError(f"there already: {', '.join(there)}; use --yes to overwrite")
    for r in made:
        catalog.write_with_backup(r.content, os.path.join(root, r.file_name))
    return "\n".join(f"Written: {r.file_name}" for r in made)


def main(argv: list[str] | None = None, spark: object = None, catalogue: str | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    try:
        told = run(argv, spark, catalogue)
        a = parser().parse_args(argv)
        if getattr(a, "output", None):
            catalog.write_text(told, a.output, a.force)
        elif told:
            print(told)
    except (ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
