"""Which files a repository map names, the map itself, and what fits its budget.

Lists, their order and what a budget may take are DataFrames. A map's Markdown is one text of a workspace, so its rows come
to the driver when it is made: the files that a list names, and as many symbols as asked.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import files, paths
from loomline.functions.once import with_once
from loomline.functions.tokens import weight
from loomline.operators import symbols as symbols_
from loomline.operators import workspace
from loomline.operators.text import code, plain
from loomline.operators.workspace import folders
from loomline.sources import scratch

BUCKETS = ["entry", "config", "docs", "test", "source", "other", "excluded"]


def entries(scan: DataFrame) -> DataFrame:
    """scan with map_language, priority, reason, bucket and whether a file is generated, large or risky."""
    path, flags = F.col("path"), F.col("risk_flags")
    rank = F.when(F.col("included"), files.priority(path, flags, F.col("estimated_tokens"))).otherwise(0)
    generated = F.array_contains(flags, "generated") | paths.basename(path).contains(".min.") | paths.basename(path).contains(".bundle.")
    ranked = with_once(scan, {"priority": rank, "generated": generated})
    p = F.col("priority")
    bucket = F.when(~F.col("included") | (p <= 10), "excluded").when(p >= 100, "entry").when(p >= 90, "config").when(p >= 80, "docs").when(p >= 70, "test").when(p >= 60, "source").otherwise("other")
    return ranked.withColumns({
        "map_language": files.of_map(F.col("extension"), files.MAP_LANGUAGES), "bucket": bucket, "reason": F.when(F.col("included"), files.reason(p)).otherwise(F.coalesce("excluded_reason", F.lit("Excluded by configuration"))),
        "large": F.col("included") & (F.col("estimated_tokens") > files.LARGE_TOKENS), "risky": F.col("included") & (F.size(flags) > 0) & ~F.array_contains(flags, "large-file"),
    })


def bucket_counts(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("bucket").agg(F.count(F.lit(1)).alias("files"), F.sum("estimated_tokens").cast("long").alias("tokens"))


def bucket_order() -> object:
    order = F.lit(len(BUCKETS))
    for n, b in enumerate(BUCKETS):
        order = F.when(F.col("bucket") == b, n).otherwise(order)
    return order


def recommended_include(mapped: DataFrame, limit: int = 50) -> DataFrame:
    return mapped.where("priority >= 60").orderBy(bucket_order(), "ord").limit(limit)


def recommended_exclude(mapped: DataFrame, least: int = 1000) -> DataFrame:
    """Large, generated, excluded and risky files of over so many tokens, each once, under the first list that has it."""
    lists = F.array(*[F.when(test, F.lit(n)) for n, test in enumerate((F.col("large"), F.col("generated"), F.col("bucket") == "excluded", F.col("risky")))])
    return mapped.withColumn("list_no", F.array_min(F.array_compact(lists))).where("list_no is not null").where(F.col("estimated_tokens") > least)


def map_folders(scan: DataFrame, limit: int = 20) -> DataFrame:
    return folders(scan).where("folder <> '.' and included_files > 0").orderBy(F.desc("total_tokens"), "ord").limit(limit)


def budget_prefix(mapped: DataFrame, budget: int) -> DataFrame:
    """Important files in order as long as their tokens' running sum stays within a budget.

    The sum runs over range partitions: each adds the totals of those before it, so no task sees all files.
    """
    narrow = mapped.where("priority >= 60").select("path", "ord", "bucket", "estimated_tokens", (F.lit(1000) - F.col("priority")).alias("_rank"))
    ordered = scratch.table(narrow, "ranked")  # the texts are read and classified once
    # files of a priority are dealt into stretches of their order, summed, and the stretches run on one another
    stretch = ordered.withColumn("_s", F.floor(F.col("ord") / 4096))
    sums = stretch.groupBy("_rank", "_s").agg(F.sum("estimated_tokens").alias("_t"))
    before = Window.orderBy("_rank", "_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    within = Window.partitionBy("_rank", "_s").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    total = stretch.withColumn("_own", F.sum("estimated_tokens").over(within)).join(starts, ["_rank", "_s"])
    return total.withColumn("running", F.col("_start") + F.col("_own")).where(F.col("running") <= budget).select("path", "bucket", "estimated_tokens", "running")


#: Lists of a map in the order in which a budget takes files from them; files of the last three lists stay.
TAKEN, KEPT = ["large", "generated", "risky", "excluded", "test", "important"], ["entry", "config", "docs"]
#: How many rows a map shows.
CAPS = {"include": 15, "exclude": 10, "symbols": 30, "imports": 15, "edges": 30, "entry hints": 5}


def listed(mapped: DataFrame) -> DataFrame:
    """mapped with lists, the names of the lists of a map that a file is in."""
    tests = {
        "large": F.col("large"), "generated": F.col("generated"), "risky": F.col("risky"), "excluded": F.col("bucket") == "excluded", "test": F.col("bucket") == "test",
        "important": F.col("priority") >= 60, "entry": F.col("bucket") == "entry", "config": F.col("bucket") == "config", "docs": F.col("bucket") == "docs",
    }
    return mapped.withColumn("lists", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()])))


def trim_order(mapped: DataFrame) -> DataFrame:
    """Files that a budget may take, with n, the first list that has them: all that stand in a list but those in KEPT."""
    own = mapped if "lists" in mapped.columns else listed(mapped)
    kept = F.max(F.arrays_overlap("lists", F.array(*map(F.lit, KEPT)))).over(Window.partitionBy("path"))  # rows of a path stay together; a scan is read once
    first = F.array_min(F.transform("lists", lambda x: F.array_position(F.array(*map(F.lit, TAKEN)), x)))
    return own.where(F.size("lists") > 0).withColumn("_kept", kept).where("not _kept").drop("_kept").withColumn("n", first.cast("int")).where("n > 0")


def display_order(mapped: DataFrame) -> DataFrame:
    """(path, priority) of important files in the order in which a map shows them. A sort reads its rows twice, so they are written first, without the texts."""
    own = scratch.table(mapped.where("priority >= 60").select("path", "priority", "ord"), "ranked")
    return own.orderBy(F.desc("priority"), "ord").select("path", "priority")


def counts(mapped: DataFrame) -> DataFrame:
    """One row of what a map's summary tells, in one pass."""
    has = lambda name: F.count_if(F.array_contains("lists", name))
    told = (mapped if "lists" in mapped.columns else listed(mapped)).agg(
        has("important").alias("important"), has("entry").alias("entry"), has("test").alias("test"), has("config").alias("config"), has("docs").alias("docs"), has("large").alias("large"), has("risky").alias("risky"),
        has("generated").alias("generated"), has("excluded").alias("excluded"), F.coalesce(F.sum(F.when(F.array_contains("lists", "important"), F.col("estimated_tokens"))), F.lit(0)).alias("important_tokens"),
        F.count_if("included").alias("included_files"), F.count_if(~F.col("included")).alias("excluded_files"), F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("total_tokens"),
    )
    return told


@dataclass
class RepoMap:
    """A map's lists and facts: bounded by a workspace's listed files, as the Markdown that it makes is one text."""

    root: str
    generated_at: str
    budget: int
    summary: list[str]
    instructions: list[str]
    workspace_tokens: int
    folders: list[tuple]
    languages: list[tuple]
    files: list[dict]
    include: list[dict]
    exclude: list[dict]
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    routes: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    estimated_tokens: int = 0

    def of(self, name: str) -> list[dict]:
        return [f for f in self.files if name in f["lists"]]

    def without(self, gone: set[str]) -> RepoMap:
        """The map without some files, wherever they are named."""
        stay = lambda rows: [r for r in rows if r["path"] not in gone]
        return replace(self, files=stay(self.files), include=stay(self.include), exclude=stay(self.exclude), symbols=stay(self.symbols), imports=stay(self.imports), routes=stay(self.routes))

    def symbol_summary(self) -> list[str]:
        n = lambda *kinds: sum(s["kind"] in kinds for s in self.symbols)
        if not self.symbols:
            return []
        files, out = len({s["path"] for s in self.symbols}), sum(bool(s["exported"]) for s in self.symbols)
        return [f"{len(self.symbols)} symbols extracted from {files} files", f"Exports: {out}", f"Functions: {n('function', 'component')}", f"Classes: {n('class')}", f"Interfaces/Types: {n('interface', 'type')}", f"Routes: {len(self.routes)}"]

    def compact(self) -> dict:
        """What a tool's client gets of a map."""
        rows = lambda some, name: [{name: a, "tokens": t, "files": n} for a, n, t in some]
        return {
            "rootPath": self.root, "generatedAt": self.generated_at, "estimatedTokens": self.estimated_tokens, "workspaceTotalTokens": self.workspace_tokens, "summary": "\n".join(self.summary),
            "topLevelFolders": rows(self.folders, "path"), "languageBreakdown": rows(self.languages, "language"), "importantFileCount": len(self.of("important")), "entryPointCount": len(self.of("entry")),
            "riskyFileCount": len(self.of("risky")), "largeFileCount": len(self.of("large")), "symbolCount": len(self.symbols),
        }


def create(
    scan: DataFrame, budget: int, root: str = ".", generated_at: str = "", goal: str | None = None, files: DataFrame | None = None, manifests: DataFrame | None = None, max_symbols: int = 100, parse_limit: int = symbols_.PARSE_LIMIT
) -> RepoMap:
    """The map of a scan within a budget of tokens; files (path, text) are parsed for symbols, imports and routes if given."""
    narrow = [c for c in ("ord", "path", "extension", "language", "bytes", "estimated_tokens", "included", "excluded_reason", "risk_flags") if c in scan.columns]
    mapped = scratch.table(listed(entries(scan.select(*narrow))), "mapped")  # without the texts, and classified once
    summed = scratch.table(workspace.sums(mapped), "sums")
    c = counts(mapped).first()
    part = f"{c.included_files / c.total_files * 100:.1f}" if c.total_files else "0.0"
    summary = [
        f"Files: {c.included_files} included / {c.excluded_files} excluded ({part}% of {c.total_files} total)", f"Important files identified: {c.important}", f"Entry points: {c.entry}", f"Tests: {c.test}", f"Config files: {c.config}",
        f"Documentation files: {c.docs}", f"Large files: {c.large}", f"Risky files: {c.risky}", f"Tokens in important files: ~{c.important_tokens:,}", f"Workspace total: ~{c.total_tokens:,} tokens",
    ]
    rows = lambda df, *names: [r.asDict() for r in df.select("path", "estimated_tokens", "priority", "reason", "map_language", "lists", *names).collect()]
    kept = mapped
    own = rows(kept.where(F.size("lists") > 0).orderBy("ord"), "ord")
    first = [f["path"] for f in own if "entry" in f["lists"]][: CAPS["entry hints"]]
    told = ["Start by reading this repo map to understand the workspace structure.", "Do not read the full contents of large files unless specifically needed."]
    told += [f"Key entry points to read first: {', '.join(first)}"] * bool(first)
    told += [f"There are {c.large} large file(s). Ask before reading them."] * bool(c.large) + [f"There are {c.risky} potentially sensitive file(s). Ask before reading."] * bool(c.risky)
    told += [f"There are {c.generated} generated file(s). Avoid editing them."] * bool(c.generated) + [f"The current workspace goal is: {goal}"] * bool(goal)
    told += ["Prefer reading targeted files over scanning entire directories.", "Use patch-only output when making code changes."]
    per = workspace.view(summed, "language").select("name", "files", "tokens").collect()
    shape = workspace.view(summed, "folder").where("name <> '.' and included > 0").limit(20)
    made = RepoMap(
        root, generated_at, budget, summary, told, c.total_tokens, [tuple(r) for r in shape.select("name", "included", "tokens").collect()], [tuple(r) for r in per], own,
        rows(recommended_include(kept)), rows(recommended_exclude(kept).orderBy("list_no", "ord")),
    )
    if files is not None:
        important = mapped.where("priority >= 60")
        marks = important.select("path").distinct().join(symbols_.eligible(mapped, important, parse_limit).select("path", F.lit(True).alias("_parsed")).distinct(), "path", "left")
        shown = scratch.table(files.select("path", "text").join(marks, "path"), "texts")  # each language's search reads them, so they are found once
        texts = shown.where("_parsed").drop("_parsed")
        made.symbols = [r.asDict() for r in symbols_.rank_symbols(symbols_.all_symbols(texts), goal or "build-mvp", max_symbols).collect()]
        made.imports = [r.asDict() for r in symbols_.resolve(symbols_.all_imports(texts), mapped).select("path", "source", "kind", "resolved").orderBy("path", "source").collect()]
        routes = symbols_.call_routes(shown).select("path", "route", "framework", "reason")
        if manifests is not None:
            placed = symbols_.file_routes(important.select("path"), manifests)
            routes = placed.select("path", "route", F.lit("nextjs").alias("framework"), F.concat(F.lit("Next.js "), "router", F.lit(" route")).alias("reason")).unionByName(routes)
        made.routes = [r.asDict() for r in routes.orderBy("path", "route").collect()]
    return within_budget(made, [r.path for r in trim_order(mapped).orderBy("n", "ord").select("path").collect()])


def settled(made: RepoMap) -> RepoMap:
    """The map with the tokens of its Markdown, which names them."""
    return replace(made, estimated_tokens=repeated(*weight(markdown(replace(made, estimated_tokens=0))), made.estimated_tokens))


def repeated(units: int, words: int, first: int) -> int:
    """The tokens of a Markdown that names none yet, once it names its own: from those that it named first, twice."""
    for _ in range(2):
        first = max(1, math.ceil((units + len(f"{first:,}") - 1) / 4), math.ceil(words * 1.3))
    return first


class Sizes:
    """The tokens of a map without the first n files of an order, for any n, without its Markdown being made again.

    Each file's lines are weighed once and summed along the order; what else a map has is made for each n, without those lines.
    """

    def __init__(self, made: RepoMap, order: list[str]) -> None:
        self.made, self.at = made, {}
        for n, path in enumerate(order):
            self.at.setdefault(path, n)
        found = {}
        for f in made.files:
            place = self.at.get(f["path"], math.inf)
            for name in f["lists"]:
                found.setdefault(name, []).append((place, *(weight(line(name, f)) if name in LINES else (0, 0))))
        self.lists = {}
        for name, own in found.items():
            own.sort()
            sums = [(0, 0)]
            for _, units, words in own:
                sums.append((sums[-1][0] + units, sums[-1][1] + words))
            self.lists[name] = ([place for place, _, _ in own], sums)

    def left(self, name: str, n: int) -> tuple[int, int, int]:
        """(files, code units, words) of a list when n files are gone."""
        places, sums = self.lists.get(name, ([], [(0, 0)]))
        gone = bisect_left(places, n)
        return len(places) - gone, sums[-1][0] - sums[gone][0], sums[-1][1] - sums[gone][1]

    def __call__(self, n: int) -> int:
        stay = lambda rows: (r for r in rows if self.at.get(r["path"], math.inf) >= n)
        m = self.made
        rest = replace(m, files=[], estimated_tokens=0, include=list(islice(stay(m.include), CAPS["include"])), exclude=list(islice(stay(m.exclude), CAPS["exclude"])), symbols=list(stay(m.symbols)), imports=list(stay(m.imports)), routes=list(stay(m.routes)))
        units, words = weight(markdown(rest, lambda name: self.left(name, n)[0]))
        for name in LINES:
            count, more, of_them = self.left(name, n)
            units, words = units + more + count, words + of_them  # a line feed for each line
        return repeated(units, words, m.estimated_tokens)


def within_budget(made: RepoMap, order: list[str]) -> RepoMap:
    """The map without the fewest files, in that order, that bring it under its budget, and notes on it.

    Markdown gets shorter as files go, but for a few words where a list runs empty, so the number of files is found by
    halving, and the numbers right below it are tried too. The notes on it come last and may lead over the budget again,
    which the last note then says.
    """
    if not math.isfinite(made.budget) or made.budget <= 0:
        raise ValueError(f"token budget must be a finite number > 0 (got {made.budget})")
    whole = settled(made)
    if whole.estimated_tokens <= made.budget:
        return whole
    noted = replace(made, notes=[*made.notes, f"Budget of {made.budget:,} tokens exceeded; lower-priority sections were trimmed."])
    size = Sizes(noted, order)
    low, high = 1, len(order)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if size(mid) <= made.budget else (mid + 1, high)
    gone = min(low, len(order))
    gone = next((n for n in range(max(1, gone - 16), gone) if size(n) <= made.budget), gone)
    out = noted.without(set(order[:gone]))
    if gone:
        out = replace(out, notes=[*out.notes, f"Trimmed {gone} lower-priority file(s); entry points, config, and documentation were preserved."])
    out = settled(out)
    if out.estimated_tokens > made.budget:
        out = settled(replace(out, notes=[*out.notes, f"The required high-priority sections need {out.estimated_tokens:,} tokens and cannot fit the requested budget."]))
    return out


#: A section's heading, list, words for none, and words before the list.
SECTIONS = [
    ("Entry Points", "entry", "No entry points detected.", ""), ("Tests", "test", "No test files detected.", ""), ("Config & Tooling", "config", "No config files detected.", ""), ("Documentation", "docs", "No documentation files detected.", ""),
    ("Large / Noisy Files", "large", "No large or noisy files detected.", "The following files exceed ~50K estimated tokens and should usually not be sent to an AI agent:"),
    ("Risk / Sensitive Files", "risky", "No risk-flagged files detected.", "The following files may contain sensitive information. Contents are not exposed here:"),
]
#: What a map tells an agent.
GUIDELINES = [
    "Ask before reading files marked as risky or sensitive.", "Summarize large files instead of reading them fully.", "Use patch-only output for code changes to minimize token usage.",
    "Prefer reading targeted files over scanning entire directories.",
]
PREFIX = "> You are working in this repository. Start by reading this repo map. Do not read large files unless needed. Prefer targeted file reads. Use patch-only output for code changes. Ask before reading risky or generated files."


#: The lists whose files have a line each in a map.
LINES = ["important", *[name for _, name, _, _ in SECTIONS]]


def line(name: str, f: dict) -> str:
    """A file's line under a list."""
    if name == "important":
        return f"| {code(f['path'])} | {plain(f['reason'])} | {f['estimated_tokens']:,} | {f['priority']} |"
    lang = plain(f" ({f['map_language']})") if name == "entry" and f["map_language"] else ""
    return f"- {code(f['path'])}{lang} — ~{f['estimated_tokens']:,} tokens"


def markdown(m: RepoMap, held: Callable[[str], int] | None = None) -> str:
    """The map as Markdown; held tells how many files lists have whose lines are left out."""
    if held is None:
        of = {name: m.of(name) for name in {*LINES, "excluded"}}
        held = lambda name: len(of[name])
    else:
        of = dict.fromkeys(LINES, [])
    sized = lambda f: f"{code(f['path'])} — ~{f['estimated_tokens']:,} tokens"
    grid = lambda head, rules, rows: [f"| {' | '.join(head)} |", "|" + "".join(" ---:|" if r == "r" else " --- |" for r in rules), *("| " + " | ".join(map(str, r)) + " |" for r in rows), ""]
    out = ["# Repo Map", "", "## Summary", ""]
    facts = {"Workspace Root": code(m.root), "Generated": m.generated_at, "Token Budget": f"{m.budget:,}", "Estimated Repo Map Tokens": f"{m.estimated_tokens:,}", "Workspace Total Tokens": f"{m.workspace_tokens:,}", "Included Files": held("important"), "Excluded Files": held("excluded")}
    out += [f"- **{k}:** {v}" for k, v in facts.items()] + ["", plain("\n".join(m.summary)), "", "## Project Shape", ""]
    for title, head, rows, shown in (("Top-Level Folders", "Folder", m.folders, code), ("Language Breakdown", "Language", m.languages, plain)):
        if rows:
            out += [f"### {title}", "", *grid([head, "Files", "Estimated Tokens"], "lrr", [[shown(a), n, f"{t:,}"] for a, n, t in rows])]
    important = sorted(of["important"], key=lambda f: -f["priority"])
    out += ["## Important Files", ""] + ([*grid(["Path", "Reason", "Tokens", "Priority"], "llrr", [])[:-1], *[line("important", f) for f in important], ""] if held("important") else ["No important files identified.", ""])
    for title, name, none, lead in SECTIONS:
        out += [f"## {title}", ""] + ([lead, ""] * bool(lead) + [line(name, f) for f in of[name]] if held(name) else [none]) + [""]
    if m.symbols:
        shown = [[code(s["name"]), plain(s["kind"]), code(s["path"]), "yes" if s["exported"] else "", s["priority"]] for s in m.symbols[: CAPS["symbols"]]]
        rows = grid(["Symbol", "Kind", "File", "Exported", "Priority"], "llllr", shown)
        more = len(m.symbols) - len(shown)
        out += ["## Key Symbols", "", *rows[:-1], *[f"| *... and {more} more* | | | |"] * (more > 0), ""]
    if m.routes:
        out += ["## Routes / Entry Handlers", "", *grid(["File", "Route / Framework", "Reason"], "lll", [[code(r["path"]), plain(r["route"] or r["framework"] or "unknown"), plain(r["reason"])] for r in m.routes])]
    if m.imports:
        often = Counter(i["source"] for i in m.imports).most_common(CAPS["imports"])
        out += ["## Import / Dependency Hints", "", *grid(["Module", "Files Importing"], "lr", [[code(a), n] for a, n in often])]
        if edges := [[code(i["path"]), code(i["resolved"])] for i in m.imports if i["resolved"]][: CAPS["edges"]]:
            out += ["### Resolved Dependency Edges", "", *grid(["From", "To"], "ll", edges)]
    out += ["## Recommended Agent Context", ""]
    if m.include:
        out += ["### Files to Read First", "", *[f"- {code(f['path'])} — {plain(f['reason'])}" for f in m.include[: CAPS["include"]]], ""]
    if m.exclude:
        out += ["### Files to Avoid", "", *[f"- {sized(f)}" for f in m.exclude[: CAPS["exclude"]]], ""]
    out += ["### Guidelines", "", *[f"- {g}" for g in GUIDELINES], "", "## Suggested Prompt Prefix", "", PREFIX, "", "## Overflow Notes", ""]
    out += [f"- {plain(n)}" for n in m.notes] or ["No budget trimming applied. All files fit within the requested budget."]
    return "\n".join([*out, ""])
