"""Symbols, imports and routes of source files, by patterns over their lines.

Symbols of Python, JavaScript and of Java, Kotlin, Go and Rust files follow line patterns exactly. Declarations of TypeScript and
the imports of scripts come from a file's tokens (functions/script.py), so what stands in strings, comments, templates or markup is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import paths
from loomline.functions.batches import slices
from loomline.functions.script import Script

#: Patterns of declarations.
PY = [(r"^async\s+def\s+(\w+)", "function", 6, True), (r"^def\s+(\w+)", "function", 5, False), (r"^class\s+(\w+)", "class", 7, False)]
JS = [(r"^class\s+(\w+)", "class"), (r"^function\s+(\w+)", "function"), (r"^(?:const|let|var)\s+(\w+)\s*=", "variable")]
GO = [r"^func\s+(?:\([^)]*\)\s*)?(\w+)", r"^type\s+(\w+)\s+(?:struct|interface)"]
RUST = [r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", r"^(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)"]
JAVA = [
    r"^(?:public\s+|private\s+|protected\s+|internal\s+|open\s+|abstract\s+)*(?:class|interface|enum|record|object)\s+(\w+)",
    r"^(?:public\s+|private\s+|protected\s+|internal\s+|static\s+|suspend\s+|final\s+)*[\w<>,?\[\].]+\s+(\w+)\s*\(",
]
CONTROL = r"^(?:return|throw|new|if|else|for|while|switch|when|catch)\b"
CALL_ROUTES = [
    ("express", [".ts", ".tsx", ".js", ".jsx"], r"""(?:app|router)\.(get|post|put|delete|patch|use)\s*\(\s*['"`]([^'"`]+)['"`]""", 2, 1),
    ("fastapi", [".py"], r"""@(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]""", 2, None),
    ("flask", [".py"], r"""@app\.route\s*\(\s*['"]([^'"]+)['"]""", 1, None),
    ("spring", [".java", ".kt"], r"""@(?:Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*)?['"]([^'"]+)['"]""", 1, None),
]
TYPESCRIPT, JAVASCRIPT, C_LIKE = [".ts", ".tsx", ".mts", ".cts"], [".js", ".jsx", ".mjs", ".cjs"], [".java", ".kt", ".go", ".rs"]
#: Flags of files that aren't parsed, and the largest that are.
UNPARSED, PARSE_LIMIT = ["generated", "binary", "secret", "lockfile"], 256_000
EXTENSIONS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".java", ".kt", ".go", ".rs"]


def lines(df: DataFrame) -> DataFrame:
    """A row per line, numbered from 1."""
    return df.select("path", F.posexplode(F.split("text", "\n")).alias("_n", "line")).withColumn("line_start", F.col("_n") + 1).drop("_n")


def first_match(c: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])


def python_symbols(df: DataFrame) -> DataFrame:
    found = lines(df.where(paths.extension(F.col("path")) == ".py"))
    line, kind, rank, is_async = F.col("line"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(False)
    for pattern, k, p, a in reversed(PY):
        hit = line.rlike(pattern)
        kind, rank, is_async = F.when(hit, k).otherwise(kind), F.when(hit, p).otherwise(rank), F.when(hit, a).otherwise(is_async)
    return found.select("path", first_match(line, [p for p, *_ in PY]).alias("name"), kind.alias("kind"), "line_start", is_async.alias("is_async"), rank.alias("priority")).where("name is not null")


def javascript_symbols(df: DataFrame) -> DataFrame:
    jsx = paths.extension(F.col("path")) == ".jsx"
    found = lines(df.where(paths.extension(F.col("path")).isin(".js", ".jsx", ".mjs", ".cjs")))
    line = F.col("line")
    exported = F.trim(line).rlike(r"^(?:module\.exports\s*=|exports\.\w+\s*=|export\s+default\s+)") | line.rlike(r"^\s*export\s+(?:default\s+)?")
    stripped = F.regexp_replace(line, r"^\s*(?:export\s+)?(?:default\s+)?", "")
    found = found.select("path", "line_start", exported.alias("exported"), line.rlike(r"^\s*(?:export\s+)?(?:async\s+function|async\s+\()").alias("is_async"), stripped.alias("_s"))
    raw = F.when(F.col("_s").rlike(JS[0][0]), "class").when(F.col("_s").rlike(JS[1][0]), "function").when(F.col("_s").rlike(JS[2][0]), "variable")
    found = found.withColumn("name", first_match(F.col("_s"), [p for p, _ in JS])).withColumn("_raw", raw).where("name is not null")
    component = jsx & F.col("name").rlike("^[A-Z]") & (F.col("_raw") != "class")
    out = F.col("exported")
    rank = F.when(F.col("_raw") == "class", F.when(out, 8).otherwise(5)).when(F.col("_raw") == "function", F.when(out, 7).otherwise(4)).otherwise(F.when(out & component, 8).when(out, 5).otherwise(2))
    return found.select("path", "name", F.when(component, "component").otherwise(F.col("_raw")).alias("kind"), "line_start", "exported", ((F.col("_raw") == "function") & F.col("is_async")).alias("is_async"), rank.alias("priority"))


def c_like_symbols(df: DataFrame) -> DataFrame:
    ext = paths.extension(F.col("path"))
    found = lines(df.where(ext.isin(".java", ".kt", ".go", ".rs"))).withColumn("_t", F.trim(F.regexp_replace("line", r"[\t\r]", " ")))
    t = F.col("_t")
    name = F.when(ext == ".go", first_match(t, GO)).when(ext == ".rs", first_match(t, RUST)).otherwise(first_match(t, JAVA))
    found = found.where(~t.rlike(CONTROL)).withColumn("name", name).where("name is not null")
    kind = F.when(t.contains("class "), "class").when(t.contains("interface ") | t.contains("trait "), "interface").when(t.contains("enum "), "enum").when(t.rlike(r"\b(?:type|struct|record|object)\b"), "type").otherwise("function")
    exported = F.when(ext == ".go", F.col("name").rlike("^[A-Z]")).when(ext == ".kt", ~t.rlike(r"^(?:private|protected|internal)\b")).otherwise(t.rlike(r"^(?:public|pub)\b"))
    return found.select("path", "name", kind.alias("kind"), "line_start", exported.alias("exported"), F.lit(5).alias("priority"))


def parsed_scripts(df: DataFrame, extensions: list[str]) -> DataFrame:
    """(path, symbols, imports, error) of script files: what their tokens tell, or why a file couldn't be read as a script."""
    told = "struct<symbols:array<struct<name:string,kind:string,line_start:int,exported:boolean,is_async:boolean,priority:int>>,imports:array<struct<source:string,kind:string>>,error:string>"

    symbol = pa.struct([("name", pa.string()), ("kind", pa.string()), ("line_start", pa.int32()), ("exported", pa.bool_()), ("is_async", pa.bool_()), ("priority", pa.int32())])
    made = pa.struct([("symbols", pa.list_(symbol)), ("imports", pa.list_(pa.struct([("source", pa.string()), ("kind", pa.string())]))), ("error", pa.string())])
    named = lambda kind, rows: None if rows is None else [dict(zip(kind.value_type.names, r)) for r in rows]

    @F.arrow_udf(told)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        lists = [made.field(i).type for i in (0, 1)]
        for texts, ends in batches:
            parts = []
            for some, kinds in zip(slices(texts), slices(ends)):
                rows = [parse(t or "", e) for t, e in zip(some, kinds)]
                parts.append(pa.array([{"symbols": named(lists[0], s), "imports": named(lists[1], i), "error": e} for s, i, e in rows], made))
            yield pa.concat_arrays(parts) if parts else pa.array([], made)

    ext = paths.extension(F.col("path"))
    return df.where(ext.isin(extensions)).select("path", run("text", ext).alias("_s")).select("path", "_s.*")


def parse(text: str, extension: str) -> tuple[list[tuple] | None, list[tuple] | None, str | None]:
    try:
        own = Script(text, extension in (".tsx", ".jsx", ".js"))
        return own.declarations(extension == ".tsx"), own.imports(), None
    except Exception as wrong:  # noqa: BLE001 - one odd file mustn't end the job; it is reported
        return None, None, f"{type(wrong).__name__}: {wrong}"


def typescript_symbols(df: DataFrame) -> DataFrame:
    """Top-level declarations of TypeScript files and the methods of their classes."""
    return parsed_scripts(df, TYPESCRIPT).select("path", F.explode("symbols").alias("s")).select("path", "s.*")


def failures(df: DataFrame) -> DataFrame:
    """(path, error) of script files that couldn't be read as scripts: they have neither symbols nor imports."""
    return parsed_scripts(df, [*TYPESCRIPT, *JAVASCRIPT]).where("error is not null").select("path", "error")


def eligible(scan: DataFrame, important: DataFrame, most: int = PARSE_LIMIT) -> DataFrame:
    """Files of a scan that are parsed: important ones that aren't excluded, flagged, of another language or over most bytes."""
    kept = scan.where(F.col("excluded_reason").isNull() & ~F.arrays_overlap("risk_flags", F.array(*map(F.lit, UNPARSED))) & paths.extension(F.col("path")).isin([*TYPESCRIPT, *JAVASCRIPT, ".py", *C_LIKE]) & (F.col("bytes") <= most))
    return kept.join(important.select("path").distinct(), "path", "left_semi")


def all_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files of all languages, each by its own way; null where a language can't tell."""
    missing = {"exported": "boolean", "is_async": "boolean"}
    each = [f(files) for f in (typescript_symbols, javascript_symbols, python_symbols, c_like_symbols)]
    each = [x.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in x.columns}).select("path", "name", "kind", "line_start", "exported", "is_async", "priority") for x in each]
    return each[0].unionAll(each[1]).unionAll(each[2]).unionAll(each[3])


def all_imports(files: DataFrame) -> DataFrame:
    """(path, source, kind) of script and Python files; the others have none."""
    return script_imports(files).unionByName(python_imports(files).withColumn("kind", F.lit("import")))


def python_imports(df: DataFrame) -> DataFrame:
    """(path, source): modules of import lines, then those of from lines."""
    own = df.where(paths.extension(F.col("path")) == ".py")
    plain = own.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^import[ \t]+([^#\r\n]*?)[ \t]*(?:#.*)?$"), F.lit(1))).alias("some"))
    plain = plain.select("path", F.explode(F.split("some", ",")).alias("one")).select("path", F.get(F.split(F.trim("one"), r"\s+as\s+"), 0).alias("source")).where("source <> ''")
    return plain.unionAll(own.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^from\s+(\S+)\s+import"), F.lit(1))).alias("source")))


def script_imports(df: DataFrame) -> DataFrame:
    """(path, source, kind) of JavaScript and TypeScript files: imports, re-exports, dynamic imports and require calls."""
    return parsed_scripts(df, [*TYPESCRIPT, *JAVASCRIPT]).select("path", F.explode("imports").alias("i")).select("path", "i.source", "i.kind")


def joined(folder: Column, relative: Column) -> Column:
    """A posix join, with . and .. resolved; what climbs above the root keeps its dots."""
    parts = F.split(F.concat_ws("/", folder, relative), "/")

    def walk(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), walk), "/")


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with resolved, the first candidate path that files have; null for what isn't relative or isn't there.

    Candidates become rows and meet the files by equality; the lowest place wins.
    """
    source, folder = F.col("source"), paths.dirname(paths.normal(F.col("path")))
    dots = F.length(F.regexp_extract(source, r"^(\.+)", 1))
    parts = F.filter(F.split(folder, "/"), lambda p: ~p.isin("", "."))
    above = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")  # the root is above itself
    python = joined(above, F.translate(F.regexp_replace(source, r"^\.+", ""), ".", "/"))
    python = F.when(python == "", ".").otherwise(python)
    script = joined(folder, source)
    probe = F.when(F.col("path").endswith(".py"), F.array(F.concat(python, F.lit(".py")), F.concat(python, F.lit("/__init__.py"))))
    probe = probe.otherwise(F.array(*[F.concat(script, F.lit(x)) for e in EXTENSIONS for x in (e, f"/index{e}")]))
    tried = imports.where(source.startswith(".")).select("path", "source").distinct().select("path", "source", F.posexplode(probe).alias("_at", "candidate"))
    known = files.select(paths.normal(F.col("path")).alias("candidate")).distinct()
    found = tried.join(known, "candidate").groupBy("path", "source").agg(F.min_by("candidate", "_at").alias("resolved"))
    return imports.join(found, ["path", "source"], "left")


def popularity(imports: DataFrame, n: int = 15) -> DataFrame:
    return imports.groupBy("source").agg(F.count(F.lit(1)).alias("imports")).orderBy(F.desc("imports"), "source").limit(n)


def call_routes(df: DataFrame) -> DataFrame:
    """(path, route, framework, reason) of Express, FastAPI, Flask and Spring declarations."""
    ext = paths.extension(F.col("path"))
    out = None
    for framework, kinds, pattern, at, verb in CALL_ROUTES:
        all_of = lambda n, p=pattern: F.regexp_extract_all(F.col("text"), F.lit(p), F.lit(n))
        both = F.arrays_zip(all_of(at).alias("route"), (all_of(verb) if verb else all_of(at)).alias("verb"))
        rows = df.where(ext.isin(kinds)).select("path", F.explode(both).alias("r")).select("path", F.col("r.route").alias("route"), F.col("r.verb").alias("verb"))
        why = F.concat(F.upper("verb"), F.lit(" "), F.col("route")) if verb else F.concat(F.lit(f"{framework} route: "), F.col("route"))
        rows = rows.select("path", "route", F.lit(framework).alias("framework"), why.alias("reason"))
        out = rows if out is None else out.unionAll(rows)
    return out


def dynamic(route: Column) -> Column:
    route = F.regexp_replace(route, r"\[\[\.\.\.(\w+)\]\]", ":$1*?")
    return F.regexp_replace(F.regexp_replace(route, r"\[\.\.\.(\w+)\]", ":$1*"), r"\[(\w+)\]", ":$1")


def file_routes(df: DataFrame, manifests: DataFrame) -> DataFrame:
    """Routes that the place of a file in an app or pages folder makes, below a root that manifests name.

    Every folder named so is a candidate; the first whose root is a project's wins.
    """
    parts = F.split(paths.normal(F.col("path")), "/")
    at = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(parts, i).isin("app", "pages"))
    each = df.select("path", parts.alias("_p"), F.explode(at).alias("_i"))
    below_src = (F.col("_i") > 0) & (F.get("_p", F.col("_i") - 1) == "src")
    roots = each.select("path", "_p", "_i", F.explode(F.when(below_src, F.array(F.col("_i") - 1, F.col("_i"))).otherwise(F.array(F.col("_i")))).alias("_r"))
    roots = roots.withColumn("root", F.array_join(F.slice("_p", F.lit(1), F.col("_r")), "/"))
    first = roots.join(manifests.select("root").distinct(), "root").groupBy("path").agg(F.min_by(F.struct("_p", "_i"), F.struct("_r", "_i")).alias("x")).select("path", "x.*")
    routed = first.select("path", F.get("_p", F.col("_i")).alias("router"), F.array_join(F.slice("_p", F.col("_i") + 2, F.size("_p")), "/").alias("_below"))
    app = routed.where("router = 'app'").where(F.col("_below").rlike(r"^(?:(.*)/)?(page|layout|route)\.(?:js|jsx|ts|tsx)$"))
    segments = F.filter(F.split(F.regexp_extract("_below", r"^(?:(.*)/)?(page|layout|route)\.", 1), "/"), lambda s: s != "")
    app = app.where(~F.exists(segments, lambda s: s.startswith("_"))).select("path", F.concat(F.lit("/"), dynamic(F.array_join(F.filter(segments, lambda s: ~s.rlike(r"^\(.+\)$")), "/"))).alias("route"), "router")
    leafed = F.filter(F.split(F.regexp_extract("_below", r"^(.*)(?:\.js|\.jsx|\.ts|\.tsx)$", 1), "/"), lambda s: s != "")
    leaf = F.coalesce(F.get(leafed, F.size(leafed) - 1), F.lit(""))
    pages = routed.where("router = 'pages'").where(F.col("_below").rlike(r"\.(js|jsx|ts|tsx)$")).where(~leaf.isin("_app", "_document", "_error"))
    short = F.when(leaf == "index", F.slice(leafed, F.lit(1), F.greatest(F.size(leafed) - 1, F.lit(0)))).otherwise(leafed)
    return app.unionAll(pages.select("path", F.concat(F.lit("/"), dynamic(F.array_join(short, "/"))).alias("route"), "router"))


def rank_symbols(symbols: DataFrame, goal: str = "build-mvp", limit: int = 100) -> DataFrame:
    test_first = [F.desc(F.col("path").contains("test"))] if goal in ("debug", "test-generation") else []
    return symbols.orderBy(F.desc(F.coalesce("exported", F.lit(False))), F.desc("priority"), *test_first, F.collate("name", "UNICODE"), "path", "line_start").limit(limit)


def symbol_summary(symbols: DataFrame) -> DataFrame:
    """Counts of symbols, files, and kinds; components count as functions."""
    kinds = {"functions": ["function", "component"], "classes": ["class"], "types": ["interface", "type"], "variables": ["variable"]}
    return symbols.agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("path").alias("files"), F.count_if(F.coalesce("exported", F.lit(False))).alias("exported"), *[F.count_if(F.col("kind").isin(k)).alias(n) for n, k in kinds.items()])
