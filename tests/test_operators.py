"""Operators on small inputs with known answers."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from loomline.functions import display, files, numbers, paths, tokens
from loomline.functions.script import Script
from loomline.operators import compaction, drift, git, models, symbols, workspace
from loomline.sources import catalog
from loomline.sources import files as folders



def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_to_fixed(spark):
    values = [1.005, 0.285, 1.45, 2.5, -2.5, 0.125, 1e-7, 123456.785, 0.0, 8.345]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for n in (1, 2, 4):
        want = [float(Decimal(v).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP)) for v in values]
        assert [r.y for r in df.select(numbers.to_fixed(F.col("x"), n).alias("y")).collect()] == want


@pytest.mark.parametrize(("text", "want"), [("", 0), ("   ", 1), (None, 0), ("a b c d e f g h i j", 13), ("x" * 400, 100), ("a　b﻿c", 4), ("😀😀", 2)])
def test_estimate(spark, text, want):
    assert one(spark, tokens.estimate(F.lit(text).cast("string"))) == want == tokens.estimate_text(text or "")


def test_provider_falls_back(spark):
    def provider(text):
        if text == "bad":
            raise ValueError
        return {"neg": -1, "half": 1.5}.get(text, 42)

    df = spark.createDataFrame([("bad",), ("neg",), ("half",), ("fine",)], "t string")
    got = [r.x for r in df.select(tokens.with_provider(F.col("t"), provider).alias("x")).collect()]
    assert got == [max(1, 2), max(1, 2), max(1, 2), 42]


@pytest.mark.parametrize(("path", "parts"), [("a/b.ts", ("b.ts", "a", ".ts")), (".env", (".env", ".", "")), ("x/.git/c.TAR.GZ", ("c.TAR.GZ", "x/.git", ".gz")), ("Makefile", ("Makefile", ".", ""))])
def test_paths(spark, path, parts):
    p = F.lit(path)
    assert tuple(one(spark, f(p)) for f in (paths.basename, paths.dirname, paths.extension)) == parts


def test_ancestors_and_suffixes(spark):
    assert one(spark, paths.ancestors(F.lit("a/b/c.py"))) == [".", "a", "a/b"]
    assert one(spark, paths.ancestors(F.lit("c.py"))) == ["."]
    assert one(spark, paths.suffixes(F.lit("a/b/c"))) == ["a/b/c", "b/c", "c"]


def test_classify(spark):
    rows = [(0, ".env", "A=1"), (1, "src/a.min.js", "x"), (2, "img.png", "x"), (3, "dump/x-backup.sql", "s"), (4, "a.log", "l"), (5, "dist/a.ts", "t"), (6, "a.ts", "api_key = '0123456789abcdef0'"), (7, "b.ts", ""), (8, "yarn.lock", "z z"), (9, "big.txt", "y" * 600_000)]
    got = {r.path: (r.risk_flags, r.included, r.excluded_reason, r.estimated_tokens) for r in workspace.classify(spark.createDataFrame(rows, "ord long, path string, text string")).collect()}
    assert got[".env"] == (["secret"], False, "potential secret file", 2)
    assert got["src/a.min.js"][:3] == (["generated"], False, "generated")
    assert got["img.png"] == (["binary"], False, "binary file", 0)
    assert got["dump/x-backup.sql"][2] == "database dump" and got["a.log"][2] == "log file" and got["dist/a.ts"][2] == "build output"
    assert got["a.ts"][:3] == (["secret"], False, "potential secret file")
    assert got["b.ts"] == ([], True, None, 0) and got["yarn.lock"][0] == ["lockfile"] and got["big.txt"][2] == "large file"


def test_recursive_folders(spark):
    rows = [(0, "src/a.ts", "a" * 4000), (1, "src/x/b.ts", "b" * 1000), (2, "c.ts", "c" * 1000)]
    scan = workspace.classify(spark.createDataFrame(rows, "ord long, path string, text string"))
    assert {r.folder: r.tokens for r in workspace.recursive_folders(scan).collect()} == {".": 1500, "src": 1250, "src/x": 250}


def test_drift_keeps_repeated_flags(spark):
    scan = lambda rows: spark.createDataFrame(rows, "ord long, path string, estimated_tokens long, risk_flags array<string>")
    a = scan([(0, "a", 10, []), (1, "b", 5, ["x"]), (2, "a", 20, []), (3, "gone", 1, [])])
    b = scan([(0, "a", 20, ["y", "y"]), (1, "b", 10, ["x"]), (2, "w\\new", 7, [])])
    got = {r.path: (r.status, r.delta, r.percent, r.added_flags) for r in drift.file_drift(a, b).collect()}
    assert got == {"a": ("modified", 0, 0.0, ["y", "y"]), "b": ("modified", 5, 100.0, []), "gone": ("removed", -1, -100.0, []), "w/new": ("added", 7, 100.0, [])}


def test_git(spark):
    lines = ["M  a.ts", " M b.ts", "?? c/d.ts", 'R  "old name" -> "new name"', " D e.ts", "UU f", "x", "   "]
    got = {r.path: r for r in git.parse(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert got["a.ts"].staged and got["b.ts"].unstaged and got["c/d.ts"].untracked and got["new name"].original_path == "old name" and got["e.ts"].deleted and got["f"].conflicted
    assert len(got) == 6
    scan = spark.createDataFrame([("src/C/D.ts",), ("d.ts",), ("xd.ts",), ("",)], "path string")
    dirty = spark.createDataFrame([("c/d.ts",), ("",)], "path string")
    assert {r.path for r in git.touched(scan, dirty).collect()} == {"src/C/D.ts", "d.ts"}


def catalogue(spark, rows):
    base = {"display_name": "d", "provider": "p", "context_window": 100_000, "max_output_tokens": 1000, "input_price": 3.0, "output_price": 15.0, "cached_price": 0.3, "supports_tools": True, "supports_images": False, "supports_local": False, "privacy_mode": "cloud", "coding_score": 80.0, "reasoning_score": None, "latency_score": None, "updated_at": "2026-01-01"}
    return spark.createDataFrame([base | r | {"ord": i} for i, r in enumerate(rows)], catalog.MODEL)


def test_advice_golden(spark):
    plans = models.advice(catalogue(spark, [{"id": "base", "input_price": 30.0}, {"id": "new"}]), "base", developers=4, days=20, runs=10, input_tokens=50_000, output_tokens=2_000, cache=0.5)
    assert plans.first().monthly_spend == 90.0


def test_recommend_is_exclusive_until_none_is_left(spark):
    two = models.recommend(models.score(catalogue(spark, [{"id": "b"}, {"id": "a"}]), 1000, "debug")).collect()
    assert [r.id for r in sorted(two, key=lambda r: r.tier)] == ["b", "a", "a"] or len({r.id for r in two}) == 2
    small = models.score(catalogue(spark, [{"id": "b", "context_window": 10}]), 1000, "debug")
    assert {r.id for r in models.recommend(small).collect()} == {"b"} and models.rejected(small).count() == 1


def test_validation(spark):
    rows = [{"id": "a"}, {"id": "a", "updated_at": "2026-02-30"}, {"id": " "}, {"id": "c", "max_output_tokens": 200_000, "coding_score": 101.0, "privacy_mode": "x"}]
    got = [(r.ord, r.message) for r in models.errors(catalogue(spark, rows)).orderBy("ord", "n").collect()]
    assert got == [(1, "duplicate id"), (1, "invalid updated_at"), (2, "missing id"), (3, "invalid privacy_mode"), (3, "invalid coding_score"), (3, "max_output_tokens exceeds context_window")]


@pytest.mark.parametrize(("folder", "relative", "want"), [("a/b", "../c", "a/c"), (".", "./x", "x"), ("a", "../../x", "../x"), ("a/b", ".", "a/b")])
def test_joined(spark, folder, relative, want):
    assert one(spark, symbols.joined(F.lit(folder), F.lit(relative))) == want


def test_python_import_resolution(spark):
    known = spark.createDataFrame([("a/b/c.py",), ("a/d/__init__.py",), ("a/e.py",)], "path string")
    imports = spark.createDataFrame([("a/b/x.py", ".c"), ("a/b/x.py", "..d"), ("a/b/x.py", "..e"), ("a/b/x.py", "os"), ("a/b/x.py", "....z")], "path string, source string")
    assert {r.source: r.resolved for r in symbols.resolve(imports, known).collect()} == {".c": "a/b/c.py", "..d": "a/d/__init__.py", "..e": "a/e.py", "os": None, "....z": None}


def test_markdown(spark):
    assert one(spark, compaction.escape_markdown(F.lit("a*b\n_c|\\"))) == "a\\*b \\_c\\|\\\\"
    assert one(spark, compaction.markdown_code(F.lit("x`y``z|"))) == "``` x`y``z&#124; ```"


def test_collapse():
    assert compaction.collapse("class A {\n  go(x) {\n    if (x) { y }\n  }\n}\nconst k = 1") == "class A {\n  go(x) { /* collapsed */ }\n}\nconst k = 1"


def test_folder_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("let a = 1")
    (tmp_path / "x.log").write_text("log")
    (tmp_path / "out2").mkdir()
    (tmp_path / "out2/z.ts").write_text("z")
    (tmp_path / ".gitignore").write_text("*.log\nout2/\n")
    df, warnings = folders.read_folder(spark, str(tmp_path))
    got = {r.path: (r.included, r.excluded_reason) for r in workspace.classify(df, F.col("_ignored")).collect()}
    assert got == {".gitignore": (True, None), "src/a.ts": (True, None), "x.log": (False, "matches ignore pattern")} and warnings.isEmpty()


def test_folder_of_a_small_project(spark, tmp_path):
    """Tokens by hand: the larger of a quarter of the characters and 1.3 a word, rounded up, then by the extension."""
    own = {"README.md": ("# Title\n\nfour more words here\n", 9), "src/index.ts": ("export const a = 1;\n" * 4, 26), "src/data.json": ("[" + "1," * 99 + "1]", 46), "empty.py": ("", 0), "a.lock": ("x y z", 6)}
    for path, (text, _) in own.items():
        place = tmp_path / path
        place.parent.mkdir(exist_ok=True)
        place.write_text(text)
    scan = workspace.classify(folders.read_folder(spark, str(tmp_path))[0], F.col("_ignored"))
    assert {r.path: r.estimated_tokens for r in scan.collect()} == {p: n for p, (_, n) in own.items()}
    total = workspace.stats(scan).first()
    assert (total.total_files, total.included_files, total.total_bytes, total.total_tokens) == (5, 5, sum(len(t) for t, _ in own.values()), sum(n for _, n in own.values()))


def plain_collapse(text):
    """A plain version, over one line after the other, of what opens a body and where it ends."""
    import re

    out, depth, open_head = [], 0, False
    opens = lambda x: x.count("{") - x.count("}")
    for line in text.split("\n"):
        t = line.strip()
        first = re.match(r"(?:}\s*)?(?:else\s+)?([A-Za-z_$][\w$]*)", t)
        call = re.search(r"\b[A-Za-z0-9_$]+\s*\([^)]*\)\s*(?::\s*[^;{]+)?\s*\{?$", t) and (first is None or first[1] not in ("if", "for", "while", "switch", "catch", "with"))
        named = any(t.startswith(x) for x in ("function ", "export function ", "async function ", "export async function ", "constructor"))
        arrow = re.match(r"(const|let|var)\s+[A-Za-z0-9_$]+\s*=\s*(async\s*)?\([^)]*\)\s*(=>)?\s*\{?$", t)
        if depth > 0:
            depth = max(0, depth + opens(line))
        elif not re.match(r"(export\s+)?(abstract\s+)?class\s+", t) and (named or call or arrow):
            if "{" in line:
                out.append(line[: line.index("{") + 1] + " /* collapsed */ }")
                depth = max(0, opens(line))
            else:
                out.append(line)
                open_head = True
        elif open_head:
            if "{" in line:
                out.append("  /* collapsed */\n}")
                depth, open_head = 1, False
        else:
            out.append(line)
    return "\n".join(out)


def test_collapse_by_a_plain_version(spark):
    import random

    rng = random.Random(5)
    lines = ["class A {", "export abstract class B {", "  go(x) {", "  async go(a, b): Promise<T> {", "}", "  }", "return foo(x)", "await f(x) {", "const z = new X(y)", "if (a) {", "} else if (b) {", "for (const x of y) {", "export async function f(x) {", "function g()", "{", "constructor(a) {",
             "const k = (a) => {", "let m = async (b) =>", "x = { a: 1 }", "switch (x) {", "call(x);", "with (y) {", "", "  value: 1,"]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(1, 14))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", compaction.collapse_bodies("t").alias("c")).collect()
    assert all(r.c == plain_collapse(r.t) for r in got)
    code = spark.createDataFrame([("a.ts", t) for t in texts[:50]], "path string, text string")
    for fixed in range(4):
        told = compaction.progressive(code, None, F.lit(False), fixed=fixed).collect()
        assert {r.stage for r in told} == {fixed}
    for r in compaction.progressive(code, 20, F.lit(False)).collect():
        assert r.tokens <= 20 or r.stage == 3
    with pytest.raises(ValueError):
        compaction.progressive(code, 20, F.lit(False), fixed=1)


def test_escapes(spark):
    cases = {"a/b": False, "../a": True, "a/../../b": True, "a/../b": False, "/etc": True, "C:/x": True, "..": True, "./a": False, "a/..": False}
    assert {p: one(spark, workspace.escapes(F.lit(p))) for p in cases} == cases


def test_typescript_methods():
    src = "export class S {\n  private x = 1;\n  constructor(a) {}\n  async get(id) { if (a) { b(c); } }\n  get size() { return 1; }\n  handler = () => {};\n}\nconst a = 1, b = { c: 2, d: [1, 2] };\n/* class N {} */ let s = 'class M {}';\n"
    assert [(x[0], x[1], x[2]) for x in Script(src, False).declarations(False)] == [("S", "class", 1), ("S.get", "method", 4), ("a", "variable", 8), ("b", "variable", 8), ("s", "variable", 9)]


def test_cache_round_trip(spark, tmp_path):
    scan = workspace.classify(spark.createDataFrame([(0, "a.ts", "x y")], "ord long, path string, text string")).withColumn("mtime", F.lit("2026-01-01").cast("timestamp"))
    assert catalog.load_cache(spark, str(tmp_path)).count() == 0
    catalog.save_cache(scan, str(tmp_path))
    assert workspace.with_cache(scan, catalog.load_cache(spark, str(tmp_path))).first().cache_hit
    assert catalog.load_cache(spark, str(tmp_path), "provider:x").count() == 0


def test_languages_of_both_maps(spark):
    assert one(spark, files.language(F.lit("x/app.Dockerfile"))) == "Dockerfile" and one(spark, files.language(F.lit("a.H"))) == "C/C++ Header"


def test_text_for_panels(spark):
    told = {0: "0", 7: "7", 999: "999", 1000: "1K", 1049: "1K", 1050: "1.1K", 1250: "1.3K", 123_456: "123.5K", 999_949: "999.9K", 999_950: "1M", 1_500_000: "1.5M", 999_950_000: "1B", 2_000_000_000_000: "2T", 12_345_600_000_000_000: "12,345.6T", -1_260: "-1.3K", None: None}
    rows = spark.createDataFrame([(x,) for x in told], "x long").select("x", display.compact(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == told
    ages = {0: "just now", -5: "just now", 59: "just now", 60: "1m ago", 3599: "59m ago", 3600: "1h ago", 86_399: "23h ago", 86_400: "1d ago", None: "just now"}
    rows = spark.createDataFrame([(x,) for x in ages], "x long").select("x", display.age(F.timestamp_seconds(1_000_000 - F.col("x")), F.timestamp_seconds(F.lit(1_000_000))).alias("y")).collect()
    assert {r.x: r.y for r in rows} == ages
    text = spark.createDataFrame([("<a href=\"x\">'&amp;'</a>",), (None,)], "t string")
    assert [tuple(r) for r in text.select(display.escape_html(F.col("t")), display.escape_html(F.col("t"), apostrophes=True)).collect()] == [("&lt;a href=&quot;x&quot;&gt;'&amp;amp;'&lt;/a&gt;", "&lt;a href=&quot;x&quot;&gt;&#39;&amp;amp;&#39;&lt;/a&gt;"), (None, None)]
