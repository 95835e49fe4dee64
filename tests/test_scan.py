"""Scans of folders: any bytes, ignore rules by an index, walks in rounds, caches that save reading, tokenizers."""

from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from loomline.operators import workspace
from loomline.sources import files, rules, walk
from loomline.sources.bodies import Tokenizer, read_bodies

LINES = ["*.log", "!keep.log", "build/", "/top.txt", "a/**/z", "docs/*.md", "# note", "\\#x", "b[0-9].c", "c[!x].d", "", "  ", "s?p", "trail\\ "]
PATHS = "path string"


def write(root, tree):
    for path, body in tree.items():
        place = root / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(body if isinstance(body, bytes) else body.encode())


def test_rules():
    own = rules.Rules([("", LINES), ("pkg", ["own", "/here", "q[]"])])
    yes = ["x.log", "d/X.LOG", "build/keep.log", "top.txt", "a/z", "a/b/c/z", "docs/r.md", "#x", "b1.c", "cy.d", "pkg/own", "pkg/q/own", "pkg/here", "sip", "trail "]
    no = ["keep.log", "d/top.txt", "docs/q/r.md", "own", "pkg/q/here", "bx.c", "buildx/a", "cx.d", "build", "s/p"]
    assert [p for p in yes if not own.ignored(p)] == [] and [p for p in no if own.ignored(p)] == []


def test_rules_as_an_index(spark):
    rng = random.Random(4)
    parts = ["a", "b", "docs", "build", "x.log", "keep.log", "r.md", "Z", "[q]", "b1.c"]
    paths = sorted({"/".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(400)})
    df = spark.createDataFrame([(p,) for p in paths] + [(None,)], PATHS)
    choices = [*LINES, "z", "/b", "!b", "!r.md", "*", "!*.md", "\\[q]", "docs/", "**/b/**", "b/"]
    for trial in range(3):
        top, last = rng.sample(choices, 4 + trial), rng.sample(choices, trial)
        nested = [(f, rng.sample(choices, 3)) for f in ("a", "a/b", "docs", "b/docs/a", "[q]")]
        plain = rules.Rules([("", top), *sorted(nested, key=lambda n: n[0].count("/"))], last)
        got = rules.with_ignored(df, top, spark.createDataFrame(nested, "folder string, lines array<string>"), last)
        assert {r.path: r.ignored for r in got.collect()} == {p: plain.ignored(p) for p in paths} | {None: False}
        assert "Python" not in got._jdf.queryExecution().toString()
    flat = rules.with_ignored(df, LINES)
    assert {r.path: r.ignored for r in flat.collect()} == {p: rules.Rules([("", LINES)]).ignored(p) for p in paths} | {None: False}
    none = rules.with_ignored(df, [], spark.createDataFrame([], "folder string, lines array<string>"))
    assert none.where("ignored").count() == 0


def test_scan_of_any_bytes(spark, tmp_path):
    root = tmp_path / "p"
    latin = "é caf".encode("latin-1")
    write(root, {"a.png": b"\x89PNG\x00\xff", "l.txt": latin, "big.txt": b"x" * 12_000_000, "six.txt": b"y " * 3_000_000, "ok.ts": "let a = 1", "bad.py": b"\xff\xfe\xf0\x9f" * 50, "e.md": b"", "n.txt": b"a\x00b"})
    scan = files.scan_folder(spark, str(root))
    got = {r.path: r for r in scan.files.collect()}
    assert got["l.txt"].text == latin.decode("utf-8", "replace") and got["l.txt"].bytes == 5 and got["bad.py"].text == (b"\xff\xfe\xf0\x9f" * 50).decode("utf-8", "replace") and got["n.txt"].text == "a\x00b"
    assert got["a.png"].text is None and got["a.png"].excluded_reason == "binary file" and got["a.png"].estimated_tokens == 0
    assert got["big.txt"].risk_flags == ["large-file"] and got["big.txt"].excluded_reason == "exceeds max file size (12.0MB)" and got["big.txt"].text is None and got["big.txt"].bytes == 12_000_000
    assert got["six.txt"].text is None and (got["six.txt"].estimated_tokens, got["six.txt"].risk_flags) == (1_500_000, ["large-file"])
    assert got["e.md"].estimated_tokens == 0 and got["ok.ts"].included and scan.warnings == []
    assert [r.path for r in sorted(got.values(), key=lambda r: r.ord)] == ["a.png", "bad.py", "big.txt", "e.md", "l.txt", "n.txt", "ok.ts", "six.txt"]
    (tmp_path / "none").mkdir()
    assert files.scan_folder(spark, str(tmp_path / "none")).warnings == ["No files found in workspace"]


def test_files_that_can_not_be_read(spark, tmp_path, monkeypatch):
    write(tmp_path, {"a.ts": "let a = 1", "b.ts": "x" * 100, "c.ts": "y"})
    listed = files.list_folder

    def gone(*a, **b):
        found = listed(*a, **b)
        (tmp_path / "b.ts").unlink()
        return found

    monkeypatch.setattr(files, "list_folder", gone)
    scan = files.scan_folder(spark, str(tmp_path))
    got = {r.path: r for r in scan.files.collect()}
    assert got["b.ts"].estimated_tokens == 25 and got["b.ts"].included and got["b.ts"].text is None and got["b.ts"].error
    assert scan.warnings == ["unreadable file: b.ts: No such file or directory"] and [r.note for r in scan.every.collect()] == scan.warnings


def plain_walk(root, excluded):
    """One folder after the other, depth first."""
    real, found, seen = os.path.realpath(root), {}, set()

    def enter(folder, path, scopes):
        place = os.path.realpath(folder)
        if not (place == real or place.startswith(real + "/")) or place in seen:
            return
        seen.add(place)
        own = os.path.join(folder, ".gitignore")
        scopes = [*scopes, (path, open(own, errors="replace").read().split("\n"))] if os.path.isfile(own) else scopes
        now = rules.Rules(scopes, excluded)
        for name in sorted(os.listdir(folder)):
            at, child = f"{path}/{name}" if path else name, os.path.join(folder, name)
            target = os.path.realpath(child)
            if name == ".git" or os.path.islink(child) and not target.startswith(real):
                continue
            if os.path.isdir(child):
                if not now.decides(at, True):
                    enter(child, at, scopes)
            elif os.path.isfile(child) and not (os.path.islink(child) and now.decides(at, False)):
                found[at] = now.decides(at, False)

    enter(root, "", [])
    return found


def test_walk_in_rounds(spark, tmp_path):
    root = tmp_path / "p"
    rng = random.Random(2)
    names = ["a", "b", "cc", "docs", "build", "x.log", "keep.log", "r.md", "é"]
    tree = {f"{'/'.join(rng.choices(names[:5], k=rng.randint(0, 4)))}/{rng.choice(names[5:])}".lstrip("/"): "x" for _ in range(120)}
    write(root, tree | {".gitignore": "*.log\n/b/build/\n", "a/.gitignore": "!keep.log\nbuild/\n", "a/b/.gitignore": "r.md", ".git/config": "x", "cc/f": "x"})
    os.symlink("/etc", root / "out")
    os.symlink("nowhere", root / "gone")
    os.symlink(root / "cc" / "f", root / "zz")
    expected = plain_walk(root, ["cc/docs"])
    for share in (1, 7, 20_000):
        found, notes = walk.walk(spark, str(root), exclude=["cc/docs"], share=share)
        assert {r.path: r.ignored for r in found.collect()} == expected
        assert sorted(r.note for r in notes.collect()) == ["broken link: gone", "link out of the root: out"]


@pytest.mark.parametrize("share", [1, 20_000])
def test_walk_of_circles(spark, tmp_path, share):
    root = tmp_path / "p"
    write(root, {"a/b/x": "1", "a/y": "1", "c/z": "1"})
    os.symlink(root, root / "a" / "b" / "top")
    os.symlink(root / "a", root / "c" / "again")
    os.symlink(root / "c", root / "a" / "b" / "under")
    found, notes = walk.walk(spark, str(root), share=share)
    reached = {os.path.realpath(root / r.path) for r in found.collect()}
    assert found.count() == 3 and reached == {str(root.resolve() / p) for p in ("a/b/x", "a/y", "c/z")}
    assert {r.note.split(":")[0] for r in notes.collect()} == {"folder met before"}


def test_ignore_files(spark, tmp_path):
    root = tmp_path / "p"
    write(root, {"more.ignore": "y.txt\n", "x.txt": "1", "y.txt": "1"})
    write(tmp_path, {"outer": "*"})
    os.symlink(tmp_path / "outer", root / "linked")
    scan = files.scan_folder(spark, str(root), ignore_files=["more.ignore", "../outer", "/etc/passwd", "linked", "missing"])
    assert {r.path for r in scan.files.where("excluded_reason = 'matches ignore pattern'").collect()} == {"y.txt"}
    assert [w for w in scan.warnings if "ignore file" in w] == [f"ignore file outside the root: {n}" for n in ("../outer", "/etc/passwd", "linked")]


def test_cache_saves_reading(spark, tmp_path):
    root = tmp_path / "p"
    write(root, {"a.ts": "let a = 1", "b.ts": "password = 'hunter2secret'", "c.ts": "x y z", "i.png": b"\x89", ".gitignore": "z.ts\n", "z.ts": "1"})
    first = files.scan_folder(spark, str(root), cache=".cache")
    read = lambda scan: {r.path for r in scan.files.where("text is not null").collect()}
    assert read(first) == {"a.ts", "b.ts", "c.ts", ".gitignore"} and first.files.where("cache_hit").count() == 0
    (root / "c.ts").write_text("x y z and more")
    (root / "d.ts").write_text("new")
    before = {r.path: (r.estimated_tokens, r.risk_flags, r.excluded_reason) for r in first.files.collect()}
    second = files.scan_folder(spark, str(root), cache=".cache")
    assert read(second) == {"c.ts", "d.ts"}
    hits = {r.path: r for r in second.files.where("cache_hit").collect()}
    assert set(hits) == {"a.ts", "b.ts", ".gitignore"} and all((r.estimated_tokens, r.risk_flags, r.excluded_reason) == before[p] for p, r in hits.items())
    assert hits["b.ts"].excluded_reason == "potential secret file"
    os.utime(root / "a.ts", (time.time() + 5, time.time() + 5))
    assert read(files.scan_folder(spark, str(root), cache=".cache")) == {"a.ts"}


def test_tokenizer_in_a_scan(spark, tmp_path):
    root = tmp_path / "p"
    write(root, {"a.ts": "one two three", "b.ts": "fail here", "c.json": "x", "i.png": b"\x89"})

    def make():
        def count(text):
            if "fail" in text:
                raise ValueError(text)
            return -1 if text == "x" else 100 + len(text.split())

        return count

    own = Tokenizer("P", "words", make, version="2", model="m/1")
    scan = files.scan_folder(spark, str(root), cache=".cache", tokenizer=own)
    plain = {r.path: r.estimated_tokens for r in files.scan_folder(spark, str(root), cache=".cache").files.collect()}
    got = {r.path: r.estimated_tokens for r in scan.files.collect()}
    assert got == plain | {"a.ts": 103} and got["b.ts"] == plain["b.ts"] > 0
    assert scan.warnings == ["tokenizer failed, estimate taken: 2 files"]
    assert files.scan_folder(spark, str(root), cache=".cache", tokenizer=own).files.where("cache_hit").count() == 3
    newer = Tokenizer("P", "words", make, version="3", model="m/1")
    assert files.scan_folder(spark, str(root), cache=".cache", tokenizer=newer).files.where("cache_hit").count() == 0
    assert own.key != newer.key != Tokenizer("P", "words", make).key


def test_bodies_are_planned_by_size(spark, tmp_path, monkeypatch):
    from loomline.sources import bodies

    monkeypatch.setattr(bodies, "SHARE", 1000)
    write(tmp_path, {f"{i}.txt": "x" * 500 for i in range(20)})
    wanted = spark.createDataFrame([(f"{i}.txt", str(tmp_path / f"{i}.txt"), 500) for i in range(21)], "path string, full string, bytes long")
    got = read_bodies(spark, wanted)
    assert got.rdd.getNumPartitions() > 4
    rows = {r.path: r for r in got.collect()}
    assert len(rows) == 21 and rows["20.txt"].error and rows["3.txt"].text == "x" * 500


def test_known_facts_of_a_table(spark):
    scan = workspace.classify(spark.createDataFrame([(0, "a.ts", None, 80, 7, ["secret"]), (1, "b.ts", None, 80, None, None), (2, "c.ts", "", 0, 9, None)], "ord long, path string, text string, bytes long, _tokens long, _flags array<string>"))
    assert [(r.estimated_tokens, r.risk_flags, r.included) for r in scan.orderBy("ord").collect()] == [(7, ["secret"], False), (20, [], True), (0, [], True)]
    assert scan.select(F.max("bytes")).first()[0] == 80
