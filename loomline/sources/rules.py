"""Ignore rules: lines of ignore files as patterns, over one path in Python or over a table of paths by joins.

A path is ignored if the last rule that matches it, or a folder on its way, isn't negated; what an ignored folder holds can't come
back. Letters match in either case. Rules of one file that follow each other with the same sign are one pattern, so a
file of many lines is a few patterns, tried from the last; a folder is matched with a slash behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE_FILES = [".gitignore", ".cursorignore", ".aiderignore", ".continueignore"]  # further names are a parameter
Run = tuple[str, bool]


def pattern(line: str, folder: str = "") -> Run | None:
    """(pattern, whether it ignores) of a line of an ignore file that lies in a folder; none for blanks and comments.

    The pattern is for whole paths, those of folders with a slash at the end, and means the same to Python and Java.
    """
    rule = line.rstrip("\r\n")
    rule = rule if rule.endswith("\\ ") else rule.rstrip(" ")
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[negated:]
    rule = rule[1:] if rule[:2] in ("\\#", "\\!") else rule
    only_folders, rule = rule.endswith("/"), rule.rstrip("/")
    anchored, rule = "/" in rule, rule.lstrip("/")
    if not rule:
        return None
    out, i = [], 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            out.append("/.+")
            i += 3
        elif rule[i] == "*":
            out.append("[^/]*")
            i += 1 + rule.startswith("**", i)
        elif rule[i] == "?":
            out.append("[^/]")
            i += 1
        elif rule[i] == "[" and (end := rule.find("]", i + 2)) > 0:
            inner = rule[i + 1 : end]
            other, inner = inner[0] in "!^", inner.lstrip("!^") if inner[0] in "!^" else inner
            out.append("(?!/)[" + "^" * other + re.sub(r"([\[\]\\&~^])", r"\\\1", inner) + "]")
            i = end + 1
        else:
            if rule[i] == "\\" and i + 1 < len(rule):
                i += 1
            out.append(re.escape(rule[i]))
            i += 1
    lead = (re.escape(folder + "/") if folder else "") + ("" if anchored else "(?:.*/)?")
    return lead + "".join(out) + ("/" if only_folders else "/?"), not negated


def runs(lines: Iterable[str], folder: str = "") -> list[Run]:
    """The patterns of lines in order, from the last, neighbours of one sign as one."""
    made = [p for line in lines if (p := pattern(line, folder))]
    return [("|".join(p for p, _ in reversed(list(own))), ignores) for ignores, own in ((k, list(g)) for k, g in groupby(made, lambda p: p[1]))][::-1]


class Rules:
    """Rules over single paths: those of the root's ignore files, of nested ones and the caller's own, the last of which goes first."""

    def __init__(self, scopes: Iterable[tuple[str, Iterable[str]]], own: Iterable[str] = (), under: Rules | None = None) -> None:
        self.base = [(re.compile(p, re.IGNORECASE | re.DOTALL), ignores) for folder, lines in reversed(list(scopes)) for p, ignores in runs(lines, folder)] + (under.base if under else [])
        self.own = under.own if under else [(re.compile(p, re.IGNORECASE | re.DOTALL), ignores) for p, ignores in runs(own)]

    def decides(self, path: str, folder: bool) -> bool:
        subject = path + "/" * folder
        for found, ignores in (*self.own, *self.base):
            if found.fullmatch(subject):
                return ignores
        return False

    def ignored(self, path: str) -> bool:
        parts = path.split("/")
        return any(self.decides("/".join(parts[:n]), True) for n in range(1, len(parts))) or self.decides(path, False)


def steps(path: Column) -> Column:
    """The folders on the way to a path, each with a slash behind it, and the path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.when(n < F.size(parts), "/").otherwise("")))


def first_sign(subject: Column, own: list[Run]) -> Column:
    """What the first pattern that matches says, null if none does. The patterns are literals, compiled once."""
    found = F.lit(None).cast("boolean")
    for p, ignores in reversed(own):
        found = F.when(subject.rlike(rf"(?is)\A(?:{p})\z"), F.lit(ignores)).otherwise(found)
    return found


def with_ignored(df: DataFrame, root: list[str], nested: DataFrame | None = None, own: list[str] | None = None, name: str = "ignored") -> DataFrame:
    """df (path, ...) with whether rules ignore each path: those of the root's files, of nested files (folder, lines) and the caller's own.

    Nested rules are an index by folder: only the folders on a path's way are looked up, however many have rules. A null path is not ignored.
    """
    top, last = runs(root), runs(own or [])
    step = F.col("_step")
    if nested is None:
        decide = lambda s: F.coalesce(first_sign(s, last), first_sign(s, top), F.lit(False))
        return df.withColumn(name, F.coalesce(F.exists(steps(F.col("path")), decide), F.lit(False)))
    rows = [(r.folder, r.folder.count("/"), n, p, ignores) for r in nested.toLocalIterator() for n, (p, ignores) in enumerate(runs(r.lines, r.folder))]
    index = df.sparkSession.createDataFrame(rows, "_folder string, _deep int, _n int, _pattern string, _sign boolean")
    paths = df.select("path").distinct().select("path", F.explode(steps(F.col("path"))).alias("_step"))
    # a step is judged by the rules of the folders above it: the deepest first, of these the last
    above = F.explode(F.transform(F.filter(steps(F.rtrim("_step", F.lit("/"))), lambda s: s.endswith("/")), lambda s: F.substring(s, F.lit(1), F.length(s) - 1))).alias("_folder")
    met = paths.select("path", "_step", above).join(index, "_folder").where(F.expr("_step rlike concat('(?is)\\\\A(?:', _pattern, ')\\\\z')"))
    told = met.groupBy("path", "_step").agg(F.max_by("_sign", F.struct("_deep", -F.col("_n"))).alias("_inner"))
    each = paths.join(told, ["path", "_step"], "left").withColumn("_yes", F.coalesce(first_sign(step, last), F.col("_inner"), first_sign(step, top), F.lit(False)))
    found = each.groupBy("path").agg(F.bool_or("_yes").alias(name))
    return df.join(found, "path", "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
