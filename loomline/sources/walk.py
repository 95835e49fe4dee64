"""A folder's files as a table, found by a walk in the executors.

A frontier of folders is expanded round by round. Each of its rows carries the rules that it inherits; a task follows a folder
depth first, in order, until it has met SHARE entries, and hands on what is left as the next frontier, so that a small
tree takes one round and a large one spreads out. Folders met before, by their real paths, are not entered again: of several ways to one
folder the way of the earlier round counts, then the first in order. What each round finds is a table; the driver holds none of it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.paths import ancestors
from loomline.sources import scratch
from loomline.sources.rules import IGNORE_FILES, Rules

SKIPPED = {".git", ".svn", ".hg"}
SHARE = 20_000
ROUND = "kind string, path string, full string, bytes long, time double, ignored boolean, rules array<struct<folder:string,lines:array<string>>>, note string"
_FIELDS = [f.strip().split()[0] for f in ROUND.replace("array<struct<folder:string,lines:array<string>>>", "x").split(",")]


def lines_of(path: str) -> list[str]:
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read().split("\n")


def root_rules(root: str, extra: list[str] | None = None) -> tuple[list[str], list[str]]:
    """(lines, warnings) of the ignore files in the root, in their order; missing ones are passed over."""
    real, lines, warnings = os.path.realpath(root), [], []
    for name in [*IGNORE_FILES, *(extra or [])]:
        place = os.path.realpath(os.path.join(real, name))
        if os.path.isabs(name) or ".." in name.replace("\\", "/").split("/") or not place.startswith(real + os.sep):
            warnings.append(f"ignore file outside the root: {name}")
        elif os.path.exists(place):
            try:
                lines += lines_of(place)
            except OSError as error:
                warnings.append(f"unreadable ignore file: {name}: {error.strerror}")
    return lines, warnings


class Task:
    """Follows folders of a frontier and yields what it finds as tuples of ROUND."""

    def __init__(self, real: str, base: Rules, share: int) -> None:
        self.real, self.base, self.share, self.met, self.seen = real, base, share, 0, set()

    def inside(self, place: str) -> bool:
        return place == self.real or place.startswith(self.real.rstrip(os.sep) + os.sep)

    def folder(self, path: str, full: str, inherited: list[tuple[str, list[str]]]) -> Iterator[tuple]:
        stack = [iter([("folder", path, full, inherited)])]
        while stack:
            for kind, at, place, rules in stack[-1]:
                if kind == "folder":
                    if self.met >= self.share:
                        yield "folder", at, os.path.realpath(place), None, None, None, [{"folder": f, "lines": x} for f, x in rules], None
                        continue
                    stack.append(self.entries(at, place, rules))
                    break
                yield place
            else:
                stack.pop()

    def entries(self, path: str, full: str, inherited: list[tuple[str, list[str]]]) -> Iterator[tuple]:
        """("folder", path, place, rules) of folders to enter and ("row", path, tuple, None) of what is found."""
        real = os.path.realpath(full)
        if not self.inside(real) or real in self.seen:
            yield "row", path, note(f"{'folder met before' if real in self.seen else 'link out of the root'}: {path}"), None
            return
        self.seen.add(real)
        yield "row", path, ("entered", path, real, None, None, None, None, None), None
        rules = inherited
        nested = os.path.join(full, ".gitignore")
        if path and os.path.isfile(nested):
            try:
                rules = [*inherited, (path, lines_of(nested))]
            except OSError:  # as if it weren't there
                pass
        now = Rules(rules, under=self.base) if rules else self.base
        try:
            found = sorted(os.scandir(full), key=lambda e: e.name)
        except OSError as error:
            yield "row", path, note(f"unreadable folder: {path or '.'}: {error.strerror}"), None
            return
        for e in found:
            self.met += 1
            at = f"{path}/{e.name}" if path else e.name
            if e.name in SKIPPED:
                continue
            try:
                place, link = os.path.realpath(e.path), e.is_symlink()
                if link and not self.inside(place):
                    yield "row", at, note(f"link out of the root: {at}"), None
                elif e.is_dir():
                    if not now.decides(at, True):
                        yield "folder", at, e.path, rules
                elif e.is_file():
                    ignored = now.decides(at, False)
                    if not (link and ignored):
                        own = e.stat()
                        yield "row", at, ("file", at, place, own.st_size, own.st_mtime, ignored, None, None), None
                elif link:
                    yield "row", at, note(f"broken link: {at}"), None
            except OSError as error:
                yield "row", at, note(f"unreadable: {at}: {error.strerror}"), None


def note(text: str) -> tuple:
    return "note", None, None, None, None, None, None, text


def expand(frontier: DataFrame, real: str, root: list[str], own: list[str], share: int) -> DataFrame:
    """What the folders of a frontier (path, full, rules) hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, held = Rules([("", root)], own), []
        for batch in batches:
            for path, full, rules in zip(batch["path"], batch["full"], batch["rules"]):
                task = Task(real, base, share)
                for row in task.folder(path, full, [(r["folder"], list(r["lines"])) for r in rules]):
                    held.append(row)
                    if len(held) >= 10_000:
                        yield pd.DataFrame(held, columns=_FIELDS, dtype=object)
                        held = []
        if held:
            yield pd.DataFrame(held, columns=_FIELDS, dtype=object)

    return frontier.select("path", "full", "rules").mapInPandas(run, ROUND)


def walk(spark: SparkSession, root: str, extra: list[str] | None = None, exclude: list[str] | None = None, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(files, notes) of a folder that the executors see under the driver's path.

    Files have path, full (the real path), bytes, time and ignored. Ignored folders and those of version control are not entered; files in
    them are not listed, others that rules ignore are, unless they are links. Links out of the root or in a circle give notes.
    """
    real = os.path.realpath(root)
    lines, warnings = root_rules(real, extra)
    kinds = "path string, full string, rules array<struct<folder:string,lines:array<string>>>"
    frontier, rounds, met, spread = spark.createDataFrame([("", real, [])], kinds), [], [], 1
    order = lambda c: F.translate(c, "/", "\x01")  # noqa: E731  a folder before what follows its name
    while True:
        found = scratch.table(expand(frontier.repartition(spread) if spread > 1 else frontier, real, lines, exclude or [], share), "round").withColumn("_round", F.lit(len(rounds)))
        rounds.append(found)
        left = found.where("kind = 'folder'")
        n = left.count()
        if not n:
            break
        known = rounds[0]
        for r in rounds[1:]:
            known = known.unionByName(r)
        entered = known.where("kind = 'entered'").select("full")
        met.append(left.join(entered, "full", "left_semi").select(F.concat(F.lit("folder met before: "), "path").alias("note")))
        fresh = left.join(entered, "full", "left_anti").groupBy("full").agg(F.min_by(F.struct("path", "rules"), order(F.col("path"))).alias("_b"))
        frontier, spread = fresh.select("_b.path", "full", "_b.rules"), min(n, 4 * spark.sparkContext.defaultParallelism)
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    files = every.where("kind = 'file'").select("path", "full", "bytes", "time", "ignored")
    again = twice(every, order) if len(rounds) > 1 else None
    if again is not None:
        away = files.select("path", F.explode(ancestors(F.col("path"))).alias("_folder")).join(F.broadcast(again) if again.count() < 1000 else again, "_folder").select("path")
        files = files.join(away, "path", "left_anti")
    notes = every.where("kind = 'note'").select("note")
    for own in met:
        notes = notes.unionByName(own)
    if again is not None:
        notes = notes.unionByName(again.select(F.concat(F.lit("folder met before: "), "_folder").alias("note")))
    if warnings:
        notes = notes.unionByName(spark.createDataFrame([(w,) for w in warnings], "note string"))
    return files, notes


def twice(every: DataFrame, order: object) -> DataFrame | None:
    """Folders (_folder) whose real path was entered under another path first, by tasks that didn't know of each other."""
    entered = every.where("kind = 'entered'").select("path", "full", "_round")
    several = entered.groupBy("full").agg(F.count(F.lit(1)).alias("n"), F.min_by("path", F.struct("_round", order(F.col("path")))).alias("_first")).where("n > 1")
    found = entered.join(several, "full").where("path <> _first").select(F.col("path").alias("_folder")).distinct()
    return None if found.isEmpty() else found
