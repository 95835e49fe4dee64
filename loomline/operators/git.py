"""Porcelain status lines as rows, and which files they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import paths

def unquote(name: Column) -> Column:
    return paths.normal(F.regexp_replace(name, r'^"(.*)"$', "$1"))


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """A row per line of three characters or more: codes, path, original_path of a rename, and five flags."""
    raw = lines.where(F.length(line) >= 3).withColumns({"index_status": F.substring(line, 1, 1), "worktree_status": F.substring(line, 2, 1), "_rest": F.trim(F.expr(f"substring({line}, 4)"))}).where("_rest <> ''")
    code = F.concat("index_status", "worktree_status")
    renamed = F.col("_rest").contains(" -> ")
    untracked, conflicted = code == "??", (F.col("index_status") == "U") | (F.col("worktree_status") == "U") | code.isin("AA", "DD")
    plain = ~untracked & ~conflicted
    return raw.select(
        *[c for c in lines.columns if c != line],
        "index_status",
        "worktree_status",
        unquote(F.when(renamed, F.get(F.split("_rest", " -> "), 1)).otherwise(F.col("_rest"))).alias("path"),
        F.when(renamed, unquote(F.get(F.split("_rest", " -> "), 0))).alias("original_path"),
        (plain & ~F.col("index_status").isin(" ", "?")).alias("staged"),
        (plain & ~F.col("worktree_status").isin(" ", "?")).alias("unstaged"),
        untracked.alias("untracked"),
        conflicted.alias("conflicted"),
        ((F.col("index_status") == "D") | (F.col("worktree_status") == "D")).alias("deleted"),
    )


def scope(status: DataFrame, which: str = "all-dirty", deleted: bool = False) -> DataFrame:
    """staged, unstaged, untracked, conflicted or all-dirty; deleted files only on request."""
    kept = status.where("staged or unstaged or untracked or conflicted") if which == "all-dirty" else status.where(F.col(which))
    return kept if deleted else kept.where(~F.col("deleted"))


def summary(status: DataFrame) -> DataFrame:
    kinds = ("staged", "unstaged", "untracked", "conflicted", "deleted")
    return status.agg(*[F.count_if(k).alias(k) for k in kinds], F.count(F.lit(1)).alias("dirty"))


def touched(scan: DataFrame, dirty: DataFrame) -> DataFrame:
    """Files equal to a dirty path, or of which one is the other's end after a folder, in any case.

    Both sides list their suffixes, so two equality joins do what a loop over all pairs would.
    """
    low = lambda c: F.lower(paths.normal(F.col(c)))
    keys = dirty.where("path <> ''").select(low("path").alias("k")).distinct()
    ends = dirty.where("path <> ''").select(F.explode(paths.suffixes(low("path"))).alias("k")).distinct()
    own = scan.where("path <> ''").withColumn("_low", low("path"))
    longer = own.select("path", F.explode(paths.suffixes(F.col("_low"))).alias("k")).join(keys, "k", "left_semi").select("path")
    shorter = own.select("path", F.col("_low").alias("k")).join(ends, "k", "left_semi").select("path")
    return scan.join(longer.union(shorter).distinct(), "path", "left_semi")
