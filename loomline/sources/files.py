"""Folders of files as scans: listed in the executors, read as far as needed, classified, with what a cache knows taken from it."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import files, tokens
from loomline.functions.files import SCAN_LIMIT
from loomline.functions.paths import ancestors
from loomline.operators import workspace
from loomline.sources import catalog, scratch
from loomline.sources.bodies import Tokenizer, read_bodies
from loomline.sources.walk import walk

#: Warnings that come to the driver; the rest is told as a number, and all are in a table.
TOLD = 1000


def ignore_reason(size: Column, ignored: Column, limit: int = SCAN_LIMIT) -> Column:
    too_big = F.concat(F.lit("exceeds max file size ("), F.format_string("%.1f", size / 1_000_000), F.lit("MB)"))
    return F.when(size > limit, too_big).when(ignored, "matches ignore pattern")


def list_folder(spark: SparkSession, root: str, exclude: list[str] | None = None, ignore_files: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(ord, path, full, bytes, mtime, _ignored) of a folder's files in the order in which people sort paths, and notes; both are tables."""
    found, notes = walk(spark, root, ignore_files, exclude)
    ordered = found.orderBy(F.collate("path", "UNICODE"), "path")
    listed = ordered.select(F.monotonically_increasing_id().alias("ord"), "path", "full", "bytes", F.timestamp_seconds("time").alias("mtime"), ignore_reason(F.col("bytes"), F.col("ignored")).alias("_ignored"))
    return scratch.table(listed, "files"), notes


def wants_body() -> Column:
    """Of a listed file, whether its body tells anything: not of ignored, binary, empty or large ones."""
    return F.col("_ignored").isNull() & ~files.is_binary(F.col("path")) & (F.col("bytes") > 0) & (F.col("bytes") <= tokens.TEXT_LIMIT)


def read_folder(spark: SparkSession, root: str, exclude: list[str] | None = None, ignore_files: list[str] | None = None, cache: DataFrame | None = None, tokenizer: Tokenizer | None = None) -> tuple[DataFrame, DataFrame]:
    """(ord, path, bytes, mtime, text, _ignored, error, and of a cache or tokenizer _tokens, _flags, failed, cache_hit) of a folder's files, and notes.

    Only bodies that tell something and that the cache doesn't know, by path, size and time, are read.
    """
    listed, notes = list_folder(spark, root, exclude, ignore_files)
    told = F.col("_ignored").isNull() & ~files.is_binary(F.col("path")) & (F.col("bytes") > 0)
    if cache is None:
        known = listed.withColumns({"cache_hit": F.lit(False), "_tokens": F.lit(None).cast("long"), "_flags": F.lit(None).cast("array<string>")})
    else:
        own = cache.select("path", F.col("bytes").alias("_bytes"), F.col("mtime").alias("_mtime"), F.col("estimated_tokens").alias("_tokens"), F.col("risk_flags").alias("_flags"))
        hit = F.coalesce(told & (F.col("bytes") == F.col("_bytes")) & (F.col("mtime") == F.col("_mtime")), F.lit(False))
        both = listed.join(own, "path", "left").withColumn("cache_hit", hit).drop("_bytes", "_mtime")
        known = scratch.table(both.withColumns({c: F.when(F.col("cache_hit"), F.col(c)) for c in ("_tokens", "_flags")}), "known")
    bodies = read_bodies(spark, known.where(wants_body() & ~F.col("cache_hit")), tokenizer)
    scan = known.join(bodies, "path", "left").withColumn("_tokens", F.coalesce("_tokens", "tokens"))
    return scan.select("ord", "path", "bytes", "mtime", "text", "_ignored", "error", "_tokens", "_flags", F.coalesce("failed", F.lit(False)).alias("failed"), "cache_hit"), notes


@dataclass
class Scanned:
    """A scan's files, the warnings that came to the driver, and all of them as a table."""

    files: DataFrame
    warnings: list[str]
    every: DataFrame

    def __iter__(self) -> Iterator:
        return iter((self.files, self.warnings))


def scan_folder(spark: SparkSession, root: str, exclude: list[str] | None = None, cache: str | None = None, tokenizer: Tokenizer | None = None, ignore_files: list[str] | None = None) -> Scanned:
    """The classified scan of a folder with its texts and times, and warnings.

    With a cache folder, files that it knows aren't read: their tokens and flags are taken from it, their text is null, and it is saved anew.
    A cache belongs to a tokenizer and its version. Files that can't be read count by their size and are warned of.
    """
    key = tokenizer.key if tokenizer else "heuristic-v1"
    place = os.path.join(os.path.realpath(root), cache) if cache else None
    known = catalog.load_cache(spark, place, key) if place else None
    raw, notes = read_folder(spark, root, [*(exclude or []), *([f"/{cache}"] if cache else [])], ignore_files, known, tokenizer)
    scan = workspace.classify(raw, F.col("_ignored"), keep=["mtime", "error", "failed", "cache_hit"]).persist()
    if place:
        catalog.save_cache(scan, place, key)
    else:
        scan = scan.drop("cache_hit")
    unread = scan.where("error is not null").select(F.concat(F.lit("unreadable file: "), "path", F.lit(": "), "error").alias("note"))
    uncounted = scan.agg(F.count_if("failed").alias("n")).where("n > 0").select(F.concat(F.lit("tokenizer failed, estimate taken: "), F.col("n").cast("string"), F.lit(" files")).alias("note"))
    none = scan.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("No files found in workspace").alias("note"))
    every = notes.unionByName(unread).unionByName(uncounted).unionByName(none)
    warnings = [r.note for r in every.orderBy("note").take(TOLD + 1)]
    if len(warnings) > TOLD:
        warnings = [*warnings[:TOLD], f"and {every.count() - TOLD} more warnings"]
    return Scanned(scan, warnings, every)


def prune(df: DataFrame, folders: list[str]) -> DataFrame:
    """Files of a table that lie in none of the folders."""
    return df.where(~F.arrays_overlap(ancestors(F.col("path")), F.array(*[F.lit(f) for f in folders]))) if folders else df


def git_status(spark: SparkSession, root: str) -> DataFrame:
    told = subprocess.run(["git", "-C", root, "status", "--porcelain=v1", "-uall"], capture_output=True, text=True, check=True).stdout
    return spark.createDataFrame([(x,) for x in told.splitlines()], "line string")
