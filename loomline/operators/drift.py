"""What changed between two scans: by file, by folder, in all, and against a policy."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import paths
from loomline.functions.numbers import percent_change
from loomline.sources import scratch

#: Columns of a table of versions of files: whether the older and the newer scan hold a row.
SIDES = ["in_base", "in_now"]


def last_of_each(scan: DataFrame) -> DataFrame:
    """One row per path, the last by ord, with the tokens of all rows of the path. Of a saved scan, whose paths are normal, rows stay where they lie."""
    named = scan if "all_tokens" in scan.columns else scan.withColumn("path", paths.normal(F.col("path"))).groupBy("path").agg(F.max_by(F.struct("estimated_tokens", "risk_flags"), "ord").alias("x"), F.sum("estimated_tokens").alias("all_tokens")).select("path", "x.*", "all_tokens")
    return named.select("path", "estimated_tokens", "risk_flags", "all_tokens")


def save(scan: DataFrame, folder: str, buckets: int | None = None) -> None:
    """Keeps what drift needs of a scan: a row per path, bucketed and sorted by path, so that two saved scans meet without moving."""
    spark, name = scan.sparkSession, f"loomline_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    last_of_each(scan).repartition(n, "path").write.mode("overwrite").bucketBy(n, "path").sortBy("path").option("path", f"{folder.rstrip('/')}/buckets={n}").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay


def load(spark: SparkSession, folder: str) -> DataFrame:
    """A scan that was saved; the newest, if it was saved with several numbers of buckets."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [s for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place) if s.getPath().getName().startswith("buckets=")]
    newest = max(found, key=lambda s: s.getModificationTime()).getPath()
    name = f"loomline_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (path STRING, estimated_tokens BIGINT, risk_flags ARRAY<STRING>, all_tokens BIGINT) USING parquet CLUSTERED BY (path) SORTED BY (path) INTO {newest.getName().split('=')[1]} BUCKETS LOCATION '{newest.toString()}'")
    return spark.table(name)


def last_of_versions(scan: DataFrame) -> DataFrame:
    """last_of_each() of both scans that versions of files tell of, in one grouping."""
    held = scan.where(F.col(SIDES[0]) | F.col(SIDES[1])).withColumn("path", paths.normal(F.col("path")))
    last = lambda side: F.max_by(F.struct("estimated_tokens", "risk_flags"), F.when(F.col(side), F.col("ord")))
    total = lambda side: F.sum(F.when(F.col(side), F.col("estimated_tokens")))
    names = list(zip(SIDES, ("base", "current")))
    per = held.groupBy("path").agg(*[last(side).alias(f"_{n}") for side, n in names], *[total(side).alias(f"{n}_all") for side, n in names])
    return per.select("path", *[F.col(f"_{n}.{c}").alias(f"{n}_{short}") for _, n in names for c, short in (("estimated_tokens", "tokens"), ("risk_flags", "flags"))], *[f"{n}_all" for _, n in names])


def file_drift(base: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """What became of each path, from two scans, or from one table of versions of files, in which SIDES tell the scans that hold a row."""
    if now is None:
        both = last_of_versions(base)
    else:
        a = last_of_each(base).select("path", F.col("estimated_tokens").alias("base_tokens"), F.col("risk_flags").alias("base_flags"), F.col("all_tokens").alias("base_all"))
        b = last_of_each(now).select("path", F.col("estimated_tokens").alias("current_tokens"), F.col("risk_flags").alias("current_flags"), F.col("all_tokens").alias("current_all"))
        both = a.join(b, "path", "full_outer")
    old, new = F.coalesce("base_tokens", F.lit(0)), F.coalesce("current_tokens", F.lit(0))
    was, has = F.coalesce("base_flags", F.array().cast("array<string>")), F.coalesce("current_flags", F.array().cast("array<string>"))
    added, removed = F.filter(has, lambda f: ~F.array_contains(was, f)), F.filter(was, lambda f: ~F.array_contains(has, f))
    changed = (old != new) | (F.size(added) > 0) | (F.size(removed) > 0)
    status = F.when(F.col("base_tokens").isNull(), "added").when(F.col("current_tokens").isNull(), "removed").when(changed, "modified").otherwise("unchanged")
    return both.select("path", status.alias("status"), old.alias("base_tokens"), new.alias("current_tokens"), (new - old).alias("delta"), percent_change(old, new).alias("percent"), added.alias("added_flags"), removed.alias("removed_flags"), F.coalesce("base_all", F.lit(0)).alias("base_all"), F.coalesce("current_all", F.lit(0)).alias("current_all"))


def folder_drift(changes: DataFrame) -> DataFrame:
    per = changes.groupBy(paths.dirname(F.col("path")).alias("folder")).agg(
        F.sum("base_tokens").alias("base_tokens"), F.sum("current_tokens").alias("current_tokens"),
        F.sum(F.when(F.col("status") == "added", 1).when(F.col("status") == "removed", -1).otherwise(0)).cast("long").alias("net_files"),
    )
    return per.withColumn("delta", F.col("current_tokens") - F.col("base_tokens")).withColumn("percent", percent_change(F.col("base_tokens"), F.col("current_tokens")))


def summary(changes: DataFrame) -> DataFrame:
    """Counts by status; net drift from the scans' own totals, which repeated paths count in."""
    total = lambda n: F.coalesce(F.sum(n), F.lit(0))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified", "unchanged")]
    one = changes.agg(*counts, F.coalesce(F.sum(F.size("added_flags")), F.lit(0)).alias("new_flags"), total("base_all").alias("base_tokens"), total("current_all").alias("current_tokens"))
    return one.withColumn("net", F.col("current_tokens") - F.col("base_tokens")).withColumn("percent", percent_change(F.col("base_tokens"), F.col("current_tokens")))


def top_growing(changes: DataFrame, n: int = 10) -> DataFrame:
    return changes.where("delta > 0").orderBy(F.desc("delta"), "path").limit(n)


def top_shrinking(changes: DataFrame, n: int = 10) -> DataFrame:
    return changes.where("delta < 0").orderBy("delta", "path").limit(n)


def violations(total: DataFrame, max_increase: int | None = None, max_percent: float | None = None, new_flags: bool = False, max_files: int | None = None) -> DataFrame:
    """(rule, value, bound) of each rule of a policy that a summary breaks; bounds may be met."""
    rules = []
    if max_increase is not None:
        rules.append(("token-increase", F.col("net").cast("double"), float(max_increase)))
    if max_percent is not None:
        rules.append(("percent", F.col("percent"), float(max_percent)))
    if new_flags:
        rules.append(("new-risk-flags", F.col("new_flags").cast("double"), 0.0))
    if max_files is not None:
        rules.append(("file-count", (F.col("added") - F.col("removed")).cast("double"), float(max_files)))
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), v.alias("value"), F.lit(b).alias("bound")) for n, v, b in rules])
    return total.select(F.explode(rows).alias("r")).select("r.*").where("value > bound")


def largest_folders(per: DataFrame, n: int = 15) -> DataFrame:
    rank = F.row_number().over(Window.orderBy(F.desc(F.abs("delta")), "folder"))
    return per.orderBy(F.desc(F.abs("delta")), "folder").limit(n).withColumn("rank", rank)


@dataclass
class Drift:
    """What changed between two scans: every file as a table, and what a report shows of it."""

    files: DataFrame
    summary: Row
    violations: list[Row]
    growing: list[Row]
    shrinking: list[Row]
    folders: list[Row]

    @property
    def passed(self) -> bool:
        return not self.violations


def analyze(base: DataFrame, now: DataFrame | None = None, **policy: object) -> Drift:
    """All of a drift in one call, from two scans, saved scans or versions of files, under violations()' policy; they are read once."""
    changes = scratch.table(file_drift(base, now), "drift")
    total = summary(changes)
    broken = violations(total, **policy).collect() if any(v not in (None, False) for v in policy.values()) else []
    return Drift(changes, total.first(), broken, top_growing(changes).collect(), top_shrinking(changes).collect(), largest_folders(folder_drift(changes)).orderBy("rank").collect())
