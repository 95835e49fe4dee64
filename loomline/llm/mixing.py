"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source; a source's target is its weight's share of all words, but REPEAT times its words at most,
and what is above goes to the others by weight until none is above. Its rate is target over words: each document is
taken floor(rate) times, and once more if a hash of its id and the seed falls below the rate's fraction. So reruns and
other partitionings agree, and no document is taken more than REPEAT times.

A null text has 0 words. Sources rank by code point, null last and a source of its own. Rows that share id and source
share their fate. A source without words takes none. Tables without rows or words give targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import prefix

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, REPEAT = (5.0, 2.0, 1.0), 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, source: str, size: str, weights: tuple[float, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """(_source, source_size, target), a row for each source: as many as there are distinct sources, summed map-side first.

    With sources in order of repeat * words / weight, the capped ones come first: a source is capped if the share that is
    left when all before it are capped would exceed its cap.
    """
    per = sized.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("source_size"))
    rank = Window.orderBy(F.col("_source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(repeat))
    every, before = Window.partitionBy(), Window.orderBy(F.col("_ratio"), F.col("_source").asc_nulls_last())
    ranked = per.select("_source", "source_size", pick.alias("_weight")).withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    total = F.sum("source_size").over(every).cast("double")
    past = before.rowsBetween(Window.unboundedPreceding, -1)
    spare = total - F.coalesce(F.sum("_cap").over(past), F.lit(0.0))
    left = F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(past), F.lit(0.0))
    level = ranked.withColumn("_level", spare / left).withColumn("_free", F.col("_level") <= F.col("_ratio"))
    first = level.withColumn("_shared", F.min(F.when(F.col("_free"), F.struct("_ratio", "_level"))).over(every)["_level"])
    return first.select("_source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_shared"), F.col("_ratio")) * F.col("_weight")).alias("target"))


def fraction(key: Column, seed: str) -> Column:
    """Uniform in [0, 1) from 52 bits of a hash of the seed and the id."""
    hexed = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(hexed, 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, repeat: int = REPEAT, seed: str = "mix") -> DataFrame:
    """df with size, source_size, target and copies: how often the mix takes each row. Columns of those names give way."""
    added = ["size", "source_size", "target", "copies"]
    inner = prefix(*df.columns, *added)
    sized = df.select(*[c for c in df.columns if c not in added], words(F.col(text)).alias("size"))
    goals = targets(df.select(F.col(source), words(F.col(text)).alias("size")), source, "size", weights, repeat).withColumnRenamed("_source", f"{inner}source")
    # sources are few whatever the rows: the join is left to the planner, which broadcasts by size
    joined = sized.join(goals, F.col(source).eqNullSafe(F.col(f"{inner}source")), "left").drop(f"{inner}source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(repeat)))).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(fraction(F.col(key), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long"))


def emit(df: DataFrame, **options: object) -> DataFrame:
    """The rows of df, each as often as the mix takes it."""
    inner = prefix(*df.columns)
    aside = {c: f"{inner}{c}" for c in df.columns if c in ("size", "source_size", "target", "copies")}
    mixed = mix(df.withColumnsRenamed(aside), **options).where("copies > 0")
    copy = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias(f"{inner}copy")
    return mixed.select(*[F.col(aside.get(c, c)).alias(c) for c in df.columns], copy).drop(f"{inner}copy")
