"""A scan's facts and sums: files, folders (direct and recursive), languages, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import files, paths, tokens
from loomline.functions.numbers import share, to_fixed
from loomline.functions.once import with_once
from loomline.sources import scratch

#: What later steps need of a scan, without the texts.
FACTS = ["ord", "path", "language", "bytes", "estimated_tokens", "included", "risk_flags"]
LARGE = 50_000


def classify(df: DataFrame, ignored: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """(ord, path, text) with extension, language, bytes, risk_flags, estimated_tokens, included, excluded_reason, and columns to keep.

    A size comes from bytes where the table has it, else from the text. Files without a text, unread or unreadable, count by
    their size. Columns _tokens and _flags are what is known of a file: tokens in place of the estimate, and flags beside those of path and text.
    """
    path, text = F.col("path"), F.col("text")
    size = F.coalesce(*[F.col("bytes")] * ("bytes" in df.columns), F.octet_length("text"), F.lit(0)).cast("long")
    known = {c: F.col(c) if c in df.columns else F.lit(None).cast(kind) for c, kind in (("_tokens", "long"), ("_flags", "array<string>"))}
    base = df.select(
        "ord", "path", "text", paths.extension(path).alias("extension"), files.language(path).alias("language"), size.alias("bytes"), *[c for c in keep or [] if c != "bytes"],
        (F.lit(None).cast("string") if ignored is None else ignored).alias("_ignored"), *[c.alias(n) for n, c in known.items()],
    )
    flags = files.risk_flags(path, F.col("bytes"), text)
    flagged = with_once(base, {"risk_flags": F.coalesce(F.array_union(flags, F.col("_flags")), flags) if "_flags" in df.columns else flags, "_estimate": tokens.estimate(text)})
    read = F.when((F.col("bytes") > tokens.TEXT_LIMIT) | text.isNull(), tokens.estimate_bytes(F.col("bytes"))).otherwise(tokens.adjusted(F.col("_estimate"), F.col("extension")))
    counted = F.coalesce(F.col("_tokens"), read) if "_tokens" in df.columns else read
    count = F.when(F.col("_ignored").isNotNull() | files.is_binary(path) | (F.col("bytes") == 0), F.lit(0)).otherwise(counted).cast("long")
    why = files.excluded_reason(F.col("risk_flags"), path, F.col("_ignored"))
    return with_once(flagged, {"estimated_tokens": count, "excluded_reason": why}).withColumn("included", F.col("excluded_reason").isNull()).drop("_ignored", "_estimate", "_tokens", "_flags")


def stats(scan: DataFrame) -> DataFrame:
    kept = lambda c: F.sum(F.when(F.col("included"), F.col(c)).otherwise(0)).cast("long")
    return scan.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if("included").alias("included_files"), F.count_if(~F.col("included")).alias("excluded_files"), F.sum("bytes").alias("total_bytes"),
        kept("bytes").alias("included_bytes"), F.sum("estimated_tokens").alias("total_tokens"), kept("estimated_tokens").alias("included_tokens"),
    )


def folders(scan: DataFrame) -> DataFrame:
    """Sums by the folder a file lies in; ord is the group's first file, for ties."""
    return scan.groupBy(paths.dirname(F.col("path")).alias("folder")).agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("bytes").alias("total_bytes"), F.sum("estimated_tokens").alias("total_tokens"),
        F.count_if("included").alias("included_files"), F.count_if(~F.col("included")).alias("excluded_files"), F.min("ord").alias("ord"),
    )


def recursive_folders(scan: DataFrame) -> DataFrame:
    """Included tokens of each folder with all below it: a file counts for each ancestor, summed map-side."""
    each = scan.where("included").select("estimated_tokens", F.explode(paths.ancestors(F.col("path"))).alias("folder"))
    return each.groupBy("folder").agg(F.sum("estimated_tokens").alias("tokens"), F.count(F.lit(1)).alias("files"))


def languages(scan: DataFrame) -> DataFrame:
    """Included files by language, with the share of all included tokens, from 0 to 1."""
    per = scan.where("included").groupBy("language").agg(F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("total_bytes"), F.sum("estimated_tokens").alias("total_tokens"), F.min("ord").alias("ord"))
    return per.withColumn("percentage", share(F.col("total_tokens"), F.sum("total_tokens").over(Window.partitionBy())))


def top_files(scan: DataFrame, n: int = 10) -> DataFrame:
    return scan.where("included").orderBy(F.desc("estimated_tokens"), "ord").limit(n)


def top_folders(scan: DataFrame, n: int = 10) -> DataFrame:
    """Folders with included files by their recursive tokens, in one pass: an included file counts for all its ancestors, others tell only of the folder that holds them."""
    holds = paths.dirname(F.col("path"))
    each = scan.select("included", "estimated_tokens", "ord", holds.alias("_own"), F.explode(F.when(F.col("included"), paths.ancestors(F.col("path"))).otherwise(F.array(holds))).alias("folder"))
    own = F.col("folder") == F.col("_own")
    tokens = F.sum(F.when(F.col("included"), F.col("estimated_tokens"))).alias("tokens")
    per = each.groupBy("folder").agg(tokens, F.count_if(F.col("included") & own).alias("_n"), F.min(F.when(own, F.col("ord"))).alias("ord"))
    return per.where("_n > 0").select("folder", "ord", "tokens").orderBy(F.desc("tokens"), "ord").limit(n)


def top_direct_folders(scan: DataFrame, n: int = 10) -> DataFrame:
    """Folders by the tokens of the files right in them, whether or not any is included."""
    return folders(scan).orderBy(F.desc("total_tokens"), "ord").limit(n)


def ordered(scan: DataFrame) -> DataFrame:
    """Files in the order of their paths as people sort them."""
    return scan.orderBy(F.collate(F.col("path"), "UNICODE"), "path")


def count_tokens(scan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, files, languages) of a scan: all that counting a workspace's tokens tells."""
    return stats(scan).select("total_tokens", "included_tokens", (F.col("total_tokens") - F.col("included_tokens")).alias("excluded_tokens"), "total_files"), scan.select("path", "language", "estimated_tokens", "included"), languages(scan)


def facts(scan: DataFrame) -> DataFrame:
    """What later steps need of a scan, as a narrow table, so that its texts are read and classified once."""
    return scratch.table(scan.select(*FACTS), "facts")


def sums(scan: DataFrame) -> DataFrame:
    """(kind, name, files, included, bytes, included_bytes, tokens, included_tokens, large, flagged, ord) in one pass and one shuffle.

    Kinds are total, folder (that holds a file), tree (all above an included file), language (of included files) and flag; each
    view of a scan is some rows of this.
    """
    of = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    none = F.array().cast("array<struct<kind:string,name:string>>")
    each = F.concat(
        F.array(of("total", F.lit("")), of("folder", paths.dirname(F.col("path")))), F.transform("risk_flags", lambda f: of("flag", f)),
        F.when(F.col("included"), F.concat(F.array(of("language", F.col("language"))), F.transform(paths.ancestors(F.col("path")), lambda a: of("tree", a)))).otherwise(none),
    )
    rows = scan.select("ord", "bytes", "estimated_tokens", "included", (F.size("risk_flags") > 0).alias("_flagged"), F.explode(each).alias("_k")).select("_k.*", "*").drop("_k")
    kept = lambda c: F.sum(F.when(F.col("included"), F.col(c)).otherwise(0)).cast("long")
    return rows.groupBy("kind", "name").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("included").alias("included"), F.sum("bytes").alias("bytes"), kept("bytes").alias("included_bytes"), F.sum("estimated_tokens").alias("tokens"),
        kept("estimated_tokens").alias("included_tokens"), F.count_if(F.col("included") & (F.col("estimated_tokens") > LARGE)).alias("large"), F.count_if("_flagged").alias("flagged"), F.min("ord").alias("ord"),
    )


def view(summed: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind, most tokens first; a language's share is that of all included tokens."""
    own = summed.where(F.col("kind") == kind).drop("kind")
    if kind == "language":
        own = own.withColumn("percentage", share(F.col("included_tokens"), F.sum("included_tokens").over(Window.partitionBy())))
    return own.orderBy(F.desc("tokens"), "ord")


def largest_trees(summed: DataFrame, n: int = 10) -> DataFrame:
    """(name, tokens, included) of folders that hold included files, by the tokens of all below them."""
    both = summed.where(F.col("kind").isin("folder", "tree")).groupBy("name").agg(F.max(F.when(F.col("kind") == "tree", F.col("tokens"))).alias("tokens"), F.max(F.when(F.col("kind") == "folder", F.col("included"))).alias("included"), F.max(F.when(F.col("kind") == "folder", F.col("ord"))).alias("ord"))
    return both.where("included > 0").orderBy(F.desc("tokens"), "ord").limit(n)


def compact(scan: DataFrame) -> DataFrame:
    """(part, name, tokens, extra): the ten largest files, the ten folders with most tokens right in them, and languages with their shares."""
    own = facts(scan)
    summed = scratch.table(sums(own), "sums")
    files_ = top_files(own).select(F.lit("file").alias("part"), F.col("path").alias("name"), F.col("estimated_tokens").alias("tokens"), F.col("language").alias("extra"))
    folders_ = view(summed, "folder").limit(10).select(F.lit("folder"), "name", "tokens", F.col("included").cast("string"))
    return files_.union(folders_).union(view(summed, "language").select(F.lit("language"), "name", "tokens", F.format_string("%.4f", "percentage")))


def flag_counts(scan: DataFrame) -> DataFrame:
    return scan.select(F.explode("risk_flags").alias("flag"), "estimated_tokens").groupBy("flag").agg(F.count(F.lit(1)).alias("files"), F.sum("estimated_tokens").alias("tokens"))


def escapes(path: Column) -> Column:
    """Whether a path leads out of the root."""
    depth = F.aggregate(F.split(paths.normal(path), "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda d, p: F.struct(
        (d["at"] + F.when(p.isin("", "."), 0).when(p == "..", -1).otherwise(1)).alias("at"), F.least(d["least"], d["at"] + F.when(p == "..", -1).otherwise(0)).alias("least")))
    return paths.normal(path).startswith("/") | paths.normal(path).rlike("^[A-Za-z]:") | (depth["least"] < 0)


def batch(scan: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row per wanted path: whether it is there, its size and tokens, and what is wrong else. One path out of the root fails all."""
    out = wanted.where(escapes(F.col("path"))).limit(1).collect()
    if out:
        raise ValueError(f"path outside the root: {out[0].path}")
    found = wanted.join(scan.select("path", "estimated_tokens", "bytes", F.lit(True).alias("_there")), "path", "left")
    there = F.coalesce("_there", F.lit(False))
    return found.select("path", there.alias("exists"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("estimated_tokens", F.lit(0)).cast("long").alias("estimated_tokens"), F.when(~there, "file not found").alias("error"))


def batch_fit(scan: DataFrame, wanted: DataFrame, budget: int) -> DataFrame:
    """Totals of the wanted paths that can be read, and how far they fill a budget."""
    total = batch(scan, wanted).agg(F.count(F.lit(1)).alias("requested"), F.count_if("exists").alias("readable"), F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return total.withColumn("fits", F.col("tokens") <= budget).withColumn("utilisation", to_fixed(F.col("tokens") / F.lit(float(budget)) * 100, 2))


def cache_counts(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count_if("cache_hit").alias("cache_hits"), F.count_if(~F.col("cache_hit")).alias("cache_misses"))


def with_cache(scan: DataFrame, cache: DataFrame) -> DataFrame:
    """Marks files whose path, size and time a cache has, with its tokens and, where the cache has flags, those too; what isn't there was missed."""
    flags = [F.col("risk_flags").alias("_flags")] * ("risk_flags" in cache.columns)
    known = cache.select("path", F.col("bytes").alias("_bytes"), F.col("mtime").alias("_mtime"), F.col("estimated_tokens").alias("_tokens"), *flags)
    both = scan.join(known, "path", "left")
    hit = F.coalesce((F.col("bytes") == F.col("_bytes")) & (F.col("mtime") == F.col("_mtime")), F.lit(False))
    told = {"cache_hit": hit, "estimated_tokens": F.when(hit, F.col("_tokens")).otherwise(F.col("estimated_tokens"))}
    if flags:
        told["risk_flags"] = F.when(hit & F.col("_flags").isNotNull(), F.array_union("risk_flags", "_flags")).otherwise(F.col("risk_flags"))
    return both.withColumns(told).drop("_bytes", "_mtime", "_tokens", "_flags")
