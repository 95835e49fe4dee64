"""Model catalogues, saved reports and scan caches as tables."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Sequence
from urllib.parse import urlsplit
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_VERSION = 3
REPORT_VERSION = "1.0.0"
FEED_LIMIT, FEED_SECONDS = 1_000_000, 10
MODEL = (
    "id string, display_name string, provider string, context_window long, max_output_tokens long, input_price double, output_price double, cached_price double, supports_tools boolean, supports_images boolean, "
    "supports_local boolean, privacy_mode string, coding_score double, reasoning_score double, latency_score double, updated_at string, ord long"
)
#: The names of a catalogue file's fields, in the order of MODEL.
FIELDS = ["id", "displayName", "provider", "contextWindow", "maxOutputTokens", "inputPricePerMillion", "outputPricePerMillion", "cachedInputPricePerMillion", "supportsTools", "supportsImages", "supportsLocal", "privacyMode", "codingScore", "reasoningScore", "latencyScore", "updatedAt"]
_NUMBERS = {3, 4, 5, 6, 7, 12, 13, 14}


def parse_models(spark: SparkSession, value: object) -> DataFrame:
    """A bare list of models, or an object that has one; values of a wrong type become null, for validation to find."""
    models = parse_catalogue(value)["models"]

    def clean(n: int, x: object) -> object:
        if n in _NUMBERS:
            ok = isinstance(x, int | float) and not isinstance(x, bool)
            return (int(x) if n in (3, 4) and float(x).is_integer() else None if n in (3, 4) else float(x)) if ok else None
        return x if isinstance(x, bool if n in (8, 9, 10) else str) else None

    rows = [tuple(clean(n, m.get(f)) for n, f in enumerate(FIELDS)) + (i,) for i, m in enumerate(models) if isinstance(m, dict)]
    return spark.createDataFrame(rows, MODEL)


def parse_catalogue(value: object) -> dict:
    """version, updatedAt and models of a catalogue file; a bare list has the defaults, as has what an object leaves out."""
    own = {"models": value} if isinstance(value, list) else value if isinstance(value, dict) else {}
    text = lambda f, default: own[f] if isinstance(own.get(f), str) else default
    return {"version": text("version", "1.0"), "updatedAt": text("updatedAt", time.strftime("%Y-%m-%d", time.gmtime())), "models": own["models"] if isinstance(own.get("models"), list) else []}


def load_models(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A catalogue file, or models.json in a folder; empty if there is none, unless strict."""
    place = os.path.join(path, "models.json") if os.path.isdir(path) else path
    if not os.path.exists(place) and not strict:
        return spark.createDataFrame([], MODEL)
    with open(place, encoding="utf-8") as f:
        return parse_models(spark, json.load(f))


def first_catalogue(spark: SparkSession, candidates: Sequence[str]) -> DataFrame:
    """The first of some places whose catalogue isn't empty."""
    for path in candidates:
        found = load_models(spark, path)
        if not found.isEmpty():
            return found
    return spark.createDataFrame([], MODEL)


def fetch_models(spark: SparkSession, url: str, opener=urlopen) -> DataFrame:  # noqa: ANN001
    """A catalogue from an https address, of FEED_LIMIT bytes at most, also after redirects."""
    if urlsplit(url).scheme != "https":
        raise ValueError("only https")
    with opener(url, timeout=FEED_SECONDS) as reply:
        if urlsplit(reply.geturl()).scheme != "https":
            raise ValueError("only https, also after redirects")
        body = reply.read(FEED_LIMIT + 1)
    if len(body) > FEED_LIMIT:
        raise ValueError("catalogue too large")
    found = parse_models(spark, json.loads(body))
    if found.isEmpty():
        raise ValueError("empty catalogue")
    return found


def cache_path(folder: str, tokenizer: str) -> str:
    return f"{folder.rstrip('/')}/version={CACHE_VERSION}/tokenizer={tokenizer}"


def load_cache(spark: SparkSession, folder: str, tokenizer: str = "heuristic-v1") -> DataFrame:
    """A scan cache of this version and tokenizer; empty if there is none."""
    schema = "path string, bytes long, mtime timestamp, estimated_tokens long, risk_flags array<string>"
    to = cache_path(folder, tokenizer)
    for place in (to, to + ".old"):  # the older one is there alone only if a save was cut short
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema(schema).parquet(place)
    return spark.createDataFrame([], schema)


def save_cache(scan: DataFrame, folder: str, tokenizer: str = "heuristic-v1") -> None:
    """Replaces a cache as a whole: written beside it, the old one put aside, the new one moved into its place. A crash leaves one of them."""
    spark, to = scan.sparkSession, cache_path(folder, tokenizer)
    scan.select("path", "bytes", "mtime", "estimated_tokens", "risk_flags").write.mode("overwrite").parquet(to + ".new")
    new, now, old = (spark._jvm.org.apache.hadoop.fs.Path(to + end) for end in (".new", "", ".old"))
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(now):
        fs.delete(old, True)
        fs.rename(now, old)
    fs.rename(new, now)
    fs.delete(old, True)


def list_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Saved reports, newest first: id, title, generatedAt, goal, summary."""
    counts = "totalFiles:long,includedFiles:long,excludedFiles:long,totalEstimatedTokens:long,includedTokens:long"
    raw = spark.read.schema(f"title string, generatedAt string, goal string, summary struct<{counts}>").option("multiLine", True).json(folder)
    name = F.regexp_extract(F.input_file_name(), r"/([\w-]+)\.json$", 1)
    return raw.withColumn("id", name).where("id <> '' and generatedAt is not null").orderBy(F.desc("generatedAt"), "id").select("id", "title", "generatedAt", "goal", "summary")


def check_report(report: object) -> None:
    """Raises ValueError for what isn't a report of this version."""
    names, lists = ("title", "generatedAt", "workspacePath"), ("topTokenConsumers", "topFolders", "languages", "warnings", "assumptions", "optimizationChecklist")
    counts = ("totalFiles", "includedFiles", "excludedFiles", "totalEstimatedTokens", "includedTokens")
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool) and 0 <= x < float("inf")
    if not isinstance(report, dict) or report.get("schemaVersion") != REPORT_VERSION:
        raise ValueError("not a report of this version")
    wrong = [n for n in names if not isinstance(report.get(n), str)] + [n for n in lists if not isinstance(report.get(n), list)]
    if not isinstance(report.get("goal"), str | None):
        wrong.append("goal")
    summary = report.get("summary")
    wrong += [n for n in counts if not isinstance(summary, dict) or not number(summary.get(n))]
    if not isinstance(report.get("recommendations", ""), dict | None):
        wrong.append("recommendations")
    if wrong:
        raise ValueError("wrong fields in report: " + ", ".join(wrong))


def save_report(report: dict, folder: str) -> str:
    """Checks a report, writes it under a new id into a folder, and returns the id."""
    check_report(report)
    body = json.dumps(report, ensure_ascii=False)
    if len(body.encode()) > FEED_LIMIT:
        raise ValueError("report too large")
    os.makedirs(folder, exist_ok=True)
    name = f"{time.time_ns() // 1_000_000}-{uuid.uuid4().hex[:8]}"
    write_text(body, os.path.join(folder, name + ".json"))
    return name


def write_text(text: str, path: str, force: bool = False) -> None:
    """Writes a file that isn't there yet, or, if forced, any."""
    with open(path, "w" if force else "x", encoding="utf-8") as f:
        f.write(text)


def write_with_backup(text: str, path: str) -> str | None:
    """Replaces a file in one step; the path of the copy that is kept of what was there, if anything was."""
    kept = None
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    if os.path.exists(path):
        kept = path + ".bak"
        shutil.copy2(path, kept)
    new = f"{path}.{uuid.uuid4().hex}.tmp"
    write_text(text, new)
    os.replace(new, path)
    return kept
