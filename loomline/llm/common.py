"""Shared plumbing: scratch tables in the cluster's shared folder and skew-safe lookups."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key holding at least one row in this many counts as hot; so there are at most this many hot keys.
HOT_SHARE = 1000

_scratch: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local one only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[set[str]]:
    """Deletes the scratch paths made inside, at the end, but those added to the set that it gives."""
    before, keep = set(_scratch), set()
    yield keep
    for path in set(_scratch) - before - keep:
        drop_scratch(spark, path)


def prefix(*columns: str) -> str:
    """The start of names that no column of these has, whatever its case."""
    found = "_"
    while any(c.lower().startswith(found) for c in columns):
        found += "_"
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when this driver process ends."""
    path = f"{shared_dir(spark)}/loomline-{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_clean)
    _scratch.add(path)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    _scratch.discard(path)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_scratch):
        if spark is not None:
            try:
                drop_scratch(spark, path)
            except Exception:  # noqa: BLE001 - the session may already be gone at exit
                return


def cut(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder, at path or a fresh one, and read it back."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join rows to keyed (one row per key) where a few keys may hold a large share of the rows.

    weight is the keyed column that counts the rows of a key. Keys with at least total / HOT_SHARE rows, of which there
    can be HOT_SHARE at most, go by broadcast; all others by a shuffled join whose partitions stay even.
    """
    floor = max(2, total // HOT_SHARE)
    inner = prefix(*rows.columns, *keyed.columns)
    names = [c for c in keyed.columns if c != key]
    hot = keyed.where(F.col(weight) >= floor).select(key, F.lit(True).alias(f"{inner}hot"), *[F.col(c).alias(f"{inner}h_{c}") for c in names])
    first = rows.join(F.broadcast(hot), key, "left")
    cold = keyed.where(F.col(weight) < floor)
    back = [c for c in rows.columns if c != key]
    done = first.where(F.col(f"{inner}hot")).select(key, *back, *[F.col(f"{inner}h_{c}").alias(c) for c in names])
    rest = first.where(F.col(f"{inner}hot").isNull()).select(key, *back).join(cold, key, "left").select(key, *back, *names)
    return done.unionByName(rest)


def count_words(text: Column, separators: str, pattern: str) -> Column:
    """How many runs of other characters than separators a text has: what regexp_count says of the pattern, cheaper if that has many ranges.

    Separators become blanks, and runs of up to 16 of these one; texts with longer runs are left to the pattern.
    """
    x = F.translate(text, separators, " " * len(separators))
    for _ in range(4):
        x = F.replace(x, F.lit("  "), F.lit(" "))
    bare = F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    ends = F.when(F.startswith(x, F.lit(" ")), 1).otherwise(0) + F.when(F.endswith(x, F.lit(" ")), 1).otherwise(0)
    return F.when(F.contains(x, F.lit("  ")), F.regexp_count(text, F.lit(pattern))).when(bare == 0, 0).otherwise(F.octet_length(x) - bare + 1 - ends)


def bitmap(keys: DataFrame, column: str, bits: tuple[int, int] = (16, 26)) -> tuple[DataFrame, int]:
    """(_word, _bits) of a bitmap of the hashes of a column, and its size as a power of 2: 16 bits a row, within these bounds (8 MB)."""
    power = min(bits[1], max(bits[0], (16 * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64(column), F.lit(1 << power))
    bit = F.expr("shiftleft(1L, cast(_slot % 64 as int))")
    return keys.select(slot.alias("_slot")).groupBy(F.expr("shiftright(_slot, 6)").alias("_word")).agg(F.bit_or(bit).alias("_bits")), power


def in_bitmap(df: DataFrame, column: str, found: tuple[DataFrame, int], how: str) -> DataFrame:
    """Rows of df whose column may be among the keys (how left_semi), or can't (left_anti); the bitmap is broadcast."""
    inner, (words, power) = prefix(*df.columns), found
    words = words.select(F.col("_word").alias(f"{inner}word"), F.col("_bits").alias(f"{inner}bits"))
    slot = F.pmod(F.xxhash64(column), F.lit(1 << power))
    hit = F.col(f"{inner}bits").bitwiseAND(F.col(f"{inner}bit")) != 0
    marked = df.withColumns({f"{inner}at": F.shiftright(slot, 6), f"{inner}bit": F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))})
    return marked.join(F.broadcast(words), (F.col(f"{inner}at") == F.col(f"{inner}word")) & hit, how).select(*df.columns)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def slices(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have most bytes together, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


#: Bytes of texts that a worker holds as Python values at once.
LOT = 4 << 20


def in_lots(batches: Iterator[pa.RecordBatch], name: str, most: int = LOT) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, name, most)
    give_back()


def give_back() -> None:
    """Returns memory that a task has freed to the system, as its worker may wait long for the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def vocabulary(name: str) -> str:
    """Where a public tokenizer file lies; the folder can be set by PUBLIC_TOKENIZERS."""
    if folder := os.environ.get("PUBLIC_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
