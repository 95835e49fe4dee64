"""Exact duplicates by content-defined chunk recipes.

A rolling hash cuts every text where its content says so; a text's recipe is the ordered list of its chunks'
identifiers. Chunks of equal hash are compared byte for byte, once for each batch that holds them, so an identifier is
verified; the few texts with a chunk whose hash two contents share (none, with 128 bits) go by the text itself. Equal
texts have equal recipes and the other way round, so documents meet as lists of 16 bytes a chunk, not as texts.

Null counts as empty, and empty texts are equal to each other. Rows with null ids are grouped too, but stay only if their
group has no other. Among rows that share text and id, all carry the same verdict. Further columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import bitmap, cut, in_bitmap, in_lots, lookup, prefix

#: Bytes of a chunk: at least, about, at most; and bytes hashed at once.
LEAST, USUAL, MOST, BLOCK = 256, 2048, 16384, 1 << 20
WINDOW = 16
#: Bytes of chunks that a task remembers as sent.
SEEN = 16 << 20
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, np.uint32)


def digest16(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def candidates(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: where the hash of the last WINDOW bytes has its upper bits clear."""
    h = _GEAR[data]
    shift = 1
    while shift < WINDOW:
        h[shift:] += h[:-shift] << np.uint32(shift)
        shift *= 2
    return np.flatnonzero(h < np.uint32((1 << 32) // USUAL)) + 1


def cuts(data: np.ndarray, start: int, end: int, found: np.ndarray) -> list[int]:
    """Ends of the chunks of data[start:end]; what lies before start has no say, as LEAST is over WINDOW."""
    out, at = [], start
    while end - at > LEAST:
        i = np.searchsorted(found, at + LEAST)
        stop = min(at + MOST, int(found[i]) if i < len(found) else end, end)
        out.append(stop)
        at = stop
    if at < end:
        out.append(end)
    return out


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The chunks of each text."""
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= BLOCK or i + 1 == len(texts):
            joined = b"".join(held)
            data = np.frombuffer(joined, np.uint8)
            found, at = candidates(data) if size else np.empty(0, np.int64), 0
            for own in held:
                ends = cuts(data, at, at + len(own), found)
                yield [joined[a:b] for a, b in zip([at, *ends], ends)]
                at += len(own)
            held, size = [], 0


def payload(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("_text").cast(pa.binary()).to_pylist()]


def recipes(docs: DataFrame, digest: Callable[[bytes], bytes] = digest16) -> DataFrame:
    """(_id, _recipe, text_sha256) of rows (_id, _text), and rows with chunk_id: identifiers that stand for more than one content.

    Texts are chunked once. A task sends a chunk once, as long as it remembers it; equal identifiers meet and their
    contents are compared, while recipes pass by.
    """
    kind = docs.schema["_id"].dataType.simpleString()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = {}, 0
        for batch in in_lots(batches, "_text"):
            texts, made, ids, contents = payload(batch), [], [], []
            for own in chunks(texts):
                recipe = []
                for c in own:
                    recipe.append(i := digest(c))
                    if seen.get(i) != c:
                        ids.append(i)
                        contents.append(c)
                        seen[i] = c
                        size += len(c)
                made.append(b"".join(recipe))
                if size > SEEN:
                    seen, size = {}, 0
            n, m = len(texts), len(ids)
            names = ["key", "chunk", "_id", "_recipe", "sum"]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(contents, pa.binary()), pa.nulls(m, batch.column("_id").type), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names=names)
            sums = [hashlib.sha256(t).digest() for t in texts]
            spread = [xxhash.xxh3_128_digest(s + i.to_bytes(8, "big")) for i, s in enumerate(sums)]
            yield pa.RecordBatch.from_arrays([pa.array(spread, pa.binary()), pa.nulls(n, pa.binary()), batch.column("_id"), pa.array(made, pa.binary()), pa.array(sums, pa.binary())], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, content, told = None, None, False
        for batch in batches:
            bad = []
            for key, chunk in zip(batch.column("key").to_pylist(), batch.column("chunk").to_pylist()):
                if chunk is None:
                    continue
                if key != last:
                    last, content, told = key, chunk, False
                elif chunk != content and not told:
                    bad.append(key)
                    told = True
            own = batch.filter(batch.column("sum").is_valid())
            n = len(bad)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([own.column("_id"), pa.nulls(n, own.column("_id").type)]), pa.concat_arrays([own.column("_recipe").cast(pa.binary()), pa.nulls(n, pa.binary())]),
                pa.array([x.hex() for x in own.column("sum").to_pylist()] + [None] * n, pa.string()), pa.array([None] * own.num_rows + bad, pa.binary()),
            ], names=["_id", "_recipe", "text_sha256", "chunk_id"])

    sent = docs.mapInArrow(send, f"key binary, chunk binary, _id {kind}, _recipe binary, sum binary")
    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(compare, f"_id {kind}, _recipe binary, text_sha256 string, chunk_id binary")


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[bytes], bytes] = digest16) -> DataFrame:
    """One row per row of df: its id, keep_id (the largest id of its group), group_size, kept and text_sha256."""
    docs = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    made = cut(recipes(docs, digest), "recipes")
    found = made.where("text_sha256 is not null").select("_id", "_recipe", "text_sha256")
    bad = made.where("chunk_id is not null").select("chunk_id")
    wide = len(digest(b""))
    if not bad.isEmpty():
        own = F.sequence(F.lit(0), F.expr(f"cast(octet_length(_recipe) div {wide} as int) - 1"))
        of = found.where("octet_length(_recipe) > 0").select("text_sha256", F.explode(F.transform(own, lambda i: F.substring("_recipe", i * wide + 1, F.lit(wide)))).alias("chunk_id"))
        again = of.join(bad.distinct(), "chunk_id", "left_semi").select("text_sha256").distinct().withColumn("_bad", F.lit(True))
        whole = docs.select("_id", F.coalesce(F.col("_text"), F.lit("")).cast("binary").alias("_whole")).withColumn("text_sha256", F.sha2("_whole", 256))
        marked = whole.join(again, "text_sha256", "left").where("_bad").select("_id", F.concat(F.lit(b"="), "_whole").alias("_recipe"), "text_sha256")
        found = cut(found.join(again, "text_sha256", "left_anti").select("_id", "_recipe", "text_sha256").unionByName(marked), "recipes")
    total = found.count()
    groups = found.groupBy("_recipe").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    out = lookup(found, groups.where("group_size > 1"), "_recipe", "group_size", total)
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return out.select(F.col("_id").alias(key), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), keep.eqNullSafe(F.col("_id")).alias("kept"), "text_sha256")


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay: of equal texts the row with the largest id (of rows that share it too, one).

    Verdicts travel as ids and digests. A broadcast bitmap tells which ids may have a row to drop; all other rows stay
    where they are, and only those texts move once.
    """
    names, inner = df.columns, prefix(*df.columns)
    verdicts = cut(exact_groups(df, key, text).groupBy(F.col(key).alias("_id"), F.col("text_sha256").alias("_sum")).agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "verdicts")
    going = bitmap(verdicts.where("not kept or n > 1"), "_id")
    certain = in_bitmap(df, key, going, "left_anti")
    doubtful = in_bitmap(df, key, going, "left_semi").withColumn(f"{inner}sum", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    stay = verdicts.where("kept").select(F.col("_id").alias(f"{inner}id"), F.col("_sum").alias(f"{inner}own"))
    once = doubtful.join(stay, F.col(key).eqNullSafe(F.col(f"{inner}id")) & (F.col(f"{inner}sum") == F.col(f"{inner}own")), "left_semi").dropDuplicates([key, f"{inner}sum"])
    return certain.unionByName(once.select(*names))
