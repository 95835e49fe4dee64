"""Token counts by a two-tier look-up on the map side; pre-tokens are never shuffled.

Tier one is a compact table of frequent pre-tokens and their numbers of tokens, broadcast: TOP entries of 17 bytes at most,
whatever the corpus holds. It is ranked on about SAMPLE documents, chosen by a hash of their texts among all: each partition
sums up those that it has and hands its KEPT commonest to the driver, so no pre-token is ever shuffled. Tier two, for what
the table lacks, merges pairs and keeps the outcome in the worker. The ranking decides how often tier two is asked, never a
count, and every document is counted whole.

Counts are those of a byte-level BPE file of the `tokenizers` library: special strings inside a text are one token each,
as is that library's default; nothing is added or cut. Null counts as empty: 0 tokens. Rows don't meet, so ties and
repeated rows need no care; very long texts are counted in pieces; an empty table gives an empty one; a column of df that
has the name of a new one gives way to it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm import pretok
from loomline.llm.bpe import SHORT, Encoder, Slots, keys
from loomline.llm.common import in_lots, strings

#: Entries of the broadcast table at most; documents that it is ranked on, about; pre-tokens that a partition names for it, at most.
TOP, SAMPLE, KEPT = 1 << 16, 1 << 13, 1 << 12


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable ones as they are, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def load(path: str) -> tuple[Encoder, re.Pattern | None]:
    """An encoder over ranks in the order of the file's merges, and a pattern of its special strings."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, letters = file["model"], byte_letters()
    if model["type"] != "BPE" or file["pre_tokenizer"]["type"] != "ByteLevel" or file["normalizer"] or file["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"not a plain byte-level BPE file: {path}")
    ranks, pairs = {bytes([i]): i for i in range(256)}, {}
    for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
        a, b = (bytes(letters[c] for c in x) for x in (left, right))
        if a + b in ranks:
            raise ValueError("a token made by two merges")
        pairs[ranks[a] << 32 | ranks[b]] = ranks[a + b] = len(ranks)
    special = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
    return Encoder(ranks, pairs, whole=bool(model.get("ignore_merges"))), re.compile("|".join(map(re.escape, special))) if special else None


def apart(texts: list[str], special: re.Pattern | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts without their special strings, the text of each part, and how many such strings each text has."""
    parts = [special.split(t) if special else [t] for t in texts]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    return [p for own in parts for p in own], np.repeat(np.arange(len(parts)), n), n - 1


def summed(parts: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
    """Keys and their summed counts, the most common so many."""
    low, high, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((low, high))
    low, high, n = low[order], high[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))[: len(low)])
    low, high, n = low[first], high[first], np.add.reduceat(n, first) if len(first) else n
    best = np.argsort(-n, kind="stable")[:most]
    return low[best], high[best], n[best]


def frequent(df: DataFrame, text: str, top: int = TOP, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the commonest short pre-tokens of about sample documents of df, commonest first."""
    table = pretok.classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, parts, size = pretok.class_table(table), [], 0
        for batch in in_lots(batches, "text"):
            for some in pretok.pieces(strings(batch, "text")):
                data, at, length, _ = pretok.split(classes, [t for _, t in some])
                short = length <= SHORT
                low, high = keys(data, at[short], length[short])
                parts.append(summed([(low, high, np.ones(len(low), np.int64))], len(low)))
                size += len(parts[-1][0])
                if size > 16 * KEPT:
                    parts = [summed(parts, 4 * KEPT)]
                    size = len(parts[0][0])
        if parts:
            low, high, n = summed(parts, KEPT)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (low, high, n)], names=["low", "high", "n"])

    chosen = df.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(max(1, df.count()))) < sample)
    got = chosen.mapInArrow(run, "low long, high long, n long").toArrow()
    low, high, n = (got.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "n"))
    low, high, _ = summed([(low.view(np.uint64), high.view(np.uint64), n)], top)
    return low, high


def packed_table(df: DataFrame, path: str, text: str, top: int) -> tuple[bytes, bytes, bytes]:
    """Keys and numbers of tokens of frequent pre-tokens, packed."""
    if top <= 0:
        return b"", b"", b""
    low, high = frequent(df, text, top)
    data = np.stack([low, high], 1).tobytes()  # the keys hold the pre-tokens, 16 bytes for each
    count = load(path)[0].encode(data, np.arange(len(low)) * 16, (high >> np.uint64(56)).astype(np.int64))[1] if len(low) else low
    return low.tobytes(), high.tobytes(), count.astype(np.uint8).tobytes()


_tier_one: dict[bytes, Slots] = {}


def tier_one(key: bytes, packed: tuple[bytes, bytes, bytes]) -> Slots:
    """The table of a worker, known by a digest of its content and vocabulary."""
    if key not in _tier_one:
        _tier_one.clear()
        low, high, count = (np.frombuffer(x, kind) for x, kind in zip(packed, (np.uint64, np.uint64, np.uint8)))
        _tier_one[key] = Slots.of(low, high, count.astype(np.int32))
    return _tier_one[key]


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens", top: int = TOP) -> DataFrame:
    """Adds the number of tokens of each whole text."""
    packed = packed_table(df, path, text, top)
    table, shared = pretok.classes(), df.sparkSession.sparkContext.broadcast(packed)
    key = hashlib.sha256(path.encode() + b"".join(hashlib.sha256(x).digest() for x in packed)).digest()
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, (encoder, special), slots = pretok.class_table(table), load(path), tier_one(key, shared.value)
        for batch in in_lots(batches, text):
            parts, owner, total = apart(strings(batch, text), special)
            total = total.copy()
            for some in pretok.pieces(parts):
                data, at, length, tokens = pretok.split(classes, [t for _, t in some])
                low, high = keys(data, at, length)
                count = slots.get(low, high).astype(np.int64)
                count[length > SHORT] = -1
                if len(miss := np.flatnonzero(count < 0)):
                    found = encoder.entry(data, at[miss], length[miss], low[miss], high[miss])  # may move the counts
                    count[miss] = encoder.count[found]
                sums = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], np.cumsum(tokens)))]
                np.add.at(total, owner[[i for i, _ in some]], np.diff(sums))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(total, pa.int64())], names=kept + [out])

    return df.mapInArrow(run, schema)


