"""Phrases of two to DEPTH words that stand together, per language.

Each shard of a task's texts becomes a generalised suffix automaton over words, cut at DEPTH: the substrings that end at
the same places are one state, whose longest member has its length, whose link is the state of the longest suffix that
ends at more places, and whose count is the number of its places. Automata are made over arrays: the link tree is the
suffix tree of the reversed pieces, so a level of it is a sort by one more word to the left.

Two passes read the texts. The first enumerates all substrings up to DEPTH as hashes and counts, packed by bucket (a row
for each shard and bucket, as many buckets as spark.sql.shuffle.partitions says); buckets add up, and a filter of fixed
size (FILTER bits) tells what may occur often enough. It decides how many rows the second pass sends, not the result. The second
enumerates the automata again, sends the phrases that pass with their counts, summed by shard, and these are added up
exactly, by phrase. A phrase of a hot word or language is a row for each shard, not for each place.

A candidate's score is the lowest over its cuts of floor(2,000,000 * a / (l + r)). It is dropped if it lies inside a longer
candidate with 100 * f >= 80 * a: what lies inside is what the links lead to from each prefix of the longer one.

Letters A to Z are lower-cased; null texts are empty; a null language is "und"; repeated rows count as often as they
occur; tables without words give no rows, as do texts of separators alone. Columns but text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import cut, give_back, in_lots
from loomline.llm.shingles import mixed, word_hashes

DEPTH, LEAST, SUBSUMED, BEST = 4, 30, 80, 2000
#: Bytes of text of a shard, and bits of the filter (8 MB).
SHARD, FILTER = 3 << 20, 1 << 26
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


def split(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and its place in its piece."""
    kind = _KIND[data]
    edge = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False))
    first, end = edge[::2], edge[1::2]
    piece = np.searchsorted(np.flatnonzero(kind == 2), first)
    places = np.arange(len(first))
    begins = np.concatenate(([True], piece[1:] != piece[:-1])) if len(first) else np.empty(0, bool)
    return first, end, places - np.maximum.accumulate(np.where(begins, places, 0))


def named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each key, and of each number a place that has it and how many do."""
    order = np.argsort(key)
    s = key[order]
    new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, np.int64)
    counts = np.diff(new, append=len(s)).astype(np.int32)
    name = np.empty(len(key), np.int32)
    name[order] = np.repeat(np.arange(len(new), dtype=np.int32), counts)
    return name, order[new].astype(np.int32), counts


class Automaton:
    """Of words with their places in their pieces. Lists by length less one, of arrays by number: count, end (the place of
    its last word, once), up (the number of the suffix that is a word shorter), low (the shortest of its state), hash."""

    def __init__(self, words: np.ndarray, inner: np.ndarray, depth: int, seed: int) -> None:
        word, some, count = named(words)
        own = words[some]
        self.count, self.end, self.up, self.low, self.hash = [count], [some], [np.zeros(len(some), np.int32)], [np.ones(len(some), np.int32)], [mixed(own + np.uint64(seed))]
        at = word
        for d in range(2, depth + 1):
            ends = np.flatnonzero(inner >= d - 1)
            left = word[ends - d + 1]
            name, some, count = named(at[ends].astype(np.int64) * len(own) + left)
            up, left = at[ends[some]], left[some]
            at = np.full(len(words), -1, np.int32)
            at[ends] = name
            self.low.append(np.where(count == self.count[-1][up], self.low[-1][up], np.int32(d)))
            self.hash.append(mixed(self.hash[-1][up] * _C1 + own[left] * _C2))
            self.count.append(count)
            self.end.append(ends[some].astype(np.int32))
            self.up.append(up)

    def states(self) -> Iterator[tuple[int, np.ndarray]]:
        """(length, numbers) of the longest members of the states."""
        for d in range(len(self.count)):
            own = np.ones(len(self.count[d]), bool)
            if d + 1 < len(self.count):
                longer = self.low[d + 1] <= d + 1  # ends wherever its suffix does
                own[self.up[d + 1][longer]] = False
            yield d + 1, np.flatnonzero(own)

    def substrings(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, numbers, counts) of all members of all states: from a state's longest down its links."""
        for d, numbers in self.states():
            counts = self.count[d - 1][numbers]
            low = self.low[d - 1][numbers]
            for length in range(d, 0, -1):
                keep = low <= length
                if length < d:
                    numbers, counts, low = self.up[length][numbers[keep]], counts[keep], low[keep]
                yield length, numbers, counts


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """(language, bytes of texts, lower-cased and set apart by line ends) of a task's batches, by lots of SHARD bytes."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush() -> Iterator[tuple[str, np.ndarray]]:
        for lang in list(held):
            data = np.frombuffer(b"\n".join(held.pop(lang)), np.uint8)
            yield lang, data + ((data >= 65) & (data <= 90)).view(np.uint8) * np.uint8(32)

    for batch in in_lots(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= SHARD:
                    yield from flush()
                    size = 0
    yield from flush()
    give_back()


def seed_of(lang: str) -> int:
    return int(mixed(word_hashes(np.frombuffer(b"." + lang.encode(), np.uint8), np.array([0]), np.array([len(lang.encode()) + 1])))[0])


def automaton(lang: str, data: np.ndarray, depth: int) -> tuple[Automaton, np.ndarray, np.ndarray] | None:
    first, end, inner = split(data)
    if not len(first):
        return None
    return Automaton(mixed(word_hashes(data, first, end)), inner, depth, seed_of(lang)), first, end


def slots(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a hash, and 32 bits of it that the bucket does not depend on."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), hashes.astype(np.uint32)


def frequent(docs: DataFrame, depth: int, least: int, buckets: int, bits: int) -> np.ndarray:
    """For each bucket a row of flags, packed: which slices of its hashes hold one that occurs least times."""
    width = max(8, bits // buckets // 8 * 8)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in shards(batches):
            if (made := automaton(lang, data, depth)) is None:
                continue
            found = [(made[0].hash[d - 1][numbers], counts) for d, numbers, counts in made[0].substrings()]
            bucket, own = slots(np.concatenate([x for x, _ in found]), buckets)
            counts = np.concatenate([x for _, x in found]).astype(np.uint32)
            order = np.argsort(bucket.astype(np.int64) << 32 | own)
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            own, counts, full = own[order], counts[order], np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([own[ends[b] : ends[b + 1]].tobytes() for b in full], pa.binary()), pa.array([counts[ends[b] : ends[b + 1]].tobytes() for b in full], pa.binary())], names=["bucket", "hashes", "counts"])

    def add(table: pa.Table) -> pa.Table:
        hashes = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint32)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
        order = np.argsort(hashes)
        hashes = hashes[order]
        new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        often = hashes[new][np.add.reduceat(counts[order], new, dtype=np.int64) >= least]
        flags = np.zeros(width, bool)
        flags[(often.astype(np.uint64) * np.uint64(width) >> np.uint64(32)).astype(np.int64)] = True
        return pa.table({"bucket": table.column("bucket")[:1], "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    rows = docs.mapInArrow(send, "bucket int, hashes binary, counts binary").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(add, "bucket int, flags binary")
    out = np.zeros((buckets, width // 8), np.uint8)
    for r in rows.toLocalIterator():
        out[r.bucket] = np.frombuffer(r.flags, np.uint8)
    return out


def counted(docs: DataFrame, depth: int, least: int, flags: np.ndarray) -> DataFrame:
    """(lang, phrase, f, words) of all phrases that occur least times, and with a null phrase each language's words."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(flags)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = shipped.value
        width = np.uint64(may.shape[1] * 8)
        for lang, data in shards(batches):
            if (made := automaton(lang, data, depth)) is None:
                continue
            own, first, end = made
            raw, phrases, counts, words = data.tobytes(), [None], [len(first)], [0]
            for d, numbers, f in own.substrings():
                bucket, low = slots(own.hash[d - 1][numbers], len(may))
                bit = (low.astype(np.uint64) * width >> np.uint64(32)).astype(np.int64)
                hit = (may[bucket, bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
                last = own.end[d - 1][numbers[hit]]
                for stop in last.tolist():
                    span = range(stop - d + 1, stop + 1)
                    phrases.append(b" ".join([raw[first[j] : end[j]] for j in span]))
                counts += f[hit].tolist()
                words += [d] * len(last)
            n = len(phrases)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(words, pa.int32())], names=["lang", "phrase", "f", "words"])

    rows = docs.mapInArrow(send, "lang string, phrase string, f long, words int")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("phrase").isNull())


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", depth: int = DEPTH, least: int = LEAST, subsumed: int = SUBSUMED, best: int = BEST) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(counted(docs, depth, least, frequent(docs, depth, least, buckets, FILTER)), "phrases")
    totals = found.where("phrase is null").select("lang", F.col("f").alias("n"))
    phrases = found.where("phrase is not null").select("lang", "phrase", "f", "words")
    part = lambda a, b: F.array_join(F.slice("_w", a, b), " ")
    candidates = phrases.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("_w"))
    # the links of each prefix of a candidate lead to all that lies inside it
    inside = candidates.where("words > 2").select("lang", "a", "words", "_w", F.explode(F.sequence(F.lit(2), F.col("words"))).alias("_end"))
    inside = inside.select("lang", "a", "words", "_w", "_end", F.explode(F.sequence(F.lit(1), F.col("_end") - 1)).alias("_from")).where("_end - _from + 1 < words")
    over = inside.groupBy("lang", part(F.col("_from"), F.col("_end") - F.col("_from") + 1).alias("phrase")).agg(F.max("a").alias("_longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    free = candidates.join(over, ["lang", "phrase"], "left").where(F.coalesce(wide("_longer") * 100 < wide("a") * subsumed, F.lit(True)))
    cuts = free.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("_k"), "words", "_w")
    cuts = cuts.select("lang", "phrase", "a", "_k", part(F.lit(1), F.col("_k")).alias("_left"), part(F.col("_k") + 1, F.col("words") - F.col("_k")).alias("_right"))
    of = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(of("_left", "l"), ["lang", "_left"]).join(of("_right", "r"), ["lang", "_right"])
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = both.withColumn("score", score.cast("long")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "_k", "a", "l", "r")).alias("_b"))
    flat = scored.select("lang", "phrase", "_b.a", "_b.l", "_b.r", "_b.score")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = flat.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= best)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
