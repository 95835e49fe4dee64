"""Passages of documents that also stand in a document with a smaller id, found by suffix arrays of shards.

A byte goes if a string of LENGTH bytes covers it that also starts in a document with a smaller id. What stands where:

1. Equal texts are told by their digest: all but the smallest id's go whole and take no further part.
2. Texts are dealt to lots by their digest, as a table bucketed by lot, which later steps join without moving it.
3. Each string of LENGTH bytes has an anchor, the leftmost place of the least hash of GRAM bytes within it, and holds the 2 * GRAM
   bytes from there, or those up to its end. Lots send the prints of these, packed by bucket, and hear which of them another lot
   has. A string whose print is in no other text can't be repeated.
4. The strings that share an anchor, and may be repeated, are a window of their text. Lots send each distinct window once, with the smallest and the
   largest id that has it, to the shard of its anchor: so all places of a string are in one shard, whatever text they are in.
5. A shard's windows are one string, whose suffixes are sorted by external induced sorting (suffixes.py): suffixes that share
   LENGTH bytes are a group, which has a smallest id. Lots hear it for each window, mark what goes and hash what stays.

A text of any number of copies, or a passage of any number of texts, is sent once by each lot. Texts move twice if they may be copies
and once else. A shard's tuples beyond MEMORY go to the shared folder, so windows of one anchor may be larger than memory.

Null texts are empty and have no bytes. Null ids are larger than all others and not smaller than each other; rows that share an id
don't remove each other's bytes, and equal rows have equal results. Texts are bytes: what stays need not be UTF-8. Empty tables
give empty results. Ids are integers; columns but id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import suppress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm import suffixes
from loomline.llm.common import bitmap, cut, give_back, in_bitmap, lookup, scratch_path
from loomline.llm.shingles import mixed

LENGTH, GRAM = 50, 16
#: Bytes of a lot while there are few lots and when there are many; lots up to which they are small; buckets at most.
LOT, LARGE_LOT, FEW_LOTS, BUCKETS = 6 << 20, 128 << 20, 4096, 65_536
#: Bytes of a shard's tuples in memory.
MEMORY = 192 << 20
BLOCK = 1 << 19
_GEAR = np.random.default_rng(13).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_C, _LEFT = 0x9E3779B97F4A7C15, np.uint64(0xA5A5A5A55A5A5A5A)
_LAST = (1 << 63) - 1
SPANS = "array<struct<first:long,end:long>>"


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of GRAM bytes, a power of 2, and of twice as many from each place. The last places' are of fewer."""
    h, span = _GEAR[data], 1
    while span < GRAM:
        h[:-span] = h[:-span] * np.uint64(pow(_C, span, 1 << 64)) + h[span:]
        span *= 2
    twice = h.copy()
    twice[:-span] = h[:-span] * np.uint64(pow(_C, span, 1 << 64)) + h[span:]
    return h, twice


class Windows(NamedTuple):
    """Runs of strings that share an anchor: text, first and last start, place of the first start of the right part, and prints of the anchor, the right and the left part."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    middle: np.ndarray
    anchor: np.ndarray
    right: np.ndarray
    left: np.ndarray

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(prints by bucket, texts, runs) of the right parts that are there, then of the left ones."""
        at = np.flatnonzero(self.last >= self.middle), np.flatnonzero(self.first < self.middle)
        run = np.concatenate(at)
        return placed(np.concatenate((self.right[at[0]], self.left[at[1]])), buckets), self.text[run], run


def windows(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """What Windows has but for the text; none passes a text's end."""
    empty = (*[np.empty(0, np.int64)] * 3, *[np.empty(0, np.uint64)] * 3)
    if len(data) < length:
        return empty
    h, twice = gram_hashes(data)
    least = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(data), dtype=np.uint64)
    wide, span = length - GRAM + 1, 1
    while span * 2 <= wide:
        np.minimum(least[:-span], least[span:], out=least[:-span])
        span *= 2
    if span < wide:
        np.minimum(least[: -(wide - span)], least[wide - span :], out=least[: -(wide - span)])
    whole = np.ones(len(data), bool)
    for end, begin in zip(ends, np.concatenate(([0], ends[:-1]))):
        whole[max(begin, end - length + 1) : end] = False
    at = np.flatnonzero(whole)
    if not len(at):
        return empty
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(anchor) != 0))))
    anchor = anchor[new]
    # strings from here on hold the bytes right of the anchor, those before hold the bytes left of it
    middle = anchor - (length - 2 * GRAM - 1)
    return at[new], at[np.append(new[1:], len(at)) - 1], middle, mixed(h[anchor]), mixed(twice[anchor]), mixed(twice[np.maximum(anchor - GRAM, 0)] ^ _LEFT)


class Lot:
    """The texts of a lot in one order, whatever the order in which they come."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by("_sum")
        self.sums, self.ids = table.column("_sum"), table.column("_id").to_numpy().astype(np.int64)
        texts = table.column("_text").cast(pa.large_binary()).to_pylist()
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        self.bytes = b"".join(texts)
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.begins = np.concatenate(([0], self.ends[:-1]))

    def windows(self, length: int) -> Windows:
        parts, low = [], 0  # a few texts at a time
        while low < len(self.ends):
            start = self.begins[low]
            high = max(low + 1, int(np.searchsorted(self.ends, start + BLOCK)))
            first, last, middle, *prints = windows(self.data[start : self.ends[high - 1]], self.ends[low:high] - start, length)
            parts.append((np.searchsorted(self.ends, first + start, "right"), first + start, last + start, middle + start, *prints))
            low = high
        return Windows(*(np.concatenate(c) for c in zip(*parts)))


def placed(prints: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 further bits of each print, as one number."""
    return (prints % np.uint64(buckets)) << np.uint64(32) | (prints // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)


def packed(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(fields)})


def joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in table.column(name).to_pylist()), kind)


NOTE = "lot int, kind int, shard int, a binary, b binary, c binary"


def texts_in_lots(docs: DataFrame, facts: DataFrame, lots: int, name: str) -> DataFrame:
    """(lot, _id, _sum, _text) of each distinct text, under its smallest id, as a table bucketed by lot."""
    spark = docs.sparkSession
    keyed = docs.withColumn("_sum", F.unhex(F.sha2("_text", 256)))
    several = facts.groupBy("_sum").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = bitmap(several, "_sum")
    stay = several.select(F.col("_sum").alias("_own"), "_first")
    once = in_bitmap(keyed, "_sum", copies, "left_semi").join(stay, F.col("_sum") == F.col("_own"), "left").where("_own is null or _id = _first").select("_id", "_sum", "_text").dropDuplicates(["_sum"])
    dealt = in_bitmap(keyed, "_sum", copies, "left_anti").unionByName(once).select(F.pmod(F.xxhash64("_sum"), F.lit(lots)).cast("int").alias("lot"), "_id", "_sum", "_text")
    buckets = min(lots, BUCKETS)
    dealt.repartition(buckets, "lot").write.bucketBy(buckets, "lot").sortBy("lot").option("path", scratch_path(spark, "texts")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def prints_of(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, lot, prints) of each lot, distinct and in order."""

    def run(table: pa.Table) -> pa.Table:
        lot = table.column("lot")[0].as_py()
        found = np.unique(Lot(table).windows(length).keys(buckets)[0])
        ends = np.searchsorted(found >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        own = found.astype(np.uint32)
        give_back()
        return packed([(int(b), lot, own[ends[b] : ends[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(ends))], [("bucket", pa.int32()), ("lot", pa.int32()), ("prints", pa.binary())])

    return texts.groupBy("lot").applyInArrow(run, "bucket int, lot int, prints binary")


def shared(prints: DataFrame, buckets: int) -> DataFrame:
    """Of each lot's prints those that another lot has too."""

    def run(table: pa.Table) -> pa.Table:
        each = [np.frombuffer(x, np.uint32) for x in table.column("prints").to_pylist()]
        all_ = np.sort(np.concatenate(each))
        often = np.unique(all_[1:][all_[1:] == all_[:-1]])
        bucket = table.column("bucket")[0].as_py()
        rows = [(lot, 0, bucket, np.intersect1d(own, often, True).tobytes(), None, None) for lot, own in zip(table.column("lot").to_pylist(), each)]
        return packed([r for r in rows if r[3]], FIELDS)

    return prints.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, NOTE)


FIELDS = [("lot", pa.int32()), ("kind", pa.int32()), ("shard", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]


def sent(texts: DataFrame, heard: DataFrame, length: int, buckets: int, shards: int) -> DataFrame:
    """Rows of kind 1: a lot's distinct windows for a shard (bytes, lengths, number of the first with the ids); of kind 2: where they stand."""

    def run(table: pa.Table, notes: pa.Table) -> pa.Table:
        if not table.num_rows:
            return packed([], FIELDS)
        lot = Lot(table)
        found = lot.windows(length)
        key, text, of_run = found.keys(buckets)
        known = [np.uint64(b) << np.uint64(32) | np.frombuffer(x, np.uint32).astype(np.uint64) for b, x in zip(notes.column("shard").to_pylist(), notes.column("a").to_pylist())]
        elsewhere = np.sort(np.concatenate(known)) if known else np.empty(0, np.uint64)
        order = np.argsort(key, kind="stable")
        k, t = key[order], text[order]
        shared_ = np.zeros(len(key), bool)  # with another text of the lot
        if len(k):
            begins = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            shared_[order] = np.repeat(np.minimum.reduceat(t, begins) != np.maximum.reduceat(t, begins), np.diff(begins, append=len(k)))
        if len(elsewhere):
            shared_ |= elsewhere[np.minimum(np.searchsorted(elsewhere, key), len(elsewhere) - 1)] == key
        parts = np.zeros((2, len(found.first)), bool)  # which of right and left may be repeated
        rights = np.arange(len(key)) < np.count_nonzero(found.last >= found.middle)
        parts[0, of_run[shared_ & rights]] = parts[1, of_run[shared_ & ~rights]] = True
        first = np.where(parts[1], found.first, np.maximum(found.first, found.middle))
        last = np.where(parts[0], found.last, np.minimum(found.last, found.middle - 1))
        text, prints, hit = found.text, found.anchor, np.flatnonzero(parts.any(0))
        shard = ((prints[hit] >> np.uint64(7)) % np.uint64(shards)).astype(np.int64)
        hit = hit[np.argsort(shard, kind="stable")]
        shard = np.sort(shard)
        number, bodies, entry = {}, [], np.empty(len(hit), np.int32)
        low, high, where = [], [], []
        for i, (a, b, s, doc) in enumerate(zip(first[hit].tolist(), last[hit].tolist(), shard.tolist(), lot.ids[text[hit]].tolist())):
            body = lot.bytes[a : b + length]
            e = number.setdefault((s, body), len(bodies))
            if e == len(bodies):
                bodies.append(body)
                low.append(doc)
                high.append(doc)
                where.append(s)
            else:
                low[e], high[e] = min(low[e], doc), max(high[e], doc)
            entry[i] = e
        name, rows = table.column("lot")[0].as_py(), []
        ends = np.searchsorted(where, np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(ends)).tolist():
            own = slice(ends[s], ends[s + 1])
            rows.append((name, 1, s, b"".join(bodies[own]), np.fromiter(map(len, bodies[own]), np.uint16).tobytes(), np.array([ends[s], *low[own], *high[own]], np.int64).tobytes()))
        rows.append((name, 2, 0, entry.tobytes(), first[hit].astype(np.int64).tobytes(), None))
        give_back()
        return packed(rows, FIELDS)

    return texts.groupBy("lot").cogroup(heard.groupBy("lot")).applyInArrow(run, NOTE)


def repeated(rows: DataFrame, length: int, shards: int, folder: str, memory: int) -> DataFrame:
    """For each lot and shard, runs of a window's starts whose string has a smaller id: (entry, from, count) and that id."""

    def run(table: pa.Table) -> pa.Table:
        number, bodies, low, high, lots = {}, [], [], [], []
        for lot, shard, data, sizes, ids in zip(*[table.column(c).to_pylist() for c in ("lot", "shard", "a", "b", "c")]):
            ids, own, at = np.frombuffer(ids, np.int64), [], 0
            n = (len(ids) - 1) // 2
            for size, a, b in zip(np.frombuffer(sizes, np.uint16).tolist(), ids[1 : n + 1].tolist(), ids[n + 1 :].tolist()):
                body = data[at : at + size]
                at += size
                e = number.setdefault(body, len(bodies))
                if e == len(bodies):
                    bodies.append(body)
                    low.append(a)
                    high.append(b)
                else:
                    low[e], high[e] = min(low[e], a), max(high[e], b)
                own.append(e)
            lots.append((lot, shard, int(ids[0]), np.array(own)))
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        begins = np.cumsum(sizes + 1) - sizes - 1
        string = np.frombuffer(b"\0".join([*bodies, b""]) + b"\0", np.uint8).astype(np.uint16) + np.uint16(2)
        string[begins + sizes], string[-1] = 1, 0
        del number, bodies
        low = np.array(low)
        group, least = np.full(len(string), -1, np.int32 if len(string) < 1 << 31 else np.int64), []
        of = lambda places: np.searchsorted(begins, places, "right") - 1
        disk, groups = suffixes.Disk(folder, memory), 0
        try:
            for places, common in suffixes.suffixes(string, 258, disk, length):
                mine = of(places)
                whole = np.flatnonzero((mine >= 0) & (places + length <= begins[mine] + sizes[mine]))
                # the suffix before one with a whole string in common has a whole string itself, so it is among these
                new = common[whole] < length
                if not len(whole):
                    continue
                mark = groups + np.cumsum(new) - 1
                group[places[whole]] = mark
                leads = np.flatnonzero(np.concatenate(([True], mark[1:] != mark[:-1])))
                found = np.minimum.reduceat(low[mine[whole]], leads)
                if mark[0] < groups:  # goes on from the part before
                    least[-1][-1] = min(least[-1][-1], found[0])
                    found = found[1:]
                if len(found):
                    least.append(found)
                groups = int(mark[-1]) + 1
        finally:
            disk.close()
        at = np.flatnonzero(group >= 0)
        own, best = of(at), np.concatenate([*least, np.empty(0, np.int64)])[group[at]]
        keep = best < np.array(high)[own] if len(at) else np.empty(0, bool)
        at, own, best = at[keep], own[keep], best[keep]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(own) != 0) | (np.diff(best) != 0)))) if len(at) else np.empty(0, np.int64)
        count, entry, start, best = np.diff(new, append=len(at)), own[new], at[new] - begins[own[new]], best[new]
        bounds, rows = np.searchsorted(entry, np.arange(len(sizes) + 1)), []
        for lot, shard, base, mine in lots:
            n = np.diff(bounds)[mine]
            pick = np.repeat(bounds[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            runs = np.column_stack((np.repeat(np.arange(len(mine)) + base, n), start[pick], count[pick])).astype(np.int32)
            if len(runs):
                rows.append((lot, 3, shard, runs.tobytes(), best[pick].astype(np.int64).tobytes(), None))
        give_back()
        return packed(rows, FIELDS)

    return rows.where("kind = 1").repartition(shards, "shard").groupBy("shard").applyInArrow(run, NOTE)


def rest_of(texts: DataFrame, notes: DataFrame, length: int, columns: dict[str, Column]) -> DataFrame:
    """(_sum, columns) of each text, from (spans, kept): what goes, and the bytes that stay."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"_sum": pa.array([], pa.binary()), "spans": pa.array([], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), "kept": pa.array([], pa.binary())})
        lot = Lot(table)
        kinds = np.array(told.column("kind").to_pylist(), int)
        places, runs = told.filter(pa.array(kinds == 2)), told.filter(pa.array(kinds == 3))
        entry, first = joined(places, "a", "<i4"), joined(places, "b", "<i8")
        told_runs, best = joined(runs, "a", "<i4").reshape(-1, 3).astype(np.int64), joined(runs, "b", "<i8")
        order = np.argsort(told_runs[:, 0], kind="stable")
        told_runs, best = told_runs[order], best[order]
        a, b = np.searchsorted(told_runs[:, 0], entry), np.searchsorted(told_runs[:, 0], entry, "right")
        n = b - a
        pick = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        start = np.repeat(first, n)
        ids = lot.ids[np.searchsorted(lot.ends, start, "right")]
        hit = best[pick] < ids
        begin = start[hit] + told_runs[pick[hit], 1]
        end = begin + told_runs[pick[hit], 2] + length - 1
        change = np.zeros(len(lot.data) + 1, np.int32)
        np.add.at(change, begin, 1)
        np.add.at(change, end, -1)
        gone = np.cumsum(change[:-1]) > 0
        spans, kept = [], []
        for a, b in zip(lot.begins.tolist(), lot.ends.tolist()):
            edge = np.flatnonzero(np.diff(gone[a:b], prepend=False, append=False))
            spans.append([{"first": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
            kept.append(lot.data[a:b][~gone[a:b]].tobytes() if len(edge) else lot.bytes[a:b])
        give_back()
        return pa.table({"_sum": lot.sums.cast(pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    found = texts.groupBy("lot").cogroup(notes.groupBy("lot")).applyInArrow(run, f"_sum binary, spans {SPANS}, kept binary")
    return found.select("_sum", *[c.alias(name) for name, c in columns.items()])


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, columns: dict[str, Column] | None = None, lot: int | None = None, memory: int = MEMORY) -> DataFrame:
    """Per row: key, n_bytes and columns, which are made of spans (what goes: first byte and end of each run, from 0) and kept (the bytes that stay)."""
    if length <= 3 * GRAM:
        raise ValueError(f"strings of more than {3 * GRAM} bytes are told by their prints")
    spark, kind = df.sparkSession, df.schema[key].dataType
    columns = columns or {"spans": F.col("spans"), "kept": F.col("kept")}
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    own = df.select(F.col(key).alias("_key"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    facts = cut(own.select("_key", "_id", F.octet_length("_text").cast("long").alias("n_bytes"), F.unhex(F.sha2("_text", 256)).alias("_sum")), "facts")
    total, size = facts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    lots = max(1, -(-size // (lot or LOT)))
    lots = lots if lots <= FEW_LOTS or lot else max(FEW_LOTS, -(-size // LARGE_LOT))
    buckets = shards = min(lots, BUCKETS)
    folder = scratch_path(spark, "tuples")
    name = "loomline_" + folder.rpartition("-")[2]
    texts = texts_in_lots(docs, facts, lots, name)
    heard = shared(prints_of(texts, length, buckets), buckets)
    rows = cut(sent(texts, heard, length, buckets, shards), "windows")
    notes = rows.where("kind = 2").unionByName(repeated(rows, length, shards, folder, memory))
    results = cut(rest_of(texts, notes, length, columns), "rest")
    with suppress(Exception):  # the catalogue's entry only; its files go with the other scratch tables
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    groups = facts.groupBy("_sum").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    known = lookup(facts, results.join(groups, "_sum"), "_sum", "_n", total)
    gone = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("end")))
    copies = known.where(f"_id > _first and n_bytes >= {length}").select("_key", "n_bytes", gone.cast(SPANS).alias("spans"), F.lit(b"").alias("kept")).select("_key", "n_bytes", *[c.alias(n) for n, c in columns.items()])
    others = known.where(f"not (_id > _first and n_bytes >= {length})").select("_key", "n_bytes", *columns)
    return others.unionByName(copies).select(F.col("_key").cast(kind).alias(key), "n_bytes", *columns)
