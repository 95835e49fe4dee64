"""Byte-level BPE: encoding by cached pair merging over vectorised pre-tokens, and decoding.

encode() and decode() are general operators; each text keeps its ids and, on request, the byte offset at which each id's
bytes start in the text; decoding puts each id's bytes at its offset, and a range of bytes is decoded from the ids that
touch it alone. A null text counts as empty and has no ids; very long texts are encoded in pieces that end between
pre-tokens; an empty table gives an empty one; repeated rows and ties need no care, as rows don't meet; further columns
pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomline.llm import pretok
from loomline.llm.common import in_lots, strings

#: Distinct pre-tokens a worker keeps before it starts afresh; bounds its memory.
CACHE = 500_000
SLOT_BITS = 20
SHORT = 15
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id << 32 | right id) to the merged id, for each way a token splits in two tokens."""
    found = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                found[a << 32 | b] = rank
    return found


def merger(ranks: dict[bytes, int], pairs: dict[int, int], whole: bool = True) -> Callable[[bytes], list[int]]:
    """Ids of a pre-token: as long as neighbours form a token, the pair of lowest rank merges, leftmost first.

    whole: a pre-token that is a token itself gets its id, whether or not merges lead there.
    """
    single = [ranks[bytes([i])] for i in range(256)]
    none = 1 << 60

    def merge(piece: bytes) -> list[int]:
        if whole and piece in ranks:
            return [ranks[piece]]
        ids = [single[b] for b in piece]
        get = pairs.get
        best = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while best and (low := min(best)) != none:
            i = best.index(low)
            ids[i : i + 2] = [low]
            del best[i]
            if i:
                best[i - 1] = get(ids[i - 1] << 32 | low, none)
            if i < len(best):
                best[i] = get(low << 32 | ids[i + 1], none)
        return ids

    def long_merge(piece: bytes) -> list[int]:
        """The same by a heap over linked neighbours, for runs of one kind that go on for pages."""
        import heapq

        if whole and piece in ranks:
            return [ranks[piece]]
        n, ids = len(piece), [single[b] for b in piece]
        after, before, get = list(range(1, n + 1)), list(range(-1, n - 1)), pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (x := get(r << 32 | ids[after[j]])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[j]]))
            if (h := before[i]) >= 0 and (x := get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return [x for x in ids if x >= 0]

    return lambda piece: merge(piece) if len(piece) < 200 else long_merge(piece)


def keys(data: bytes, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words that hold a pre-token of SHORT bytes at most, its length in the highest byte: equal only if it is."""
    padded = data + b"\0" * 16
    words = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    low = words[at] & _MASK[np.minimum(length, 8)]
    high = words[np.minimum(at + 8, len(data))] & _MASK[np.clip(length - 8, 0, 7)]
    return low, high | (length.astype(np.uint64) << np.uint64(56))


class Slots:
    """An open-addressing table from keys() to small numbers, looked up for whole arrays."""

    PROBES = 12

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.value = np.full(1 << bits, -1, np.int32)

    def home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * _K1 ^ high * _K2
        h ^= h >> np.uint64(29)
        return ((h * _K3) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Values, -1 for what isn't there."""
        slot, last = self.home(low, high), (1 << self.bits) - 1
        value = self.value[slot]
        other = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high))
        value_out = value
        open_ = other[value[other] >= 0]
        value_out[other] = -1
        for _ in range(self.PROBES):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & last
            s = slot[open_]
            hit = (self.low[s] == low[open_]) & (self.high[s] == high[open_])
            value_out[open_[hit]] = self.value[s[hit]]
            open_ = open_[~hit & (self.value[s] >= 0)]
        return value_out

    def put(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        """Adds keys that aren't there; the few that find no slot stay out, which a cache can do with: see of() for a table."""
        slot, last = self.home(low, high), (1 << self.bits) - 1
        left = np.arange(len(low))
        for _ in range(self.PROBES):
            free = left[self.value[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            s = slot[won]
            self.low[s], self.high[s], self.value[s] = low[won], high[won], value[won]
            placed = np.zeros(len(low), bool)
            placed[won] = True
            left = left[~placed[left]]
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & last
        self.out = len(left)

    @classmethod
    def of(cls, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> Slots:
        """A table of all these distinct keys, as large as it takes."""
        for bits in range(max(8, (4 * len(low)).bit_length()), 31):
            made = cls(bits)
            made.put(low, high, value)
            if not made.out:
                return made
        raise ValueError("keys repeat")


class Merger:
    """Merges many short pre-tokens at once: a row each, the pair of lowest rank of every row in each round."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int], pairs: dict[int, int], whole: bool) -> None:
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = Slots.of(np.fromiter(pairs, np.uint64, len(pairs)), np.ones(len(pairs), np.uint64), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.tokens = None
        if whole:
            short = [t for t in ranks if len(t) <= SHORT]
            length = np.fromiter(map(len, short), np.int64, len(short))
            low, high = keys(b"".join(short), np.cumsum(length) - length, length)
            self.tokens = Slots.of(low, high, np.fromiter((ranks[t] for t in short), np.int32, len(short)))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.pairs.get(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64), np.ones(left.shape, np.uint64))
        found[found < 0] = self.NONE
        return found

    def merge(self, data: bytes, at: np.ndarray, length: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each pre-token has."""
        wide = np.arange(SHORT)
        octets = np.frombuffer(data + b"\0" * SHORT, np.uint8)
        out, left = self.single[octets[at[:, None] + wide]], length.copy()
        rows = np.flatnonzero(length > 1)
        if self.tokens is not None:
            whole = self.tokens.get(low, high)
            known = whole >= 0
            out[known, 0], left[known] = whole[known], 1
            rows = rows[~known[rows]]
        ids, size = out[rows], length[rows]
        inside = wide[1:] < size[:, None]
        ranks = np.full((len(rows), SHORT), self.NONE)
        ranks[:, :-1][inside] = self.rank(ids[:, :-1][inside], ids[:, 1:][inside])
        while len(rows):
            pos = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), pos]
            over = best == self.NONE
            if over.any():
                out[rows[over]], left[rows[over]] = ids[over], size[over]
                go = ~over
                rows, ids, size, ranks, pos, best = rows[go], ids[go], size[go], ranks[go], pos[go], best[go]
                if not len(rows):
                    break
            line = np.arange(len(rows))
            ids[line, pos] = best
            ids = np.take_along_axis(ids, np.minimum(wide + (wide > pos[:, None]), SHORT - 1), 1)
            ranks = np.take_along_axis(ranks, np.minimum(wide + (wide >= pos[:, None]), SHORT - 1), 1)
            ranks[:, -1] = self.NONE
            size = size - 1
            for there in (pos - 1, pos):
                ok = np.flatnonzero((there >= 0) & (there < size - 1))
                ranks[ok, there[ok]] = self.rank(ids[ok, there[ok]], ids[ok, there[ok] + 1])
            end = pos >= size - 1
            ranks[line[end], pos[end]] = self.NONE
        return out[wide < left[:, None]], left


class Encoder:
    """Ids of pre-tokens, merged once per worker and distinct pre-token."""

    def __init__(self, ranks: dict[bytes, int], pairs: dict[int, int], whole: bool = True) -> None:
        self.one, self.many = merger(ranks, pairs, whole), Merger(ranks, pairs, whole)
        self.fresh()

    def fresh(self) -> None:
        self.slots, self.rest = Slots(SLOT_BITS), {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.first, self.count = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.used = self.entries = 0

    def add(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Keeps the ids of some pre-tokens; the numbers under which they are found."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids) + len(ids))
        if self.entries + len(count) > len(self.first):
            self.first, self.count = (np.resize(x, 2 * len(self.first) + len(count)) for x in (self.first, self.count))
        e = np.arange(self.entries, self.entries + len(count))
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[e], self.count[e] = self.used + np.cumsum(count) - count, count
        self.used += len(ids)
        self.entries += len(count)
        return e

    def entry(self, data: bytes, at: np.ndarray, length: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """The number under which each pre-token's ids are kept."""
        if self.entries > CACHE:
            self.fresh()
        if low is None:
            low, high = keys(data, at, length)
        short = length <= SHORT
        out = self.slots.get(low, high).astype(np.int64)
        out[~short] = -1
        if len(miss := np.flatnonzero((out < 0) & short)):
            order = miss[np.lexsort((low[miss], high[miss]))]
            new = np.ones(len(order), bool)
            new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            one = order[new]
            e = self.add(*self.many.merge(data, at[one], length[one], low[one], high[one]))
            self.slots.put(low[one], high[one], e.astype(np.int32))
            out[order] = e[np.cumsum(new) - 1]
        for i in np.flatnonzero(~short).tolist():
            piece = data[at[i] : at[i] + length[i]]
            if (e := self.rest.get(piece)) is None:
                ids = self.one(piece)
                e = int(self.add(np.array(ids, np.uint32), np.array([len(ids)]))[0])
                if len(piece) < 1000:
                    self.rest[piece] = e
            out[i] = e
        return out

    def encode(self, data: bytes, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each pre-token has."""
        e = self.entry(data, at, length)
        first, count = self.first[e], self.count[e]
        return gather(self.ids, first, count), count


def gather(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[first[i] : first[i] + count[i]] of all i, one after another."""
    total = np.cumsum(count)
    if not len(total):
        return values[:0]
    return values[np.arange(total[-1]) + np.repeat(first - total + count, count)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    ranks = read_ranks(path)
    return Encoder(ranks, pair_table(ranks))


@lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens, where each id's start, and how many they are; an id that isn't there has none."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    count = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(count) - count, count


def encode_texts(path: str, packed: bytes, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, ids) of texts, in order; a long text comes in several parts."""
    table, e = pretok.class_table(packed), encoder(path)
    for some in pretok.pieces(texts):
        data, at, length, tokens = pretok.split(table, [t for _, t in some])
        ids, count = e.encode(data, at, length)
        ends = np.concatenate(([0], np.cumsum(count)))[np.cumsum(tokens)]
        start = 0
        for (i, _), end in zip(some, ends.tolist()):
            yield i, ids[start:end]
            start = end


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", packed: bool = False, offsets: str | None = None) -> DataFrame:
    """Adds the ids of each text by the rank file at path, as array<int> or packed as little-endian unsigned 32-bit words.

    offsets names a further column: the byte at which each id starts in the text, in the same form as the ids. A column of
    df that has the name of a new one gives way to it.
    """
    new = [out] + [offsets] * (offsets is not None)
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, kind) for c in new])
    table = pretok.classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_lots(batches, text):
            texts, parts = strings(batch, text), {}
            done = 0
            for i, ids in encode_texts(path, table, texts):
                parts.setdefault(i, []).append(ids)
                if i - done >= 2048:
                    yield emit(batch, done, i, parts)
                    done = i
            yield emit(batch, done, len(texts), parts)

    def emit(batch: pa.RecordBatch, start: int, end: int, parts: dict) -> pa.RecordBatch:
        rows = [np.concatenate(parts.pop(i)).astype("<u4") for i in range(start, end)]
        columns = [rows]
        if offsets is not None:
            size = token_bytes(path)[2]
            columns.append([(np.cumsum(size[r]) - size[r]).astype("<u4") for r in rows])
        made = [pa.array([r.tobytes() for r in c], pa.binary()) if packed else pa.array([r.astype(np.int32) for r in c], pa.list_(pa.int32())) for c in columns]
        part = batch.slice(start, end - start)
        return pa.RecordBatch.from_arrays([part.column(c) for c in kept] + made, names=kept + new)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", offsets: str | None = None, span: tuple[int, int] | None = None) -> DataFrame:
    """Adds the bytes that ids stand for, as binary; null ids count as none, an id that isn't in the file has no bytes.

    offsets names the column of offsets that encode() has kept: each id's bytes are then put where its offset says, and
    with span (first byte, past the last) only ids that touch these bytes are decoded, for those bytes of the text.
    Without offsets ids follow each other.
    """
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.BinaryType())])
    numbers = lambda c, row: np.frombuffer(row or b"", "<u4").astype(np.int64) if isinstance(c, T.BinaryType) else np.array(row or [], np.int64)
    kind, at_kind = df.schema[ids].dataType, df.schema[offsets].dataType if offsets else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, first, count = token_bytes(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                made = []
                rows = part.column(ids).to_pylist()
                for row, at in zip(rows, part.column(offsets).to_pylist() if offsets else [None] * len(rows)):
                    own = numbers(kind, row)
                    ok = (own < len(count)) & (own >= 0)
                    if offsets:
                        made.append(put(data, first, count, own[ok], numbers(at_kind, at)[ok], span))
                    else:
                        made.append(gather(data, first[own[ok]], count[own[ok]]).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(made, pa.binary())], names=kept + [out])

    return df.mapInArrow(run, schema)


def put(data: np.ndarray, first: np.ndarray, count: np.ndarray, ids: np.ndarray, at: np.ndarray, span: tuple[int, int] | None) -> bytes:
    """The bytes of ids, each at its offset; of a span, if there is one."""
    if span:
        low, high = np.searchsorted(at + count[ids], span[0], "right"), np.searchsorted(at, span[1], "left")
        ids, at = ids[low:high], at[low:high]
    if not len(ids):
        return b""
    size, base = count[ids], int(at[0])
    whole = np.zeros(int(at[-1] + size[-1]) - base, np.uint8)
    ends = np.cumsum(size)
    whole[np.arange(ends[-1]) + np.repeat(at - base - ends + size, size)] = gather(data, first[ids], size)
    return whole[max(0, span[0] - base) : span[1] - base].tobytes() if span else whole.tobytes()
