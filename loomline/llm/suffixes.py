"""Suffix and common-prefix arrays of one shard by external induced sorting.

The suffixes that begin a rise (each smaller than both neighbours) are sorted first: their substrings by induction, and their
order by sorting the string of these substrings' names, recursively, in memory once it has BASE symbols at most. From
them all falling suffixes are induced in ascending order, and from those all rising ones in descending order.

Induction goes through a monotone priority queue over symbols. A tuple of a suffix is pushed when its successor is popped, so
tuples of one symbol come in their order and a symbol's part of the queue is a file to append to. Tuples carry the common
prefix with the tuple before them, which is the least of those popped in between, plus one. Common prefixes of the seeds are
compared up to the wanted length, and that of a symbol's last falling and first rising suffix is the shorter run.

Strings, the places of their seeds and a page of the queue are in memory; tuples and results, which are the larger part by
far, are arrays that go to the folder given, in files read once and in order, when all held ones exceed the memory given. Pages
of the queue are one symbol of many tuples, or several symbols of few; within the latter, symbols are popped together up to the
first that gets another tuple.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow.fs as pafs

#: Symbols of a string that is sorted in memory; tuples of a page of several symbols; tuples handed on at once; symbols that all have pages of their own.
BASE, PAGE, STEP, FEW = 1 << 21, 1 << 16, 1 << 20, 512


class Disk:
    """Arrays that are held in memory up to a limit and in files beyond."""

    def __init__(self, folder: str | None, limit: int) -> None:
        self.limit, self.held, self.spools, self.written = limit, 0, set(), 0
        self.fs, self.root = pafs.FileSystem.from_uri(folder) if folder else (None, None)

    def spool(self) -> Spool:
        return Spool(self)

    def room(self, size: int) -> None:
        self.held += size
        if self.fs and self.held > self.limit:
            for spool in sorted(self.spools, key=lambda s: -s.held):
                if self.held <= self.limit // 2:
                    break
                spool.write()

    def close(self) -> None:
        for spool in list(self.spools):
            spool.drop()


class Spool:
    """A queue of tuples, kept by columns."""

    def __init__(self, disk: Disk) -> None:
        self.disk, self.parts, self.held, self.rows = disk, [], 0, 0
        disk.spools.add(self)

    def push(self, *columns: np.ndarray) -> None:
        if n := len(columns[0]):
            size = sum(c.nbytes for c in columns)
            self.parts.append(columns)
            self.rows += n
            self.held += size
            self.disk.room(size)

    def write(self) -> None:
        """Moves what is in memory to one file, which holds the rows in order after those of earlier files."""
        fresh = [p for p in self.parts if isinstance(p, tuple)]
        if not fresh:
            return
        columns = [np.concatenate(c) for c in zip(*fresh)]
        self.disk.fs.create_dir(self.disk.root, recursive=True)
        path = f"{self.disk.root}/{uuid.uuid4().hex}"
        with self.disk.fs.open_output_stream(path, compression=None) as out:
            for at in range(0, len(columns[0]), STEP):
                for c in columns:
                    out.write(np.ascontiguousarray(c[at : at + STEP]).data)
        self.parts = [p for p in self.parts if isinstance(p, Stored)] + [Stored(path, len(columns[0]), [c.dtype for c in columns])]
        self.disk.held -= self.held
        self.disk.written += self.held
        self.held = 0

    def read(self, back: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """The tuples in order, or from the last to the first, by parts of about STEP."""
        held, rows = [], 0
        for part in reversed(self.parts) if back else self.parts:
            for columns in part.read(self.disk.fs, back) if isinstance(part, Stored) else [part]:
                held.append(tuple(c[::-1] for c in columns) if back else columns)
                rows += len(columns[0])
                if rows >= STEP:
                    yield tuple(np.concatenate(c) for c in zip(*held))
                    held, rows = [], 0
        if held:
            yield tuple(np.concatenate(c) for c in zip(*held))

    def drop(self) -> None:
        for part in self.parts:
            if isinstance(part, Stored):
                self.disk.fs.delete_file(part.path)
        self.disk.held -= self.held
        self.parts, self.held = [], 0
        self.disk.spools.discard(self)


class Stored:
    def __init__(self, path: str, rows: int, kinds: list[np.dtype]) -> None:
        self.path, self.rows, self.kinds = path, rows, kinds

    def read(self, fs: pafs.FileSystem, back: bool) -> Iterator[tuple[np.ndarray, ...]]:
        width = sum(k.itemsize for k in self.kinds)
        starts = list(range(0, self.rows, STEP))
        with fs.open_input_file(self.path) as file:
            for at in reversed(starts) if back else starts:
                n, place, out = min(STEP, self.rows - at), at * width, []
                for k in self.kinds:
                    out.append(np.frombuffer(file.read_at(n * k.itemsize, place), k))
                    place += n * k.itemsize
                yield tuple(out)


def stable(keys: np.ndarray, most: int) -> np.ndarray:
    """Stable order of small integers; those of 16 bits are sorted by radix."""
    return np.argsort(keys.astype(np.uint16) if most < 1 << 16 else keys, kind="stable")


def least_of(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last], ends included, for each pair; first <= last."""
    rows = [values]
    while 2 << (len(rows) - 1) <= len(values):
        half = 1 << (len(rows) - 1)
        rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
    power = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    for p in np.unique(power).tolist():
        at = np.flatnonzero(power == p)
        out[at] = np.minimum(rows[p][first[at]], rows[p][last[at] - (1 << p) + 1])
    return out


def run_of(string: np.ndarray, at: int, most: int) -> int:
    own = string[at : at + most]
    other = np.flatnonzero(own != own[0])
    return int(other[0]) if len(other) else len(own)


class Seeds:
    """Seeds in the order of the pass, given out symbol by symbol."""

    def __init__(self, parts: Iterator[tuple[np.ndarray, ...]], symbols: object) -> None:
        self.parts, self.symbols, self.held = parts, symbols, None

    def upto(self, bound: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(symbols, places, common prefixes) of the next seeds with symbols below bound."""
        while True:
            if self.held is None:
                part = next(self.parts, None)
                if part is None:
                    return
                self.held = (self.symbols(part[0]), *part)
            n = int(np.searchsorted(self.held[0], np.asarray(bound, self.held[0].dtype)))  # of its own kind, else all are converted
            if n:
                yield tuple(c[:n] for c in self.held)
            if n < len(self.held[0]):
                self.held = tuple(c[n:] for c in self.held)
                return
            self.held = None


class Pass:
    """One induction. flip turns the order of symbols round, for rising suffixes. sizes: how many tuples each symbol will have at most."""

    def __init__(self, string: np.ndarray, symbols: int, flip: bool, sizes: np.ndarray, disk: Disk, most: int) -> None:
        self.string, self.flip, self.count, self.disk, self.most = string, flip, symbols, disk, most
        self.out = disk.spool()
        sizes = sizes[::-1] if flip else sizes
        many, share = sizes > PAGE, (np.cumsum(sizes) - sizes) // PAGE
        begins = np.concatenate(([True], many[1:] | many[:-1] | (share[1:] != share[:-1]) | (symbols <= FEW)))
        self.page, self.starts = np.cumsum(begins) - 1, np.append(np.flatnonzero(begins), symbols)
        self.queue = [disk.spool() for _ in range(len(self.starts) - 1)]
        if most:
            self.since, self.met = np.full(symbols, most, np.uint8), np.zeros(symbols, bool)

    def of(self, places: np.ndarray) -> np.ndarray:
        own = self.string[places].astype(np.int32)
        return self.count - 1 - own if self.flip else own

    def pop(self, symbols: np.ndarray, places: np.ndarray, shared: np.ndarray | None, seeds: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """The tuples that come of these, which were popped in this order: (symbols, places, common prefixes)."""
        before = places - 1
        own = self.of(np.maximum(before, 0))
        hit = np.flatnonzero((before >= 0) & ((own > symbols) if seeds else (own >= symbols)))
        own, made = own[hit], before[hit]
        if not self.most:
            return own, made, None
        order = stable(own, self.count)
        group, at = own[order], hit[order]
        first = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.empty(0, bool)
        lead = np.flatnonzero(first)
        low = least_of(shared, np.where(first, 0, np.concatenate(([0], at[:-1])) + 1), at) if len(at) else np.empty(0, np.uint8)
        low[lead] = np.minimum(low[lead], self.since[group[lead]])
        low = np.minimum(low, self.most - 1) + 1
        low[lead[~self.met[group[lead]]]] = 0
        np.minimum(self.since, shared.min(), out=self.since)
        if len(at):
            ends = np.concatenate((lead[1:], [len(group)])) - 1
            tail, final = at[ends] + 1, np.full(len(ends), self.most, np.uint8)
            rest = np.flatnonzero(tail < len(shared))
            final[rest] = least_of(shared, tail[rest], np.full(len(rest), len(shared) - 1))
            self.since[group[ends]], self.met[group[ends]] = final, True
        out = np.empty(len(own), np.uint8)
        out[order] = low
        return own, made, out

    def push(self, own: np.ndarray, made: np.ndarray, shared: np.ndarray | None) -> None:
        page = self.page[own]
        order = stable(page, len(self.queue))
        ends = np.flatnonzero(np.diff(page[order], append=-1)) + 1
        start = 0
        for end in ends.tolist():
            at = order[start:end]
            self.queue[page[at[0]]].push(own[at], made[at], *([shared[at]] if self.most else []))
            start = end

    def alone(self, symbol: int, parts: Iterator[tuple[np.ndarray, ...]], seeds: Seeds, push: Callable[..., None]) -> None:
        """Pops all tuples of one symbol, also those that come of its own, then its seeds."""
        last = None
        while True:
            wave = self.disk.spool()
            for _, places, *shared in parts:
                last = int(places[-1])
                self.out.push(places, *shared)
                got = self.pop(np.full(len(places), symbol), places, shared[0] if self.most else None, False)
                same = got[0] == symbol
                wave.push(*[c[same] for c in got if c is not None])
                push(*[None if c is None else c[~same] for c in got])
            if not wave.rows:
                wave.drop()
                break
            parts = self.once(wave)
        for symbols, places, *shared in seeds.upto(symbol + 1):
            if self.most and last is not None:
                shared[0] = shared[0].copy()
                shared[0][0] = min(run_of(self.string, last, self.most), run_of(self.string, int(places[0]), self.most))
                last = None
            push(*self.pop(symbols, places, shared[0] if self.most else None, True))

    @staticmethod
    def once(spool: Spool) -> Iterator[tuple[np.ndarray, ...]]:
        yield from spool.read()
        spool.drop()

    def run(self, parts: Iterator[tuple[np.ndarray, ...]]) -> Spool:
        seeds = Seeds(parts, self.of)
        for page, spool in enumerate(self.queue):
            low, high = int(self.starts[page]), int(self.starts[page + 1])
            if high - low == 1:
                self.alone(low, self.once(spool), seeds, self.push)
            else:
                self.several(low, high, spool, seeds)
        return self.out

    def several(self, low: int, high: int, spool: Spool, seeds: Seeds) -> None:
        """Pops the symbols of a page. As many as have about the root of all tuples go together, if none of them gets a tuple of another."""
        held = [np.concatenate(c) for c in zip(*self.once(spool))] or [np.empty(0, np.int64)] * 2 + [np.empty(0, np.uint8)] * bool(self.most)
        own = [np.concatenate(c) for c in zip(*seeds.upto(high))] or [np.empty(0, np.int64)] * 2 + [np.empty(0, np.uint8)] * bool(self.most)
        order = stable(held[0], self.count)
        held = [c[order] for c in held]
        wide = max(1, int(len(self.string) ** 0.5))
        while len(held[0]) or len(own[0]):
            first = min(c[0][0] for c in (held, own) if len(c[0]))
            ends = [c[0][wide] for c in (held, own) if len(c[0]) > wide]
            bound = max(first + 1, min([*ends, high]))
            cuts, lead = tuple(np.searchsorted(c[0], np.asarray(bound, c[0].dtype)) for c in (held, own)), None
            if bound > first + 1 and not self.most:
                symbols = np.concatenate((held[0][: cuts[0]], own[0][: cuts[1]]))
                order = stable(symbols, self.count)
                symbols, places, seeded = symbols[order], np.concatenate((held[1][: cuts[0]], own[1][: cuts[1]]))[order], order >= cuts[0]
                before = self.of(np.maximum(places - 1, 0))
                hit = (places > 0) & np.where(seeded, before > symbols, before >= symbols)
                lead = min(bound, int(before[hit].min())) if hit.any() else bound
            if lead is not None and lead > first:
                n = np.searchsorted(symbols, lead)
                self.out.push(places[:n][~seeded[:n]])
                made, at = before[:n][hit[:n]], places[:n][hit[:n]] - 1
                cuts = np.searchsorted(held[0], lead), np.searchsorted(own[0], lead)
                held, own = [c[cuts[0] :] for c in held], [c[cuts[1] :] for c in own]
                inside = made < high
                self.push(made[~inside], at[~inside], None)
                held = self.added(held, made[inside], at[inside], None)
            else:
                cuts = np.searchsorted(held[0], first + 1), np.searchsorted(own[0], first + 1)
                page, inner = [c[: cuts[0]] for c in held], Seeds(iter([[c[: cuts[1]] for c in own[1:]]] if cuts[1] else []), self.of)
                held, own = [c[cuts[0] :] for c in held], [c[cuts[1] :] for c in own]
                got = []
                self.alone(int(first), iter([page] if len(page[0]) else []), inner, lambda *c, got=got: got.append(c))
                for made, at, shared in got:
                    inside = made < high
                    self.push(made[~inside], at[~inside], shared[~inside] if self.most else None)
                    held = self.added(held, made[inside], at[inside], shared[inside] if self.most else None)

    @staticmethod
    def added(held: list[np.ndarray], symbols: np.ndarray, places: np.ndarray, shared: np.ndarray | None) -> list[np.ndarray]:
        """held, sorted by symbols, with further tuples, each after those of its symbol."""
        if not len(symbols):
            return held
        order = np.argsort(symbols, kind="stable")
        at = np.searchsorted(held[0], symbols[order], "right")
        return [np.insert(c, at, x[order]) for c, x in zip(held, (symbols, places, shared)) if x is not None]


def rises(string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix whether it is smaller than the next, and the places of those that begin a rise."""
    n = len(string)
    differs = np.flatnonzero(string[:-1] != string[1:])
    up = string[differs] < string[differs + 1]
    rising = np.ones(n, bool)
    rising[: n - 1] = np.repeat(up, np.diff(differs, prepend=-1))
    return rising, (np.flatnonzero(rising[1:] & ~rising[:-1]) + 1).astype(np.int32 if n < 1 << 31 else np.int64)


def parts_of(*columns: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    for at in range(0, len(columns[0]), STEP):
        yield tuple(c[at : at + STEP] for c in columns)


def turned(spool: Spool) -> Iterator[tuple[np.ndarray, ...]]:
    """The tuples from last to first, each with the prefix it shares with the one before it in this order."""
    carry = np.zeros(1, np.uint8)
    for places, *shared in spool.read(back=True):
        if shared:
            shared = [np.concatenate((carry, shared[0][:-1]))], shared[0][-1:]
            carry, shared = shared[1], shared[0]
        yield places, *shared


def common(string: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """The prefix that each suffix shares with the one before it in places, up to most symbols."""
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate((string, np.zeros(most + 8, string.dtype))), 8)
    out = np.zeros(len(places), np.uint8)
    for start in range(1, len(places), STEP):
        own = np.arange(start, min(start + STEP, len(places)))
        for at in range(0, most, 8):
            same = wide[places[own] + at] == wide[places[own - 1] + at]
            whole = same.all(1)
            out[own] = np.minimum(most, at + np.where(whole, 8, np.argmin(same, 1)))
            own = own[whole]
            if not len(own):
                break
    return out


def sorted_in_memory(string: np.ndarray) -> np.ndarray:
    """Suffixes by doubling: only those not told apart yet are sorted again, by the rank of what follows."""
    n, width = len(string), 1
    order = np.argsort(string, kind="stable")
    new = np.concatenate(([True], string[order][1:] != string[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    tied = order[~(new & np.append(new[1:], True))]
    while len(tied):
        behind = tied + width
        key = rank[tied] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        groups = np.concatenate(([True], key[1:] // (n + 1) != key[:-1] // (n + 1)))
        starts = np.flatnonzero(groups)[np.cumsum(groups) - 1]  # of the group that was tied
        fresh = rank[tied] + np.flatnonzero(new)[np.cumsum(new) - 1] - starts
        rank[tied] = fresh
        tied, width = tied[~(new & np.append(new[1:], True))], width * 2
    order[rank] = np.arange(n)
    return order


def induced(string: np.ndarray, symbols: int, rising: np.ndarray, seeds: Iterator[tuple[np.ndarray, ...]], disk: Disk, most: int) -> tuple[Spool, Spool]:
    """All falling suffixes in order, and all rising ones in descending order, from seeds in order."""
    falling = Pass(string, symbols, False, np.bincount(string[~rising], minlength=symbols), disk, most).run(seeds)
    return falling, Pass(string, symbols, True, np.bincount(string[rising], minlength=symbols), disk, most).run(turned(falling))


def seeds_in_order(string: np.ndarray, symbols: int, rising: np.ndarray, places: np.ndarray, disk: Disk) -> np.ndarray:
    """The suffixes that begin a rise, in order: by names of their substrings, which one induction sorts."""
    falling, upward = induced(string, symbols, rising, parts_of(places[stable(string[places], symbols)]), disk, 0)
    falling.drop()
    begins = np.zeros(len(string), bool)
    begins[places] = True
    found = np.concatenate([places[-1:], *[own[begins[own]] for (own,) in upward.read(back=True)]])
    upward.drop()
    number = np.searchsorted(places, found)
    length = np.append(np.diff(places), 0)[number]
    same = np.zeros(len(found), bool)
    left = np.flatnonzero(length[1:] == length[:-1]) + 1
    at = 0
    while len(left):
        left = left[string[found[left] + at] == string[found[left - 1] + at]]
        done = length[left] == at
        same[left[done]] = True
        left, at = left[~done], at + 1
    names = np.cumsum(~same) - 1
    if names[-1] + 1 == len(found):
        return found
    reduced = np.empty(len(found), np.int32 if len(found) < 1 << 31 else np.int64)
    reduced[number] = names
    if len(reduced) <= BASE:
        return places[sorted_in_memory(reduced)]
    return places[np.concatenate([own for own, *_ in suffixes(reduced, int(names[-1]) + 1, disk)])]


def suffixes(string: np.ndarray, symbols: int, disk: Disk, most: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """Places of the suffixes in order, by parts, and with most (to 255) how much each shares with the one before, up to that.

    The last symbol is 0 and no other is.
    """
    yield (np.array([len(string) - 1], np.int32 if len(string) < 1 << 31 else np.int64), *([np.zeros(1, np.uint8)] if most else []))
    if len(string) == 1:
        return
    rising, places = rises(string)
    order = seeds_in_order(string, symbols, rising, places, disk)
    falling, upward = induced(string, symbols, rising, parts_of(order, *([common(string, order, most)] if most else [])), disk, most)
    del order
    readers = [Seeds(parts, lambda at: string[at].astype(np.int32)) for parts in (falling.read(), turned(upward))]
    sizes = np.cumsum(np.bincount(string, minlength=symbols))
    low = 0
    while low < symbols:
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + STEP, "right")))
        both = [[np.concatenate(c) for c in zip(*r.upto(high))] for r in readers]
        both = [b or [np.empty(0, np.int64)] * 2 + [np.empty(0, np.uint8)] * bool(most) for b in both]
        symbol, own, *shared = (np.concatenate(c) for c in zip(*both))
        upper = np.arange(len(symbol)) >= len(both[0][0])
        by = stable(symbol, symbols)
        symbol, own, upper, shared = symbol[by], own[by], upper[by], [c[by] for c in shared]
        if most:
            for k in (np.flatnonzero((symbol[1:] == symbol[:-1]) & upper[1:] & ~upper[:-1]) + 1).tolist():
                shared[0][k] = min(run_of(string, int(own[k - 1]), most), run_of(string, int(own[k]), most))
        if len(own):
            yield own, *shared
        low = high
    falling.drop()
    upward.drop()
