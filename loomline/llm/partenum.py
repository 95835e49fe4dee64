"""N-gram Jaccard join by PartEnum signatures.

Sets of a size band and the next share a bound on the number of elements in which two similar sets can differ. The
domain of elements is dealt into first-level partitions, so many that similar sets differ by few elements in at least
one, and each of these into second-level ones; every choice of all but those few second-level partitions is a signature.
So similar sets share a signature, and sets that share none need no look. Signatures with too few elements are passed
over: each set may do so in SPARE first-level partitions, for which there are twice as many more.

A task sends one of the equal sets that it remembers; the others are linked to it. Sets that share a signature form a group; equal groups
of up to SAME sets are looked at once. Within a group sets meet as parity sketches: a bit per bucket of elements tells
whether an odd number falls there, so sketches differ in no more bits than sets in elements, and the size bound and the
sketch rule out what can't be similar without losing a link. What is left makes clusters, which hold next to nothing but
near copies; these are verified by set intersection, in blocks of at most UNIT documents. Where a group has more than
WIDE sets or a cluster more than UNIT, every block first meets the first block; documents that then are not in the
largest component meet all blocks, and those in it are linked already. So no link between two texts is lost, no pairs
are emitted, and the outcome is that of comparing all pairs. Only a group of more than WIDE sets that share a signature
by a passage and aren't similar costs all pairs of its blocks.

A text's set is its distinct shingles of k words, A to Z lower-cased; fewer words make one shingle. A null text, and one
without words, has no set and no links. Rows with a null id are never linked and keep a null component. Rows that share an id are
one document, linked as any of its texts is. Repeated rows are linked to each other. Extra columns play no part. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import bitmap, cut, give_back, in_bitmap, in_lots
from loomline.llm.components import connected
from loomline.llm.shingles import mixed, shingle_sets

#: Documents that are verified at once; sketches that are compared at once; sets of a group that is looked at once however often it occurs.
UNIT, WIDE, SAME = 512, 4096, 64
#: Bits of a sketch, as powers of 2: about one for each element.
LEAST_BITS, MOST_BITS = 6, 16
#: First-level partitions that a set may pass over, and the least elements of a signature that is sent all the same.
SPARE, FEW = 2, 4
#: Elements whose signatures are made at once, and sets that a task remembers.
AT_ONCE, SEEN = 1 << 18, 1 << 16
_SALT = np.uint64(0x2545F4914F6CDD1D)


@lru_cache(64)
def bands(num: int, den: int) -> np.ndarray:
    """Smallest size of each band: a set and one that has at least num/den of its size lie in the same or the next band."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * den // num + 1)
    return np.array(low)


def choices(errors: int, parts: int) -> np.ndarray:
    """For each choice of errors parts to leave out, which parts stay."""
    from itertools import combinations

    return np.array([[p not in out for p in range(parts)] for out in combinations(range(parts), errors)])


def levels(num: int) -> tuple[int, int]:
    """(elements a first-level partition may differ in, second-level partitions), by how similar sets must be."""
    return (1, 3) if num >= 75 else (2, 4)


def signatures(flat: np.ndarray, size: np.ndarray, num: int, den: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of its set) of sets that lie one after another in flat, for each set's band and the next."""
    low, (errors, parts) = bands(num, den), levels(num)
    stay = choices(errors, parts)
    filled = np.flatnonzero(size)
    size = size[filled]
    row = np.repeat(np.arange(len(size)), size)
    band = np.searchsorted(low, size, "right") - 1
    out, of = [], []
    for instance in (band, band + 1):
        most = (den - num) * 2 * (low[instance + 1] - 1) // (den + num)
        salt = mixed((instance + 1).astype(np.uint64) * _SALT)
        spare = np.where(most > 24, SPARE, 0)
        first = most // (errors + 1) + 1 + 2 * spare
        base = np.cumsum(first) - first
        x = mixed(flat + salt[row])
        cell = ((x >> np.uint64(40)) * first[row].astype(np.uint64) >> np.uint64(24)).astype(np.int64) + base[row]
        cell = cell * parts + ((x & np.uint64(0xFFFF)) * np.uint64(parts) >> np.uint64(16)).astype(np.int64)
        cells = int(first.sum()) * parts
        sums = np.zeros(cells, np.uint64)
        np.add.at(sums, cell, mixed(x * _SALT))
        sums = sums.reshape(-1, parts)
        owner = np.repeat(np.arange(len(size)), first)
        made = np.stack([sums[:, kept].sum(1, dtype=np.uint64) for kept in stay], 1)
        number = ((np.arange(len(owner)) - base[owner])[:, None] * len(stay) + np.arange(len(stay))).astype(np.uint64)
        made = mixed(made + mixed(number + salt[owner][:, None]))
        count = np.bincount(cell, minlength=cells).reshape(-1, parts)
        held = np.stack([count[:, kept].sum(1) for kept in stay], 1).min(1)
        send = np.ones(len(owner), bool)
        weak = np.flatnonzero((held < FEW) & (spare[owner] > 0))
        weak = weak[np.lexsort((held[weak], owner[weak]))]
        start = np.flatnonzero(np.diff(owner[weak], prepend=-1))
        rank = np.arange(len(weak)) - np.repeat(start, np.diff(start, append=len(weak)))
        send[weak[rank < SPARE]] = False
        same = most == 0  # such sets differ in nothing: one signature is enough
        send &= ~same[owner]
        out.append(made[send].ravel())
        of.append(np.repeat(owner[send], len(stay)))
        if same.any():
            whole = np.zeros(len(size), np.uint64)
            np.add.at(whole, row, mixed(x * _SALT))
            out.append(mixed(whole[same] ^ salt[same]))
            of.append(np.flatnonzero(same))
    return np.concatenate(out), filled[np.concatenate(of)]


def sketches(flat: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Of each set the parities of how many elements fall into buckets, the next power of 2 above its size."""
    bits = 1 << np.clip(np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    base = np.cumsum(bits) - bits
    row = np.repeat(np.arange(len(size)), size)
    cell = base[row] + (mixed(flat ^ _SALT) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits(np.bincount(cell, minlength=int(bits.sum())).astype(np.uint8) & 1, bitorder="little").tobytes()
    return [packed[a // 8 : (a + b) // 8] for a, b in zip(base.tolist(), bits.tolist())]


def unseen(ids: np.ndarray, sets: list[np.ndarray], seen: dict[bytes, int]) -> tuple[list[int], list[tuple[int, int]]]:
    """Which sets have no equal among those seen, and (id, id of the equal set) of the others. seen is kept up."""
    own, pairs = [], []
    for i, (name, s) in enumerate(zip(ids.tolist(), sets)):
        if len(s):
            key = xxhash.xxh3_128_digest(s.tobytes())
            if (other := seen.get(key)) is None:
                seen[key] = name
                own.append(i)
            elif other != name:
                pairs.append((name, other))
    if len(seen) > SEEN:
        seen.clear()
    return own, pairs


def lots(sets: list[np.ndarray], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of sets with most elements together, or one set."""
    start = size = 0
    for i, s in enumerate(sets):
        if size and size + len(s) > most:
            yield start, i
            start, size = i, 0
        size += len(s)
    if start < len(sets):
        yield start, len(sets)


def payload(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def candidates(docs: DataFrame, k: int, num: int) -> DataFrame:
    """(doc, n, sketch, other, g): a row with n and sketch per row of docs, rows with other, whose set is equal, and rows with g, a group of sets that share a signature."""

    def rows(sig: np.ndarray, doc: pa.Array, **more: pa.Array) -> pa.RecordBatch:
        n, kinds = len(sig), {"other": pa.int64(), "n": pa.int64(), "sketch": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), doc, *[more.get(c, pa.nulls(n, kind)) for c, kind in kinds.items()]], names=["sig", "doc", *kinds])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in in_lots(batches, "_text"):
            sets = list(shingle_sets(payload(batch.column("_text")), k))
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            known = np.flatnonzero(np.asarray(batch.column("_id").is_valid()))
            ids = np.asarray(batch.column("_id").fill_null(0)).astype(np.int64)
            own, pairs = unseen(ids[known], [sets[i] for i in known], seen)
            own = known[own] if own else known[:0]
            some = [sets[i] for i in own]
            for start, end in lots(some, AT_ONCE):
                sig, doc = signatures(np.concatenate(some[start:end]), size[own[start:end]], num)
                yield rows(sig, pa.array(ids[own[start:end]][doc]))
            if pairs:
                a, b = np.array(pairs, np.int64).T
                yield rows(mixed(a.astype(np.uint64) * _SALT + b.astype(np.uint64)), pa.array(a), other=pa.array(b))
            spread = mixed(np.arange(len(ids), dtype=np.uint64) + mixed(ids.astype(np.uint64)))
            for start, end in lots(sets, AT_ONCE):
                drawn = sketches(np.concatenate(sets[start:end]), size[start:end])
                yield rows(spread[start:end], batch.column("_id").cast(pa.int64()).slice(start, end - start), n=pa.array(size[start:end]), sketch=pa.array(drawn, pa.binary()))

    sent = docs.mapInArrow(send, "sig long, doc long, other long, n long, sketch binary")
    met = sent.selectExpr("*", "count(1) over (partition by sig) as m", "try_sum(shiftright(xxhash64(doc), 20)) over (partition by sig) as same")
    group = F.expr(f"case when n is null and other is null and m > 1 then if(m <= {SAME}, same, sig) end")
    return met.select("doc", "n", "sketch", "other", group.alias("g")).where("n is not null or other is not null or g is not null")


def alike(ids: np.ndarray, size: np.ndarray, drawn: list[bytes], num: int, den: int = 100) -> np.ndarray:
    """The number of the first set that each reaches by pairs that size and sketch don't rule out; rows with one id count as such a pair."""
    n, wide = len(ids), min(map(len, drawn))
    level = [np.frombuffer(x, np.uint64) for x in drawn]
    for i, x in enumerate(level):
        while x.nbytes > wide:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        level[i] = x
    bits, first = np.stack(level), np.arange(n)
    left = np.arange(1, n)
    root, ask = 0, [0]
    while len(left):
        if not ask:
            root, left = int(left[0]), left[1:]
            ask = [root]
            continue
        p = ask.pop()
        apart = np.bitwise_count(bits[left] ^ bits[p]).sum(1, dtype=np.int64)
        near = (den + num) * apart <= (den - num) * (size[left] + size[p])
        near &= den * np.minimum(size[left], size[p]) >= num * np.maximum(size[left], size[p])
        near |= ids[left] == ids[p]
        if near.any():
            first[left[near]] = root
            ask += left[near].tolist()
            left = left[~near]
    return first


def by_unit(rows: DataFrame, columns: list[str], found: Callable[..., np.ndarray]) -> DataFrame:
    """(doc, root) of rows (unit, doc, *columns), where found gives roots of a unit's ids and columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, out, ready = None, [], [], 0

        def done() -> None:
            nonlocal ready
            ids = np.array([h[0] for h in held], np.int64)
            out.append((ids, found(ids, *([h[i] for h in held] for i in range(1, len(columns) + 1)))))
            ready += len(ids)

        def told() -> pa.RecordBatch:
            nonlocal ready
            rows = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["doc", "root"])
            out.clear()
            ready = 0
            return rows

        for batch in batches:
            for u, *row in zip(*(batch.column(c).to_pylist() for c in ["unit", "doc", *columns])):
                if u != unit:
                    if len(held) > 1:
                        done()
                    unit, held = u, []
                    if ready > 1 << 14:
                        yield told()
                held.append(row)
        if len(held) > 1:
            done()
        held = []
        if out:
            yield told()
        give_back()

    return rows.repartition("unit").sortWithinPartitions("unit").select("unit", "doc", *columns).mapInArrow(run, "doc long, root long")


def compare(rows: DataFrame, num: int) -> DataFrame:
    """(doc, root) of rows (unit, doc, n, sketch): pairs that size and sketch don't rule out lead from doc to root."""

    def found(ids: np.ndarray, size: list[int], drawn: list[bytes]) -> np.ndarray:
        return ids[alike(ids, np.array(size, np.int64), drawn, num)]

    return by_unit(rows, ["n", "sketch"], found)


def linked(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int = 100) -> np.ndarray:
    """The smallest id that each set reaches by links, all sets compared; rows with one id count as linked."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1
    column = np.cumsum(shared) - 1
    keep = shared[number]
    row, column = row[keep], column[number[keep]]
    common = np.zeros((n, n), np.float32)
    wide, step = (int(column.max()) + 1 if len(column) else 0), max(1024, (1 << 23) // max(n, 1))
    for start in range(0, wide, step):
        a, b = np.searchsorted(column, [start, start + step])
        part = np.zeros((n, min(step, wide - start)), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        common += part @ part.T
    inter = common.astype(np.int64)
    near = den * inter >= num * (size[:, None] + size - inter)
    near &= (size > 0) & (size > 0)[:, None]
    near |= ids[:, None] == ids
    label = ids.copy()
    while True:
        least = np.where(near, label, np.iinfo(np.int64).max).min(1)
        if (least == label).all():
            return label
        label = least


def verify(rows: DataFrame, k: int, num: int) -> DataFrame:
    """(doc, root) of rows (unit, doc, text): the smallest id of the unit that each document reaches by links."""
    return by_unit(rows, ["text"], lambda ids, texts: linked(ids, list(shingle_sets([(t or "").encode() for t in texts], k)), num))


def edges_of(met: DataFrame) -> DataFrame:
    return met.where("root <> doc").select(F.col("doc").alias("a"), F.col("root").alias("b"))


def dealt(members: DataFrame, most: int) -> DataFrame:
    """members (root, doc) with blocks, in how many blocks of most or so a root's members are dealt, and block, a member's."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / most).cast("int"))
    return members.join(sizes, "root").select("doc", "root", "blocks", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"))


def meet(members: DataFrame, content: DataFrame, most: int, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): what check(rows of content with unit) finds among the members of each root, in units of a few times most.

    The blocks of a root meet its first; members that then aren't in its largest component meet all.
    """
    unit = lambda *c: F.concat_ws("/", F.col("root"), *c)
    # a table, so that what follows doesn't run beside this in workers of its own
    small = cut(edges_of(check(content.join(members.where("blocks = 1").select("doc", unit().alias("unit")), "doc"))), "pairs")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return small
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("meets")
    deal = large.where("block > 0").select("doc", unit("block").alias("unit")).union(large.where("block = 0").select("doc", "root", every).select("doc", unit("meets").alias("unit")))
    edges = cut(small.union(edges_of(check(content.join(deal, "doc")))), "met")
    label = connected(edges)
    told = large.join(label.select(F.col("node").alias("doc"), F.col("root").alias("label")), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    count = told.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    count = count.withColumn("rest", F.ceil((F.col("all") - F.col("most")) / most).cast("int"))
    rest = cut(told.join(count.where("rest > 0").select("root", "main", "rest"), "root").withColumn("odd", F.pmod(F.xxhash64("doc", F.lit(1)), "rest").cast("int")), "rest")
    if rest.isEmpty():
        return edges
    to_odd = F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("odd")
    stay = rest.select("doc", "root", "block", to_odd).select("doc", unit("odd", "block").alias("unit"))
    ask = rest.where("label <> main").select("doc", "root", "odd", every).select("doc", unit("odd", "meets").alias("unit"))
    return edges.union(edges_of(check(content.join(stay.union(ask).distinct(), "doc"))))


def components(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, num: int = 90) -> DataFrame:
    """(key, n_shingles, component_id), a row per row of df; sets link if 100 * intersection >= num * union."""
    docs = df.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    found = cut(candidates(docs, k, num), "candidates")
    groups = cut(dealt(found.where("g is not null").select(F.col("g").alias("root"), "doc").distinct(), WIDE), "groups")
    drawn = found.where("n > 0 and doc is not null").select("doc", "n", "sketch").distinct()
    clusters = connected(meet(groups, drawn, WIDE, lambda rows: compare(rows, num)))
    members = cut(dealt(clusters.select("root", F.col("node").alias("doc")), UNIT), "members")
    own = docs.where("_id is not null").select(F.col("_id").alias("doc"), F.col("_text").alias("text"))
    # texts travel once, and only those of members and of few others
    texts = cut(in_bitmap(own, "doc", bitmap(members, "doc"), "left_semi").join(members.select("doc").hint("shuffle_merge"), "doc"), "texts")
    links = meet(members, texts, UNIT, lambda rows: verify(rows, k, num))
    roots = connected(links.union(found.where("other is not null").select("doc", "other")))
    rows = found.where("n is not null").select("doc", "n")
    out = rows.where("doc is not null").join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").unionByName(rows.where("doc is null").withColumn("root", F.lit(None).cast("long")))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("root", "doc").alias("component_id"))
