"""A Merkle manifest: per group (language) a tree over its rows' digests in order of their keys, and one over the groups' roots.

Ranks come from a radix trie of the keys, without a global sort: rows are counted by their digits of 10 bits, and a digit's
place is the count of smaller digits below the same prefix plus the place of that prefix, so that no window holds more
than 1,024 digits. Rows of one key go on by the digits of their leaves; equal rows are one entry with a count. Digits of
the rank in the base of the fanout then key the tree: nodes that share their longest prefix, up to BLOCK of them, are
reduced together over several levels, and their heads go on as the next round's nodes. So a language of any size takes a
round for each BLOCK-fold, a group never holds more than BLOCK nodes, and what moves are digests, never texts.

A leaf is H of the row's fields, each "-" for null, else its UTF-8 length, ":" and the value. Up to fanout nodes in a row become H of
their digests as text, also the last ones of a level, even one, until one is left; a lone leaf is its group's root.
Null keys come before all others; rows that share a key are ordered by their leaves, equal rows have equal rows of the result
but for their siblings. Null groups are a group, the first. An empty table gives an empty manifest. Further columns are not read.
The distinct groups are ranked by a window over one row for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import cut

#: Bits of a key's digit, and nodes at most that a task reduces at once.
DIGIT, BLOCK = 10, 1024
OUT = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(fields: Sequence[Column]) -> Column:
    each = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in each]).cast("binary"), 256)


def levels_of(leaves: list[str], count: int, fanout: int) -> list[list[str]]:
    """The nodes of each level from leaves up, count levels above them."""
    out = [leaves]
    for _ in range(count):
        below = out[-1]
        out.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def siblings(levels: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """What stands left and right of a leaf in its run, level by level."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
        at //= fanout
    return out


def packed(path: list[tuple[str, str]]) -> str:
    return "/".join(f"{left}|{right}" for left, right in path)


def unpacked(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split("|")) for x in text.split("/")] if text else []


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def placed(counted: DataFrame, path: list[list[str]]) -> DataFrame:
    """counted (columns of path, n) with _at: how many rows of the same first columns come before, by the digits of path."""
    if len(path) == 1:
        return counted.withColumn("_at", F.lit(0).cast("long"))
    above = [c for part in path[:-1] for c in part]
    up = placed(counted.groupBy(*above).agg(F.sum("n").alias("n")), path[:-1]).drop("n").withColumnRenamed("_at", "_up")
    before = Window.partitionBy(*above).orderBy(*path[-1]).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("_own", F.coalesce(F.sum("n").over(before), F.lit(0))).join(up, above).withColumn("_at", F.col("_up") + F.col("_own")).drop("_up", "_own")


def ranked(leaves: DataFrame) -> DataFrame:
    """leaves (_group, _key, leaf, tampered) with _rank, a row's place among those of its group."""
    lowest, highest = leaves.agg(F.min("_key"), F.max("_key")).first()
    shifts = [0]
    while lowest is not None and (highest >> shifts[-1]) - (lowest >> shifts[-1]) >= 1 << DIGIT and shifts[-1] + DIGIT < 64:
        shifts.append(shifts[-1] + DIGIT)
    some = F.col("_key").isNotNull()
    key = F.coalesce(F.col("_key").cast("long"), F.lit(0).cast("long"))
    counted = leaves.groupBy("_group", "_key", "leaf", "tampered").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumns({"_some": some, "_tie": F.substring("leaf", 1, 4)} | {f"_d{s}": F.shiftright(key, s) for s in shifts})
    digits = [["_some", f"_d{shifts[-1]}"]] + [[f"_d{s}"] for s in shifts[-2::-1]]
    found = placed(counted, [["_group"], *digits, ["_tie"], ["leaf", "tampered"]])
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return found.select("_group", "_key", "leaf", "tampered", "_at", copy.alias("_copy")).select("_group", "_key", "leaf", "tampered", (F.col("_at") + F.col("_copy")).alias("_rank"))


def depth(n: Column, fanout: int) -> Column:
    """Levels above n leaves until one node is left."""
    steps, k = F.lit(0), 1
    while k < 1 << 62:
        steps, k = steps + F.when(n > k, 1).otherwise(0), k * fanout
    return steps


def manifest(df: DataFrame, fields: Sequence[str], altered: dict[str, Column] | None = None, key: str = "doc_id", group: str = "lang", fanout: int = 2) -> DataFrame:
    """Per row: its key (as doc_id), leaf, its group's subroot, root, proof_sha256 (H of all siblings on the way to the root), folded_root and verified.

    altered gives other values of some fields: folded_root is what the way to the root yields from the leaf of those, and
    verified tells whether that is still the root. Keys are integers.
    """
    kind, altered = df.schema[key].dataType.simpleString(), altered or {}
    per = 1
    while per * fanout <= BLOCK:
        per *= fanout
    step = depth_of(per, fanout)
    own = [F.col(f) for f in fields]
    other = [altered.get(f, F.col(f)) for f in fields]
    changed = F.lit(False)
    for a, b in zip(own, other):
        changed = changed | ~a.eqNullSafe(b)
    leaves = cut(df.select(F.col(group).alias("_name"), F.col(key).alias("_key"), leaf_of(own).alias("leaf"), F.when(changed, leaf_of(other)).alias("_other")), "leaves")
    leaves = leaves.select("_name", "_key", "leaf", F.coalesce("_other", "leaf").alias("tampered"))
    # a row for each group: the groups are few beside their rows
    groups = leaves.groupBy("_name").agg(F.count(F.lit(1)).alias("_n")).withColumn("_group", F.row_number().over(Window.orderBy(F.col("_name").asc_nulls_first())) - 1)
    groups = cut(groups.select("_name", F.col("_group").cast("long").alias("_group"), depth(F.col("_n"), fanout).alias("_levels")), "groups")
    known = leaves.join(groups.select(F.col("_name").alias("_own"), "_group"), F.col("_name").eqNullSafe(F.col("_own"))).drop("_name", "_own")
    rows = cut(ranked(known).withColumn("_block", F.floor(F.col("_rank") / per).cast("long")).join(groups.select("_group", "_levels"), "_group"), "ranked")
    rounds, nodes = [], rows.select("_group", "_rank", F.col("leaf").alias("node"), "_levels")
    deepest = groups.agg(F.max("_levels")).first()[0] or 0
    for _ in range(max(1, -(-deepest // step))):
        rounds.append(nodes)
        nodes = cut(heads(nodes, per, step, fanout), "nodes")
    tops = nodes.where("_rank = 0").select("_group", F.col("node").alias("subroot"))
    above = cut(over_groups(tops, fanout, per, step), "roots")  # _group, subroot, root, way: of each group
    way = above.select("_group", F.lit(0).cast("long").alias("_rank"), "way", "subroot", "root")
    for nodes in rounds[:0:-1]:
        way = cut(ways(nodes, way, per, step, fanout), "ways")

    def prove(mine: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("_rank")
        levels = levels_of(mine["leaf"].tolist(), min(step, int(mine["_levels"].iloc[0])), fanout)
        rest, root = unpacked(up["way"].iloc[0]), up["root"].iloc[0]
        out = []
        for at, (leaf, tampered) in enumerate(zip(mine["leaf"], mine["tampered"])):
            path = siblings(levels, at, fanout) + rest
            out.append((digest("".join(a + b for a, b in path)), fold(tampered, path)))
        proofs, folded = zip(*out)
        return pd.DataFrame({"doc_id": mine["_key"], "leaf": mine["leaf"], "subroot": up["subroot"].iloc[0], "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]})

    up = way.withColumnRenamed("_rank", "_block")
    told = rows.withColumn("_key", F.col("_key").cast("string"))  # as integers beside nulls would come as floats
    proved = told.groupBy("_group", "_block").cogroup(up.groupBy("_group", "_block")).applyInPandas(prove, OUT)
    return proved.withColumn("doc_id", F.col("doc_id").cast(kind))


def depth_of(n: int, fanout: int) -> int:
    steps = 0
    while n > 1:
        n, steps = -(-n // fanout), steps + 1
    return steps


def heads(nodes: DataFrame, per: int, step: int, fanout: int) -> DataFrame:
    """nodes (_group, _rank, node, _levels left) a round up: a node for each per of them."""

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        levels = int(rows["_levels"].iloc[0])
        top = levels_of(rows.sort_values("_rank")["node"].tolist(), min(step, levels), fanout)[-1]
        return pd.DataFrame({"_group": [key[0]], "_rank": [key[1]], "node": top, "_levels": [max(0, levels - step)]})

    return nodes.groupBy("_group", F.floor(F.col("_rank") / per).cast("long").alias("_block")).applyInPandas(reduce, "_group long, _rank long, node string, _levels int")


def ways(nodes: DataFrame, way: DataFrame, per: int, step: int, fanout: int) -> DataFrame:
    """The way to the root of each of nodes, from those of the heads of their blocks."""

    def extend(mine: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("_rank")
        levels = levels_of(mine["node"].tolist(), min(step, int(mine["_levels"].iloc[0])), fanout)
        rest = up["way"].iloc[0]
        own = ["/".join(filter(None, (packed(siblings(levels, at, fanout)), rest))) for at in range(len(mine))]
        return pd.DataFrame({"_group": mine["_group"], "_rank": mine["_rank"], "way": own, "subroot": up["subroot"].iloc[0], "root": up["root"].iloc[0]})

    blocks = nodes.withColumn("_block", F.floor(F.col("_rank") / per).cast("long"))
    return blocks.groupBy("_group", "_block").cogroup(way.withColumnRenamed("_rank", "_block").groupBy("_group", "_block")).applyInPandas(extend, "_group long, _rank long, way string, subroot string, root string")


def over_groups(tops: DataFrame, fanout: int, per: int, step: int) -> DataFrame:
    """(_group, subroot, root, way) from the groups' subroots, by the same rounds over their numbers."""
    count = tops.count()
    nodes = tops.select(F.lit(0).cast("long").alias("_group"), F.col("_group").alias("_rank"), F.col("subroot").alias("node"), F.lit(depth_of(count, fanout)).alias("_levels"))
    rounds = []
    for _ in range(max(1, -(-depth_of(count, fanout) // step))):
        rounds.append(nodes)
        nodes = cut(heads(nodes, per, step, fanout), "nodes")
    way = nodes.select("_group", "_rank", F.lit("").alias("way"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    for nodes in rounds[::-1]:
        way = cut(ways(nodes, way, per, step, fanout), "ways")
    return way.select(F.col("_rank").alias("_group"), "root", "way").join(tops, "_group")
