"""Splits with given shares that keep related records together."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.flow import Network
from plumbline.scratch import Scratch

#: Parts of a bundle's hash range whose sizes are counted before members are ranked.
PARTS = 1024
#: Cost of a record beyond a split's quota, and beyond the split's part of the groups of its size.
OVER_SPLIT, OVER_SIZE = 1000, 10
#: Groups of a bundle and split that are placed one by one, by their labels, and rows of the plan that the driver holds.
SINGLY, HELD = 16, 100_000


class Related(NamedTuple):
    """``nodes``: (node, root) of every value; ``rows``: the records with the node that places them."""

    rows: DataFrame
    roots: DataFrame


def relate(records: DataFrame, id_column: str, by: Sequence[str], keep: tuple[str, str], scratch: Scratch) -> Related:
    """Which records share a value in one of ``by``, directly or through others.

    The graph has a vertex for each value, not for each record: a record ties its own
    values together, and equal ties are counted once before any graph work. A value that
    a third of all rows share is therefore one vertex. Null values relate nothing; a
    record without any value stands alone. Rows without an id are no
    records. ``keep`` is a column to carry along and its new name.
    """
    values = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(c))) for i, c in enumerate(by)]
    alone = F.concat(F.lit("-:"), F.col(id_column).cast("string"))
    column, name = keep
    rows = records.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(column).alias(name), F.array_compact(F.array(*values)).alias("values"), alone.alias("alone"))
    rows = rows.select("id", name, "values", F.coalesce(F.get("values", F.lit(0)), "alone").alias("node"))
    ties = rows.where("size(values) > 1").select("node", F.explode(F.slice("values", 2, len(by))).alias("other")).distinct()
    roots = components(ties, "node", "other", scratch).select(F.col("id").alias("node"), F.col("group_id").alias("root"))
    return Related(rows.drop("values"), roots)


def _with_root(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def broken_groups(records: DataFrame, id_column: str, by: Sequence[str], split: str, labels: tuple[str, str], scratch: Scratch) -> DataFrame:
    """(group_id, id): members of related groups that hold records of both split labels.

    Rows with another or a null split belong to their group; ``group_id`` is its smallest
    id. Repeated rows are given once; an empty table gives an empty result.
    """
    related = relate(records, id_column, by, (split, "split"), scratch)
    rows = related.rows
    # Reduced to one row a node before roots are looked up.
    nodes = rows.groupBy("node").agg(
        F.min("id").alias("least"), *[F.max(F.coalesce(F.col("split") == v, F.lit(False))).alias(f"has_{i}") for i, v in enumerate(labels)]
    )
    nodes = _with_root(nodes, related.roots)
    groups = nodes.groupBy("root").agg(F.min("least").alias("group_id"), F.max("has_0").alias("has_0"), F.max("has_1").alias("has_1"))
    placed = nodes.select("node", "root").join(groups.where("has_0 AND has_1"), "root").select("node", "group_id")
    return rows.select("id", "node").distinct().join(placed, "node").select("group_id", "id")


def _allocate(sizes: list, shares: list[tuple[str, float]]) -> list[list[int]]:
    """For each size how many of its groups go to each split."""
    total = sum(b.size * b.n for b in sizes)
    quotas = [round(share * total) for _, share in shares]
    k, m = len(shares), len(sizes)
    source, sink = 0, 1
    split_at = [2 + i for i in range(k)]
    first = 2 + k + k * m
    net = Network(first + m)
    widest = max(range(k), key=lambda i: quotas[i])
    for i in range(k):
        net.arc(split_at[i], sink, quotas[i])
        net.arc(split_at[i], sink, total, OVER_SPLIT)
    arcs = []
    for at, b in enumerate(sizes):
        net.arc(source, first + at, b.size * b.n)
        row = []
        for i in range(k):
            cell = 2 + k + i * m + at
            net.arc(cell, split_at[i], round(shares[i][1] * b.size * b.n))
            net.arc(cell, split_at[i], total, OVER_SIZE)
            # A split takes only groups that fit its quota whole; the widest takes any.
            room = b.n if i == widest else min(b.n, quotas[i] // b.size)
            row.append(net.arc(first + at, cell, room * b.size))
        arcs.append(row)
    net.solve(source, sink)
    # Whole groups: floors first, then each rest to the split that lags most.
    lag = list(map(float, quotas))
    counts = []
    for b, row in zip(sizes, arcs, strict=True):
        flows = [net.flow(a) for a in row]
        whole = [f // b.size for f in flows]
        counts.append(whole)
        for i in range(k):
            lag[i] -= whole[i] * b.size
    for b, whole in sorted(zip(sizes, counts, strict=True), key=lambda x: -x[0].size):
        for _ in range(b.n - sum(whole)):
            i = max(range(k), key=lambda i: (lag[i], -i))
            whole[i] += 1
            lag[i] -= b.size
    return counts


def _deal(bundles: Iterator, rooms: dict[int, list[int]], of_label: dict[str | None, int], shares: list[tuple[str, float]]) -> Iterator[tuple]:
    """For each bundle of a (size, profile) how many of its groups go to each split: (size, profile, counts).

    ``rooms`` tells how many groups of each size a split takes. Most groups of a large
    bundle are dealt in proportion to that, which deviates in no label; each other goes
    where its label counts add least to the squared deviations from the label quotas.
    """
    k = len(shares)
    quota = {x: [max(share * n, 1.0) for _, share in shares] for x, n in of_label.items()}
    held = {x: [0] * k for x in of_label}
    for b in bundles:
        room = rooms[b.size]
        parts = [(quota[x], held[x], n) for x, n in ((p.get("label"), p["n"]) for p in json.loads(b.profile))]
        free = sum(room)
        counts = [max(0, b.n * r // free - SINGLY) for r in room]
        for i in range(k):
            room[i] -= counts[i]
            for _, h, n in parts:
                h[i] += counts[i] * n
        for _ in range(b.n - sum(counts)):
            i = min((i for i in range(k) if room[i]), key=lambda i: (sum((2 * (h[i] - q[i]) * n + n * n) / q[i] for q, h, n in parts), i))
            counts[i] += 1
            room[i] -= 1
            for _, h, n in parts:
                h[i] += n
        yield b.size, b.profile, counts


def assign_splits(records: DataFrame, id_column: str, by: Sequence[str], label: str, targets: DataFrame, scratch: Scratch, seed: int = 7) -> DataFrame:
    """(id, split_name): every record in one split, related records in the same.

    Groups of identical size and label profile (how many records have each label; null
    is a label) are one bundle. A min-cost flow decides how many groups of each size go
    to each split: going over a split's quota costs most, over its part of the groups of
    a size less. Flows are rounded to whole groups. The bundles of a size then share these
    by their true label counts, see ``_deal``. Which groups go where is decided by the
    rank of their hash. ``targets`` holds (split_name, target_share) with shares that add
    up to 1. An empty table gives an empty result; rows repeated under one id count as
    often as they are stored and share a split. With N records fewer than sqrt(2 N) sizes
    and one row for each label reach the driver; bundles, however many, pass through it
    one by one, and their plan is written in parts.
    """
    shares = [(r.split_name, r.target_share) for r in targets.orderBy("split_name").limit(101).collect()]
    if not 0 < len(shares) <= 100 or abs(sum(s for _, s in shares) - 1) > 1e-9:
        raise ValueError("targets must be 1 to 100 shares that add up to 1")
    related = relate(records, id_column, by, (label, "label"), scratch)
    counted = related.rows.groupBy("node", "label").agg(F.count("*").alias("n"))
    per_label = _with_root(counted, related.roots).groupBy("root", "label").agg(F.sum("n").alias("n"))
    per_label = scratch.save(per_label, "labels")
    groups = per_label.groupBy("root").agg(F.sum("n").alias("size"), F.to_json(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("profile"))
    hashed = F.xxhash64("root", F.lit(seed))
    groups = groups.select("root", "size", "profile", hashed.alias("hash"), F.pmod(hashed, F.lit(PARTS)).alias("part"))
    groups = scratch.save(groups, "groups")

    sizes = groups.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()
    of_label = {r.label: r.n for r in per_label.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    rooms = {b.size: counts for b, counts in zip(sizes, _allocate(sizes, shares) if sizes else [], strict=True)}
    bundles = groups.groupBy("size", "profile").agg(F.count("*").alias("n")).orderBy(F.desc("size"), "profile")
    spark = records.sparkSession
    cuts, plan = [], []

    def write() -> None:
        plan.append(scratch.save(spark.createDataFrame(cuts, "size long, profile string, split_name string, low long, high long"), "plan"))
        cuts.clear()

    for size, profile, counts in _deal(bundles.toLocalIterator(), rooms, of_label, shares):
        upto = 0
        for (name, _), n in zip(shares, counts, strict=True):
            if n:
                cuts.append((size, profile, name, upto, upto + n))
            upto += n
        if len(cuts) >= HELD:
            write()
    write()
    cut = reduce(DataFrame.unionAll, plan)

    # Rank within a bundle: members of earlier parts of the hash, then the rank in the part.
    parts = groups.groupBy("size", "profile", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size", "profile").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("size", "profile", "part").orderBy("hash", "root")
    ranked = groups.withColumn("rank", F.row_number().over(inside) - 1).join(parts, ["size", "profile", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    chosen = ranked.join(cut, ["size", "profile"]).where("rank >= low AND rank < high").select("root", "split_name")

    nodes = _with_root(related.rows.select("node").distinct(), related.roots)
    placed = nodes.join(chosen, "root").select("node", "split_name")
    return related.rows.select("id", "node").join(placed, "node").select("id", "split_name")
