"""Similarity graphs over records: components, their sizes, edge statistics, bounded clusters, covers.

Components come from alternating star contractions: every vertex hands its larger
neighbours, then its smaller ones, to the least of them. Each round is two aggregations
and two joins; the rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.scratch import Scratch

# Priority of the confirmed edge types.
PRIORITY = {"exact_semantic_signature": 3, "char_ngram": 2, "token_jaccard": 1}
#: Pairs of blocks that the sequential clustering accepts: what one task holds.
MOST_PAIRS = 2_000_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction over (a, b) with a > b, each pair once."""
    if large:
        around = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    least = around.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    joined = around.join(least, "a")
    moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")) if large else joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not large:
        moved = moved.unionAll(least.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def components(vertices: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root): every vertex with the least vertex of its component.

    ``vertices`` has a column v, ``edges`` columns a and b; edges with a null or unknown
    end still join what they join, but only vertices are in the result.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    state = scratch.save(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    seen = None
    while True:
        after = scratch.save(_stars(_stars(state, large=True), large=False), "stars")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(state)
        state = after
        if mark == seen:
            break
        seen = mark
    roots = state.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return vertices.join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root"))


def relation_edges(records: DataFrame, vertex: str, fields: Sequence[str]) -> DataFrame:
    """Edges from every record to the least one with the same value of a field: stars, never all pairs."""
    out = None
    for field in fields:
        valued = records.where(F.col(field).isNotNull() & (F.col(field) != "")).select(F.col(vertex).alias("a"), F.col(field).alias("value"))
        least = valued.groupBy("value").agg(F.min("a").alias("b"))
        found = valued.join(least, "value").select("a", "b")
        out = found if out is None else out.unionAll(found)
    return out


def parent_edges(records: DataFrame, vertex: str, parent: str) -> DataFrame:
    """Edges from every record to the one it names as its parent; null and empty names, and records of themselves, give none."""
    found = records.where(F.col(parent).isNotNull() & (F.col(parent) != "") & (F.col(parent) != F.col(vertex)))
    return found.select(F.col(vertex).alias("a"), F.col(parent).alias("b"))


def size_summary(sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, least, median, most, share of the largest, concentration and its inverse of group sizes (column n)."""
    rows, squares = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    return sizes.groupBy(*by).agg(
        F.count("*").alias("components"), F.min("n").alias("minimum_rows"), F.median("n").alias("median_rows"), F.max("n").alias("maximum_rows"),
        (F.max("n") / rows).alias("maximum_share"), (squares.cast("double") / (rows * rows)).alias("hhi"), ((rows * rows).cast("double") / squares).alias("effective_components"),
    )


def top_sizes(sizes: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest groups with their rank."""
    top = sizes.orderBy(F.desc("n"), "root").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("n"), "root")).alias("rank"), "n")


def edge_selection(edges: DataFrame, char_from: float | None, token_from: float | None) -> DataFrame:
    """Exact edges always; the others from a score on, or not at all."""
    kind, score = F.col("edge_type"), F.col("score")
    keep = kind == "exact_semantic_signature"
    for name, least in (("char_ngram", char_from), ("token_jaccard", token_from)):
        if least is not None:
            keep = keep | ((kind == name) & (score >= least))
    return edges.where(keep)


def with_ends(edges: DataFrame, records: DataFrame, vertex: str, columns: Sequence[str]) -> DataFrame:
    """Edges with the columns of both end records, prefixed left_ and right_; edges with an unknown end drop out."""
    for side in ("left", "right"):
        ends = records.select(F.col(vertex).alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        edges = edges.join(ends, f"{side}_id")
    return edges


def edge_statistics(ended: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each edge type: how many, how many across each column, and scores."""
    across = [F.count_if(~F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}"))).alias(f"cross_{c}") for c in columns]
    scores = [F.min("score").alias("min_score"), F.median("score").alias("median_score"), F.max("score").alias("max_score")]
    return ended.groupBy("edge_type").agg(F.count("*").alias("n"), *across, *scores)


def block_pairs(ended: DataFrame, block: str) -> DataFrame:
    """One row for each unordered pair of blocks with edges between them."""
    left, right = F.col(f"left_{block}"), F.col(f"right_{block}")
    kind = F.col("edge_type")
    rank = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in PRIORITY.items()], F.lit(0))
    return ended.where(left != right).groupBy(F.least(left, right).alias("block_a"), F.greatest(left, right).alias("block_b")).agg(
        F.count("*").alias("edge_count"), *[F.count_if(kind == k).alias(f"n_{k}") for k in PRIORITY],
        F.max("score").alias("max_score"), F.max(rank).alias("priority"),
    )


class _Sets:
    """Disjoint sets with weights and an optional cap."""

    def __init__(self, weights: dict[str, int]) -> None:
        self.parent = {x: x for x in weights}
        self.weight = dict(weights)

    def find(self, x: str) -> str:
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, x: str, y: str, cap: int) -> bool | None:
        """None if already together, else whether the cap let them join."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return None
        if self.weight[x] + self.weight[y] > cap:
            return False
        keep, drop = sorted((x, y), key=lambda r: (-self.weight[r], r))
        self.parent[drop] = keep
        self.weight[keep] += self.weight.pop(drop)
        return True


def bounded_clusters(weights: DataFrame, pairs: DataFrame, cap: int, scratch: Scratch) -> DataFrame:
    """(block, cluster, n): blocks merged along their strongest pairs while clusters hold at most ``cap`` rows.

    The order (priority, exact edges, edges, best score, names, all descending) makes each
    merge depend on those before it, so one task does it, over block pairs only: records
    never reach it. More than MOST_PAIRS pairs are refused.
    """
    order = ["priority", "n_exact_semantic_signature", "edge_count", "max_score", "block_a", "block_b"]
    pairs = scratch.save(pairs.select(*order), "block_pairs")
    n_pairs = pairs.count()
    if n_pairs > MOST_PAIRS:
        raise ValueError(f"{n_pairs} block pairs; at most {MOST_PAIRS} fit one sequential clustering")
    left = weights.select(F.lit(1).alias("k"), "block", F.col("n").cast("long"))
    right = pairs.select(F.lit(1).alias("k"), *order)

    def merge(blocks: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        sets = _Sets(dict(zip(blocks["block"], blocks["n"].astype(int), strict=True)))
        links = links.sort_values(order, ascending=False, kind="stable")
        for a, b in zip(links["block_a"], links["block_b"], strict=True):
            sets.join(a, b, cap)
        return pd.DataFrame({"block": blocks["block"], "cluster": [sets.find(b) for b in blocks["block"]], "n": blocks["n"]})

    return left.groupBy("k").cogroup(right.groupBy("k")).applyInPandas(merge, "block string, cluster string, n long")


def cluster_report(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row about ``bounded_clusters``: clusters, their sizes, merged and refused pairs, most blocks in one.

    A merge leaves one cluster fewer, and what the cap refused once it refuses for good,
    so the pairs refused are those whose blocks end apart.
    """
    sizes = clusters.groupBy("cluster").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"))
    spread = size_summary(sizes).crossJoin(F.broadcast(sizes.agg(F.max("blocks").alias("most_blocks"), F.sum("blocks").alias("n_blocks"))))
    ended = pairs.select("block_a", "block_b")
    for side in "ab":
        ended = ended.join(clusters.select(F.col("block").alias(f"block_{side}"), F.col("cluster").alias(f"c_{side}")), f"block_{side}")
    refused = ended.agg(F.count_if(F.col("c_a") != F.col("c_b")).alias("rejected_pairs"))
    return spread.crossJoin(F.broadcast(refused)).withColumn("accepted_pairs", F.col("n_blocks") - F.col("components"))


def _cover(edges: pd.DataFrame) -> pd.DataFrame:
    ends = list(zip(edges["a"], edges["b"], edges["n"].astype(int), strict=True))
    touching: dict[str, set[int]] = {}
    live: dict[str, int] = {}
    for i, (a, b, n) in enumerate(ends):
        for family in {a, b}:
            touching.setdefault(family, set()).add(i)
            live[family] = live.get(family, 0) + n
    heap = [(-n, family) for family, n in live.items()]
    heapq.heapify(heap)
    chosen = []
    while heap:
        count, family = heapq.heappop(heap)
        if live[family] != -count:  # counted when more of its edges were live
            if live[family]:
                heapq.heappush(heap, (-live[family], family))
            continue
        chosen.append((family, -count))
        for i in touching[family]:
            a, b, n = ends[i]
            for other in {a, b} - {family}:
                touching[other].discard(i)
                live[other] -= n
        live[family] = 0
    return pd.DataFrame(chosen, columns=["family", "n_edges"])


def _strongest(pairs: DataFrame) -> DataFrame:
    """(family, n_edges): families with more live edges than any they share one with, ties to the least name."""
    ends = pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("family"), "n")
    degree = ends.groupBy("family").agg(F.sum("n").alias("n_edges"))
    across = pairs.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("family"), F.col("b").alias("other")), F.struct(F.col("b").alias("family"), F.col("a").alias("other")))).alias("e")).select("e.*")
    around = across.join(degree.select(F.col("family").alias("other"), F.col("n_edges").alias("n_other")), "other")
    best = around.groupBy("family").agg(F.min(F.struct((-F.col("n_other")).alias("k"), "other")).alias("rival"))
    mine = F.struct((-F.col("n_edges")).alias("k"), F.col("family").alias("other"))
    return degree.join(best, "family", "left").where(F.col("rival").isNull() | (mine < F.col("rival"))).select("family", "n_edges")


def family_cover(crossing: DataFrame, scratch: Scratch, most: int = MOST_PAIRS) -> DataFrame:
    """(family, n_edges): families that touch every crossing edge, as the greedy cover takes them: the most live edges first, ties to the least name.

    Live counts only fall, so a family ahead of all it shares an edge with is taken before
    any of them, whatever happens elsewhere: all such are taken at once, by joins, until at
    most ``most`` pairs of families are left, which one task finishes. Taken in order of
    ``n_edges`` (descending) and name, the result is that of the sequential program.
    Edges reach it as counts of family pairs; those with a null family are left out.
    """
    ends = crossing.where("left_family_id IS NOT NULL AND right_family_id IS NOT NULL")
    pair = (F.least("left_family_id", "right_family_id").alias("a"), F.greatest("left_family_id", "right_family_id").alias("b"))
    pairs, taken = scratch.save(ends.groupBy(*pair).agg(F.count("*").alias("n")), "family_pairs"), None
    while pairs.count() > most:
        found = scratch.save(_strongest(pairs), "taken")
        taken = found if taken is None else taken.unionAll(found)
        rest = pairs
        for side in "ab":
            rest = rest.join(found.select(F.col("family").alias(side)), side, "left_anti")
        rest = scratch.save(rest.select("a", "b", "n"), "family_pairs")
        scratch.drop(pairs)
        pairs = rest
    last = pairs.withColumn("k", F.lit(1)).groupBy("k").applyInPandas(lambda df: _cover(df), "family string, n_edges long")
    return last if taken is None else taken.unionAll(last)


def without_vertices(edges: DataFrame, removed: DataFrame, vertex: str) -> DataFrame:
    """Edges (left_id, right_id, ...) that touch none of the removed vertices."""
    gone = removed.select(vertex).distinct()
    for side in ("left_id", "right_id"):
        edges = edges.join(gone.withColumnRenamed(vertex, side), side, "left_anti")
    return edges


def tagged_components(variants: Sequence[tuple[str, DataFrame, Sequence[str], DataFrame | None]], vertex: str, scratch: Scratch) -> DataFrame:
    """(variant, root, n): component sizes of several definitions, contracted in one loop over variant-qualified vertices.

    A variant is a name, records, relation fields and edges (left_id, right_id) or none.
    """
    vertices = found = None
    for name, records, fields, edges in variants:
        tag = F.lit(f"{name}|")
        mine = records.select(F.concat(tag, vertex).alias("v"), *fields)
        parts = [relation_edges(mine, "v", fields)] if fields else []
        if edges is not None:
            parts.append(edges.select(F.concat(tag, "left_id").alias("a"), F.concat(tag, "right_id").alias("b")))
        vertices = mine.select("v") if vertices is None else vertices.unionAll(mine.select("v"))
        for part in parts:
            found = part if found is None else found.unionAll(part)
    if found is None:
        found = vertices.select(F.col("v").alias("a"), F.col("v").alias("b"))
    roots = components(vertices, found, scratch)
    return roots.groupBy(F.substring_index("v", "|", 1).alias("variant"), "root").agg(F.count("*").alias("n"))


def duplicate_groups(rows: DataFrame, key: Column, columns: Sequence[str]) -> DataFrame:
    """(size, n_groups, excess, cross_...): histogram of groups of equal ``key`` with two rows or more."""
    spread = [(F.count_distinct(c) > 1).alias(f"cross_{c}") for c in columns]
    groups = rows.groupBy(key.alias("key")).agg(F.count("*").alias("size"), *spread).where("size > 1")
    return groups.groupBy("size").agg(
        F.count("*").alias("n_groups"), F.sum(F.col("size") - 1).alias("excess"), *[F.count_if(f"cross_{c}").alias(f"cross_{c}") for c in columns]
    )


def duplicate_summary(rows: DataFrame, text: str, state: str, columns: Sequence[str], label: str) -> DataFrame:
    """One row about equal texts: how many distinct, excess, groups, and what the groups cross; null texts are left out."""
    keyed = rows.where(F.col(text).isNotNull())
    spread = [(F.count_distinct(c) > 1).alias(f"cross_{c}") for c in columns]
    groups = keyed.groupBy(F.col(text).alias("key")).agg(F.count("*").alias("size"), *spread)
    twice = F.col("size") > 1
    found = groups.agg(
        F.count("*").alias("distinct_texts"), (F.count("*") / F.sum("size")).alias("unique_share"), F.sum(F.col("size") - 1).alias("excess_rows"), F.count_if(twice).alias("groups"),
        F.coalesce(F.sum(F.when(twice, F.col("size"))), F.lit(0)).alias("rows_in_groups"), F.max("size").alias("largest_group"),
        *[F.count_if(twice & F.col(f"cross_{c}")).alias(f"groups_cross_{c}") for c in columns],
        F.coalesce(F.sum(F.when(twice & F.col(f"cross_{label}"), F.col("size"))), F.lit(0)).alias(f"rows_cross_{label}"),
    )
    pairs = keyed.groupBy(text, state).agg(F.count("*").alias("n")).agg(F.count("*").alias("distinct_text_states"))
    return found.crossJoin(F.broadcast(pairs))


def review_packet(edges: DataFrame, per_type: int, seed: str, exactly: bool = False) -> DataFrame:
    """The ``per_type`` edges of each type that come first by a seeded hash, numbered; with ``exactly`` a type that has fewer ends the job."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), "edge_type", "left_id", "right_id").cast("binary"), 256)
    place = F.row_number().over(Window.partitionBy("edge_type").orderBy("order", "left_id", "right_id"))
    found = edges.withColumn("order", order).withColumn("place", place).where(F.col("place") <= per_type).drop("order")
    if exactly:
        short = found.groupBy("edge_type").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") == per_type).alias("full"))
        full = short.select(F.assert_true(F.col("full") == len(PRIORITY), F.lit("a type has too few edges to review")).alias("__ok"))
        found = found.crossJoin(F.broadcast(full)).where("__ok IS NULL").drop("__ok")
    return found.withColumn("packet_id", F.format_string("%s-%04d", F.col("edge_type"), F.col("place")))


def gates(checks: DataFrame, conditions: Sequence[tuple[str, Column]]) -> DataFrame:
    """(gate, passed) of one summary row; 'all' passes if every gate does."""
    entries: Iterator[Column] = (F.struct(F.lit(name).alias("gate"), c.alias("passed")) for name, c in conditions)
    everything = F.lit(True)
    for _, c in conditions:
        everything = everything & c
    return checks.select(F.explode(F.array(*entries, F.struct(F.lit("all").alias("gate"), everything.alias("passed")))).alias("g")).select("g.*")


def repair_candidates(records: DataFrame, crossing: DataFrame, families: DataFrame) -> DataFrame:
    """(family_id, n_rows, n_edges): the chosen families with their records and incident crossing edges.

    An edge counts once for a family that has both its ends. Edges reach families by a
    join, not by going through all edges for each.
    """
    edge = F.struct("left_id", "right_id", "edge_type")
    ends = crossing.select(edge.alias("e"), F.explode(F.array("left_family_id", "right_family_id")).alias("family_id")).where("family_id IS NOT NULL")
    edges = ends.distinct().groupBy("family_id").agg(F.count("*").alias("n_edges"))
    rows = records.where("family_id IS NOT NULL").groupBy("family_id").agg(F.count("*").alias("n_rows"))
    return families.select("family_id").distinct().join(rows, "family_id").join(edges, "family_id", "left").fillna(0, ["n_edges"])
