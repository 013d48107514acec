"""Groups from pairwise links, by repeated low-diameter decomposition.

Each level draws for every vertex an exponentially distributed head start, seeded by a
hash of its id, and lets clusters grow along links for a fixed number of hops; a vertex
belongs to whichever centre reaches it first. Clusters then contract to super-vertices,
links between clusters are the next level's graph, and the assignments of all levels are
composed from the last to the first. Every level joins and aggregates over rows that
shrink geometrically; the number of levels grows with the logarithm of the number of
vertices, whatever the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.scratch import Scratch

#: Mean head start in hops is 1 / RATE; growth stops after HOPS. Both only change how much
#: one level contracts, not the result.
RATE = 0.1
HOPS = 3


def _both_ways(links: DataFrame) -> DataFrame:
    turned = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return links.select("src", "dst").unionAll(turned).where("src <> dst").distinct()


def _grow(edges: DataFrame, level: int) -> DataFrame:
    """(v, center): one level's assignment of every vertex of symmetric ``edges``."""
    # 53 hash bits as a number in (0, 1].
    uniform = (F.shiftrightunsigned(F.xxhash64("v", F.lit(level), F.lit("start")), 11) + 1) / F.lit(float(2**53))
    reached = (
        edges.select(F.col("src").alias("v"))
        .distinct()
        .select("v", F.struct((F.log(uniform) / RATE).alias("at"), F.col("v").alias("center")).alias("first"))
    )
    for _ in range(HOPS):
        step = F.struct((F.col("first.at") + 1).alias("at"), F.col("first.center").alias("center"))
        sent = edges.join(reached, F.col("src") == F.col("v")).select(F.col("dst").alias("v"), step.alias("first"))
        reached = reached.unionAll(sent).groupBy("v").agg(F.min("first").alias("first"))
    return reached.select("v", F.col("first.center").alias("center"))


def components(links: DataFrame, left: str, right: str, scratch: Scratch) -> DataFrame:
    """(id, group_id): every id with a link to another, and the smallest id of its group.

    Links with a null end or equal ends say nothing and are ignored; repeated and turned
    links count once. An empty table gives an empty result. Ids of any orderable type
    will do; other columns are not read.
    """
    links = links.select(F.col(left).alias("src"), F.col(right).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    edges = scratch.save(_both_ways(links), "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        assigned = scratch.save(_grow(edges, len(levels)), "assigned")
        of_src = assigned.select(F.col("v").alias("src"), F.col("center").alias("c1"))
        of_dst = assigned.select(F.col("v").alias("dst"), F.col("center").alias("c2"))
        # A turned copy of each link exists, so one direction is enough here.
        between = (
            edges.where("src < dst")
            .join(of_src, "src")
            .join(of_dst, "dst")
            .where("c1 <> c2")
            .select(F.col("c1").alias("src"), F.col("c2").alias("dst"))
        )
        # Growth that stops after HOPS may leave a centre inside another cluster.
        captured = (
            assigned.where("v <> center")
            .join(assigned.select(F.col("center").alias("v")).distinct(), "v", "left_semi")
            .select(F.col("v").alias("src"), F.col("center").alias("dst"))
        )
        levels.append(assigned)
        rest = scratch.save(_both_ways(between.unionAll(captured)), "edges")
        scratch.drop(edges)
        edges = rest
    if not levels:
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("group_id"))
    composed = levels[-1].select("v", F.col("center").alias("root"))
    for assigned in reversed(levels[:-1]):
        upper = composed.withColumnRenamed("v", "center")
        composed = assigned.join(upper, "center", "left").select("v", F.coalesce("root", "center").alias("root"))
    composed = scratch.save(composed, "composed")
    scratch.drop(edges, *levels)
    smallest = composed.groupBy("root").agg(F.min("v").alias("group_id"))
    return composed.join(smallest, "root").select(F.col("v").alias("id"), "group_id")
