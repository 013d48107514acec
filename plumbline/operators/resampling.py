"""Confidence intervals from component-clustered resampling.

Rows are reduced to one row of counts per component first; a replicate is a bag of
components, as many as there are, drawn with replacement. The counts are small beside the
rows they come from: up to CELLS of them are broadcast, and each task draws a range of
replicates and multiplies multiplicities with counts as matrices. Beyond that bound the
draws are rows that are joined to the counts; both give the same numbers.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from plumbline.operators.scoring import metric_columns, rate_columns
from plumbline.scratch import Scratch

RATES = ("accuracy", "macro_f1", "invalid_rate", "unsafe_rate", "denial_rate", "non_answer_rate")
#: Counts (components x groups x columns) that may be broadcast: 64 MB.
CELLS = 8_000_000
#: Draws held at once by a task.
HELD = 4_000_000
Seed = int | Callable[[Row], int] | None


def placed(keys: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """Distinct ``key`` values with their place from 0 in sorted order.

    Sorted by range, numbered within each partition, and shifted by the sizes of the
    partitions before it, so no task sees more than its range.
    """
    ordered = keys.select(key).distinct().repartitionByRange(key).withColumn("part", F.spark_partition_id())
    ordered = scratch.save(ordered, "ordered")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(key))
    return ordered.join(sizes, "part").select(key, (F.col("before") + inside - 1).alias("place"))


class HashedDraws:
    """Slot s of replicate r draws the first 8 hex digits of md5("r:s"), modulo n: any engine can repeat it."""

    def __init__(self, n: int) -> None:
        self.n = n

    def take(self, first: int, last: int) -> np.ndarray:
        """Places of the replicates from ``first`` to before ``last``, one row each."""
        md5, n = hashlib.md5, self.n
        raw = b"".join(md5(b"%d:%d" % (r, s)).digest()[:4] for r in range(first, last) for s in range(n))
        return (np.frombuffer(raw, dtype=">u4").astype(np.int64) % n).reshape(last - first, n)


class SeededDraws:
    """The draws of ``random.Random(seed).choice`` in the order a sequential program makes them.

    Python's generator and numpy's are the same twister, so its raw numbers come in
    blocks; a task that starts later passes over what comes before.
    """

    def __init__(self, n: int, seed: int) -> None:
        key = random.Random(seed).getstate()[1]  # noqa: S311
        self.raw = np.random.MT19937()
        self.raw.state = {"bit_generator": "MT19937", "state": {"key": np.array(key[:-1], dtype=np.uint32), "pos": key[-1]}}
        self.n, self.shift, self.at = n, 32 - n.bit_length(), 0
        self.rest = np.zeros(0, dtype=np.int64)

    def _next(self, wanted: int) -> np.ndarray:
        parts, have = [self.rest], len(self.rest)
        while have < wanted:
            found = (self.raw.random_raw(max(1024, 2 * (wanted - have))) >> np.uint64(self.shift)).astype(np.int64)
            found = found[found < self.n]
            parts.append(found)
            have += len(found)
        whole = np.concatenate(parts)
        self.rest = whole[wanted:]
        return whole[:wanted]

    def take(self, first: int, last: int) -> np.ndarray:
        """As ``HashedDraws.take``; replicates must be asked for in order."""
        while self.at < first:
            step = min(first - self.at, max(1, HELD // self.n))
            self._next(step * self.n)
            self.at += step
        self.at = last
        return self._next((last - first) * self.n).reshape(last - first, self.n)


def _draws(n: int, seed: int | None) -> HashedDraws | SeededDraws:
    return HashedDraws(n) if seed is None else SeededDraws(n, seed)


def _multiplying(groups: object, width: int):
    """(g, replicate, s0...): the column sums of every group in each replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers: dict[tuple[int, int | None], HashedDraws | SeededDraws] = {}
        most = max((len(table) for table, _ in groups.value), default=1)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for start in range(0, len(ids), max(1, HELD // most)):
                part = ids[start : start + max(1, HELD // most)]
                first, last = int(part[0]), int(part[-1]) + 1
                bags: dict[tuple[int, int | None], np.ndarray] = {}
                out: list[list[np.ndarray]] = [[] for _ in range(width + 2)]
                for g, (table, seed) in enumerate(groups.value):
                    key = (len(table), seed)
                    if key not in bags:
                        maker = makers.setdefault(key, None) or _draws(*key)
                        makers[key] = maker
                        places = maker.take(first, last) + np.arange(last - first)[:, None] * key[0]
                        bags[key] = np.bincount(places.ravel(), minlength=(last - first) * key[0]).reshape(-1, key[0]).astype(np.float64)
                    # Exact: all sums are whole and far below 2^53.
                    sums = np.rint(bags[key] @ table).astype(np.int64)
                    out[0].append(np.full(last - first, g, dtype=np.int64))
                    out[1].append(part.astype(np.int64))
                    for i in range(width):
                        out[i + 2].append(sums[:, i])
                arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, dtype=np.int64)) for c in out]
                yield pa.RecordBatch.from_arrays(arrays, names=["g", "replicate", *[f"s{i}" for i in range(width)]])

    return run


def _drawing(sizes: object):
    """(g, replicate, place, multiplicity) of every group, for draws that are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = [_draws(n, seed) for n, seed in sizes.value]
        for batch in batches:
            for replicate in batch.column("id").to_pylist():
                for g, maker in enumerate(makers):
                    places, times = np.unique(maker.take(replicate, replicate + 1), return_counts=True)
                    n = len(places)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, g)), pa.array(np.full(n, replicate)), pa.array(places), pa.array(times.astype(np.int64))], names=["g", "replicate", "place", "multiplicity"]
                    )

    return run


def replicate_sums(
    counts: DataFrame, by: Sequence[str], names: Sequence[str], component: str, replicates: int, scratch: Scratch, seed: Seed = None, own: bool = False, cells: int = CELLS
) -> DataFrame:
    """(by..., replicate, names...): the sums of every group in each replicate, from one row of counts per (by, component).

    With ``own`` each group draws among its own components, else all among all, on shared
    draws. ``seed`` is one number, or a function of a group's row; without it draws are
    hashed. Groups are few (systems, methods): they are listed on the driver.
    """
    spark, by, names = counts.sparkSession, list(by), list(names)
    counts = scratch.save(counts.select(*by, F.col(component).alias("__c"), *[F.col(c).cast("long").alias(c) for c in names]), "counts")
    groups = counts.groupBy(*by).agg(F.count("*").alias("__n")).orderBy(*by).collect() if by else [r for r in counts.agg(F.count("*").alias("__n")).collect() if r["__n"]]
    fields = ", ".join([f"`{c}` {t}" for c, t in counts.select(*by).dtypes] + ["g long"])
    listed = spark.createDataFrame([(*[r[c] for c in by], g) for g, r in enumerate(groups)], fields)
    seeds = [seed(r) if callable(seed) else seed for r in groups]
    if own and by:
        numbered = counts.withColumn("place", (F.row_number().over(Window.partitionBy(*by).orderBy("__c")) - 1).cast("long"))
        sizes = [r["__n"] for r in groups]
    else:
        places = scratch.save(placed(counts, "__c", scratch), "places")
        numbered, n = counts.join(places, "__c"), places.count()
        sizes = [n] * len(groups)
    same = F.lit(True)
    for c in by:
        same = same & numbered[c].eqNullSafe(listed[c])
    numbered = numbered.join(F.broadcast(listed), same).select("g", "place", *names)
    ids = spark.range(0, replicates, 1, max(1, min(replicates, spark.sparkContext.defaultParallelism)))
    if sum(sizes) * len(names) <= cells:
        tables = [np.zeros((size, len(names)), dtype=np.float64) for size in sizes]
        for r in numbered.collect():
            tables[r.g][r.place] = r[2:]
        shared = spark.sparkContext.broadcast(list(zip(tables, seeds, strict=True)))
        schema = ", ".join(["g long", "replicate long", *[f"s{i} long" for i in range(len(names))]])
        sums = ids.mapInArrow(_multiplying(shared, len(names)), schema)
        sums = sums.select("g", "replicate", *[F.col(f"s{i}").alias(c) for i, c in enumerate(names)])
    else:
        shared = spark.sparkContext.broadcast(list(zip(sizes, seeds, strict=True)))
        draws = ids.mapInArrow(_drawing(shared), "g long, replicate long, place long, multiplicity long")
        joined = numbered.join(draws, ["g", "place"])
        sums = joined.groupBy("g", "replicate").agg(*[F.sum(F.col(c) * F.col("multiplicity")).alias(c) for c in names])
    return sums.join(F.broadcast(listed), "g").select(*by, "replicate", *names)


def component_counts(rows: DataFrame, by: Sequence[str], component: str = "component_id") -> DataFrame:
    """The metric counts of each component, one row per (by, component)."""
    return rows.groupBy(*by, component).agg(*metric_columns())


def intervals(replicates: DataFrame, by: Sequence[str], rates: Sequence[str]) -> DataFrame:
    """95% percentile intervals with linear interpolation, one row per rate; null replicates are left out and counted."""
    ends = F.array(F.lit(0.025), F.lit(0.975))
    entries = replicates.select(*by, F.explode(F.create_map(*[x for r in rates for x in (F.lit(r), F.col(r))])).alias("rate", "value"))
    grouped = entries.groupBy(*by, "rate").agg(F.percentile("value", ends).alias("q"), F.count("value").alias("n_valid"))
    return grouped.select(*by, "rate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n_valid")


def _metric_replicates(rows: DataFrame, by: Sequence[str], replicates: int, scratch: Scratch, seed: Seed, own: bool) -> DataFrame:
    counts = component_counts(rows, by)
    names = [c for c in counts.columns if c not in (*by, "component_id")]
    return replicate_sums(counts, by, names, "component_id", replicates, scratch, seed, own).select(*by, "replicate", *rate_columns())


def metric_intervals(rows: DataFrame, by: Sequence[str], replicates: int, scratch: Scratch, seed: Seed = None) -> DataFrame:
    """Intervals of the six rates for each ``by``, each group on draws among its own components. An empty input gives an empty result."""
    return intervals(_metric_replicates(rows, by, replicates, scratch, seed, own=True), by, RATES)


def _difference(each: DataFrame, by: Sequence[str], system: str, left: str, right: str, rates: Sequence[str]) -> DataFrame:
    """Right minus left of every rate in each replicate; null where either is."""
    sides = [F.max(F.when(F.col(system) == name, F.col(r))).alias(f"{r}_{i}") for r in rates for i, name in enumerate((left, right))]
    wide = each.groupBy(*by, "replicate").agg(*sides)
    return wide.select(*by, "replicate", *[(F.col(f"{r}_1") - F.col(f"{r}_0")).alias(r) for r in rates])


def paired_intervals(rows: DataFrame, system: str, left: str, right: str, replicates: int, scratch: Scratch, seed: Seed = None) -> DataFrame:
    """Intervals of right minus left for the six rates of two systems on shared draws."""
    each = _metric_replicates(rows.where(F.col(system).isin(left, right)), [system], replicates, scratch, seed, own=False)
    return intervals(_difference(each, [], system, left, right, RATES), [], RATES)


Flags = Sequence[tuple[str, str | None]]


def _flag_counts(rows: DataFrame, by: Sequence[str], flags: Flags, component: str) -> DataFrame:
    sums = []
    for numerator, denominator in flags:
        base = F.lit(1).cast("long") if denominator is None else F.col(denominator).cast("long")
        sums += [F.sum(F.col(numerator).cast("long") * base).alias(f"a_{numerator}"), F.sum(base).alias(f"b_{numerator}")]
    return rows.groupBy(*by, component).agg(*sums)


def _flag_rates(flags: Flags) -> list[Column]:
    return [(F.col(f"a_{f}") / F.nullif(F.col(f"b_{f}"), F.lit(0))).alias(f) for f, _ in flags]


def clustered_rate_intervals(
    rows: DataFrame, by: Sequence[str], flags: Flags, replicates: int, scratch: Scratch, seed: Seed = None, own: bool = False, component: str = "component_id"
) -> DataFrame:
    """Rates of 0/1 columns over components with intervals.

    ``flags`` are pairs (numerator, denominator); without a denominator all rows count. A
    replicate whose denominator is zero is invalid: left out and counted in ``n_valid``.
    With items in place of components this is the bootstrap over items.
    """
    counts = scratch.save(_flag_counts(rows, by, flags, component), "counts")
    names = [f"{x}_{f}" for f, _ in flags for x in "ab"]
    drawn = replicate_sums(counts, by, names, component, replicates, scratch, seed, own)
    found = intervals(drawn.select(*by, "replicate", *_flag_rates(flags)), by, [f for f, _ in flags])
    total = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])
    points = F.create_map(*[x for f, _ in flags for x in (F.lit(f), F.struct(F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")))])
    point = total.select(*by, F.explode(points).alias("rate", "p"))
    point = point.select(*by, "rate", F.col("p.a").alias("numerator"), F.col("p.b").alias("denominator"), (F.col("p.a") / F.nullif(F.col("p.b"), F.lit(0))).alias("point"))
    same = F.lit(True)
    for c in (*by, "rate"):
        same = same & point[c].eqNullSafe(found[c])
    return point.join(found, same).select(*[point[c] for c in (*by, "rate")], "numerator", "denominator", "point", "low", "high", "n_valid")


def paired_rate_intervals(rows: DataFrame, by: Sequence[str], system: str, left: str, right: str, flags: Flags, replicates: int, scratch: Scratch, seed: Seed = None) -> DataFrame:
    """Intervals of right minus left for rates of 0/1 columns, all cells on shared draws; a replicate without either rate is invalid."""
    rows = rows.where(F.col(system).isin(left, right))
    counts = _flag_counts(rows, [system, *by], flags, "component_id")
    names = [f"{x}_{f}" for f, _ in flags for x in "ab"]
    each = replicate_sums(counts, [system, *by], names, "component_id", replicates, scratch, seed).select(system, *by, "replicate", *_flag_rates(flags))
    return intervals(_difference(each, by, system, left, right, [f for f, _ in flags]), by, [f for f, _ in flags])
