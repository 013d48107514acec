"""A heldout split of whole components with a given number of rows, as near as possible to the one there is.

Spark counts each component once; the choice itself is over components. Rows that newly
enter are least by an exact recurrence over sums of sizes. Components of equal size and
equal cost are one kind there, taken in powers of two, so it grows with the kinds and not
with the components, and no table of choices is kept: the sums are halved between two
halves of the kinds until their choices fit. Among choices of as many rows that is then
improved by exchanges of components of one kind: first the deviation from the suites'
targets, then that from the labels', then a seeded order. Components of one kind with
the same suites and labels differ in that order only and are exchanged as one. An
exchange never costs rows, so the first aim stays exact; the others are local optima.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums of the recurrence, which are all rows up to the target and the largest component (4 bytes each, a few arrays).
CELLS = 200_000_000
#: Choices that are kept at once (a byte each).
KEPT = 16_000_000


class _Lot(NamedTuple):
    """``count`` components of one kind, taken together."""

    kind: tuple[int, int]
    count: int

    @property
    def size(self) -> int:
        return self.kind[0] * self.count

    @property
    def cost(self) -> int:
        return self.kind[1] * self.count


def _lots(kinds: Mapping[tuple[int, int], int], top: int) -> list[_Lot]:
    """Any number of components of a kind, up to all, is a sum of its lots; those beyond ``top`` rows are left out."""
    lots = []
    for kind, count in sorted(kinds.items()):
        power = 1
        while count and power * kind[0] <= top:
            lots.append(_Lot(kind, min(power, count)))
            count -= lots[-1].count
            power *= 2
    return lots


def _least(lots: Sequence[_Lot], top: int, taken: np.ndarray | None = None) -> np.ndarray:
    """The least cost of each sum of sizes up to ``top``; ``taken`` gets which lots lower it."""
    kind = np.int32 if sum(lot.cost for lot in lots) < 2**30 else np.int64
    best = np.full(top + 1, 2**30 if kind is np.int32 else 2**62, dtype=kind)
    best[0] = reach = 0
    for i, lot in enumerate(lots):
        # No sum beyond ``reach`` has a choice yet.
        reach = min(top, reach + lot.size)
        if lot.size <= top:
            moved = best[: reach + 1 - lot.size] + kind(lot.cost)
            if taken is not None:
                np.less(moved, best[lot.size : reach + 1], out=taken[i, lot.size : reach + 1])
            np.minimum(best[lot.size : reach + 1], moved, out=best[lot.size : reach + 1])
    return best


def _unreached(best: np.ndarray) -> int:
    return 2**30 if best.dtype == np.int32 else 2**62


def _picked(lots: Sequence[_Lot], at: int) -> list[_Lot]:
    """Lots whose sizes add up to ``at`` at the least cost; some do."""
    if len(lots) * (at + 1) <= KEPT or len(lots) < 2:
        taken, chosen = np.zeros((len(lots), at + 1), dtype=bool), []
        _least(lots, at, taken)
        for i in range(len(lots) - 1, -1, -1):
            if taken[i, at]:
                chosen.append(lots[i])
                at -= lots[i].size
        return chosen
    halves = lots[::2], lots[1::2]
    left, right = (_least(half, at) for half in halves)
    both = left.astype(np.int64) + right[::-1]
    both[(left == _unreached(left)) | (right[::-1] == _unreached(right))] = np.iinfo(np.int64).max
    part = int(np.argmin(both))
    del left, right, both
    return _picked(halves[0], part) + _picked(halves[1], at - part)


def least_entering(sizes: Sequence[int], costs: Sequence[int], target: int) -> list[int]:
    """Positions whose sizes add up to ``target``, or as near as any do (the smaller of two), at the least sum of costs."""
    top = target + max(sizes, default=0)
    if top + 1 > CELLS:
        raise ValueError("too many rows for one recurrence")
    of_kind: dict[tuple[int, int], list[int]] = {}
    for i, kind in enumerate(zip(sizes, costs, strict=True)):
        if kind[0] > 0:
            of_kind.setdefault(kind, []).append(i)
    lots = _lots({kind: len(held) for kind, held in of_kind.items()}, top)
    best = _least(lots, top)
    reached = np.nonzero(best != _unreached(best))[0]
    away = np.abs(reached - target)
    at = int(reached[np.argmin(away)])  # the first, so the smaller of two as near
    del best, reached, away
    counts: Counter = Counter()
    for lot in _picked(lots, at):
        counts[lot.kind] += lot.count
    return sorted(i for kind, n in counts.items() for i in of_kind[kind][:n])


class _Kind:
    """Components of equal size and cost by their suites and labels, each of these profiles with its positions in the seeded order."""

    def __init__(self, at: Sequence[int], suites: np.ndarray, labels: np.ndarray, order: Sequence[int], chosen: set[int]) -> None:
        profiles: dict[bytes, list[int]] = {}
        for i in at:
            profiles.setdefault(suites[i].tobytes() + labels[i].tobytes(), []).append(i)
        self.at = [sorted(held, key=lambda i: (order[i], i)) for held in profiles.values()]
        first = [held[0] for held in self.at]
        self.suites, self.labels, self.order = suites[first], labels[first], order
        self.sizes = np.array([len(held) for held in self.at])
        self.taken = np.array([sum(i in chosen for i in held) for held in self.at])
        # The order of the next that would enter; of no use where all are taken.
        self.next = np.array([order[held[min(n, len(held) - 1)]] for held, n in zip(self.at, self.taken.tolist(), strict=True)], dtype=np.int64)

    def chosen(self) -> list[int]:
        return [i for held, n in zip(self.at, self.taken.tolist(), strict=True) for i in held[:n]]

    def _take(self, profile: int, change: int) -> None:
        self.taken[profile] += change
        held = self.at[profile]
        self.next[profile] = self.order[held[min(int(self.taken[profile]), len(held) - 1)]]

    def improve(self, over_suites: np.ndarray, over_labels: np.ndarray) -> bool:
        """Exchange while that lowers the deviations (suites, labels) or else the order; both arrays hold chosen rows less those aimed at and are changed."""
        better = False
        if len(self.at) < 2:
            return better
        for out in np.nonzero(self.taken)[0].tolist():
            while self.taken[out]:
                into = np.nonzero(self.taken < self.sizes)[0]
                into = into[into != out]
                if not len(into):
                    break
                now = _total(over_suites), _total(over_labels), 0
                of_suites = _total(over_suites - self.suites[out] + self.suites[into])
                into = into[of_suites == of_suites.min()]
                of_labels = _total(over_labels - self.labels[out] + self.labels[into])
                into = into[of_labels == of_labels.min()]
                to = int(into[np.argmin(self.next[into])])
                tie = int(self.next[to]) - self.order[self.at[out][int(self.taken[out]) - 1]]
                if (float(of_suites.min()), float(of_labels.min()), tie) >= now:
                    break
                over_suites += self.suites[to] - self.suites[out]
                over_labels += self.labels[to] - self.labels[out]
                self._take(out, -1)
                self._take(to, 1)
                better = True
        return better


def _total(over: np.ndarray) -> np.ndarray:
    """Sums of absolute deviations, alike where only rounding differs."""
    return np.abs(over).sum(axis=-1).round(9)


def _table(components: Sequence[Mapping], name: str, targets: Mapping[str, float]) -> np.ndarray:
    """Rows of each component with each value that has a target."""
    place = {value: k for k, value in enumerate(sorted(targets))}
    table = np.zeros((len(components), len(place)), dtype=np.int64)
    for i, c in enumerate(components):
        for value, n in c[name].items():
            if value in place:
                table[i, place[value]] = n
    return table


def choose(components: Sequence[Mapping], target: int, suites: Mapping[str, float], labels: Mapping[str, float], seed: int) -> list[int]:
    """Positions of the components that make the heldout split; each has n, n_held, suites and labels (counts by name)."""
    sizes, costs = [c["n"] for c in components], [c["n"] - c["n_held"] for c in components]
    chosen = set(least_entering(sizes, costs, target))
    order = [int(hashlib.sha256(f"{seed}|{c['component']}".encode()).hexdigest()[:12], 16) for c in components]
    of_suites, of_labels = _table(components, "suites", suites), _table(components, "labels", labels)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, key in enumerate(zip(sizes, costs, strict=True)):
        alike.setdefault(key, []).append(i)
    kinds = [_Kind(at, of_suites, of_labels, order, chosen) for at in alike.values()]
    now = np.array([i for kind in kinds for i in kind.chosen()], dtype=np.int64)
    over_suites = of_suites[now].sum(axis=0) - np.array([suites[k] for k in sorted(suites)], dtype=float)
    over_labels = of_labels[now].sum(axis=0) - np.array([labels[k] for k in sorted(labels)], dtype=float)
    while any([kind.improve(over_suites, over_labels) for kind in kinds]):
        pass
    return sorted(i for kind in kinds for i in kind.chosen())


def resplit(rows: DataFrame, component: str, split: str, suite: str, label: str, share: float, seed: int, held: str = "heldout", kept: str = "development") -> DataFrame:
    """(component, n, split_name): every component with its new split; ``held`` gets ``share`` of the rows, or the nearest that whole components give.

    Suites and labels are to be spread over both splits alike. Rows without a component
    stay out. An empty table gives an empty result. One row a component reaches the driver.
    """
    named = rows.where(F.col(component).isNotNull()).select(F.col(component).alias("component"), F.col(split).eqNullSafe(F.lit(held)).alias("h"), F.coalesce(F.col(suite), F.lit("")).alias("s"), F.coalesce(F.col(label), F.lit("")).alias("l"))
    cells = named.groupBy("component", "s", "l").agg(F.count("*").alias("n"), F.count_if("h").alias("h"))
    counted = cells.groupBy("component").agg(F.sum("n").alias("n"), F.sum("h").alias("n_held"), F.collect_list(F.struct("s", "l", "n")).alias("cells")).orderBy("component").collect()
    components, whole_suites, whole_labels = [], Counter(), Counter()
    for r in counted:
        suites, labels = Counter(), Counter()
        for c in r["cells"]:
            suites[c.s] += c.n
            labels[c.l] += c.n
        whole_suites.update(suites)
        whole_labels.update(labels)
        components.append({"component": r.component, "n": r.n, "n_held": r.n_held, "suites": suites, "labels": labels})
    target = round(share * sum(c["n"] for c in components))
    chosen = set(choose(components, target, {k: v * share for k, v in whole_suites.items()}, {k: v * share for k, v in whole_labels.items()}, seed))
    kind = rows.schema[component].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(c["component"], c["n"], held if i in chosen else kept) for i, c in enumerate(components)], f"component {kind}, n long, split_name string")
