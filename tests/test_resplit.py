"""A heldout split of whole components against all choices."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from plumbline.operators import resplit


@pytest.mark.parametrize("seed", range(6))
def test_least_entering_against_all_choices(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 12) for _ in range(9)]
    costs = [rng.randrange(n + 1) for n in sizes]
    target = rng.randrange(5, 40)
    choices = [c for k in range(10) for c in itertools.combinations(range(9), k)]
    best = min((abs(sum(sizes[i] for i in c) - target), sum(sizes[i] for i in c), sum(costs[i] for i in c)) for c in choices)
    found = resplit.least_entering(sizes, costs, target)
    assert (abs(sum(sizes[i] for i in found) - target), sum(sizes[i] for i in found), sum(costs[i] for i in found)) == best


def test_exchanges_only_improve():
    rng = random.Random(3)
    parts = [{"component": f"c{i}", "n": 4, "n_held": 2, "suites": {s: 4}, "labels": {rng.choice("AB"): 4}} for i, s in enumerate("xxxxxyyyyy")]
    chosen = resplit.choose(parts, 16, {"x": 8, "y": 8}, {"A": 8, "B": 8}, 1)
    assert len(chosen) == 4 and sorted(parts[i]["suites"] == {"x": 4} for i in chosen) == [False, False, True, True]
    assert chosen == resplit.choose(parts, 16, {"x": 8, "y": 8}, {"A": 8, "B": 8}, 1)


def test_resplit_of_rows(spark):
    rng = random.Random(5)
    rows = [(f"c{rng.randrange(40):02d}" if rng.random() < 0.95 else None, rng.choice(["heldout", "development", None]), rng.choice("st"), rng.choice(["A", "B", None])) for _ in range(600)]
    df = spark.createDataFrame(rows, "c string, split string, suite string, label string")
    found = resplit.resplit(df, "c", "split", "suite", "label", 0.2, 7).collect()
    sizes = {}
    for c, *_ in rows:
        if c:
            sizes[c] = sizes.get(c, 0) + 1
    assert {r.component: r.n for r in found} == sizes
    assert sum(r.n for r in found if r.split_name == "heldout") == round(0.2 * sum(sizes.values()))
    assert resplit.resplit(df.limit(0), "c", "split", "suite", "label", 0.2, 7).count() == 0
    with pytest.raises(ValueError, match="too many"):
        resplit.least_entering([10**9], [1], 5)


def test_least_entering_of_many_components(monkeypatch):
    """More components than a table of all their choices would hold (F2), against the recurrence by component."""
    rng = random.Random(11)
    sizes = [2000, *(rng.randrange(1, 9) for _ in range(30_000))]
    costs = [rng.choice([0, n // 2, n]) for n in sizes]
    target = round(0.2 * sum(sizes))
    best = np.full(target + 1, 10**9)
    best[0] = 0
    for n, cost in zip(sizes, costs, strict=True):
        best[n:] = np.minimum(best[n:], best[:-n] + cost)
    for kept in (resplit.KEPT, 1):
        monkeypatch.setattr(resplit, "KEPT", kept)
        found = resplit.least_entering(sizes, costs, target)
        assert len(set(found)) == len(found)
        assert (sum(sizes[i] for i in found), sum(costs[i] for i in found)) == (target, best[target])


@pytest.mark.parametrize("seed", range(4))
def test_no_exchange_improves_the_choice(seed):
    rng = random.Random(seed)
    parts = []
    for i in range(60):
        n = rng.randrange(1, 4)
        rows = [(rng.choice("xyz"), rng.choice("AB")) for _ in range(n)]
        parts.append({"component": f"c{i}", "n": n, "n_held": rng.randrange(2) * n, "suites": Counter(r[0] for r in rows), "labels": Counter(r[1] for r in rows)})
    aims = [{k: 0.3 * v for k, v in sum((p[name] for p in parts), Counter()).items()} for name in ("suites", "labels")]
    target = round(0.3 * sum(p["n"] for p in parts))
    chosen = set(resplit.choose(parts, target, *aims, 7))
    order = [int(hashlib.sha256(f"7|{p['component']}".encode()).hexdigest()[:12], 16) for p in parts]

    def worth(held):
        sums = [sum((parts[i][name] for i in held), Counter()) for name in ("suites", "labels")]
        return *(round(sum(abs(got[k] - want) for k, want in aim.items()), 9) for got, aim in zip(sums, aims, strict=True)), sum(order[i] for i in held)

    kind = [(p["n"], p["n_held"]) for p in parts]
    others = [chosen - {i} | {j} for i in chosen for j in range(60) if j not in chosen and kind[i] == kind[j]]
    assert sum(parts[i]["n"] for i in chosen) == target and others
    assert all(worth(chosen) <= worth(x) for x in others)
