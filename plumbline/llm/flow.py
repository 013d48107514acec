"""A min-cost flow solver for small networks, by successive shortest paths."""

from __future__ import annotations

import heapq

INFINITE = 1 << 60


class Network:
    """A network with whole capacities and costs of zero or more."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        """Add an arc and its reverse; gives the number by which ``flow`` knows it."""
        number = len(self.to)
        for start, end, room, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[start].append(len(self.to))
            self.to.append(end)
            self.left.append(room)
            self.cost.append(price)
        return number

    def flow(self, number: int) -> int:
        """Flow on an arc."""
        return self.left[number + 1]

    def solve(self, source: int, sink: int) -> int:
        """Send as much as fits at least cost; gives the cost."""
        n = len(self.out)
        potential, total = [0] * n, 0
        while True:
            far = [INFINITE] * n
            came = [-1] * n
            far[source] = 0
            heap = [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for number in self.out[a]:
                    if not self.left[number]:
                        continue
                    b = self.to[number]
                    through = d + self.cost[number] + potential[a] - potential[b]
                    if through < far[b]:
                        far[b], came[b] = through, number
                        heapq.heappush(heap, (through, b))
            if far[sink] == INFINITE:
                return total
            for i in range(n):
                potential[i] += min(far[i], far[sink])
            amount, at = INFINITE, sink
            while at != source:
                amount = min(amount, self.left[came[at]])
                at = self.to[came[at] ^ 1]
            at = sink
            while at != source:
                self.left[came[at]] -= amount
                self.left[came[at] ^ 1] += amount
                total += amount * self.cost[came[at]]
                at = self.to[came[at] ^ 1]
