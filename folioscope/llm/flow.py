"""Min-cost flow on small graphs, by successive shortest paths."""

from __future__ import annotations

import math


class Flow:
    """Nodes are any hashable values. Capacities may be fractional; costs may be negative only on fresh edges without cycles."""

    def __init__(self) -> None:
        self.at: dict = {}
        self.out: list[list[int]] = []
        self.to: list[int] = []
        self.left: list[float] = []
        self.cost: list[float] = []

    def node(self, name) -> int:
        if name not in self.at:
            self.at[name] = len(self.out)
            self.out.append([])
        return self.at[name]

    def edge(self, a, b, capacity: float, cost: float = 0.0) -> int:
        i, j = self.node(a), self.node(b)
        for x, y, c, w in ((i, j, capacity, cost), (j, i, 0.0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def flow_of(self, edge: int) -> float:
        return self.left[edge + 1]

    def solve(self, source, sink, most: float = math.inf, eps: float = 1e-9) -> float:
        """Sends as much as there is room for, cheapest first; returns the amount."""
        s, t, sent = self.node(source), self.node(sink), 0.0
        while sent < most - eps:
            dist, via = [math.inf] * len(self.out), [-1] * len(self.out)
            dist[s], queue, queued = 0.0, [s], {s}
            while queue:
                x = queue.pop(0)
                queued.discard(x)
                for e in self.out[x]:
                    y = self.to[e]
                    if self.left[e] > eps and dist[x] + self.cost[e] < dist[y] - 1e-12:
                        dist[y], via[y] = dist[x] + self.cost[e], e
                        if y not in queued:
                            queued.add(y)
                            queue.append(y)
            if via[t] < 0:
                break
            path, x = [], t
            while x != s:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            push = min([most - sent, *(self.left[e] for e in path)])
            for e in path:
                self.left[e] -= push
                self.left[e ^ 1] += push
            sent += push
        return sent

    def reach(self, source, eps: float = 1e-6) -> set:
        """Names of the nodes to which more could be sent: the near side of the least cut after `solve`."""
        near, todo = {self.node(source)}, [self.node(source)]
        while todo:
            for e in self.out[todo.pop()]:
                if self.left[e] > eps and self.to[e] not in near:
                    near.add(self.to[e])
                    todo.append(self.to[e])
        return {name for name, i in self.at.items() if i in near}
