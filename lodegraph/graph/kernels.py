"""Whole-graph algorithms on one graph held in memory: nodes 0..n-1 and adjacency as lists of sorted successors. All are iterative."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterable


def adjacency(n: int, edges: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[set[int]] = [set() for _ in range(n)]
    for a, b in edges:
        out[a].add(b)
    return [sorted(s) for s in out]


def reverse(adj: list[list[int]]) -> list[list[int]]:
    return adjacency(len(adj), ((b, a) for a, bs in enumerate(adj) for b in bs))


def degrees(adj: list[list[int]]) -> tuple[list[int], list[int]]:
    """(in, out) over distinct successors; a self-loop counts once each way."""
    incoming = [0] * len(adj)
    for bs in adj:
        for b in bs:
            incoming[b] += 1
    return incoming, [len(bs) for bs in adj]


class Tree:
    """What a breadth-first search found: order without the starts, depth and parent by node, and whether the node limit cut it."""

    def __init__(self):
        self.order: list[int] = []
        self.depth: dict[int, int] = {}
        self.parent: dict[int, int] = {}
        self.truncated = False

    def path_to(self, node: int) -> list[int] | None:
        if node not in self.depth:
            return None
        path = [node]
        while path[-1] in self.parent:
            path.append(self.parent[path[-1]])
        return path[::-1]


def bfs(adj: list[list[int]], starts: Iterable[int], max_depth: int | None = None, max_nodes: int | None = None) -> Tree:
    """Level by level: the nodes of a level in order of their parents, each under the first parent that leads to it."""
    t = Tree()
    level = list(dict.fromkeys(starts))
    t.depth = dict.fromkeys(level, 0)
    depth = 0
    while level and not t.truncated and (max_depth is None or depth < max_depth):
        depth += 1
        new: dict[int, int] = {}
        for a in level:
            for b in adj[a]:
                if b not in t.depth:
                    new.setdefault(b, a)
        level = list(new)
        if max_nodes is not None and len(t.order) + len(level) > max_nodes:
            t.truncated, level = True, level[: max_nodes - len(t.order)]
        t.order += level
        for b in level:
            t.depth[b], t.parent[b] = depth, new[b]
    return t


def shortest_path(adj: list[list[int]], a: int, b: int) -> list[int] | None:
    return bfs(adj, [a]).path_to(b)


def components(adj: list[list[int]]) -> list[list[int]]:
    """Strongly connected components, sinks first, members sorted."""
    n = len(adj)
    index, low, on, stack, out, count = [-1] * n, [0] * n, bytearray(n), [], [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, 0)]
        while work:
            a, i = work.pop()
            if i == 0:
                index[a] = low[a] = count
                count += 1
                stack.append(a)
                on[a] = 1
            descended = False
            successors = adj[a]
            while i < len(successors):
                b = successors[i]
                i += 1
                if index[b] < 0:
                    work.append((a, i))
                    work.append((b, 0))
                    descended = True
                    break
                if on[b] and index[b] < low[a]:
                    low[a] = index[b]
            if descended:
                continue
            if low[a] == index[a]:
                member = -1
                part = []
                while member != a:
                    member = stack.pop()
                    on[member] = 0
                    part.append(member)
                out.append(sorted(part))
            if work and low[a] < low[work[-1][0]]:
                low[work[-1][0]] = low[a]
    return out


def cyclic_components(adj: list[list[int]]) -> list[list[int]]:
    """Components with a cycle, larger ones first, then by smallest member."""
    found = [c for c in components(adj) if len(c) > 1 or c[0] in adj[c[0]]]
    return sorted(found, key=lambda c: (-len(c), c[0]))


def shortest_cycle(adj: list[list[int]], component: list[int]) -> list[int]:
    """A shortest cycle through the smallest member of a cyclic component, from that member on."""
    first, inside = component[0], set(component)
    if first in adj[first]:
        return [first]
    within = [[b for b in bs if b in inside] if a in inside else [] for a, bs in enumerate(adj)]
    tree = bfs(within, within[first])
    path = tree.path_to(first)
    return [first, *path[:-1]] if path else [first]


def topological(adj: list[list[int]]) -> tuple[list[int] | None, list[list[int]]]:
    """(order with the smallest ready node first, []), or (None, cyclic components)."""
    incoming, _ = degrees(adj)
    ready = [a for a, k in enumerate(incoming) if not k]
    heapq.heapify(ready)
    order = []
    while ready:
        a = heapq.heappop(ready)
        order.append(a)
        for b in adj[a]:
            incoming[b] -= 1
            if not incoming[b]:
                heapq.heappush(ready, b)
    return (order, []) if len(order) == len(adj) else (None, cyclic_components(adj))


def layers(adj: list[list[int]]) -> list[int]:
    """Longest chain of dependencies below each node's component; members of a cycle share it."""
    at, of = [0] * len(adj), {}
    for i, part in enumerate(components(adj)):
        for a in part:
            of[a] = i
        layer = max((at[b] + 1 for a in part for b in adj[a] if of[b] != i), default=0)
        for a in part:
            at[a] = layer
    return at


def betweenness(adj: list[list[int]], sources: Iterable[int] | None = None) -> list[float]:
    """Shares of shortest paths through each node, directed, not normalised, over the given sources (all by default)."""
    n = len(adj)
    score = [0.0] * n
    for s in range(n) if sources is None else sources:
        if not adj[s]:
            continue
        dist, sigma, order, before = {s: 0}, {s: 1.0}, [], {}
        queue = deque([s])
        while queue:
            a = queue.popleft()
            order.append(a)
            for b in adj[a]:
                if b not in dist:
                    dist[b] = dist[a] + 1
                    queue.append(b)
                if dist[b] == dist[a] + 1:
                    sigma[b] = sigma.get(b, 0.0) + sigma[a]
                    before.setdefault(b, []).append(a)
        delta = dict.fromkeys(order, 0.0)
        for b in reversed(order):
            for a in before.get(b, ()):
                delta[a] += sigma[a] / sigma[b] * (1 + delta[b])
            if b != s:
                score[b] += delta[b]
    return score
