"""In-memory graph algorithms against plain definitions, on random graphs."""

from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.graph import kernels

NODES = 6
graphs = st.sets(st.tuples(st.integers(0, NODES - 1), st.integers(0, NODES - 1)), max_size=14).map(lambda e: (sorted(e), kernels.adjacency(NODES, e)))
fast = settings(max_examples=60, deadline=None)


def distances(edges, start):
    """By relaxing every edge until nothing changes."""
    d = {start: 0}
    for _ in range(NODES):
        for a, b in edges:
            if a in d and d[a] + 1 < d.get(b, NODES + 1):
                d[b] = d[a] + 1
    return d


@fast
@given(graphs, st.integers(0, NODES - 1), st.integers(0, NODES), st.integers(0, NODES))
def test_search(graph, start, depth, most):
    edges, adj = graph
    want = distances(edges, start)
    whole = kernels.bfs(adj, [start])
    assert whole.depth == want and not whole.truncated
    assert [want[n] for n in whole.order] == sorted(want[n] for n in whole.order) and start not in whole.order
    for n in whole.order:
        path = whole.path_to(n)
        assert path[0] == start and path[-1] == n and len(path) == want[n] + 1 and all(p in set(edges) for p in zip(path, path[1:]))
        assert whole.parent[n] == min((a for a in [start, *whole.order] if (a, n) in edges and want[a] == want[n] - 1), key=[start, *whole.order].index)
    cut = kernels.bfs(adj, [start], max_depth=depth, max_nodes=most)
    within = [n for n in whole.order if want[n] <= depth]
    assert cut.order == within[:most] and cut.truncated == (len(within) > most)
    for goal in range(NODES):
        path = kernels.shortest_path(adj, start, goal)
        assert (path is None) == (goal not in want) and (path is None or len(path) == want[goal] + 1)


@fast
@given(graphs)
def test_components(graph):
    edges, adj = graph
    reach = [distances(edges, a) for a in range(NODES)]
    want = {tuple(b for b in range(NODES) if b in reach[a] and a in reach[b]) for a in range(NODES)}
    found = kernels.components(adj)
    assert {tuple(c) for c in found} == want and sum(map(len, found)) == NODES
    for i, part in enumerate(found):
        assert all(found.index(other) <= i for a, b in edges if a in part for other in found if b in other)
    cyclic = kernels.cyclic_components(adj)
    assert {tuple(c) for c in cyclic} == {c for c in want if len(c) > 1 or (c[0], c[0]) in edges} and [len(c) for c in cyclic] == sorted(map(len, cyclic), reverse=True)
    for part in cyclic:
        loop = kernels.shortest_cycle(adj, part)
        lengths = [distances(edges, b)[part[0]] + 1 for b in adj[part[0]] if part[0] in distances(edges, b)]
        assert loop[0] == part[0] and len(loop) == min(lengths) and all(p in set(edges) for p in zip(loop, [*loop[1:], loop[0]]))


@fast
@given(graphs)
def test_orders_and_layers(graph):
    edges, adj = graph
    valid = [p for p in permutations(range(NODES)) if all(p.index(a) < p.index(b) for a, b in edges)]
    order, cycles = kernels.topological(adj)
    assert order == (list(min(valid)) if valid else None) and bool(cycles) == (not valid)
    layer = kernels.layers(adj)
    reach = [distances(edges, a) for a in range(NODES)]
    same = lambda a, b: b in reach[a] and a in reach[b]
    for a in range(NODES):
        below = [layer[b] + 1 for x, b in edges for m in range(NODES) if same(a, m) and x == m and not same(a, b)]
        assert layer[a] == max(below, default=0)


@fast
@given(graphs)
def test_degrees_and_betweenness(graph):
    edges, adj = graph
    assert kernels.degrees(adj) == ([sum(b == n for _, b in edges) for n in range(NODES)], [sum(a == n for a, _ in edges) for n in range(NODES)])

    def walks(a, b):
        """All shortest paths."""
        d = distances(edges, a)
        if b not in d:
            return []
        if a == b:
            return [[a]]
        return [[*w, b] for m in range(NODES) if (m, b) in edges and d.get(m, NODES) == d[b] - 1 for w in walks(a, m)]

    want = [0.0] * NODES
    for a in range(NODES):
        for b in range(NODES):
            all_ = walks(a, b) if a != b else []
            for n in range(NODES):
                if all_ and n not in (a, b):
                    want[n] += sum(n in w for w in all_) / len(all_)
    parts = [kernels.betweenness(adj, range(s, NODES, 2)) for s in range(2)]
    assert all(abs(x - y) < 1e-9 and abs(x - p - q) < 1e-9 for x, y, p, q in zip(want, kernels.betweenness(adj), *parts))


def test_long_chains_do_not_recurse():
    n = 50_000
    adj = kernels.adjacency(n, ((i, i + 1) for i in range(n - 1)))
    assert len(kernels.components(adj)) == n and kernels.layers(adj)[0] == n - 1 and kernels.bfs(adj, [0]).depth[n - 1] == n - 1
