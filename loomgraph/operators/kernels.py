"""Graph kernels in numpy and plain Python, without Spark; run per source, per replica or per seed inside tasks."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np


class Csr:
    """Adjacency of nodes 0..n-1 in compressed rows; rows are sorted by neighbour."""

    def __init__(self, n: int, u, v, w=None):
        u, v = np.asarray(u, np.int64), np.asarray(v, np.int64)
        w = np.ones(len(u)) if w is None else np.asarray(w, np.float64)
        order = np.lexsort((v, u))
        self.n, self.to, self.w = n, v[order], w[order]
        self.at = np.searchsorted(u[order], np.arange(n + 1))

    def near(self, i: int) -> np.ndarray:
        return self.to[self.at[i] : self.at[i + 1]]

    def lists(self) -> list[list[int]]:
        return [self.near(i).tolist() for i in range(self.n)]


def bfs(g: Csr, source: int) -> np.ndarray:
    """Hop distances, -1 where unreachable; a whole frontier at a time."""
    d = np.full(g.n, -1, np.int32)
    d[source], frontier, step, left = 0, np.array([source]), 0, g.n - 1
    while len(frontier) and left:
        size = g.at[frontier + 1] - g.at[frontier]
        k = np.repeat(g.at[frontier] - np.cumsum(size) + size, size) + np.arange(size.sum())
        step += 1
        frontier = _reached(d, g.to[k], step)
        left -= len(frontier)
    return d


def _reached(d: np.ndarray, ends: np.ndarray, step: int) -> np.ndarray:
    """The nodes of `ends` without a distance, in order; they get `step`."""
    new = ends[d[ends] < 0]
    d[new] = step
    return np.flatnonzero(d == step) if 8 * len(new) > len(d) else np.unique(new)


def brandes(g: Csr, source: int, edges: bool = False):
    """Dependencies of one source on every node (and, if asked, on every directed edge slot of the rows)."""
    delta, on_edge, _ = dependency_search(g, source, edges)
    return (delta, on_edge) if edges else delta


def dependency_search(g: Csr, source: int, edges: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(dependencies on nodes, on edge slots if asked, hop distances) of one source; a level's links are read once on the way out."""
    d, sigma = np.full(g.n, -1, np.int32), np.zeros(g.n)
    d[source], sigma[source], layer, step, steps, left = 0, 1, np.array([source]), 0, [], g.n - 1
    while len(layer) and left:  # the last level leads nowhere
        size = g.at[layer + 1] - g.at[layer]
        k = np.repeat(g.at[layer] - np.cumsum(size) + size, size) + np.arange(size.sum())
        a, b = np.repeat(layer, size), g.to[k]
        step += 1
        layer = _reached(d, b, step)
        left -= len(layer)
        ok = np.flatnonzero(d[b] == step)
        if len(ok):
            a, b = a[ok], b[ok]
            _add(sigma, b, sigma[a])
            steps.append((a, b, k[ok] if edges else None))
    delta, on_edge = np.zeros(g.n), np.zeros(len(g.to)) if edges else None
    for a, b, k in reversed(steps):
        c = sigma[a] / sigma[b] * (1 + delta[b])
        if edges:
            on_edge[k] = c
        _add(delta, a, c)
    delta[source] = 0
    return delta, on_edge, d


def _add(total: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    """total[at] += x with repeats, where total[at] is 0."""
    if 8 * len(at) > len(total):
        total += np.bincount(at, x, len(total))
    else:
        np.add.at(total, at, x)


def parts_of(g: Csr, sources) -> Iterator[tuple[np.ndarray, np.ndarray, Csr, np.ndarray]]:
    """(members, slots, the part as a graph of its own, its sources) for each component of g, directions ignored, that holds a
    source. Members and slots are positions in g, in order; sources are positions in the part, in the order given."""
    size, sources = np.diff(g.at), np.asarray(sources, np.int64)
    label, place = component_labels(g.n, np.repeat(np.arange(g.n), size), g.to), np.empty(g.n, np.int64)
    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.diff(label[order], prepend=-1))
    asked = sources[np.argsort(label[sources], kind="stable")]
    cut = np.searchsorted(label[asked], label[order[first]])
    for members, own in zip(np.split(order, first[1:]), np.split(asked, cut[1:])):
        if len(own):
            place[members] = np.arange(len(members))
            ends = np.cumsum(size[members])
            slots = np.repeat(g.at[members] - ends + size[members], size[members]) + np.arange(size[members].sum())
            part = Csr.__new__(Csr)
            part.n, part.to, part.w, part.at = len(members), place[g.to[slots]], g.w[slots], np.concatenate([[0], ends])
            yield members, slots, part, place[own]


def dependencies(g: Csr, sources, edges: bool = False) -> np.ndarray:
    """brandes() summed over sources, on nodes or on edge slots. A source is searched in its own component, so a graph of many
    parts costs what its parts cost."""
    total = np.zeros(len(g.to) if edges else g.n)
    for members, slots, part, own in parts_of(g, sources):
        total[slots if edges else members] = sum(brandes(part, s, True)[1] if edges else brandes(part, s) for s in own.tolist())
    return total


#: Cells of all levels together that all_dependencies() holds, and levels that it tries at least.
_LEVELS, _LEAST_LEVELS = 1 << 23, 12


def all_dependencies(near: np.ndarray) -> np.ndarray | None:
    """dependencies() of all sources on all nodes of an undirected graph, given as a matrix of 0 and 1: a level of all searches is one
    product. None where there are too many levels for that to be of use."""
    n = len(near)
    most = max(_LEAST_LEVELS, _LEVELS // max(1, n * n))
    open_, levels = near == 0, [near]
    np.fill_diagonal(open_, False)
    while open_.any():
        ways = levels[-1] @ near
        ways *= open_
        new = ways > 0
        if not new.any():
            break
        if len(levels) == most:
            return None
        open_ &= ~new
        levels.append(ways)
    delta = np.zeros((n, n))
    total = np.zeros(n)
    for above, ways in zip(levels[-2::-1], levels[:0:-1]):
        delta += 1
        delta = above * (np.divide(delta, ways, out=np.zeros_like(ways), where=ways > 0) @ near)
        total += delta.sum(axis=0)
    return total


def piece_dependencies(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """dependencies() of all sources of one piece: by products where it is small or has many links, else source by source."""
    if n > 2 and (n <= 256 or len(u) >= 3 * n):
        near = np.zeros((n, n))
        near[u, v] = near[v, u] = 1
        if (found := all_dependencies(near)) is not None:
            return found
    return dependencies(Csr(n, np.concatenate([u, v]), np.concatenate([v, u])), np.arange(n)) if n > 2 else np.zeros(n)


def pieces_of(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, u, v) of each component of the links (u, v) between sorted ids, and of each id without one."""
    label = component_labels(len(ids), np.searchsorted(ids, u), np.searchsorted(ids, v))
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.diff(label[order])) + 1
    own = label[np.searchsorted(ids, u)]
    links = np.argsort(own, kind="stable")
    at = np.searchsorted(own[links], label[order[np.concatenate([[0], cuts])]] if len(ids) else [])
    for members, k in zip(np.split(order, cuts) if len(ids) else [], np.split(links, at[1:])):
        yield ids[members], u[k], v[k]


class Pieces:
    """What is left of a graph while the node of largest betweenness is removed again and again (rounded to 9 places, ties to the
    smaller id). Betweenness in a piece depends on that piece alone, so a removal changes no other one's."""

    def __init__(self, score=piece_dependencies):
        self.score, self.best, self.sizes, self.held = score, [], [], {}

    def add(self, ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
        """A connected piece of sorted ids."""
        x = np.round(self.score(len(ids), np.searchsorted(ids, u), np.searchsorted(ids, v)), 9)
        i = int(np.argmax(x))
        self.held[int(ids[i])] = ids, u, v
        heapq.heappush(self.best, (-float(x[i]), int(ids[i])))
        heapq.heappush(self.sizes, (-len(ids), int(ids[i])))

    def largest(self) -> int:
        while self.sizes and (self.sizes[0][1] not in self.held or len(self.held[self.sizes[0][1]][0]) != -self.sizes[0][0]):
            heapq.heappop(self.sizes)
        return -self.sizes[0][0] if self.sizes else 0

    def remove(self) -> tuple[int, float]:
        """(node, its betweenness) of the next removal."""
        x, at = heapq.heappop(self.best)
        ids, u, v = self.held.pop(at)
        keep = (u != at) & (v != at)
        for piece in pieces_of(ids[ids != at], u[keep], v[keep]):
            self.add(*piece)
        return at, -x


#: Rows that waves() gathers at a time, times the words of a row.
_GATHERED = 1 << 21


def waves(back: Csr, sources) -> Iterator[tuple[int, np.ndarray]]:
    """(d, bits) for d = 0, 1, ...: bit k % 64 of bits[i, k // 64] is set if sources[k] reaches node i first at distance d. `back` holds
    each node's predecessors. A level is an OR over these, for all sources at once."""
    k = np.arange(len(sources))
    bits = np.zeros((back.n, -(-len(k) // 64)), np.uint64)
    np.bitwise_or.at(bits, (np.asarray(sources, np.int64), k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
    seen, row, most, d = bits.copy(), np.repeat(np.arange(back.n), np.diff(back.at)), max(1, _GATHERED // max(1, bits.shape[1])), 0
    while bits.any():
        yield d, bits
        live = np.flatnonzero(bits.any(axis=1)[back.to])
        rows, to, new = row[live], back.to[live], np.zeros_like(bits)
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        cuts = np.flatnonzero(np.diff(first // most, prepend=-1)).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(first)]):
            lo, hi = first[i], first[j] if j < len(first) else len(to)
            new[rows[first[i:j]]] = np.bitwise_or.reduceat(bits[to[lo:hi]], first[i:j] - lo, axis=0)
        new &= ~seen
        seen |= new
        bits, d = new, d + 1


def bit_counts(bits: np.ndarray) -> np.ndarray:
    """How many rows have each bit set, bit k % 64 of word k // 64 at place k: three rows become a sum and a carry, until few are left."""
    total, weight = np.zeros(bits.shape[1] * 64, np.int64), 1
    while len(bits):
        carries = [bits[:0]]
        while len(bits) > 2:
            k = len(bits) // 3
            a, b, c = bits[:k], bits[k : 2 * k], bits[2 * k : 3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            bits = np.concatenate([half ^ c, bits[3 * k :]])
        total += weight * np.unpackbits(np.ascontiguousarray(bits).astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits, weight = np.concatenate(carries), 2 * weight
    return total


def component_labels(n: int, u, v) -> np.ndarray:
    """Smallest member of each node's undirected component."""
    root = np.arange(n)
    u, v = np.asarray(u, np.int64), np.asarray(v, np.int64)
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


class Union:
    """Disjoint sets with sizes."""

    def __init__(self, n: int):
        self.up, self.size = list(range(n)), [1] * n

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        if self.size[i] < self.size[j]:
            i, j = j, i
        self.up[j] = i
        self.size[i] += self.size[j]
        return True


class Tally:
    """How many pieces there are of each size from two nodes on, and the nodes in them."""

    def __init__(self, count: dict[int, int]):
        self.count, self.sizes, self.nodes = dict(count), sorted(count), sum(s * n for s, n in count.items())

    def join(self, a: int, b: int) -> None:
        """A piece of a nodes and one of b become one."""
        for size in (a, b):
            if size == 1:
                self.nodes += 1
            elif self.count[size] > 1:
                self.count[size] -= 1
            else:
                del self.count[size]
                self.sizes.pop(bisect_left(self.sizes, size))
        if a + b not in self.count:
            insort(self.sizes, a + b)
        self.count[a + b] = self.count.get(a + b, 0) + 1

    def two(self) -> tuple[int, int]:
        """The sizes of the two largest pieces, 0 for one that is missing."""
        top = self.sizes[-1] if self.sizes else 0
        return top, top if self.count.get(top, 0) > 1 else self.sizes[-2] if len(self.sizes) > 1 else 0


def bridges(a: list[int], b: list[int]) -> list[int]:
    """Positions of the links (a, b), of which some may be parallel or loops, that lie on no cycle, by low points."""
    near: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, (i, j) in enumerate(zip(a, b)):
        near[i].append((j, k))
        near[j].append((i, k))
    depth, low, found = {}, {}, []
    for top in list(near):
        if top in depth:
            continue
        depth[top] = low[top] = 0
        stack = [(top, -1, iter(near[top]))]
        while stack:
            i, came, it = stack[-1]
            for j, k in it:
                if j not in depth:
                    depth[j] = low[j] = depth[i] + 1
                    stack.append((j, k, iter(near[j])))
                    break
                if k != came:
                    low[i] = min(low[i], depth[j])
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[i])
                    if low[i] > depth[up]:
                        found.append(came)
    return sorted(found)


def strong_components(g: Csr) -> np.ndarray:
    """Smallest member of each node's strongly connected component (two depth-first passes)."""
    out, back = g.lists(), [[] for _ in range(g.n)]
    for i, near in enumerate(out):
        for j in near:
            back[j].append(i)
    seen, order = [False] * g.n, []
    for s in range(g.n):
        if seen[s]:
            continue
        seen[s], stack = True, [(s, iter(out[s]))]
        while stack:
            i, it = stack[-1]
            for j in it:
                if not seen[j]:
                    seen[j] = True
                    stack.append((j, iter(out[j])))
                    break
            else:
                order.append(i)
                stack.pop()
    label = np.full(g.n, -1)
    for s in reversed(order):
        if label[s] >= 0:
            continue
        members, todo = [], [s]
        label[s] = s
        while todo:
            i = todo.pop()
            members.append(i)
            for j in back[i]:
                if label[j] < 0:
                    label[j] = s
                    todo.append(j)
        label[members] = min(members)
    return label


def articulation(g: Csr) -> list[int]:
    """Cut vertices of an undirected graph, by low points of a depth-first search."""
    near, depth, low, cut = g.lists(), [-1] * g.n, [0] * g.n, set()
    for root in range(g.n):
        if depth[root] >= 0:
            continue
        depth[root] = 0
        stack, children = [(root, -1, iter(near[root]))], 0
        while stack:
            i, parent, it = stack[-1]
            for j in it:
                if depth[j] < 0:
                    depth[j] = low[j] = depth[i] + 1
                    stack.append((j, i, iter(near[j])))
                    break
                if j != parent:
                    low[i] = min(low[i], depth[j])
            else:
                stack.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[i])
                    if parent == root:
                        children += 1
                    elif low[i] >= depth[parent]:
                        cut.add(parent)
        if children > 1:
            cut.add(root)
    return sorted(cut)


def certificate(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Positions of the links of two forests, two a node at most, that without any one node have the components of all links without
    it; this holds with more links added to both. The first forest scans nodes in turn, each taking all its neighbours that have no
    parent yet; the second is any spanning forest of the rest. A link that neither has has ends that the second joins. Where it does so
    only through a node x, the two neighbours of x on that way had parents before x was scanned, so the first joins them without x."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    order = np.argsort(np.concatenate([a, b]), kind="stable")
    to, link, at = np.concatenate([b, a])[order], (order % max(1, len(u))), np.searchsorted(np.concatenate([a, b])[order], np.arange(len(ids) + 1))
    taken, seen = np.zeros(len(u), bool), np.zeros(len(ids), bool)
    frontier = np.unique(component_labels(len(ids), a, b))
    seen[frontier] = True
    while len(frontier):
        size = at[frontier + 1] - at[frontier]
        k = np.repeat(at[frontier] - np.cumsum(size) + size, size) + np.arange(size.sum())
        k = k[~seen[to[k]]]
        frontier, first = np.unique(to[k], return_index=True)
        seen[frontier], taken[link[k[first]]] = True, True
    sets, rest = Union(len(ids)), np.flatnonzero(~taken)
    taken[[i for i, x, y in zip(rest.tolist(), a[rest].tolist(), b[rest].tolist()) if sets.join(x, y)]] = True
    return np.flatnonzero(taken)


def removal_pieces(g: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root, pieces, largest) of each node: the smallest node of its component, and what that falls into without the node. A child's
    subtree comes loose if no link from it passes its parent, by low points of a depth-first search."""
    near, root, depth, low, size = g.lists(), [-1] * g.n, [0] * g.n, [0] * g.n, [1] * g.n
    loose, total, most = [0] * g.n, [0] * g.n, [0] * g.n
    for top in range(g.n):
        if root[top] >= 0:
            continue
        root[top], stack = top, [(top, -1, iter(near[top]))]
        while stack:
            i, parent, it = stack[-1]
            for j in it:
                if root[j] < 0:
                    root[j], depth[j] = top, depth[i] + 1
                    low[j] = depth[j]
                    stack.append((j, i, iter(near[j])))
                    break
                if j != parent and depth[j] < low[i]:
                    low[i] = depth[j]
            else:
                stack.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[i])
                    size[parent] += size[i]
                    if low[i] >= depth[parent]:
                        loose[parent] += 1
                        total[parent] += size[i]
                        most[parent] = max(most[parent], size[i])
    root = np.array(root, np.int64)
    rest = np.array(size, np.int64)[root] - 1 - np.array(total, np.int64)
    return root, np.array(loose, np.int64) + (rest > 0), np.maximum(np.array(most, np.int64), rest)


#: Wedges that triangles() holds at a time.
_WEDGES = 1 << 21


def triangles(u: np.ndarray, v: np.ndarray) -> Iterator[np.ndarray]:
    """The triangles of distinct links, as blocks of positions in np.unique(u and v), three a row. Links point from the end of smaller
    degree, so a node has at most sqrt(2 m) of them; two of a node are a wedge, whose third link is looked up, first by a hash."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    n, half = len(ids), len(u)
    k = np.bincount(ends, minlength=n)
    a, b = ends[:half], ends[half:]
    turn = (k[a] > k[b]) | ((k[a] == k[b]) & (a > b))
    a, b = np.where(turn, b, a), np.where(turn, a, b)
    keys = np.sort(np.minimum(a, b) * n + np.maximum(a, b))
    bits = min(30, max(10, (8 * half).bit_length()))
    slot = lambda x: (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    there = np.zeros(1 << bits, bool)
    there[slot(keys)] = True
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    rest = np.searchsorted(a, a, side="right") - 1 - np.arange(half)  # links after each one in its node's row
    upto = np.cumsum(rest)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(upto, np.arange(_WEDGES, upto[-1] if half else 0, _WEDGES)), [half]]))
    for i, j in zip(cuts, cuts[1:]):
        size = rest[i:j]
        x = np.repeat(np.arange(i, j), size)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
        p, q = b[x], b[y]
        third = np.minimum(p, q) * n + np.maximum(p, q)
        maybe = np.flatnonzero(there[slot(third)])
        at = np.minimum(np.searchsorted(keys, third[maybe]), half - 1)
        yes = maybe[keys[at] == third[maybe]]
        if len(yes):
            yield np.stack([a[x[yes]], p[yes], q[yes]], axis=1)


def cliques_from(near: list[set], start: int, rank: list[int]):
    """Maximal cliques whose first node in the degeneracy order is `start`."""
    later = {j for j in near[start] if rank[j] > rank[start]}
    earlier = near[start] - later
    stack = [([start], later, earlier)]
    while stack:
        clique, todo, done = stack.pop()
        if not todo and not done:
            yield sorted(clique)
            continue
        pivot = max(todo | done, key=lambda x: len(near[x] & todo))
        for j in sorted(todo - near[pivot]):
            stack.append(([*clique, j], todo & near[j], done & near[j]))
            todo, done = todo - {j}, done | {j}


def degeneracy_rank(near: list[set]) -> list[int]:
    """Position of each node when a node of least remaining degree goes first."""
    degree, rank, heap = [len(x) for x in near], [-1] * len(near), [(len(x), i) for i, x in enumerate(near)]
    heapq.heapify(heap)
    k = 0
    while heap:
        d, i = heapq.heappop(heap)
        if rank[i] >= 0 or d != degree[i]:
            continue
        rank[i], k = k, k + 1
        for j in near[i]:
            if rank[j] < 0:
                degree[j] -= 1
                heapq.heappush(heap, (degree[j], j))
    return rank


def clashes(there: np.ndarray, made: np.ndarray) -> np.ndarray:
    """Which of `made` are in `there`, or in `made` more than once. Only keys whose slot by a hash another row has taken are compared."""
    keys = np.concatenate([there, made])
    bits = max(10, (8 * len(keys)).bit_length())
    h = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)
    slot, row = np.empty(1 << bits, np.int32), np.arange(len(keys), dtype=np.int32)  # read only where it was written
    slot[h] = row
    at = slot[h]
    lost = np.flatnonzero(at != row)
    met = np.zeros(len(keys), bool)
    met[lost] = met[at[lost]] = True
    some = np.flatnonzero(met)
    _, back, often = np.unique(keys[some], return_inverse=True, return_counts=True)
    met[some] = often[back] > 1
    return met[len(there) :]


def swap_edges(n: int, u, v, swaps: int, rng: np.random.Generator, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Double edge swaps that keep every degree and make neither loops nor repeated edges; ends as two arrays, smaller first.

    A round deals the edges into pairs that share none and tries all their swaps at once. One that makes a loop, an edge that
    is there, or an edge that another one makes is left out. Rounds end when `swaps` are done, or after `rounds`."""
    lo, hi = np.minimum(u, v).astype(np.int64), np.maximum(u, v).astype(np.int64)
    done = 0
    while done < swaps and rounds > 0 and len(lo) > 1:
        rounds -= 1
        i, j = rng.permutation(len(lo))[: len(lo) // 2 * 2].reshape(2, -1)
        turn = rng.random(len(i)) < 0.5
        a, b, c, d = lo[i], hi[i], np.where(turn, hi[j], lo[j]), np.where(turn, lo[j], hi[j])
        made = np.concatenate([np.minimum(a, d) * n + np.maximum(a, d), np.minimum(b, c) * n + np.maximum(b, c)])
        fine = ~clashes(lo * n + hi, made).reshape(2, -1).any(axis=0) & (a != d) & (b != c)
        fine[np.cumsum(fine) > swaps - done] = False
        i, j, (p, q) = i[fine], j[fine], made.reshape(2, -1)[:, fine]
        lo[i], hi[i], lo[j], hi[j] = p // n, p % n, q // n, q % n
        done += len(i)
    return lo, hi


def swap_across(a: np.ndarray, b: np.ndarray, rng: np.random.Generator, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Double edge swaps of distinct edges between nodes a on one side and b on the other, which stay on their sides. A round tries
    each edge once; swaps that make an edge that is there, or that another one makes, are left out."""
    (left, a), (right, b) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
    for _ in range(rounds):
        i, j = rng.permutation(len(a))[: len(a) // 2 * 2].reshape(2, -1)
        made = np.concatenate([a[i] * len(right) + b[j], a[j] * len(right) + b[i]])
        fine = ~clashes(a * len(right) + b, made).reshape(2, -1).any(axis=0)
        i, j = i[fine], j[fine]
        b[i], b[j] = b[j], b[i]
    return left[a], right[b]


def stub_matching(degrees: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Configuration model: random pairs of stubs, without loops and with repeated edges once."""
    stubs = rng.permutation(np.repeat(np.arange(len(degrees)), degrees))
    stubs = stubs[: len(stubs) // 2 * 2].reshape(-1, 2)
    stubs = np.sort(stubs[stubs[:, 0] != stubs[:, 1]], axis=1)
    return np.unique(stubs, axis=0)


def random_pairs(n: int, m: int, rng: np.random.Generator) -> np.ndarray:
    """The first m distinct pairs a < b of uniform draws, in order. There must be as many."""
    drawn, found = np.empty(0, np.int64), np.empty(0, np.int64)
    while len(found) < m:
        a, b = rng.integers(0, n, (m, 2)).T
        drawn = np.concatenate([drawn, (np.minimum(a, b) * n + np.maximum(a, b))[a != b]])
        found, first = np.unique(drawn, return_index=True)
    pairs = np.sort(found[np.argsort(first)[:m]]) if m else found
    return np.stack([pairs // max(1, n), pairs % max(1, n)], axis=1)


def regular_graph(n: int, k: int, rng: np.random.Generator, tries: int = 200) -> np.ndarray:
    """A random graph in which all degrees are k: stub matching whose bad pairs are matched anew."""
    for _ in range(tries):
        edges, left = set(), np.repeat(np.arange(n), k)
        for _ in range(1000):
            left = rng.permutation(left)
            bad = []
            for a, b in left.reshape(-1, 2).tolist():
                p = (min(a, b), max(a, b))
                if a == b or p in edges:
                    bad += [a, b]
                else:
                    edges.add(p)
            if not bad:
                return np.array(sorted(edges))
            if len(bad) == len(left) and len(bad) < 3 * k:
                break
            left = np.array(bad)
    raise ValueError("no regular graph found")


def attachment_tree(n: int, rng: np.random.Generator, preferential: bool = True) -> list[tuple[int, int]]:
    """A tree grown a node at a time: each new node links to one chosen by degree, or uniformly."""
    edges, ends = [(0, 1)], [0, 1]
    for i in range(2, n):
        j = ends[rng.integers(0, len(ends))] if preferential else int(rng.integers(0, i))
        edges.append((j, i))
        ends += [i, j]
    return edges


def modularity(n: int, u, v, w, labels, gamma: float = 1.0) -> float:
    labels, w = np.asarray(labels), np.asarray(w, np.float64)
    m = w.sum()
    if m == 0:
        return 0.0
    k = np.bincount(u, w, n) + np.bincount(v, w, n)
    _, lab = np.unique(labels, return_inverse=True)
    inside = np.bincount(lab[np.asarray(u)], w * (lab[np.asarray(u)] == lab[np.asarray(v)]), lab.max() + 1)
    return float((inside / m - gamma * (np.bincount(lab, k, lab.max() + 1) / (2 * m)) ** 2).sum())


def _rows(n: int, a: np.ndarray, b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, to, w): weights x from a to b as compressed rows in the order that they come in, those of a pair added up at its first."""
    _, first, back = np.unique(a * n + b, return_index=True, return_inverse=True)
    order = np.lexsort((first, a[first]))
    return np.searchsorted(a[first][order], np.arange(n + 1)), b[first][order], np.bincount(back, x, len(first))[order]


def _choice(links: dict, own: int, rest: float, total: list[float], k: float, m: float, gamma: float) -> tuple[int, float]:
    """The community of largest gain for a node of weight k (its own, of weight `rest` without it, unless another gains more), and by how
    much the others fall short."""
    best, gain, top = own, links.get(own, 0.0) / m - gamma * rest * k / (2 * m * m), -math.inf
    stay = gain
    for c in sorted(links):
        if c != own:
            g = links[c] / m - gamma * total[c] * k / (2 * m * m)
            if g > top:
                top = g
            if g > gain + 1e-12:
                best, gain = c, g
    return best, stay + 1e-12 - top


def _local_moves(at: np.ndarray, to: np.ndarray, w: np.ndarray, loops: list[float], m: float, gamma: float, rng) -> list[int]:
    """One level of modularity moves: each node to the neighbouring community of largest gain, until none gains.

    A node that stayed is asked again only if a neighbour has moved since, or if communities have changed by as much as its choice can
    bear: `drift` is at least what any one has, as every sweep adds the most that one changed in it. So no move is missed."""
    n, cut, known = len(loops), at.tolist(), list(range(len(loops)))
    near = [known[j] for j in to.tolist()]
    near = [near[i:j] for i, j in zip(cut, cut[1:])]
    plain = bool((w == 1).all())
    values, which = np.unique(w, return_inverse=True)
    values = values.tolist()
    weights = [] if plain else [values[q] for q in which.tolist()]
    weights = [weights[i:j] for i, j in zip(cut, cut[1:])]
    k = [(float(len(x)) if plain else sum(y)) + 2 * z for x, y, z in zip(near, weights, loops)]
    com, total, never = list(range(n)), list(k), -math.inf
    bears, drift = [never] * n, 0.0  # a node is passed by while drift is less than what it bears
    moved, order = True, [i for i in rng.permutation(n).tolist() if near[i]]
    while moved:
        moved, begun = False, drift
        change: dict[int, float] = defaultdict(float)
        for i in order:
            if drift < bears[i]:
                continue
            if plain:
                links = Counter(map(com.__getitem__, near[i]))
            else:
                links = defaultdict(float)
                for j, x in zip(near[i], weights[i]):
                    links[com[j]] += x
            own = com[i]
            best, room = _choice(links, own, total[own] - k[i], total, k[i], m, gamma)
            if best == own:
                bears[i] = begun + (room * (1 - 1e-9) - 1e-14) * m * m / (gamma * k[i]) if gamma * k[i] > 0 else math.inf
                continue
            total[own] -= k[i]
            total[best] += k[i]
            com[i], moved, bears[i] = best, True, never
            for j in near[i]:
                bears[j] = never
            for c in (own, best):
                change[c] += k[i]
                drift = max(drift, begun + change[c])
    return com


def relabel(labels) -> list[int]:
    """Labels numbered by falling size, then by smallest member."""
    members: dict = defaultdict(list)
    for i, c in enumerate(labels):
        members[c].append(i)
    order = sorted(members, key=lambda c: (-len(members[c]), members[c][0]))
    number = {c: k for k, c in enumerate(order)}
    return [number[c] for c in labels]


def louvain(n: int, u, v, w, seed: int, gamma: float = 1.0, levels: int | None = None) -> list[int]:
    """Multilevel modularity; levels=1 stops after the first phase."""
    rng, node = np.random.default_rng(seed), np.arange(n)
    a, b, x = np.asarray(u, np.int64), np.asarray(v, np.int64), np.asarray(w, np.float64)
    m = float(sum(x.tolist()))
    if m == 0:
        return node.tolist()
    loop, ends = a == b, np.stack([a, b], axis=1)[a != b]
    loops = np.bincount(a[loop], x[loop], n)
    at, to, x = _rows(n, ends.ravel(), ends[:, ::-1].ravel(), np.repeat(x[~loop], 2))
    level = 0
    while levels is None or level < levels:
        com = np.array(relabel(_local_moves(at, to, x, loops.tolist(), m, gamma, rng)))
        size = int(com.max()) + 1
        node = com[node]
        level += 1
        if size == len(com):
            break
        a, b = np.repeat(com, np.diff(at)), com[to]
        same = a == b
        ends = np.concatenate([com, a[same]]), np.concatenate([loops, x[same] / 2])
        loops = np.bincount(*ends, size)
        at, to, x = _rows(size, a[~same], b[~same], x[~same])
    return relabel(node.tolist())


def greedy_modularity(n: int, u, v, w, m: float | None = None) -> list[int]:
    """Agglomeration by the largest modularity gain, from single nodes. m is the weight of the whole graph, if this is a part of it."""
    m = float(sum(w) if m is None else m)
    near: list[dict] = [defaultdict(float) for _ in range(n)]
    for a, b, x in zip(u, v, w):
        if a != b:
            near[a][b] += x / m
            near[b][a] += x / m
    k = [(sum(near[i].values())) / 2 for i in range(n)]
    label, alive, stamp = list(range(n)), set(range(n)), [0] * n
    gain = lambda i, j: near[i][j] - 2 * k[i] * k[j]
    heap = [(-gain(i, j), i, j, 0, 0) for i in range(n) for j in near[i] if i < j]
    heapq.heapify(heap)
    while heap:
        g, i, j, si, sj = heapq.heappop(heap)
        if i not in alive or j not in alive or si != stamp[i] or sj != stamp[j]:
            continue
        if -g <= 1e-15:
            break
        for x, y in near[j].items():
            if x != i:
                near[i][x] += y
                near[x][i] += y
            near[x].pop(j, None)
        near[i].pop(j, None)
        k[i] += k[j]
        alive.discard(j)
        label = [i if c == j else c for c in label]
        stamp[i] += 1
        for x in near[i]:
            if x in alive:
                a, b = min(i, x), max(i, x)
                heapq.heappush(heap, (-gain(a, b), a, b, stamp[a], stamp[b]))
    return relabel(label)


def girvan_newman(n: int, edges: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """Remove edges of largest betweenness (ties to the smallest pair) until a component splits; labels and removals."""
    edges, removed = sorted(edges), []
    parts = len(set(component_labels(n, [a for a, _ in edges], [b for _, b in edges]).tolist()))
    while edges:
        g = Csr(n, [a for a, _ in edges] + [b for _, b in edges], [b for _, b in edges] + [a for a, _ in edges])
        total = dependencies(g, range(n), True)
        from_ = np.repeat(np.arange(n), np.diff(g.at))
        score = {}
        for a, b, c in zip(from_.tolist(), g.to.tolist(), total.tolist()):
            score[(min(a, b), max(a, b))] = score.get((min(a, b), max(a, b)), 0) + c
        worst = min(score, key=lambda e: (-round(score[e], 9), e))
        edges.remove(worst)
        removed.append(worst)
        labels = component_labels(n, [a for a, _ in edges], [b for _, b in edges]).tolist() if edges else list(range(n))
        if len(set(labels)) > parts:
            return relabel(labels), removed
    return list(range(n)), removed


def map_equation(flow: np.ndarray, exits: np.ndarray, labels) -> float:
    """Two-level code length in bits, for node visit rates and each module's exit rate."""
    plogp = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0])))
    _, lab = np.unique(labels, return_inverse=True)
    p = np.bincount(lab, flow)
    q = np.asarray(exits, np.float64)
    return plogp(np.array([q.sum()])) - 2 * plogp(q) - plogp(flow) + plogp(q + p)


def _flow_model(n: int, u, v, w, is_directed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Visit rates, and flow along each (u, v)."""
    u, v, w = np.asarray(u), np.asarray(v), np.asarray(w, np.float64)
    if not is_directed:
        m = w.sum()
        return (np.bincount(u, w, n) + np.bincount(v, w, n)) / (2 * m), w / (2 * m)
    out = np.bincount(u, w, n)
    p = np.full(n, 1 / n)
    for _ in range(200):
        p = 0.15 / n + 0.85 * (np.bincount(v, p[u] * w / out[u], n) + p[out == 0].sum() / n)
    f = p[u] * w / out[u]
    return p, f / max(f.sum(), 1e-300)


def infomap(n: int, u, v, w, seed: int, trials: int = 3, is_directed: bool = False) -> tuple[list[int], float, float]:
    """Labels, code length and one-level code length by moving nodes (then whole modules) while the code shortens."""
    best: tuple[list[int], float, float] = (list(range(n)), math.inf, math.inf)
    for t in range(trials):
        found = infomap_trial(n, u, v, w, seed, t, is_directed)
        if found[1] < best[1]:
            best = found
    return best if trials else infomap_trial(n, u, v, w, seed, 0, is_directed)


def _added(xs) -> float:
    """The sum from left to right, as a running total has it; sum() compensates."""
    t = 0.0
    for x in xs:
        t += x
    return t


def infomap_trial(n: int, u, v, w, seed: int, t: int, is_directed: bool = False) -> tuple[list[int], float, float]:
    """One trial of infomap(), which takes the shortest code, the earlier of equal ones. What a module's exit and rate add to the code is
    kept until they change, and what a node takes from its own module is worked out once for all candidates."""
    p, f = _flow_model(n, u, v, w, is_directed)
    one = map_equation(p, np.zeros(1), np.zeros(n, np.int64))
    log2 = math.log2
    plogp = lambda x: x * log2(x) if x > 1e-15 else 0.0
    rng = np.random.default_rng((seed, t))
    node, level_p = list(range(n)), p.tolist()
    out: list[dict] = [defaultdict(float) for _ in range(n)]
    into: list[dict] = [defaultdict(float) for _ in range(n)] if is_directed else out
    for a, b, x in zip(np.asarray(u).tolist(), np.asarray(v).tolist(), f.tolist()):
        if a != b:
            out[a][b] += x
            into[b][a] += x
    while True:
        size = len(level_p)
        com, rate = list(range(size)), list(level_p)
        leave = [_added(x.values()) for x in out]
        total_q, moved = _added(leave), True
        own_out = list(leave)
        of_exit, of_both = [plogp(x) for x in leave], [plogp(x + y) for x, y in zip(leave, rate)]
        for _ in range(50):
            if not moved:
                break
            moved = False
            for i in rng.permutation(size).tolist():
                to = frm = defaultdict(float)
                for j, x in out[i].items():
                    to[com[j]] += x
                if into is not out:
                    frm = defaultdict(float)
                    for j, x in into[i].items():
                        frm[com[j]] += x
                a = com[i]
                if len(to) <= (a in to) and len(frm) <= (a in frm):
                    continue  # no other module near
                q_a = leave[a] - (own_out[i] - to[a]) + frm[a]  # exit of a without i
                choice = (0.0, a, None)
                total, less, left = plogp(total_q), plogp(q_a), plogp(q_a + rate[a] - level_p[i])
                own, out_i, p_i = of_exit[a], own_out[i], level_p[i]
                for b in sorted(to.keys() | frm.keys()):
                    if b == a:
                        continue
                    q_b = leave[b] + (out_i - to[b]) - frm[b]
                    q = total_q - leave[a] - leave[b] + q_a + q_b
                    both = q_b + rate[b] + p_i
                    more = q_b * log2(q_b) if q_b > 1e-15 else 0.0
                    change = (q * log2(q) if q > 1e-15 else 0.0) - total - 2 * (less + more - own - of_exit[b])
                    change += left + (both * log2(both) if both > 1e-15 else 0.0) - of_both[a] - of_both[b]
                    if change < choice[0] - 1e-10:
                        choice = (change, b, (q_a, q_b, q))
                if choice[2]:
                    b = choice[1]
                    leave[a], leave[b], total_q = choice[2]
                    rate[a] -= level_p[i]
                    rate[b] += level_p[i]
                    for c in (a, b):
                        of_exit[c], of_both[c] = plogp(leave[c]), plogp(leave[c] + rate[c])
                    com[i], moved = b, True
        com = relabel(com)
        k = max(com) + 1
        node = [com[c] for c in node]
        if k == size:
            break
        up_out: list[dict] = [defaultdict(float) for _ in range(k)]
        up_in: list[dict] = [defaultdict(float) for _ in range(k)]
        up_p = [0.0] * k
        for i in range(size):
            up_p[com[i]] += level_p[i]
            for j, x in out[i].items():
                if com[i] != com[j]:
                    up_out[com[i]][com[j]] += x
                    up_in[com[j]][com[i]] += x
        out, into, level_p = up_out, up_in, up_p
    code = codelength(n, u, v, w, node, is_directed)
    if one <= code:
        return [0] * n, one, one
    return relabel(node), code, one


def codelength(n: int, u, v, w, labels, is_directed: bool = False) -> float:
    p, f = _flow_model(n, u, v, w, is_directed)
    _, lab = np.unique(labels, return_inverse=True)
    a, b = lab[np.asarray(u)], lab[np.asarray(v)]
    cut = a != b
    q = np.bincount(a[cut], f[cut], lab.max() + 1) + (0 if is_directed else np.bincount(b[cut], f[cut], lab.max() + 1))
    return map_equation(p, q, lab)


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs (row, column) of largest total gain (Hungarian algorithm with potentials)."""
    flip = gain.shape[0] > gain.shape[1]
    c = -(gain.T if flip else gain).astype(np.float64)
    n, m = c.shape
    pu, pv, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            cur = c[i0 - 1] - pu[i0] - pv[1:]
            better = ~used[1:] & (cur < low[1:])
            low[1:][better], way[1:][better] = cur[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, low[1:]))) + 1
            step = low[j1]
            pu[match[used]] += step
            pv[used] -= step
            low[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def expected_mutual_information(a: np.ndarray, b: np.ndarray) -> float:
    """Mean mutual information of two labellings with class sizes a and b under random relabelling."""
    n, lg = int(a.sum()), math.lgamma
    total = 0.0
    for x in a.tolist():
        for y in b.tolist():
            for k in range(max(1, x + y - n), min(x, y) + 1):
                term = k / n * math.log(n * k / (x * y))
                log_p = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1) - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1)
                total += term * math.exp(log_p)
    return total


def student_p(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation, through Student's t with n - 2 degrees of freedom."""
    if n < 3 or abs(rho) >= 1:
        return 0.0 if n >= 3 else 1.0
    df = n - 2
    x = df / (df + rho * rho * df / (1 - rho * rho))
    return _beta_fraction(df / 2, 0.5, x)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d, out = 1.0, 0.0, 1.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d)
        c = 1 + num / c
        out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (out - 1)


def dijkstra(near: list[list[tuple[int, float]]], source: int) -> tuple[list[float], list[int]]:
    """Distances and predecessors (ties to the smaller predecessor)."""
    dist, prev, heap = [math.inf] * len(near), [-1] * len(near), [(0.0, source)]
    dist[source] = 0.0
    while heap:
        d, i = heapq.heappop(heap)
        if d > dist[i]:
            continue
        for j, w in near[i]:
            if d + w < dist[j] - 1e-15 or abs(d + w - dist[j]) <= 1e-15 and 0 <= i < prev[j]:
                changed = d + w < dist[j] - 1e-15
                dist[j], prev[j] = min(dist[j], d + w), i
                if changed:
                    heapq.heappush(heap, (d + w, j))
    return dist, prev


def removal_fractions(n: int, u, v, order: list[int]) -> list[float]:
    """Largest component as a share of n after 0, 1, ... removals; computed by adding nodes back."""
    near = [[] for _ in range(n)]
    for a, b in zip(u, v):
        near[a].append(b)
        near[b].append(a)
    sets, there, best, out = Union(n), [False] * n, 0, [0.0]
    gone = set(order)
    for i in [x for x in range(n) if x not in gone] + list(reversed(order)):
        there[i] = True
        best = max(best, 1)
        for j in near[i]:
            if there[j]:
                sets.join(i, j)
        best = max(best, sets.size[sets.find(i)])
        out.append(best / n)
    return list(reversed(out[-(len(order) + 1) :]))


#: Cells of neighbourhoods that link_trees() multiplies at a time; a node with more takes its rows one by one.
_CELLS = 1 << 24


def link_trees(g: Csr, nodes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each node with two or more links: a spanning tree of its links by largest similarity, as (a, b, similarity), and all the
    similarities of its links, each once. A link's number is its weight in g, which has both directions. Two links i-k and j-k are as
    similar as the inclusive neighbourhoods of i and j, by Jaccard; for each k these are counted anew, so that nothing is kept."""
    size, place = np.diff(g.at) + 1, np.full(g.n, -1)

    def spans(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, neighbour) of the inclusive neighbourhoods of x."""
        n = size[x] - 1
        k = np.repeat(g.at[x] - np.cumsum(n) + n, n) + np.arange(n.sum())
        rows = np.arange(len(x))
        return np.concatenate([np.repeat(rows, n), rows]), np.concatenate([g.to[k], x])

    for k in nodes:
        near, link = g.near(k), g.w[g.at[k] : g.at[k + 1]].astype(np.int64)
        if (d := len(near)) < 2:
            continue
        own, whole = size[near], None
        if size[near].sum() <= _CELLS:
            row, to = spans(near)
            if 16 * len(to) < g.n:
                cols, to = np.unique(to, return_inverse=True)
            else:
                cols = np.flatnonzero(np.bincount(to, minlength=g.n))
                place[cols] = np.arange(len(cols))
                to = place[to]
            if d * len(cols) <= _CELLS:
                held = np.zeros((d, len(cols)), np.float32)
                held[row, to] = 1
                whole = (held @ held.T).astype(np.float64)
                whole /= own[:, None] + own - whole
        if whole is None:
            place[:] = -1
            place[near] = np.arange(d)

        def similar(i: int) -> np.ndarray:
            if whole is not None:
                return whole[i]
            c = np.zeros(d)
            met = spans(near[i : i + 1])[1]
            for x in np.split(met, np.flatnonzero(np.diff(np.cumsum(size[met]) // _CELLS)) + 1):
                at = place[spans(x)[1]]
                c += np.bincount(at[at >= 0], minlength=d)
            return c / (own[i] + own - c)

        first = similar(0)
        best, back, left, every = first.copy(), np.zeros(d, np.int64), np.ones(d, bool), [np.unique(first[1:])]
        left[0], best[0] = False, -1
        order, s = np.empty(d - 1, np.int64), np.empty(d - 1)
        for step in range(d - 1):
            i = int(best.argmax())
            order[step], s[step] = i, best[i]
            left[i], best[i] = False, -1
            new = similar(i)
            if whole is None:
                every = [np.union1d(every[0], new[left])]
            better = left & (new > best)
            best[better], back[better] = new[better], i
        yield link[back[order]], link[order], s, every[0] if whole is None else np.unique(whole[np.triu_indices(d, 1)])


def links_sweep(pairs: list[tuple[float, int, int]], links: list[tuple[int, int]]) -> tuple[list[tuple[float, float]], list[int], float]:
    """Single linkage of links by falling similarity, ties as one level: (similarity, partition density) of each level,
    the labels at the densest level, and its similarity."""
    sets = Union(len(links))
    nodes: dict[int, set[int]] = {}  # of what has more than one link, by root

    def part(m: int, n: int) -> float:
        return m * (m - (n - 1)) / ((n - 2) * (n - 1)) if n > 2 else 0.0

    total, M = 0.0, max(1, len(links))
    best, curve = (-1.0, 0, 1.0), []
    pairs = sorted(pairs, key=lambda x: -x[0])
    i = 0
    while i < len(pairs):
        level = pairs[i][0]
        while i < len(pairs) and abs(pairs[i][0] - level) < 1e-12:
            a, b = sets.find(pairs[i][1]), sets.find(pairs[i][2])
            i += 1
            if a == b:
                continue
            x, y = nodes.pop(a, None) or set(links[a]), nodes.pop(b, None) or set(links[b])
            total -= part(sets.size[a], len(x)) + part(sets.size[b], len(y))
            if len(x) < len(y):
                x, y = y, x
            x |= y
            sets.join(a, b)
            a = sets.find(a)
            nodes[a] = x
            total += part(sets.size[a], len(x))
        density = 2 / M * total
        curve.append((level, density))
        if density > best[0] + 1e-15:
            best = (density, i, level)
    cut = Union(len(links))
    for _, a, b in pairs[: best[1]]:
        cut.join(a, b)
    return curve, relabel([cut.find(x) for x in range(len(links))]), best[2]


def bfs_path(near: list[list[int]], a: int, b: int) -> list[int] | None:
    """The lexicographically smallest shortest path, if there is one."""
    if a == b:
        return [a]
    back: list[list[int]] = [[] for _ in near]
    for i, x in enumerate(near):
        for j in x:
            back[j].append(i)
    d, todo = {b: 0}, deque([b])
    while todo:
        i = todo.popleft()
        for j in back[i]:
            if j not in d:
                d[j] = d[i] + 1
                todo.append(j)
    if a not in d:
        return None
    path = [a]
    while path[-1] != b:
        path.append(min(j for j in near[path[-1]] if d.get(j, -1) == d[path[-1]] - 1))
    return path
