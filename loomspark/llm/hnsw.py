"""A hierarchical navigable small-world graph over one shard of vectors, in numpy.

Searches and insertions go in blocks of vectors at once, so that every step is an array operation
over a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Links of a node that are kept when its list is cut, and those a list can hold.
KEPT, ROOM = 16, 32
BLOCK = 256
#: Fewer nodes than this are compared one by one: the top of the hierarchy.
TOP = 64
#: Each layer has about one of so many nodes of the one below.
RATIO = 16
#: Beam of insertions, and the first and the widest beam of searches.
BUILD_BEAM, FIRST_BEAM, WIDEST_BEAM = 48, 32, 1 << 14
#: Similarities in single precision are this far off at most.
SLACK = 1e-4
#: An audit goes on until its vectors stand for so many groups, a vector with p neighbours counting 1 / p;
#: beyond the sample's size it leaves out vectors with more neighbours than the second number.
GROUPS, FEW = 128, 256
#: Vectors whose neighbours an audit finds by brute force; those of more are found by beams so many times as wide as the searches'.
BRUTE_FORCED, WIDER = 4096, 16


class Layer:
    def __init__(self, n: int):
        self.links = np.full((n, ROOM), -1, np.int32)
        self.degree = np.zeros(n, np.int32)


class Graph:
    """``x`` has unit rows; ``order`` is a random order of them, whose first ones are the higher layers."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        self.x, n = x, len(x)
        self.order = np.random.default_rng(seed).permutation(n)
        sizes = [n]
        while sizes[-1] > TOP * RATIO:
            sizes.append(sizes[-1] // RATIO)
        self.sizes = sizes  # layer l holds order[:sizes[l]]
        self.layers = [Layer(n) for _ in sizes]
        self.beam, self.exact = FIRST_BEAM, False
        for level in reversed(range(len(sizes))):
            done = min(TOP, n)
            start = self.order[:done]
            self._connect(level, start, start[None, :].repeat(done, 0))
            while done < sizes[level]:
                block = self.order[done : min(done + BLOCK, 2 * done, sizes[level])]
                found, _ = self._beam(level, self.x[block], self._entries(self.x[block], level), BUILD_BEAM)
                self._connect(level, block, np.concatenate([found, block[None, :].repeat(len(block), 0)], 1))
                done += len(block)

    def save(self, put: Callable[[str, np.ndarray], None]) -> None:
        """Hand what searches need to ``put`` as named arrays."""
        put("x", self.x)
        put("order", self.order[: max(TOP, *self.sizes[1:], 0) if len(self.sizes) > 1 else TOP])
        put("facts", np.array([self.beam, self.exact, *self.sizes], np.int64))
        for i, layer in enumerate(self.layers):
            put(f"links{i}", layer.links)

    @classmethod
    def load(cls, get: Callable[[str], np.ndarray]) -> "Graph":
        g = cls.__new__(cls)
        g.x, g.order, facts = get("x"), get("order"), get("facts").tolist()
        g.beam, g.exact, g.sizes = facts[0], bool(facts[1]), facts[2:]
        g.layers = [Layer.__new__(Layer) for _ in g.sizes]
        for i, layer in enumerate(g.layers):
            layer.links = get(f"links{i}")
        return g

    def _entries(self, q: np.ndarray, level: int) -> np.ndarray:
        """Where searches of ``level`` begin: the best of the top, made better by each layer between."""
        top = self.order[: min(TOP, len(self.order))]
        best = top[np.argsort(-(q @ self.x[top].T), 1)[:, :4]]
        for upper in range(len(self.sizes) - 1, level, -1):
            best = self._beam(upper, q, best, 8)[0][:, :4]
        return best

    def _beam(self, level: int, q: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes met for each query (-1: none) in falling similarity."""
        links, b = self.layers[level].links, len(q)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, len(self.x) + 1), bool)  # the last column is for -1
        seen[:, -1] = True
        nodes = np.where(np.sort(entries, 1) == np.pad(np.sort(entries, 1)[:, :-1], ((0, 0), (1, 0)), constant_values=-2), -1, np.sort(entries, 1))
        sims = np.where(nodes >= 0, np.einsum("bkd,bd->bk", self.x[nodes], q), -9)
        seen[rows, nodes] = True
        nodes, sims = np.pad(nodes, ((0, 0), (0, beam)), constant_values=-1), np.pad(sims, ((0, 0), (0, beam)), constant_values=-9)
        order = np.argsort(-sims, 1)[:, :beam]
        nodes, sims = nodes[rows, order], sims[rows, order]
        done = nodes < 0
        live = np.arange(b)
        out_n, out_s = nodes, sims
        step = max(2, beam // 24)
        while len(live):
            first = np.argsort(done[live], 1, kind="stable")[:, :step]  # the best ones not yet followed
            r = live[:, None]
            ask = np.where(done[r, first], -1, out_n[r, first])
            done[r, first] = True
            near = np.where(ask[:, :, None] >= 0, links[ask], -1).reshape(len(live), -1)
            near = np.where(seen[r, near], -1, near)
            near.sort(1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            seen[r, near] = True
            width = int((near >= 0).sum(1).max())
            if width:
                near = -np.sort(-near, 1)[:, :width]
                s = np.where(near >= 0, np.einsum("bkd,bd->bk", self.x[near], q[live]), -9)
                all_n, all_s = np.concatenate([out_n[live], near], 1), np.concatenate([out_s[live], s], 1)
                all_d = np.concatenate([done[live], near < 0], 1)
                order = np.argsort(-all_s, 1)[:, :beam]
                k = np.arange(len(live))[:, None]
                out_n[live], out_s[live], done[live] = all_n[k, order], all_s[k, order], all_d[k, order]
            live = live[~done[live].all(1)]
        return out_n, out_s

    def _choose(self, nodes: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of the candidates of each node, KEPT ones: first those nearer to it than to any chosen
        before, then the nearest of the rest; -1 fills up."""
        near = np.where(near == nodes[:, None], -1, near)
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        s = np.where(near >= 0, np.einsum("bkd,bd->bk", self.x[near], self.x[nodes]), -9)
        order = np.argsort(-s, 1)[:, : 3 * KEPT]
        k = np.arange(len(nodes))[:, None]
        near, s = near[k, order], s[k, order]
        v = self.x[near]
        between = np.einsum("bid,bjd->bij", v, v)
        chosen = np.zeros(near.shape, bool)
        closest = np.full(near.shape, -9.0)  # similarity to the chosen ones
        for j in range(near.shape[1]):
            take = (near[:, j] >= 0) & (closest[:, j] < s[:, j]) & (chosen.sum(1) < KEPT)
            chosen[:, j] = take
            closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
        rank = np.argsort(np.where(near < 0, 2, np.where(chosen, 0, 1)), 1, kind="stable")[:, :KEPT]
        return near[k, rank]

    def _connect(self, level: int, nodes: np.ndarray, near: np.ndarray) -> None:
        layer = self.layers[level]
        chosen = self._choose(nodes, near)
        width = chosen.shape[1]
        layer.links[nodes, :width] = chosen
        layer.links[nodes, width:] = -1
        layer.degree[nodes] = (chosen >= 0).sum(1)
        # links back
        to, source = chosen.ravel(), np.repeat(nodes, width)
        to, source = to[to >= 0], source[chosen.ravel() >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        target, first, count = np.unique(to, return_index=True, return_counts=True)
        nth = np.arange(len(to)) - np.repeat(first, count)
        full = target[layer.degree[target] + count > ROOM]
        for i in range(0, len(full), BLOCK):
            part = full[i : i + BLOCK]
            cut = self._choose(part, layer.links[part])
            layer.links[part] = -1
            layer.links[part, : cut.shape[1]] = cut
            layer.degree[part] = (cut >= 0).sum(1)
        place = layer.degree[to] + nth
        fits = place < ROOM
        layer.links[to[fits], place[fits]] = source[fits]
        layer.degree[target] = np.minimum(layer.degree[target] + count, ROOM)

    def _all(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, node) with similarity ``least`` or more, by comparing blocks of queries with every node."""
        hits = [np.nonzero(q[i : i + BLOCK] @ self.x.T >= least) for i in range(0, len(q), BLOCK)]
        return np.concatenate([a + i * BLOCK for i, (a, _) in enumerate(hits)]), np.concatenate([b for _, b in hits])

    def near(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) with similarity ``least`` or more; where all of a beam is that near, the
        query is searched again with a wider one. A graph that failed its audit compares all."""
        if self.exact:
            return self._all(q, least)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        left = np.arange(len(q))
        while len(left):
            again = []
            size = max(8, BLOCK * FIRST_BEAM // beam)
            for i in range(0, len(left), size):
                part = left[i : i + size]
                n, s = self._beam(0, q[part], self._entries(q[part], 0), min(beam, len(self.x)))
                short = (s[:, -1] >= least) & (n.shape[1] < len(self.x)) & (beam < WIDEST_BEAM * 64)
                again.append(part[short])
                hit = (s >= least) & ~short[:, None] & (n >= 0)
                found.append((part[np.nonzero(hit)[0]], n[hit]))
            left, beam = np.concatenate(again), beam * 4
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def hits(self, q: np.ndarray, least: float):
        """The pairs of ``near``, a block of queries at a time: (number of the block's first query, query in it, node)."""
        for i in range(0, len(q), BLOCK):
            yield i, *self.near(q[i : i + BLOCK], least, self.beam)

    def _sample(self, least: float, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors that have neighbours, in a random order, and all pairs (place in it, node) of them and their
        neighbours: ``sample`` vectors and as many more as GROUPS asks for, or all that the shard has. The neighbours of
        the first BRUTE_FORCED vectors looked at are found by brute force, so that the cost of an audit doesn't grow with the
        square of a shard in which few vectors have any; those of the others by a far wider beam."""
        order = np.random.default_rng(2).permutation(len(self.x))
        picks, places, nodes, n, groups = [], [], [], 0, 0.0
        for i in range(0, len(order), BLOCK):
            part = order[i : i + BLOCK]
            a, b = self._all(self.x[part], least) if i < BRUTE_FORCED else self.near(self.x[part], least, WIDER * self.beam)
            a, b = a[part[a] != b], b[part[a] != b]  # a vector is no neighbour of itself
            count = np.bincount(a, minlength=len(part))
            take = (count > 0) & ((count <= FEW) | (n + np.cumsum(count > 0) <= sample))
            place = n + np.cumsum(take) - 1
            picks.append(part[take])
            places.append(place[a[take[a]]].astype(np.int32))
            nodes.append(b[take[a]].astype(np.int32))
            n += int(take.sum())
            groups += float((1 / count[take]).sum())
            if n >= sample and groups >= GROUPS:
                break
        return np.concatenate(picks), np.concatenate(places), np.concatenate(nodes)

    def recall_of(self, q: np.ndarray, least: float) -> tuple[int, int]:
        """How many pairs of the queries ``q`` and near nodes there are, by brute force, and how many of them a search finds."""
        a, b = self._all(q, least)
        found = np.zeros((len(q), len(self.x)), bool)
        found[self.near(q, least - SLACK, self.beam)] = True
        return len(a), int(found[a, b].sum())

    def audit(self, least: float, recall: float, sample: int) -> float:
        """Widen the beam until the graph finds the share ``recall`` of the true neighbours of a sample's vector,
        averaged both over its vectors and over the groups they stand for, so that no large group hides what is
        missed beside it. If the widest beam doesn't, searches compare all from then on."""
        pick, places, nodes = self._sample(least, sample)
        if not len(pick):
            return 1.0
        n, true = len(self.x), np.bincount(places, minlength=len(pick))
        start = np.concatenate([[0], np.cumsum(true)])
        while True:
            share = np.zeros(len(pick))
            for i in range(0, len(pick), BLOCK):
                part = pick[i : i + BLOCK]
                found = np.zeros((len(part), n), bool)
                found[self.near(self.x[part], least - SLACK, self.beam)] = True
                own = slice(start[i], start[i + len(part)])
                share[i : i + BLOCK] = np.bincount(places[own] - i, found[places[own] - i, nodes[own]], len(part)) / true[i : i + BLOCK]
            got = min(share.mean(), np.average(share, weights=1 / true))
            if got >= recall:
                return float(got)
            if self.beam >= min(WIDEST_BEAM, n):
                self.exact = True
                return 1.0
            self.beam *= 2
