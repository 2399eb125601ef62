"""A navigable small-world index over unit vectors, built and searched in vectorised batches.

Vectors within cosine 0.999 of an earlier one join its group; the graph holds
the group leaders only, so thousands of near-equal vectors are one node and
cannot fill every neighbour list around them.
"""

from __future__ import annotations

import io

import numpy as np

GROUP = 0.999
_BATCH = 1024


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, whatever their magnitude."""
    own = raw.astype(np.float64)
    own /= np.abs(own).max(axis=1, keepdims=True)
    return own / np.linalg.norm(own, axis=1, keepdims=True)


class Index:
    """Groups of vectors, taken at length 1, and a layered graph over their leaders."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, links: int = 24, ef: int = 48, seed: int = 7):
        with np.errstate(over="ignore"):
            single = raw.astype(np.float32)
        self.ids, self.raw, self.vectors = ids, single if (single == raw).all() else raw, unit(raw)
        self.links = links
        vectors = self.vectors
        n = len(ids)
        self.group = np.full(n, -1, np.int64)  # of each vector, an index into leaders
        self.leaders = np.zeros(0, np.int64)  # rows of vectors
        self.near = np.zeros((0, 2 * links), np.int32)
        self.flat = np.zeros((0, vectors.shape[1]), np.float32)
        self.upper: list[tuple[np.ndarray, np.ndarray]] = []
        self.level = np.zeros(0, np.int64)
        rng = np.random.default_rng(seed)
        at = 0
        while at < n:
            step = min(_BATCH, max(64, len(self.leaders)))
            self._insert(np.arange(at, min(n, at + step)), ef, rng)
            at += step
        self._members()

    def _members(self) -> None:
        self.order = np.argsort(self.group, kind="stable")
        self.start = np.searchsorted(self.group[self.order], np.arange(len(self.leaders) + 1))
        cos = np.einsum("ij,ij->i", self.vectors, self.vectors[self.leaders[self.group]]) if len(self.group) else np.zeros(0)
        self.radius = np.zeros(len(self.leaders))
        np.maximum.at(self.radius, self.group, np.arccos(np.clip(cos, -1, 1)))

    def members(self, g: int) -> np.ndarray:
        return self.order[self.start[g] : self.start[g + 1]]

    def _insert(self, rows: np.ndarray, ef: int, rng: np.random.Generator) -> None:
        new = self.vectors[rows]
        old = len(self.leaders)
        found, sims = self.search(new.astype(np.float32), ef) if old else (np.full((len(rows), 0), -1), np.zeros((len(rows), 0)))
        if old:
            exact = np.einsum("ij,ij->i", new, self.vectors[self.leaders[found[:, 0]]])
            joins = exact >= GROUP
            self.group[rows[joins]] = found[joins, 0]
            rows, new, found, sims = rows[~joins], new[~joins], found[~joins], sims[~joins]
        among = new @ new.T
        leads = []
        free = np.ones(len(rows), bool)
        for i in range(len(rows)):
            if free[i]:
                mine = free & (among[i] >= GROUP)
                mine[i] = True
                self.group[rows[mine]] = old + len(leads)
                free &= ~mine
                leads.append(i)
        if not leads:
            return
        among, found, sims = among[np.ix_(leads, leads)].astype(np.float32), found[leads], sims[leads]
        self.leaders = np.concatenate([self.leaders, rows[leads]])
        self.flat = np.concatenate([self.flat, new[leads].astype(np.float32)])
        self.near = np.concatenate([self.near, np.full((len(leads), 2 * self.links), -1, np.int32)])
        self.level = np.concatenate([self.level, np.minimum(6, rng.exponential(1 / np.log(16), len(leads)).astype(np.int64))])
        np.fill_diagonal(among, -2)
        inner = np.argsort(-among, axis=1)[:, : self.links]
        every = np.concatenate([found, old + inner], axis=1)
        value = np.concatenate([sims, np.take_along_axis(among, inner, 1)], axis=1)
        value[every < 0] = -2
        best = np.argsort(-value, axis=1)[:, : self.links]
        chosen, worth = np.take_along_axis(every, best, 1), np.take_along_axis(value, best, 1)
        for i in range(len(leads)):
            mine = chosen[i][worth[i] > -2]
            self.near[old + i, : len(mine)] = mine
        back: dict[int, list[int]] = {}
        for i in range(len(leads)):
            for v in chosen[i][worth[i] > -2].tolist():
                back.setdefault(v, []).append(old + i)
        for v, more in back.items():
            own = np.unique(np.concatenate([self.near[v][self.near[v] >= 0], np.array(more, np.int32)]))
            if len(own) > 2 * self.links:
                own = own[np.argsort(-(self.flat[own] @ self.flat[v]), kind="stable")[: 2 * self.links]]
            self.near[v] = -1
            self.near[v, : len(own)] = own
        self._layers()

    def _layers(self) -> None:
        """Upper layers: about one node in 16 of the layer below, with their nearest neighbours."""
        self.upper = []
        for level in range(1, int(self.level.max(initial=0)) + 1):
            nodes = np.flatnonzero(self.level >= level)
            sims = self.flat[nodes] @ self.flat[nodes].T
            np.fill_diagonal(sims, -2)
            k = min(self.links, len(nodes) - 1)
            near = np.full((len(nodes), max(1, k)), -1, np.int64)
            if k > 0:
                near[:, :k] = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            self.upper.append((nodes, near))

    def _entry(self, queries: np.ndarray) -> np.ndarray:
        """The layer-0 node each query starts from, by greedy descent."""
        if not self.upper:
            return np.zeros(len(queries), np.int64)
        nodes, _ = self.upper[-1]
        at = nodes[np.argmax(queries @ self.flat[nodes].T, axis=1)]
        for nodes, near in reversed(self.upper[:-1]):
            here = np.searchsorted(nodes, at)
            sim = np.einsum("ij,ij->i", queries, self.flat[nodes[here]])
            moving = np.ones(len(queries), bool)
            while moving.any():
                q = np.flatnonzero(moving)
                step = near[here[q]]
                s = np.einsum("ij,ikj->ik", queries[q], self.flat[nodes[step]])
                s[step < 0] = -2
                top = np.argmax(s, axis=1)
                gain = s[np.arange(len(q)), top] > sim[q]
                moving[q[~gain]] = False
                q, top, s, step = q[gain], top[gain], s[gain], step[gain]
                here[q], sim[q] = step[np.arange(len(q)), top], s[np.arange(len(q)), top]
            at = nodes[here]
        return at

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` best leaders found for each query, best first; -1 fills up."""
        rows = max(1, min(len(queries), (1 << 25) // max(1, len(self.leaders))))
        parts = [self._beam(queries[i : i + rows], ef) for i in range(0, len(queries), rows)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _beam(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(queries), len(self.leaders)
        if ef >= m:
            sims = queries @ self.flat.T
            order = np.argsort(-sims, axis=1)
            return order, np.take_along_axis(sims, order, 1)
        ids, sims, done = np.full((n, ef), -1, np.int64), np.full((n, ef), -2.0, np.float32), np.ones((n, ef), bool)
        seen = np.zeros((n, m), bool)
        start = self._entry(queries)
        ids[:, 0], done[:, 0] = start, False
        sims[:, 0] = np.einsum("ij,ij->i", queries, self.flat[start])
        seen[np.arange(n), start] = True
        live = np.arange(n)
        while len(live):
            open_sims = np.where(done[live], -3, sims[live])
            pick = np.argmax(open_sims, axis=1)
            live_ok = open_sims[np.arange(len(live)), pick] > -3
            live, pick = live[live_ok], pick[live_ok]
            if not len(live):
                break
            node = ids[live, pick]
            done[live, pick] = True
            near = self.near[node]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[np.repeat(live, fresh.sum(axis=1)), near[fresh]] = True
            s = np.einsum("ij,ikj->ik", queries[live], self.flat[near])
            s[~fresh] = -2
            width = near.shape[1]
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
            all_sims = np.concatenate([sims[live], s], axis=1)
            all_done = np.concatenate([done[live], ~fresh], axis=1)
            keep = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef] if width else np.arange(ef)[None]
            ids[live], sims[live], done[live] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_sims, all_done))
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def within(self, queries: np.ndarray, least: float, ef: int) -> list[np.ndarray]:
        """Leaders found with cosine >= ``least``: beams double until they reach below it."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        left = np.arange(len(queries))
        while len(left):
            ids, sims = self.search(queries[left], ef)
            enough = (sims[:, -1] < least) | (ids[:, -1] < 0) | (ef >= len(self.leaders))
            for i in np.flatnonzero(enough):
                out[left[i]] = ids[i][(sims[i] >= least) & (ids[i] >= 0)]
            left, ef = left[~enough], 2 * ef
        return out

    def dump(self, graph: bool = True) -> bytes:
        """Bytes for ``load``; without the graph it can be asked, but not searched."""
        file = io.BytesIO()
        parts = {"ids": self.ids, "raw": self.raw, "group": self.group, "leaders": self.leaders}
        if graph:
            parts |= {"near": self.near, "level": self.level, "links": np.array(self.links)}
            parts |= {f"nodes{i}": x[0] for i, x in enumerate(self.upper)} | {f"near{i}": x[1] for i, x in enumerate(self.upper)}
        np.savez(file, **parts)
        return file.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Index:
        own = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as x:
            own.ids, own.raw, own.group, own.leaders = (x[k] for k in ("ids", "raw", "group", "leaders"))
            if "near" in x.files:
                own.near, own.level, own.links = x["near"], x["level"], int(x["links"])
                own.upper = [(x[f"nodes{i}"], x[f"near{i}"]) for i in range(sum(k.startswith("nodes") for k in x.files))]
        own.vectors = unit(own.raw)
        own.flat = own.vectors[own.leaders].astype(np.float32)
        own._members()
        return own
