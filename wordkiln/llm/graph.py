"""Navigable small-world graph over Hamming distance, built and searched in batches of numpy rows."""

from __future__ import annotations

import numpy as np

from .common import mix

BATCH = 512


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points whose last axis holds the fingerprint's uint64 words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _jitter(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In [0, 1), by both points alike: parts ties at random, or the same few of many equally near would get all links."""
    x = np.minimum(a, b).astype(np.uint64) << np.uint64(32) | np.maximum(a, b).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    return (mix(x, 13) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class SmallWorld:
    """Points enter in a random order, each linked to the nearest found so far and back, so early links reach far.

    Up to `complete` points every point is linked to every other, and a search is exact. Points must be distinct.
    """

    def __init__(self, points: np.ndarray, forward: int = 10, back: int = 22, beam: int = 24, complete: int = 256):
        order = np.argsort(mix(points[:, 0] ^ mix(points[:, 1], 3), 7), kind="stable")
        self.order, self.points, self.n = order, points[order], len(points)
        self.complete = self.n <= complete
        if self.complete:
            return
        self.forward, self.width = forward, forward + back
        self.links = np.full((self.n, self.width), -1, dtype=np.int64)
        self.far = np.full((self.n, self.width), 1e6)
        self.filled = 0
        while self.filled < self.n:
            at, end = self.filled, min(self.n, max(64, min(self.filled + BATCH, 2 * self.filled)))
            new = self.points[at:end]
            among = hamming(new[:, None], new[None])
            np.fill_diagonal(among, 1 << 20)
            ids, dist = np.broadcast_to(np.arange(at, end), among.shape), among
            if at:
                found, d = self.search(new, beam)
                ids, dist = np.concatenate([found, ids], axis=1), np.concatenate([d, dist], axis=1)
            k = min(forward, ids.shape[1] - (at == 0))
            dist = dist + _jitter(np.arange(at, end)[:, None], ids)
            best = np.argsort(dist, axis=1, kind="stable")[:, :k]
            self.filled = end
            ids, dist = np.take_along_axis(ids, best, 1), np.take_along_axis(dist, best, 1)
            self.links[at:end, :k], self.far[at:end, :k] = ids, dist
            self._link_back(np.repeat(np.arange(at, end), k), ids.ravel(), dist.ravel())

    def _link_back(self, source: np.ndarray, target: np.ndarray, dist: np.ndarray) -> None:
        """target gets a link to source in its back slots, which hold the nearest; its own links always stay."""
        keep = dist < 1e6
        source, target, dist = source[keep], target[keep], dist[keep]
        s = np.lexsort((source, dist, target))
        source, target, dist = source[s], target[s], dist[s]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        rank = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
        back = self.width - self.forward
        keep = rank < back
        rows = target[first]
        slot = np.searchsorted(rows, target[keep])
        ids, far = np.full((len(rows), back), -1, dtype=np.int64), np.full((len(rows), back), 1e6)
        ids[slot, rank[keep]], far[slot, rank[keep]] = source[keep], dist[keep]
        ids, far = np.concatenate([self.links[rows, self.forward :], ids], 1), np.concatenate([self.far[rows, self.forward :], far], 1)
        best = np.argsort(far, axis=1, kind="stable")[:, :back]
        self.links[rows, self.forward :], self.far[rows, self.forward :] = np.take_along_axis(ids, best, 1), np.take_along_axis(far, best, 1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam nearest points found: positions (-1: none) and distances, nearest first."""
        ids, dist = (np.concatenate(x) for x in zip(*(self._search(queries[i : i + BATCH], beam) for i in range(0, len(queries), BATCH)), strict=True))
        return ids, dist

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n = self.n if self.complete else self.filled
        entries = np.arange(n) if self.complete else np.arange(min(n, 64))
        d = hamming(q[:, None], self.points[entries][None])
        key = np.sort((d << 33) | (entries << 1)[None], axis=1)[:, :beam]
        if key.shape[1] < beam:
            key = np.concatenate([key, np.full((len(q), beam - key.shape[1]), 1 << 60, dtype=np.int64)], axis=1)
        if not self.complete:
            self._walk(q, key)
        ids, dist = (key >> 1) & 0xFFFFFFFF, key >> 33
        return np.where(key >= 1 << 60, -1, ids), np.where(key >= 1 << 60, 1 << 20, dist)

    def _walk(self, q: np.ndarray, key: np.ndarray) -> None:
        """Expand the nearest point of each beam that hasn't been, until none is left; the lowest bit marks expanded ones."""
        active, beam = np.arange(len(q)), key.shape[1]
        while len(active):
            k = key[active]
            fresh = (k & 1 == 0) & (k < 1 << 60)
            at = fresh.argmax(axis=1)
            some = fresh[np.arange(len(active)), at]
            active, k, at = active[some], k[some], at[some]
            if not len(active):
                return
            rows = np.arange(len(active))
            node = (k[rows, at] >> 1) & 0xFFFFFFFF
            k[rows, at] |= 1
            near = self.links[node]
            d = hamming(q[active][:, None], self.points[near])
            seen = ((k >> 1) & 0xFFFFFFFF)[:, None, :] == near[:, :, None]
            new = np.where((near < 0) | (near >= self.filled) | seen.any(axis=2), 1 << 60, (d << 33) | (near << 1))
            new.sort(axis=1)
            new[:, 1:][(new[:, 1:] == new[:, :-1])] = 1 << 60
            key[active] = np.sort(np.concatenate([k, new], axis=1), axis=1)[:, :beam]

    def within(self, queries: np.ndarray, radius: int, beam: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of query, position, distance) of the points found within the radius."""
        z = np.zeros(0, dtype=np.int64)
        r, p, d = (np.concatenate(x) for x in zip((z, z, z), *self.pieces(queries, radius, beam), strict=True))
        return r, p, d

    def pieces(self, queries: np.ndarray, radius: int, beam: int = 16):
        """within() piece by piece, so that a ball of many points is never held as pairs.

        A beam that ends full of points within the radius may have missed more: it is widened fourfold and searched
        again, and if it fills again the query is compared with every point.
        """
        rows = np.arange(len(queries))
        for width in (beam, 4 * beam):
            if not len(rows) or width >= self.n or self.complete:
                break
            ids, dist = self.search(queries[rows], width)
            full = dist[:, -1] <= radius
            r, c = np.nonzero((dist <= radius) & ~full[:, None])
            yield rows[r], self.order[ids[r, c]], dist[r, c]
            rows = rows[full]
        for i in range(0, len(rows), 64):
            d = hamming(queries[rows[i : i + 64]][:, None], self.points[None])
            r, c = np.nonzero(d <= radius)
            yield rows[i + r], self.order[c], d[r, c]
