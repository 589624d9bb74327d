"""A hierarchical navigable small-world graph over unit vectors, built and searched in batches with numpy."""

import numpy as np

#: Links per node above the lowest layer (twice as many in it), and beam while building.
LINKS, BUILD_BEAM = 12, 32
#: Nodes that are inserted or queried together.
BATCH = 256


def _prune(own: np.ndarray, ids: np.ndarray, sims: np.ndarray, vectors: np.ndarray, links: int) -> np.ndarray:
    """Choose ``links`` of each row's candidates (-1: none; sorted by descending sims).

    A candidate closer to one already chosen than to the row's own vector waits; waiting ones fill what is left, so
    that dense groups of near copies stay connected among themselves and with the rest.
    """
    rows, width = ids.shape
    between = np.einsum("rid,rjd->rij", vectors[ids], vectors[ids])
    chosen = np.zeros((rows, width), bool)
    count = np.zeros(rows, np.int64)
    valid = ids >= 0
    for j in range(width):
        closer = (np.where(chosen, between[:, j, :], -2).max(axis=1) > sims[:, j]) if j else np.zeros(rows, bool)
        take = valid[:, j] & ~closer & (count < links)
        chosen[:, j] = take
        count += take
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :links]
    out = np.take_along_axis(np.where(valid, ids, -1), order, 1)
    if out.shape[1] < links:
        out = np.concatenate([out, np.full((rows, links - out.shape[1]), -1, out.dtype)], axis=1)
    return out


class Hnsw:
    """``layers[l]`` holds the links (-1: none) of all nodes in layer l; a node is in the layers up to its level."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, layers: list[np.ndarray] | None = None):
        self.vectors, self.levels = np.ascontiguousarray(vectors, np.float32), levels
        self.entry = int(np.argmax(levels)) if len(levels) else -1
        if layers is not None:
            self.layers = layers
            return
        self.layers = [np.full((len(vectors), LINKS * (2 if level == 0 else 1)), -1, np.int32)
                       for level in range(int(levels.max()) + 1 if len(levels) else 1)]
        order = np.argsort(-levels, kind="stable")  # top layers first: every insertion finds the way down
        done, step = 1, 1
        while done < len(order):
            self._insert(order[:done], order[done:done + step])
            done += step
            step = min(BATCH, max(1, done))  # a batch never doubles the graph, so it finds most neighbours in it

    @staticmethod
    def draw_levels(keys: np.ndarray) -> np.ndarray:
        """Geometric levels from 64-bit hashes of the nodes."""
        u = (keys.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        return np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)).astype(np.int64), 6)

    def _insert(self, present: np.ndarray, new: np.ndarray) -> None:
        queries = self.vectors[new]
        entry = np.full((len(new), 1), present[0], np.int64)
        for level in range(int(self.levels[present[0]]), -1, -1):
            ids, sims = self._beam(queries, entry, level, BUILD_BEAM if level <= self.levels[new].max() else 1)
            entry = ids
            inside = np.nonzero(self.levels[new] >= level)[0]
            if not len(inside):
                continue
            # the batch's own members are candidates too
            peers = new[inside]
            mutual = queries[inside] @ queries[inside].T
            np.fill_diagonal(mutual, -2)
            k = min(8, len(peers) - 1)
            near = np.argpartition(-mutual, k, axis=1)[:, :k] if k > 0 else np.empty((len(peers), 0), np.int64)
            all_ids = np.concatenate([ids[inside], peers[near]], axis=1)
            all_sims = np.concatenate([sims[inside], np.take_along_axis(mutual, near, 1)], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")
            all_ids, all_sims = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)
            links = self.layers[level].shape[1]
            chosen = _prune(queries[inside], all_ids, all_sims, self.vectors, max(LINKS, links // 2))
            self.layers[level][peers, : chosen.shape[1]] = chosen
            self._link_back(level, peers, chosen)

    def _link_back(self, level: int, new: np.ndarray, chosen: np.ndarray) -> None:
        table = self.layers[level]
        to, source = chosen.ravel(), np.repeat(new, chosen.shape[1])
        keep = to >= 0
        to, source = to[keep], source[keep]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        nodes, first, size = np.unique(to, return_index=True, return_counts=True)
        extra = np.full((len(nodes), int(size.max()) if len(size) else 0), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), size), np.arange(len(to)) - np.repeat(first, size)] = source
        for k in range(0, len(nodes), BATCH):
            own = nodes[k:k + BATCH]
            ids = np.concatenate([table[own], extra[k:k + BATCH]], axis=1).astype(np.int64)
            ids.sort(axis=1)
            repeated = np.concatenate([np.zeros((len(ids), 1), bool), ids[:, 1:] == ids[:, :-1]], axis=1)
            ids[repeated] = -1
            sims = np.where(ids >= 0, np.einsum("rid,rd->ri", self.vectors[ids], self.vectors[own]), -2)
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * table.shape[1]]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            table[own] = _prune(self.vectors[own], ids, sims, self.vectors, table.shape[1])

    def _beam(self, queries: np.ndarray, entry: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes each query finds in a layer from its entry nodes: ids (-1: none) and cosines."""
        rows, links, n = len(queries), self.layers[level], len(self.vectors)
        seen = np.zeros((rows, n + 1), bool)  # the last column stands for "none"
        seen[:, n] = True
        entry = np.where(entry < 0, n, entry)
        ids = np.full((rows, beam), n, np.int64)
        sims = np.full((rows, beam), -2, np.float32)
        todo = np.zeros((rows, beam), bool)
        self._take(queries, np.arange(rows), entry, seen, ids, sims, todo)
        wide = max(2, beam // 16)
        while True:
            active = np.nonzero(todo.any(axis=1))[0]
            if not len(active):
                break
            score = np.where(todo[active], sims[active], -3)
            pick = np.argsort(-score, axis=1, kind="stable")[:, :wide]
            chosen = np.take_along_axis(todo[active], pick, 1)
            todo[active[:, None], pick] = False
            nodes = np.where(chosen, np.take_along_axis(ids[active], pick, 1), n)
            around = links[np.minimum(nodes, n - 1)]
            around = np.where((nodes < n)[:, :, None] & (around >= 0), around, n).reshape(len(active), -1)
            self._take(queries, active, around, seen, ids, sims, todo)
        return np.where(ids == n, -1, ids), sims

    def _take(self, queries, rows, nodes, seen, ids, sims, todo) -> None:
        """Offer nodes to the beams of some rows."""
        n, beam = len(self.vectors), ids.shape[1]
        nodes = np.sort(nodes, axis=1)
        nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = n
        new = ~seen[rows[:, None], nodes]
        nodes = np.where(new, nodes, n)
        seen[rows[:, None], nodes] = True
        r, c = np.nonzero(new)
        found = np.full(nodes.shape, -2, np.float32)
        found[r, c] = np.einsum("id,id->i", self.vectors[nodes[r, c]], queries[rows[r]])
        all_ids = np.concatenate([ids[rows], nodes], axis=1)
        all_sims = np.concatenate([sims[rows], found], axis=1)
        all_todo = np.concatenate([todo[rows], new], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[rows], sims[rows] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)
        todo[rows] = np.take_along_axis(all_todo, order, 1)

    def stray(self) -> np.ndarray:
        """Nodes that cannot be reached from the entry in the lowest layer."""
        seen, edge = np.zeros(len(self.vectors), bool), np.array([self.entry])
        while len(edge):
            seen[edge] = True
            around = self.layers[0][edge].ravel()
            edge = np.unique(around[around >= 0])
            edge = edge[~seen[edge]]
        return np.flatnonzero(~seen)

    def search(self, queries: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and cosines of the ``beam`` best nodes found for every query, best first.

        ``own``: nodes that the queries are, from which the search of the lowest layer starts as well.
        """
        parts = []
        beam = min(beam, len(self.vectors))
        for k in range(0, len(queries), BATCH):
            part = np.ascontiguousarray(queries[k:k + BATCH], np.float32)
            entry = np.full((len(part), 1), self.entry, np.int64)
            for level in range(len(self.layers) - 1, 0, -1):
                entry = self._beam(part, entry, level, 1)[0]
            if own is not None:
                entry = np.concatenate([entry, own[k:k + BATCH, None]], axis=1)
            parts.append(self._beam(part, entry, 0, beam))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
