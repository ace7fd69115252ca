"""A hierarchical navigable small-world graph over one shard, in flat arrays.

Points are unit rows of a matrix; ``graph[level]`` holds each point's neighbours at that level, -1
where there is none. Points are inserted, and queries walked, a block at a time.
"""

import numpy as np

#: Neighbours of a point (twice as many at the ground), beam widths of building and of search.
M, BUILD_BEAM, BEAM = 16, 64, 96
_BLOCK, _STEP = 256, 4


def levels(n: int, seed: int = 7) -> np.ndarray:
    """Random level of each point: each level holds 1/M of the one below."""
    u = np.random.default_rng(seed).random(n)
    return np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(M)).astype(np.int8)


def _dots(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.matmul(rows, one[:, :, None])[:, :, 0]


def beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int):
    """Best-first walk of all queries at one level from ``entry`` (a row each): points and similarities, best first."""
    q = len(queries)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, len(x) + 1), bool)
    seen[:, -1] = True
    seen[rows, entry] = True
    sim = _dots(x[entry], queries)
    sim[entry < 0] = -np.inf
    point, done = entry.copy(), np.zeros(entry.shape, bool)
    done[entry < 0] = True
    while True:
        order = np.argsort(np.where(done, np.inf, -sim), axis=1, kind="stable")[:, :_STEP]
        fresh = ~np.take_along_axis(done, order, 1)
        live = np.flatnonzero(fresh.any(axis=1))
        if not len(live):
            break
        order, fresh = order[live], fresh[live]
        done[live[:, None], order] = True
        at = np.where(fresh, point[live[:, None], order], -1)
        near = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], near]] = -1
        seen[live[:, None], near] = True
        got = _dots(x[near], queries[live])
        got[near < 0] = -np.inf
        sims = np.concatenate([sim[live], got], axis=1)
        points = np.concatenate([point[live], near], axis=1)
        dones = np.concatenate([done[live], near < 0], axis=1)
        if sims.shape[1] > width:
            best = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            sims, points, dones = (np.take_along_axis(a, best, 1) for a in (sims, points, dones))
        if sims.shape[1] > sim.shape[1]:
            pad = ((0, 0), (0, sims.shape[1] - sim.shape[1]))
            sim, point, done = (np.pad(a, pad, constant_values=v) for a, v in ((sim, -np.inf), (point, -1), (done, True)))
        sim[live], point[live], done[live] = sims, points, dones
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(point, order, 1), np.take_along_axis(sim, order, 1)


def diverse(x: np.ndarray, owner: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """Of each owner's candidates, up to ``most``: those nearer to it than to a better one first, then the rest."""
    sim = _dots(x[cand], x[owner])
    sim[(cand < 0) | (cand == owner[:, None])] = -np.inf
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    valid = np.isfinite(sim)
    valid[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    among = np.matmul(x[cand], x[cand].transpose(0, 2, 1))
    taken = np.zeros(cand.shape, bool)
    for i in range(cand.shape[1]):
        clash = (taken[:, :i] & (among[:, i, :i] > sim[:, i, None])).any(axis=1)
        taken[:, i] = valid[:, i] & ~clash & (taken[:, :i].sum(axis=1) < most)
    rank = np.where(taken, 0, np.where(valid, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(cand, order, 1)
    return np.where(np.take_along_axis(rank, order, 1) < 2, out, -1)


def _connect(x: np.ndarray, links: np.ndarray, new: np.ndarray, cand: np.ndarray) -> None:
    """Link ``new`` points to the best of their candidates, and those back to them."""
    most = links.shape[1]
    chosen = diverse(x, new, cand, most // 2)
    links[new, : chosen.shape[1]] = chosen
    owner = np.repeat(new, chosen.shape[1])
    there = chosen.ravel()
    owner, there = owner[there >= 0], there[there >= 0]
    order = np.argsort(there, kind="stable")
    owner, there = owner[order], there[order]
    ends, start, count = np.unique(there, return_index=True, return_counts=True)
    for a in range(0, len(ends), _BLOCK):
        e, s, c = ends[a : a + _BLOCK], start[a : a + _BLOCK], count[a : a + _BLOCK]
        extra = np.arange(c.max())[None, :]
        added = np.where(extra < c[:, None], owner[np.minimum(s[:, None] + extra, len(owner) - 1)], -1)
        both = np.concatenate([links[e], added], axis=1)
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        full = (both >= 0).sum(axis=1) > most
        links[e] = both[:, :most]
        if full.any():
            kept = diverse(x, e[full], both[full], most)
            links[e[full], : kept.shape[1]] = kept


def build(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Levels of the points and the graph of unit rows ``x`` (single precision)."""
    n = len(x)
    level = levels(n)
    # Points of the upper levels go first, so that every later walk starts from a finished hierarchy.
    order = np.argsort(-level, kind="stable")
    graph = [np.full((n, 2 * M if h == 0 else M), -1, np.int32) for h in range(int(level.max(initial=0)) + 1)]
    for a in range(0, n, _BLOCK):
        new = order[a : a + _BLOCK]
        before = order[:a]
        entry = np.full((len(new), 1), order[0])
        peers = x[new] @ x[new].T
        np.fill_diagonal(peers, -np.inf)
        for h in range(len(graph) - 1, -1, -1):
            if len(before):
                point, _ = beam(x, graph[h], x[new], entry, BUILD_BEAM if (level[new] >= h).any() else 4)
                entry = point[:, :4]
            else:
                point = np.full((len(new), 1), -1)
            mine = np.flatnonzero(level[new] >= h)
            if not len(mine):
                continue
            near = np.argsort(-peers[np.ix_(mine, mine)], axis=1, kind="stable")[:, :M]
            near = new[mine][near]
            _connect(x, graph[h], new[mine], np.concatenate([point[mine], near], axis=1))
    return level, graph


def search(x: np.ndarray, level: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, width: int = BEAM) -> np.ndarray:
    """Up to ``width`` points near each query, nearest first, -1 where there are fewer."""
    out = []
    for a in range(0, len(queries), _BLOCK):
        q = queries[a : a + _BLOCK]
        entry = np.full((len(q), 1), int(np.argmax(level)))
        for h in range(len(graph) - 1, 0, -1):
            entry = beam(x, graph[h], q, entry, 8)[0][:, :4]
        point = beam(x, graph[0], q, entry, width)[0]
        out.append(np.pad(point, ((0, 0), (0, max(0, width - point.shape[1]))), constant_values=-1))
    most = max((o.shape[1] for o in out), default=0)
    return np.concatenate([np.pad(o, ((0, 0), (0, most - o.shape[1])), constant_values=-1) for o in out]) if out else np.zeros((0, 0), np.int64)
