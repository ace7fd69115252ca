"""A quadtree over a sparse grid whose cells hold the largest value below them, as flat arrays, and its joint best-first descent."""

from dataclasses import dataclass

import numpy as np

from tessera.llm.blocks import squeezed, unsqueezed

#: States that one item takes up in a step, best bounds first.
BEAM = 256
_BITS = np.array([bin(i).count("1") for i in range(16)], np.int32)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers moved to every second place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def build(row: np.ndarray, column: np.ndarray, value: np.ndarray) -> bytes:
    """The tree of points (each cell once, values of 0 or more): height, then four-bit masks of children and maxima of each level.

    A node's maximum is stored as what it lacks of its parent's, which is small, so levels compress well.
    """
    height = max(1, int(max(row.max(initial=0), column.max(initial=0))).bit_length())
    key = (_spread(row) << np.uint64(1)) | _spread(column)
    order = np.argsort(key)
    key, most = key[order], value[order].astype(np.int32)
    masks, lacks = [], []
    for _ in range(height):
        up = key >> np.uint64(2)
        start = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
        many = np.diff(np.append(start, len(key)))
        above = np.maximum.reduceat(most, start)
        masks.append(np.bitwise_or.reduceat(np.left_shift(1, (key & np.uint64(3)).astype(np.int32), dtype=np.int32), start))
        lacks.append(np.repeat(above, many) - most)
        key, most = up[start], above
    return squeezed(np.array([height, int(most[0])]), *masks[::-1], *lacks[::-1])


@dataclass
class Tree:
    """All levels in a row: a node's mask of children, its first child's number, its maximum."""

    height: int
    mask: np.ndarray
    child: np.ndarray
    most: np.ndarray


def load(blob: bytes) -> Tree:
    (height, top), *rest = unsqueezed(blob)
    masks, most = rest[:height], [np.array([top], np.int32)]
    for mask, lack in zip(masks, rest[height:], strict=True):
        most.append(np.repeat(most[-1], _BITS[mask]) - lack)
    mask = np.concatenate([*masks, np.zeros(len(most[-1]), np.int32)]).astype(np.uint8)
    child = np.ones(len(mask), np.int32)
    np.cumsum(_BITS[mask[:-1]], out=child[1:], dtype=np.int32)
    child[1:] += 1
    return Tree(int(height), mask, child, np.concatenate(most))


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """All numbers of several ranges, one range after the other."""
    return np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())


def search(tree: Tree, item: np.ndarray, row: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each item's ``k`` columns of largest sums over its rows of weight times value, over 0; equal sums by column.

    ``item`` is sorted. An item's state is a range of columns with one node for each of its rows' paths that go on there;
    its bound is the weighted sum of their maxima. Each step halves the best open ranges of every item, all paths
    of a range together. A range of one column has its sum as bound. Ranges that cannot come before the last
    of ``k`` found are closed. Returns items, columns and sums, an item's best first.
    """
    names, first = np.unique(item, return_index=True)
    n = len(names)
    found_item = found_column = found_sum = np.zeros(0, np.int64)
    if not n:
        return found_item, found_column, found_sum
    # A state: item (by place), level, column prefix, bound, and its entries' start and number. An entry: node, row, weight.
    many = np.diff(np.append(first, len(item)))
    bound = np.add.reduceat(weight * tree.most[0], first)
    state = np.stack([np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), bound, first, many])
    node, path, heavy = np.zeros(len(item), np.int64), row.astype(np.int64), weight.astype(np.int64)
    least, last = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    while state.shape[1]:
        left = state[2] << (tree.height - state[1])
        order = np.lexsort((left, -state[3], state[0]))
        state, left = state[:, order], left[order]
        place = np.arange(len(left)) - np.searchsorted(state[0], state[0])
        chosen, rest = state[:, place < BEAM], state[:, place >= BEAM]
        at = _ranges(chosen[4], chosen[5])
        of = np.repeat(np.arange(chosen.shape[1]), chosen[5])
        e_node, e_path, e_heavy = node[at], path[at], heavy[at]
        bit = (e_path >> (tree.height - 1 - chosen[1][of])) & 1
        halves = []
        for half in (0, 1):
            slot = 2 * bit + half
            mask = tree.mask[e_node].astype(np.int64)
            goes = (mask >> slot) & 1 == 1
            below = tree.child[e_node[goes]] + _BITS[mask[goes] & ((1 << slot[goes]) - 1)]
            halves.append((of[goes], below, e_path[goes], e_heavy[goes], half))
        opened = []
        for owner, below, paths, weights, half in halves:
            if not len(owner):
                continue
            start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            parent = chosen[:, owner[start]]
            bounds = np.add.reduceat(weights * tree.most[below], start)
            fresh = np.stack([parent[0], parent[1] + 1, 2 * parent[2] + half, bounds, start, np.diff(np.append(start, len(owner)))])
            opened.append((fresh, below, paths, weights))
        # What stays open keeps its entries; all entries are laid out anew.
        parts = [(rest, node, path, heavy), *opened]
        offset, states = 0, []
        for s, *_ in parts:
            s = s.copy()
            s[4] += offset
            states.append(s)
            offset += len(parts[len(states) - 1][1])
        state = np.concatenate(states, axis=1)
        node, path, heavy = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        leaf = (state[1] == tree.height) & (state[3] > 0)
        if leaf.any():
            found_item, found_column = np.append(found_item, state[0][leaf]), np.append(found_column, state[2][leaf])
            found_sum = np.append(found_sum, state[3][leaf])
            order = np.lexsort((found_column, -found_sum, found_item))
            found_item, found_column, found_sum = found_item[order], found_column[order], found_sum[order]
            place = np.arange(len(order)) - np.searchsorted(found_item, found_item)
            keep = place < k
            found_item, found_column, found_sum, place = found_item[keep], found_column[keep], found_sum[keep], place[keep]
            full = place == k - 1
            least[found_item[full]], last[found_item[full]] = found_sum[full], found_column[full]
        left = state[2] << (tree.height - state[1])
        floor, edge = least[state[0]], last[state[0]]
        open_ = (state[1] < tree.height) & (state[3] > 0) & ((state[3] > floor) | ((state[3] == floor) & (left < edge)))
        state = state[:, open_]
        at = _ranges(state[4], state[5])
        node, path, heavy = node[at], path[at], heavy[at]
        state[4] = np.cumsum(state[5]) - state[5]
    return names[found_item], found_column, found_sum
