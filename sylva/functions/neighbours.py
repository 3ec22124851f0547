"""Neighbours of points by cells, in arrays of many trees at once. Places are those of the arrays given."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Candidate pairs that are looked at together, the bound of memory in dense clouds.
PAIRS = 1 << 15
#: Pairs that are held for all rounds of a cover; where there are more, each round seeks them again.
LISTED = 1 << 23
#: Cells from a tree's minimum up to which they are told apart; what lies beyond shares the last one.
FARTHEST = 1 << 40


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed in the order of the axes."""
    d = a - b
    d *= d
    out = d[:, 0] + d[:, 1]
    out += d[:, 2]
    return out


def spread(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places lo[i], ..., lo[i] + n[i] - 1 with their i."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n - lo, n)


class Grid:
    """Points of trees in cells of their tree's grid; tree holds codes 0, 1, ... in order.

    Columns of cells are ranked among those that hold points, so that no far point makes a key overflow.
    """

    def __init__(self, tree: np.ndarray, xyz: np.ndarray, edge: float):
        self.edge = edge * (1 + 1e-9)
        starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if len(tree) else np.zeros(0, int)
        self.low = np.zeros((int(tree[-1]) + 1 if len(tree) else 0, 3))
        if len(tree):
            self.low[tree[starts]] = np.minimum.reduceat(xyz, starts)
        c = self.cell(tree, xyz)
        self.size = c.max(0, initial=0) + 3
        one, self.rank_x = np.unique(tree * self.size[0] + c[:, 0], return_inverse=True)
        two, rank_y = np.unique(self.rank_x * self.size[1] + c[:, 1], return_inverse=True)
        self.x, self.y = one, two
        key = rank_y * self.size[2] + c[:, 2]
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        self.sorted = xyz[self.order]

    def cell(self, tree: np.ndarray, xyz: np.ndarray) -> np.ndarray:
        """Cells from 1 on, so that a neighbour's is not negative; -1 and less lie below the grid."""
        return np.clip(np.floor((xyz - self.low[tree]) / self.edge), -2, FARTHEST).astype(np.int64) + 1

    def near(self, tree: np.ndarray, xyz: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j), i ascending: each of the points given with all of the grid's in the 27 cells round it."""
        c = self.cell(tree, xyz)
        within = np.flatnonzero(((c >= 0) & (c < self.size)).all(1))
        within = within[np.lexsort((c[within, 2], c[within, 1], c[within, 0], tree[within]))] if len(within) else within
        lo, n = np.zeros((9, len(xyz)), np.int64), np.zeros((9, len(xyz)), np.int64)

        def found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            return at, keys[at] == asked

        for dx in (-1, 0, 1):
            x = c[within, 0] + dx
            at, held = found(self.x, tree[within] * self.size[0] + x)
            held &= (x >= 0) & (x < self.size[0])
            some, at = within[held], at[held]
            for dy in (-1, 0, 1):
                y = c[some, 1] + dy
                col, there = found(self.y, at * self.size[1] + y)
                there &= (y >= 0) & (y < self.size[1])
                who, col = some[there], col[there]
                k, base = 3 * dx + dy + 4, col * self.size[2]
                z = c[who, 2]
                lo[k, who] = np.searchsorted(self.key, base + np.maximum(z - 1, 0))
                n[k, who] = np.searchsorted(self.key, base + np.minimum(z + 1, self.size[2] - 1), "right") - lo[k, who]
        lo, n = lo.T, n.T
        ends = np.cumsum(n.sum(1))
        at = 0
        while at < len(xyz):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            i, j = spread(lo[at:stop].ravel(), n[at:stop].ravel())
            yield i // 9 + at, j
            at = stop


def within(tree: np.ndarray, xyz: np.ndarray, radius2: np.ndarray | float, edge: float, distances: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j): places of all points j of i's tree with a squared distance below radius2 (of i), i itself too; with `distances`
    also the squared ones. edge: the largest radius at least."""
    if not len(tree):
        return
    g = Grid(tree, xyz, edge)
    t, limit = tree[g.order], np.broadcast_to(radius2, len(tree))[g.order]
    for i, j in g.near(t, g.sorted):
        d = squared(g.sorted[i], g.sorted[j])
        keep = np.flatnonzero(d < limit[i])
        pair = g.order[i[keep]], g.order[j[keep]]
        yield (*pair, d[keep]) if distances else pair


def counts(tree: np.ndarray, xyz: np.ndarray, radius2: np.ndarray | float, edge: float, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """How many points lie nearer than the radius, and the sum of their ids."""
    n, total = np.zeros(len(tree), np.int64), None if ids is None else np.zeros(len(tree), np.int64)
    for i, j in within(tree, xyz, radius2, edge):
        n += np.bincount(i, minlength=len(n)) if len(i) * 4 > len(n) else 0
        if len(i) * 4 <= len(n):
            np.add.at(n, i, 1)
        if total is not None:
            np.add.at(total, i, ids[j])
    return n, total


def kth(tree: np.ndarray, xyz: np.ndarray, k: int, edge: float) -> np.ndarray:
    """Distance to the k-th nearest point of the tree, the point itself counted; NaN in trees of fewer.

    A distance of at most the cells' edge is final; for the points left over the edge doubles.
    """
    out = np.full(len(tree), np.nan)
    left = np.flatnonzero(np.bincount(tree)[tree] >= k) if len(tree) else np.zeros(0, int)
    while len(left):
        mine = np.isin(tree, tree[left])
        _, code = np.unique(tree[mine], return_inverse=True)
        g = Grid(code, xyz[mine], edge)
        place = np.cumsum(mine) - 1
        t, at = code[place[left]], xyz[left]
        span = np.zeros(len(g.low))
        np.maximum.at(span, code, (xyz[mine] - g.low[code]).max(1))
        for i, j in g.near(t, at):
            d = squared(at[i], g.sorted[j])
            keep = np.flatnonzero((d <= edge * edge * (1 + 1e-9)) | (span[t[i]] < edge))
            i, d = i[keep], d[keep]
            order = np.lexsort((d, i))
            i, d = i[order], d[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
            enough = first[np.diff(np.r_[first, len(i)]) >= k]
            distance = np.sqrt(d[enough + k - 1])
            who = i[enough]
            final = (distance <= edge) | (span[t[who]] < edge)
            out[left[who[final]]] = distance[final]
        left = left[np.isnan(out[left])]
        edge *= 2
    return out


def layered(tree: np.ndarray, z: np.ndarray, value: np.ndarray, sigmas: float, above: bool) -> tuple[np.ndarray, np.ndarray]:
    """(layer, keep) as filters.layered says, of trees in order. A NaN value is in no mean and isn't kept."""
    if not len(tree):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    code = np.cumsum(np.r_[0, tree[1:] != tree[:-1]])
    low, high = np.minimum.reduceat(z, starts)[code], np.maximum.reduceat(z, starts)[code]
    layer = np.floor(z - low).astype(np.int64)
    value = value.astype(float)
    counted = (layer < np.ceil(high - low)) & ~np.isnan(value)
    _, of = np.unique(code * (int(layer.max()) + 1) + layer, return_inverse=True)
    v, o = value[counted], of[counted]
    n = np.bincount(o, minlength=of.max() + 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.bincount(o, v, minlength=len(n)) / n
        std = np.sqrt(np.bincount(o, (v - mean[o]) ** 2, minlength=len(n)) / (n - 1))
        std[n == 1] = 0
        keep = value > (mean - sigmas * std)[of] if above else value < (mean + sigmas * std)[of]
    return layer, keep


def by_pairs(left: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """first_independent of the points `left`, from all pairs of an earlier point and a later one that it covers."""
    left, found = left.copy(), np.zeros(len(left), bool)
    while left.any():
        keep = left[src] & left[dst]
        src, dst = src[keep], dst[keep]
        new = left.copy()
        new[dst] = False
        found |= new
        left &= ~new
        left[dst[new[src]]] = False
    return np.flatnonzero(found)


def first_independent(tree: np.ndarray, xyz: np.ndarray, rank: np.ndarray, reach: np.ndarray, ball: np.ndarray, nmin: int) -> np.ndarray:
    """Places of the centres that a pass by rank would choose: points with nmin points in their ball and no earlier centre
    nearer than its reach. In rounds, as cover.centres."""
    edge, square = float(max(ball.max(initial=0), reach.max(initial=0))), np.maximum(ball, reach) ** 2
    n, pairs, listed = np.zeros(len(tree), np.int64), [], 0
    for i, j, d in within(tree, xyz, square, edge, distances=True):
        np.add.at(n, i[d < (ball * ball)[i]], 1)
        if listed <= LISTED:
            hit = (rank[i] < rank[j]) & (d < (reach * reach)[i])
            pairs.append((i[hit].astype(np.int32), j[hit].astype(np.int32)))
            listed += len(pairs[-1][0])
    if listed <= LISTED:
        return by_pairs(n >= nmin, *(np.concatenate(x) for x in zip(*pairs, strict=True))) if pairs else np.zeros(0, np.int64)
    left, found = np.flatnonzero(n >= nmin), []
    while len(left):
        _, code = np.unique(tree[left], return_inverse=True)
        r, far, at = rank[left], reach[left], xyz[left]
        blocked = np.zeros(len(left), bool)
        for i, j in within(code, at, far * far, float(far.max())):
            blocked[j[r[i] < r[j]]] = True
        found.append(left[~blocked])
        g = Grid(code, at, float(far.max()))
        new = np.flatnonzero(~blocked)
        gone = ~blocked
        for i, j in g.near(code[new], at[new]):
            i, to = new[i], g.order[j]
            gone[to[(squared(at[i], g.sorted[j]) < (far * far)[i]) & (r[i] < r[to])]] = True
        left = left[~gone]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is linked with, over links either way."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, src, label[dst])
        np.minimum.at(low, dst, label[src])
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def cover(tree: np.ndarray, xyz: np.ndarray, rank: np.ndarray, reach: np.ndarray, ball: np.ndarray, nmin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(centres, member, src, dst): places of the centres, each point's nearest centre (its number; -1: in no ball), and links
    of numbers both ways, of sets whose ball holds a point of the other. Points of NaN reach can be no centres."""
    some = np.flatnonzero(~np.isnan(reach))
    _, code = np.unique(tree[some], return_inverse=True)
    centre = some[first_independent(code, xyz[some], rank[some], reach[some], ball[some], nmin)]
    member = np.full(len(tree), -1)
    if not len(centre):
        return centre, member, centre, centre
    b = ball[centre]
    g = Grid(tree, xyz, float(b.max()))
    found = []
    for i, j in g.near(tree[centre], xyz[centre]):
        d = squared(xyz[centre[i]], g.sorted[j])
        keep = d < (b * b)[i]
        found.append((i[keep], g.order[j[keep]], d[keep]))
    i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((rank[centre][i], d, j))
    first = order[np.r_[True, j[order][1:] != j[order][:-1]]]
    member[j[first]] = i[first]
    a, c = i, member[j]
    a, c = a[a != c], c[a != c]
    pair = np.unique(np.r_[a * len(centre) + c, c * len(centre) + a])
    return centre, member, pair // len(centre), pair % len(centre)
