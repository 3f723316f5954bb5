"""Cluster features: trees that absorb vectors, merge with each other, and Ward's agglomeration of their leaves.

A feature is the count, the linear sum and the sum of squares of some vectors. Features add up, so a tree built
over one part of the data can be inserted into a tree of another part leaf by leaf.
"""

from __future__ import annotations

import numpy as np

#: Leaves of a node beyond which it is split into two.
FANOUT = 48
#: Features inserted at once.
CHUNK = 1_024
#: Share of the leaves that the next threshold lets a full tree merge, and least growth of the threshold.
MERGED_SHARE, GROWTH = 0.5, 1.05
#: Share of the first rows that the first threshold lets merge, where they are more than the leaves may be.
FIRST_SHARE = 0.85


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a to those of b."""
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0)


def _cost(n: np.ndarray, m: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Ward's cost: what joining features of n and m rows adds to the sum of squares."""
    return n * m / (n + m) * d2


class FeatureTree:
    """A tree of two levels: a feature descends to the nearest node and there to the nearest leaf.

    A leaf absorbs what adds at most the threshold to the sum of squares (Ward's cost, which unlike the radius does
    not let a large leaf swallow whatever comes). When there are more than ``most`` leaves the threshold grows and
    the leaves are inserted anew, so a tree never outgrows its bound, however many rows it saw.
    """

    def __init__(self, dim: int, most: int, threshold: float = 0.0):
        self.most, self.threshold = most, threshold
        self.n, self.ls, self.ss = np.zeros(0), np.zeros((0, dim)), np.zeros(0)
        self.node = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.n)

    def add_rows(self, rows: np.ndarray) -> None:
        self.add(np.ones(len(rows)), rows, (rows**2).sum(axis=1))

    def add(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        """Inserts features: single rows, or the leaves of another tree."""
        for lo in range(0, len(n), CHUNK):
            self._insert(n[lo : lo + CHUNK], ls[lo : lo + CHUNK], ss[lo : lo + CHUNK])
            while len(self) > self.most:
                self._rebuild()

    def _insert(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        centre = ls / n[:, None]
        rest, near_node = np.arange(len(n)), np.zeros(len(n), np.int64)
        if len(self):
            own_centre = self.ls / self.n[:, None]
            nodes = self.node.max() + 1
            weight = np.bincount(self.node, self.n, nodes)
            sums = np.zeros((nodes, ls.shape[1]))
            np.add.at(sums, self.node, self.ls)
            near_node = _squares(centre, sums / weight[:, None]).argmin(axis=1)
            taken = np.zeros(len(n), bool)
            for node in np.unique(near_node):
                rows, leaves = np.flatnonzero(near_node == node), np.flatnonzero(self.node == node)
                d2 = _squares(centre[rows], own_centre[leaves])
                at = d2.argmin(axis=1)
                leaf, d2 = leaves[at], d2[np.arange(len(rows)), at]
                fits = _cost(n[rows], self.n[leaf], d2) <= self.threshold
                rows, leaf = rows[fits], leaf[fits]
                np.add.at(self.n, leaf, n[rows])
                np.add.at(self.ls, leaf, ls[rows])
                np.add.at(self.ss, leaf, ss[rows])
                taken[rows] = True
            rest = np.flatnonzero(~taken)
        if not len(rest):
            return
        # what no leaf absorbs becomes leaves, which absorb each other in order
        d2 = _squares(centre[rest], centre[rest])
        left, leaders, leader_of = np.ones(len(rest), bool), [], np.empty(len(rest), np.int64)
        cost = _cost(n[rest][:, None], n[rest], d2)
        if not len(self) and not self.threshold and len(rest) > self.most:
            np.fill_diagonal(cost, np.inf)
            self.threshold = float(np.quantile(cost.min(axis=1), FIRST_SHARE))
        joined = cost <= self.threshold
        np.fill_diagonal(joined, True)
        for i in range(len(rest)):
            if left[i]:
                took = joined[i] & left
                left[took] = False
                leader_of[took] = len(leaders)
                leaders.append(i)
        new = len(leaders)
        fresh_ls = np.zeros((new, ls.shape[1]))
        np.add.at(fresh_ls, leader_of, ls[rest])
        self.n = np.r_[self.n, np.bincount(leader_of, n[rest], new)]
        self.ls = np.concatenate([self.ls, fresh_ls])
        self.ss = np.r_[self.ss, np.bincount(leader_of, ss[rest], new)]
        self.node = np.r_[self.node, near_node[rest[leaders]]]
        self._split()

    def _split(self) -> None:
        """Splits nodes with too many leaves at their two farthest leaves."""
        todo = np.flatnonzero(np.bincount(self.node) > FANOUT).tolist()
        while todo:
            node = todo.pop()
            leaves = np.flatnonzero(self.node == node)
            c = self.ls[leaves] / self.n[leaves, None]
            one = _squares(c[:1], c)[0].argmax()
            away = _squares(c[one : one + 1], c)[0]
            side = _squares(c[away.argmax()][None], c)[0] < away
            if side.all() or not side.any():  # all leaves at one place
                side = np.arange(len(leaves)) % 2 == 1
            fresh = self.node.max() + 1
            self.node[leaves[side]] = fresh
            todo += [x for x, size in ((node, (~side).sum()), (fresh, side.sum())) if size > FANOUT]

    def _rebuild(self) -> None:
        """A larger threshold, by what merging each leaf with its nearest would need."""
        centre = self.ls / self.n[:, None]
        needs = _cost(self.n[:, None], self.n, _squares(centre, centre))
        np.fill_diagonal(needs, np.inf)
        self.threshold = max(self.threshold * GROWTH, float(np.quantile(needs.min(axis=1), MERGED_SHARE)), 1e-9)
        order = np.argsort(-self.n, kind="stable")
        n, ls, ss = self.n[order], self.ls[order], self.ss[order]
        self.n, self.ls, self.ss, self.node = n[:0], ls[:0], ss[:0], self.node[:0]
        for lo in range(0, len(n), CHUNK):
            self._insert(n[lo : lo + CHUNK], ls[lo : lo + CHUNK], ss[lo : lo + CHUNK])


def ward(n: np.ndarray, centre: np.ndarray, most: float) -> np.ndarray:
    """Labels of features after agglomeration by Ward's cost, the growth of the sum of squares.

    The cheapest pair is joined again and again, as long as the two together count at most ``most``.
    """
    count = len(n)
    label = np.arange(count)
    if count < 2:
        return label
    n = n.astype(np.float64)
    cost = _cost(n[:, None], n, _squares(centre, centre))
    cost[n[:, None] + n > most] = np.inf
    np.fill_diagonal(cost, np.inf)
    near = cost.argmin(axis=1)
    least = cost[np.arange(count), near]
    centre, square = centre.copy(), (centre**2).sum(axis=1)
    for _ in range(count - 1):
        i = int(least.argmin())
        if not np.isfinite(least[i]):
            break
        i, j = sorted((i, int(near[i])))
        total = n[i] + n[j]
        c = (n[i] * centre[i] + n[j] * centre[j]) / total
        centre[i], square[i], n[i], n[j] = c, c @ c, total, np.inf
        # the joined feature against each other one that is left and not too large
        row = np.full(count, np.inf)
        fits = np.flatnonzero(n + total <= most)
        row[fits] = total * n[fits] / (total + n[fits]) * np.maximum(square[fits] + square[i] - 2 * centre[fits] @ c, 0)
        row[i] = np.inf
        cost[i, :], cost[:, i], cost[j, :], cost[:, j] = row, row, np.inf, np.inf
        label[label == j] = i
        lower = row < least
        stale = np.flatnonzero(((near == i) | (near == j)) & ~lower)
        near[lower], least[lower] = i, row[lower]
        stale = np.union1d(stale, [i])
        near[stale] = cost[stale].argmin(axis=1)
        least[stale] = cost[stale, near[stale]]
        least[j] = np.inf
    return np.unique(label, return_inverse=True)[1]
