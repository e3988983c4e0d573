"""Direct enumeration of the set by its definition, for tables of a few rows.

Independent of the Spark code: it keeps row lists, recurses, and builds every
tree as a nested tuple ``(feature, left, right)`` or a bare prediction.
"""

from __future__ import annotations

import math
from functools import lru_cache

INF = float("inf")


def half_up(x: float) -> int:
    return math.floor(x + 0.5) if x - math.floor(x) != 0.49999999999999994 else math.floor(x)


class SmallModel:
    def __init__(self, rows, labels, *, lam=0.01, depth=3, mult=0.05, slack=0.0, budget=None, k=1, style=0,
                 multipass=True, rule_list=False, majority=False, greedy=1, searched=0):
        self.x, self.y = [tuple(r) for r in rows], list(labels)
        self.n_features = len(self.x[0])
        self.lam = half_up(lam * len(self.x))
        self.depth, self.k, self.style, self.greedy_mode = depth, k, style, greedy
        self.multipass, self.rule_list, self.majority = multipass, rule_list, majority
        self.searched = min(searched, self.n_features) if searched > 0 else self.n_features
        everything = frozenset(range(len(self.x)))
        self.by_depth = self.cycle() if style == 2 else None
        reference = self.greedy(everything, depth) if k <= 0 else self.look(everything, depth, k)
        self.reference = reference
        self.bound = budget if budget is not None else half_up(reference * (1 + mult) * (1 + slack))
        self.trees = sorted(self.grow(everything, depth, self.bound), key=self.order)

    # -- counts ---------------------------------------------------------------

    @lru_cache(maxsize=None)
    def wrong(self, rows):
        positives = sum(self.y[i] for i in rows)
        return positives, len(rows) - positives  # errors of label 0, of label 1

    def leaf(self, rows):
        return self.lam + min(self.wrong(rows))

    @lru_cache(maxsize=None)
    def sides(self, rows, f):
        left = frozenset(i for i in rows if self.x[i][f])
        return left, rows - left

    def splits(self, rows, limit):
        for f in range(limit):
            left, right = self.sides(rows, f)
            if left and right:
                yield f, left, right

    # -- estimates --------------------------------------------------------------

    @lru_cache(maxsize=None)
    def exact(self, rows, d):
        leaf = self.leaf(rows)
        if d <= 0 or leaf <= 2 * self.lam:
            return leaf
        options = [self.exact(a, d - 1) + self.exact(b, d - 1) for _, a, b in self.splits(rows, self.searched)]
        return min([leaf, *options])

    def gain(self, rows, left, right):
        def h(part):
            p = sum(self.y[i] for i in part) / len(part)
            p = max(1e-12, min(1 - 1e-12, p))
            return -(p * math.log2(p) + (1 - p) * math.log2(1 - p))

        n = len(rows)
        return h(rows) - (len(left) / n * h(left) + len(right) / n * h(right))

    @lru_cache(maxsize=None)
    def greedy(self, rows, d):
        leaf = self.leaf(rows)
        if d == 0:
            return leaf
        if d == 1 and self.greedy_mode in (1, 2):
            return self.exact(rows, 1)
        if leaf <= 2 * self.lam:
            return leaf
        if self.greedy_mode == 2:
            ranked = [(self.leaf(a) + self.leaf(b), f, a, b) for f, a, b in self.splits(rows, self.searched)]
        else:
            ranked = [(round(-self.gain(rows, a, b), 12), f, a, b) for f, a, b in self.splits(rows, self.searched)]
        if not ranked:
            return leaf
        _, _, a, b = min(ranked, key=lambda r: r[:2])
        return min(leaf, self.greedy(a, d - 1) + self.greedy(b, d - 1))

    @lru_cache(maxsize=None)
    def look(self, rows, d, k):
        leaf = self.leaf(rows)
        if d == 0:
            return leaf
        if d == 1:
            return self.exact(rows, 1)
        k = min(k, d - 1)
        if k == d - 1:
            return self.exact(rows, d)
        if leaf <= 2 * self.lam:
            return leaf

        def estimate(part):
            return self.greedy(part, d - 1) if k - 1 <= 0 else self.look(part, d - 1, k - 1)

        ranked = [(estimate(a) + estimate(b), f, a, b) for f, a, b in self.splits(rows, self.searched)]
        if not ranked:
            return leaf
        _, _, a, b = min(ranked, key=lambda r: r[:2])
        if self.style == 3 and k - 1 <= 0:
            return min(leaf, self.greedy(a, d - 1) + self.greedy(b, d - 1))
        if self.style == 0:
            after = k
        elif self.style == 3:
            after = k - 1
        else:
            after = self.k if k - 1 == 0 else k - 1
        return min(leaf, self.look(a, d - 1, after) + self.look(b, d - 1, after))

    def cycle(self):
        plan, k = {}, self.k
        for d in range(self.depth, -1, -1):
            plan[d] = min(d, k)
            k = k - 1 if k > 1 else self.k
        return plan

    def admission(self, rows, d):
        """Estimate of a child that has ``d`` levels left."""
        if self.k < 0:
            return self.leaf(rows)
        if self.k == 0:
            return self.greedy(rows, d)
        return self.look(rows, d, self.by_depth[d] if self.by_depth else self.k)

    # -- the set ----------------------------------------------------------------

    @lru_cache(maxsize=None)
    def grow(self, rows, d, budget):
        """All ``(objective, tree)`` of the set of ``rows`` under ``budget``."""
        errors = self.wrong(rows)
        found = [(self.lam + errors[label], label) for label in (0, 1)]
        if self.majority:
            found = [found[1] if errors[1] <= errors[0] else found[0]]
        found = [t for t in found if t[0] <= budget]
        if d == 0 or budget < 2 * self.lam:
            return tuple(found)
        for f, left, right in self.splits(rows, self.n_features):
            pair = self.allot(left, right, d, budget)
            if pair is None:
                continue
            found += [
                (a[0] + b[0], (f, a[1], b[1])) for a in pair[0] for b in pair[1] if a[0] + b[0] <= budget
            ]
        return tuple(found)

    def least(self, rows, d, budget):
        return min((t[0] for t in self.grow(rows, d, budget)), default=INF)

    def allot(self, left, right, d, budget):
        v_l, v_r = self.admission(left, d - 1), self.admission(right, d - 1)
        if self.rule_list:
            if v_l > budget - self.lam and v_r > budget - self.lam:
                return None
        elif v_l + v_r > budget:
            return None
        b_l, b_r = budget - v_r, budget - v_l
        if self.multipass and not self.rule_list:
            m_l = self.least(left, d - 1, b_l)
            if m_l == INF:
                return None
            b_r = budget - m_l
            while True:
                before = (b_l, b_r)
                b_l = max(b_l, budget - self.least(right, d - 1, b_r))
                b_r = max(b_r, budget - self.least(left, d - 1, b_l))
                if (b_l, b_r) == before:
                    break
        if b_l < 0 or b_r < 0:
            return None
        return self.grow(left, d - 1, b_l), self.grow(right, d - 1, b_r)

    # -- reading the set ----------------------------------------------------------

    def histogram(self):
        out = {}
        for objective, _ in self.trees:
            out[objective] = out.get(objective, 0) + 1
        return sorted(out.items())

    def order(self, item):
        """Rank order: objective, then leaves, then splits by feature and sides."""
        objective, tree = item
        return objective, self.rank_key(tree, frozenset(range(len(self.x))))

    def rank_key(self, tree, rows):
        if not isinstance(tree, tuple):
            return (-1, tree)
        left, right = self.sides(rows, tree[0])
        return (
            tree[0],
            self.cost(tree[1], left),
            self.rank_key(tree[1], left),
            self.rank_key(tree[2], right),
        )

    def cost(self, tree, rows):
        if not isinstance(tree, tuple):
            return self.lam + self.wrong(rows)[tree]
        left, right = self.sides(rows, tree[0])
        return self.cost(tree[1], left) + self.cost(tree[2], right)

    @staticmethod
    def paths(tree, path=()):
        if not isinstance(tree, tuple):
            return [(list(path), tree)]
        f = tree[0] + 1
        return SmallModel.paths(tree[1], (*path, f)) + SmallModel.paths(tree[2], (*path, -f))
