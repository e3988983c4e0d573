"""Cost estimates of subproblems, computed bottom-up.

Depth left is ``depth - size(itemset)``: a feature cannot repeat on a path, so
every estimate is a function of the itemset.  At each level
children are sent to all their parents, where both sides of a split meet, and a
parent keeps its best split per estimate.

Estimates of an itemset with ``d`` levels left:

* ``leaf``  the cheaper single leaf;
* ``x``     the exact optimum over trees of depth ``d``;
* ``g``     the greedy tree;
* ``v<k>``  lookahead k: take the split whose sides have the least estimate with
  lookahead k-1 (0 = greedy), then go on with the same rule on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.columns import (
    entropy_gain,
    gain_rank,
    is_cheap,
    leaf_objective,
    loss_rank,
    names,
    sql,
)
from .counts import side_sums, to_parents

ALWAYS_LOSS, ENTROPY_THEN_EXACT, ALWAYS_ENTROPY = 2, 1, 0


@dataclass(frozen=True)
class ProxyRule:
    """Everything the estimates depend on besides the counts."""

    depth: int
    lam_n: int
    n_features: int
    lookahead: int = 1
    style: int = 0
    greedy_mode: int = 1
    proxy_features: int = 0

    @property
    def searched(self) -> int:
        """Features the estimates may split on (the set itself may use all)."""
        return min(self.proxy_features, self.n_features) if self.proxy_features > 0 else self.n_features

    @property
    def top(self) -> int:
        """Largest lookahead column needed."""
        return max(self.lookahead, 1)

    @property
    def lookaheads(self) -> list[int]:
        """Lookahead columns kept; v0 is reached only by a restart below one."""
        first = 0 if self.lookahead <= 0 and self.style in (1, 2) else 1
        return list(range(first, self.top + 1))

    @property
    def estimates(self) -> list[str]:
        return ["leaf", "x", "g", *(f"v{k}" for k in self.lookaheads)]

    def next_lookahead(self, k: int) -> int | None:
        """Lookahead after a split chosen with lookahead ``k``; None = greedy."""
        if self.style == 0:
            return max(k, 0)
        if self.style == 3:
            return k - 1 if k > 1 else None
        return max(self.lookahead if k - 1 == 0 else k - 1, 0)

    def lookahead_by_depth(self) -> list[int]:
        """Style 2: lookahead per depth left, cycling K, K-1, ..., 1, K, ..."""
        plan, k = [0] * (self.depth + 1), self.lookahead
        for d in range(self.depth, -1, -1):
            plan[d] = min(d, k)
            k = k - 1 if k > 1 else self.lookahead
        return plan

    def reference(self) -> str:
        """Estimate of the whole problem that sets the bound."""
        return "g" if self.lookahead <= 0 else f"v{self.lookahead}"

    def admission(self, depth_left: int) -> str:
        """Estimate of the children of a node with ``depth_left`` levels left."""
        if self.lookahead < 0:
            return "leaf"
        if self.lookahead == 0:
            return "g"
        if self.style == 2:
            # children without levels left are leaves under any lookahead
            return f"v{max(self.lookahead_by_depth()[depth_left - 1], 1)}"
        return f"v{self.lookahead}"

    def exact_below(self) -> int:
        """Depths up to this one have exact admission estimates (-1 = none)."""
        if self.lookahead < 1 or self.searched < self.n_features or self.style == 2:
            return 0
        return self.lookahead + 1


def base_level(counts: DataFrame, rule: ProxyRule, keys: Sequence[str] = ()) -> DataFrame:
    """Itemsets that are not split any more: every estimate is the leaf."""
    leaf = leaf_objective("n", "p", rule.lam_n)
    return counts.selectExpr(*keys, "itemset", "n", "p", *(f"{leaf} AS {e}" for e in rule.estimates))


def parent_splits(children: DataFrame, depth_left: int, rule: ProxyRule, keys: Sequence[str] = ()) -> DataFrame:
    """All splits of the parents of ``children``, one row per itemset and feature.

    Output: counts of both sides, ``v_l``/``v_r`` (what a node with ``depth_left``
    levels left holds against its sides) and per estimate the sum over both sides.
    A split with an empty side is kept: it still tells the parent's counts.
    """
    parent, both = names(keys, "itemset"), [f"sum({e}) {e}_sum" for e in rule.estimates]
    return sql(
        f"""SELECT {parent}, feature, {side_sums(n="n", p="p", v=rule.admission(depth_left))}, {names((), *both)}
        FROM (
            SELECT /*+ REPARTITION({parent}) */ *
            FROM ({to_parents("{children}", keys, "n", "p", *rule.estimates)}))
        GROUP BY {parent}, feature""",
        children=children,
    )


def settle_estimates(splits: DataFrame, depth_left: int, rule: ProxyRule, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, itemset) -> n, p, <estimates>`` from all splits of the itemsets.

    Aggregates are single values, and a stored split table holds the
    splits of an itemset together, so nearly all of it is combined map-side.
    """
    ok = f"n_l > 0 AND n_r > 0 AND feature < {rule.searched}"

    def pick(rank: str, outcome: str) -> str:
        """Outcome of the split with the least rank."""
        return f"min_by(if({ok}, {outcome}, NULL), if({ok}, {rank}, NULL))"

    by_loss = loss_rank("leaf_sum", "feature", rule.n_features)
    by_gain = gain_rank(entropy_gain("n_l", "p_l", "n_r", "p_r"), "feature")
    best = {
        "x": f"min(if({ok}, x_sum, NULL))",
        "g": pick(by_loss if rule.greedy_mode == ALWAYS_LOSS else by_gain, "g_sum"),
    }
    for k in rule.lookaheads:
        chooser = "g_sum" if k <= 1 else f"v{k - 1}_sum"
        after = rule.next_lookahead(k)
        best[f"v{k}"] = pick(
            loss_rank(chooser, "feature", rule.n_features), "g_sum" if after is None else f"v{after}_sum"
        )

    def source(name: str) -> str:
        """Shallow subproblems are solved exactly whatever the estimate."""
        if name == "g":
            exact = depth_left == 1 and rule.greedy_mode != ALWAYS_ENTROPY
        else:
            exact = name == "x" or depth_left == 1 or int(name[1:]) >= max(depth_left - 1, 1)
        return "x" if exact else name

    needed = {source(e) for e in rule.estimates if e != "leaf"}
    # LEAST skips NULL: without a valid split the leaf remains
    values = ", ".join(
        f"if({is_cheap('leaf', rule.lam_n)}, leaf, least(leaf, {source(e)}_best)) {e}"
        for e in rule.estimates
        if e != "leaf"
    )
    group = names(keys, "itemset")
    return sql(
        f"""SELECT {group}, n, p, leaf, {values} FROM (
            SELECT *, {leaf_objective("n", "p", rule.lam_n)} leaf FROM (
                SELECT {group}, max(n_l + n_r) n, max(p_l + p_r) p,
                    {names((), *(f"{expr} {name}_best" for name, expr in best.items() if name in needed))}
                FROM {{splits}} GROUP BY {group}))""",
        splits=splits,
    )


def split_scores(contingency: DataFrame, lam_n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Information gain and summed leaf loss of every valid split."""
    loss = f"{leaf_objective('n_l', 'p_l', lam_n)} + {leaf_objective('n_r', 'p_r', lam_n)}"
    gain = entropy_gain("n_l", "p_l", "n_r", "p_r")
    valid = contingency.where("n_l > 0 AND n_r > 0")
    return valid.selectExpr(*keys, "itemset", "feature", f"{gain} AS gain", f"{loss} AS loss")


def best_split(
    contingency: DataFrame, lam_n: int, n_features: int, by_entropy: bool, searched: int = 0, keys: Sequence[str] = ()
) -> DataFrame:
    """``(itemset) -> feature``: the split with the highest gain or the least leaf
    loss; the lower feature wins ties.  ``searched`` > 0 limits it to a prefix of
    the features.  Itemsets without a valid split have no row."""
    rank = gain_rank("gain", "feature") if by_entropy else loss_rank("loss", "feature", n_features)
    group = names(keys, "itemset")
    return sql(
        f"""SELECT {group}, min_by(feature, {rank}) feature FROM {{scores}}
        WHERE feature < {searched or n_features} GROUP BY {group}""",
        scores=split_scores(contingency, lam_n, keys),
    )
