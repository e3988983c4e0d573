"""Subproblems on request: only what an estimate or a budget asks for is counted.

A *request* is a conjunction with its row counts; ``member`` tables hold the patterns of
each requested conjunction.  Both grow from level to level by one equi-join with the splits
that are followed, and the counts of all splits of all requests of a level are one
aggregate over the members: no table of all conjunctions is made.

Estimates follow the chosen split only.  A greedy estimate asks for two children per
request, whatever the number of features; a lookahead asks for the cheaper estimate of all
children, then goes on below the least one; only exact estimates ask for everything below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.columns import NO_LITERALS, entropy_gain, gain_rank, is_cheap, leaf_objective, loss_rank, names, sql
from ..plans.storage import cut
from .patterns import WORD_BITS, bit, words
from .predict import itemset_weights
from .proxies import ALWAYS_ENTROPY, ALWAYS_LOSS, ProxyRule
from .trie import RULE_LIST, SIDES

#: Features whose sums one aggregate carries; wider tables are summed in several passes.
BLOCK = 32


def requested_counts(patterns: DataFrame, itemsets: DataFrame, depth: int, n_features: int) -> DataFrame:
    """``(itemset, n, p)`` of the listed conjunctions of at most ``depth`` literals.

    Patterns walk down the prefix tree of the list, so the work is in proportion to the
    matches.  Conjunctions that no row meets have counts of 0; repeated ones come once.
    """
    wanted = itemsets.select("itemset").distinct()
    return sql(
        "SELECT itemset, coalesce(n, 0L) n, coalesce(p, 0L) p FROM {wanted} LEFT JOIN {counts} USING (itemset)",
        wanted=wanted,
        counts=itemset_weights(patterns, wanted, depth, n_features),
    )


def whole(patterns: DataFrame, n_features: int) -> DataFrame:
    """Members of the problem without conditions."""
    return patterns.selectExpr(f"{NO_LITERALS} itemset", *words(n_features), "n", "p")


def contingency(members: DataFrame, n_features: int, searched: int) -> DataFrame:
    """All splits of all requested conjunctions that leave no side empty, with counts of both sides.

    ``e`` is the least number of errors any tree makes: of rows with equal features the
    label of fewer is always wrong.
    """
    wrong = "least(p, n - p)"
    parts = []
    for low in range(0, searched, BLOCK):
        cells = ", ".join(
            f"struct({f} AS feature, sum(n * {bit(f)}) AS n_l, sum(p * {bit(f)}) AS p_l, sum({wrong} * {bit(f)}) AS e_l)"
            for f in range(low, min(low + BLOCK, searched))
        )
        parts.append(f"SELECT itemset, sum(n) n, sum(p) p, sum({wrong}) e, array({cells}) cells FROM {{members}} GROUP BY itemset")
    return sql(
        f"""SELECT itemset, feature, n_l, p_l, e_l, n - n_l n_r, p - p_l p_r, e - e_l e_r, {SIDES}
        FROM (SELECT itemset, n, p, e, inline(cells) FROM ({" UNION ALL ".join(parts)}))
        WHERE n_l > 0 AND n_l < n""",
        members=members,
    )


def children(splits: DataFrame, left_limit: str = "0L", right_limit: str = "0L") -> DataFrame:
    """Requests ``(itemset, n, p, budget, origin)`` for both sides of splits, each once.

    ``origin`` is one parent with the literal that leads from it; ``budget`` the greatest limit.
    """
    return sql(
        f"""SELECT itemset, max(n) n, max(p) p, max(budget) budget, min(origin) origin FROM (
            SELECT inline(array(
                struct(left_itemset AS itemset, n_l AS n, p_l AS p, {left_limit} AS budget,
                    struct(itemset AS parent, 2 * feature + 1 AS literal) AS origin),
                struct(right_itemset AS itemset, n_r AS n, p_r AS p, {right_limit} AS budget,
                    struct(itemset AS parent, 2 * feature AS literal) AS origin)))
            FROM {{splits}})
        GROUP BY itemset""",
        splits=splits,
    )


def members_of(requests: DataFrame, members: DataFrame, n_features: int) -> DataFrame:
    """Members of requests from those of their parents."""
    word = f"element_at(array({names((), *words(n_features))}), cast(shiftright(literal, 1) div {WORD_BITS} AS int) + 1)"
    holds = f"(shiftright({word}, cast(shiftright(literal, 1) % {WORD_BITS} AS int)) & 1L) = (literal & 1)"
    return sql(
        f"""SELECT itemset, {names((), *words(n_features), "n", "p")} FROM (
            SELECT r.itemset, origin.literal literal, {names((), *words(n_features), prefix="m.")}, m.n, m.p
            FROM {{members}} m JOIN {{requests}} r ON m.itemset = r.origin.parent)
        WHERE {holds}""",
        members=members,
        requests=requests,
    )


def _open(requests: DataFrame, rule: ProxyRule) -> DataFrame:
    """Requests that a split can improve."""
    return requests.where(f"NOT {is_cheap(leaf_objective('n', 'p', rule.lam_n), rule.lam_n)}")


def side_values(kind: str, splits: DataFrame, members: DataFrame, depth: int, rule: ProxyRule) -> DataFrame:
    """``splits`` with ``v_l`` and ``v_r``: estimates of both sides, ``depth`` levels left."""
    if kind == "leaf" or depth <= 0:
        left, right = (leaf_objective(f"n_{s}", f"p_{s}", rule.lam_n) for s in ("l", "r"))
        return splits.selectExpr("*", f"{left} AS v_l", f"{right} AS v_r")
    requests = cut(children(splits), "requests")
    below = cut(members_of(_open(requests, rule), members, rule.n_features), "members")
    values = cut(estimate(kind, requests, below, depth, rule), "estimates")
    return sql(
        """SELECT s.*, l.value v_l, r.value v_r FROM {splits} s
        JOIN {values} AS l ON s.left_itemset = l.itemset JOIN {values} AS r ON s.right_itemset = r.itemset""",
        splits=splits,
        values=values,
    )


def estimate(kind: str, requests: DataFrame, members: DataFrame, depth: int, rule: ProxyRule) -> DataFrame:
    """``(itemset, value)`` of requests with ``depth`` levels left.

    ``kind`` is an estimate of :mod:`proxies`: ``leaf``, ``x``, ``g`` or ``v<k>``.
    ``members`` has at least those of the requests that are not solved by a leaf.
    """
    leaf = leaf_objective("n", "p", rule.lam_n)
    if kind == "leaf" or depth <= 0:
        return requests.selectExpr("itemset", f"{leaf} AS value")
    cheap = is_cheap("leaf", rule.lam_n)
    wanted = members.join(_open(requests, rule).select("itemset"), "itemset", "left_semi")
    splits = cut(contingency(wanted, rule.n_features, rule.searched), "contingency")
    if kind == "g":
        exact = depth == 1 and rule.greedy_mode != ALWAYS_ENTROPY
    else:
        exact = kind == "x" or depth == 1 or int(kind[1:]) >= max(depth - 1, 1)

    def chosen(table: DataFrame, rank: str) -> DataFrame:
        kept = "feature, n_l, p_l, e_l, n_r, p_r, e_r, left_itemset, right_itemset"
        return sql(
            f"SELECT itemset, best.* FROM (SELECT itemset, min_by(struct({kept}), {rank}) best FROM {{table}} GROUP BY itemset)",
            table=table,
        )

    if exact:
        best = side_values("x", splits, members, depth - 1, rule)
    elif kind == "g":
        loss = f"{leaf_objective('n_l', 'p_l', rule.lam_n)} + {leaf_objective('n_r', 'p_r', rule.lam_n)}"
        by_loss = loss_rank(f"({loss})", "feature", rule.n_features)
        by_gain = gain_rank(entropy_gain("n_l", "p_l", "n_r", "p_r"), "feature")
        best = side_values("g", chosen(splits, by_loss if rule.greedy_mode == ALWAYS_LOSS else by_gain), members, depth - 1, rule)
    else:
        k = int(kind[1:])
        scored = side_values("g" if k <= 1 else f"v{k - 1}", splits, members, depth - 1, rule)
        after = rule.next_lookahead(k)
        followed = cut(chosen(scored, loss_rank("(v_l + v_r)", "feature", rule.n_features)), "followed")
        best = side_values("g" if after is None else f"v{after}", followed, members, depth - 1, rule)
    return sql(
        f"""SELECT itemset, if({cheap}, leaf, least(leaf, best)) value
        FROM (SELECT itemset, {leaf} leaf FROM {{requests}})
        LEFT JOIN (SELECT itemset, min(v_l + v_r) best FROM {{best}} GROUP BY itemset) USING (itemset)""",
        requests=requests,
        best=best,
    )


def affordable_splits(requests: DataFrame, members: DataFrame, depth: int, rule: ProxyRule, allocation: str) -> DataFrame:
    """Splits of requests that some budget up to theirs admits, with estimates of both sides.

    Splits whose sides cost too much by the errors that no tree avoids are left out first:
    their estimates are never asked for.
    """
    lam = rule.lam_n
    wanted = requests.where(f"budget >= {max(2 * lam, 0)}L")
    splits = contingency(members.join(wanted.select("itemset"), "itemset", "left_semi"), rule.n_features, rule.n_features)

    def fits(left: str, right: str) -> str:
        if allocation == RULE_LIST:
            return f"{left} <= budget - {lam}L OR {right} <= budget - {lam}L"
        return f"{left} + {right} <= budget"

    bounded = sql(
        f"SELECT s.*, budget FROM {{splits}} s JOIN {{wanted}} USING (itemset) WHERE {fits(f'(e_l + {lam}L)', f'(e_r + {lam}L)')}",
        splits=splits,
        wanted=wanted.select("itemset", "budget"),
    )
    valued = side_values(rule.admission(depth), cut(bounded, "bounded"), members, depth - 1, rule)
    return valued.where(fits("v_l", "v_r"))
