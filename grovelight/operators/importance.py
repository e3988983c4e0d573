"""Importance of a variable over a whole set of trees (subtractive model reliance).

A tree relies on a variable by as many rows as it gets right less once the
variable's columns are permuted.  That loss adds up over the leaves of a tree, so
the distribution over all trees is one more bottom-up fold; no tree is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.columns import running_sum, sql


def leaf_losses(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(b, var, itemset, prediction) -> delta``: rows a leaf gets right less.

    ``before`` is ``(b, itemset, n, p)``, ``after`` the same per variable; an
    itemset that no row meets after the permutation has no row there.
    """
    return sql(
        """SELECT b, var, itemset, inline(array(
                struct(0 AS prediction, (n - p) - (coalesce(n2, 0) - coalesce(p2, 0)) AS delta),
                struct(1 AS prediction, p - coalesce(p2, 0) AS delta)))
        FROM {before} LEFT JOIN (SELECT b, var, itemset, n n2, p p2 FROM {after}) USING (b, var, itemset)""",
        before=before,
        after=after,
    )


def touched_itemsets(itemsets: DataFrame, variables: Sequence[Sequence[int]]) -> DataFrame:
    """``(b, var, itemset, n, p)`` where the itemset tests a column of the variable;
    no other leaf changes."""
    owners = "map_from_entries(array({}))".format(
        ", ".join(f"struct({f}, {v})" for v, columns in enumerate(variables) for f in columns)
    )
    return sql(
        f"""SELECT b, var, itemset, n, p FROM (
            SELECT *, explode(array_compact(array_distinct(
                transform(itemset, x -> try_element_at({owners}, shiftright(x, 1)))))) var
            FROM {{itemsets}})""",
        itemsets=itemsets,
    )


def reliance_mass(hist: DataFrame, totals: DataFrame, mult: float, n_boot: int, normalize: bool) -> DataFrame:
    """``(var, delta) -> mass`` from root histograms keyed by bootstrap and variable.

    A bootstrap's trees up to ``(1 + mult) * its least objective`` count, each with
    weight ``1 / (n_boot * all its trees)``; that sums to 1 only if every tree of
    every bootstrap passes.  ``normalize`` divides by the trees that pass and the
    bootstraps that have any.
    """
    weight = "passing * (SELECT count(*) FROM {totals})" if normalize else f"trees * {n_boot}"
    return sql(
        f"""WITH kept AS (
            SELECT b, var, delta, cnt, trees, least FROM {{hist}} JOIN {{totals}} USING (b)
            WHERE obj <= cast(round({float(1.0 + mult)!r}D * least) AS bigint)),
        passing AS (SELECT b, var, sum(cnt) passing FROM kept GROUP BY b, var),
        merged AS (SELECT b, var, delta, sum(cnt) cnt, max(trees) trees FROM kept GROUP BY b, var, delta)
        SELECT var, delta, sum(cast(cnt AS double) / cast({weight} AS double)) mass
        FROM merged JOIN passing USING (b, var) GROUP BY var, delta""",
        hist=hist,
        totals=totals,
    )


def mean_reliance(mass: DataFrame, n_rows: int, variables: int) -> DataFrame:
    """``(var, mean_sub_mr)``; 0 for a variable without any mass."""
    return sql(
        f"""SELECT var, coalesce(mean, 0D) mean_sub_mr
        FROM (SELECT explode(sequence(0, {variables - 1})) var)
        LEFT JOIN (SELECT var, sum(mass * delta) / {n_rows} mean FROM {{mass}} GROUP BY var) USING (var)""",
        mass=mass,
    )


def reliance_cdf(mass: DataFrame, n_rows: int) -> DataFrame:
    """``(var, x, p)``: running mass by ascending ``x = delta / N``."""
    summed = running_sum("{mass}", "var", "delta", "mass", False, "var, delta")
    return sql(summed, mass=mass).selectExpr("var", f"delta / {n_rows} AS x", "running AS p")
