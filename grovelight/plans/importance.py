"""Bootstrap distribution of variable importance over near-optimal sets.

All bootstraps are fitted by the same jobs: the bootstrap number is one more key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sql
from ..operators import histogram, importance, resample
from ..operators.patterns import compact, packed_rows, pattern_totals
from ..operators.predict import itemset_weights
from ..sources.tables import check_columns
from .model import NearOptimalSet, Options, subproblem_levels
from .storage import Folder


def variable_columns(n_features: int, binning_map: Mapping[int, Sequence[int]] | None) -> tuple[list[int], list[list[int]]]:
    """Variable names in ascending order and the feature columns of each."""
    if binning_map is None:
        return list(range(n_features)), [[f] for f in range(n_features)]
    variables = sorted(binning_map)
    columns = [list(binning_map[v]) for v in variables]
    used = [f for group in columns for f in group]
    if any(f < 0 or f >= n_features for f in used):
        raise ValueError("binning_map names a feature that does not exist")
    if len(set(used)) != len(used):
        raise ValueError("binning_map puts a feature into two variables")
    return variables, columns


@dataclass
class Importance:
    """Result tables and the tables they were made of."""

    mean: DataFrame  # (var, mean_sub_mr)
    cdf: DataFrame  # (var, x, p)
    mass: DataFrame  # (var, delta, mass)
    sample: DataFrame  # (b, i, words, y)
    permuted: DataFrame  # (b, var, words, n, p)
    near_optimal: NearOptimalSet
    folder: Folder

    def close(self) -> None:
        """Remove the working tables; none of the tables can be read afterwards."""
        self.folder.remove()


def subtractive_reliance(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str | None = None,
    n_boot: int = 10,
    lambda_reg: float = 0.01,
    depth_budget: int = 5,
    rashomon_mult: float = 0.03,
    lookahead_k: int = 1,
    seed: int = 0,
    binning_map: Mapping[int, Sequence[int]] | None = None,
    normalize: bool = False,
) -> Importance:
    """Mean and distribution of subtractive model reliance per variable.

    ``row_id`` is a unique column that fixes the row order; without one, rows are
    taken in the order in which they are first stored.
    """
    check_columns(df, features, label)
    n_features = len(features)
    variables, columns = variable_columns(n_features, binning_map)
    if row_id is None:
        df, row_id = df.withColumn("_gl_id", F.monotonically_increasing_id()), "_gl_id"
    rows = packed_rows(df, features, label, keep=[row_id]).withColumnRenamed(row_id, "_gl_id")
    spark = df.sparkSession
    folder = Folder(spark)
    cut = folder.cut
    ranged = cut(resample.ranged_rows(rows, "_gl_id"), "ranged")
    n_rows = ranged.count()
    if n_rows == 0:
        folder.remove()
        raise ValueError("no rows")

    draws = resample.bootstrap_draws(spark, n_rows, n_boot, seed)
    positioned = resample.dense_positions(ranged, "_gl_id")
    sample = cut(resample.bootstrap_sample(positioned, draws), "sample")
    patterns = cut(compact(sample, n_features, ["b"]), "patterns")

    options = Options(
        lambda_reg=lambda_reg, depth_budget=depth_budget, rashomon_mult=rashomon_mult, lookahead_k=lookahead_k
    )
    rule = options.rule(n_rows, n_features)
    levels = subproblem_levels(patterns, pattern_totals(patterns, n_features), rule, ["b"], cut)
    found = NearOptimalSet(options, rule, levels, ("b",), cut).build()

    permuted = cut(resample.permuted_patterns(sample, columns, n_rows, n_features, seed, cut), "permuted")

    # only leaves that test a permuted column can change, so only those are counted again
    frontiers = [found.frontier(size).select("b", "itemset", "n", "p") for size in range(found.deepest + 1)]
    leaf_sets = reduce(DataFrame.unionByName, frontiers).distinct()
    before = cut(importance.touched_itemsets(leaf_sets, columns), "before")
    after = itemset_weights(
        permuted, before.select("b", "var", "itemset"), found.deepest, n_features, ["b", "var"]
    )
    deltas = cut(importance.leaf_losses(before, after), "deltas")

    hist = reliance_histogram(found, deltas, len(variables))
    totals = cut(
        found.hists[0].groupBy("b").agg(F.expr("sum(cnt) trees"), F.expr("min(obj) least")), "totals"
    )
    mass = importance.reliance_mass(hist, totals, rashomon_mult, n_boot, normalize)
    names = F.create_map(*[F.lit(x) for pair in enumerate(variables) for x in pair])
    mass = cut(mass, "mass")
    return Importance(
        mean=importance.mean_reliance(mass, n_rows, len(variables)).withColumn("var", names[F.col("var")]),
        cdf=importance.reliance_cdf(mass, n_rows).withColumn("var", names[F.col("var")]),
        mass=mass.withColumn("var", names[F.col("var")]),
        sample=sample,
        permuted=permuted,
        near_optimal=found,
        folder=folder,
    )


def reliance_histogram(found: NearOptimalSet, deltas: DataFrame, n_vars: int) -> DataFrame:
    """Root histogram over (objective, delta) per bootstrap and variable."""
    each = f"explode(sequence(0, {n_vars - 1})) AS var"
    keys = ("b", "var")
    below = None
    for size in range(found.deepest, -1, -1):
        leaves = sql(
            f"""SELECT b, var, itemset, budget, prediction, loss, coalesce(delta, 0L) delta
            FROM (SELECT *, {each} FROM {{leaves}}) LEFT JOIN {{deltas}} USING (b, var, itemset, prediction)""",
            leaves=found.leaves(size),
            deltas=deltas,
        )
        splits = found.splits.get(size)
        splits = None if splits is None else splits.selectExpr("*", each)
        below = found.store(histogram.fold_level(leaves, splits, below, keys, ["delta"]), f"reliance{size}")
    return below.select("b", "var", "obj", "delta", "cnt")
