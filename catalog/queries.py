"""Spark side of the catalogue: every query reads the whole tables of ``sf_dir``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from grovelight import binary_table, fit, load, subtractive_reliance
from grovelight.functions.columns import leaf_objective
from grovelight.operators import counts, patterns, proxies, requests
from grovelight.plans.model import Options, penalty, subproblem_levels
from grovelight.plans.storage import cut, work_dir

from . import views

KEY = "array_join(itemset, ',') AS itemset"
_fitted: dict = {}


def model(spark: SparkSession, sf_dir: str, view: str = "ord_score", **options):
    """Fit once per session, data and options; several queries ask the same set."""
    key = (spark.sparkContext.applicationId, sf_dir, view, tuple(sorted(options.items())))
    if key not in _fitted:
        _fitted[key] = fit(views.load(spark, sf_dir, view), views.features(view), "y", **options)
    return _fitted[key]


def forget() -> None:
    """Drop fitted sets, so that the next query finds its set anew."""
    _fitted.clear()


def rows(spark: SparkSession, sf_dir: str, table: str) -> int:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def small(spark: SparkSession, sf_dir: str, view: str = "ord_score", **options):
    """The depth-2 set most queries ask."""
    return model(spark, sf_dir, view, **({"lambda_reg": 0.01, "depth_budget": 2, "rashomon_mult": 0.15} | options))


def compacted(spark: SparkSession, sf_dir: str, view: str):
    rows = patterns.packed_rows(views.load(spark, sf_dir, view), views.features(view), "y")
    table = cut(patterns.compact(rows, views.FEATURES[view]), "patterns")
    return table, patterns.pattern_totals(table, views.FEATURES[view])


def counted(spark: SparkSession, sf_dir: str, view: str, depth: int) -> tuple[DataFrame, int]:
    table, totals = compacted(spark, sf_dir, view)
    return counts.itemset_counts(table, totals.rare, depth), totals.rows


def levels(spark: SparkSession, sf_dir: str, view: str, depth: int, **options):
    """Estimate tables alone, without building a set."""
    key = ("levels", spark.sparkContext.applicationId, sf_dir, view, depth, tuple(sorted(options.items())))
    if key not in _fitted:
        table, totals = compacted(spark, sf_dir, view)
        rule = Options(depth_budget=depth, **options).rule(totals.rows, views.FEATURES[view])
        _fitted[key] = subproblem_levels(table, totals, rule)
    return _fitted[key]


def whole_numbers(query: Callable) -> Callable:
    """All integer columns as BIGINT, so that types match between engines."""

    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        ints = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
        return df.selectExpr(*(f"cast(`{c}` AS bigint) `{c}`" if c in ints else f"`{c}`" for c in df.columns))

    run.__name__ = query.__name__
    return run


def union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reliance(spark: SparkSession, sf_dir: str):
    key = ("reliance", spark.sparkContext.applicationId, sf_dir)
    if key not in _fitted:
        _fitted[key] = subtractive_reliance(
            views.load(spark, sf_dir, "ord_score"),
            views.features("ord_score"),
            "y",
            row_id="row_id",
            n_boot=2,
            lambda_reg=0.01,
            depth_budget=2,
            rashomon_mult=0.4,
            seed=7,
            binning_map=views.BINS,
        )
    return _fitted[key]


# -- sources and counts -------------------------------------------------------


def binary_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    raw = orders.selectExpr(
        "o_orderkey row_id", "o_custkey % 3 a", "month(o_orderdate) - 6 b", "o_orderstatus = 'F' c", "o_orderkey % 5 - 2 y"
    )
    return binary_table(raw, ["a", "b", "c"], "y", keep=["row_id"])


def pattern_compaction(spark, sf_dir):
    table, _ = compacted(spark, sf_dir, "li_score")
    return table.selectExpr(*(f"cast({patterns.bit(f)} AS int) AS f{f}" for f in range(10)), "n", "p")


def literal_counts(spark, sf_dir):
    table, _ = counted(spark, sf_dir, "li_score", 1)
    return table.where("size(itemset) = 1").selectExpr(
        "shiftright(itemset[0], 1) AS feature", "itemset[0] & 1 AS value", "n", "p"
    )


def itemset_counts_2(spark, sf_dir):
    return counted(spark, sf_dir, "li_score", 2)[0].selectExpr(KEY, "n", "p")


def itemset_counts_3(spark, sf_dir):
    return counted(spark, sf_dir, "ord_score", 3)[0].selectExpr(KEY, "n", "p")


def split_contingency(spark, sf_dir):
    table, _ = counted(spark, sf_dir, "li_score", 2)
    return counts.split_contingency(table).selectExpr(KEY, "feature", "n_l", "p_l", "n_r", "p_r")


def valid_splits(spark, sf_dir):
    table, _ = counted(spark, sf_dir, "li_score", 2)
    return counts.valid_splits(counts.split_contingency(table)).selectExpr(KEY, "feature", "n_l", "n_r")


# -- losses and estimates -------------------------------------------------------


def leaf_objectives(spark, sf_dir):
    table, n_rows = counted(spark, sf_dir, "ord_score", 2)
    return table.selectExpr(KEY, f"{leaf_objective('n', 'p', penalty(0.01, n_rows))} AS leaf")


def entropy_gain(spark, sf_dir):
    table, n_rows = counted(spark, sf_dir, "ord_score", 2)
    scores = proxies.split_scores(counts.split_contingency(table), penalty(0.01, n_rows))
    return scores.selectExpr(KEY, "feature", "round(gain, 9) AS gain", "loss")


def _best(spark, sf_dir, by_entropy, searched=0):
    table, n_rows = counted(spark, sf_dir, "ord_score", 2)
    contingency = counts.split_contingency(table)
    return proxies.best_split(contingency, penalty(0.01, n_rows), 9, by_entropy, searched).selectExpr(KEY, "feature")


def best_split_entropy(spark, sf_dir):
    return _best(spark, sf_dir, True)


def best_split_loss(spark, sf_dir):
    return _best(spark, sf_dir, False)


def best_split_prefix(spark, sf_dir):
    return _best(spark, sf_dir, True, searched=6)


def depth1_exact(spark, sf_dir):
    return levels(spark, sf_dir, "ord_score", 2, lambda_reg=0.01)[1].estimates.selectExpr(KEY, "x AS obj")


def depth2_exact(spark, sf_dir):
    return levels(spark, sf_dir, "ord_score", 3, lambda_reg=0.01)[1].estimates.selectExpr(KEY, "x AS obj")


def depth3_exact(spark, sf_dir):
    return levels(spark, sf_dir, "ord_score", 3, lambda_reg=0.01)[0].estimates.selectExpr("x AS obj")


def depth3_exact_prefix(spark, sf_dir):
    return levels(spark, sf_dir, "ord_score", 3, lambda_reg=0.01, num_proxy_features=5)[0].estimates.selectExpr("x AS obj")


def greedy_objective_d3(spark, sf_dir):
    parts = []
    for mode in (0, 1, 2):
        top = levels(spark, sf_dir, "ord_score", 3, lambda_reg=0.01, greedy_split_mode=mode)[0]
        parts.append(top.estimates.selectExpr(f"{mode} AS mode", "g AS obj"))
    return union(parts)


def greedy_objective_parity(spark, sf_dir):
    parts = []
    for mode in (0, 1, 2):
        top = levels(spark, sf_dir, "li_parity", 3, lambda_reg=0.005, greedy_split_mode=mode)[0]
        parts.append(top.estimates.selectExpr(f"{mode} AS mode", "g AS obj"))
    return union(parts)


def lookahead_objective_d3(spark, sf_dir):
    return union(
        levels(spark, sf_dir, view, 3, lambda_reg=lam)[0].estimates.selectExpr(f"'{view}' AS dataset", "v1 AS obj")
        for view, lam in (("ord_score", 0.01), ("li_parity", 0.005), ("doc_labels", 0.01))
    )


# -- the set ------------------------------------------------------------------


def rashomon_bound(spark, sf_dir):
    parts = []
    for slack in (0.0, 0.1):
        parts.append(small(spark, sf_dir, multiplicative_slack=slack).bound().selectExpr(f"{slack}D AS slack", "*"))
    return union(parts)


def admitted_leaves(spark, sf_dir):
    found = small(spark, sf_dir).set
    return union(found.leaves(size) for size in range(found.deepest + 1)).selectExpr(KEY, "budget", "prediction", "loss")


def admitted_splits(spark, sf_dir):
    splits = small(spark, sf_dir).set.splits
    return union(splits.values()).selectExpr(KEY, "budget", "feature")


def _budgets(found):
    return union(found.splits.values()).selectExpr(KEY, "budget", "feature", "left_budget", "right_budget")


def budgets_singlepass(spark, sf_dir):
    return _budgets(small(spark, sf_dir, use_multipass=False).set)


def budgets_multipass(spark, sf_dir):
    return _budgets(small(spark, sf_dir).set)


def rule_list_histogram(spark, sf_dir):
    return small(spark, sf_dir, lookahead_k=-1, rule_list_mode=True).root_histogram().selectExpr(
        "obj", "cast(cnt AS bigint) cnt"
    )


def majority_leaf_histogram(spark, sf_dir):
    return small(spark, sf_dir, majority_leaf_only=True).root_histogram().selectExpr("obj", "cast(cnt AS bigint) cnt")


# -- questions about the set ----------------------------------------------------


def root_histogram(spark, sf_dir):
    return small(spark, sf_dir).root_histogram().selectExpr("obj", "cast(cnt AS bigint) cnt")


def root_histogram_lineitem(spark, sf_dir):
    return small(spark, sf_dir, "li_score").root_histogram().selectExpr("obj", "cast(cnt AS bigint) cnt")


def root_histogram_documents(spark, sf_dir):
    found = small(spark, sf_dir, "doc_labels", rashomon_mult=0.1)
    return found.root_histogram().selectExpr("obj", "cast(cnt AS bigint) cnt")


def root_histogram_user_budget(spark, sf_dir):
    """Bound of a fifth of the rows, given by the caller."""
    n = views.load(spark, sf_dir, "ord_score").count()
    found = small(spark, sf_dir, root_budget=n // 5)
    return found.root_histogram().selectExpr("obj", "cast(cnt AS bigint) cnt")


def depth3(spark, sf_dir, **options):
    return model(spark, sf_dir, lambda_reg=0.01, depth_budget=3, rashomon_mult=0.15, **options)


def root_histogram_d3(spark, sf_dir):
    return depth3(spark, sf_dir).root_histogram().selectExpr("obj", "cast(cnt AS bigint) cnt")


def root_histogram_d3_exact(spark, sf_dir):
    return depth3(spark, sf_dir, lookahead_k=2).root_histogram().selectExpr("obj", "cast(cnt AS bigint) cnt")


def count_trees(spark, sf_dir):
    return small(spark, sf_dir).count_trees().selectExpr("cast(cnt AS bigint) cnt")


def count_leq(spark, sf_dir):
    """Trees within a fifth of the rows."""
    found = small(spark, sf_dir)
    return found.count_trees(max_obj=found.n_rows // 5).selectExpr("cast(cnt AS bigint) cnt")


def min_objective(spark, sf_dir):
    return small(spark, sf_dir).min_objective()


def trees_per_split(spark, sf_dir):
    return small(spark, sf_dir).trees_per_split().selectExpr(KEY, "budget", "feature", "cast(cnt AS bigint) cnt")


# -- trees ----------------------------------------------------------------------


def tree_objectives(spark, sf_dir):
    found = small(spark, sf_dir)
    return found.tree_objectives().selectExpr("tree_id", "obj", "round(obj_norm, 9) AS obj_norm")


def tree_leaves(spark, sf_dir):
    return small(spark, sf_dir).all_leaves.selectExpr("tree_id", "leaf_no", KEY, "prediction", "loss")


def tree_paths(spark, sf_dir):
    return small(spark, sf_dir).tree_paths().selectExpr("tree_id", "leaf_no", "array_join(path, ',') AS path", "prediction")


def tree_path_strings(spark, sf_dir):
    return small(spark, sf_dir).tree_paths().select("tree_id", "leaf_no", "path_text", "prediction")


def tree_nodes(spark, sf_dir):
    return small(spark, sf_dir).tree_nodes().selectExpr(
        "tree_id", "array_join(prefix, ',') AS prefix", "depth", "feature", "prediction", "leaves", "name"
    )


def frontier_scores(spark, sf_dir):
    return small(spark, sf_dir).frontier_scores(2)


def root_lookahead(spark, sf_dir):
    found = small(spark, sf_dir)
    return union(found.root_lookahead(d).selectExpr(f"{d} AS depth", "obj") for d in (1, 2, 3))


# -- predictions ------------------------------------------------------------------


def predict_tree(spark, sf_dir):
    rows = views.load(spark, sf_dir, "ord_score")
    return small(spark, sf_dir).predict(rows, 20).select("row_id", "prediction")


def predict_all(spark, sf_dir):
    rows = views.load(spark, sf_dir, "ord_score")
    return small(spark, sf_dir).predict_all(rows, "row_id").select("tree_id", "row_id", "prediction")


def predict_packed(spark, sf_dir):
    packed = small(spark, sf_dir).predict_packed(views.load(spark, sf_dir, "ord_score"), "row_id")
    return packed.bits.selectExpr("tree_id", "obj", "block", "bitmap_count(bits) AS ones", "md5(hex(bits)) AS digest")


def saved_trees_per_split(spark, sf_dir):
    """The set is read back from what was saved; the answers come from there."""
    path = f"{work_dir(spark)}/grovelight-saved-{uuid.uuid4().hex}"
    small(spark, sf_dir).save(path)
    return load(spark, path).trees_per_split().selectExpr(KEY, "budget", "feature", "cast(cnt AS bigint) cnt")


def predict_up_to_objective(spark, sf_dir):
    """Trees within one penalty of the best."""
    found = small(spark, sf_dir)
    best = found.min_objective().first()["obj"]
    rows = views.load(spark, sf_dir, "ord_score")
    return found.predict_all(rows, "row_id", max_obj=best + found.rule.lam_n)


def majority_vote(spark, sf_dir):
    rows = views.load(spark, sf_dir, "ord_score")
    voted = small(spark, sf_dir).majority_vote(rows, "row_id")
    return voted.selectExpr("row_id", "round(share, 9) AS share", "prediction")


def majority_vote_divided(spark, sf_dir):
    """A wider set, whose trees disagree on most rows."""
    rows = views.load(spark, sf_dir, "ord_score")
    voted = small(spark, sf_dir, rashomon_mult=0.7).majority_vote(rows, "row_id")
    return voted.selectExpr("row_id", "round(share, 9) AS share", "prediction")


def tree_paths_by_id(spark, sf_dir):
    """Scattered trees, asked for in one job."""
    return small(spark, sf_dir).tree_paths(ids=[0, 3, 17, 40]).selectExpr(
        "tree_id", "leaf_no", "array_join(path, ',') AS path", "prediction"
    )


def leaf_usage(spark, sf_dir):
    return small(spark, sf_dir).leaf_usage().selectExpr(KEY, "prediction", "cast(cnt AS bigint) cnt")


def correct_counts(spark, sf_dir):
    rows = views.load(spark, sf_dir, "ord_score")
    return small(spark, sf_dir).correct_counts(rows)


# -- importance -------------------------------------------------------------------


def bootstrap_weights(spark, sf_dir):
    return reliance(spark, sf_dir).sample.groupBy("b", "w0").agg({"y": "sum", "*": "count"}).selectExpr(
        "b", *(f"cast({patterns.bit(f)} AS int) AS f{f}" for f in range(9)), "`count(1)` AS n", "`sum(y)` AS p"
    )


def block_permutation(spark, sf_dir):
    return reliance(spark, sf_dir).permuted.selectExpr(
        "b", "var", *(f"cast({patterns.bit(f)} AS int) AS f{f}" for f in range(9)), "n", "p"
    )


def reliance_mean(spark, sf_dir):
    return reliance(spark, sf_dir).mean.selectExpr("var", "round(mean_sub_mr, 9) AS mean_sub_mr")


def reliance_cdf(spark, sf_dir):
    return reliance(spark, sf_dir).cdf.selectExpr("var", "round(x, 9) AS x", "round(p, 9) AS p")


# -- subproblems on request ------------------------------------------------------


def requested_counts(spark, sf_dir):
    """Counts of listed conjunctions alone, among them one that no row meets."""
    rows = views.load(spark, sf_dir, "li_score")
    listed = rows.selectExpr("inline(array(struct(array(f0, 8 + f4, 14 + f7) AS itemset), struct(array(2 + f1, 18 + f9) AS itemset)))")
    listed = listed.distinct().unionByName(spark.sql("SELECT array(0, 1) itemset"))
    table, _ = compacted(spark, sf_dir, "li_score")
    return requests.requested_counts(table, listed, 3, views.FEATURES["li_score"]).selectExpr(KEY, "n", "p")


def root_histogram_d4_exact(spark, sf_dir):
    found = model(spark, sf_dir, lambda_reg=0.01, depth_budget=4, rashomon_mult=0.03, lookahead_k=3)
    return found.root_histogram().selectExpr("obj", "cast(cnt AS bigint) cnt")


def root_histogram_d4_requested(spark, sf_dir):
    """The same set, found by counting only what its budgets can reach."""
    found = model(spark, sf_dir, lambda_reg=0.01, depth_budget=4, rashomon_mult=0.03, lookahead_k=3, search="lazy")
    return found.root_histogram().selectExpr("obj", "cast(cnt AS bigint) cnt")


def root_histogram_d3_requested(spark, sf_dir):
    """Estimates follow the chosen splits only; the set is that of the eager search."""
    return depth3(spark, sf_dir, search="lazy").root_histogram().selectExpr("obj", "cast(cnt AS bigint) cnt")


# -- approximate regime: no closed SQL form, checked against a small model in tests --


def histogram_depth5(spark, sf_dir):
    found = model(spark, sf_dir, lambda_reg=0.01, depth_budget=5, rashomon_mult=0.02)
    return found.root_histogram().selectExpr("obj", "cast(cnt AS bigint) cnt")


def histogram_depth5_scattered(spark, sf_dir):
    """Estimates miss the optimum at two levels, so budgets are handed on in rounds."""
    found = model(spark, sf_dir, "li_scattered", lambda_reg=0.003, depth_budget=5, rashomon_mult=0.01)
    return found.root_histogram().selectExpr("obj", "cast(cnt AS bigint) cnt")


def histogram_style2(spark, sf_dir):
    found = model(
        spark, sf_dir, "li_score", lambda_reg=0.01, depth_budget=4, rashomon_mult=0.02, lookahead_k=2, oracle_style=2
    )
    return found.root_histogram().selectExpr("obj", "cast(cnt AS bigint) cnt")


def histogram_style2_scattered(spark, sf_dir):
    """Splits of the root that only exact estimates would admit are not in the set."""
    found = model(
        spark, sf_dir, "li_scattered", lambda_reg=0.002, depth_budget=4, rashomon_mult=0.02, lookahead_k=2, oracle_style=2
    )
    return found.root_histogram().selectExpr("obj", "cast(cnt AS bigint) cnt")


def lookahead_styles_d4(spark, sf_dir):
    """Lookahead 2 at depth 4, where every style goes on in another way."""
    return union(
        levels(spark, sf_dir, "li_scattered", 4, lambda_reg=0.002, lookahead_k=2, oracle_style=style)[0].estimates.selectExpr(
            f"{style} AS style", "v2 AS obj"
        )
        for style in (0, 1, 2, 3)
    )


def budgets_greedy_d3(spark, sf_dir):
    """Greedy estimates (lookahead 0) miss the optimum, so multipass budgets are found in
    rounds and are larger than those of a single pass."""
    parts = []
    for name, multipass in (("multipass", True), ("singlepass", False)):
        found = model(
            spark, sf_dir, "li_scattered", lambda_reg=0.001, depth_budget=3, rashomon_mult=0.3, lookahead_k=0,
            greedy_split_mode=0, use_multipass=multipass,
        )
        parts.append(_budgets(found.set).selectExpr(f"'{name}' AS allocation", "*"))
    return union(parts)


CATALOGUE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: whole_numbers(f)
    for f in (
        binary_scan,
        pattern_compaction,
        literal_counts,
        itemset_counts_2,
        itemset_counts_3,
        split_contingency,
        valid_splits,
        leaf_objectives,
        entropy_gain,
        best_split_entropy,
        best_split_loss,
        best_split_prefix,
        depth1_exact,
        depth2_exact,
        depth3_exact,
        depth3_exact_prefix,
        greedy_objective_d3,
        greedy_objective_parity,
        lookahead_objective_d3,
        rashomon_bound,
        admitted_leaves,
        admitted_splits,
        budgets_singlepass,
        budgets_multipass,
        rule_list_histogram,
        majority_leaf_histogram,
        root_histogram,
        root_histogram_lineitem,
        root_histogram_documents,
        root_histogram_user_budget,
        root_histogram_d3,
        root_histogram_d3_exact,
        root_histogram_d3_requested,
        root_histogram_d4_exact,
        root_histogram_d4_requested,
        requested_counts,
        count_trees,
        count_leq,
        min_objective,
        trees_per_split,
        tree_objectives,
        tree_leaves,
        tree_paths,
        tree_path_strings,
        tree_nodes,
        frontier_scores,
        root_lookahead,
        predict_tree,
        predict_all,
        predict_packed,
        saved_trees_per_split,
        predict_up_to_objective,
        majority_vote,
        majority_vote_divided,
        tree_paths_by_id,
        leaf_usage,
        correct_counts,
        bootstrap_weights,
        block_permutation,
        reliance_mean,
        reliance_cdf,
        histogram_depth5,
        histogram_depth5_scattered,
        histogram_style2,
        histogram_style2_scattered,
        lookahead_styles_d4,
        budgets_greedy_d3,
    )
}
