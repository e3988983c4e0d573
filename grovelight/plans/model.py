"""Fitting and querying the set of near-optimal trees."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import COUNT, leaf_objective, objective_bound, quoted, sql
from ..operators import frontier, histogram, predict, requests, resample, trees, trie
from ..operators.counts import itemset_counts
from ..operators.patterns import Totals, compact, packed_rows, pattern_totals, spread, words
from ..operators.proxies import ProxyRule, base_level, parent_splits, settle_estimates
from ..sources.tables import check_columns
from . import saved
from .storage import Folder, cut


#: Writes a table under a name and returns its scan.
Store = Callable[[DataFrame, str], DataFrame]

#: Conjunctions up to the depth from which subproblems are counted on request.
LAZY_FROM = 2_000_000


@dataclass(frozen=True)
class Options:
    """Parameters that change the answer."""

    lambda_reg: float = 0.01
    depth_budget: int = 5
    rashomon_mult: float = 0.01
    multiplicative_slack: float = 0.0
    root_budget: int | None = None
    lookahead_k: int = 1
    oracle_style: int = 0
    use_multipass: bool = True
    rule_list_mode: bool = False
    majority_leaf_only: bool = False
    greedy_split_mode: int = 1
    num_proxy_features: int = 0
    search: str = "auto"  # how the set is found: "eager", "lazy", or by the number of conjunctions; never what it holds

    def __post_init__(self) -> None:
        if self.depth_budget < 0:
            raise ValueError("depth_budget must not be negative")
        if self.oracle_style not in (0, 1, 2, 3):
            raise ValueError("oracle_style is one of 0, 1, 2, 3")
        if self.greedy_split_mode not in (0, 1, 2):
            raise ValueError("greedy_split_mode is one of 0, 1, 2")
        if self.search not in ("auto", "eager", "lazy"):
            raise ValueError("search is one of auto, eager, lazy")

    def lazy(self, n_features: int) -> bool:
        """Whether subproblems are counted on request instead of all at once."""
        if self.search != "auto":
            return self.search == "lazy"
        return sum(math.comb(n_features, s) << s for s in range(min(self.depth_budget, n_features) + 1)) > LAZY_FROM

    @property
    def allocation(self) -> str:
        if self.rule_list_mode:
            return trie.RULE_LIST
        return trie.MULTIPASS if self.use_multipass else trie.SINGLEPASS

    def rule(self, n_rows: int, n_features: int, depth: int | None = None) -> ProxyRule:
        return ProxyRule(
            depth=self.depth_budget if depth is None else depth,
            lam_n=penalty(self.lambda_reg, n_rows),
            n_features=n_features,
            lookahead=self.lookahead_k,
            style=self.oracle_style,
            greedy_mode=self.greedy_split_mode,
            proxy_features=self.num_proxy_features,
        )


def penalty(lam: float, n_rows: int) -> int:
    """lambda * N rounded half away from zero."""
    product = float(lam) * float(n_rows)
    whole = int(product)
    return whole + 1 if product - whole >= 0.5 else whole


@dataclass(frozen=True)
class Level:
    """Subproblems of one itemset size: their estimates and all their splits.

    Both are None below the root of a set that was read back.
    """

    estimates: DataFrame | None
    splits: DataFrame | None = None


def subproblem_levels(
    patterns: DataFrame, totals: Totals, rule: ProxyRule, keys: Sequence[str] = (), store: Store = cut
) -> dict[int, Level]:
    """All subproblems by itemset size, deepest first."""
    deepest = min(rule.depth, rule.n_features)
    wide = spread(patterns, totals.subsets(deepest))
    counts = itemset_counts(wide, totals.rare, deepest, keys, exact_size=True)
    # the deepest level is the largest table and is read once, so it is not stored
    levels = {deepest: Level(base_level(counts, rule, keys))}
    if deepest == 0:
        levels[0] = Level(store(levels[0].estimates, "level0"))
    for size in range(deepest - 1, -1, -1):
        depth_left = rule.depth - size
        splits = store(parent_splits(levels[size + 1].estimates, depth_left, rule, keys), f"level{size}")
        levels[size] = Level(settle_estimates(splits, depth_left, rule, keys), splits)
    return levels


def root_budget(options: Options, rule: ProxyRule) -> str:
    """The bound of the whole problem, as SQL over its estimates."""
    if options.root_budget is not None and options.root_budget >= 0:
        return f"{int(options.root_budget)}L"
    return objective_bound(rule.reference(), options.rashomon_mult, options.multiplicative_slack)


def whole_problem(members: DataFrame) -> DataFrame:
    """Requests with the counts of their members."""
    return members.groupBy("itemset").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))


def requested_levels(
    patterns: DataFrame, totals: Totals, rule: ProxyRule, options: Options, store: Store = cut
) -> dict[int, Level]:
    """The subproblems that some budget can reach, by itemset size; others are never counted.

    The root has the bound as its budget.  A side of a split can get at most what the other
    side surely costs leaves over: its estimate where that is exact or is charged anyway, else
    the errors that no tree avoids.  So every subproblem has a greatest budget, and only
    splits that fit into it are followed.
    """
    deepest = min(rule.depth, rule.n_features)
    members = requests.whole(patterns, rule.n_features)
    top = store(whole_problem(members), "root")
    reference = requests.estimate(rule.reference(), top, members, rule.depth, rule)
    leaf = leaf_objective("n", "p", rule.lam_n)
    root = top.join(reference, "itemset").selectExpr("itemset", "n", "p", f"{leaf} AS leaf", f"value AS {rule.reference()}")
    levels = {0: Level(store(root, "level0"))}
    wanted = levels[0].estimates.selectExpr("itemset", "n", "p", f"{root_budget(options, rule)} AS budget")
    for size in range(deepest):
        depth_left = rule.depth - size
        splits = store(requests.affordable_splits(wanted, members, depth_left, rule, options.allocation), f"level{size}")
        levels[size] = Level(levels[size].estimates, splits.select("itemset", "feature", "n_l", "p_l", "v_l", "n_r", "p_r", "v_r"))
        # an estimate that is exact, or that the other side is charged anyway, bounds the budget closer
        exact = depth_left - 1 <= rule.exact_below() or options.allocation != trie.MULTIPASS
        least = [f"v_{s}" if exact else f"(e_{s} + {rule.lam_n}L)" for s in ("l", "r")]
        wanted = store(requests.children(splits, f"budget - {least[1]}", f"budget - {least[0]}"), f"requests{size + 1}")
        if size + 1 < deepest:
            members = store(requests.members_of(wanted.where(f"budget >= {max(2 * rule.lam_n, 0)}L"), members, rule.n_features), f"members{size + 1}")
        own = splits.selectExpr("inline(array(struct(left_itemset AS itemset, v_l AS value), struct(right_itemset AS itemset, v_r AS value)))")
        own = own.groupBy("itemset").agg(F.max("value").alias("value"))
        name = rule.admission(depth_left)
        kept = ["itemset", "n", "p", f"{leaf} AS leaf", *([f"value AS {name}"] if name != "leaf" else [])]
        levels[size + 1] = Level(store(wanted.join(own, "itemset").selectExpr(*kept), f"estimates{size + 1}"))
    return levels


@dataclass
class NearOptimalSet:
    """Level tables of the set: admitted splits and frontier nodes.

    ``keys`` are extra columns that separate independent problems solved in the
    same jobs (bootstraps).
    """

    options: Options
    rule: ProxyRule
    levels: dict[int, Level]
    keys: tuple[str, ...] = ()
    store: Store = cut
    splits: dict[int, DataFrame] = field(default_factory=dict)
    frontiers: dict[int, DataFrame] = field(default_factory=dict)

    @property
    def deepest(self) -> int:
        return max(self.levels)

    def roots(self) -> DataFrame:
        """The whole problem with its objective bound."""
        bound = root_budget(self.options, self.rule)
        return self.levels[0].estimates.selectExpr(*self.keys, "itemset", f"{bound} AS budget", "n", "p")

    def child_steps(self) -> dict[int, DataFrame | None]:
        """Non-trivial step functions per level, for levels that can have any."""
        steps: dict[int, DataFrame | None] = {}
        if self.options.allocation != trie.MULTIPASS:
            return steps
        below = None
        for size in range(self.deepest - 1, 0, -1):
            depth_left = self.rule.depth - size
            if depth_left <= self.rule.exact_below():
                continue
            own = self.rule.admission(depth_left + 1)
            level = self.levels[size]
            below = self.store(trie.min_steps(level.splits, level.estimates, below, own, self.keys), f"steps{size}")
            steps[size] = below
        return steps

    def build(self) -> NearOptimalSet:
        steps = self.child_steps()
        for size in range(self.deepest):
            admitted = trie.expand(
                self.frontier(size),
                self.levels[size].splits,
                self.rule.lam_n,
                self.options.allocation,
                steps.get(size + 1),
                self.keys,
            )
            self.splits[size] = self.store(admitted, f"splits{size}")
        return self

    def frontier(self, size: int) -> DataFrame:
        """Nodes of one level, written once."""
        if size == 0:
            return self.roots()
        if size not in self.frontiers:
            self.frontiers[size] = self.store(trie.next_frontier(self.splits[size - 1], self.keys), f"frontier{size}")
        return self.frontiers[size]

    def leaves(self, size: int) -> DataFrame:
        return trie.admitted_leaves(
            self.frontier(size), self.rule.lam_n, self.options.majority_leaf_only, self.keys
        )

    def fold(self, leaf_measures=None, measures: Sequence[str] = ()) -> dict[int, DataFrame]:
        """Histograms per level; ``leaf_measures`` adds measure columns to leaves."""
        hists: dict[int, DataFrame] = {}
        for size in range(self.deepest, -1, -1):
            leaves = self.leaves(size)
            if leaf_measures is not None:
                leaves = leaf_measures(leaves)
            hist = histogram.fold_level(leaves, self.splits.get(size), hists.get(size + 1), self.keys, measures)
            # at the deepest level a histogram is only the leaves of its frontier
            hists[size] = hist if size == self.deepest > 0 else self.store(hist, f"hist{size}")
        return hists

    @cached_property
    def hists(self) -> dict[int, DataFrame]:
        return self.fold()


@dataclass
class PackedPredictions:
    """Predictions of many trees on many rows, one bit each."""

    rows: DataFrame  # (row id, block, bit): where a row's bit is
    bits: DataFrame  # (tree_id, obj, block, bits): 4,096 bytes; bit i is in byte i div 8, lowest first


class RashomonModel:
    """The fitted set of near-optimal trees and the questions one can ask it."""

    def __init__(
        self,
        features: Sequence[str],
        label: str,
        options: Options,
        totals: Totals,
        patterns: DataFrame,
        folder: Folder,
        stored: saved.Tables | None = None,
    ):
        self.features = list(features)
        self.label = label
        self.options = options
        self.totals = totals
        self.n_rows = totals.rows
        self.patterns = patterns
        self.rule = options.rule(self.n_rows, len(self.features))
        self.folder = folder
        self.stored = stored
        # a set that is read back has its root's estimates; others are counted on request
        self.lazy = stored is not None or options.lazy(len(self.features))
        if stored is not None:
            self.levels = {size: Level(stored["root"] if size == 0 else None) for size in range(self.deepest + 1)}
            self.set = NearOptimalSet(options, self.rule, self.levels, (), folder.cut)
            self.set.splits = {size: stored[f"splits{size}"] for size in range(self.deepest)}
            self.set.frontiers = {size: stored[f"frontier{size}"] for size in range(1, self.deepest + 1)}
            self.set.hists = {size: stored[f"hist{size}"] for size in range(self.deepest + 1)}
            return
        if self.lazy:
            self.levels = requested_levels(patterns, totals, self.rule, options, folder.cut)
        else:
            self.levels = subproblem_levels(patterns, totals, self.rule, store=folder.cut)
        self.set = NearOptimalSet(options, self.rule, self.levels, (), folder.cut).build()

    @property
    def deepest(self) -> int:
        return min(self.rule.depth, self.rule.n_features)

    # -- keeping and dropping -------------------------------------------------

    def save(self, path: str) -> None:
        """Write the set under ``path``, which must not exist, for :func:`load`.

        What is kept: patterns, the root's estimates, splits and nodes of the set, and its
        histograms; not the search's tables.  The manifest is written last, so a save that
        was broken off is not taken for a set.
        """
        tables = {"patterns": self.patterns, "root": self.levels[0].estimates, "subproblems": self.subproblems()}
        for size in range(self.deepest + 1):
            tables[f"hist{size}"] = self.set.hists[size]
            if size < self.deepest:
                tables[f"splits{size}"] = self.set.splits[size]
            if size > 0:
                tables[f"frontier{size}"] = self.set.frontier(size)
        about = {
            "features": self.features,
            "label": self.label,
            "options": asdict(self.options),
            "totals": asdict(self.totals),
        }
        saved.write(self.folder.spark, path, about, tables)

    def close(self) -> None:
        """Remove the working tables of this set and of its answers; a saved set stays.

        The model and DataFrames that it returned can't be read afterwards.
        """
        self.folder.remove()

    def __enter__(self) -> RashomonModel:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # -- the set as a whole -------------------------------------------------

    def bound(self) -> DataFrame:
        """``(reference, bound)``: estimate of the whole problem and the budget."""
        return sql(
            f"SELECT {self.rule.reference()} reference, budget bound FROM {{top}} JOIN {{roots}} USING (itemset)",
            top=self.levels[0].estimates,
            roots=self.set.roots(),
        )

    def root_histogram(self) -> DataFrame:
        """``(obj, cnt)`` in ascending order of objective."""
        return self.set.hists[0].select("obj", "cnt").orderBy("obj")

    def count_trees(self, max_obj: int | None = None) -> DataFrame:
        wanted = "true" if max_obj is None else f"obj <= {int(max_obj)}"
        return self.set.hists[0].where(wanted).groupBy().agg(F.expr(f"cast(coalesce(sum(cnt), 0) AS {COUNT}) cnt"))

    def min_objective(self) -> DataFrame:
        """One row; NULL when the set is empty."""
        return self.set.hists[0].groupBy().agg(F.expr("min(obj) obj"))

    def trees_per_split(self) -> DataFrame:
        """Number of trees under every admitted split of every node."""
        parts = [
            histogram.split_counts(self.set.splits[size], self.set.hists[size + 1]) for size in self.set.splits
        ]
        return reduce(DataFrame.unionByName, parts)

    # -- single trees -------------------------------------------------------

    def ranges(self) -> DataFrame:
        return trees.objective_ranges(self.set.hists[0])

    def tree_objectives(
        self, start: int = 0, stop: int | None = None, max_obj: int | None = None, ids: Sequence[int] | None = None
    ) -> DataFrame:
        """``(tree_id, obj, obj_norm)`` by rank."""
        found = trees.ranks(self.ranges(), start, stop, max_obj, ids)
        return found.selectExpr("tree_id", "obj", f"obj / {self.n_rows} AS obj_norm")

    def tree_objective(self, tree_id: int) -> tuple[int, float]:
        row = self.tree_objectives(tree_id, tree_id + 1).first() if tree_id >= 0 else None
        if row is None:
            raise IndexError(f"tree {tree_id} is not in the set")
        return row["obj"], row["obj_norm"]

    def tree_leaves(
        self, start: int = 0, stop: int | None = None, max_obj: int | None = None, ids: Sequence[int] | None = None
    ) -> DataFrame:
        """``(tree_id, leaf_no, path, itemset, prediction, loss)`` of a rank range or of listed ids.

        Paths are signed and 1-based: ``+f`` is feature ``f-1`` true.  Requests
        walk down level by level, all trees at once.
        """
        requests = trees.first_requests(trees.ranks(self.ranges(), start, stop, max_obj, ids))
        everything = start <= 0 and stop is None and max_obj is None and ids is None
        for size in range(self.set.deepest + 1):
            leaves, splits = self.set.leaves(size), self.set.splits.get(size)
            if not everything and size > 0:
                # a few trees visit a few nodes: list the choices of those alone
                visited = requests.select("itemset", "budget").distinct()
                leaves = leaves.join(visited, ["itemset", "budget"], "left_semi")
                splits = None if splits is None else splits.join(visited, ["itemset", "budget"], "left_semi")
            entries = trees.node_entries(leaves, splits, self.set.hists.get(size + 1))
            requests = trees.descend(requests, entries)
            if not everything:
                requests = self.folder.cut(requests, f"requests{size}")
        return trees.number_leaves(requests)

    @cached_property
    def all_leaves(self) -> DataFrame:
        """Leaves of every tree, written once."""
        return self.folder.cut(self.tree_leaves(), "leaves")


    def tree_paths(
        self, start: int = 0, stop: int | None = None, max_obj: int | None = None, ids: Sequence[int] | None = None
    ) -> DataFrame:
        """``(tree_id, leaf_no, path, path_text, prediction)``."""
        leaves = self.tree_leaves(start, stop, max_obj, ids)
        return leaves.selectExpr("tree_id", "leaf_no", "path", f"{trees.path_text('path')} AS path_text", "prediction")

    def tree_nodes(
        self,
        start: int = 0,
        stop: int | None = None,
        feature_names: Sequence[str] | None = None,
        ids: Sequence[int] | None = None,
    ) -> DataFrame:
        """Explicit nodes ``(tree_id, prefix, depth, feature, prediction, leaves, name)``."""
        names = self.features if feature_names is None else feature_names
        return trees.tree_nodes(self.tree_leaves(start, stop, ids=ids), names)

    # -- predictions ----------------------------------------------------------

    def check_eval(self, df: DataFrame) -> None:
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"evaluation data lacks the features {missing}")
        check_columns(df, self.features)

    def predict(self, df: DataFrame, tree_id: int, output: str = "prediction") -> DataFrame:
        """Add one tree's prediction to ``df``: a projection, so no shuffle, and
        the same for batch and streaming DataFrames."""
        self.check_eval(df)
        if tree_id < 0:
            raise IndexError(f"tree {tree_id} is not in the set")
        leaves = self.tree_leaves(tree_id, tree_id + 1).orderBy("leaf_no").collect()
        if not leaves:
            raise IndexError(f"tree {tree_id} is not in the set")
        return df.selectExpr("*", f"{predict.tree_expression(df, self.features, leaves)} AS {quoted(output)}")

    def rows_with_id(self, df: DataFrame, row_id: str) -> DataFrame:
        """Packed rows with their id under a name that no result column has."""
        return packed_rows(df, self.features, keep=[row_id]).withColumnRenamed(row_id, "_gl_id")

    def coverage(self, rows: DataFrame, itemsets: DataFrame) -> DataFrame:
        """``(words, itemset)`` for the distinct patterns of packed rows."""
        n = len(self.features)
        patterns = rows.select(*words(n)).distinct()
        return predict.match_itemsets(patterns, itemsets, self.set.deepest, n)

    def predict_all(
        self,
        df: DataFrame,
        row_id: str,
        start: int = 0,
        stop: int | None = None,
        max_obj: int | None = None,
        stack: bool = False,
        block_rows: int = 1 << 16,
        ids: Sequence[int] | None = None,
    ) -> DataFrame:
        """``(tree_id, obj, row_id, prediction)`` for every tree of a rank range or of listed ids.

        Trees come in rank order of ``tree_id``; ``max_obj`` keeps those up to an
        objective.  With ``stack`` rows are gathered into arrays per tree and block
        of rows, so no group grows with the table.
        """
        self.check_eval(df)
        n = len(self.features)
        rows = self.rows_with_id(df, row_id)
        leaves = self.folder.cut(self.tree_leaves(start, stop, max_obj, ids), "leaves")
        objs = trees.ranks(self.ranges(), start, stop, max_obj, ids)
        covered = self.folder.cut(self.coverage(rows, leaves.select("itemset").distinct()), "coverage")
        # trees meet patterns first; rows come last, so rows times trees is never shuffled
        votes = self.folder.cut(
            sql(
                f"""SELECT {", ".join(words(n))}, tree_id, obj, prediction
                FROM {{covered}} JOIN (
                    SELECT tree_id, obj, itemset, prediction
                    FROM (SELECT tree_id, itemset, prediction FROM {{leaves}}) JOIN (SELECT tree_id, obj FROM {{objs}}) USING (tree_id))
                USING (itemset)""",
                covered=covered,
                leaves=leaves,
                objs=objs,
            ),
            "pattern_votes",
        )
        out = sql(
            f"""SELECT tree_id, obj, _gl_id, prediction FROM {{rows}} JOIN {{votes}} USING ({", ".join(words(n))})""",
            rows=rows,
            votes=votes,
        )
        if not stack:
            return out.withColumnRenamed("_gl_id", row_id)
        blocks = max(1, -(-df.count() // block_rows))
        return sql(
            f"""SELECT tree_id, obj, block, transform(cells, c -> c._gl_id) row_ids,
                transform(cells, c -> c.prediction) predictions
            FROM (
                SELECT tree_id, obj, pmod(xxhash64(_gl_id), {blocks}) block,
                    array_sort(collect_list(struct(_gl_id, prediction))) cells
                FROM {{out}} GROUP BY tree_id, obj, block)""",
            out=out,
        )

    def predict_packed(
        self,
        df: DataFrame,
        row_id: str,
        start: int = 0,
        stop: int | None = None,
        max_obj: int | None = None,
        ids: Sequence[int] | None = None,
    ) -> PackedPredictions:
        """Predictions of many trees as bitmaps of 32,768 rows, in the order of ``row_id``.

        Rows meet leaf itemsets once; trees only unite bitmaps, so rows times trees is no
        table.  ``row_id`` is unique and not null.  Without rows or without trees there are no bitmaps.
        """
        self.check_eval(df)
        n = len(self.features)
        ranged = self.folder.cut(resample.ranged_rows(self.rows_with_id(df, row_id), "_gl_id"), "ranged")
        numbered = resample.dense_positions(ranged.withColumn("_gl_row", F.col("_gl_id")), "_gl_id")
        size = predict.BLOCK_ROWS
        placed = numbered.selectExpr("_gl_row", f"pos div {size} AS block", f"cast(pos % {size} AS int) AS bit", *words(n))
        rows = self.folder.cut(placed, "placed")
        n_rows = rows.count()
        leaves = self.folder.cut(self.tree_leaves(start, stop, max_obj, ids), "leaves")
        said = leaves.where("prediction = 1").select("itemset").distinct()
        covered = self.folder.cut(self.coverage(rows, said), "coverage")
        objs = trees.ranks(self.ranges(), start, stop, max_obj, ids)
        objs = objs if n_rows else objs.limit(0)
        bitmaps = self.folder.cut(predict.leaf_bitmaps(rows, covered, n), "bitmaps")
        bits = predict.tree_bitmaps(leaves, bitmaps, objs, max(1, -(-n_rows // size)))
        return PackedPredictions(rows.select("_gl_row", "block", "bit").withColumnRenamed("_gl_row", row_id), bits)

    def leaf_usage(self, max_obj: int | None = None) -> DataFrame:
        """``(itemset, prediction) -> cnt``: in how many trees each leaf occurs.

        Counted top-down from the histograms; trees are not enumerated.
        """
        wanted = "true" if max_obj is None else f"obj <= {int(max_obj)}"
        one = f"cast(1 AS {COUNT}) AS ways"
        context = self.set.hists[0].where(wanted).selectExpr("itemset", "budget", "obj", one)
        found = []
        for size in range(self.set.deepest + 1):
            found.append(predict.used_leaves(context, self.set.leaves(size)))
            if size < self.set.deepest:
                down = predict.pass_down(context, self.set.splits[size], self.set.hists[size + 1])
                context = self.folder.cut(down, f"context{size + 1}")
        usage = reduce(DataFrame.unionByName, found)
        return sql(
            f"SELECT itemset, prediction, cast(sum(ways) AS {COUNT}) cnt FROM {{usage}} GROUP BY itemset, prediction",
            usage=usage,
        )

    def majority_vote(self, df: DataFrame, row_id: str, max_obj: int | None = None) -> DataFrame:
        """``(row_id, share, prediction)``: share of trees voting 1; a tie is 1.

        The prediction compares whole numbers of votes; only the share is rounded.

        Votes are summed per pattern over leaf usage, so the cost does not depend
        on the number of trees.
        """
        self.check_eval(df)
        n = len(self.features)
        key = ", ".join(words(n))
        rows = self.rows_with_id(df, row_id)
        usage = self.folder.cut(self.leaf_usage(max_obj), "usage")
        covered = self.coverage(rows, usage.select("itemset").distinct())
        share = self.folder.cut(
            sql(
                f"""SELECT {key}, ones, total FROM (
                    SELECT {key}, cast(sum(if(prediction = 1, cnt, 0)) AS {COUNT}) ones, cast(sum(cnt) AS {COUNT}) total
                    FROM {{covered}} JOIN {{usage}} USING (itemset) GROUP BY {key})""",
                covered=covered,
                usage=usage,
            ),
            "share",
        )
        return sql(
            f"""SELECT _gl_id, cast(ones AS double) / cast(total AS double) share,
                cast(ones >= total - ones AS int) prediction
            FROM {{rows}} JOIN {{share}} USING ({key})""",
            rows=rows,
            share=share,
        ).withColumnRenamed("_gl_id", row_id)

    def correct_counts(self, df: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
        """``(tree_id, correct, total)`` on any labelled data; counted per leaf
        itemset, never per row and tree."""
        self.check_eval(df)
        n = len(self.features)
        patterns = compact(packed_rows(df, self.features, self.label), n)
        leaves = self.folder.cut(self.tree_leaves(start, stop), "leaves")
        weights = predict.itemset_weights(patterns, leaves.select("itemset").distinct(), self.set.deepest, n)
        return sql(
            """SELECT tree_id, cast(sum(coalesce(if(prediction = 1, p, n - p), 0)) AS bigint) correct,
                cast(sum(coalesce(n, 0)) AS bigint) total
            FROM {leaves} LEFT JOIN {weights} USING (itemset) GROUP BY tree_id""",
            leaves=leaves,
            weights=weights,
        )

    # -- estimates on demand --------------------------------------------------

    def subproblems(self) -> DataFrame:
        """``(size, subproblems, splits)``: how many are stored per number of conditions."""
        if self.stored is not None:
            return self.stored["subproblems"]
        parts = []
        for size, level in self.levels.items():
            parts.append(level.estimates.selectExpr(f"{size} AS size", "1L AS subproblem", "0L AS split"))
            if level.splits is not None:
                parts.append(level.splits.selectExpr(f"{size} AS size", "0L AS subproblem", "1L AS split"))
        rows = reduce(DataFrame.unionByName, parts)
        return rows.groupBy("size").agg(F.sum("subproblem").alias("subproblems"), F.sum("split").alias("splits"))

    def itemset_counts(self, itemsets: DataFrame) -> DataFrame:
        """``(itemset, n, p)`` of listed conjunctions (sorted literals ``2 * feature + value``), counted on request."""
        longest = itemsets.agg(F.max(F.size("itemset"))).first()[0] or 0
        return requests.requested_counts(self.patterns, itemsets, longest, len(self.features))

    def estimates_at(self, itemsets: DataFrame, depth: int, kind: str = "v1") -> DataFrame:
        """``(itemset, value)`` of listed conjunctions in a tree of another depth, counted on request.

        Conjunctions longer than ``depth`` or without rows are left out.
        """
        rule = self.options.rule(self.n_rows, len(self.features), depth)
        matched = predict.match_itemsets(self.patterns, itemsets.distinct(), depth, len(self.features), carried=["n", "p"])
        members = self.folder.cut(matched, "members")
        parts = []
        sizes = members.select(F.size("itemset").alias("size")).distinct().collect()  # at most depth + 1
        for size in sorted(r["size"] for r in sizes if r["size"] <= depth):
            own = members.where(F.size("itemset") == size)
            wanted = self.folder.cut(whole_problem(own), "requests")
            parts.append(requests.estimate(kind, wanted, own, depth - size, rule))
        return reduce(DataFrame.unionByName, parts) if parts else members.selectExpr("itemset", "n AS value")

    def root_lookahead(self, depth: int) -> DataFrame:
        """Lookahead-1 estimate of the whole problem at a given depth."""
        if depth == self.rule.depth and not self.lazy:
            return self.levels[0].estimates.selectExpr("v1 AS obj")
        root = self.levels[0].estimates.select("itemset")
        return self.estimates_at(root, depth).selectExpr("value AS obj")

    def frontier_scores(
        self, depth: int, start: int = 0, stop: int | None = None, ids: Sequence[int] | None = None
    ) -> DataFrame:
        """``(tree_id, node_no, depth, score)`` for the internal nodes of trees."""
        nodes = trees.tree_nodes(self.tree_leaves(start, stop, ids=ids))
        if depth == self.rule.depth and not self.lazy:
            parts = [level.estimates.select("itemset", "v1") for level in self.levels.values()]
            return frontier.frontier_scores(nodes, reduce(DataFrame.unionByName, parts), depth)
        nodes = self.folder.cut(nodes, "nodes")
        wanted = self.folder.cut(frontier.members(nodes, depth).select("itemset").distinct(), "wanted")
        estimates = self.folder.cut(self.estimates_at(wanted, depth).withColumnRenamed("value", "v1"), "estimates")
        return frontier.frontier_scores(nodes, estimates, depth)


def fit(df: DataFrame, features: Sequence[str], label: str, **options) -> RashomonModel:
    """Find all depth-bounded trees within the bound of a strong reference tree."""
    opts = Options(**options)
    check_columns(df, features, label)
    rows = packed_rows(df, features, label)
    folder = Folder(df.sparkSession)
    patterns = folder.cut(compact(rows, len(features)), "patterns")
    totals = pattern_totals(patterns, len(features))
    if totals.rows == 0:
        folder.remove()
        raise ValueError("no rows to fit")
    if penalty(opts.lambda_reg, totals.rows) == 0:
        warnings.warn("lambda * N rounds to 0: leaves are free and the set can explode", stacklevel=2)
    return RashomonModel(features, label, opts, totals, patterns, folder)


def load(spark: SparkSession, path: str) -> RashomonModel:
    """A set written by :meth:`RashomonModel.save`; nothing is searched again."""
    about, stored = saved.read(spark, path)
    return RashomonModel(
        about["features"],
        about["label"],
        Options(**about["options"]),
        Totals(**about["totals"]),
        stored["patterns"],
        Folder(spark),
        stored,
    )
