"""The Spark search against direct enumeration, in the regimes SQL cannot state."""

import math

import numpy as np
import pytest

from grovelight import fit
from grovelight.plans.model import Options
from small_model import SmallModel


def table(spark, seed, n, n_features, noise=0.15, kind="mixed"):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, n_features)) < rng.uniform(0.25, 0.7, n_features)).astype(int)
    if kind == "parity":
        y = x[:, :3].sum(axis=1) % 2
    else:
        y = (2 * x[:, 0] + x[:, 1] + x[:, 2] * x[:, 3] - x[:, -1] >= 1).astype(int)
    y = np.where(rng.random(n) < noise, 1 - y, y)
    rows = [[int(v) for v in r] for r in x]
    names = [f"c{i}" for i in range(n_features)]
    df = spark.createDataFrame([(*r, int(t)) for r, t in zip(rows, y)], [*names, "y"])
    return df, names, rows, [int(v) for v in y]


CASES = [
    # depth, k, style, extra Spark options, extra model options
    (4, 1, 0, {}, {}),
    (5, 1, 0, {}, {}),
    (4, 2, 1, {}, {}),
    (4, 1, 1, {}, {}),
    (4, 2, 2, {}, {}),
    (4, 3, 2, {}, {}),
    (4, 2, 3, {}, {}),
    (4, 1, 3, {}, {}),
    (4, 0, 0, {}, {}),
    (3, -1, 0, {}, {}),
    (4, 1, 0, {"greedy_split_mode": 0}, {"greedy": 0}),
    (4, 1, 0, {"greedy_split_mode": 2}, {"greedy": 2}),
    (4, 1, 0, {"num_proxy_features": 3}, {"searched": 3}),
    (4, 1, 0, {"use_multipass": False}, {"multipass": False}),
    (4, 1, 0, {"majority_leaf_only": True}, {"majority": True}),
    (4, 1, 0, {"rule_list_mode": True}, {"rule_list": True}),
    (3, -1, 0, {"rule_list_mode": True}, {"rule_list": True}),
    (7, 1, 0, {}, {}),  # more depth than features
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_set_equals_enumeration(spark, case):
    kind = "parity" if case % 2 else "mixed"
    depth, k, style, options, model_options = CASES[case]
    df, names, rows, labels = table(spark, 11 + case, 90, 5, kind=kind)
    expected = SmallModel(rows, labels, lam=0.03, depth=depth, mult=0.12, k=k, style=style, **model_options)
    got = fit(
        df, names, "y", lambda_reg=0.03, depth_budget=depth, rashomon_mult=0.12, lookahead_k=k, oracle_style=style, **options
    )
    assert got.bound().first() == (expected.reference, expected.bound)
    histogram = [(r["obj"], int(r["cnt"])) for r in got.root_histogram().collect()]
    assert histogram == expected.histogram()


@pytest.mark.parametrize("case", [0, 6, 9, 12, 15])
def test_requested_subproblems_find_the_same_set(spark, case):
    depth, k, style, options, model_options = CASES[case]
    df, names, rows, labels = table(spark, 11 + case, 90, 5, kind="parity" if case % 2 else "mixed")
    expected = SmallModel(rows, labels, lam=0.03, depth=depth, mult=0.12, k=k, style=style, **model_options)
    chosen = {"lambda_reg": 0.03, "depth_budget": depth, "rashomon_mult": 0.12, "lookahead_k": k, "oracle_style": style} | options
    got = fit(df, names, "y", search="lazy", **chosen)
    assert got.bound().first() == (expected.reference, expected.bound)
    assert [(r["obj"], int(r["cnt"])) for r in got.root_histogram().collect()] == expected.histogram()
    stored = {r["size"]: r["subproblems"] for r in got.subproblems().collect()}
    everything = {s: math.comb(5, s) << s for s in stored}
    assert stored[0] == 1 and all(stored[s] <= everything[s] for s in stored)
    assert k < 0 or sum(stored.values()) < sum(everything.values())  # leaves alone bound nothing here


def test_wide_tables_are_searched_on_request():
    assert not Options(depth_budget=5).lazy(20) and Options(depth_budget=5).lazy(50)
    assert Options(depth_budget=2, search="lazy").lazy(3) and not Options(depth_budget=5, search="eager").lazy(50)
    with pytest.raises(ValueError):
        Options(search="both")


def test_rank_order_and_paths(spark):
    df, names, rows, labels = table(spark, 5, 120, 5)
    expected = SmallModel(rows, labels, lam=0.03, depth=4, mult=0.2)
    got = fit(df, names, "y", lambda_reg=0.03, depth_budget=4, rashomon_mult=0.2)
    assert len(expected.trees) > 50
    paths = {}
    for r in got.tree_paths().orderBy("tree_id", "leaf_no").collect():
        paths.setdefault(r["tree_id"], []).append((list(r["path"]), r["prediction"]))
    assert [paths[i] for i in range(len(expected.trees))] == [SmallModel.paths(t) for _, t in expected.trees]


def test_root_estimate_at_other_depths(spark):
    df, names, rows, labels = table(spark, 8, 90, 5)
    for k, style in ((1, 0), (2, 1), (0, 1)):
        model = SmallModel(rows, labels, lam=0.03, depth=2, k=k, style=style)
        got = fit(df, names, "y", lambda_reg=0.03, depth_budget=2, lookahead_k=k, oracle_style=style)
        for depth in (1, 3, 4):
            everything = frozenset(range(len(rows)))
            assert got.root_lookahead(depth).first()["obj"] == model.look(everything, depth, 1)


def test_multipass_finds_more_than_singlepass(spark):
    """A table on which side budgets rise above what the estimates alone give."""
    rng = np.random.default_rng(19)
    x = rng.integers(0, 2, (60, 5))
    y = (x[:, :3].sum(axis=1) % 2) ^ (rng.random(60) < 0.15)
    rows, labels = [[int(v) for v in r] for r in x], [int(v) for v in y]
    names = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame([(*r, t) for r, t in zip(rows, labels)], [*names, "y"])
    sizes = []
    for use in (True, False):
        model = SmallModel(rows, labels, lam=0.02, depth=5, mult=0.02, multipass=use)
        got = fit(df, names, "y", lambda_reg=0.02, depth_budget=5, rashomon_mult=0.02, use_multipass=use)
        assert [(r["obj"], int(r["cnt"])) for r in got.root_histogram().collect()] == model.histogram()
        sizes.append(len(model.trees))
    assert sizes[0] > sizes[1]
