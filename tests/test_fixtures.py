"""Known sets: hand-traced tables and the schemas the reference tests with."""

import itertools

import numpy as np
import pytest

from grovelight import fit


def histogram(model):
    return [(r["obj"], int(r["cnt"])) for r in model.root_histogram().collect()]


def frame(spark, rows, labels):
    names = [f"f{i}" for i in range(len(rows[0]))]
    return spark.createDataFrame([(*map(int, r), int(y)) for r, y in zip(rows, labels)], [*names, "y"]), names


@pytest.fixture(scope="module")
def parity5(spark):
    rows = list(itertools.product([0, 1], repeat=5))
    return frame(spark, rows, [1 - sum(r) % 2 for r in rows])


def test_three_rows_with_free_leaves(spark):
    df, names = frame(spark, [(0, 1), (1, 0), (1, 1)], [0, 1, 1])
    with pytest.warns(UserWarning, match="rounds to 0"):
        model = fit(df, names, "y", lambda_reg=0.01, depth_budget=2, rashomon_mult=0.0)
    assert histogram(model) == [(0, 3)]
    assert model.min_objective().first()["obj"] == 0


@pytest.mark.parametrize(
    "mult, expected", [(0.01, [(18, 2)]), (0.15, [(18, 2), (20, 20)]), (0.25, [(18, 2), (20, 20), (22, 320)])]
)
def test_parity_of_five(parity5, mult, expected):
    df, names = parity5
    model = fit(df, names, "y", lambda_reg=0.05, depth_budget=2, rashomon_mult=mult)
    assert histogram(model) == expected


def test_random_bits_with_parity_label(spark):
    rng = np.random.default_rng(123)
    x = rng.integers(0, 2, (1000, 15))
    df, names = frame(spark, x.tolist(), (x[:, :3].sum(axis=1) % 2).tolist())
    model = fit(df, names, "y", lambda_reg=0.01, depth_budget=3, rashomon_mult=0.5)
    found = histogram(model)
    assert found[0][0] == 80  # eight pure leaves, ten rows each
    total = int(model.count_trees().first()["cnt"])
    assert total == sum(c for _, c in found) and total >= 12
    objs = [r["obj"] for r in model.tree_objectives().orderBy("tree_id").collect()]
    assert objs == sorted(objs) and len(objs) == total
    # every tree's objective is its penalty plus its errors, counted on the rows
    leaves = {r["tree_id"]: r["leaves"] for r in model.all_leaves.groupBy("tree_id").count().withColumnRenamed("count", "leaves").collect()}
    for r in model.correct_counts(df).collect():
        assert objs[r["tree_id"]] == 10 * leaves[r["tree_id"]] + 1000 - r["correct"]


def check_example(spark, x, y, expected):
    """Depth 5, lambda 0.01, multiplier 0.05, lookahead 1, as the examples have it."""
    df, names = frame(spark, x.tolist(), y.tolist())
    model = fit(df, names, "y", lambda_reg=0.01, depth_budget=5, rashomon_mult=0.05)
    found = histogram(model)
    total = sum(c for _, c in found)
    assert found[0][0] == expected and [o for o, _ in found] == sorted({o for o, _ in found})
    assert int(model.count_trees().first()["cnt"]) == total
    penalty = round(0.01 * len(y))
    leaves = {r["tree_id"]: r["count"] for r in model.all_leaves.groupBy("tree_id").count().collect()}
    objs = [r["obj"] for r in model.tree_objectives().orderBy("tree_id").collect()]
    assert len(objs) == total
    for r in model.correct_counts(df).collect():
        assert objs[r["tree_id"]] == penalty * leaves[r["tree_id"]] + len(y) - r["correct"]


def test_example_of_ten_thousand_rows(spark):
    x = np.random.default_rng(0).integers(0, 2, (10_000, 10))
    check_example(spark, x, x[:, :3].sum(axis=1) % 2, 8 * 100)  # eight pure leaves


def test_example_with_noisy_twins(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (1000, 10))
    twins = x[:, :4] ^ (rng.random((1000, 4)) < 0.01)
    x = np.hstack([x, twins, (x[:, :1] == x[:, 1:2]).astype(int)])
    # parity of four through the XNOR of two: a pure tree needs at most sixteen leaves
    df, names = frame(spark, x.tolist(), (x[:, :4].sum(axis=1) % 2).tolist())
    model = fit(df, names, "y", lambda_reg=0.01, depth_budget=5, rashomon_mult=0.05)
    least = model.min_objective().first()["obj"]
    assert 0 < least <= 160
    assert {r["obj"] for r in model.tree_objectives().collect()} == {o for o, _ in histogram(model)}


def test_a_set_of_billions_is_counted(parity5):
    """With a budget that every tree keeps to, the number of trees has a closed form."""
    df, names = parity5
    trees = 2
    for features in range(2, 6):  # depth 1 of two features left, ..., depth 4 of five
        trees = 2 + features * trees**2
    model = fit(df, names, "y", lambda_reg=0.05, depth_budget=4, root_budget=200)
    assert trees > 10**11 and int(model.count_trees().first()["cnt"]) == trees
    first = model.tree_objectives(0, 3).orderBy("tree_id").collect()
    assert [r["tree_id"] for r in first] == [0, 1, 2]
    last = model.tree_objectives(ids=[trees - 1, trees]).collect()
    assert [r["tree_id"] for r in last] == [trees - 1]
    assert last[0]["obj"] == max(o for o, _ in histogram(model))


def test_empty_set_and_bad_ranks(parity5):
    df, names = parity5
    model = fit(df, names, "y", lambda_reg=0.05, depth_budget=2, root_budget=3)
    assert histogram(model) == []
    assert int(model.count_trees().first()["cnt"]) == 0
    assert model.min_objective().first()["obj"] is None
    with pytest.raises(IndexError):
        model.tree_objective(0)
    with pytest.raises(IndexError):
        model.predict(df, 0)
    with pytest.raises(IndexError):
        model.predict(df, -1)


def test_depth_zero_is_a_leaf(parity5):
    df, names = parity5
    model = fit(df, names, "y", lambda_reg=0.05, depth_budget=0, rashomon_mult=0.0)
    assert histogram(model) == [(18, 2)]


def test_answers_do_not_depend_on_partitioning(spark, parity5):
    df, names = parity5
    seen = set()
    for parts in (1, 7):
        model = fit(df.repartition(parts), names, "y", lambda_reg=0.05, depth_budget=2, rashomon_mult=0.15)
        rows = model.tree_paths().orderBy("tree_id", "leaf_no").collect()
        seen.add(tuple((r["tree_id"], r["path_text"], r["prediction"]) for r in rows))
    assert len(seen) == 1
    assert {"[]", "[+0]", "[-0]", "[-4]"} <= {p for _, p, _ in next(iter(seen))}


def test_stacked_and_long_predictions_agree(spark, parity5):
    df, names = parity5
    rows = df.selectExpr("f0 + 2 * f1 + 4 * f2 + 8 * f3 + 16 * f4 AS id", *names)
    model = fit(df, names, "y", lambda_reg=0.05, depth_budget=2, rashomon_mult=0.15)
    long = {(r["tree_id"], r["id"]): r["prediction"] for r in model.predict_all(rows, "id").collect()}
    stacked = {}
    for r in model.predict_all(rows, "id", stack=True, block_rows=10).collect():
        assert len(r["row_ids"]) == len(r["predictions"])
        stacked.update({(r["tree_id"], i): p for i, p in zip(r["row_ids"], r["predictions"])})
    assert long == stacked and len(long) == 22 * 32
    one = model.predict(rows, 7).collect()
    assert {r["id"]: r["prediction"] for r in one} == {i: p for (t, i), p in long.items() if t == 7}
    share = {r["id"]: r["share"] for r in model.majority_vote(rows, "id").collect()}
    for i in range(32):
        votes = [p for (_, row), p in long.items() if row == i]
        assert share[i] == pytest.approx(sum(votes) / len(votes))
