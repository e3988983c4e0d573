"""Votes near a tie, sets beyond 2^63 trees, awkward column names, listed trees."""

import itertools

import pytest

from grovelight import fit
from grovelight.functions.columns import gain_rank
from grovelight.operators import trees
from grovelight.plans import storage
from grovelight.plans.importance import subtractive_reliance


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, a, b, c, int(a if i % 5 else 1 - b)) for i, (a, b, c) in enumerate(itertools.product((0, 1), repeat=3))]
    rows += [(i + 8, a, b, c, y) for i, a, b, c, y in rows if i % 3]
    return spark.createDataFrame(rows, "rid long, a int, b int, c int, y int")


@pytest.fixture(scope="module")
def model(table):
    return fit(table, ["a", "b", "c"], "y", lambda_reg=0.02, depth_budget=2, rashomon_mult=0.6)


@pytest.mark.parametrize(("ones", "total", "winner"), [(4_999_999, 10_000_000, 0), (5_000_000, 10_000_000, 1), (10**30 - 1, 2 * 10**30, 0)])
def test_votes_are_compared_as_whole_numbers(spark, table, model, monkeypatch, ones, total, winner):
    usage = spark.sql(f"SELECT cast(array() AS array<int>) itemset, 1 prediction, cast({ones} AS decimal(38,0)) cnt UNION ALL SELECT cast(array() AS array<int>), 0, cast({total - ones} AS decimal(38,0))")
    monkeypatch.setattr(model, "leaf_usage", lambda max_obj=None: usage)
    votes = model.majority_vote(table, "rid").collect()
    assert len(votes) == table.count() and {v["prediction"] for v in votes} == {winner}
    assert all(abs(v["share"] - ones / total) < 1e-15 for v in votes)


def test_ranks_beyond_bigint(spark):
    ranges = spark.sql("""SELECT * FROM VALUES (9L, 1L, cast(3 AS decimal(38,0)), cast(0 AS decimal(38,0))),
        (9L, 2L, cast(1e30 AS decimal(38,0)), cast(3 AS decimal(38,0))), (9L, 3L, cast(5 AS decimal(38,0)), cast(1e30 AS decimal(38,0)) + 3) AS t(budget, obj, cnt, first)""")
    take = lambda **k: [(r["tree_id"], r["obj"], int(r["k"])) for r in trees.ranks(ranges, **k).orderBy("tree_id").collect()]
    assert take(start=1, stop=5) == [(1, 1, 1), (2, 1, 2), (3, 2, 0), (4, 2, 1)]
    assert take(start=0, max_obj=1) == [(0, 1, 0), (1, 1, 1), (2, 1, 2)]
    assert take(ids=[2, 2**62, 4, -1]) == [(2, 1, 2), (4, 2, 1), (2**62, 2, 2**62 - 3)]


@pytest.mark.parametrize("name", ["part", "obj", "prediction", "row id", "y", "tree_id", "share", "it`em'set"])
def test_any_row_id_name(table, model, name):
    other = table.drop("y").withColumnRenamed("rid", name)
    plain = {(r["tree_id"], r["rid"], r["prediction"]) for r in model.predict_all(table, "rid").collect()}
    out = model.predict_all(other, name)
    assert {(r[out.columns.index("tree_id") if name != "tree_id" else 0], r[2], r[3]) for r in out.collect()} == plain
    votes = {tuple(r) for r in model.majority_vote(other, name).collect()}
    assert votes == {tuple(r) for r in model.majority_vote(table, "rid").collect()}


def test_row_order_does_not_depend_on_the_id_name(spark, table):
    run = lambda df, rid: sorted(map(tuple, subtractive_reliance(df, ["a", "b", "c"], "y", rid, n_boot=1, lambda_reg=0.02, depth_budget=1, rashomon_mult=0.3).mean.drop("b").collect()))
    assert run(table, "rid") == run(table.withColumnRenamed("rid", "part").repartition(3), "part")


def test_awkward_feature_names(spark):
    df = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 1, 1)], ["it's", "a`b", "y"])
    found = fit(df, ["it's", "a`b"], "y", lambda_reg=0.01, depth_budget=1, rashomon_mult=0.0)
    assert [r["prediction"] for r in found.predict(df, 0, "pre`d").selectExpr("`pre``d` AS prediction").collect()] == [0, 1, 1]


def test_null_in_any_feature_raises(spark, table, model):
    df = spark.createDataFrame([(0, 0, None)], "a int, b int, c int")
    with pytest.raises(Exception, match="NULL in column c"):
        model.predict(df, 0).collect()


def test_gains_are_ranked_strictly(spark):
    best = spark.sql(f"SELECT min_by(f, {gain_rank('g', 'f')}) f FROM VALUES (0, 0.5D), (1, 0.5000000000000002D), (2, 0.5000000000000002D) AS t(f, g)").first()["f"]
    assert best == 1


def test_local_checkpoint_folder_is_refused_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: "file:///tmp/x")

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(ValueError, match="share"):
        storage.work_dir(Session)


def test_listed_trees(model):
    key = lambda rows: sorted(map(str, rows))
    wanted = [0, 3, 1]
    assert key(model.tree_paths(ids=wanted).collect()) == key(model.tree_paths().where("tree_id IN (0, 1, 3)").collect())
    assert key(model.tree_nodes(ids=wanted).collect()) == key(model.tree_nodes().where("tree_id IN (0, 1, 3)").collect())
    assert key(model.tree_objectives(ids=wanted).collect()) == key(model.tree_objectives().where("tree_id IN (0, 1, 3)").collect())
    assert model.tree_paths(ids=[]).isEmpty()


def test_listed_predictions_and_no_exchange_of_rows_times_trees(spark, table, model):
    out = model.predict_all(table, "rid", ids=[2, 0])
    assert {r["tree_id"] for r in out.collect()} == {0, 2} and out.count() == 2 * table.count()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = model.predict_all(table, "rid")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Join") == 1  # rows meet the finished votes of their pattern, nothing after that
