from __future__ import annotations

import numpy as np
import pytest
from conftest import hours
from pyspark.sql import functions as F

from zonetide.learning import models as ML
from zonetide.learning import neighbours as NN
from zonetide.learning import sampling as SA
from zonetide.learning import splits as SP


def _points(spark, n=240, seed=2):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1, (n // 2, 3)), rng.normal(3, 0.01, (n - n // 2, 3))])  # half in one tight spot
    rows = [(i, int(i % 5 == 0), *map(float, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, y int, a double, b double, c double"), x


def _brute(x, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return [row.argsort(kind="stable")[:k].tolist() for row in d]


@pytest.mark.parametrize("centres,block", [(2048, 4096), (5, 16), (1, 7)])
def test_neighbours_by_brute_force(spark, centres, block):
    df, x = _points(spark)
    got = {}
    for r in NN.nearest_neighbours(df, "id", ["a", "b", "c"], 4, centres, block).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["neighbour"]
    assert [[got[i][p] for p in (1, 2, 3, 4)] for i in range(len(x))] == _brute(x, 4)


def test_neighbours_in_many_dimensions_with_outlier_and_rows_at_one_spot(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (60, 32)), np.tile(rng.normal(0, 1, 32), (50, 1)), [[1e6] * 32], rng.normal(5, 1e-3, (60, 32))])
    names = [f"x{i}" for i in range(32)]
    bad = [(900, *[None] * 32), (901, *[float("nan")] * 32)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + bad, "id long, " + ", ".join(f"{n} double" for n in names))
    got = {}
    for r in NN.nearest_neighbours(df, "id", names, 3, block=16).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["neighbour"]
    want = _brute(x, 3)
    assert {i: [v[p] for p in (1, 2, 3)] for i, v in got.items()} == dict(enumerate(want))


def test_blocks_of_a_dense_cluster_are_bounded(spark, monkeypatch):
    """Nine rows in ten at nearly one spot, and one far away: no call sees more than a block of either side by much."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1e-6, (900, 4)), rng.normal(3, 2, (99, 4)), [[1e5] * 4]])
    spots = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    balls = NN.Balls(x[:30])
    assert sum(np.bincount(balls.distances(x).argmin(1), minlength=30) > 500) == 0
    got = {r["id"]: r["neighbour"] for r in NN.neighbours_of_spots(spots, "id", 1, block=64).collect()}
    assert got == {i: n[0] for i, n in enumerate(_brute(x, 1))}
    assert NN.neighbours_of_spots(spots.limit(0), "id", 1).count() == 0 and NN.neighbours_of_spots(spots.filter("id < 1"), "id", 1).count() == 0
    assert NN.neighbours_of_spots(spots.filter("id < 3"), "id", 5).count() == 6


def test_bunches_hold_every_member_once(spark):
    """More members than one bunch holds: none is compared twice, nor listed twice among a row's neighbours."""
    unit = np.repeat(np.arange(30), 50)
    assert sorted(np.concatenate([*NN._bunches(unit)]).tolist()) == list(range(1500))
    assert sorted(np.concatenate([*NN._bunches(np.zeros(9000, int))]).tolist()) == list(range(9000))
    x = np.random.default_rng(4).normal(0, 1, (1500, 8))
    spots = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in NN.neighbours_of_spots(spots, "id", 4, block=64).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["neighbour"]
    assert [[got[i][p] for p in (1, 2, 3, 4)] for i in range(len(x))] == _brute(x, 4)


def test_a_row_is_sent_to_each_block_once(monkeypatch):
    """In many dimensions all shells are within reach: a row goes to the few blocks they are in, not to each of 40 shells."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (800, 64))
    ball = NN.Balls(x[:40]).distances(x).argmin(1)
    gap = np.sqrt(((x - x[ball]) ** 2).sum(1))
    n = np.bincount(ball, minlength=40)
    shells = [(i * NN.SHELLS, i, gap[ball == i].min(), gap[ball == i].max(), int(n[i]), int(n[:i].sum())) for i in range(40)]
    balls = NN.Balls(x[:40], shells, 50, 100)
    bound = np.full(len(x), np.inf)
    sent = [(int(r), block) for block, rows, _ in balls.reached(x, bound, 3) for r in rows]
    assert balls.reaches(x, np.full(len(x), 20.0)).sum() == 800 * 40
    assert len(sent) == len(set(sent)) <= 800 * 8 and {b for _, b in sent} == set(balls.blocks.tolist()) <= set(range(8))


def test_smote_balances_and_stays_between(spark):
    df, x = _points(spark)
    out = SA.smote(df, "y", "id", ["a", "b", "c"], k=3)
    made = out.filter("synthetic")
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert abs(counts[1] - counts[0]) < 0.2 * counts[0] and made.filter("y = 0").count() == 0
    mine = x[::5]
    low, high = mine.min(0), mine.max(0)
    for r in made.collect():
        v = np.array([r["a"], r["b"], r["c"]])
        assert (v >= low - 1e-9).all() and (v <= high + 1e-9).all()
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, SA.smote(df, "y", "id", ["a", "b", "c"], k=3).filter("synthetic").collect()))


def test_tomek_links(spark):
    rows = [(1, 0, 0.0), (2, 1, 0.1), (3, 0, 5.0), (4, 0, 5.1), (5, 1, 9.0), (6, 1, 9.0), (7, 0, 9.05)]
    df = spark.createDataFrame(rows, "id long, y int, a double")
    assert {(r["id"], r["neighbour"]) for r in SA.tomek_links(df, "y", "id", ["a"]).collect()} == {(1, 2), (2, 1)}
    assert SA.without_tomek_links(df, "y", "id", ["a"]).count() == 5


@pytest.mark.parametrize("block", [4096, 16])
def test_tomek_links_by_brute_force(spark, monkeypatch, block):
    """Three classes, rows without one, rows at one spot and rows of one kin: the pairs are those of all rows compared with all."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (700, 6))
    x[500:] = x[rng.integers(0, 500, 200)] + rng.normal(0, 0.05, (200, 6))
    y = rng.choice([0, 0, 0, 1, 2, None], 700)
    x[10], y[10], x[12], y[12] = x[11], y[11], x[13], 1
    df = spark.createDataFrame([(i, c, i % 90 if c else None, *map(float, v)) for i, (c, v) in enumerate(zip(y, x))],
                               "id long, y int, kin long, " + ", ".join(f"x{i} double" for i in range(6)))
    near = [n[0] for n in _brute(x, 1)]
    want = {(i, j) for i, j in enumerate(near) if near[j] == i and None not in (y[i], y[j]) and y[i] != y[j] and {10, 11}.isdisjoint((i, j))}
    monkeypatch.setattr(SA, "opposite_neighbours", lambda spots, key: NN.opposite_neighbours(spots, key, block=block))
    for kin in (None, "kin"):
        assert len(want) > 50 and {tuple(r) for r in SA.tomek_links(df, "y", "id", [f"x{i}" for i in range(6)], kin).collect()} == want


def test_small_bounds_leave_out_balls_behind_a_plane():
    """In 64 dimensions many balls are within reach of a small bound by their radius, few by the planes between centres, and none wrongly."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.125, (3000, 64))
    ball = NN.Balls(x[:50]).distances(x).argmin(1)
    gap = np.sqrt(((x - x[ball]) ** 2).sum(1))
    shells = [(i * NN.SHELLS, i, 0.0, gap[ball == i].max(), int((ball == i).sum()), int((ball < i).sum())) for i in range(50)]
    balls = NN.Balls(x[:50], shells)
    near = x[:600] + rng.normal(0, 0.01, (600, 64))
    home, bound = balls.distances(near).argmin(1), np.full(600, 0.15)
    kept = balls.crosses(near, home, bound, np.arange(50))
    assert balls.reaches(near, bound).mean() > 0.6 and kept.mean() < 0.4
    row, col = np.nonzero(((near[:, None] - x[None]) ** 2).sum(2) <= 0.15 ** 2)
    assert len(row) >= 600 and kept[row, ball[col]].all()


def test_smote_tomek_leaves_no_pair(spark):
    df, _ = _points(spark)
    names = ["a", "b", "c"]
    both = SA.smote_tomek(df, "y", "id", names, k=3)
    plain = SA.smote(df, "y", "id", names, k=3)
    gone = plain.select("id", "copy").exceptAll(both.select("id", "copy"))
    row = F.concat_ws("#", "id", "copy").alias("row")
    links = SA.tomek_links(plain.withColumn("row", row), "y", "row", names)
    assert gone.count() == links.count() > 0 and both.columns == plain.columns
    assert {r["row"] for r in gone.select(row).collect()} == {r["row"] for r in links.collect()}


def test_smote_beside_a_row_without_a_spot(spark):
    """A positive without coordinates makes no rows and does not keep the others from making theirs."""
    df, x = _points(spark, 120)
    names = ["a", "b", "c"]
    bad = spark.createDataFrame([(900, 1, None, None, None)], df.schema)
    made = SA.smote(df.unionByName(bad), "y", "id", names, k=3).filter("synthetic")
    assert made.select("id").distinct().count() > 12 and made.filter("id >= 900").count() == 0


def test_splits(spark):
    df = hours(spark, {1: list(range(10)), 2: list(range(5))})
    pos = SP.positional_split(df)
    assert pos.filter("is_train").count() == 12 and pos.filter("zone_id = 1 and not is_train").count() == 0
    by_time = SP.time_split(df)
    assert by_time.filter("is_train").agg(F.max("timestamp")).first()[0] < by_time.filter("not is_train").agg(F.min("timestamp")).first()[0]
    lab = spark.range(1000).select("id", (F.col("id") % 8 == 0).cast("int").alias("y"))
    parts = {(r["y"], r["is_train"]): r["count"] for r in SP.stratified_split(lab, "y", ["id"]).groupBy("y", "is_train").count().collect()}
    assert parts[(1, False)] == 25 and parts[(0, False)] == 175
    folds = [r["count"] for r in SP.stratified_folds(lab, "y", ["id"]).groupBy("y", "fold").count().collect()]
    assert sorted(set(folds)) == [25, 175]
    assert SP.stratified_folds(lab, "y", ["id"]).exceptAll(SP.stratified_folds(lab, "y", ["id"])).count() == 0


def test_sampling_balances(spark):
    lab = spark.range(2000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    over = {r["y"]: r["count"] for r in SA.oversample(lab, "y", ["id"]).groupBy("y").count().collect()}
    assert over[0] == 1800 and abs(over[1] - 1800) < 60
    under = {r["y"]: r["count"] for r in SA.undersample(lab, "y", ["id"]).groupBy("y").count().collect()}
    assert under[1] == 200 and abs(under[0] - 200) < 50
    w = SA.balanced_weights(lab, "y").groupBy("y").agg(F.sum("weight").alias("w")).collect()
    assert {round(r["w"], 6) for r in w} == {1000.0}


def test_models_learn_and_calibrate(spark, tmp_path):
    df = spark.range(600).select("id", (F.pmod(F.col("id") * 37, 101) / 101.0).alias("a"), (F.pmod(F.col("id") * 53, 97) / 97.0).alias("b"))
    df = df.withColumn("y", (F.col("a") + 0.1 * F.col("b") > 0.6).cast("int")).withColumn("is_train", F.col("id") % 4 != 0)
    model, held = ML.train(df, ["a", "b"], "y", estimator=ML.gradient_boosting(trees=5, depth=3))
    assert held.agg(F.min("p"), F.max("p")).first()[0] >= 0
    from zonetide.operators.metrics import evaluate

    assert evaluate(held, "label").first()["roc_auc"] > 0.95
    imp = ML.importance(model, ["a", "b"], spark).collect()
    assert imp[0]["feature"] == "a" and abs(sum(r["importance"] for r in imp) - 1) < 1e-6
    _, cal = ML.isotonic(held.withColumn("y", F.col("label")), "y", "p")
    rows = cal.orderBy("p").select("calibrated").collect()
    assert all(a[0] <= b[0] + 1e-12 for a, b in zip(rows, rows[1:]))
    s = ML.stability(held, held).first()
    assert s["candidate_std"] == pytest.approx(s["active_std"]) and s["n_scored"] == s["n_rows"]
    ML.save(model, str(tmp_path / "m"))


def test_one_hot_unseen_is_zero(spark):
    a = spark.createDataFrame([("x",), ("y",)], "t string")
    b = spark.createDataFrame([("x",), ("new",)], "t string")
    from pyspark.ml.functions import vector_to_array

    out = ML.one_hot(["t"]).fit(a).transform(b).select("t", vector_to_array("t_onehot").alias("v")).collect()
    assert {r["t"]: list(r["v"]) for r in out} == {"x": [1.0, 0.0], "new": [0.0, 0.0]}


def test_search_rounds_stay_in_budget():
    for n, k, budget in ((9, 5, 60.0), (9, 5, 10.0), (1, 3, 2.0), (2, 5, 1e9)):
        rounds = ML.search_rounds(n, k, budget)
        assert rounds[0][0] == n and rounds[-1][0] == 1 and sum(c * s for c, s in rounds) * k <= budget + 1e-9
        assert all(a[1] < b[1] for a, b in zip(rounds, rounds[1:])) and rounds[-1][1] <= 1
    assert ML.search_rounds(9, 5, 1e9)[-1][1] == 1.0


def test_model_search_finds_what_full_cross_validation_finds(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 3))
    y = (np.sign(x[:, 0]) * np.sign(x[:, 1]) > 0).astype(int)  # no linear model can tell
    df = spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int")
    some = [c for c in ML.families(trees=5) if c[0] in ("tree", "linear")]
    board = ML.model_search(df, ["a", "b", "c"], "y", ["id"], k=3, budget=30.0, candidates=some).collect()
    assert len(board) == len(some) and board[0]["rounds"] == 3 and board[0]["share"] > board[-1]["share"]
    full = {}
    for family, setting, model in some:
        full[family, setting] = ML.cross_validated(df, ["a", "b", "c"], "y", ["id"], model, k=3).first()["mean_auc"]
    best = max(full, key=full.get)
    assert (board[0]["family"], board[0]["setting"]) == best == ("tree", "maxDepth=6")
    assert abs(board[0]["mean_auc"] - full[best]) < 0.05


def test_boosting_stops_when_the_validation_loss_does(spark):
    df = spark.range(800).select("id", (F.pmod(F.col("id") * 37, 101) / 101.0).alias("a")).withColumn("noise", F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0)
    df = df.withColumn("is_train", F.col("id") % 4 != 0)
    clear, blurred = df.withColumn("y", (F.col("a") > 0.5).cast("int")), df.withColumn("y", (F.col("noise") > 0.5).cast("int"))
    trees = {}
    for name, rows in (("clear", clear), ("blurred", blurred)):
        model, held = ML.train(rows, ["a"], "y", estimator=ML.gradient_boosting(trees=40, depth=2, validation=ML.VALIDATION))
        trees[name] = model.getNumTrees
        assert ML.VALIDATION not in held.columns and held.count() == 200
    assert trees["blurred"] < trees["clear"] <= 40


def test_models_of_rows_of_one_class(spark):
    """Without a positive, trees have one class only: scores are 0, errors are known and no AUC is defined."""
    df = spark.range(300).select(F.col("id"), (F.col("id") % 17).cast("double").alias("a"), F.lit(0).alias("y"), (F.col("id") % 4 != 0).alias("is_train"))
    _, held = ML.train(df, ["a"], "y", estimator=ML.decision_tree())
    from zonetide.operators.metrics import evaluate

    r = evaluate(held, "label").first()
    assert (r["n_test"], r["pred_mean"], r["mae"], r["tp"], r["f1"]) == (75, 0.0, 0.0, 0, 0.0) and r["roc_auc"] is None and r["average_precision"] is None
    assert [tuple(r) for r in ML.cross_validated(df, ["a"], "y", ["id"], k=3).collect()] == [("default", None, None)]
    some = [c for c in ML.families(trees=2) if c[1] in ("maxDepth=3", "regParam=0.1")]
    board = ML.model_search(df, ["a"], "y", ["id"], k=2, budget=30.0, candidates=some).collect()
    assert len(board) == len(some) == 3 and all(r["mean_auc"] is None for r in board)
    curve = ML.learning_curve(df, ["a"], "y", ["id"], fractions=(0.5, 1.0)).collect()
    assert [r["train_rows"] for r in curve][-1] == 225 and all(r["train_auc"] is None and r["test_auc"] is None for r in curve)


def test_folds_with_a_single_positive(spark):
    """The one positive is in one fold: the model of the others, which see none, is judged there as a constant one."""
    df = spark.range(60).select(F.col("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") == 30).cast("int").alias("y"))
    r = ML.cross_validated(df, ["a"], "y", ["id"], k=3).first()
    assert 0 <= r["mean_auc"] <= 1
