"""Trees grown over blocks of binned rows."""

import numpy as np
import pytest
from pyspark import RDD, SparkContext
from pyspark.sql import functions as F

from shelfcast.operators import growing as gr
from shelfcast.operators import learners as ln
from shelfcast.sources.storage import stage


def _rows(spark, n=3000):
    value = "10 * sin(id % 89 / 9) + id % 7 + (pmod(xxhash64(id), 1000) / 400)"
    rows = spark.range(n).selectExpr("double(id % 89) a", "int(id % 7) b", "if(id % 11 = 0, null, double(pmod(xxhash64(id, 1), 500))) c", f"double({value}) sales")
    return stage(rows, "rows")


def _jobs(spark, work):
    group = f"jobs-{np.random.default_rng().integers(1 << 40)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def _blocks(rows, start=0.0):
    names = ["a", "b", "c"]
    cuts = gr.all_cut_points(rows, names, rows.count(), 1)
    return gr.to_blocks(rows, names, "sales", cuts, start).persist(), cuts


def _whole(blocks):
    parts = sorted(blocks.collect(), key=lambda b: b.id)
    return np.concatenate([b.bins for b in parts], 1), np.concatenate([b.label for b in parts])


def test_cut_points():
    assert gr.cut_points(np.array([0.0] * 999 + [1.0, np.nan])).tolist() == [0.5]
    assert gr.cut_points(np.array([3.0, 3.0])).tolist() == [] and gr.cut_points(np.array([])).tolist() == []
    cuts = gr.cut_points(np.arange(3200.0))
    assert len(cuts) == 31 and np.bincount(gr.binned([np.arange(3200.0)], [cuts])[0]).tolist() == pytest.approx([100] * 32, abs=1)
    assert gr.binned([np.array([-np.inf, np.inf, np.nan])], [cuts]).tolist() == [[0, 31, 31]]
    assert [gr.features_per_node(s, 36) for s in ("sqrt", "0.8", "1.0", "all", "5")] == [6, 29, 36, 36, 5]


def test_a_split_is_the_best_of_all(spark):
    blocks, _ = _blocks(_rows(spark, 500))
    bins, label = _whole(blocks)
    tree = gr.finish(bins, label, np.ones(len(label)), 1, 3, 5, [1])
    errors = {}
    for f in range(3):
        for c in range(31):
            low = bins[f] <= c
            if min(low.sum(), (~low).sum()) >= 5:
                errors[f, c] = sum(((label[s] - label[s].mean()) ** 2).sum() for s in (low, ~low))
    assert errors[int(tree.feature[0]), int(tree.cut[0])] == pytest.approx(min(errors.values()))
    whole = ((label - label.mean()) ** 2).sum()
    assert tree.gains.sum() == pytest.approx(whole - min(errors.values()))


def test_levels_groups_and_tops_give_the_same_tree(spark):
    blocks, _ = _blocks(_rows(spark))
    bins, label = _whole(blocks)
    growth = gr.Growth(6, 5, 3, 7, 1.0, False, 3)
    by_levels = growth.by_levels(blocks, 0)
    in_one, (a, b) = growth.by_groups(blocks, 3000, [0], 0.0)[0], gr.Growth(6, 5, 3, 7, 1.0, False, 3, group_rows=400).by_groups(blocks, 3000, [0, 1], 2.0)
    for tree, shift in ((by_levels, 0), (in_one, 0), (a, 2), (b, 2)):
        leaf = tree.leaf_of(bins)
        assert (tree.left[leaf] == leaf).all() and np.bincount(leaf)[np.unique(leaf)].min() >= 5
        means = np.bincount(leaf, label) / np.maximum(np.bincount(leaf), 1)
        assert tree.forecast(bins) == pytest.approx(means[leaf] + shift)
        assert tree.forecast(bins) == pytest.approx(by_levels.forecast(bins) + shift)
        assert tree.gains == pytest.approx(by_levels.gains)
    drawn = gr.Growth(8, 5, 2, 7, 1.0, True, 3, group_rows=300).by_groups(blocks, 3000, list(range(3)), 0.0)
    assert len({t.forecast(bins).tobytes() for t in drawn}) == 3


def test_a_forest_takes_few_jobs_however_deep_it_is(spark):
    rows = _rows(spark)
    forest = ln.RandomForest(trees=40, depth=15)
    assert _jobs(spark, lambda: forest.train(rows, rows, ["a", "b", "c"])) < 40


def test_the_trees_of_a_forest_stay_with_the_tasks(spark, monkeypatch, tmp_path):
    rows, names, collected, tasks = _rows(spark), ["a", "b", "c"], [], []
    collect, union = RDD.collect, SparkContext.union

    def collecting(self):
        found = collect(self)
        collected.extend(x for x in found if isinstance(x, tuple) and any(isinstance(y, gr.Tree) for y in x))
        return found

    def uniting(self, rdds):
        tasks.append(len(rdds))
        return union(self, rdds)

    monkeypatch.setattr(RDD, "collect", collecting)
    monkeypatch.setattr(SparkContext, "union", uniting)
    model = ln.RandomForest(trees=150, depth=4).train(rows, rows, names)
    model.save(f"{tmp_path}/model")
    scored = model.predict(rows).orderBy("a", "b", "c", "sales").toPandas()
    # no tree comes to the driver, and few tasks read all blocks
    assert collected == [] and tasks == [4 * spark.sparkContext.defaultParallelism]
    monkeypatch.undo()
    again = ln.TrainedForecaster.load(f"{tmp_path}/model")
    assert again.predict(rows).orderBy("a", "b", "c", "sales").toPandas().equals(scored)
    assert again.importance().collect() == model.importance().collect()
    cuts = gr.all_cut_points(rows, names, 3000, 42)
    mean = rows.agg(F.avg("sales")).first()[0]
    growth = gr.Growth(4, 5, gr.features_per_node("sqrt", 3), 42, 1.0, True, 3)
    blocks = gr.to_blocks(rows, names, "sales", cuts, mean).persist()
    bins = _whole(blocks)[0]
    for one, other in zip(growth.by_groups(blocks, 3000, [0, 77], mean), [g[1] for g in sorted(growth.whole(blocks, [0, 77], mean).collect())], strict=True):
        assert one.forecast(bins).tobytes() == other.forecast(bins).tobytes() and one.gains.tobytes() == other.gains.tobytes()


def test_trees_shuffle_no_rows(spark):
    blocks, _ = _blocks(_rows(spark))
    blocks.count()
    tracker, group = spark.sparkContext.statusTracker(), f"stages-{np.random.default_rng().integers(1 << 40)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        assert len(gr.Growth(8, 5, 2, 7, 1.0, True, 3).by_groups(blocks, 3000, list(range(40)), 0.0)) == 40
        assert [len(tracker.getJobInfo(i).stageIds) for i in tracker.getJobIdsForGroup(group)] == [1, 1]
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_nodes_are_dealt_to_tasks_by_their_rows():
    growth = gr.Growth(8, 5, 2, 7, 1.0, True, 3, group_rows=100)
    tasks = growth._tasks([(0, 1, 1, 60), (0, 2, 1, 40), (1, 0, 0, 50), (2, 0, 0, 20), (2, 5, 3, 99)], 1)
    assert tasks == [{0: {1: 1, 2: 1}}, {1: {0: 0}, 2: {0: 0}}, {2: {5: 3}}]
    assert len(growth._tasks([(i, 0, 0, 5) for i in range(40)], 8)) == 8
    assert growth._tasks([(0, 0, 0, 900)], 8) == [{0: {0: 0}}]


def test_slices_do_not_change_a_tree(spark, monkeypatch):
    blocks, _ = _blocks(_rows(spark))
    bins, label = _whole(blocks)
    weight = np.random.default_rng(3).integers(1, 4, len(label))
    trees = []
    for sizes in ((128, 1 << 14, 1 << 11), (3, 100, 50), (1000, 1 << 20, 1 << 20)):
        for name, size in zip(("_SLICE", "_SLICE_ROWS", "_LONE_ROWS"), sizes, strict=True):
            monkeypatch.setattr(gr, name, size)
        trees.append(gr.finish(bins, label, weight, 7, 2, 5, [4]))
    for tree in trees[1:]:
        assert tree.left.tolist() == trees[0].left.tolist() and tree.forecast(bins) == pytest.approx(trees[0].forecast(bins))
    leaf = trees[0].leaf_of(bins)
    means = np.bincount(leaf, weight * label) / np.maximum(np.bincount(leaf, weight), 1)
    assert trees[0].forecast(bins) == pytest.approx(means[leaf])


def test_a_boosted_tree_takes_a_pass_a_level(spark):
    rows = _rows(spark)
    boosted = ln.BoostedTrees(trees=12, depth=3, patience=50)
    assert _jobs(spark, lambda: boosted.train(rows, rows, ["a", "b", "c"])) <= 12 * 3 + 30


def test_missing_values_and_a_constant_target(spark):
    rows = _rows(spark, 300)
    for learner in (ln.RandomForest(trees=3, depth=3), ln.BoostedTrees(trees=3, depth=3, chunk=2)):
        flat = learner.train(rows.withColumn("sales", F.lit(4.0)), rows, ["a", "c"])
        assert flat.predict(rows).where("abs(prediction - 4) > 1e-9").count() == 0
        assert flat.importance().agg(F.sum("importance")).first()[0] == 0
        assert learner.train(rows, rows, ["c"]).predict(rows).where("prediction is null or isnan(prediction)").count() == 0
        with pytest.raises(ValueError, match="no training row"):
            learner.train(rows.where("a < 0"), rows, ["a"])
