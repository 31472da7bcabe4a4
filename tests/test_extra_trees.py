import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import extra_trees as E
from earshot.operators.models import SpoofModel
from earshot.session import scratch


def make(rng, n, width=9):
    x = rng.normal(size=(n, width)).round(2)
    x[:, 1] = 3.0  # a constant feature
    y = ((x[:, 0] + 0.5 * x[:, 2] > 0.3) ^ (rng.random(n) < 0.1)).astype(int)
    return x, y


def grow(x, y, settings, weights, tree):
    """The same tree by recursion over plain arrays: {node: (feature, cut, left)} and class counts, numbered level by level."""
    out, counts, level, last = {}, {0: (int((y == 0).sum()), int((y == 1).sum()))}, [(0, np.arange(len(y)))], 0
    for _ in range(settings.depth):
        following = []
        for node, rows in level:
            best = None
            for f in E.candidates(settings.seed, np.array([tree]), np.array([node]), x.shape[1], settings._count(x.shape[1]))[0]:
                v = x[rows, f]
                if v.min() == v.max():
                    continue
                cut = v.min() + E.draw(settings.seed, np.array([tree]), np.array([node]), np.array([f]), 1)[0] * (v.max() - v.min())
                left = rows[v <= cut]
                if min(len(left), len(rows) - len(left)) < settings.leaf:
                    continue
                c = [np.array([float((y[left] == k).sum())]) for k in (0, 1)]
                g = E.gain(*c, *[np.array([float(n)]) for n in counts[node]], weights)[0]
                if best is None or g > best[0]:
                    best = (g, f, cut, left)
            if best is None or best[0] <= 0:
                continue
            _, f, cut, left = best
            right = np.setdiff1d(rows, left)
            out[node] = (f, cut, last + 1)
            for side in (left, right):
                last += 1
                counts[last] = (int((y[side] == 0).sum()), int((y[side] == 1).sum()))
                if min(counts[last]) and len(side) >= 2 * settings.leaf:
                    following.append((last, side))
        level = following
    return out, counts


@pytest.mark.parametrize("leaf", [1, 4])
def test_trees_equal_plain_recursion(spark, monkeypatch, leaf):
    rng = np.random.default_rng(leaf)
    x, y = make(rng, 300)
    order = rng.permutation(300)
    data = spark.createDataFrame([(int(y[k]), x[k].tolist()) for k in order], "label int, features array<double>").repartition(5)
    settings = E.ExtraTrees(trees=5, depth=6, leaf=leaf, subset=3, seed=7)
    monkeypatch.setattr(E, "CELLS", 40)  # several batches of trees
    model = settings.fit(data)
    n = np.bincount(y)
    weights = (300 / (2 * n[0]), 300 / (2 * n[1]))
    for tree in range(5):
        splits, counts = grow(x, y, settings, weights, tree)
        nodes = model.nodes[model.nodes["tree"] == tree]
        assert len(nodes) == len(counts)
        for r in nodes:
            c0, c1 = counts[r["node"]]
            assert r["share"] == pytest.approx(c1 * weights[1] / (c0 * weights[0] + c1 * weights[1]))
            if r["node"] in splits:
                f, cut, left = splits[r["node"]]
                assert (r["feature"], r["left"]) == (f, left) and r["cut"] == pytest.approx(cut)
            else:
                assert r["feature"] == -1
    again = settings.fit(data.coalesce(1).orderBy(F.rand(3)))
    assert (again.nodes == model.nodes).all()


def test_scores_separate_and_survive_saving(spark):
    rng = np.random.default_rng(5)
    x, y = make(rng, 1200)
    rows = spark.createDataFrame([(k, int(y[k]), x[k].tolist()) for k in range(1200)], "audio_id int, label int, f array<double>")
    model = SpoofModel.fit(rows.filter("audio_id < 800"), "soft_voting", [f"x{k}" for k in range(9)], trees=15, depth=8)
    held = rows.filter("audio_id >= 800")
    got = {r.audio_id: r.model_prob for r in model.score(held).collect()}
    p = np.array([got[k] for k in range(800, 1200)])
    assert p.min() >= 0 and p.max() <= 1
    assert p[y[800:] == 1].mean() > p[y[800:] == 0].mean() + 0.3
    path = scratch(spark, "voters")
    model.save(spark, path)
    again = {r.audio_id: r.model_prob for r in SpoofModel.load(spark, path).score(held).collect()}
    assert again == got


def test_odd_tables(spark):
    kind = "label int, features array<double>"
    settings = E.ExtraTrees(trees=2, depth=3)
    for rows, share in (([], 0.0), ([(1, [1.0, None])] * 3, 1.0), ([(0, [1.0, 2.0])], 0.0), ([(0, [1.0, 1.0]), (1, [1.0, 1.0]), (None, [5.0, 5.0])], 0.5)):
        model = settings.fit(spark.createDataFrame(rows, kind))
        assert len(model.nodes) == 2 and set(model.nodes["share"].tolist()) == {share}
        assert all(r.p == share for r in spark.createDataFrame([(0, [0.0, None])], kind).select(model.probability(F.col("features")).alias("p")).collect())
