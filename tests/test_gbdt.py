"""Model text, limits and training."""

import numpy as np
import pytest

from waymark.config import TrainConfig
from waymark.errors import InvalidInput, IoError, ModelError
from waymark.gbdt import Branch, FeatureSchema, GbdtModel, Leaf
from waymark.gbdt.train import apart, fit, fit_pairs

HEAD = "VA_GBDT 1\nbase 0\nlr 0.1\ndim 28\nnaics\ntrees 1\n"


def test_round_trip(tmp_path):
    model = GbdtModel(FeatureSchema((4451, 7225)), 1e-7, 0.1, (Branch(3, 1e21, Leaf(-0.5), Leaf(2.0)), Leaf(0.0)))
    model.save(tmp_path / "m")
    assert GbdtModel.load(tmp_path / "m") == model
    assert "base 0.0000001\n" in model.to_text() and "e" not in model.to_text().split("trees")[1].split("\n", 1)[1]
    assert GbdtModel.from_text(HEAD.replace("\n", " \n", 2).replace("VA_GBDT 1 ", "VA_GBDT 1") + "\n L 1 \nmore\n").trees == (Leaf(1.0),)
    with pytest.raises(IoError):
        GbdtModel.load(tmp_path / "none")


@pytest.mark.parametrize("text", ["", HEAD, HEAD + "X 1", HEAD + "L 1 2", HEAD + "B 40 0 L 1 L 1", HEAD + "B 0 0 L 1", HEAD.replace("28", "99") + "L 1", HEAD.replace("GBDT 1", "GBDT 2") + "L 1", HEAD.replace("trees 1", "trees 257"), HEAD + "B 0 0 " * 33 + "L 1 " * 34, HEAD + " " * (8 * 1024 * 1024)])
def test_bad_models(text):
    with pytest.raises(ModelError):
        GbdtModel.from_text(text)


def test_training():
    schema, xs = FeatureSchema(()), np.zeros((4, 28))
    xs[:, 0] = [2, 1, -2, -1]
    model = fit(schema, xs, np.array([1, 1, -1, -1]))
    assert model.predict([2.0] + [0.0] * 27) > 0 > model.predict([-2.0] + [0.0] * 27)
    one = fit(schema, xs[:1], np.array([1.0]), TrainConfig(n_trees=1))
    assert one.trees == (Leaf(0.5),)
    for x, y, c in ((xs[:0], [], {}), (xs, [1], {}), (xs[:, :5], [1] * 4, {}), (xs, [1] * 4, {"n_trees": 0}), (xs, [1] * 4, {"n_trees": 257}), (xs, [1] * 4, {"max_depth": 33})):
        with pytest.raises(InvalidInput):
            fit(schema, np.array(x), np.array(y), TrainConfig(**c))
    with pytest.raises(InvalidInput):
        model.predict([1.0])


def test_training_query_uses_all_pairs(monkeypatch):
    """The registered query trains with the default parameters: stride 1, 32 trees."""
    from waymark.config import TrainConfig
    from waymark.plans import queries

    seen = []

    def train(found, truth, config=None):
        seen.append(config or TrainConfig())
        raise InterruptedError

    monkeypatch.setattr(queries, "_found", lambda spark, d: None)
    monkeypatch.setattr(queries, "_truth", lambda found: None)
    monkeypatch.setattr(queries.rank.GbdtRanker, "train", train)
    try:
        queries.gbdt_train_nodes(None, "")
    except InterruptedError:
        pass
    assert seen == [TrainConfig()] and seen[0].subsample_stride == 1


@pytest.mark.parametrize("stride", [1, 3])
def test_pairs_give_the_trees_of_the_matrix(stride):
    rng = np.random.default_rng(3 + stride)
    schema, n = FeatureSchema((4451, 5311, 7225)), 700
    numbers = [rng.normal(size=n), np.round(rng.normal(size=n), 1) + rng.choice((0, 1e-14), n), rng.integers(-3, 4, n) * 1.0, rng.integers(-1, 2, n) * 1.0]
    first, second, hour = rng.integers(0, 4, n), rng.integers(0, 4, n), rng.choice((9, 10, 23), n)
    ys = np.where(numbers[0] + (first == 1) * (hour == 10) - (second == 2) + rng.normal(size=n) > 0, 1.0, -1.0)
    xs = np.zeros((n, schema.dim))
    for f in range(4):
        xs[:, f] = numbers[f]
    np.add.at(xs, (np.arange(n), 4 + first * 24 + hour), 1)
    np.add.at(xs, (np.arange(n), 4 + second * 24 + hour), -1)
    config = TrainConfig(max_depth=5, subsample_stride=stride)
    model = fit(schema, xs, ys, config)
    assert any(isinstance(t, Branch) and t.feature < 4 for t in model.trees)
    assert fit_pairs(schema, list(numbers), first, second, hour, ys, config).to_text() == model.to_text()


def test_close_values_are_one():
    rng = np.random.default_rng(5)
    for _ in range(200):
        values = np.unique(rng.integers(0, 30, 40) * rng.choice((3e-13, 1e-12, 1.0)) + rng.choice((0, 4e-13), 40))
        want = [0]
        for i, v in enumerate(values):
            if v - values[want[-1]] >= 1e-12:
                want.append(i)
        assert apart(values).tolist() == want
    assert not len(apart(np.zeros(0)))


def test_training_takes_many_pairs():
    """A dense matrix of these would take 6 GB; the tool's driver has 1.5."""
    import resource

    n, schema = 1_000_000, FeatureSchema(tuple(range(1000, 1032)))
    rng = np.random.default_rng(1)
    numbers = [rng.normal(size=n), rng.normal(size=n), rng.integers(-3, 4, n) * 1.0, rng.integers(-3, 4, n) * 1.0]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    model = fit_pairs(schema, numbers, *(rng.integers(0, k, n) for k in (33, 33, 24)), np.where(numbers[2] > 0, 1.0, -1.0), TrainConfig(n_trees=2))
    assert model.trees[0].feature == 2 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000
